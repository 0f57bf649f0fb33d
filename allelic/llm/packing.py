"""Best-fit packing into sequences of several permitted lengths.

Pieces are taken from the longest to the shortest. A piece goes into the open bin, of whatever capacity, that it fills
best; where none has room, a bin of one of the permitted capacities is opened. Which, is searched for jointly over all
capacities: by the least cost for each token that it can still be filled with, and, besides, with each capacity as the
preferred one; of these packings the cheapest counts. At the end every bin shrinks to the smallest capacity that holds its
contents, and the costs compared are those of the shrunk bins. Texts longer than the largest capacity are cut into pieces of
that capacity.

Pieces are dealt by the hash of their key to shards of about SHARD pieces, so that the packing doesn't depend on the order or
the partitions of the rows; only ids and lengths move, never texts. `assemble` puts the tokens of the pieces into sequences.

Defined results: rows of length 0 or null have one piece of length 0 without a bin. Equal rows are packed as many times
as they occur. Ties in length go by key, those in cost to the rule first tried. Very long texts become many pieces. Keys may
be null and may have any name but those of the results (piece, start, length, bin_id, offset, capacity); a key so named is an
error. Other columns aren't read.

An empty table gives no piece.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let_go, materialize, ship

CAPACITIES = (256, 512, 1024, 2048)
SHARD = 4096
RESULTS = ("piece", "start", "length", "bin_id", "offset", "capacity")


def cost(capacity: int) -> float:
    """Of one sequence: linear work, attention that grows with the square, and a fixed part."""
    return capacity + capacity**2 / 16384 + 64


def bound(lengths: list[int], capacities=CAPACITIES, cost=cost) -> float:
    """No packing costs less: every token at the rate of the cheapest full sequence."""
    return sum(lengths) * min(cost(c) / c for c in capacities)


def pack_by(lengths: list[int], sizes: list[int], cost, preferred: int | None) -> tuple[float, list[tuple[int, int, int]]]:
    """Best fit with one rule of opening: the cost, and (bin, offset, capacity) of each length."""
    left = sum(lengths)
    room: list[tuple[int, int]] = []  # (room, bin) of the open bins
    used, at = [], [(0, 0)] * len(lengths)
    rate = {c: cost(c) for c in sizes}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        k = bisect_left(room, (n, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            b = len(used)
            fitting = [c for c in sizes if c >= n]
            free = preferred if preferred in fitting else min(fitting, key=lambda c: (rate[c] / min(c, left), c))
            used.append(0)
        at[i] = (b, used[b])
        used[b] += n
        left -= n
        if free > n:
            insort(room, (free - n, b))
    final = [next(c for c in sizes if c >= u) for u in used]
    return sum(map(cost, final)), [(b, offset, final[b]) for b, offset in at]


def pack_lengths(lengths: list[int], capacities=CAPACITIES, cost=cost) -> list[tuple[int, int, int]]:
    """(bin, offset, capacity of the bin) of each length by the cheapest of all rules; bins are numbered as they open."""
    sizes = sorted(capacities)
    tried = (pack_by(lengths, sizes, cost, preferred) for preferred in (None, *reversed(sizes)))
    return min(tried, key=lambda x: x[0])[1]


def pack(df: DataFrame, keys: list[str], length: Column, capacities=CAPACITIES) -> DataFrame:
    """keys, piece, start, length, bin_id, offset and capacity of every piece of every row."""
    clash = [k for k in keys if k.lower() in RESULTS]
    if clash:
        raise ValueError(f"keys named like results: {clash}")
    top = max(capacities)
    rows = df.select(*keys, F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("length"))
    # equal rows are counted, so that a row with many copies is dealt to many shards
    rows = rows.groupBy(*keys, "length").agg(F.count("*").alias("start"))
    rows = rows.select(*keys, "length", F.explode(F.sequence(F.lit(1).cast("long"), "start")).alias("offset"))
    pieces = rows.select(*keys, "length", "offset", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(0L, (length - 1) div {top})"))).alias("piece"))
    pieces = pieces.select(*keys, "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top).cast("long"), F.col("length") - F.col("piece") * top).alias("length"), F.xxhash64(*keys, "offset", "piece").alias("bin_id"))
    pieces = materialize(pieces, "pieces")
    shards = max(1, -(-pieces.count() // SHARD))
    full = [*keys, "piece", "start", "length"]
    schema = pieces.select(*full).limit(0).selectExpr("*", "0L as bin_id", "0L as offset", "0L as capacity").schema
    some = pieces.where("length > 0").withColumn("offset", F.least(F.floor((F.col("bin_id") / F.lit(2.0**64) + 0.5) * shards), F.lit(shards - 1)).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        let_go()
        pdf = pdf.sort_values(["length", "bin_id", "start"], ascending=[False, True, True], kind="stable")
        bins, offsets, sizes = zip(*pack_lengths(pdf["length"].tolist(), capacities), strict=True)
        return pdf[full].assign(bin_id=[int(pdf["offset"].iloc[0]) << 32 | b for b in bins], offset=offsets, capacity=sizes)

    packed = some.groupBy("offset").applyInPandas(run, schema)
    empty = pieces.where("length <= 0").select(*full, *(F.lit(None).cast("long").alias(c) for c in ("bin_id", "offset", "capacity")))
    return packed.unionAll(empty)


def assemble(packed: DataFrame, tokens: DataFrame, keys: list[str], ids: str = "ids", pad: int = 0) -> DataFrame:
    """bin_id, capacity, ids and segments of each sequence: the pieces' tokens by offset, padded to the capacity, and for
    each place the number of its piece (0 where it is padding). Keys must be unique in tokens. A sequence is no longer than
    the largest capacity, so that no group is large."""
    cut = packed.where("bin_id is not null").join(tokens.select(*keys, F.col(ids).alias("_ids")), keys)
    part = F.struct("offset", F.slice("_ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("t"))
    bins = cut.groupBy("bin_id", "capacity").agg(F.array_sort(F.collect_list(part)).alias("_p"))
    rest = (F.col("capacity") - F.aggregate("_p", F.lit(0), lambda n, p: n + F.size(p["t"]))).cast("int")
    kind = dict(tokens.dtypes)[ids]
    filled = lambda x, value: F.concat(x, F.array_repeat(value, rest))
    segments = F.flatten(F.transform("_p", lambda p, i: F.array_repeat(i + 1, F.size(p["t"]))))
    return bins.select("bin_id", "capacity", filled(F.flatten(F.transform("_p", lambda p: p["t"])), F.lit(pad)).cast(kind).alias(ids), filled(segments, F.lit(0)).alias("segments"))


ship(__name__)
