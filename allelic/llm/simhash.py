"""SimHash fingerprints with DataFrame functions only.

A term is a word with its successor; its 64-bit hash votes on 64 signed bits with a weight that grows with the term's
length, once for each occurrence. Votes are summed in generated code, several counts to a long.

`within` finds the fingerprints within a Hamming radius with permuted block tables: 64 bits are cut into blocks, and
fingerprints that differ in at most r bits agree on some choice of (blocks - r) blocks; each choice is a table keyed by
those blocks' bits.

Defined results: a null text counts as empty; the fingerprint of a text without words is 0. Equal texts have equal
fingerprints. Equal rows stay as many rows; of those, each but the last is followed by its like. Rows with a null id come
last in the order of ids; rows with equal ids are ordered by their texts' hash. A very long text is one row of one task's
range, and no cap applies to it. Only the named columns are read, so clashing names of others don't matter.

An empty table gives an empty one.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BITS = 64
#: The lowest bit of each of the four counts in a long, and terms whose weights fit into one of them.
LANES, CHUNK = 0x0001000100010001, 2047
#: A term's weight is its number of characters, up to this bound.
HEAVIEST = 16
#: Characters in one range of ids, ranges that one task sorts to find each row's successor, and the unit of lengths.
RANGE_CHARS, RANGES_A_TASK, UNIT = 1 << 20, 8, 1 << 12
#: Ranges at most (beyond it they grow, and sorting spills); they are found by a search of levels, each so wide.
MOST_RANGES, WIDE = 1 << 18, 64


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda w: F.length(w) > 0)


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and the fingerprint (long) of each row; the keys must tell rows apart.

    Four counts of 16 bits share a long, so that 16 sums hold all 64; a part of CHUNK terms can't overflow them. Where df is
    partitioned by one of the keys, nothing is shuffled."""
    w = df.select(*keys, words(F.col(text)).alias("_w"))
    pairs = w.select(*keys, F.posexplode_outer(F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", 2, 1 << 30).alias("b"))).alias("_at", "_p"))
    weight = F.when(F.col("_p").isNull(), F.lit(0)).otherwise(F.least(F.lit(HEAVIEST), F.length("_p.a") + F.coalesce(F.length("_p.b"), F.lit(0)))).cast("long")
    pairs = pairs.select(*keys, F.floor(F.coalesce("_at", F.lit(0)) / CHUNK).cast("int").alias("_chunk"), F.xxhash64("_p.a", "_p.b").alias("_vote"), weight.alias("_weight"))
    votes = [F.sum(F.shiftrightunsigned("_vote", j).bitwiseAND(F.lit(LANES)) * F.col("_weight")).alias(f"_s{j}") for j in range(16)]
    parts = pairs.groupBy(*keys, "_chunk").agg(F.sum("_weight").alias("_all"), *votes)
    summed = parts.groupBy(*keys).agg(F.sum("_all").alias("_all"), F.collect_list(F.array(*[f"_s{j}" for j in range(16)])).alias("_parts"))
    # on the few rows that are left, an expression over arrays instead of 64 spelled out, which make a very large method
    bits = F.expr("""aggregate(sequence(0, 63), 0L, (acc, i) -> acc | if(2 * aggregate(_parts, 0L, (n, p) -> n + (shiftrightunsigned(element_at(p, i % 16 + 1), cast(i div 16 * 16 as int)) & 65535L)) > _all, shiftleft(1L, i), 0L))""")
    return summed.select(*keys, bits.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _count(cuts: list, c: Column, kind: str, below: bool) -> Column:
    """How many of the sorted cuts are below c, or not above it: a search of as many levels as WIDE-fold steps need."""
    if not cuts:
        return F.lit(0)
    # one constant, folded once: a literal for each cut would be a call for each
    array = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast(f"array<{kind}>")
    fits = lambda x: x < c if below else x <= c
    step = WIDE
    while step < len(cuts):
        step *= WIDE
    found = F.lit(0)
    while step >= 1:
        level = cuts[step - 1 :: step]
        if level:
            # the cuts of this level that stand under the one found above
            part = F.slice(array(level), (found / step).cast("int") + 1, F.lit(WIDE)) if len(level) > WIDE else array(level)
            done = (found / step).cast("int") if len(level) > WIDE else F.lit(0)
            found = (done + F.array_size(F.filter(part, fits))) * step
        step //= WIDE
    return found


def _spread(tie: Column, parts: Column) -> Column:
    """The part of 0 to parts - 1 that a hash falls into, ascending with the hash."""
    unit = tie / F.lit(2.0**64) + 0.5
    return F.least(F.floor(unit * parts).cast("int"), (parts - 1).cast("int"))


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, range, seat, guest, next_key and next_text: the row that comes next by descending key (after the last row:
    the first; nulls come last; ties go by the text's hash, descending). seat numbers the rows of a range in this order.

    The rows are dealt by ranges of (key, hash), which hold about RANGE_CHARS characters each however long the texts and
    however frequent a key are: a key with many rows is cut by the hash. What bounds the ranges comes from keys, lengths and
    hashes alone. A range's first row also visits the range above it, as a guest, so that whole texts are dealt once; guests
    come last in their range; the row after theirs means nothing. Rows with equal keys and texts stand in one range."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    df = df.select(key, F.coalesce(text, F.lit("")).alias(text)).withColumn("tie", F.xxhash64(text))
    narrow = materialize(df.select(key, "tie", F.length(text).alias("n")), "lengths")
    units = F.ceil((F.col("n") + 1) / UNIT).cast("int")
    rows, known, unknown = narrow.agg(F.count("*"), F.sum(F.when(F.col(key).isNotNull(), units)), F.sum(F.when(F.col(key).isNull(), units))).first()
    each = max(RANGE_CHARS // UNIT, -(-((known or 0) + (unknown or 0)) // MOST_RANGES))
    ranges, nulls = -(-(known or 0) // each), -(-(unknown or 0) // each)
    cuts = []
    if ranges > 1:
        copies = narrow.where(F.col(key).isNotNull()).select(key, F.explode(F.array_repeat(F.lit(0), units)))
        cuts = sorted(int(x) for x in copies.approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.1 / ranges))
    upto, under = _count(cuts, F.col(key), kind, False), _count(cuts, F.col(key), kind, True)
    at = F.when(upto - under > 1, under + 1 + _spread(F.col("tie"), upto - under)).otherwise(upto)
    at = F.when(F.col(key).isNull(), _spread(F.col("tie"), F.lit(max(1, nulls))) - max(1, nulls)).otherwise(at).cast("int")
    tops = {r["range"]: r["top"] for r in narrow.select(at.alias("range"), key, "tie").groupBy("range").agg(F.max(F.struct(key, "tie")).alias("top")).collect()}  # one small row for each range
    down = sorted(tops, reverse=True)
    guests = [(tops[s][key], tops[s]["tie"], r) for r, s in zip(down, [*down[1:], *down[:1]], strict=True)]
    guests = F.broadcast(spark.createDataFrame(guests, f"_key {kind}, _tie long, _to int"))
    dealt = df.withColumn("range", at).join(guests, F.col(key).eqNullSafe(F.col("_key")) & (F.col("tie") == F.col("_tie")), "left")
    seats = F.array(F.struct(F.col("range").alias("r"), F.lit(False).alias("g")), F.struct(F.col("_to").alias("r"), F.lit(True).alias("g")))
    dealt = dealt.select(key, text, "tie", F.explode(F.filter(seats, lambda x: x["r"].isNotNull())).alias("_seat")).select(key, text, "tie", F.col("_seat.r").alias("range"), F.col("_seat.g").alias("guest"))
    dealt = dealt.repartition(max(1, -(-(ranges + nulls) // RANGES_A_TASK)), "range")
    seats = Window.partitionBy("range").orderBy("guest", F.col(key).desc_nulls_last(), F.col("tie").desc())
    return dealt.select(key, text, "range", F.row_number().over(seats).alias("seat"), "guest", F.lead(key).over(seats).alias("next_key"), F.lead(text).over(seats).alias("next_text"))


def within(fps: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6, fp: str = "fingerprint") -> DataFrame:
    """(query, fingerprint, distance) for every pair of a distinct query fingerprint and a distinct fingerprint that
    differ in at most `radius` bits; each pair once. Permuted block tables: choose (blocks - radius) blocks as the key."""
    if blocks <= radius:
        raise ValueError("more blocks than the radius are needed")
    cut = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (cut[b + 1] - cut[b])) - 1) << cut[b] for b in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m

    def tables(df: DataFrame, name: str) -> DataFrame:
        # a table's number and its bits in one long; what meets by chance is told apart below
        keys = F.array(*[F.xxhash64(F.lit(i), F.col(fp).bitwiseAND(F.lit(signed(m)).cast("long"))) for i, m in enumerate(masks)])
        return df.where(F.col(fp).isNotNull()).select(fp).distinct().select(F.col(fp).alias(name), F.posexplode(keys).alias("t", "_k"))

    both = tables(queries, "query").join(tables(fps, "fingerprint").withColumnRenamed("t", "_t"), "_k").where("t = _t")
    gap = F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint")))
    # a pair is kept by the first table that holds it
    agree = F.col("query").bitwiseXOR(F.col("fingerprint"))
    first = F.coalesce(*[F.when(agree.bitwiseAND(F.lit(signed(m)).cast("long")) == 0, F.lit(i)) for i, m in enumerate(masks)])
    return both.where((gap <= radius) & (F.col("t") == first)).select("query", "fingerprint", gap.alias("distance"))


def near_counts(rows: DataFrame, queries: DataFrame, radius: int = 3, fp: str = "fingerprint") -> DataFrame:
    """fp and n_within for each distinct fingerprint of queries: how many of the rows lie within the radius."""
    counts = rows.groupBy(F.col(fp).alias("fingerprint")).agg(F.count("*").alias("_n"))
    pairs = within(rows, queries, radius, fp=fp)
    return pairs.join(counts, "fingerprint").groupBy(F.col("query").alias(fp)).agg(F.sum("_n").alias("n_within"))
