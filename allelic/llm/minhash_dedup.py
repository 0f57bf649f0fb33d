"""Near-duplicate documents by SetSketch registers.

A document is its set of distinct word shingles. Register i of a set's sketch is the exponentially spaced, truncated
minimum of the i-th hash over the set, K = clamp(floor(1 - log_b(min / a))); registers of a union are the maxima.
Sketches are cut into bands, and equal band values make candidates; the Jaccard similarity of a candidate pair is
estimated jointly from the counts of smaller, larger and equal registers by maximum likelihood, with a wide margin,
and what is left is confirmed on the full shingle sets.

Work by group size: equal sets are one class. In each bucket every class is compared with the bucket's least class
only (a star). Buckets whose classes are then still in several components are searched in blocks, where all pairs
across components are compared by their sketches; promising ones join into families, by a spanning forest of each block
only, and families are compared on full sets, block by block, of which a spanning forest goes on. No bucket and no family
is capped or handled otherwise for its size. Joins by a hot bucket's key stay sort-merge joins, whose large partitions
adaptive execution splits.

Defined results: a null text and a text without words have an empty set, are linked with nothing and are their own
component. Equal rows and equal ids stay as many rows; a null id comes after all others, and is its
component only where no row with an id is in it. Very long texts are
read whole. Ties go to the least (id, hash of the text). Columns other than doc_id and text aren't read, and pass through
`deduplicate` whatever their names.

Chance of missing a pair at exactly the threshold 0.8: (1 - 0.8**5)**30 = 7e-6 by the bands, below 1e-6 by the margin.

An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, let_go, materialize, ship, small_batches
from .graph import components

BANDS, ROWS = 30, 5
M = BANDS * ROWS
BASE, RATE, TOP = 1.02, 20.0, 65534
#: A pair goes on to the full sets if its estimate is above threshold - MARGIN (over five standard errors).
MARGIN = 0.18
#: Links of a hub that one task confirms together, and the blocks of the search in mixed buckets.
SALT, BLOCK_R, BLOCK_L = 64, 128, 512
#: Rows and shingles of a block within a family.
BLOCK_F, BLOCK_S = 256, 200_000

_ODD = np.random.default_rng(20240229).integers(1 << 63, size=(2, M), dtype=np.uint64)
MULTIPLY, ADD = (_ODD[0] * np.uint64(2) + np.uint64(1))[:, None], (_ODD[1] * np.uint64(2))[:, None]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOW = (1 << 64) - 1


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word k-shingles; A-Z lower-cased, words parted by ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return mix(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=k)], np.uint64))
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(h) - k + 1
    acc = h[:n].copy()
    for i in range(1, k):
        acc = acc * np.uint64(0x9FB21C651E98DF25) + h[i : i + n]
    return np.unique(mix(acc))


def registers(s: np.ndarray) -> np.ndarray:
    """The sketch of a set that isn't empty."""
    low = np.full(M, np.iinfo(np.uint64).max)
    for i in range(0, len(s), 1024):
        np.minimum(low, (s[None, i : i + 1024] * MULTIPLY + ADD).min(axis=1), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 1) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype("<u2")


def estimate(ra: np.ndarray, na: np.ndarray, rb: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs, by rows, from registers and set sizes jointly."""
    more, less = (ra > rb).sum(1), (ra < rb).sum(1)
    same = ra.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def loss(j):
        a, b = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return -(more * np.log(a + tiny) + less * np.log(b + tiny) + same * np.log(np.clip(1 - a - b, tiny, 1)))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    g = (5**0.5 - 1) / 2
    for _ in range(24):  # golden section: the likelihood is unimodal in J
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        left = loss(c) < loss(d)
        hi, lo = np.where(left, d, hi), np.where(left, lo, c)
    return (lo + hi) / 2


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, M)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, cls and check (halves of a digest of the set, null if it is empty) and registers of every row."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64()), ("check", pa.int64()), ("registers", pa.binary())])

    def run(batches):
        let_go()
        for batch in batches:
            n, cls, check, regs = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, k)
                n.append(len(s))
                digest = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None
                cls.append((digest & _LOW) - (1 << 63) if len(s) else None)
                check.append((digest >> 64) - (1 << 63) if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(check, pa.int64()), pa.array(regs, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, cls long, check long, registers binary")


def promising(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes whose estimated similarity is above threshold - MARGIN."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))

    def run(batches):
        let_go()
        for batch in batches:
            if batch.num_rows:
                j = estimate(_matrix(batch.column("ra")), batch.column("na").to_numpy().astype(float), _matrix(batch.column("rb")), batch.column("nb").to_numpy().astype(float))
                yield batch.select(["a", "b"]).filter(pa.array(j >= threshold - MARGIN))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The distinct pairs (a, b) with 100 * |A and B| >= percent * |A or B| on the full sets. A hub's pairs are dealt to several tasks."""
    small_batches(docs.sparkSession)
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    members = pairs.join(hubs, "b").select("b", F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"), F.col("a").alias("cls"))
    heads = hubs.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("b").alias("cls"))
    wanted = members.unionAll(heads)
    rows = wanted.join(texts_of(wanted, classes, docs), "cls").repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("cls") != F.col("b"))

    def run(batches):
        let_go()
        at, own = None, None
        for batch in batches:
            a, b = [], []
            for hub, salt, cls, text in zip(*(batch.column(c).to_pylist() for c in ("b", "salt", "cls", "text")), strict=True):
                if (hub, salt) != at:
                    at, own = (hub, salt), shingles(text, k)  # the hub itself comes first
                    continue
                s = shingles(text, k)
                both = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(s) - both):
                    a.append(cls)
                    b.append(hub)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.select("b", "salt", "cls", "text").mapInArrow(run, "a long, b long")


def across(members: DataFrame, classes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Promising pairs within buckets that still hold several components, other than those with the bucket's centre: of
    each block's pairs a spanning forest.

    Rows outside the centre's component go into blocks of BLOCK_R, all rows into blocks of BLOCK_L; each task compares
    one block of either kind by sketches. A pair is compared in the first band in which its rows agree."""
    rows = members.join(labels.select(F.col("node").alias("cls"), "root"), "cls", "left").select("key", "band", "cls", "center", F.coalesce("root", "cls").alias("comp"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("cls") == F.col("center"), F.col("comp"))).alias("main"))
    mixed = mixed.where("lo != hi").select("key", "main")
    rows = materialize(rows.join(mixed.hint("merge"), "key").where("cls != center"), "mixed")
    # without a main, the centre isn't among the members, and then none of them is in its component
    apart = F.coalesce(F.col("comp") != F.col("main"), F.lit(True))
    counts = rows.groupBy("key").agg(F.ceil(F.count(F.when(apart, 1)) / BLOCK_R).cast("int").alias("rbs"), F.ceil(F.count("*") / BLOCK_L).cast("int").alias("lbs"))
    rows = rows.join(counts.where("rbs > 0").hint("merge"), "key").join(classes.select("cls", F.col("n").alias("size"), "registers"), "cls")
    block = lambda c, n: F.pmod(F.xxhash64(F.lit(c), "cls"), n).cast("int")
    own = rows.where(apart).withColumn("lb", _every("lbs")).select("key", block("r", "rbs").alias("rb"), "lb", F.lit(0).alias("role"), "band", "cls", "comp", "size", "registers")
    other = rows.withColumn("rb", _every("rbs")).select("key", "rb", block("l", "lbs").alias("lb"), F.lit(1).alias("role"), "band", "cls", "comp", "size", "registers")
    dealt = own.unionAll(other).repartition("key", "rb", "lb").sortWithinPartitions("key", "rb", "lb", "role", "cls")

    def compare(held, band):
        own, other = held
        if not own or not other:
            return
        rb, nb, cb, kb = (np.array([x[i] for x in other]) if i else np.frombuffer(b"".join(x[0] for x in other), "<u2").reshape(-1, M) for i in range(4))
        for reg, n, comp, cls in own:
            keep = np.flatnonzero((cb != comp) & (cls != kb))  # only pairs across components
            same = rb[keep] == np.frombuffer(reg, "<u2")
            agree = same.reshape(-1, BANDS, ROWS).all(2)
            # equal registers bound the estimate roughly
            near = keep[(agree.argmax(1) == band) & agree[:, band] & (same.mean(1) >= (threshold - MARGIN) * 0.8)]
            if len(near):
                j = estimate(np.broadcast_to(np.frombuffer(reg, "<u2"), (len(near), M)), np.full(len(near), float(n)), rb[near], nb[near].astype(float))
                yield from ((cls, int(x)) for x in kb[near[j >= threshold - MARGIN]])

    def run(batches):
        let_go()
        at, band, held = None, None, ([], [])
        for batch in batches:
            found = []
            for key, r, l, role, own_band, cls, comp, size, reg in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if (key, r, l) != at:
                    found += spanning(compare(held, band))
                    at, band, held = (key, r, l), own_band, ([], [])
                held[role].append((reg, size, comp, cls))
            yield _pairs(found)
        yield _pairs(spanning(compare(held, band)))

    return dealt.mapInArrow(run, "a long, b long")


def _every(n: str):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def spanning(pairs) -> list[tuple[int, int]]:
    """Those of the pairs that join what earlier ones didn't."""
    up: dict[int, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            up[ra] = rb
            out.append((a, b))
    return out


def within_families(families: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links across components within each family (family, cls, comp), by full sets: a spanning forest of those of each
    pair of blocks. Blocks have about BLOCK_F rows and BLOCK_S shingles at most, and a row goes to as many tasks as its family
    has blocks."""
    small_batches(docs.sparkSession)
    sized = families.join(classes.select("cls", "n"), "cls")
    blocks = sized.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK_F), F.ceil(F.sum("n") / BLOCK_S)).cast("int").alias("blocks"))
    rows = families.join(blocks.hint("merge"), "family").withColumn("own", F.pmod(F.xxhash64("cls"), "blocks").cast("int")).withColumn("other", _every("blocks"))
    rows = rows.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cls", "comp")
    rows = rows.join(texts_of(families.select("cls"), classes, docs), "cls").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "cls")

    def compare(held):
        at, comp = {}, {}
        for side, cls, c, text in held:
            if cls not in at:
                at[cls] = (side, shingles(text, k))
                comp[cls] = c
        ids = sorted(at)
        regs = np.stack([registers(at[x][1]) for x in ids])
        bands = regs.reshape(len(ids), BANDS, ROWS)
        up = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for x in range(len(ids)):
            # later rows that share a band, the likeliest first
            share = (regs[x + 1 :] == regs[x]).mean(1)
            later = np.flatnonzero((bands[x + 1 :] == bands[x]).all(2).any(1) & (share >= (percent / 100 - MARGIN) * 0.8))
            for y in later[np.argsort(-share[later], kind="stable")] + x + 1:
                a, b = ids[x], ids[y]
                ra, rb = root(comp[a]), root(comp[b])
                if ra == rb:
                    continue
                s, t = at[a][1], at[b][1]
                if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                    continue
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    up[ra] = rb
                    out.append((a, b))
        return out

    def run(batches):
        let_go()
        at, held = None, []
        for batch in batches:
            found = []
            for family, i, j, side, cls, comp, text in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if (family, i, j) != at:
                    found += compare(held) if held else []
                    at, held = (family, i, j), []
                held.append((side, cls, comp, text))
            yield _pairs(found)
        yield _pairs(compare(held) if held else [])

    return rows.select("family", "i", "j", "side", "cls", "comp", "text").mapInArrow(run, "a long, b long")


def texts_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """cls and text of the classes wanted."""
    reps = wanted.select("cls").distinct().join(classes.select("cls", "rep"), "cls").select("cls", F.col("rep.doc_id").alias("_id"), F.col("rep.text_hash").alias("_th"))
    reps = materialize(reps, "reps")
    if reps.count() <= 1_000_000:  # 24 MB; beyond it, a shuffle join
        reps = F.broadcast(reps)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h")).join(reps, (F.col("_h") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return texts.groupBy("cls").agg(F.min("text").alias("text"))


def _pairs(found) -> pa.RecordBatch:
    found = list(found)
    return pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _own():
    """What a component's rows are ordered by: ids that are null come last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id (least doc_id reachable by links), kept and first, for every row of docs."""
    threshold = percent / 100
    sk = materialize(sketches(docs, k), "sketches")
    full = sk.where("cls is not null")
    grouped = lambda full: materialize(full.groupBy("cls").agg(F.min(_own()).alias("rep"), F.max("n_shingles").alias("n"), F.min("registers").alias("registers"), F.min("check").alias("lo"), F.max("check").alias("hi")), "classes")
    classes = grouped(full)
    if not classes.where("lo != hi").isEmpty():  # sets whose digests agree in one half only: both halves name the class
        twice = classes.where("lo != hi").select(F.col("cls").alias("_c"))
        full = full.join(twice.hint("merge"), F.col("cls") == F.col("_c"), "left").withColumn("cls", F.when(F.col("_c").isNull(), F.col("cls")).otherwise(F.xxhash64("cls", "check"))).drop("_c")
        classes = grouped(full)
    # an expression over the bands' numbers: thirty of them spelled out make a very large method
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    bands = classes.select("cls", F.posexplode(keys).alias("band", "key"))
    buckets = bands.groupBy("key").agg(F.min("cls").alias("center"), F.count("*").alias("n")).where("n > 1")
    members = written = materialize(bands.join(buckets.hint("merge"), "key"), "members")
    ordered = lambda p: p.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tested = materialize(ordered(promising(members.where("cls != center").select(F.col("cls").alias("a"), F.col("center").alias("b")).distinct(), classes, threshold)), "tested")
    labels = components(confirmed(tested, classes, docs, k, percent))
    members = members.where("n > 2")
    # what may link across components: families of promising pairs, compared within
    label = labels.select(F.col("node").alias("cls"), "root")
    promise = materialize(across(members, classes, labels, threshold), "promise")
    families = None
    if not promise.isEmpty():
        families = components(promise.unionAll(labels.select(F.col("node").alias("a"), F.col("root").alias("b")))).select(F.col("node").alias("cls"), F.col("root").alias("family"))
        open_ = families.join(promise.select(F.col("a").alias("cls")).distinct(), "cls").groupBy("family").agg(F.lit(1).alias("open"))
        families = families.join(open_.hint("merge"), "family").join(label, "cls", "left").select("family", "cls", F.coalesce("root", "cls").alias("comp"))
        families = materialize(families, "families")
        more = within_families(families, classes, docs, k, percent)
        labels = components(more.unionAll(labels.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    discard(written, tested, promise, *([families] if families is not None else []))
    reps = classes.select("cls", "rep")
    linked = labels.join(reps, labels["node"] == reps["cls"]).select("cls", "root", "rep")
    least = linked.groupBy("root").agg(F.min("rep").alias("first"))
    linked = linked.join(least, "root").select("cls", "first")
    known = reps.join(linked, "cls", "left").select("cls", F.coalesce("first", "rep").alias("first"))
    own = _own()
    rows = full.join(known, "cls", "left").select("doc_id", "text_hash", "n_shingles", "first")
    rows = rows.unionAll(sk.where("cls is null").select("doc_id", "text_hash", "n_shingles", own.alias("first")))
    # first: whether the row is its component's first by doc_id and text hash; several equal rows can be
    return rows.select("doc_id", "text_hash", "n_shingles", F.col("first.doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("first.doc_id"), F.lit(False)).alias("kept"), own.eqNullSafe(F.col("first")).alias("first"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each group of near-duplicates. Rows with an empty set stay."""
    rows = near_duplicates(docs, k, percent)
    full = rows.where("n_shingles > 0")
    gone = materialize(full.groupBy("doc_id", "text_hash").agg(F.min("first").alias("first"), F.count("*").alias("n")).where("not first or n > 1"), "gone")
    h, i, th, first, row = (free_name(docs.columns, c) for c in ("_h", "_id", "_th", "first", "_row"))
    gone = gone.select(F.col("doc_id").alias(i), F.col("text_hash").alias(th), F.col("first").alias(first))
    if gone.count() <= 1_000_000:  # 20 MB; beyond it, a shuffle join
        gone = F.broadcast(gone)
    marked = docs.withColumn(h, F.xxhash64("text"))
    at = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(h) == F.col(th))
    own = [F.col(f"`{c}`") for c in docs.columns]
    stay = marked.join(gone, at, "left_anti").select(*own)
    # firsts that occur as several equal rows
    repeated = marked.join(gone.where(F.col(first)), at).groupBy(i, th).agg(F.min(F.struct(*own)).alias(row))
    return stay.unionAll(repeated.select(f"{row}.*"))


ship(__name__)
