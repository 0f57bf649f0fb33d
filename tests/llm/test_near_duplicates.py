import random
from itertools import combinations

import numpy as np
import pytest

from allelic.llm import graph, minhash_dedup
from allelic.llm.minhash_dedup import estimate, near_duplicates, registers, shingles


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randint(0, 5000)}" for _ in range(n)]


def edited(w, k, seed):
    r = random.Random(seed)
    w = list(w)
    for i in r.sample(range(len(w)), k):
        w[i] = f"e{r.randint(0, 10**6)}"
    return w


def brute(rows, k, percent):
    sets = [frozenset(shingles(t, k).tolist()) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            up[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    return {(rows[i][0], rows[i][1]): min(groups[root(i)]) for i in range(len(rows))}, sets


@pytest.fixture(scope="module")
def rows():
    out, n = [], 0
    for g in range(12):
        base = words(random.Random(g).randint(30, 400), g)
        for c in range(random.Random(g).randint(1, 9)):
            out.append((n := n + 1, " ".join(edited(base, c * len(base) // 100, 100 * g + c))))
    # a large family around one text, whose members are linked to some others only
    base = words(150, 99)
    out += [(n := n + 1, " ".join(edited(base, i % 7, i))) for i in range(120)]
    out += [(n := n + 1, out[3][1].upper()), (n := n + 1, ""), (n := n + 1, ""), (n := n + 1, None), (n := n + 1, "two words"), (n := n + 1, "Two  WORDS"), (n := n + 1, "word " * 20000)]
    random.Random(1).shuffle(out)
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_against_brute_force(spark, rows, k):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_duplicates(df, k, 80).collect()
    want, sets = brute(rows, k, 80)
    assert len(got) == len(rows)
    by_id = {i: (t, s) for (i, t), s in zip(rows, sets, strict=True)}
    for r in got:
        text, s = by_id[r["doc_id"]]
        assert r["n_shingles"] == len(s)
        assert r["component_id"] == want[r["doc_id"], text]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_families_of_many_blocks(spark, rows, monkeypatch):
    """A family cut into many blocks, by rows and by shingles, gives the same."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute(rows, 4, 80)
    for name, value in (("BLOCK_F", 7), ("BLOCK_S", 900)):
        monkeypatch.setattr(minhash_dedup, name, value)
        assert {r["doc_id"]: r["component_id"] for r in near_duplicates(df, 4, 80).collect()} == {i: c for (i, _), c in want.items()}
        monkeypatch.undo()


def test_digests_that_collide(spark, rows, monkeypatch):
    """Different sets with one half of their digests equal stay apart."""
    monkeypatch.setattr(minhash_dedup, "_LOW", 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute(rows, 4, 80)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(df, 4, 80).collect()} == {i: c for (i, _), c in want.items()}


def test_buckets_with_other_centres(spark):
    """Two similar texts meet in no bucket but those whose least class is a text unlike both."""
    k, base = 4, words(200, 7)
    digest = lambda w: minhash_dedup.xxhash.xxh3_128_intdigest(shingles(" ".join(w), k).tobytes()) & minhash_dedup._LOW
    sketch = lambda w: registers(shingles(" ".join(w), k))
    bands = lambda r: r.reshape(-1, minhash_dedup.ROWS)
    # of many texts those of greatest digests, so that others are the centres
    a = max((edited(base, 1, i) for i in range(60)), key=digest)
    b = max((edited(a, 4, i) for i in range(60)), key=digest)
    rows = [(1, " ".join(a)), (2, " ".join(b))]
    ra, rb = sketch(a), sketch(b)
    alone = np.stack([sketch(a[p : p + k]) for p in range(len(a) - k + 1)])
    for band in np.flatnonzero((bands(ra) == bands(rb)).all(1)):
        # a text of the few shingles that make the band's registers
        at = [int(np.flatnonzero(alone[:, i] == ra[i])[0]) for i in range(band * minhash_dedup.ROWS, (band + 1) * minhash_dedup.ROWS)]
        tries = ([x for p in at for x in (*a[p : p + k], f"f{seed}")] for seed in range(200))
        c = next(w for w in tries if digest(w) < min(digest(a), digest(b)) and (bands(sketch(w))[band] == bands(ra)[band]).all())
        rows.append((len(rows) + 1, " ".join(c)))
    assert len(rows) > 2
    want, _ = brute(rows, k, 80)
    assert want[rows[1]] == 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(df, k, 80).collect()} == {i: c for (i, _), c in want.items()}


def test_repeated_rows_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (1, "other text that is here now", "x"), (None, "a b c d e f", "y"), (2, None, None)], "doc_id long, text string, component_id string")
    assert near_duplicates(df.drop("component_id"), 4).count() == 5
    kept = minhash_dedup.deduplicate(df, 4).collect()
    assert len(kept) == 3 and kept[0].__fields__ == ["doc_id", "text", "component_id"]
    assert near_duplicates(df.limit(0), 4).count() == 0
    assert minhash_dedup.deduplicate(df.limit(0), 4).count() == 0


def test_estimate_is_near_the_truth():
    r = np.random.default_rng(3)
    errors = []
    for j in (0.3, 0.6, 0.8, 0.95):
        for _ in range(6):
            n = 600
            both = int(2 * n * j / (1 + j))
            pool = r.integers(1 << 63, size=2 * n, dtype=np.uint64)
            a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
            e = estimate(registers(a)[None], np.array([float(len(a))]), registers(b)[None], np.array([float(len(b))]))[0]
            errors.append(abs(e - both / (2 * n - both)))
    assert max(errors) < 0.16 and np.mean(errors) < 0.05


def test_registers_of_a_union_are_the_maxima():
    r = np.random.default_rng(5)
    a, b = (r.integers(1 << 63, size=300, dtype=np.uint64) for _ in range(2))
    assert (registers(np.concatenate([a, b])) == np.maximum(registers(a), registers(b))).all()


@pytest.mark.parametrize("few", [10**6, 0])
def test_components(spark, few):
    r = random.Random(2)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long").repartition(4), few).collect()))
    assert got == {x: root(x) for x in up}
