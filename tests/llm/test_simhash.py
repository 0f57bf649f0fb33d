import hashlib
import random

import pytest
from pyspark.sql import functions as F

from allelic.llm import queries, simhash


def fps(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {r["i"]: r["fingerprint"] for r in simhash.fingerprints(df, ["i"], "text").collect()}


def test_equal_texts_and_empty(spark):
    got = fps(spark, ["the cat sat on the mat", "the cat sat on the mat", "", "...", "one"])
    assert got[0] == got[1]
    assert got[2] == got[3] == 0


def test_votes_by_hand(spark):
    r = random.Random(1)
    # the longer ones' votes don't fit into one part's counts
    texts = ["alpha beta gamma alpha beta", "one", " ".join(r.choice(["alpha", "betagamma", "c", "délta"]) for _ in range(9000)), "sixteenletterword " * 5000]
    for got, text in zip(map(fps(spark, texts).get, range(4)), texts, strict=True):
        words = text.split()
        pairs = list(zip(words, [*words[1:], None], strict=True))
        known = spark.createDataFrame(sorted(set(pairs), key=str), "a string, b string").select("a", "b", F.xxhash64("a", "b")).collect()
        hashes = {(x[0], x[1]): x[2] & (2**64 - 1) for x in known}
        weights = [min(simhash.HEAVIEST, len(a) + len(b or "")) for a, b in pairs]
        want = sum(1 << j for j in range(64) if 2 * sum(w for p, w in zip(pairs, weights, strict=True) if hashes[p] >> j & 1) > sum(weights))
        assert got & (2**64 - 1) == want


def followers(spark, rows):
    """Each row with the one that comes next, by hand."""
    ties = dict(spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t")).distinct().collect())
    order = sorted(((i, t or "") for i, t in rows), key=lambda k: (k[0] is not None, k[0] or 0, ties[k[1]]), reverse=True)
    return list(zip(order, [*order[1:], *order[:1]], strict=True))


def odd_rows():
    r = random.Random(5)
    rows = [(i * 5, " ".join(r.choice(["alpha", "Beta", "gamma,", "δέλτα", "e"]) for _ in range(r.randint(0, 40)))) for i in range(300)]
    return rows + [(30, f"tie {i}") for i in range(60)] + [(40, "same same")] * 5 + [(None, f"null {i}") for i in range(30)] + [(None, None), (7, None), (8, ""), (9, "word " * 30000), (10, "x" * 50000)]


@pytest.mark.parametrize("chars", [1 << 20, 1 << 12])
def test_next_of_all_rows(spark, monkeypatch, chars):
    """With many ranges too, and a key and nulls that fill several of them."""
    monkeypatch.setattr(simhash, "RANGE_CHARS", chars)
    monkeypatch.setattr(simhash, "UNIT", 1 << 7)
    monkeypatch.setattr(simhash, "WIDE", 4)
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = simhash.with_next(df.withColumn("range", F.lit("clash")), "doc_id", "text").where("not guest").collect()
    got = sorted(((r["doc_id"], r["text"]), (r["next_key"], r["next_text"])) for r in found if r["doc_id"] is not None)
    assert got == sorted(x for x in followers(spark, [(i, t) for i, t in rows]) if x[0][0] is not None)
    assert len(found) == len(rows) and (len({r["range"] for r in found}) > 15) == (chars < 1 << 20)


def test_next_of_one_and_none(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert simhash.with_next(df, "doc_id", "text").where("not guest").first()["next_text"] == "a"
    assert simhash.with_next(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("chars", [1 << 20, 1 << 12])
def test_the_query_against_brute_force(spark, tmp_path, monkeypatch, chars):
    monkeypatch.setattr(simhash, "RANGE_CHARS", chars)
    monkeypatch.setattr(simhash, "UNIT", 1 << 7)
    rows = odd_rows()
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want, texts = [], set()
    for (i, text), (_, after) in followers(spark, rows):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        texts |= {text, edited, after}
        want.append((i, text, edited, after))
    texts = sorted(texts)
    fp = {texts[i]: x & (2**64 - 1) for i, x in fps(spark, texts).items()}
    like = lambda a, b: 1 - (fp[a] ^ fp[b]).bit_count() / 64
    asked = lambda i, t: sum((fp[t] ^ fp[u or ""]).bit_count() <= 3 for _, u in rows) - 1 if i is not None and i % 50 == 0 else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    full = [(i, len(t), sha(e), f"{fp[t]:016x}", f"{fp[e]:016x}", like(t, e), like(t, u), asked(i, t)) for i, t, e, u in want]
    got = [tuple(r) for r in queries.op8_simhash(spark, str(tmp_path)).collect()]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(full, key=key)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op8_simhash(spark, f"{tmp_path}/none").count() == 0


def test_within_is_exact(spark):
    random.seed(4)
    base = [random.getrandbits(64) for _ in range(40)]
    all_ = base + [b ^ sum(1 << j for j in random.sample(range(64), random.randint(1, 5))) for b in base for _ in range(3)]
    signed = [x - (1 << 64) if x >> 63 else x for x in all_]
    df = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    got = {(r["query"], r["fingerprint"]) for r in simhash.within(df, df.limit(60), radius=3).collect()}
    queries = {r["fingerprint"] for r in df.limit(60).collect()}
    want = {(a, b) for a in queries for b in set(signed) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want
