"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for each operator."""

import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from allelic.llm import bpe, common, html_extract, lang_id, minhash_dedup, packing, queries, token_counts, toxicity, vector_join
from allelic.llm.queries import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every oddity, and columns named like the operators' own."""
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (None, "a b c d e f"), (4, "word " * 60_000), (5, "x" * 200_000), (6, "\x00 ﻿ é"), (7, "123 !!")]
    df = spark.createDataFrame([(*r, "la", "s") for r in rows], "doc_id long, text string, lang string, source string")
    for c in ("ids", "decoded", "n_tokens", "lang_pred", "score", "predicted", "n_chars", "cls", "key", "_text", "_ids"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_bpe(spark, odd):
    whole = Tokenizer.from_file(PATH)
    out = bpe.decode(bpe.encode(odd, PATH), PATH)
    assert sorted(out.columns) == sorted(odd.columns)
    for r in out.collect():
        want = whole.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == whole.decode(want, skip_special_tokens=False) and r["_text"] == r["n_tokens"] == "clash"
    counts = bpe.token_counts(odd, PATH).collect()
    assert len(counts) == odd.count() and counts[0]["_text"] == "clash"


def test_bpe_digests_of_documents(spark):
    """What the query returns, against the library, for every document."""
    whole = Tokenizer.from_file(PATH)
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.op10_bpe(spark, SF).collect():
        ids = whole.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(whole.decode(ids, skip_special_tokens=False)))


def test_memories_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 50)
    monkeypatch.setattr(bpe, "PAIRS", 50)
    coder, whole = bpe.Coder(bpe.Vocabulary(json.load(open(PATH)))), Tokenizer.from_file(PATH)
    for i in range(30):
        texts = [" ".join(f"w{i}x{j}y" for j in range(20)) + " " + "z" * 500]
        assert coder.encode(texts)[0] == whole.encode(texts[0], add_special_tokens=False).ids
    assert len(coder.known) <= 200 and max(map(len, coder.known)) <= bpe.SHORT_WORD


def test_token_counts_of_a_vocabulary(spark, tmp_path):
    """op2's totals, counted by the library and by hand."""
    whole, split = Tokenizer.from_file(PATH), regex.compile(bpe.SPLIT)
    labels = {}
    for r in table(spark, SF, "labels").collect():
        x = labels.setdefault(r["doc_id"], [0, 9])
        x[0], x[1] = max(x[0], r["toxic"]), min(x[1], r["quality"])
    want = {}
    for r in table(spark, SF, "documents").collect():
        toxic, quality = labels.get(r["doc_id"], (0, 1))
        if toxic == 1:
            continue
        text = r["text"] or ""
        tokens = len(whole.encode(text, add_special_tokens=False).ids)
        for version, n in (("byte-bpe-50k", tokens + (quality == 0)), ("byte-split", len(split.findall(text)))):
            x = want.setdefault((r["source"], r["lang"], version), [0, 0])
            x[0], x[1] = x[0] + 1, x[1] + n
    got = {(r["source"], r["lang"], r["version"]): [r["docs"], r["tokens"]] for r in queries.op2_token_counts(spark, SF).collect()}
    assert got == want


def test_rollup_commits_once(spark, odd, tmp_path):
    rollup = token_counts.Rollup(spark, f"{tmp_path}/rollup")
    delta = token_counts.changes(odd, "insert", F.lit("v"), F.length("text"))
    assert rollup.commit("a", delta) and not rollup.commit("a", delta)
    # a second driver that has looked before the first one committed
    draft = f"{tmp_path}/rollup/draft/x"
    delta.write.parquet(draft)
    assert not rollup._rename(draft, f"{tmp_path}/rollup/log/batch-a")
    once = rollup.totals().collect()
    for i in range(4):
        rollup.compact()
        assert not rollup.commit("a", delta)
        rollup.commit(f"none{i}", delta.limit(0))
        assert rollup.totals().collect() == once
    assert len(rollup._names("base")) <= 2 and once[0]["docs"] == odd.count()
    assert token_counts.Rollup(spark, f"{tmp_path}/other").totals().count() == 0


def test_classifiers_keep_other_columns(spark, odd):
    for out in (lang_id.identify(odd, None), toxicity.score(odd, None)):
        assert sorted(out.columns) == sorted({*odd.columns}) and out.count() == odd.count() and out.first()["ids"] == "clash"


def test_every_language_is_learnt(spark):
    """More than two hundred languages, each of letters of its own."""
    rows = [(i, " ".join([chr(0x4E00 + 40 * (i % 230) + j) * 2 for j in range(30)]), f"l{i % 230:03}") for i in range(230 * 8)]
    model = lang_id.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len({lang for lang, _ in model}) == 230


def test_near_duplicates(spark, odd):
    got = minhash_dedup.near_duplicates(odd, 5).collect()
    assert len(got) == odd.count() and {r["component_id"] for r in got if r["doc_id"] == 1} == {1}
    kept = minhash_dedup.deduplicate(odd, 5)
    assert kept.columns == odd.columns and kept.where("doc_id = 1").count() == 1


def test_packing_by_hand(spark, odd):
    """All rules' cheapest against every packing of a few pieces, and the bound that none goes below."""
    r = np.random.default_rng(3)
    sizes = (4, 8, 16)
    cost = lambda c: c + c * c / 32 + 1

    def best(lengths, bins):
        if not lengths:
            return sum(cost(next(c for c in sizes if c >= b)) for b in bins)
        n, rest = lengths[0], lengths[1:]
        options = [best(rest, [*bins[:i], bins[i] + n, *bins[i + 1 :]]) for i in range(len(bins)) if bins[i] + n <= 16]
        return min([*options, best(rest, [*bins, n])])

    ratios = []
    for _ in range(40):
        lengths = r.integers(1, 17, 7).tolist()
        got = packing.pack_lengths(lengths, sizes, cost)
        used = {}
        for n, (b, offset, c) in zip(lengths, got, strict=True):
            used.setdefault(b, []).append((offset, n, c))
        total = sum(cost(x[0][2]) for x in used.values())
        optimum = best(sorted(lengths, reverse=True), [])
        assert packing.bound(lengths, sizes, cost) <= optimum <= total + 1e-9
        assert total <= min(packing.pack_by(lengths, list(sizes), cost, p)[0] for p in (None, *sizes)) + 1e-9
        ratios.append(total / optimum)
    assert np.mean(ratios) < 1.03 and max(ratios) < 1.25


def test_packing_edges(spark, odd):
    docs = odd.unionAll(odd.where("doc_id = 1").crossJoin(spark.range(5000).drop("id")))  # a row with thousands of copies
    one = packing.pack(docs.repartition(3), ["doc_id", "cls"], F.length("text"))
    two = packing.pack(docs.orderBy(F.desc("text")).repartition(7), ["doc_id", "cls"], F.length("text"))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert one.agg(F.sum("length")).first()[0] == docs.agg(F.sum(F.length("text"))).first()[0]
    with pytest.raises(ValueError):
        packing.pack(docs.withColumnRenamed("cls", "piece"), ["piece"], F.length("text"))


def test_sequences_hold_all_tokens(spark):
    docs = bpe.encode(table(spark, SF, "documents").select("doc_id", "text"), PATH).cache()
    packed = packing.pack(docs, ["doc_id"], F.size("ids")).cache()
    bins = {r["bin_id"]: r for r in packing.assemble(packed, docs, ["doc_id"]).collect()}
    ids = {r["doc_id"]: r["ids"] for r in docs.collect()}
    seen = 0
    for r in packed.where("length > 0").collect():
        b = bins[r["bin_id"]]
        at = slice(r["offset"], r["offset"] + r["length"])
        assert b["ids"][at] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] and len(set(b["segments"][at])) == 1
        seen += r["length"]
    assert seen == sum(map(len, ids.values())) == sum(sum(x > 0 for x in b["segments"]) for b in bins.values())
    assert all(len(b["ids"]) == len(b["segments"]) == b["capacity"] for b in bins.values())


def test_html(spark):
    tree = html_extract.grow(*html_extract.labelled())
    used = html_extract.described(tree)
    assert "before" in used or "after" in used or "around" in used
    # hostile pages: a second is plenty for a megabyte
    for page in ("<a " * 350_000, "<p" * 500_000, '<a x="' * 170_000, "<!--" * 250_000, "<script>" + "</script " * 110_000, "<b>" * 8000 + "<p>x</p>" * 8000, "<a href='>" * 100_000, "<i><p>" * 80_000 + "</i>" * 80_000, "<div>" * 90_000 + "</div>" * 90_000):
        html_extract.main_text(page, tree)
    assert html_extract.main_text("<p>1 < 2 and 3 > 2</p><p>x <a b", tree) == "1 < 2 and 3 > 2 x <a b"
    long = "<p>" + "word " * 300_000 + "</p>"
    df = spark.createDataFrame([(1, "u", long, "c"), (1, "u", long, "c"), (2, None, None, None)], "page_id long, url string, html string, n_chars string").withColumn("_html", F.lit("own"))
    got = html_extract.extract(df).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 1_499_999, 1_499_999] and {r["_html"] for r in got} == {"own"}



def test_session_settings(spark):
    """A batch size that the user has set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "77")
        common.small_batches(spark)
        assert spark.conf.get(name) == "77"
    finally:
        spark.conf.set(name, before)


def test_the_shared_folder(spark):
    df = common.materialize(spark.range(3), "x")
    path = df._written
    assert path.startswith(common.shared_dir(spark)) and df.count() == 3
    common.discard(df)
    from pathlib import Path

    assert not Path(path).exists()
