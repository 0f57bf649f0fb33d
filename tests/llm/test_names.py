"""Columns of the user that are named like the operators' own, in any case."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from allelic.llm import bpe, lang_id, minhash_dedup, toxicity

CLASHES = ["_h", "_id", "_th", "first", "_row", "_lang", "_limit", "n", "Score", "Predicted", "Lang_Pred", "N_Tokens"]


@pytest.fixture(scope="module")
def docs(spark):
    words = {"en": "the cat sat on a mat and then it ran", "de": "der Hund und die Katze sind sehr gut"}
    rows = [(i, f"{words[lang]} number {i % 20} {'x' * (i % 5)}", lang, "s") for i in range(60) for lang in [["en", "de"][i % 2]]]
    rows += [(3, rows[3][1], "de", "s"), (100, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, TEXT string, lang string, source string")
    for c in CLASHES:
        df = df.withColumn(c, F.concat(F.lit("mine "), F.col("doc_id").cast("string")))
    return df


def kept(df, names):
    assert {c for c in names if c in CLASHES} <= set(df.columns)
    assert all(r[c] == f"mine {r['doc_id']}" for r in df.collect() for c in names)


def test_deduplicate_keeps_the_users_columns(docs):
    out = minhash_dedup.deduplicate(docs)
    assert out.columns == docs.columns and out.schema == docs.schema and 1 <= out.count() < docs.count()
    kept(out, CLASHES)


def test_language_of_clashing_columns(docs):
    model = lang_id.fit(docs)
    assert sorted(model.langs) == ["de", "en"]
    out = lang_id.identify(docs, model)
    assert out.columns[-2:] == ["lang_pred", "score"] and out.where("doc_id = 100 and lang_pred = 'und'").count() == 1
    kept(out, [c for c in CLASHES if c not in ("Score", "Lang_Pred")])


def test_toxicity_of_clashing_columns(docs):
    out = toxicity.score(docs, None)
    assert out.columns[-2:] == ["score", "predicted"] and out.count() == docs.count()
    kept(out, [c for c in CLASHES if c not in ("Score", "Predicted")])


def test_token_counts_of_clashing_columns(docs):
    out = bpe.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert out.columns[-2:] == ["n_tokens", "n_pieces"] and "TEXT" not in out.columns and out.where("doc_id = 100 and n_tokens = 0").count() == 1
    kept(out, [c for c in CLASHES if c != "N_Tokens"])
