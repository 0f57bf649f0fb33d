"""A worker keeps a tokenizer for tasks that need one only."""

import sys

import public_tokenizers

from allelic.llm import bpe, lang_id
from allelic.llm.common import HELD


def held(spark, name):
    """How many tokenizers each of the workers keeps."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([pa.array([len(sys.__dict__.get(name, {}))] * b.num_rows, pa.int64())], names=["n"])

    return {r[0] for r in spark.range(0, 4, 1, 1).mapInArrow(run, "n long").collect()}


def test_other_stages_give_it_up(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i}", "en") for i in range(8)], "doc_id long, text string, lang string").coalesce(1)
    model = lang_id.fit(docs)
    bpe.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert held(spark, HELD) == {1}
    lang_id.identify(docs, model).select("lang_pred").collect()
    assert held(spark, HELD) == {0}


def test_few_words_are_counted_anew():
    import json

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        v = bpe.Vocabulary(json.loads(f.read()))
    texts = [" ".join(f"w{i * 9001 + j}" for j in range(9001)) for i in range(14)]
    c = bpe.Coder(v)
    counts = [x for t in texts for x in c.counts([t])]
    assert len(c.sizes) < bpe.COUNTED + 10_000 and counts == [x for t in texts for x in bpe.Coder(v).counts([t])]
