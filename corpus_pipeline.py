"""Documents to packed training sequences: language, toxicity, near-duplicates, packing.

Every stage takes the rows that its predecessor kept, and what it decides takes effect. Defined results: documents without
text or without a letter are rejected by the language stage, and so never reach the others; very long texts are read
whole; of equal and nearly equal documents the one of least (id, hash of the text) stays, once; a null doc_id, lang or source
is kept as it is; columns beyond those of documents are dropped, whatever their names; an empty table gives an empty one.
Bins are the same however the rows are ordered; their ties go by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelic.llm import bpe, lang_id, minhash_dedup, packing, toxicity
from allelic.llm.common import discard, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text is rejected if its leading language is less sure than this. Texts in two languages are clean, and stay.
SURE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts without a leading language."""
    seen = lang_id.identify(docs.select(*COLUMNS), lang_id.fit(docs))
    return seen.where((F.col("lang_pred") != lang_id.UND) & (F.col("score") >= SURE)).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts predicted toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: word 5-shingles, similarity of 0.8 or more."""
    return minhash_dedup.deduplicate(docs.select(*COLUMNS), k=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Pieces of documents in sequences, by the tokens of a vocabulary (the public byte-level one unless another is named):
    `packing.assemble` makes the sequences from `bpe.encode`'s ids."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    keys = ["doc_id", "lang", "source"]
    return packing.pack(bpe.token_counts(docs.select(*keys, "text"), vocabulary), keys, F.col("n_tokens"))


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("packing", packed)]

#: SQL can express neither the classifiers nor best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
