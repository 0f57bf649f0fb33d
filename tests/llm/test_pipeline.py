import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from allelic.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_and_contracts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        rows = out.collect()
        assert rows and all(before[r["doc_id"]] == r["text"] for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.packed(spark, docs, SF).collect()
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch([r["text"] for r in docs.collect()], add_special_tokens=False)
    assert sum(r["length"] for r in packed) == sum(len(t.ids) for t in tokens)


def test_odd_rows_and_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = docs.where("lang = 'en'").agg(F.max("doc_id").alias("doc_id"), F.array_join(F.collect_list("text"), " ").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).alias("n_chars"))
    names = docs.columns
    more = docs.unionAll(docs.limit(20)).unionAll(long.selectExpr(*names)).unionAll(docs.limit(3).withColumns({"doc_id": F.lit(None).cast(dict(docs.dtypes)["doc_id"]), "source": F.lit(None).cast("string")}).select(*names)).unionAll(docs.limit(2).withColumn("text", F.lit(None).cast("string")).select(*names)).unionAll(docs.limit(2).withColumn("text", F.lit("")).select(*names))
    for c in ("score", "predicted", "cls", "length", "bin_id", "n_tokens"):
        more = more.withColumn(c, F.lit("clash"))
    rows = spark.createDataFrame(more.collect(), more.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == names, name
        kept = out.collect()
        assert kept and all(r["text"] for r in kept), name
        if name == "near_duplicates":
            assert len({r["text"].lower() for r in kept}) == len(kept)
        rows = spark.createDataFrame(kept, out.schema)
        empty = stage(spark, more.limit(0), SF)
        assert empty.columns == names and empty.count() == 0, name
    assert corpus_pipeline.packed(spark, rows, SF).where("bin_id is null").count() == 0
    assert corpus_pipeline.packed(spark, more.limit(0), SF).count() == 0


def test_every_query_runs(spark):
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)} and set(ORACLE_SQL) <= set(QUERIES)
    for name, f in QUERIES.items():
        assert f(spark, SF).count() > 0, name
