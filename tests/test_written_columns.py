"""Sinks predict the columns that they write; files are compressed; a MAF's rows are dealt once."""

from pathlib import Path

from allelic import queries
from allelic.plans import pick


def test_a_maf_row_is_dealt_once(spark):
    a = spark.createDataFrame([(1, "T1.2", "G", "protein_coding", True, "LOW", "", 5, "T1", "", ""), (1, "T2.1", "G", "protein_coding", True, "HIGH", "p.", 9, "T1", "", "")], "record_id long, transcript_id string, gene_name string, biotype string, msk_canonical boolean, impact string, hgvsp string, tx_start long, maf_transcript string, maf_gene string, maf_consequence string")
    best = pick.best_for_maf(a.repartition(3), ["record_id"])
    assert [r["transcript_id"] for r in best.collect()] == ["T1.2"]
    assert best._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("hashpartitioning(record_id") == 1


def test_written_variants_are_compressed(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    old = set(shared.rglob("part-*"))
    n = queries.QUERIES["S4_S5_K2_maf_append"](spark, "/root/testdata/sf0.001").count()
    parts = {p for p in shared.rglob("part-*") if "maf-" in str(p)} - old
    assert n == 6000 and parts and all(p.name.endswith(".gz") for p in parts)
