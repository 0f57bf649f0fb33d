"""Prediction copies few rows: few steps behind the join, final columns from the batched function, one join where nothing is
predicted."""

from pyspark.sql import functions as F

from allelic import queries, synth
from allelic.functions import codon
from allelic.plans import overlap, predict

SF = "/root/testdata/sf0.001"
TX = "1|20|64|20,64,0|0,89,20,64,0,1|" + "ATG" + "GCT" * 13 + "TAA" + "|GCTTAA"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_single_bases_take_few_steps(spark):
    v = queries.variants_only(spark, SF).where("length(ref) = 1 and length(alt) = 1")
    plan = plan_of(predict.annotate_snvs(v, synth.transcripts(spark, SF).drop("k", "n"), queries.BIN, ["consequence", "impact", "hgvsp"]))
    above = plan[: plan.index("Join ")]
    assert above.count("Project ") <= 10 and "regexp_replace" not in above and "RLIKE" not in above


def test_alleles_are_worked_out_above_the_shuffle(spark):
    plan = plan_of(queries.variants_only(spark, SF).where("length(ref) = 1"))
    assert "md5" not in plan[plan.index("RepartitionByExpression") :]


def test_batched_function_gives_final_columns():
    got = predict._effects([30, 10, 64, 5], ["A", "AC", "AC", "A"], ["AT", "A", "GT", "AT"], [TX, TX, TX, None])
    assert [got["consequence"][i] for i in (0, 1, 3)] == ["frameshift_variant", "5_prime_UTR_variant", "intergenic_variant"]
    assert list(got["impact"][:2]) == ["HIGH", "MODIFIER"] and list(got["exon_number"]) == ["1/1", "1/1", "1/1", ""]
    assert list(predict._effects([30], ["A"], ["AT"], ["1|0|0||0,89,0,0,0,1||"], biotype=["miRNA"])["consequence"]) == ["mature_miRNA_variant"]


def test_own_columns_take_one_join(spark):
    v, t = queries.variants_only(spark, SF), synth.transcripts(spark, SF).drop("k", "n")
    got = predict.annotate(v, t, width=queries.BIN, only=["transcript_id", "gene_name"])
    plan = plan_of(got)
    assert plan.count("Join ") == 1 and "Python" not in plan and "cds_sequence" not in plan
    want = overlap.interval_join(v, t.select("transcript_id", "gene_name", "chrom", "start", "end"), queries.BIN).select(*v.columns, *(F.coalesce(c, F.lit("")).alias(c) for c in ("transcript_id", "gene_name")))
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_bases_and_codons_without_patterns(spark):
    x = spark.createDataFrame([("A", "ATG"), ("t", "TAA"), ("N", "ANG"), ("-", "* T"), ("G", "AT"), ("C", None)], "b string, c string")
    got = x.select(codon.complement_base(F.col("b")), codon.amino_acid(F.col("c"))).collect()
    assert [r[0] for r in got] == ["T", "a", "N", "N", "C", "G"] and [r[1] for r in got] == ["M", "*", "X", "X", "X", "X"]
