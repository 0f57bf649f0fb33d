"""Places of variants by segments: no expression over arrays where all transcripts are plain, and the same rows as by arrays."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from allelic import queries, synth
from allelic.functions import coords
from allelic.plans import overlap, predict

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["F20_F21_notation", "F12_F13_F15_F16_splice", "F14_indel_splice"])
def test_plain_models_take_no_arrays(spark, name):
    """Per pair: lambdas stay below the join, with the transcripts."""
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "lambda" not in plan[: plan.index("Join ")]


def test_segments_give_what_arrays_give(spark):
    P, t = F.col("pos"), synth.transcripts(spark, SF).drop("k", "n")
    v = queries.variants_only(spark, SF).limit(400).crossJoin(spark.range(12).toDF("more")).withColumn("pos", P + F.col("more") * 13).withColumn("ref", F.expr("rpad(ref, cast(1 + more * 9 as int), 'ACGT')"))
    of = (P, F.col("ref"), F.col("alt"))
    columns = {"n": (coords.plain_notation(P), coords.notation(P)), "x": (coords.plain_nearest(P), coords.nearest_exon(P)["place"]), "i": (coords.plain_indel_splice_site(*of), coords.indel_splice_site(*of)), "r": (coords.plain_in_splice_region(P), coords.in_splice_region(P))}
    got = predict.placed(v, t, columns, queries.BIN)
    want = overlap.interval_join(v, t, queries.BIN, "inner").select(*v.columns, "transcript_id", *(c[1].alias(k) for k, c in columns.items()))
    assert got.count() > 1000 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    # some transcripts aren't plain: an exon is missing from the counts of bases before
    odd = t.withColumn("exon_cum", F.when(F.col("canonical"), F.slice("exon_cum", 1, 0)).otherwise(F.col("exon_cum")))
    only = {"x": columns["x"], "i": columns["i"]}
    got = predict.placed(v, odd, only, queries.BIN)
    assert got.exceptAll(want.select(*got.columns)).count() == want.select(*got.columns).exceptAll(got).count() == 0


def test_methods_are_compiled(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    s = spark.newSession()
    s.conf.unset(name)
    predict.small_methods(s)
    assert s.conf.get(name) == "8000"
    s.conf.set(name, "1000")
    predict.small_methods(s)
    assert s.conf.get(name) == "1000"


def test_unwanted_notations_are_not_worked_out():
    tx = "1|20|64|20,64,0|0,89,20,64,0,1|" + "ATG" + "GCT" * 13 + "TAA" + "|GCTTAA"
    one = [pd.Series(x) for x in ([30], ["A"], ["AT"], [tx])]
    whole, less = predict._effects(*one), predict._effects(*one, protein=False, coding=False)
    assert whole["hgvsp"][0] and whole["hgvsc"][0] and less["hgvsp"][0] == less["hgvsc"][0] == ""
    assert whole.drop(columns=["hgvsp", "hgvsc"]).equals(less.drop(columns=["hgvsp", "hgvsc"]))
