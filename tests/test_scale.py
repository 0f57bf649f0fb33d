"""What lets a plan grow with its tables: work dealt to all cores, one join for a large model, no single task."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from allelic import queries, synth
from allelic.functions import codon
from allelic.plans import overlap, predict

SF = "/root/testdata/sf0.001"


def test_tables_are_dealt_before_work(spark):
    assert synth.transcripts(spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert synth.variants(spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_a_large_model_is_joined_once(spark, monkeypatch):
    """Beyond the broadcast bound whole transcripts go to their bins, and no second join by id moves the pairs."""
    v = queries.variants_only(spark, SF)
    wide = synth.transcripts(spark, SF).drop("k", "n")
    few = overlap.interval_join(v, wide, queries.BIN, broadcast_bytes=1).select("record_id", "transcript_id")
    assert few._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    many = overlap.interval_join(v, wide, 8, broadcast_bytes=1).select("record_id", "transcript_id")
    assert overlap.touches_few(wide, queries.BIN) and not overlap.touches_few(wide, 8)
    assert few.exceptAll(many).count() == many.exceptAll(few).count() == 0


def test_plain_models_take_one_join_of_single_bases(spark):
    t = synth.transcripts(spark, SF).drop("k", "n")
    a = predict.annotate_snvs(queries.variants_only(spark, SF).where("length(ref) = 1 and length(alt) = 1"), t, queries.BIN, ["transcript_id", "consequence"])
    assert a._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert {r[0] for r in a.where("consequence = 'intergenic_variant'").select("transcript_id").distinct().collect()} <= {""}


@pytest.mark.parametrize("cds", ["", "A", "ATG", "ATGTAAC", "ATGNNNTAA", "atgTTT", "AT\n", "TTTf", None, "".join(codon.CODE)])
def test_translation(spark, cds):
    got = spark.createDataFrame([(cds,)], "s string").select(codon.translate(F.col("s"))).first()[0]
    s = cds or ""
    assert got == "".join(codon.CODE.get(s[3 * i : 3 * i + 3], "X") for i in range(math.floor(len(s) / 3)))


def test_a_large_model_is_never_broadcast(spark):
    """Spark's estimate, from a file's few bytes, would send a model of any size through the driver to all executors."""
    v, t = queries.variants_only(spark, SF), synth.transcripts(spark, SF).drop("k", "n")
    for width in (queries.BIN, 8):
        plan = overlap.interval_join(v, t, width, broadcast_bytes=1)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert "BroadcastHashJoin" in overlap.interval_join(v, t, queries.BIN)._jdf.queryExecution().executedPlan().toString()


def test_texts_of_a_batch_are_decoded_once():
    got = predict._once(pa.array(["ACGT" * 9, None, "T", "ACGT" * 9]))
    assert got == ["ACGT" * 9, None, "T", "ACGT" * 9] and got[0] is got[3]
    assert predict._once(pa.array([], pa.string())) == []
