"""INFO fields and places among bounds without a step for each entry."""

import pytest
from pyspark.sql import functions as F

from allelic.functions import text
from allelic.plans import compare

INFO = ["DP=3;CSQ=a|b;DB", "DB;DP=1;DP=2", "DP=1;DP", "", ".", ";;DP=;X=DP=4;", "CSQ=a;CSQ=b;DB", "CSQ", "CSQX=1;XCSQ=2;CSQ=", "DP=a=b\nc;DB", "DB=;CSQ;;CSQ=1", "DP=1\n", "=1;.;.=2", None]


def test_info_field_is_what_the_map_holds(spark):
    df = spark.createDataFrame([(x,) for x in INFO], "info string")
    for key in ("DP", "DB", "CSQ", "X", "A.B"):
        assert df.where(~text.info_field(F.col("info"), key).eqNullSafe(text.info_map(F.col("info"))[key])).collect() == []
    plan = df.select(text.info_field(F.col("info"), "DP"), text.without_key(F.col("info"), "DP"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_without_key(spark):
    df = spark.createDataFrame([(x,) for x in INFO], "info string")
    by_hand = lambda x: None if x is None else ";".join(e for e in x.split(";") if e and e.split("=")[0] != "CSQ") or "."
    assert [r[0] for r in df.select(text.without_key(F.col("info"), "CSQ")).collect()] == [by_hand(x) for x in INFO]


@pytest.mark.parametrize("bounds", [[], [5], [1, 3, 3, 8], list(range(0, 2046, 2))])
def test_below(spark, bounds):
    df = spark.range(-2, 2100).select(F.when(F.col("id") != 7, F.col("id")).alias("x"))
    got = df.select("x", compare.below(bounds, F.col("x")).alias("n"))
    assert all(r["n"] == (0 if r["x"] is None else sum(b < r["x"] for b in bounds)) for r in got.collect())


def test_bounds_are_halved(spark):
    """Ten steps for a thousand bounds."""
    c = spark.range(1).select(compare.below(list(range(1023)), F.col("id")).alias("n"))
    steps = c._jdf.queryExecution().analyzed().toString().split("aggregate(array(", 1)[1].split(")", 1)[0]
    assert len(steps.split(",")) == 10
