"""Common prefixes: the shortcuts give what going letter by letter gives."""

import itertools
import os.path

from pyspark.sql import functions as F

from allelic.functions import alleles


def test_common_prefix(spark):
    texts = ["", "A", "AC", "AG", "ACGT", "ACGA", "C", "CCCC", "ACGTACGT"]
    pairs = list(itertools.product(texts, texts))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", alleles.lcp(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r["n"] for r in got] == [len(os.path.commonprefix([r["a"], r["b"]])) for r in got]
    sql = spark.createDataFrame(pairs, "a string, b string").select(alleles.lcp(F.col("a"), F.col("b")))._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith" in sql and sql.index("StartsWith") < sql.index("array_position")
