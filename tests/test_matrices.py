"""Prediction matrices: dumps of bytes, digests that are worked out once, cells that are read at their places."""

import pytest
from pyspark.sql import functions as F

from allelic import queries
from allelic.operators import lookups
from allelic.sources import tables


def test_digests_are_worked_out_above_the_shuffle(spark):
    """A filter on a digest that is pushed to the scan works the sequence out for every codon, in one task."""
    plan = queries.matrices(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "md5(" in line]


def test_all_bytes_pass_through_a_dump(spark):
    rows = [bytes(range(256)), b"", b"\\", b"\\\\n\\", b"\\0\0\n\t\r", b"n\\\\\\t"]
    df = spark.createDataFrame([(bytearray(x),) for x in rows], "b binary")
    got = df.select("b", tables.unescaped(tables.escaped(F.col("b"))).alias("x"), F.encode(tables.escaped(F.col("b")), tables.BYTES).alias("e")).collect()
    assert [bytes(r["x"]) for r in got] == rows and not any(c in bytes(r["e"]) for r in got for c in b"\0\n\t\r")
    read = spark.createDataFrame([("\\x\\n\\\\0\\",)], "t string").select(tables.unescaped(F.col("t"))).first()[0]
    assert bytes(read) == b"x\n\\0\\"


@pytest.fixture(scope="module")
def model(spark):
    cells = lambda k: b"\0\0\0" + b"".join(((i * 37 + k) % 1024 | (i % 4) << 14).to_bytes(2, "little") if i != 3 else b"\xff\xff" for i in range(45))
    m = spark.createDataFrame([("a", "sift", bytearray(cells(1))), ("a", "sift", bytearray(cells(9))), ("a", "polyphen", bytearray(cells(5))), ("b", "polyphen", bytearray(cells(7))), ("c", "sift", bytearray(b"\0\0\0"))], "md5 string, analysis string, matrix binary")
    t = spark.createDataFrame([("T1", "a"), ("T2", "b"), ("T2", "a"), ("T3", ""), ("T4", "none"), ("T5", "c")], "transcript_id string, peptide_md5 string")
    return t, m


def test_matrices_give_what_their_cells_give(spark, model):
    t, m = model
    a = spark.createDataFrame([(p, aa) for p in range(5) for aa in [*lookups.AMINO, "X", "*", ""]], "position long, aa string")
    a = a.join(spark.createDataFrame([(x, c) for x in ("T1", "T2", "T3", "T4", "T5", "T6", "") for c in ("missense_variant", "splice_region_variant,missense_variant", "synonymous_variant")], "transcript_id string, consequence string"))
    a = a.select("transcript_id", "consequence", F.col("position").alias("protein_position"), F.when(F.col("aa") == "", "").otherwise(F.concat(F.lit("A1"), "aa")).alias("amino_acid_change"))
    columns = [*a.columns, "sift_score", "sift_prediction", "polyphen_score", "polyphen_prediction"]
    old = lookups.join_predictions(a.join(t, "transcript_id", "left").fillna("", ["peptide_md5"]), lookups.explode_matrix(m)).select(*columns)
    new = lookups.join_matrices(a, t, m).select(*columns)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(new) == rows(old) and any(r["sift_score"] for r in new.collect())
    assert lookups.explode_matrix(m).count() == 4 * 44
