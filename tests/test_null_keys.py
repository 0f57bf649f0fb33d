"""Rows without a key in joins with protein tables."""

from pyspark.sql import functions as F

from allelic.operators import lookups


def test_rows_without_a_key_are_dealt(spark):
    a = spark.range(1000).selectExpr("'1' as chrom", "id as pos", "'' as transcript_id", "0L as protein_position", "'intron_variant' as consequence", "'' as peptide_md5", "'' as amino_acid_change")
    assert a.select(lookups._apart(a, F.lit(None).cast("string")).alias("k")).distinct().count() > 500
    h = spark.createDataFrame([("T1", 0, "3d", 0.1)], "transcript_id string, position long, type string, q_value double")
    assert lookups.join_hotspots(a, h).where("hotspot = ''").count() == 1000
