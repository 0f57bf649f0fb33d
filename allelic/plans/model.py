"""Building the transcript model from GTF and FASTA rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import EXON, REGION

#: 3' UTR bases that are kept.
UTR3 = 300


def assemble(features: DataFrame) -> DataFrame:
    """One row for each transcript of the GTF features (feature, chrom, start, end, strand, frame and attributes): exons
    with their coding parts, coding bounds from codons where the file has them, else from CDS rows; running offsets.

    One shuffle on the transcript; an exon's rows are bounded by the transcript. One id may stand at several places (as in both
    pseudoautosomal regions): a row belongs to the transcript row of its id and chromosome that begins last before it."""
    f = features.where(F.col("feature").isin("transcript", "exon", "CDS", "start_codon", "stop_codon") & (F.col("transcript_id") != ""))
    same = Window.partitionBy("transcript_id", "chrom")
    begin = F.when(F.col("feature") == "transcript", F.col("start"))
    upto = same.orderBy("start", F.col("feature") != "transcript").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f = f.withColumn("_begin", F.coalesce(F.max(begin).over(upto), F.min(begin).over(same)))
    of = lambda kind, c: F.when(F.col("feature") == kind, c)
    pair = F.struct(F.col("start").alias("s"), F.col("end").alias("e"), "frame")
    own = lambda c: F.first(of("transcript", F.col(c)), ignorenulls=True)
    t = f.groupBy("transcript_id", F.col("chrom").alias("_chrom"), "_begin").agg(
        *(own(c).alias(c) for c in ("gene_id", "gene_name", "chrom", "start", "end", "strand", "biotype", "canonical", "mane_select")),
        F.max("protein_id").alias("protein_id"), F.array_sort(F.collect_set(of("exon", pair))).alias("_exons"), F.array_sort(F.collect_set(of("CDS", pair))).alias("_cds"),
        F.min(of("CDS", F.col("start"))).alias("_lo"), F.max(of("CDS", F.col("end"))).alias("_hi"),
        F.min(F.when(F.col("feature").isin("start_codon", "stop_codon"), F.col("start"))).alias("_clo"), F.max(F.when(F.col("feature").isin("start_codon", "stop_codon"), F.col("end"))).alias("_chi"),
        F.max(of("start_codon", F.lit(1))).alias("_has_start"), F.max(of("stop_codon", F.lit(1))).alias("_has_stop"),
    ).where("start is not null").drop("_chrom", "_begin")
    plus = F.col("strand") == 1
    left, right = F.when(plus, F.col("_has_start")).otherwise(F.col("_has_stop")), F.when(plus, F.col("_has_stop")).otherwise(F.col("_has_start"))
    zero = F.lit(0).cast("bigint")
    t = t.withColumns({"cds_start": F.coalesce(F.when(left == 1, F.least("_clo", F.coalesce("_lo", "_clo"))).otherwise(F.col("_lo")), zero), "cds_end": F.coalesce(F.when(right == 1, F.greatest("_chi", F.coalesce("_hi", "_chi"))).otherwise(F.col("_hi")), zero)})
    n = F.size("_exons")
    inside = lambda e: (F.col("cds_start") > 0) & (e["s"] <= F.col("cds_end")) & (e["e"] >= F.col("cds_start"))
    frame = lambda e: F.coalesce(F.get(F.transform(F.filter("_cds", lambda c: (c["s"] <= e["e"]) & (c["e"] >= e["s"])), lambda c: c["frame"]), F.lit(0)), F.lit(-1)).cast("int")
    exon = lambda e, i: F.struct(F.when(plus, i + 1).otherwise(n - i).cast("int").alias("number"), e["s"].alias("start"), e["e"].alias("end"), F.when(inside(e), F.greatest(e["s"], F.col("cds_start"))).otherwise(zero).alias("cds_start"), F.when(inside(e), F.least(e["e"], F.col("cds_end"))).otherwise(zero).alias("cds_end"), frame(e).alias("frame"))
    t = t.withColumn("exons", F.transform("_exons", exon).cast(f"array<{EXON}>"))
    return with_offsets(t.drop("_exons", "_cds", "_lo", "_hi", "_clo", "_chi", "_has_start", "_has_stop"))


def with_offsets(t: DataFrame) -> DataFrame:
    """Adds cds_regions and exon_cum: running sums in transcript order."""
    plus = F.col("strand") == 1

    def running(sizes):
        sums = F.aggregate(sizes, F.expr("struct(0L as n, cast(array() as array<bigint>) as a)"), lambda acc, x: F.struct((acc["n"] + x).alias("n"), F.concat(acc["a"], F.array(acc["n"])).alias("a")))
        return sums["a"]

    def offsets(sizes):
        return F.when(plus, running(sizes)).otherwise(F.reverse(running(F.reverse(sizes))))

    coding = F.filter("exons", lambda e: e["cds_start"] > 0)
    t = t.withColumns({"_coding": coding, "exon_cum": offsets(F.transform("exons", lambda e: e["end"] - e["start"] + 1))})
    zipped = F.zip_with("_coding", offsets(F.transform("_coding", lambda e: e["cds_end"] - e["cds_start"] + 1)), lambda e, o: F.struct(e["cds_start"].alias("start"), e["cds_end"].alias("end"), o.alias("offset")))
    return t.withColumn("cds_regions", zipped.cast(f"array<{REGION}>")).drop("_coding")


def with_sequences(t: DataFrame, fasta: DataFrame) -> DataFrame:
    """Adds cds_sequence and utr3_sequence from FASTA records (name, cds_from, cds_to, sequence), by exact id, else by the
    id without version."""
    cds = F.when(F.col("cds_from").isNull(), F.col("sequence")).otherwise(F.expr("substring(sequence, cast(cds_from as int), cast(cds_to - cds_from + 1 as int))"))
    utr = F.when(F.col("cds_to").isNull(), F.lit("")).otherwise(F.expr(f"substring(sequence, cast(cds_to + 1 as int), {UTR3})"))
    s = fasta.select("name", cds.alias("_cds"), utr.alias("_utr"))
    exact = s.groupBy("name").agg(F.min(F.struct("_cds", "_utr")).alias("_a"))
    loose = s.groupBy(text.unversioned(F.col("name")).alias("_base")).agg(F.min(F.struct("name", "_cds", "_utr")).alias("_b"))
    out = t.join(exact, t["transcript_id"] == exact["name"], "left").join(loose, text.unversioned(F.col("transcript_id")) == F.col("_base"), "left")
    return out.withColumns({"cds_sequence": F.coalesce("_a._cds", "_b._cds", F.lit("")), "utr3_sequence": F.coalesce("_a._utr", "_b._utr", F.lit(""))}).drop("name", "_a", "_base", "_b")


def with_overrides(t: DataFrame, overrides: DataFrame) -> DataFrame:
    """Sets msk_canonical from (gene_name, target): in genes that have the target, it is the only one; other genes keep
    their flags."""
    o = overrides.groupBy("gene_name").agg(F.max("target").alias("_target"))
    hit = F.coalesce(text.unversioned(F.col("transcript_id")) == F.col("_target"), F.lit(False))
    j = t.join(o, "gene_name", "left").withColumn("_hit", hit)
    j = j.withColumn("_any", F.max("_hit").over(Window.partitionBy("gene_name")))
    return j.withColumn("msk_canonical", F.when(F.col("_any"), F.col("_hit")).otherwise(F.col("msk_canonical"))).drop("_target", "_hit", "_any")


def with_entrez(t: DataFrame, ids: DataFrame) -> DataFrame:
    e = ids.groupBy("gene_name").agg(F.max("entrez_id").alias("_entrez"))
    return t.drop("entrez_id").join(e, "gene_name", "left").withColumn("entrez_id", F.coalesce("_entrez", F.lit(""))).drop("_entrez")
