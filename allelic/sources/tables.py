"""Tab-separated, FASTA, GTF and JSON reference files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alleles, text
from ..plans.overlap import with_size_check
from . import compressed
from .variants import TAB, lines_of


def fields(lines: DataFrame, skip: int = 0, comment: str | None = None) -> DataFrame:
    """line and f (array of fields) after the first `skip` lines."""
    rows = lines.where(F.trim("value") != "")
    if comment:
        rows = rows.where(~F.col("value").startswith(comment))
    if skip:
        last = rows.orderBy("line").limit(skip).agg(F.max("line")).first()[0]
        rows = rows.where(F.col("line") > (last if last is not None else -1))
    return rows.select("line", F.split("value", TAB, -1).alias("f"))


def by_header(lines: DataFrame, comment: str | None = "#") -> tuple[DataFrame, dict[str, Column]]:
    """(rows, name -> column) of a file whose first line names its columns."""
    rows = lines.where(F.trim("value") != "")
    rows = rows.where(~F.col("value").startswith(comment)) if comment else rows
    first = rows.orderBy("line").limit(1).collect()
    names = [n.strip() for n in first[0]["value"].split(TAB)] if first else []
    body = rows.where(F.col("line") > first[0]["line"]) if first else rows
    return body.select("line", F.split("value", TAB, -1).alias("f")), {n: F.trim(F.coalesce(F.get("f", F.lit(i)), F.lit(""))) for i, n in enumerate(names)}


def at(i: int) -> Column:
    return F.coalesce(F.get("f", F.lit(i)), F.lit(""))


def gtf(lines: DataFrame, chrom: str | None = None) -> DataFrame:
    """Features with their attributes. Lines without nine fields are skipped; a chromosome filter applies to the scan."""
    f = fields(lines, comment="#").where(F.size("f") == 9)
    if chrom:
        f = f.where(alleles.chrom_of_gtf(at(0)) == chrom)
    attribute = lambda k: F.regexp_extract(at(8), rf'(?:^|;\s*){k} "([^"]*)"', 1)
    tags = F.array_join(F.regexp_extract_all(at(8), F.lit(r'(?:^|;\s*)tag "([^"]*)"'), F.lit(1)), " ")
    return f.select(
        "line", alleles.chrom_of_gtf(at(0)).alias("chrom"), at(2).alias("feature"), at(3).try_cast("bigint").alias("start"), at(4).try_cast("bigint").alias("end"), F.when(at(6) == "-", -1).otherwise(1).alias("strand"),
        F.coalesce(at(7).try_cast("int"), F.lit(-1)).alias("frame"), attribute("transcript_id").alias("transcript_id"), text.unversioned(attribute("gene_id")).alias("gene_id"), attribute("gene_name").alias("gene_name"),
        F.coalesce(F.nullif(attribute("transcript_type"), F.lit("")), attribute("transcript_biotype")).alias("biotype"), text.unversioned(attribute("protein_id")).alias("protein_id"), tags.alias("tags"),
        tags.contains("Ensembl_canonical").alias("canonical"), tags.contains("MANE_Select").alias("mane_select"),
    ).where("start is not null and end is not null")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name (up to the first pipe or space), cds_from and cds_to (null where the header has no CDS:a-b) and sequence."""
    file = spark.read.option("lineSep", "\n>").text(path)
    compressed.must_be_plain(spark, file.inputFiles())
    raw = file.select(F.regexp_replace("value", "^>", "").alias("v")).where("trim(v) <> ''")
    head, body = F.split("v", "\n", 2)[0], F.coalesce(F.get(F.split("v", "\n", 2), F.lit(1)), F.lit(""))
    part = lambda i: F.nullif(F.regexp_extract(head, r"CDS:(\d+)-(\d+)", i), F.lit("")).try_cast("bigint")
    return raw.select(F.regexp_extract(head, r"^([^|\s]*)", 1).alias("name"), part(1).alias("cds_from"), part(2).alias("cds_to"), F.upper(F.regexp_replace(body, r"[\s>]", "")).alias("sequence"))


def canonical_table(lines: DataFrame) -> DataFrame:
    """gene_name, ensembl, target (MSK) and entrez_id of a canonical transcript table; the last line of a gene counts."""
    clean = lambda i: F.when(F.trim(at(i)).isin("", "nan"), F.lit("")).otherwise(text.unversioned(F.trim(at(i))))
    f = fields(lines, skip=1).where(F.size("f") >= 12)
    rows = f.select("line", F.trim(at(0)).alias("gene_name"), clean(2).alias("ensembl"), clean(11).alias("target"), F.when(F.trim(at(27)) == "nan", F.lit("")).otherwise(F.trim(at(27))).alias("entrez_id")).where("gene_name <> ''")
    last = lambda c: F.coalesce(F.max_by(c, F.when(F.col(c) != "", F.col("line"))), F.lit("")).alias(c)
    return rows.groupBy("gene_name").agg(last("ensembl"), last("target"), last("entrez_id"))


def override_table(lines: DataFrame) -> DataFrame:
    f = fields(lines, skip=1).where(F.size("f") >= 3)
    rows = f.select("line", F.trim(at(0)).alias("gene_name"), text.unversioned(F.trim(at(2))).alias("target")).where("gene_name <> '' and target <> ''")
    return rows.groupBy("gene_name").agg(F.max_by("target", "line").alias("target"))


def alphamissense(lines: DataFrame) -> DataFrame:
    f = fields(lines, skip=4).where(F.size("f") >= 10)
    return f.select(alleles.chrom_of_vcf(at(0)).alias("chrom"), at(1).try_cast("bigint").alias("pos"), at(2).alias("ref"), at(3).alias("alt"), "line", at(8).try_cast("float").alias("am_score"), at(9).alias("am_class")).where("length(ref) = 1 and length(alt) = 1 and pos is not null and am_score is not null")


def signal(lines: DataFrame) -> DataFrame:
    rows, c = by_header(lines)
    out = rows.select("line", alleles.chrom_of_vcf(c["Chromosome"]).alias("chrom"), c["Start_Position"].try_cast("bigint").alias("pos"), c["Reference_Allele"].alias("_r"), c["Alternate_Allele"].alias("_a"), c["n_impact"].try_cast("bigint").alias("signal_count"), c["f_impact"].try_cast("double").alias("signal_frequency"))
    bare = lambda x: F.when(F.col(x) == "-", F.lit("")).otherwise(F.col(x))
    return out.where("signal_count > 0 and signal_frequency > 0").select("chrom", "pos", bare("_r").alias("ref"), bare("_a").alias("alt"), "line", F.lit("germline").alias("signal_status"), "signal_count", "signal_frequency")


def hotspots(lines: DataFrame) -> DataFrame:
    rows, c = by_header(lines)
    return rows.select("line", c["hugo_symbol"].alias("gene_name"), c["amino_acid_position"].try_cast("bigint").alias("position"), c["type"].alias("type"), F.coalesce(c["q_value"].try_cast("double"), F.lit(0.0)).alias("q_value"), c["transcript_id"].alias("transcript_id")).where("transcript_id <> '' and position is not null")


def gene_list(lines: DataFrame) -> DataFrame:
    rows, c = by_header(lines)
    return rows.select("line", c["Hugo Symbol"].alias("gene_name"), c["Gene Type"].alias("gene_type")).where("gene_name <> ''")


def pfam(families: DataFrame, domains: DataFrame) -> DataFrame:
    """transcript_id, pfam, name, start, end: domains with their family's name."""
    a = fields(families).select(at(0).alias("pfam"), at(1).alias("name"), at(2).alias("description")).where("pfam <> ''")
    d = fields(domains, skip=1).select(at(1).alias("transcript_id"), at(3).alias("pfam"), at(4).try_cast("bigint").alias("start"), at(5).try_cast("bigint").alias("end")).where("transcript_id <> '' and pfam <> '' and start is not null")
    return d.join(a.groupBy("pfam").agg(F.max("name").alias("name"), F.max("description").alias("description")), "pfam", "left").fillna("", ["name", "description"])


PTM = "uniprot_entry string, uniprot_accession string, position bigint, type string, pubmed_ids array<string>, sequence string, ensembl_transcript_ids array<string>"


def ptm(spark: SparkSession, path: str) -> DataFrame:
    """Modification sites, one row for each transcript; malformed lines are dropped."""
    rows = spark.read.schema(PTM).option("mode", "DROPMALFORMED").json(path)
    return rows.select(F.explode("ensembl_transcript_ids").alias("transcript_id"), "uniprot_entry", "uniprot_accession", "position", "type", "pubmed_ids", "sequence").where("transcript_id <> ''")


def uniprot(lines: DataFrame) -> DataFrame:
    f = fields(lines, skip=1).select("line", text.unversioned(at(0)).alias("transcript_id"), at(1).alias("accession")).where("transcript_id <> '' and accession <> ''")
    return f.groupBy("transcript_id").agg(F.max_by("accession", "line").alias("accession"))


def json_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts of a JSON model, in the engine's schema but for offsets (see plans.model.with_offsets)."""
    exon = "Number int, Start bigint, End bigint, CDSStart bigint, CDSEnd bigint, Frame int"
    schema = f"ID string, GeneID string, GeneName string, Chrom string, Start bigint, End bigint, Strand int, Biotype string, IsCanonicalMSK boolean, IsCanonicalEnsembl boolean, IsMANESelect boolean, ProteinID string, CDSStart bigint, CDSEnd bigint, Exons array<struct<{exon.replace(' int', ':int').replace(' bigint', ':bigint')}>>, CDSSequence string, UTR3Sequence string"
    j = spark.read.schema(schema).option("multiLine", True).json(path)
    s = lambda c: F.coalesce(F.col(c), F.lit(""))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).try_cast("bigint")
    b = lambda c: F.coalesce(F.col(c), F.lit(False))
    exons = F.transform(F.array_sort(F.transform("Exons", lambda e: F.struct(e["Start"].alias("start"), e["End"].alias("end"), e["Number"].alias("number"), F.coalesce(e["CDSStart"], F.lit(0)).alias("cds_start"), F.coalesce(e["CDSEnd"], F.lit(0)).alias("cds_end"), F.coalesce(e["Frame"], F.lit(-1)).alias("frame")))), lambda e: F.struct(e["number"].alias("number"), e["start"].alias("start"), e["end"].alias("end"), e["cds_start"].alias("cds_start"), e["cds_end"].alias("cds_end"), e["frame"].alias("frame")))
    return j.select(s("ID").alias("transcript_id"), s("GeneID").alias("gene_id"), s("GeneName").alias("gene_name"), alleles.chrom_of_gtf(s("Chrom")).alias("chrom"), z("Start").alias("start"), z("End").alias("end"), F.coalesce("Strand", F.lit(1)).try_cast("int").alias("strand"), s("Biotype").alias("biotype"), b("IsCanonicalEnsembl").alias("canonical"), b("IsCanonicalMSK").alias("msk_canonical"), b("IsMANESelect").alias("mane_select"), z("CDSStart").alias("cds_start"), z("CDSEnd").alias("cds_end"), s("ProteinID").alias("protein_id"), F.lit("").alias("entrez_id"), exons.alias("exons"), s("CDSSequence").alias("cds_sequence"), s("UTR3Sequence").alias("utr3_sequence"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return lines_of(spark, path)


# The analyses of a prediction dump that are kept, by their public attribute ids.
ANALYSES = {267: "sift", 269: "polyphen"}
# What a dump writes after a backslash, and the character that it stands for; other characters stand for themselves.
ESCAPES = {"0": "\0", "n": "\n", "t": "\t", "r": "\r"}
#: Bytes as characters, one for each, so that text functions take them apart, and a character that no byte gives.
BYTES, NO_BYTE = "ISO-8859-1", "\u0100"


def escaped(bytes_: Column) -> Column:
    """Bytes with a dump's backslash escapes, as characters."""
    out = F.replace(F.decode(bytes_, BYTES), F.lit("\\"), F.lit("\\\\"))
    for code, char in ESCAPES.items():
        out = F.replace(out, F.lit(char), F.lit(f"\\{code}"))
    return out


def unescaped(chars: Column) -> Column:
    """The bytes of characters with a dump's backslash escapes, read from the left: pairs of backslashes are put aside first."""
    out = F.replace(chars, F.lit("\\\\"), F.lit(NO_BYTE))
    for code, char in ESCAPES.items():
        out = F.replace(out, F.lit(f"\\{code}"), F.lit(char))
    return F.encode(F.replace(F.regexp_replace(out, r"(?s)\\(.)", "$1"), F.lit(NO_BYTE), F.lit("\\")), BYTES)


def translation_md5(lines: DataFrame) -> DataFrame:
    """translation_id and md5 of a digest dump; lines without a number are skipped, the last of an id counts."""
    f = lines.select("line", F.split("value", TAB, 2).alias("f")).where(F.size("f") == 2)
    rows = f.select("line", at(0).try_cast("bigint").alias("translation_id"), at(1).alias("md5")).where("translation_id is not null")
    return rows.groupBy("translation_id").agg(F.max_by("md5", "line").alias("md5"))


def prediction_dump(spark: SparkSession, path: str, digests: DataFrame) -> DataFrame:
    """md5, analysis and matrix (binary) of a prediction dump: rows of known digests and of the analyses that are kept; the
    first of equal (md5, analysis) counts. Lines are bytes: they are taken apart as characters of one byte."""
    raw = spark.read.option("lineSep", "\n").text(path)
    compressed.must_be_plain(spark, raw.inputFiles())
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = raw.select(place.alias("_line"), F.decode(F.col("value").cast("binary"), BYTES).alias("_t"))
    part = lambda i: F.regexp_extract("_t", r"(?s)\A([0-9]+)\t([0-9]+)\t(.*)\z", i)
    number = lambda i: F.regexp_extract("_t", r"\A([0-9]+)\t([0-9]+)\t", i).try_cast("bigint")
    rows = rows.select("_line", number(1).alias("translation_id"), number(2).alias("_a"), part(3).alias("_m"))
    name = F.when(F.lit(False), F.lit(""))
    for k, v in ANALYSES.items():
        name = name.when(F.col("_a") == k, F.lit(v))
    rows = rows.withColumn("analysis", name).where("analysis is not null").join(with_size_check(digests), "translation_id")
    return rows.groupBy("md5", "analysis").agg(unescaped(F.min_by("_m", "_line")).alias("matrix"))
