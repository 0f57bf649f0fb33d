"""The SQL surface, configuration and service functions over annotations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import alleles, coords, terms, text
from .functions.notation import parse_location, parse_region
from .operators import lookups
from .plans import predict, reverse
from .plans.overlap import BIN

# Names that an assembly goes by.
ASSEMBLIES = {"grch37": "GRCh37", "hg19": "GRCh37", "37": "GRCh37", "grch38": "GRCh38", "hg38": "GRCh38", "38": "GRCh38"}


#: Settings that a session for prediction should have; `predict` sets them where they are Spark's defaults.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": str(predict.METHOD_BYTES)}


def assembly(name: str) -> str:
    known = ASSEMBLIES.get(name.strip().lower())
    if not known:
        raise ValueError(f"unknown assembly {name!r}")
    return known


@dataclass
class Config:
    assembly: str = "GRCh38"
    canonical_only: bool = False
    sources: set[str] = field(default_factory=lambda: {"alphamissense", "clinvar", "hotspots", "genes"})
    exclude: list[str] = field(default_factory=list)

    def uses_index(self) -> bool:
        """Whether any genomic source is on; the germline source counts for GRCh37 only."""
        return bool(self.sources & {"alphamissense", "clinvar", "gnomad", "dbsnp"}) or ("signal" in self.sources and assembly(self.assembly) == "GRCh37")

    @classmethod
    def from_options(cls, options: dict[str, str]) -> Config:
        on = lambda v: str(v).strip().lower() in ("1", "true", "yes", "on")
        known = {"alphamissense", "clinvar", "signal", "gnomad", "dbsnp", "hotspots", "genes", "sift", "polyphen"}
        c = cls(assembly=assembly(options.get("assembly", "GRCh38")), canonical_only=on(options.get("canonical_only", "false")))
        c.sources = {s for s in known if on(options.get(s, str(s in c.sources)))}
        c.exclude = [x for x in options.get("exclude", "").split(",") if x]
        return c


    @classmethod
    def load(cls, path: str | None = None, environment: dict[str, str] | None = None, prefix: str = "ALLELIC_") -> Config:
        """From a file of `name = value` lines (# begins a comment) and, above it, from the environment."""
        options: dict[str, str] = {}
        if path:
            with open(path, encoding="utf-8") as f:
                for line in f:
                    name, found, value = line.split("#", 1)[0].partition("=")
                    if found:
                        options[name.strip().lower()] = value.strip().strip("\"'")
        options |= {k.removeprefix(prefix).lower(): v for k, v in (environment or {}).items() if k.startswith(prefix)}
        return cls.from_options(options)


@dataclass
class Sources:
    """The reference tables that annotations are joined with; None where there is none."""

    index: DataFrame | None = None
    hotspots: DataFrame | None = None
    genes: DataFrame | None = None
    predictions: DataFrame | None = None


#: Columns of the genomic index, by source.
INDEXED = {"alphamissense": ["am_score", "am_class"], "clinvar": ["clinvar_significance", "clinvar_review", "clinvar_disease"], "gnomad": ["gnomad_af", "gnomad_ac", "gnomad_an", "gnomad_homalt"], "dbsnp": ["dbsnp_id"], "signal": ["signal_status", "signal_count", "signal_frequency"]}


def enriched(annotations: DataFrame, sources: Sources, config: Config) -> DataFrame:
    """annotations joined with every source that is there and that the configuration turns on: the index of genomic sources
    in one join, then protein- and gene-level tables."""
    out = annotations
    if sources.index is not None and config.uses_index():
        on = {c for s, cols in INDEXED.items() if s in config.sources and (s != "signal" or assembly(config.assembly) == "GRCh37") for c in cols}
        out = lookups.join_index(out, sources.index.select(*lookups.GENOMIC_KEY, *(c for c in sources.index.columns if c in on)))
    if sources.predictions is not None and config.sources & {"sift", "polyphen"}:
        out = lookups.join_predictions(out, sources.predictions)
        out = out.drop(*(f"{a}_{b}" for a in ("sift", "polyphen") if a not in config.sources for b in ("score", "prediction")))
    if sources.hotspots is not None and "hotspots" in config.sources:
        out = lookups.join_hotspots(out, sources.hotspots)
    if sources.genes is not None and "genes" in config.sources:
        out = lookups.join_genes(out, sources.genes)
    return out


def local_first(annotations: DataFrame, remote: DataFrame | None = None) -> DataFrame:
    """Population frequency and rs id of each row: its own, if it has either; else those of a stored response of a variant
    service (chrom, pos, ref, alt and the columns of `reshape_remote`), as many as it has. `frequency_source` says which."""
    cols = ["dbsnp_id", "gnomad_af", "gnomad_ac", "gnomad_an", "gnomad_homalt"]
    zero = lambda c: F.lit("") if c == "dbsnp_id" else F.lit(0.0) if c == "gnomad_af" else F.lit(0).cast("bigint")
    have = annotations.withColumns({c: F.coalesce(F.col(c), zero(c)) if c in annotations.columns else zero(c) for c in cols})
    own = (F.col("dbsnp_id") != "") | (F.col("gnomad_af") != 0)
    if remote is None:
        return have.withColumn("frequency_source", F.when(own, "local").otherwise(""))
    r = remote.groupBy(*lookups.GENOMIC_KEY).agg(*(F.max(c).alias(f"_{c}") for c in cols))
    out = have.join(r, lookups.GENOMIC_KEY, "left")
    found = F.coalesce((F.col("_dbsnp_id") != "") | (F.col("_gnomad_af") != 0), F.lit(False))
    source = F.when(own, "local").when(found, "remote").otherwise("")
    return out.withColumn("frequency_source", source).withColumns({c: F.when(F.col("frequency_source") == "remote", F.col(f"_{c}")).otherwise(F.col(c)) for c in cols}).drop(*(f"_{c}" for c in cols))


def register(spark: SparkSession, path: str, view: str = "annotations") -> DataFrame:
    """An exported Parquet table as a view for free-form SQL."""
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(view)
    return df


def at_variant(annotations: DataFrame, chrom: str, pos: int, ref: str, alt: str) -> DataFrame:
    n = alleles.chrom_number(F.lit(chrom))
    where = (F.col("chrom_numeric") == n) & (F.col("pos") == pos) & (F.col("ref") == ref) & (F.col("alt") == alt)
    return annotations.where(where).orderBy(F.desc("msk_canonical"), terms.rank_of_impact(F.col("impact")).desc(), "transcript_id")


def in_gene(annotations: DataFrame, gene: str, limit: int = 1000) -> DataFrame:
    return annotations.where(F.col("gene_name") == gene).orderBy("chrom_numeric", "pos", "ref", "alt", "transcript_id").limit(limit)


def with_change(annotations: DataFrame, gene: str, change: str) -> DataFrame:
    return annotations.where((F.col("gene_name") == gene) & (F.col("amino_acid_change") == change))


def transcript_by_id(transcripts: DataFrame, ids: list[str]) -> DataFrame:
    """Exact ids, and ids without version where the version isn't there."""
    bare = [i.split(".")[0] for i in ids]
    return transcripts.where(F.col("transcript_id").isin(ids) | text.unversioned(F.col("transcript_id")).isin(bare))


def transcripts_where(transcripts: DataFrame, gene: str | None = None, entrez: str | None = None, chrom: str | None = None) -> DataFrame:
    out = transcripts
    for c, v in (("gene_name", gene), ("entrez_id", entrez), ("chrom", chrom)):
        out = out.where(F.col(c) == v) if v else out
    return out


def canonical_transcripts(transcripts: DataFrame, isoform_source: str = "mskcc") -> DataFrame:
    """One transcript a gene by isoform source: its own flag, then the other flag, coding, MANE, and the longest."""
    flags = ["msk_canonical", "canonical"] if isoform_source == "mskcc" else ["canonical", "msk_canonical"]
    order = [F.desc(f) for f in flags] + [(F.col("cds_start") > 0).desc(), F.desc("mane_select"), (F.col("end") - F.col("start")).desc(), F.asc("transcript_id")]
    return transcripts.withColumn("_r", F.row_number().over(Window.partitionBy("gene_name").orderBy(*order))).where("_r = 1").drop("_r")


def with_utrs(transcripts: DataFrame) -> DataFrame:
    return transcripts.withColumn("utrs", coords.utr_parts())


def annotate_regions(requests: DataFrame, transcripts: DataFrame, width: int = BIN, only: list[str] | None = None) -> DataFrame:
    """id, region, allele -> annotations (of which `only` names the predicted columns that are wanted). A region of one base
    gets its reference base from a coding sequence."""
    p = requests.select("id", parse_region(F.col("region"), F.col("allele")).alias("r")).where("r is not null").select("id", "r.*").withColumnRenamed("start", "pos")
    known = reverse.reference_bases(p, transcripts, width)
    p = p.join(known, ["chrom", "pos"], "left")
    ref = F.when((F.col("pos") == F.col("end")) & (F.col("alt") != ""), F.coalesce("base", F.lit(""))).otherwise(F.col("ref"))
    return predict.annotate(p.select("id", "chrom", "pos", ref.alias("ref"), "alt"), transcripts, width=width, only=only)


def annotate_locations(requests: DataFrame, transcripts: DataFrame, width: int = BIN) -> DataFrame:
    """id, location (`chrom,start,end,ref,alt`) -> annotations."""
    p = requests.select("id", parse_location(F.col("location")).alias("r")).where("r is not null").select("id", "r.chrom", "r.pos", "r.ref", "r.alt")
    return predict.annotate(p, transcripts, width=width)


def annotate_notations(requests: DataFrame, transcripts: DataFrame, width: int = BIN) -> tuple[DataFrame, DataFrame]:
    """id, input -> (annotations, errors)."""
    r = reverse.resolve(requests, transcripts, width=width)
    good = r.where("error = ''").select("id", "chrom", "pos", "ref", "alt")
    return predict.annotate(good, transcripts, width=width), r.where("error <> ''").select("id", "error")


def reshape_remote(df: DataFrame, column: str = "response") -> DataFrame:
    """The population frequencies and rs id of a stored response of a variant service, as flat columns."""
    schema = "dbsnp struct<rsid:string>, gnomad_exome struct<af:struct<af:double>, ac:struct<ac:bigint>, an:struct<an:bigint>, hom:struct<hom:bigint>>, gnomad_genome struct<af:struct<af:double>>"
    r = F.from_json(column, schema)
    return df.withColumn("_r", r).select("*", F.coalesce("_r.dbsnp.rsid", F.lit("")).alias("dbsnp_id"), F.coalesce("_r.gnomad_exome.af.af", "_r.gnomad_genome.af.af", F.lit(0.0)).alias("gnomad_af"), F.coalesce("_r.gnomad_exome.ac.ac", F.lit(0)).cast("bigint").alias("gnomad_ac"), F.coalesce("_r.gnomad_exome.an.an", F.lit(0)).cast("bigint").alias("gnomad_an"), F.coalesce("_r.gnomad_exome.hom.hom", F.lit(0)).cast("bigint").alias("gnomad_homalt")).drop("_r")
