"""Command line: prepare, index, annotate, convert, compare, export, cache, clean, stream, config, version.

python -m allelic annotate maf IN.maf OUT --model MODEL ..."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session
from .functions import alleles
from .operators import lookups, writers
from .plans import compare, model, pick, predict, reverse
from .sources import compressed, tables, variants
from .store import shared_dir
from .streaming import annotate as stream


#: Changes when a stored model's columns do.
MODEL_SCHEMA = "1"


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def prepare(spark: SparkSession, a) -> None:
    """The transcript model from GTF and FASTA, sorted by place, with peptide digests. A model that was made of the same
    files, by their sizes and times, is left as it is."""
    from .functions.codon import peptide_md5

    made_of = writers.fingerprint([p for p in (a.gtf, a.fasta, a.canonical, a.overrides) if p], spark, f"{MODEL_SCHEMA} {a.chrom}")
    if writers.made_of(spark, a.out) == made_of:
        return

    t = model.assemble(tables.gtf(tables.read(spark, a.gtf), a.chrom)).withColumns({"msk_canonical": F.col("canonical"), "entrez_id": F.lit("")})
    t = model.with_sequences(t, tables.fasta(spark, a.fasta)) if a.fasta else t.withColumns({"cds_sequence": F.lit(""), "utr3_sequence": F.lit("")})
    if a.canonical:
        c = tables.canonical_table(tables.read(spark, a.canonical))
        t = model.with_entrez(model.with_overrides(t, c.where("target <> ''")), c)
    if a.overrides:
        t = model.with_overrides(t, tables.override_table(tables.read(spark, a.overrides)))
    t.withColumn("peptide_md5", peptide_md5(F.col("cds_sequence"))).repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").write.mode("overwrite").parquet(a.out)
    writers.mark(spark, a.out, made_of)


def index(spark: SparkSession, a) -> None:
    """The genomic index from whichever source files are named, written sorted by place."""
    parts = {}
    for name, read, first in (("alphamissense", tables.alphamissense, True), ("clinvar", variants.clinvar, False), ("gnomad", variants.gnomad, False), ("dbsnp", variants.dbsnp, False), ("signal", tables.signal, False)):
        path = getattr(a, name)
        if path:
            parts[name] = (read(tables.read(spark, path)), session.INDEXED[name], first)
    if not parts:
        raise SystemExit("name at least one source file")
    lookups.unified_index(parts).repartitionByRange("chrom", "pos").sortWithinPartitions(*lookups.GENOMIC_KEY).write.mode("overwrite").parquet(a.out)


def load_sources(spark: SparkSession, a) -> session.Sources:
    found = session.Sources()
    if a.index:
        found.index = spark.read.parquet(a.index)
    if a.hotspots:
        found.hotspots = tables.hotspots(tables.read(spark, a.hotspots))
    if a.genes:
        found.genes = tables.gene_list(tables.read(spark, a.genes))
    if a.predictions:
        md5, dump = a.predictions.split(",")
        found.predictions = lookups.explode_matrix(tables.prediction_dump(spark, dump, tables.translation_md5(tables.read(spark, md5))))
    return found


def print_rows(table: DataFrame) -> None:
    """All rows, tab-separated, a partition at a time."""
    print("\t".join(table.columns))
    for row in table.toLocalIterator():
        print("\t".join("" if x is None else str(x) for x in row))


def configured(a) -> session.Config:
    return session.Config.load(a.config, dict(os.environ))


def annotate(spark: SparkSession, a) -> None:
    t = load_model(spark, a.model)
    config, sources = configured(a), load_sources(spark, a)
    only = a.canonical_only or config.canonical_only
    if a.cache and only:
        raise SystemExit("a cache holds the predictions for all transcripts: --cache can't go with --canonical-only")
    one = lambda rows: writers.annotate_cached(rows, lambda v: predict.annotate(v, t), a.cache) if a.cache else predict.annotate(rows, t, only)
    predicted = lambda rows: session.enriched(one(rows), sources, config)
    if a.kind == "vcf":
        meta, samples = variants.vcf_header(spark, a.input)
        rows = predicted(variants.read_vcf(spark, a.input))
        rows = pick.pick_best(rows, ["record_id", "ord"]) if a.pick else rows
        fixed = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])]
        writers.write_vcf(rows, [*meta, "\t".join(fixed)], a.out)
    elif a.kind == "maf":
        rows, header = variants.read_maf(spark, a.input)
        base = one(rows)
        rows = session.enriched(base, sources, config)
        extra = [c for c in rows.columns if c not in base.columns]
        best = pick.best_for_maf(rows, ["record_id"]).join(pick.all_effects(rows, ["record_id"]), "record_id")
        if a.replace:
            header, lines = writers.maf_replace(best, header, extra)
        else:
            header, lines = writers.maf_append(best, header, a.exclude.split(",") if a.exclude else config.exclude, extra)
        top = spark.createDataFrame([(-1, "\t".join(header))], "record_id bigint, value string")
        top.unionByName(lines).orderBy("record_id").select("value").write.mode("overwrite").text(a.out)
    else:
        found = reverse.resolve(spark.createDataFrame([(0, a.input)], "id bigint, input string"), t)
        for row in found.where("error <> ''").select("error").collect():  # of one input
            print("error:", row["error"], file=sys.stderr)
        table = writers.table_of(predicted(found.where("error = ''").select("chrom", "pos", "ref", "alt")))
        if a.out == "-":
            print_rows(table)
        else:
            table.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(a.out)


def convert(spark: SparkSession, a) -> None:
    rows = predict.annotate(variants.read_vcf(spark, a.input), load_model(spark, a.model))
    _, samples = variants.vcf_header(spark, a.input)
    m = writers.vcf_to_maf(rows, session.assembly(a.assembly), samples[0] if samples else "TUMOR")
    m.orderBy("record_id", "ord").select(*writers.MAF).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(a.out)


def compare_files(spark: SparkSession, a) -> None:
    def keyed(path):
        if path.removesuffix(".gz").endswith(".vcf"):
            return variants.vcf_for_compare(spark, path)
        rows, header = variants.read_maf(spark, path)
        names = [h if header.index(h) == i else f"{h}_{i}" for i, h in enumerate(header)]
        full = rows.select("record_id", *(F.coalesce(F.get("raw", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)))
        return full.withColumn("_key", alleles.compare_key(F.col("Chromosome"), F.col("Start_Position"), F.col("Reference_Allele"), F.col("Tumor_Seq_Allele2"))), names

    left, lh = keyed(a.left)
    right, rh = keyed(a.right)
    columns, warnings = compare.resolve_columns(lh, rh, set(variants.REQUIRED), a.columns.split(",") if a.columns else None)
    for w in warnings:
        print("warning:", w)
    pairs = compare.paired(left, right, "_key", "record_id")
    rows = compare.categorised(pairs, columns, not a.simple)
    compare.differing(rows, a.max_diffs, a.all).write.mode("overwrite").option("sep", "\t").option("header", True).csv(a.out)
    compare.overlap_stats(pairs).show(truncate=False)
    print_rows(compare.column_counts(rows))
    print_rows(compare.category_counts(rows).orderBy("column", "place"))


def export(spark: SparkSession, a) -> None:
    t = load_model(spark, a.model)
    rows = variants.read_maf(spark, a.input)[0] if a.input.endswith((".maf", ".txt", ".maf.gz")) else variants.read_vcf(spark, a.input)
    out = predict.annotate(rows, t, a.canonical_only)
    key = [c for c in ("record_id", "ord") if c in out.columns]  # a VCF line has a row for each allele
    writers.write_parquet(pick.pick_best(out, key) if a.pick else out, a.out)


def cache(spark: SparkSession, a) -> None:
    """Predictions of a file's variants into the cache; or, without a file, the cache's rows as sorted Parquet."""
    if a.input:
        rows = variants.read_maf(spark, a.input)[0] if a.input.endswith((".maf", ".txt", ".maf.gz")) else variants.read_vcf(spark, a.input)
        writers.write_cache(predict.annotate(rows.select("chrom", "pos", "ref", "alt"), load_model(spark, a.model)), a.cache)
    if a.export:
        writers.export_cache(spark, a.cache, a.export)


def clean(spark: SparkSession, a) -> None:
    writers.clear_cache(spark, a.cache)


def show_config(spark: SparkSession, a) -> None:
    print(configured(a))


def version(spark: SparkSession, a) -> None:
    from . import __version__

    print(__version__)


def run_stream(spark: SparkSession, a) -> None:
    stream.start(spark, a.input, load_model(spark, a.model), a.out, f"{a.out}-checkpoint", available_now=not a.follow).awaitTermination()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="allelic")
    sub = p.add_subparsers(required=True)

    def command(name, f, *args, flags=()):
        c = sub.add_parser(name)
        for x in args:
            c.add_argument(x)
        for x in flags:
            c.add_argument(x, action="store_true")
        c.set_defaults(f=f)
        return c

    c = command("prepare", prepare, "gtf", "out")
    for x in ("--fasta", "--canonical", "--overrides", "--chrom"):
        c.add_argument(x)
    c = command("index", index, "out", *(f"--{n}" for n in session.INDEXED))
    c = command("annotate", annotate, "kind", "input", "out", "--model", "--exclude", "--config", "--index", "--hotspots", "--genes", "--predictions", "--cache", flags=("--pick", "--canonical-only", "--replace"))
    c = command("convert", convert, "input", "out", "--model")
    c.add_argument("--assembly", default="GRCh38")
    c = command("compare", compare_files, "left", "right", "out", "--columns", flags=("--simple", "--all"))
    c.add_argument("--max-diffs", type=int)
    command("export", export, "input", "out", "--model", flags=("--pick", "--canonical-only"))
    command("cache", cache, "cache", "--input", "--model", "--export")
    command("clean", clean, "cache")
    command("config", show_config, "--config")
    command("version", version)
    command("stream", run_stream, "input", "out", "--model", flags=("--follow",))
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("allelic").getOrCreate()
    if getattr(a, "input", None) == "-":  # standard input is read once
        a.input = compressed.spool(spark, sys.stdin.buffer, shared_dir(spark))
    a.f(spark, a)


if __name__ == "__main__":
    main()
