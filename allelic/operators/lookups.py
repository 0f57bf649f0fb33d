"""Lookups: left joins of annotations with reference tables, and the tables' own upserts.

A source is anything with name, match_level, columns and join(df) -> DataFrame."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alleles, terms, text
from ..plans.overlap import with_size_check

GENOMIC_KEY = ["chrom", "pos", "ref", "alt"]


class Source(Protocol):
    name: str
    match_level: str  # genomic, protein_position or gene
    columns: list[str]

    def join(self, annotations: DataFrame) -> DataFrame: ...


def keep_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """First row of each key by file order (insert or ignore)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.asc(order)))).where("_r = 1").drop("_r")


def keep_last(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Last row of each key by file order (insert or update)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def with_normal_key(df: DataFrame) -> DataFrame:
    """chrom, pos, ref and alt in the form that the index is keyed by."""
    n = alleles.normalised(F.col("pos"), F.col("ref"), F.col("alt"))
    return df.withColumn("_n", n).withColumns({"chrom": alleles.chrom_of_vcf(F.col("chrom")), "pos": F.col("_n.pos"), "ref": F.col("_n.ref"), "alt": F.col("_n.alt")}).drop("_n")


def unified_index(parts: dict[str, tuple[DataFrame, list[str], bool]]) -> DataFrame:
    """One table from several: name -> (rows with chrom, pos, ref, alt, line and value columns, value columns, whether
    the first row of a key counts instead of the last). One shuffle for all of them, not a join for each."""
    values = {c: dict(df.dtypes)[c] for df, cols, _ in parts.values() for c in cols}
    rows = None
    for name, (df, cols, first) in parts.items():
        line = F.col("line") if first else -F.col("line")
        own = with_normal_key(df).select(*GENOMIC_KEY, F.lit(name).alias("_part"), line.alias("_line"), *(F.col(c) if c in cols else F.lit(None).cast(t).alias(c) for c, t in values.items()))
        rows = own if rows is None else rows.unionByName(own)
    aggs = [F.min_by(c, F.when(F.col("_part") == name, F.col("_line"))).alias(c) for name, (_, cols, _) in parts.items() for c in cols]
    out = rows.groupBy(*GENOMIC_KEY).agg(*aggs)
    empty = lambda c: F.lit("") if values[c] == "string" else F.lit(0).cast(values[c])
    return out.select(*GENOMIC_KEY, *(F.coalesce(F.col(c), empty(c)).alias(c) for c in values))


def join_index(annotations: DataFrame, index: DataFrame, missense_only: tuple[str, ...] = ("am_score", "am_class")) -> DataFrame:
    """annotations with the index's columns by the normalised variant; some columns only for missense rows."""
    values = [c for c in index.columns if c not in GENOMIC_KEY]
    n = alleles.normalised(F.col("pos"), F.col("ref"), F.col("alt"))
    a = annotations.withColumn("_n", n).withColumns({"_kp": F.col("_n.pos"), "_kr": F.col("_n.ref"), "_ka": F.col("_n.alt"), "_kc": alleles.chrom_of_vcf(F.col("chrom"))}).drop("_n")
    i = index.withColumnsRenamed({"chrom": "_kc", "pos": "_kp", "ref": "_kr", "alt": "_ka"})
    kinds = dict(index.dtypes)
    empty = lambda c: F.lit("") if kinds[c] == "string" else F.lit(0).cast(kinds[c])
    out = a.join(i, ["_kc", "_kp", "_kr", "_ka"], "left").drop("_kc", "_kp", "_kr", "_ka")
    missense = terms.is_missense(F.col("consequence"))
    return out.withColumns({c: F.coalesce(F.when(missense, F.col(c)) if c in missense_only else F.col(c), empty(c)) for c in values})


HOTSPOT_TYPES = ["single residue", "in-frame indel", "splice", "3d"]


def best_hotspots(hotspots: DataFrame) -> DataFrame:
    """One row for each (transcript, position): lowest q-value, then the type's priority."""
    kind = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, HOTSPOT_TYPES)), F.col("type")), F.lit(0)), F.lit(len(HOTSPOT_TYPES) + 1))
    h = hotspots.where("transcript_id <> '' and position is not null").withColumn("transcript_id", text.unversioned(F.col("transcript_id")))
    w = Window.partitionBy("transcript_id", "position").orderBy("q_value", kind, "type")
    return h.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _apart(annotations: DataFrame, key: Column) -> Column:
    """A text key; rows where it is null get one of some thousand that no table has, so that they are dealt to all tasks."""
    spread = [c for c in (*GENOMIC_KEY, "transcript_id") if c in annotations.columns]
    return F.coalesce(key, F.concat(F.lit("-"), F.pmod(F.xxhash64(*spread), F.lit(4096)).cast("string")))


def join_hotspots(annotations: DataFrame, hotspots: DataFrame) -> DataFrame:
    h = best_hotspots(hotspots).select(F.col("transcript_id").alias("_t"), F.col("position").alias("_p"), F.col("type").alias("hotspot_type"), text.q_value(F.col("q_value")).alias("hotspot_q"))
    key = _apart(annotations, F.when(F.col("protein_position") != 0, text.unversioned(F.col("transcript_id"))))
    out = annotations.join(with_size_check(h), (key == F.col("_t")) & (F.col("protein_position") == F.col("_p")), "left")
    return out.withColumns({"hotspot": F.when(F.col("_t").isNotNull(), "Y").otherwise(""), "hotspot_type": F.coalesce("hotspot_type", F.lit("")), "hotspot_q": F.coalesce("hotspot_q", F.lit(""))}).drop("_t", "_p")


def join_genes(annotations: DataFrame, genes: DataFrame) -> DataFrame:
    """Gene type of each cancer gene; of repeated genes the last line counts."""
    g = keep_last(genes, ["gene_name"], "line").select("gene_name", "gene_type")
    return annotations.join(with_size_check(g), "gene_name", "left").withColumn("gene_type", F.coalesce("gene_type", F.lit("")))


def join_predictions(annotations: DataFrame, cells: DataFrame) -> DataFrame:
    """SIFT and PolyPhen of missense rows from cells (md5, analysis, position, alt_aa, score, prediction)."""
    alt = F.substring("amino_acid_change", -1, 1)
    key = F.when(terms.is_missense(F.col("consequence")) & (F.col("peptide_md5") != ""), F.col("peptide_md5"))
    out = annotations.withColumns({"_md5": _apart(annotations, key), "_aa": alt})
    # both analyses of a cell in one row, so that one join does
    wide = cells.groupBy("md5", "position", "alt_aa").agg(*(F.max(F.when(F.col("analysis") == a, F.col(c))).alias(f"{a}_{c}") for a in ("sift", "polyphen") for c in ("score", "prediction")))
    out = out.join(wide, (F.col("_md5") == F.col("md5")) & (F.col("protein_position") == F.col("position")) & (F.col("_aa") == F.col("alt_aa")), "left")
    cols = {f"{a}_{c}": F.coalesce(text.score3(F.col(f"{a}_{c}")) if c == "score" else F.col(f"{a}_{c}"), F.lit("")) for a in ("sift", "polyphen") for c in ("score", "prediction")}
    return out.withColumns(cols).drop("_md5", "_aa", "md5", "position", "alt_aa")


AMINO = "ACDEFGHIKLMNPQRSTVWY"
CLASSES = {"sift": ["tolerated", "deleterious", "tolerated_low_confidence", "deleterious_low_confidence"], "polyphen": ["probably_damaging", "possibly_damaging", "benign", "unknown"]}


def decode_cell(cell: Column, analysis: Column) -> Column:
    """struct(score, prediction) of a 16-bit cell: two bits of class above ten bits of thousandths; null for 0xFFFF."""
    kind = F.shiftright(cell, 14).bitwiseAND(3)
    name = F.when(analysis == "sift", F.element_at(F.array(*map(F.lit, CLASSES["sift"])), kind + 1)).otherwise(F.element_at(F.array(*map(F.lit, CLASSES["polyphen"])), kind + 1))
    return F.when(cell != 0xFFFF, F.struct((cell.bitwiseAND(1023) / 1000.0).alias("score"), name.alias("prediction")))


def cell_at(matrix: Column, at: Column) -> Column:
    """The cell (0 to 65535) at a place, from 0, of a matrix of a 3-byte header and little-endian cells, 20 for a position."""
    swapped = F.conv(F.hex(F.substring(matrix, (4 + 2 * at).cast("int"), F.lit(2))), 16, 10).cast("int")
    return swapped % 256 * 256 + F.floor(swapped / 256).cast("int")


def explode_matrix(matrices: DataFrame) -> DataFrame:
    """Cells of matrices (md5, analysis, matrix: binary, see cell_at)."""
    n = F.floor((F.octet_length("matrix") - 3) / 2).cast("int")
    rows = matrices.where(F.octet_length("matrix") >= 5).select("md5", "analysis", "matrix", F.explode(F.sequence(F.lit(0), n - 1)).alias("_i"))
    # generated from a one-element array, so that a cell is read once and not in each expression that uses it
    rows = rows.select("md5", "analysis", "_i", F.explode(F.array(cell_at(F.col("matrix"), F.col("_i")))).alias("_cell")).where("_cell <> 65535")
    d = decode_cell(F.col("_cell"), F.col("analysis"))
    return rows.select("md5", "analysis", (F.expr("_i div 20") + 1).cast("bigint").alias("position"), F.substring(F.lit(AMINO), F.expr("cast(_i % 20 + 1 as int)"), F.lit(1)).alias("alt_aa"), d["score"].alias("score"), d["prediction"].alias("prediction"))


def with_matrices(peptides: DataFrame, matrices: DataFrame) -> DataFrame:
    """Rows with peptide_md5 and the matrices of that peptide, an array for each analysis (`_sift`, `_polyphen`): some hundred
    bytes a peptide, where its cells would be a hundred rows and more."""
    wide = matrices.where(F.octet_length("matrix") >= 5).groupBy("md5").agg(*(F.collect_set(F.when(F.col("analysis") == a, F.col("matrix"))).alias(f"_{a}") for a in CLASSES))
    return peptides.join(wide, F.col("peptide_md5") == F.col("md5"), "left").drop("md5")


def read_matrices(annotations: DataFrame) -> DataFrame:
    """SIFT and PolyPhen of missense rows, as `join_predictions` gives them, each read at its place in the row's matrices."""
    aa = F.substring("amino_acid_change", -1, 1)
    at = (F.col("protein_position") - 1) * len(AMINO) + F.instr(F.lit(AMINO), aa) - 1
    asked = terms.is_missense(F.col("consequence")) & (F.col("protein_position") > 0) & (aa != "") & (F.instr(F.lit(AMINO), aa) > 0)
    out = annotations.withColumn("_at", F.explode(F.array(F.when(asked, at))))

    def most(analysis, part):
        cells = F.transform(F.col(f"_{analysis}"), lambda m: F.when(F.col("_at") < F.floor((F.octet_length(m) - 3) / 2), decode_cell(cell_at(m, F.col("_at")), F.lit(analysis))[part]))
        value = F.when(F.col("_at").isNotNull(), F.array_max(cells))
        return F.coalesce(text.score3(value) if part == "score" else value, F.lit(""))

    return out.withColumns({f"{a}_{part}": most(a, part) for a in CLASSES for part in ("score", "prediction")}).drop("_at", *(f"_{a}" for a in CLASSES))


def join_matrices(annotations: DataFrame, peptides: DataFrame, matrices: DataFrame) -> DataFrame:
    """Annotations with the predictions of their transcripts' peptides (transcript_id, peptide_md5): the matrices are joined to
    the peptides first, so that the many rows are dealt once."""
    key = _apart(annotations, F.nullif("transcript_id", F.lit("")))
    found = with_matrices(peptides, matrices).withColumnRenamed("transcript_id", "_id").hint("merge")
    return read_matrices(annotations.withColumn("_key", key).join(found, F.col("_key") == F.col("_id"), "left").drop("_key", "_id"))


def join_by_transcript(df: DataFrame, table: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Rows of a table keyed by unversioned transcript id, as a sorted list in one column (domains, sites, accessions)."""
    t = table.groupBy(text.unversioned(F.col("transcript_id")).alias("_t")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    return df.join(t, text.unversioned(F.col("transcript_id")) == F.col("_t"), "left").withColumn(name, F.coalesce(F.col(name), F.filter(F.array(F.struct(*[F.lit(None).cast(dict(table.dtypes)[c]).alias(c) for c in columns])), lambda x: F.lit(False)))).drop("_t")
