"""Consequence prediction: one row for each variant and overlapping transcript.

Single-base variants stay in JVM expressions from the join on. The few others take the same join; their coding effect
and notation come from one Arrow-batched function. The two branches are filtered before the join, so each reads only
its own variants."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from itertools import repeat

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alleles, codon, coords, terms
from . import indel
from .overlap import BIN, BROADCAST_BYTES, interval_join, row_bytes

# Executors need no copy of this package: what runs on them travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(indel)

OUT = ["consequence", "impact", "cds_position", "protein_position", "amino_acid_change", "codon_change", "exon_number", "hgvsp", "hgvsc"]
#: Columns that exist in every output and are never assigned.
EMPTY = {"intron_number": "''", "cdna_position": "0L"}
TX = ["transcript_id", "gene_id", "gene_name", "strand", "biotype", "canonical", "msk_canonical", "mane_select", "protein_id", "entrez_id"]


def _region(df: DataFrame, plain: bool) -> DataFrame:
    """Where a variant starts: exon, coding position, splice sites. Rows of segments (plain) have the exons beside it."""
    pos = F.col("pos")
    if plain:
        return df.withColumns({
            "_exon": coords.flat_exon(pos), "_cds": coords.flat_cds_position(pos), "_near": coords.flat_in_splice_region(pos), "_site": coords.flat_splice_site(pos),
            "_edge_codon": coords.flat_splice_codon(pos), "_place": coords.flat_notation(pos),
        }).drop(*coords.FLAT)
    df = df.withColumns({"_coding": coords.is_coding(), "_plus": F.col("strand") == 1, "_exon": coords.exon_at(pos)["number"], "_exons": F.size("exons")})
    place = {"_near": coords.in_splice_region(pos), "_edge_codon": coords.splice_codon(pos), "_place": coords.notation(pos)}
    cds, site = coords.cds_position(pos), coords.splice_site(pos)
    return df.withColumns({**place, "_cds": F.when(F.col("_exon").isNull(), F.lit(0).cast("bigint")).otherwise(cds), "_site": F.when(F.col("_exon").isNull(), site).otherwise(F.lit(""))})


def _cascade(coding_term: Column) -> Column:
    """The first rule that fits gives the term; `coding_term` is what the coding sequence says."""
    pos = F.col("pos")
    intron = F.when(F.col("_site") != "", F.col("_site")).when(F.col("_near"), F.lit("splice_region_variant,intron_variant")).otherwise(F.lit("intron_variant"))
    noncoding = F.when(F.col("biotype") == "miRNA", F.lit("mature_miRNA_variant")).otherwise(F.lit("non_coding_transcript_exon_variant"))
    before = F.when(F.col("_plus"), pos < F.col("cds_start")).otherwise(pos > F.col("cds_end"))
    after = F.when(F.col("_plus"), pos > F.col("cds_end")).otherwise(pos < F.col("cds_start"))
    utr = F.when(before, F.lit("5_prime_UTR_variant")).otherwise(F.lit("3_prime_UTR_variant"))
    cds = F.when(F.col("_near"), F.concat(coding_term, F.lit(",splice_region_variant"))).otherwise(coding_term)
    return F.when(F.col("transcript_id").isNull(), F.lit("intergenic_variant")).when(F.col("_exon").isNull(), intron).when(~F.col("_coding"), noncoding).when(before | after, utr).otherwise(cds)


def _impact(term: Column) -> Column:
    """Of a predicted list of terms: the first is the highest (a splice region is appended, never in front of a coding
    term), so that no expression goes over an array."""
    first = F.substring_index(term, ",", 1)
    return F.when(first.isin(terms.HIGH), F.lit("HIGH")).when(first.isin(terms.MODERATE), F.lit("MODERATE")).when(first.isin(terms.LOW), F.lit("LOW")).otherwise(F.lit("MODIFIER"))


def _finish(df: DataFrame, variant_columns: list[str], only: list[str] | None = None) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    nmd = F.when(F.col("biotype") == "nonsense_mediated_decay", F.concat("consequence", F.lit(",NMD_transcript_variant"))).otherwise(F.col("consequence"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = {
        "variant_id": alleles.variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")),
        **{c: flag(c) if c in ("canonical", "msk_canonical", "mane_select") else F.coalesce(F.col(c), F.lit(0)) if c == "strand" else text(c) for c in TX},
        "tx_start": F.coalesce("tx_start", F.lit(0)).cast("bigint"), "consequence": nmd, **{c: F.col(c) for c in OUT[1:]}, **{k: F.expr(v) for k, v in EMPTY.items()}, "peptide_md5": F.coalesce("peptide_md5", F.lit("")),
    }
    # Generating the row from a one-element array keeps later filters on predicted columns from being pushed below and
    # expanded into copies of the whole expression tree.
    row = F.explode(F.array(F.struct(*(c.alias(k) for k, c in out.items() if only is None or k in only))))
    return df.select(*variant_columns, row.alias("_row")).select(*variant_columns, "_row.*")


def _snv(df: DataFrame, plain: bool) -> DataFrame:
    """Adds the predicted columns for single-base variants, joined with segments (plain) or with whole transcripts."""
    df = _region(df, plain)
    number, offset = coords.codon_number(F.col("_cds")), coords.codon_offset(F.col("_cds"))
    own = codon.codon_at(F.col("_slice"), number - F.col("_codon0")) if plain else codon.codon_at(F.col("cds_sequence"), number)
    base = F.when(F.col("_plus"), F.col("alt")).otherwise(codon.complement_base(F.col("alt")))
    df = df.withColumns({"_number": number, "_ref_codon": F.when(F.col("_cds") > 0, own).otherwise(F.lit(""))})
    df = df.withColumns({"_offset": offset, "_ref_aa": codon.amino_acid(F.col("_ref_codon")), "_alt_codon": codon.mutate(F.col("_ref_codon"), offset, base)})
    df = df.withColumn("_alt_aa", codon.amino_acid(F.col("_alt_codon")))
    ref, alt, n = F.col("_ref_aa"), F.col("_alt_aa"), F.col("_number")
    term = (
        F.when(F.col("_cds") < 1, F.lit("intron_variant")).when(F.coalesce(F.length("_ref_codon"), F.lit(0)) != 3, F.lit("coding_sequence_variant"))
        .when((ref == alt) & (ref == "*"), F.lit("stop_retained_variant")).when(ref == alt, F.lit("synonymous_variant")).when(alt == "*", F.lit("stop_gained")).when(ref == "*", F.lit("stop_lost"))
        .when((ref == "M") & (n == 1), F.lit("start_lost")).otherwise(F.lit("missense_variant"))
    )
    df = df.withColumn("_term", term).withColumn("consequence", _cascade(F.col("_term")))
    in_cds = F.col("_coding") & F.col("_exon").isNotNull() & F.col("pos").between(F.col("cds_start"), F.col("cds_end"))
    df = df.withColumns({"_in_cds": F.coalesce(in_cds, F.lit(False)), "impact": _impact(F.col("consequence"))})
    known = F.col("_in_cds") & (F.col("_cds") >= 1) & ~F.col("_term").isin("intron_variant", "coding_sequence_variant")
    splice_n = F.when(F.col("_coding") & F.col("_exon").isNull() & F.col("consequence").isin("splice_donor_variant", "splice_acceptor_variant"), F.col("_edge_codon")).otherwise(F.lit(0))
    df = df.withColumns({"_known": known, "_splice_n": splice_n})
    number = n.cast("string")
    three = codon.three_letter
    stop = F.when(F.col("_term") == "stop_lost", F.col("_utr_stop")).otherwise(F.lit(0))
    p = (
        F.when(F.col("_term") == "missense_variant", F.concat(F.lit("p."), three(ref), number, three(alt))).when(F.col("_term") == "synonymous_variant", F.concat(F.lit("p."), three(ref), number, F.lit("=")))
        .when(F.col("_term") == "stop_gained", F.concat(F.lit("p."), three(ref), number, F.lit("Ter"))).when(F.col("_term") == "stop_lost", F.concat(F.lit("p.Ter"), number, three(alt), F.lit("ext*"), F.when(stop > 0, stop.cast("string")).otherwise(F.lit("?"))))
        .when(F.col("_term") == "stop_retained_variant", F.concat(F.lit("p.Ter"), number, F.lit("="))).when(F.col("_term") == "start_lost", F.lit("p.Met1?")).otherwise(F.lit(""))
    )
    strand_base = lambda c: F.when(F.col("_plus"), F.col(c)).otherwise(codon.complement_base(F.col(c)))
    prefix = F.when(F.col("_coding"), F.lit("c.")).otherwise(F.lit("n."))
    c = F.when(F.col("transcript_id").isNull() | (F.col("_place") == ""), F.lit("")).when(F.col("ref") == F.col("alt"), F.concat(prefix, F.col("_place"), F.lit("="))).otherwise(F.concat(prefix, F.col("_place"), strand_base("ref"), F.lit(">"), strand_base("alt")))
    change = F.when(F.col("_known") & F.col("_term").isin("missense_variant", "stop_gained", "stop_lost", "start_lost"), F.concat(ref, number, alt)).otherwise(F.lit(""))
    return df.withColumns({
        "cds_position": F.when(F.col("_in_cds"), F.col("_cds")).otherwise(F.lit(0)).cast("bigint"),
        "protein_position": F.when(F.col("_in_cds"), n).otherwise(F.col("_splice_n")).cast("bigint"),
        "amino_acid_change": change,
        "codon_change": F.when(F.col("_known"), codon.codon_change(F.col("_ref_codon"), F.col("_alt_codon"), F.col("_offset"))).otherwise(F.lit("")),
        "exon_number": F.coalesce(F.concat(F.col("_exon").cast("string"), F.lit("/"), F.col("_exons").cast("string")), F.lit("")),
        "hgvsp": F.when(F.col("_known"), p).when(F.col("_splice_n") > 0, F.concat(F.lit("p.X"), F.col("_splice_n").cast("string"), F.lit("_splice"))).otherwise(F.lit("")),
        "hgvsc": c,
    })


#: What the batched function gives, of which a query takes the columns that it reads.
EFFECT = {"consequence": pa.string(), "impact": pa.string(), "cds_position": pa.int64(), "protein_position": pa.int64(), "amino_acid_change": pa.string(), "codon_change": pa.string(), "exon_number": pa.string(), "hgvsp": pa.string(), "hgvsc": pa.string()}
SPARK_TYPE = {pa.string(): "string", pa.int64(): "bigint"}
IMPACT = {t: level for level, names in (("LOW", terms.LOW), ("MODERATE", terms.MODERATE), ("HIGH", terms.HIGH)) for t in names}


#: Characters of transcripts that a worker keeps parsed.
KEEP = 48 << 20
_parsed: dict[str, indel.Tx] = {}
_kept = [0]


def packed_transcript() -> Column:
    """A transcript as one string, made once for each transcript before the join; workers parse each string once."""
    regions = F.array_join(F.transform("cds_regions", lambda r: F.concat_ws(",", r["start"], r["end"], r["offset"])), ";")
    exons = F.array_join(F.transform(F.arrays_zip(F.col("exons").alias("e"), F.col("exon_cum").alias("c")), lambda x: F.concat_ws(",", x["e"]["start"], x["e"]["end"], x["e"]["cds_start"], x["e"]["cds_end"], x["c"], x["e"]["number"])), ";")
    return F.concat_ws("|", "strand", "cds_start", "cds_end", F.coalesce(regions, F.lit("")), F.coalesce(exons, F.lit("")), F.coalesce("cds_sequence", F.lit("")), F.coalesce("utr3_sequence", F.lit("")))


def parsed(s: str) -> indel.Tx:
    t = _parsed.get(s)
    if t is None:
        if _kept[0] > KEEP:
            _parsed.clear()
            _kept[0] = 0
        _kept[0] += len(s)
        strand, lo, hi, regions, exons, cds, utr3 = s.split("|")
        rows = lambda text: [tuple(map(int, x.split(","))) for x in text.split(";") if x]
        e = rows(exons)
        t = _parsed[s] = indel.Tx(int(strand), rows(regions), cds, utr3, exons=[x[:4] for x in e], cds_start=int(lo), cds_end=int(hi), exon_cum=[x[4] for x in e], numbers=[x[5] for x in e])
    return t


def _term(t: indel.Tx, pos: int, ref: str, alt: str, biotype: str | None, exon: int, near: bool, site: str, touched: str, coding_term: str) -> str:
    """The first rule that fits, as in `_cascade`; `touched` is the splice site that an indel's bases touch."""
    if not exon:
        return touched or site or ("splice_region_variant,intron_variant" if near else "intron_variant")
    if not t.coding:
        return "mature_miRNA_variant" if biotype == "miRNA" else "non_coding_transcript_exon_variant"
    lo, hi, plus, end, long = t.cds_start, t.cds_end, t.strand == 1, pos + len(ref) - 1, len(ref) > 1
    start, stop = ((lo, lo + 2), (hi - 2, hi)) if plus else ((hi - 2, hi), (lo, lo + 2))
    spans = lambda x: end >= x[0] and pos <= x[1]
    if pos < lo or pos > hi:
        five = pos < lo if plus else pos > hi
        if long:
            if touched and len(ref) != len(alt):
                return touched
            if five and spans(start):
                return "start_lost"
            if not five and spans(stop):
                return "stop_lost,3_prime_UTR_variant"
        return "5_prime_UTR_variant" if five else "3_prime_UTR_variant"
    if long and len(ref) != len(alt) and spans(start):
        return "start_lost"
    return touched or (f"{coding_term},splice_region_variant" if near else coding_term)


def _effect_rows(pos: Iterable, ref: Iterable, alt: Iterable, tx: Iterable, protein: bool, coding: bool, biotype: Iterable) -> list[tuple]:
    """EFFECT's values for variants that aren't single bases, each with a packed transcript or none. `protein` and `coding`
    say whether these notations are wanted; '' otherwise."""
    none = indel.Effect()
    nowhere = ("intergenic_variant", "MODIFIER", 0, 0, "", "", "", "", "")
    out = []
    for p, r, a, s, kind in zip(pos, ref, alt, tx, biotype):  # noqa: B905
        if not s:
            out.append(nowhere)
            continue
        t = parsed(s)
        exon, near, site, touched, edge = indel.place(t, p, r, a)
        inside = exon > 0 and t.coding and t.cds_start <= p <= t.cds_end
        e = indel.coding_effect(t, p, r, a) if inside else none
        c = _term(t, p, r, a, kind, exon, near, site, touched, e.consequence)
        at_splice = edge if t.coding and not exon and c in ("splice_donor_variant", "splice_acceptor_variant") else 0
        lost = exon > 0 and c == "start_lost" and (not inside or (len(r) > 1 and len(r) != len(a)))
        hgvsp = ""
        if protein:
            hgvsp = "p.Met1?" if lost else e.hgvsp() if inside else f"p.X{at_splice}_splice" if at_splice > 0 else ""
        out.append((
            c, IMPACT.get(c.split(",", 1)[0], "MODIFIER"), e.cds_position if inside else 0, 1 if lost else e.protein_position if inside else at_splice, e.amino_acid_change, "",
            f"{exon}/{len(t.exons)}" if exon else "", hgvsp, indel.hgvsc(t, p, r, a) if coding else "",
        ))
    return out


def _effects(pos: Iterable, ref: Iterable, alt: Iterable, tx: Iterable, protein: bool = True, coding: bool = True, biotype: Iterable | None = None) -> pd.DataFrame:
    """The same as a table."""
    return pd.DataFrame(_effect_rows(pos, ref, alt, tx, protein, coding, repeat(None) if biotype is None else biotype), columns=list(EFFECT))


def _once(texts: pa.Array) -> list[str | None]:
    """The texts of a batch; one that stands in many rows is decoded and hashed once."""
    known = texts.dictionary_encode()
    values = known.dictionary.to_pylist()
    return [None if i is None else values[i] for i in known.indices.to_pylist()]


def _complex(df: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Adds the predicted columns that are wanted for all other variants, all of them worked out in the batched function."""
    wanted = [c for c in EFFECT if only is None or c in only]
    kinds = [EFFECT[c] for c in wanted]

    def effects(pos: pa.Array, ref: pa.Array, alt: pa.Array, tx: pa.Array, biotype: pa.Array) -> pa.Array:
        found = _effect_rows(pos.to_pylist(), _once(ref), _once(alt), _once(tx), "hgvsp" in wanted, "hgvsc" in wanted, _once(biotype))
        columns = dict(zip(EFFECT, zip(*found, strict=True), strict=True)) if found else dict.fromkeys(EFFECT, ())
        return pa.StructArray.from_arrays([pa.array(columns[c], k) for c, k in zip(wanted, kinds, strict=True)], wanted)

    one = F.arrow_udf(effects, ", ".join(f"{c} {SPARK_TYPE[EFFECT[c]]}" for c in wanted))
    df = df.withColumn("_e", one("pos", "ref", "alt", "_packed", "biotype")).drop("_packed")
    return df.withColumns({c: F.col(f"_e.{c}") for c in wanted}).drop("_e")


#: The JVM leaves methods of more than 8,000 bytes of code uncompiled, and one method for a whole stage of predictions is larger;
#: beyond this limit Spark makes smaller ones.
METHOD_BYTES = 8000


def small_methods(spark: SparkSession) -> None:
    """Methods that the JVM compiles, in this session; a limit that the user has set stays."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name) == "65535":  # Spark's default
        spark.conf.set(name, str(METHOD_BYTES))


def prepared(transcripts: DataFrame) -> tuple[DataFrame, int, bool]:
    """transcripts with what prediction needs of each, made once a transcript and on all cores; their measured bytes, and
    whether some of them aren't plain."""
    small_methods(transcripts.sparkSession)
    known = coords.with_plan(transcripts).agg(F.coalesce(F.sum(row_bytes(transcripts)), F.lit(0)), F.count_if(~F.col("_plain"))).first()
    size = 2 * int(known[0])  # with what is added
    cores = transcripts.sparkSession.sparkContext.defaultParallelism
    t = transcripts.repartition(cores) if size <= BROADCAST_BYTES else transcripts  # a small model may be one partition
    if "peptide_md5" not in t.columns:
        t = t.withColumn("peptide_md5", codon.peptide_md5(F.col("cds_sequence")))
    utr_stop = F.instr(codon.translate(F.coalesce(F.col("utr3_sequence"), F.lit(""))), "*")  # codons to the first stop there
    return coords.with_plan(t.withColumns({"tx_start": F.col("start"), "_utr_stop": utr_stop})), size, known[1] > 0


def _single(variants: DataFrame, t: DataFrame, size: int, odd: bool, width: int, only: list[str] | None) -> DataFrame:
    """Prediction of single-base variants: by segments for plain transcripts, without an expression over arrays; by whole
    transcripts for the others; and a row for variants that no transcript holds, from the same join where all transcripts are
    plain: their segments fill them."""
    kept = variants.columns
    if not odd:
        return _finish(_snv(interval_join(variants, coords.flat(coords.segments(t).drop("_plain")), width, "left", size=size), True), kept, only)
    out = _finish(_snv(interval_join(variants, coords.flat(coords.segments(t.where("_plain")).drop("_plain")), width, "inner", size=size), True), kept, only)
    out = out.unionByName(_finish(_snv(interval_join(variants, t.where("not _plain").drop("_plain"), width, "inner", size=size), False), kept, only))
    return out.unionByName(_finish(_nowhere(variants, t, size, width), kept, only))


def _nowhere(variants: DataFrame, t: DataFrame, size: int, width: int) -> DataFrame:
    """Variants that no transcript holds, with their predicted columns."""
    ids = t.select("transcript_id", "chrom", "start", "end")
    names = [c for c in t.columns if c not in variants.columns]
    kinds = dict(t.dtypes)
    rest = interval_join(variants, ids, width, "left", size=size).where("transcript_id is null").drop("transcript_id", "start", "end")
    rest = rest.withColumns({c: F.lit(None).cast(kinds[c]) for c in names})
    zero = {"cds_position": "0L", "protein_position": "0L"}
    return rest.withColumns({"consequence": F.lit("intergenic_variant"), "impact": F.lit("MODIFIER"), **{c: F.expr(zero.get(c, "''")) for c in OUT[2:]}})


def placed(variants: DataFrame, transcripts: DataFrame, columns: dict[str, tuple[Column, Column]], width: int = BIN) -> DataFrame:
    """variants with each transcript that holds them (its id) and columns that say where: of each a pair, by the segments of
    plain transcripts and by the arrays of the others."""
    t, size, odd = prepared(transcripts)
    kept = [*variants.columns, "transcript_id"]
    rows = lambda t, i: interval_join(variants, t.drop("_plain"), width, "inner", size=size).withColumn("_inside", F.col("pos") <= F.col("_lo.end") if i == 0 else F.lit(None)).select(*kept, *(c[i].alias(k) for k, c in columns.items()))
    out = rows(coords.segments(t.where("_plain") if odd else t), 0)
    return out.unionByName(rows(t.where("not _plain"), 1)) if odd else out


def annotate(variants: DataFrame, transcripts: DataFrame, canonical_only: bool = False, width: int = BIN, only: list[str] | None = None) -> DataFrame:
    """variants (at least chrom, pos, ref, alt) with the prediction for each transcript that holds them; a variant
    without a transcript has one intergenic row. With canonical_only only MSK-canonical transcripts count; `only` names
    the predicted columns that are wanted."""
    if canonical_only:
        transcripts = transcripts.where("msk_canonical")
    if only is not None and set(only) <= {*TX, "tx_start", "variant_id"}:
        return _overlapping(variants, transcripts, width, only)
    t, size, odd = prepared(transcripts)
    columns = variants.columns
    v = variants.withColumn("chrom", alleles.chrom_of_vcf(F.col("chrom"))).withColumnsRenamed({c: f"_v_{c}" for c in columns if c in t.columns and c != "chrom"})
    snv = alleles.is_snv(F.col("ref"), F.col("alt"))
    one = _single(v.where(snv), t, size, odd, width, only)
    packed = t.withColumn("_packed", packed_transcript()).drop("_plain", "exons", "exon_cum", "cds_regions", "cds_sequence", "utr3_sequence", "_t5", "_t3", "_utr_stop")
    more = _finish(_complex(interval_join(v.where(~snv), packed, width, size=size), only), v.columns, only)
    return one.unionByName(more)


def _overlapping(variants: DataFrame, transcripts: DataFrame, width: int, only: list[str]) -> DataFrame:
    """Where nothing is predicted: each variant with the transcripts that hold it, in one join of all variants."""
    t = transcripts.select("transcript_id", "chrom", "start", "end", *(c for c in TX[1:] if c in only), F.col("start").alias("tx_start"))
    v = variants.withColumn("chrom", alleles.chrom_of_vcf(F.col("chrom"))).withColumnsRenamed({c: f"_v_{c}" for c in variants.columns if c in t.columns and c != "chrom"})
    return _finish(interval_join(v, t, width), v.columns, only)


def annotate_snvs(variants: DataFrame, transcripts: DataFrame, width: int = BIN, only: list[str] | None = None) -> DataFrame:
    """The single-base branch alone, for inputs known to hold nothing else."""
    t, size, odd = prepared(transcripts.withColumn("peptide_md5", F.lit("")))
    return _single(variants, t, size, odd, width, only)
