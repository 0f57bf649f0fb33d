"""Consequence terms: impacts, MAF classes, normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codon import lit_map

# The public impact of each consequence term.
HIGH = ["transcript_ablation", "splice_acceptor_variant", "splice_donor_variant", "stop_gained", "frameshift_variant", "stop_lost", "start_lost"]
MODERATE = ["inframe_insertion", "inframe_deletion", "missense_variant", "protein_altering_variant"]
LOW = ["splice_region_variant", "start_retained_variant", "stop_retained_variant", "synonymous_variant"]
RANK = {t: 3 for t in HIGH} | {t: 2 for t in MODERATE} | {t: 1 for t in LOW}
IMPACTS = ["MODIFIER", "LOW", "MODERATE", "HIGH"]

# MAF classes of consequence terms; frameshifts and inframe terms are below.
MAF_CLASS = {
    "missense_variant": "Missense_Mutation", "stop_gained": "Nonsense_Mutation", "synonymous_variant": "Silent", "splice_donor_variant": "Splice_Site", "splice_acceptor_variant": "Splice_Site",
    "splice_region_variant": "Splice_Region", "stop_lost": "Nonstop_Mutation", "start_lost": "Translation_Start_Site", "inframe_deletion": "In_Frame_Del", "inframe_insertion": "In_Frame_Ins",
    "stop_retained_variant": "Silent", "start_retained_variant": "Silent", "3_prime_UTR_variant": "3'UTR", "5_prime_UTR_variant": "5'UTR", "intron_variant": "Intron", "intergenic_variant": "IGR",
    "downstream_gene_variant": "3'Flank", "upstream_gene_variant": "5'Flank", "non_coding_transcript_exon_variant": "RNA", "mature_miRNA_variant": "RNA",
}

# Spellings that a comparison takes for one another.
ALIASES = {
    "missense_mutation": "missense_variant", "nonsense_mutation": "stop_gained", "silent": "synonymous_variant", "splice_site": "splice_donor_variant", "frame_shift_del": "frameshift_variant", "frame_shift_ins": "frameshift_variant",
    "in_frame_del": "inframe_deletion", "in_frame_ins": "inframe_insertion", "nonstop_mutation": "stop_lost", "translation_start_site": "start_lost", "3'utr": "3_prime_utr_variant", "5'utr": "5_prime_utr_variant",
    "intron": "intron_variant", "igr": "intergenic_variant", "3'flank": "downstream_gene_variant", "5'flank": "upstream_gene_variant", "protein_altering_variant": "inframe_variant", "inframe_deletion": "inframe_variant",
    "inframe_insertion": "inframe_variant", "mature_mirna_variant": "non_coding_transcript_exon_variant", "splice_donor_region_variant": "splice_region_variant", "splice_donor_5th_base_variant": "splice_region_variant",
}
# Terms that a comparison leaves out, terms that speak of coding sequence, and biotypes with one.
SILENT_TERMS = ["non_coding_transcript_variant", "nmd_transcript_variant", "splice_polypyrimidine_tract_variant"]
CODING_TERMS = ["missense_variant", "missense_mutation", "synonymous_variant", "silent", "frameshift_variant", "frame_shift_del", "frame_shift_ins", "nonsense_mutation", "stop_gained", "stop_lost", "nonstop_mutation", "start_lost", "translation_start_site", "inframe_deletion", "inframe_insertion", "in_frame_del", "in_frame_ins", "protein_altering_variant", "stop_retained_variant", "splice_site"]
CODING_BIOTYPES = ["protein_coding", "nonsense_mediated_decay", "non_stop_decay", "IG_V_gene", "IG_D_gene", "IG_J_gene", "IG_C_gene", "TR_V_gene", "TR_D_gene", "TR_J_gene", "TR_C_gene", "protein_coding_LoF"]


def parts(terms: Column) -> Column:
    return F.split(terms, ",")


def rank_of_term(term: Column) -> Column:
    return F.coalesce(F.element_at(lit_map(RANK), term), F.lit(0))


def impact_rank(terms: Column) -> Column:
    """0 (modifier) to 3 (high): the most of a comma-separated list."""
    return F.array_max(F.transform(parts(terms), rank_of_term))


def impact_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, IMPACTS)), rank + 1)


def impact(terms: Column) -> Column:
    return impact_name(impact_rank(terms))


def rank_of_impact(name: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, IMPACTS)), name) - 1, F.lit(-1)).cast("int")


def is_missense(terms: Column) -> Column:
    return F.array_contains(parts(terms), "missense_variant")


def is_coding_biotype(biotype: Column) -> Column:
    return biotype.isin(CODING_BIOTYPES)


def maf_class(terms: Column, ref: Column, alt: Column) -> Column:
    """MAF variant classification of the first term; an unknown term stands for itself."""
    first = F.element_at(parts(terms), 1)
    bare = lambda x: F.length(F.replace(x, F.lit("-"), F.lit("")))
    shift = F.when(bare(ref) > bare(alt), "Frame_Shift_Del").otherwise("Frame_Shift_Ins")
    return F.when(first == "frameshift_variant", shift).otherwise(F.coalesce(F.element_at(lit_map(MAF_CLASS), first), first))


def normalised(terms: Column) -> Column:
    """Comparable form: lower case, aliases mapped once, terms dropped that others imply, sorted."""
    t = F.transform(F.split(F.lower(F.trim(terms)), ","), lambda x: F.coalesce(F.element_at(lit_map(ALIASES), F.trim(x)), F.trim(x)))
    t = F.filter(t, lambda x: ~x.isin(SILENT_TERMS))
    has = lambda p: F.exists(t, p)
    splice = has(lambda x: x.isin("splice_donor_variant", "splice_acceptor_variant"))
    high = has(lambda x: rank_of_term(x) == 3)
    shift = has(lambda x: x == "frameshift_variant")
    primary = has(lambda x: ~x.isin("intron_variant", "splice_region_variant"))
    drop = lambda x: (splice & (x == "intron_variant")) | (primary & (x == "splice_region_variant")) | (high & x.isin("5_prime_utr_variant", "3_prime_utr_variant", "start_retained_variant", "stop_retained_variant", "coding_sequence_variant")) | (shift & x.isin("stop_gained", "stop_lost"))
    return F.array_join(F.array_sort(F.filter(t, lambda x: ~drop(x))), ",")


def primary(norm: Column) -> Column:
    """The term of highest impact, the first on ties."""
    t = parts(norm)
    return F.element_at(F.filter(t, lambda x: rank_of_term(x) == F.array_max(F.transform(t, rank_of_term))), 1)


def has_coding(terms: Column) -> Column:
    return F.exists(F.split(F.lower(terms), ","), lambda x: F.trim(x).isin(CODING_TERMS))


def has_noncoding(norm: Column) -> Column:
    return F.exists(F.split(norm, ","), lambda x: F.trim(x).isin("non_coding_transcript_exon_variant", "intron_variant"))
