"""Sequence functions on columns: codons, complements, translation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code, codons in the order of the bases TCAG, and amino acid names.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
THREE = {"A": "Ala", "R": "Arg", "N": "Asn", "D": "Asp", "C": "Cys", "Q": "Gln", "E": "Glu", "G": "Gly", "H": "His", "I": "Ile", "L": "Leu", "K": "Lys", "M": "Met", "F": "Phe", "P": "Pro", "S": "Ser", "T": "Thr", "W": "Trp", "Y": "Tyr", "V": "Val", "*": "Ter", "X": "Xaa"}

CODE = dict(zip((a + b + c for a in BASES for b in BASES for c in BASES), AMINO_ACIDS, strict=True))


def lit_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def amino_acid(codon: Column) -> Column:
    """One-letter code of an upper-case codon; X if it is none.

    By the place of the bases in TCAG: arithmetic and one substring, so that it stays in generated code."""
    at = lambda i: F.instr(F.lit(BASES), F.substring(codon, i, 1))
    place = (at(1) - 1) * 16 + (at(2) - 1) * 4 + at(3)
    return F.when((F.length(codon) == 3) & (at(1) > 0) & (at(2) > 0) & (at(3) > 0), F.substring(F.lit(AMINO_ACIDS), place, F.lit(1))).otherwise(F.lit("X"))


def is_stop(codon: Column) -> Column:
    return codon.isin([c for c, a in CODE.items() if a == "*"])


def is_start(codon: Column) -> Column:
    return codon == "ATG"


def three_letter(aa: Column) -> Column:
    """Three-letter code; Xaa for what is none."""
    return F.coalesce(F.element_at(lit_map(THREE), aa), F.lit("Xaa"))


def three_letters(aas: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(aas, ""), lambda a: a != ""), three_letter), "")


def complement(s: Column) -> Column:
    """Of A, C, G, T in either case; N for anything else."""
    return F.translate(F.regexp_replace(s, "[^ACGTacgt]", "N"), "ACGTacgt", "TGCAtgca")


def complement_base(base: Column) -> Column:
    """The same of a single base, without a search by pattern."""
    return F.substring(F.lit("NTGCAtgca"), F.instr(F.lit("ACGTacgt"), base) + 1, F.lit(1))


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def codon_at(cds: Column, number: Column) -> Column:
    """The 1-based codon, '' where the sequence has none."""
    fits = (number >= 1) & (number * 3 <= F.length(cds))
    return F.when(fits, F.substring(cds, (number * 3 - 2).cast("int"), F.lit(3))).otherwise(F.lit(""))


def mutate(codon: Column, offset: Column, base: Column) -> Column:
    """The codon with the base at a 0-based offset replaced."""
    return F.when((F.length(codon) == 3) & (offset >= 0) & (offset <= 2), F.concat(F.substring(codon, F.lit(1), offset.cast("int")), base, F.substring(codon, (offset + 2).cast("int"), F.lit(3)))).otherwise(codon)


#: Every codon with its amino acid behind it.
TABLE = "".join(f"{c}{a.lower()} " for c, a in CODE.items())


def translate(cds: Column) -> Column:
    """Amino acids of the whole codons. Of a sequence of known bases alone each codon is looked up in one text, where amino
    acids are in lower case, so that a codon is found at its own place only."""
    n = F.floor(F.length(cds) / 3).cast("int")
    each = lambda one: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: one(F.substring(cds, i * 3 - 2, F.lit(3)))), "")
    known = F.upper(each(lambda c: F.substring(F.lit(TABLE), F.instr(F.lit(TABLE), c) + 3, F.lit(1))))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit("")).when(~cds.rlike("[^TCAG]"), known).otherwise(each(amino_acid))


def peptide_md5(cds: Column) -> Column:
    """MD5 of the translation up to the first stop; '' for no peptide."""
    peptide = F.substring_index(translate(cds), "*", 1)
    return F.when(F.length(peptide) > 0, F.md5(peptide.cast("binary"))).otherwise(F.lit(""))


def codon_change(ref: Column, alt: Column, offset: Column) -> Column:
    """`ggt/Tgt`: lower case but for the mutated base of the alternate codon."""
    low = F.lower(alt)
    cut = F.concat(F.substring(low, F.lit(1), offset.cast("int")), F.upper(F.substring(alt, (offset + 1).cast("int"), F.lit(1))), F.substring(low, (offset + 2).cast("int"), F.lit(3)))
    return F.concat(F.lower(ref), F.lit("/"), cut)


def to_short(hgvsp: Column) -> Column:
    """Three-letter codes of a protein notation as one letter; X and Ter included."""
    names = F.array(*[F.struct(F.lit(three).alias("long"), F.lit(one).alias("short")) for one, three in THREE.items()])
    return F.aggregate(names, hgvsp, lambda out, x: F.replace(out, x["long"], x["short"]))
