"""Functions on alleles and chromosome names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def is_snv(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & (F.length(alt) == 1)


def is_indel(ref: Column, alt: Column) -> Column:
    return F.length(ref) != F.length(alt)


def is_insertion(ref: Column, alt: Column) -> Column:
    return F.length(alt) > F.length(ref)


def is_deletion(ref: Column, alt: Column) -> Column:
    return F.length(ref) > F.length(alt)


def chrom_of_vcf(c: Column) -> Column:
    """Without a leading chr, unless nothing would be left."""
    return F.when((F.length(c) > 3) & c.startswith("chr"), F.substring(c, 4, 1 << 30)).otherwise(c)


def chrom_of_gtf(c: Column) -> Column:
    return F.regexp_replace(c, "^chr", "")


def chrom_number(c: Column) -> Column:
    """1-22, X 23, Y 24, MT and M 25, else 0: the export's sort key."""
    bare = F.regexp_replace(c, "^chr", "")
    number = F.when(bare.rlike("^([1-9]|1[0-9]|2[0-2])$"), bare.cast("int"))
    return F.coalesce(F.when(bare == "X", 23), F.when(bare == "Y", 24), F.when(bare.isin("MT", "M"), 25), number, F.lit(0)).cast("int")


def refseq_chrom(c: Column) -> Column:
    """NC_0000NN.v as 1-22, X, Y; '' for other accessions."""
    n = F.regexp_extract(c, r"^NC_0*([0-9]+)\.", 1)
    return F.when(n == "23", "X").when(n == "24", "Y").when(n.rlike("^([1-9]|1[0-9]|2[0-2])$"), n).otherwise(F.lit(""))


def variant_id(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat(chrom, F.lit("_"), pos.cast("string"), F.lit("_"), ref, F.lit("/"), alt)


def lcp(a: Column, b: Column) -> Column:
    """Length of the common prefix. Most texts differ at once, or one begins with the other: only the rest is taken letter by
    letter."""
    n = F.least(F.length(a), F.length(b))
    at = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))), True)
    differ, whole = F.substring(a, 1, 1) != F.substring(b, 1, 1), F.startswith(a, b) | F.startswith(b, a)
    return F.when((n == 0) | differ, F.lit(0)).when(whole, n).when(at > 0, at.cast("int") - 1).otherwise(n)


def normalised(pos: Column, ref: Column, alt: Column) -> Column:
    """struct(pos, ref, alt): common prefix, then common suffix removed. An insertion after a trimmed prefix stays at
    the base before it."""

    def trimmed(x):
        cut = lambda y, s: F.substring(y, F.lit(1), F.length(y) - s)

        def out(s):
            r, a = cut(x["r"], s), cut(x["a"], s)
            back = F.when((x["q"] > 0) & (r == "") & (a != ""), 1).otherwise(0)
            return F.struct((pos + x["q"] - back).cast("bigint").alias("pos"), r.alias("ref"), a.alias("alt"))

        return let(lcp(F.reverse(x["r"]), F.reverse(x["a"])), out)

    rest = lambda q: F.struct(q.alias("q"), F.substring(ref, q + 1, F.length(ref)).alias("r"), F.substring(alt, q + 1, F.length(alt)).alias("a"))
    plain = (F.length(ref) == 1) & (F.length(alt) == 1) & (ref != alt)
    return F.when(plain, F.struct(pos.cast("bigint").alias("pos"), ref.alias("ref"), alt.alias("alt"))).otherwise(let(let(lcp(ref, alt), rest), trimmed))


def as_maf(pos: Column, ref: Column, alt: Column) -> Column:
    """struct(start, end, ref, alt) in MAF's convention."""
    q = lcp(ref, alt)
    r, a = F.substring(ref, q + 1, F.length(ref)), F.substring(alt, q + 1, F.length(alt))
    same = F.length(ref) == F.length(alt)
    r, a = F.when(same, ref).otherwise(r), F.when(same, alt).otherwise(a)
    at = F.when(same, pos).otherwise(pos + q)
    insertion = ~same & (r == "")
    start = F.when(insertion, at - 1).otherwise(at)
    end = F.when(insertion, at).otherwise(at + F.length(r) - 1)
    dash = lambda x: F.when(x == "", F.lit("-")).otherwise(x)
    return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), dash(r).alias("ref"), dash(a).alias("alt"))


def maf_type(ref: Column, alt: Column) -> Column:
    """SNP, DNP, TNP, ONP, INS or DEL of MAF alleles, in which '-' and '' are empty."""
    n, m = (F.when(x == "-", 0).otherwise(F.length(x)) for x in (ref, alt))
    return F.when(n < m, "INS").when(n > m, "DEL").when(n == 1, "SNP").when(n == 2, "DNP").when(n == 3, "TNP").otherwise("ONP")


def short_type(ref: Column, alt: Column) -> Column:
    """The type that the nested JSON carries: lengths decide first."""
    n, m = (F.when(x == "-", 0).otherwise(F.length(x)) for x in (ref, alt))
    return F.when((n == 1) & (m == 1), "SNP").when((n == m) & (n == 2), "DNP").when((n == m) & (n == 3), "TNP").when(n == m, "ONP").when(m > n, "INS").otherwise("DEL")


def compare_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """`chrom:pos ref>alt` without chr and dashes."""
    bare = lambda x: F.replace(x, F.lit("-"), F.lit(""))
    return F.concat(F.regexp_replace(chrom, "^chr", ""), F.lit(":"), pos.cast("string"), F.lit(" "), bare(ref), F.lit(">"), bare(alt))
