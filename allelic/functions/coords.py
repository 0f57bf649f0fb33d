"""Coordinates within a transcript, on its nested exons and coding regions.

t(name) gives a transcript's column. Lookups use filters over the exon arrays; a position has at most one exon."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

T = Callable[[str], Column]


def col_of(name: str) -> Column:
    return F.col(name)


def is_coding(t: T = col_of) -> Column:
    return (t("cds_start") > 0) & (t("cds_end") > 0)


def first(a: Column) -> Column:
    return F.get(a, F.lit(0))


def exon_at(pos: Column, t: T = col_of) -> Column:
    """The exon that holds a position, or null."""
    return first(F.filter(t("exons"), lambda e: (e["start"] <= pos) & (pos <= e["end"])))


def cds_position(pos: Column, t: T = col_of) -> Column:
    """1-based position in the coding sequence, 0 outside of it."""
    r = first(F.filter(t("cds_regions"), lambda r: (r["start"] <= pos) & (pos <= r["end"])))
    inner = F.when(t("strand") == 1, pos - r["start"]).otherwise(r["end"] - pos)
    return F.when(is_coding(t), F.coalesce(r["offset"] + inner + 1, F.lit(0))).otherwise(F.lit(0)).cast("bigint")


def genomic_of_cds(cds: Column, t: T = col_of) -> Column:
    """Genomic position of a coding position, 0 out of range."""
    r = first(F.filter(t("cds_regions"), lambda r: (cds > r["offset"]) & (cds <= r["offset"] + r["end"] - r["start"] + 1)))
    inner = cds - r["offset"] - 1
    return F.when(is_coding(t) & (cds >= 1), F.coalesce(F.when(t("strand") == 1, r["start"] + inner).otherwise(r["end"] - inner), F.lit(0))).otherwise(F.lit(0)).cast("bigint")


def transcript_position(pos: Column, t: T = col_of) -> Column:
    """1-based position among exonic bases, 0 in introns."""
    at = first(F.filter(F.arrays_zip(t("exons").alias("e"), t("exon_cum").alias("c")), lambda x: (x["e"]["start"] <= pos) & (pos <= x["e"]["end"])))
    inner = F.when(t("strand") == 1, pos - at["e"]["start"]).otherwise(at["e"]["end"] - pos)
    return F.coalesce(at["c"] + inner + 1, F.lit(0)).cast("bigint")


def codon_number(cds: Column) -> Column:
    return F.when(cds < 1, F.lit(0)).otherwise(F.floor((cds - 1) / 3) + 1).cast("bigint")


def codon_offset(cds: Column) -> Column:
    return F.when(cds < 1, F.lit(0)).otherwise((cds - 1) % 3).cast("int")


def nearest_exon(pos: Column, t: T = col_of) -> Column:
    """struct(distance, place): the exon nearest to a position, the lower one on ties."""
    gap = lambda e: F.when(pos < e["start"], e["start"] - pos).when(pos > e["end"], pos - e["end"]).otherwise(F.lit(0))
    return F.array_min(F.transform(t("exons"), lambda e, i: F.struct(gap(e).alias("distance"), i.alias("place"))))


def splice_sites(t: T = col_of) -> Column:
    """array<struct(start, end, site)>: the two intron bases at each side of each exon, an exon's end before its start."""
    donor, acceptor = F.lit("splice_donor_variant"), F.lit("splice_acceptor_variant")
    plus = t("strand") == 1
    side = lambda lo, hi, site: F.struct(lo.cast("bigint").alias("start"), hi.cast("bigint").alias("end"), site.alias("site"))
    return F.flatten(F.transform(t("exons"), lambda e: F.array(side(e["end"] + 1, e["end"] + 2, F.when(plus, donor).otherwise(acceptor)), side(e["start"] - 2, e["start"] - 1, F.when(plus, acceptor).otherwise(donor)))))


def splice_site(pos: Column, t: T = col_of) -> Column:
    """The splice site term at an intron position, '' elsewhere: one pass over the exons, the first that is near."""
    after, before = lambda e: pos.between(e["end"] + 1, e["end"] + 2), lambda e: pos.between(e["start"] - 2, e["start"] - 1)
    hit = first(F.transform(F.filter(t("exons"), lambda e: after(e) | before(e)), lambda e: after(e) == (t("strand") == 1)))
    return F.when(hit, F.lit("splice_donor_variant")).when(~hit, F.lit("splice_acceptor_variant")).otherwise(F.lit(""))


def indel_splice_site(pos: Column, ref: Column, alt: Column, t: T = col_of) -> Column:
    """The first splice site that the reference bases of an indel touch; '' for other variants."""
    end = pos + F.length(ref) - 1
    hits = F.filter(splice_sites(t), lambda s: (s["start"] <= end) & (pos <= s["end"]))
    first_hit = F.array_min(F.transform(hits, lambda s, i: F.struct(F.greatest(s["start"], pos).alias("at"), i.alias("i"), s["site"].alias("site"))))
    return F.when((F.length(ref) > 1) & (F.length(ref) != F.length(alt)), F.coalesce(first_hit["site"], F.lit(""))).otherwise(F.lit(""))


def in_splice_region(pos: Column, t: T = col_of) -> Column:
    """Within 3 bases inside an exon's boundary or 3 to 8 outside of it."""

    def near(e):
        into, out = pos - e["start"], e["end"] - pos
        side = lambda d: d.between(0, 2) | d.between(-8, -3)
        return side(into) | side(out)

    return F.exists(t("exons"), near)


def splice_codon(pos: Column, t: T = col_of) -> Column:
    """Codon at the coding end of the exon boundary within two bases, 0 if none."""
    edges = F.flatten(F.transform(F.filter(t("exons"), lambda e: e["cds_start"] > 0), lambda e, i: F.array(F.struct(F.abs(pos - e["end"]).alias("d"), i.alias("i"), F.lit(0).alias("k"), e["cds_end"].alias("at")), F.struct(F.abs(pos - e["start"]).alias("d"), i.alias("i"), F.lit(1).alias("k"), e["cds_start"].alias("at")))))
    edge = F.array_min(F.filter(edges, lambda x: x["d"] <= 2))
    return F.coalesce(codon_number(cds_position(edge["at"], t)), F.lit(0))


def exonic_distance(a: Column, b: Column, t: T = col_of) -> Column:
    """Exonic bases between two positions, both ends counted, less one."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    n = F.aggregate(t("exons"), F.lit(0).cast("bigint"), lambda acc, e: acc + F.greatest(F.lit(0).cast("bigint"), F.least(hi, e["end"]) - F.greatest(lo, e["start"]) + 1))
    return F.greatest(n - 1, F.lit(0))


def _text(n: Column) -> Column:
    return n.cast("bigint").cast("string")


def exonic_notation(pos: Column, t: T = col_of) -> Column:
    """Notation of an exonic position: coding position, -n before the coding part, *n after it; plain numbers in
    transcripts without one."""
    cds = cds_position(pos, t)
    plus = t("strand") == 1
    before = F.when(plus, pos < t("cds_start")).otherwise(pos > t("cds_end"))
    after = F.when(plus, pos > t("cds_end")).otherwise(pos < t("cds_start"))
    five = F.concat(F.lit("-"), _text(exonic_distance(pos, F.when(plus, t("cds_start")).otherwise(t("cds_end")), t)))
    three = F.concat(F.lit("*"), _text(exonic_distance(pos, F.when(plus, t("cds_end")).otherwise(t("cds_start")), t)))
    coding = F.when(cds > 0, _text(cds)).when(before, five).when(after, three).otherwise(F.lit(""))
    plain = transcript_position(pos, t)
    return F.when(is_coding(t), coding).otherwise(F.when(plain > 0, _text(plain)).otherwise(F.lit("")))


def notation(pos: Column, t: T = col_of) -> Column:
    """HGVS position of any position: introns count from the nearer exon, the lower one on ties."""
    low = F.array_max(F.transform(F.filter(t("exons"), lambda e: e["end"] < pos), lambda e: e["end"]))
    high = F.array_min(F.transform(F.filter(t("exons"), lambda e: e["start"] > pos), lambda e: e["start"]))
    use_low = low.isNotNull() & (high.isNull() | (high - pos >= pos - low))
    edge, gap = F.when(use_low, low).otherwise(high), F.when(use_low, pos - low).otherwise(high - pos)
    sign = F.when(use_low == (t("strand") == 1), F.lit("+")).otherwise(F.lit("-"))
    intron = F.when(edge.isNull(), F.lit("")).otherwise(F.concat(exonic_notation(edge, t), sign, _text(gap)))
    return F.when(exon_at(pos, t).isNotNull(), exonic_notation(pos, t)).otherwise(intron)


def utr_parts(t: T = col_of) -> Column:
    """array<struct(type, start, end)>: each exon's parts before and after the coding part, named by strand."""
    plus = t("strand") == 1
    left, right = F.when(plus, "five_prime_UTR").otherwise("three_prime_UTR"), F.when(plus, "three_prime_UTR").otherwise("five_prime_UTR")
    part = lambda kind, lo, hi: F.struct(kind.alias("type"), lo.alias("start"), hi.alias("end"))
    both = F.flatten(F.transform(t("exons"), lambda e: F.array(part(left, e["start"], F.least(e["end"], t("cds_start") - 1)), part(right, F.greatest(e["start"], t("cds_end") + 1), e["end"]))))
    return F.when(is_coding(t), F.filter(both, lambda p: p["start"] <= p["end"])).otherwise(F.filter(both, lambda p: F.lit(False)))


# ---- positions by the two exons beside them -------------------------------------------------------------------------
#
# Most transcripts are plain: exons by position that fill the transcript from end to end, none shorter than 3 bases, introns of
# 9 or more, and coding parts that follow each other without a gap. There, everything about a position follows from the exon
# that begins last before it and the next one: a segment holds both as plain columns, so that no expression goes over
# arrays. The functions above are for the others.


def with_plan(transcripts: DataFrame) -> DataFrame:
    """transcripts with _plain, and the positions among exonic bases of the first and the last coding base (0 if there is
    none). Once for each transcript."""
    e = F.col("exons")
    gap = lambda x, i: F.when(i == 0, F.lit(True)).otherwise(x["start"] - F.get(e, F.greatest(i - 1, F.lit(0)))["end"] > 9)
    apart = F.forall(F.transform(e, lambda x, i: gap(x, i) & (x["end"] - x["start"] >= 2)), lambda ok: ok)
    filled = (F.get(e, F.lit(0))["start"] == F.col("start")) & (F.get(e, F.size(e) - 1)["end"] == F.col("end"))
    plus = F.col("strand") == 1
    t5 = transcript_position(F.when(plus, F.col("cds_start")).otherwise(F.col("cds_end")))
    t3 = transcript_position(F.when(plus, F.col("cds_end")).otherwise(F.col("cds_start")))
    t = transcripts.withColumns({"_t5": F.when(is_coding(), t5).otherwise(F.lit(0)), "_t3": F.when(is_coding(), t3).otherwise(F.lit(0))})
    length = F.aggregate("cds_regions", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"] + 1)
    whole = ~is_coding() | ((F.col("_t5") > 0) & (F.col("_t3") > 0) & (length == F.col("_t3") - F.col("_t5") + 1))
    return t.withColumn("_plain", F.coalesce((F.size(e) > 0) & filled & apart & whole & (F.size(e) == F.size("exon_cum")), F.lit(False)))


def segments(plain: DataFrame) -> DataFrame:
    """A row for each exon of plain transcripts with the intron behind it (start and end are the segment's): _lo, the exon, _at,
    its place, _hi, the next one, and the codons of its own coding bases as _slice, from the codon after _codon0 on."""
    seg = plain.select(*(c for c in plain.columns if c not in ("exons", "exon_cum", "cds_regions", "start", "end")), F.col("end").alias("_end"), F.posexplode("exons").alias("_at", "_lo"), "exons", "exon_cum")
    seg = seg.withColumns({"_hi": F.get("exons", F.col("_at") + 1), "_cum_lo": F.get("exon_cum", F.col("_at")), "_cum_hi": F.get("exon_cum", F.col("_at") + 1), "_exons": F.size("exons")}).drop("exons", "exon_cum")
    one, two = (_among(F.col(f"_lo.{c}"), F.col("_lo"), F.col("_cum_lo")) - F.col("_t5") + 1 for c in ("cds_start", "cds_end"))
    seg = seg.withColumns({"start": F.col("_lo.start"), "end": F.coalesce(F.col("_hi.start") - 1, F.col("_end")), "_a": F.when((F.col("_t5") > 0) & (F.col("_lo.cds_start") > 0), F.least(one, two)), "_b": F.greatest(one, two)}).drop("_end")
    before = F.floor((F.col("_a") - 1) / 3)
    codons = F.floor((F.col("_b") - 1) / 3) - before + 1
    slice_ = F.substring("cds_sequence", (3 * before + 1).cast("int"), (3 * codons).cast("int"))
    return seg.withColumns({"_slice": F.coalesce(slice_, F.lit("")), "_codon0": F.coalesce(before, F.lit(0)).cast("bigint")}).drop("_a", "_b", "cds_sequence", "utr3_sequence")


def _among(pos: Column, e: Column, cum: Column) -> Column:
    """Position among exonic bases of one that the exon holds."""
    return cum + F.when(F.col("strand") == 1, pos - e["start"]).otherwise(e["end"] - pos) + 1


def plain_cds_position(pos: Column) -> Column:
    at = _among(pos, F.col("_lo"), F.col("_cum_lo"))
    inside = F.col("_inside") & (F.col("_t5") > 0) & pos.between(F.col("cds_start"), F.col("cds_end"))
    return F.when(inside, at - F.col("_t5") + 1).otherwise(F.lit(0)).cast("bigint")


def plain_in_splice_region(pos: Column) -> Column:
    near = lambda d: F.coalesce(d.between(0, 2) | d.between(-8, -3), F.lit(False))
    return near(pos - F.col("_lo.start")) | near(F.col("_lo.end") - pos) | near(pos - F.col("_hi.start"))


def plain_splice_site(pos: Column) -> Column:
    """The splice site term at an intron position, '' elsewhere."""
    after = F.coalesce((pos - F.col("_lo.end")).between(1, 2), F.lit(False))
    before = F.coalesce((F.col("_hi.start") - pos).between(1, 2), F.lit(False))
    donor = after == (F.col("strand") == 1)
    return F.when(~(after | before), F.lit("")).when(donor, F.lit("splice_donor_variant")).otherwise(F.lit("splice_acceptor_variant"))


def plain_nearest(pos: Column) -> Column:
    """Place of the exon nearest to a position, the lower one on ties."""
    lo, hi = F.col("_lo.end"), F.col("_hi.start")
    return F.when(F.col("_inside") | hi.isNull() | (hi - pos >= pos - lo), F.col("_at")).otherwise(F.col("_at") + 1)


def plain_indel_splice_site(pos: Column, ref: Column, alt: Column) -> Column:
    """The first splice site that the reference bases of an indel touch; '' for other variants. Bases that begin in a segment
    and go beyond it touch the site before the next exon first."""
    end, lo, hi = pos + F.length(ref) - 1, F.col("_lo.end"), F.col("_hi.start")
    donor, acceptor = F.lit("splice_donor_variant"), F.lit("splice_acceptor_variant")
    plus = F.col("strand") == 1
    after, before = (pos <= lo + 2) & (end > lo), F.coalesce(end >= hi - 2, F.lit(False))
    site = F.when(after, F.when(plus, donor).otherwise(acceptor)).when(before, F.when(plus, acceptor).otherwise(donor)).otherwise(F.lit(""))
    return F.when((F.length(ref) > 1) & (F.length(ref) != F.length(alt)), site).otherwise(F.lit(""))


def plain_splice_codon(pos: Column) -> Column:
    """Codon at the coding end of the exon boundary within two bases, 0 if none."""
    lo = F.coalesce((pos - F.col("_lo.end") <= 2) & (F.col("_lo.cds_start") > 0), F.lit(False))
    hi = F.coalesce((F.col("_hi.start") - pos <= 2) & (F.col("_hi.cds_start") > 0), F.lit(False))
    at = F.when(lo, _among(F.col("_lo.cds_end"), F.col("_lo"), F.col("_cum_lo"))).when(hi, _among(F.col("_hi.cds_start"), F.col("_hi"), F.col("_cum_hi")))
    return F.coalesce(codon_number(at - F.col("_t5") + 1), F.lit(0))


def plain_notation(pos: Column) -> Column:
    """HGVS position: introns count from the nearer exon, the lower one on ties."""
    lo, hi = F.col("_lo.end"), F.col("_hi.start")
    use_low = F.col("_inside") | (lo.isNotNull() & (hi.isNull() | (hi - pos >= pos - lo)))
    edge = F.when(F.col("_inside"), pos).when(use_low, lo).otherwise(hi)
    at = F.when(use_low, _among(edge, F.col("_lo"), F.col("_cum_lo"))).otherwise(_among(edge, F.col("_hi"), F.col("_cum_hi")))
    exonic = F.when(F.col("_t5") == 0, _text(at)).when(at < F.col("_t5"), F.concat(F.lit("-"), _text(F.col("_t5") - at))).when(at > F.col("_t3"), F.concat(F.lit("*"), _text(at - F.col("_t3")))).otherwise(_text(at - F.col("_t5") + 1))
    sign = F.when(use_low == (F.col("strand") == 1), F.lit("+")).otherwise(F.lit("-"))
    return F.when(F.col("_inside"), exonic).when(edge.isNull(), F.lit("")).otherwise(F.concat(exonic, sign, _text(F.abs(edge - pos))))


# The same of segments whose exons are spread to plain numbers before the join, so that a joined row is small and its places are
# comparisons with numbers.

FLAT = ["_ls", "_le", "_hs", "_hi_end", "_number_lo", "_ca", "_cb", "_c0", "_k_lo", "_k_hi", "_cum_lo", "_cum_hi", "_t5", "_t3"]


def flat(seg: DataFrame) -> DataFrame:
    """Of each segment: bounds of its exon (_ls, _le) and the start of the next (_hs), the coding bases in it (_ca to _cb, null
    without any), what a coding position adds to the strand's position (_c0), and the codons at the exons' edges (null where
    they aren't coding)."""
    lo, hi, plus, numbered = F.col("_lo"), F.col("_hi"), F.col("strand") == 1, F.col("_lo.number").isNotNull()
    coding = (F.col("_t5") > 0) & numbered
    edge = lambda e, at, cum: F.when(e["cds_start"] > 0, F.coalesce(codon_number(_among(at, e, F.col(cum)) - F.col("_t5") + 1), F.lit(0).cast("bigint")))
    return seg.withColumns({
        "_coding": is_coding(), "_plus": plus, "_ls": lo["start"], "_le": lo["end"], "_hs": hi["start"], "_hi_end": hi["end"], "_number_lo": lo["number"],
        "_ca": F.when(coding, F.greatest(lo["start"], F.col("cds_start"))), "_cb": F.when(coding, F.least(lo["end"], F.col("cds_end"))),
        "_c0": F.col("_cum_lo") + F.when(plus, -lo["start"]).otherwise(lo["end"]) - F.col("_t5") + 2, "_k_lo": edge(lo, lo["cds_end"], "_cum_lo"), "_k_hi": edge(hi, hi["cds_start"], "_cum_hi"),
    }).drop("_lo", "_hi", "_at")


def flat_exon(pos: Column) -> Column:
    return F.when(pos <= F.col("_le"), F.col("_number_lo"))


def flat_cds_position(pos: Column) -> Column:
    return F.when(pos.between(F.col("_ca"), F.col("_cb")), F.col("_c0") + F.when(F.col("_plus"), pos).otherwise(-pos)).otherwise(F.lit(0)).cast("bigint")


def flat_in_splice_region(pos: Column) -> Column:
    near = lambda d: F.coalesce(d.between(0, 2) | d.between(-8, -3), F.lit(False))
    return near(pos - F.col("_ls")) | near(F.col("_le") - pos) | near(pos - F.col("_hs"))


def flat_splice_site(pos: Column) -> Column:
    """The splice site term at a position that isn't in a numbered exon, '' elsewhere."""
    after = F.coalesce((pos - F.col("_le")).between(1, 2), F.lit(False))
    before = F.coalesce((F.col("_hs") - pos).between(1, 2), F.lit(False))
    return F.when(~(after | before), F.lit("")).when(after == F.col("_plus"), F.lit("splice_donor_variant")).otherwise(F.lit("splice_acceptor_variant"))


def flat_splice_codon(pos: Column) -> Column:
    lo = F.col("_k_lo").isNotNull() & (pos - F.col("_le") <= 2)
    hi = F.col("_k_hi").isNotNull() & (F.col("_hs") - pos <= 2)
    return F.when(lo, F.col("_k_lo")).when(hi, F.col("_k_hi")).otherwise(F.lit(0))


def flat_notation(pos: Column) -> Column:
    lo, hi, plus, t5, t3 = F.col("_le"), F.col("_hs"), F.col("_plus"), F.col("_t5"), F.col("_t3")
    inside = pos <= lo
    use_low = inside | (lo.isNotNull() & (hi.isNull() | (hi - pos >= pos - lo)))
    edge = F.when(inside, pos).when(use_low, lo).otherwise(hi)
    among = lambda start, end, cum: cum + F.when(plus, edge - start).otherwise(end - edge) + 1
    at = F.when(use_low, among(F.col("_ls"), lo, F.col("_cum_lo"))).otherwise(among(hi, F.col("_hi_end"), F.col("_cum_hi")))
    exonic = F.when(t5 == 0, _text(at)).when(at < t5, F.concat(F.lit("-"), _text(t5 - at))).when(at > t3, F.concat(F.lit("*"), _text(at - t3))).otherwise(_text(at - t5 + 1))
    sign = F.when(use_low == plus, F.lit("+")).otherwise(F.lit("-"))
    return F.when(inside, exonic).when(edge.isNull(), F.lit("")).otherwise(F.concat(exonic, sign, _text(F.abs(edge - pos))))
