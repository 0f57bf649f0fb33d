"""Functions on columns against small vectors."""

import pytest
from pyspark.sql import functions as F

from allelic.functions import alleles, codon, coords, notation, terms, text
from allelic.plans import compare, model


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


L = F.lit


@pytest.mark.parametrize(
    ("pos", "ref", "alt", "want"),
    [(99, "GAT", "G", (100, "AT", "")), (66926, "AG", "A", (66927, "G", "")), (100, "A", "ACG", (100, "", "CG")), (99, "GATC", "GC", (100, "AT", "")), (99, "GT", "GCGT", (99, "", "CG")), (99, "GA", "TCC", (99, "GA", "TCC")), (99, "GCAT", "GTA", (100, "CAT", "TA")), (100, "A", "A", (101, "", ""))],
)
def test_normalised(spark, pos, ref, alt, want):
    assert tuple(one(spark, alleles.normalised(L(pos), L(ref), L(alt)))) == want


@pytest.mark.parametrize(
    ("pos", "ref", "alt", "want", "kind"),
    [(100, "C", "A", (100, 100, "C", "A"), "SNP"), (100, "CG", "AT", (100, 101, "CG", "AT"), "DNP"), (100, "ACG", "A", (101, 102, "CG", "-"), "DEL"), (100, "A", "ATG", (100, 101, "-", "TG"), "INS"), (100, "ACG", "AT", (101, 102, "CG", "T"), "DEL")],
)
def test_maf_alleles(spark, pos, ref, alt, want, kind):
    m = one(spark, alleles.as_maf(L(pos), L(ref), L(alt)))
    assert tuple(m) == want
    assert one(spark, alleles.maf_type(L(m["ref"]), L(m["alt"]))) == kind


def test_codons(spark):
    for c, a in {"ATG": "M", "TAA": "*", "TGG": "W", "atg": "X", "AT": "X", "ANG": "X"}.items():
        assert one(spark, codon.amino_acid(L(c))) == a
    assert one(spark, codon.reverse_complement(L("ACGTacgtN-"))) == "NNacgtACGT"
    assert one(spark, codon.translate(L("ATGGCTTA"))) == "MA"
    assert one(spark, codon.translate(L("AT"))) == ""
    assert one(spark, codon.codon_change(L("GGT"), L("TGT"), L(0))) == "ggt/Tgt"
    assert one(spark, codon.to_short(L("p.Gly12_Ala13insLeuTer"))) == "p.G12_A13insL*"
    assert one(spark, codon.three_letters(L("AL*"))) == "AlaLeuTer"


@pytest.mark.parametrize(
    ("spec", "kind", "fields"),
    [("12:25245350:C:A", "genomic", {"chrom": "12", "pos": 25245350, "ref": "C", "alt": "A"}), ("chr12:25245350:C>A", "genomic", {"alt": "A"}), ("12-25245350-C-A", "genomic", {"pos": 25245350}), ("KRAS G12C", "protein", {"gene": "KRAS", "ref_aa": "G", "number": 12, "alt_aa": "C"}), ("KRAS p.Gly12Cys", "protein", {"ref_aa": "G", "alt_aa": "C"}), ("KRAS c.35G>T", "hgvsc", {"gene": "KRAS", "notation": "c.35G>T"}), ("ENST0001.2:c.35G>T", "hgvsc", {"gene": "ENST0001.2"}), ("5:g.100_101del", "hgvsg", {"chrom": "5", "notation": "100_101del"}), ("", "unknown", {}), ("12:", "unknown", {}), ("KRAS", "unknown", {}), ("12:abc:C:A", "unknown", {})],
)
def test_specs(spark, spec, kind, fields):
    got = one(spark, notation.parse_spec(L(spec)))
    assert got["kind"] == kind and all(got[k] == v for k, v in fields.items())


def test_numbers(spark):
    for x, want in {0.0: "0", 0.1: "0.1", 0.00012345678: "0.000123457", 1e-5: "1e-05", 123456.7: "123457", 2.5e6: "2.5e+06"}.items():
        assert one(spark, text.significant(L(x))) == want
    for x, want in {0.0: "0", 0.0001: "1.000e-04", 0.05: "0.05", 1.0: "1"}.items():
        assert one(spark, text.q_value(L(x))) == want
    for x in (0.0375, 0.0005, 0.1235, -0.9995, 0.9995, 2.0005, 0.0, 123.4565):
        assert one(spark, text.fixed(L(x), 3)) == "%.3f" % x


def test_info(spark):
    info = L("XAF=9;AF=0.5,0.1;DB;AF2=1")
    assert one(spark, text.info_value(info, "AF")) == "0.5,0.1"
    assert one(spark, text.info_map(info)) == {"XAF": "9", "AF": "0.5,0.1", "DB": "true", "AF2": "1"}
    assert one(spark, text.without_key(L("CSQ=a"), "CSQ")) == "."


def test_terms(spark):
    assert one(spark, terms.impact(L("intron_variant,stop_gained"))) == "HIGH"
    assert one(spark, terms.maf_class(L("frameshift_variant,stop_lost"), L("CG"), L("-"))) == "Frame_Shift_Del"
    assert one(spark, terms.maf_class(L("odd_variant"), L("C"), L("G"))) == "odd_variant"
    assert one(spark, terms.normalised(L("Missense_Mutation,splice_region_variant"))) == "missense_variant"
    assert one(spark, terms.normalised(L("in_frame_del"))) == "inframe_deletion"


@pytest.mark.parametrize(
    ("left", "right", "want"),
    [("missense_variant", "Missense_Mutation", "match"), ("5'Flank", "5_prime_UTR_variant", "upstream_reclassified"), ("missense_variant", "intergenic_variant", "gene_model_change"), ("missense_variant", "intron_variant", "transcript_model_change"), ("missense_variant", "coding_sequence_variant", "no_cds_data"), ("intron_variant", "3_prime_UTR_variant", "upstream_reclassified"), ("frameshift_variant", "stop_gained", "match"), ("stop_lost", "stop_retained_variant", "match"), ("missense_variant", "synonymous_variant", "mismatch")],
)
def test_consequence_categories(spark, left, right, want):
    assert one(spark, compare.consequence_category(L(left), L(right))) == want


@pytest.mark.parametrize(
    ("left", "right", "want"),
    [("", "", "both_empty"), ("ENST1:c.1A>G", "c.1A>G", "match"), ("c.1A>G", "", "vep_empty"), ("", "c.1A>G", "maf_empty"), ("n.5A>G", "c.5A>G", "transcript_model_change"), ("c.5A>G", "c.8A>G", "position_shift"), ("c.5dup", "c.5_6insA", "dup_vs_ins"), ("c.5_6delinsA", "c.5del", "delins_normalized"), ("c.100_101insTA", "c.101_102insAT", "position_shift"), ("c.1_2insAA", "c.1_2insGG", "mismatch")],
)
def test_hgvsc_categories(spark, left, right, want):
    assert one(spark, compare.hgvsc_category(L(left), L(right))) == want


@pytest.mark.parametrize(
    ("left", "right", "conseq", "want"),
    [("p.G12C", "p.G12C", "", "match"), ("p.K5fs*3", "p.L6fs", "", "fuzzy_fs"), ("p.K5fs", "p.K5*", "", "fuzzy_fs"), ("p.X5_splice", "p.K5=", "", "splice_vs_syn"), ("p.*5*", "", "", "maf_nonstandard"), ("p.G1C", "", "splice_donor_variant", "splice_no_protein"), ("p.G12C", "p.G13C", "", "position_shift"), ("p.X5_splice", "p.K5L", "", "splice_vs_predicted"), ("p.G12C", "p.G12D", "", "mismatch")],
)
def test_hgvsp_categories(spark, left, right, conseq, want):
    assert one(spark, compare.hgvsp_category(L(left), L(right), L(conseq), L(""), L(""))) == want


def transcript(spark, strand):
    exons = [(1, 1010, 1050, 1010, 1050, 0), (2, 1100, 1180, 1100, 1180, 0)] if strand == 1 else [(2, 1010, 1050, 1010, 1050, 0), (1, 1100, 1180, 1100, 1180, 0)]
    df = spark.createDataFrame([("T", strand, 1010, 1180, exons)], "transcript_id string, strand int, cds_start bigint, cds_end bigint, exons array<struct<number:int,start:bigint,end:bigint,cds_start:bigint,cds_end:bigint,frame:int>>")
    return model.with_offsets(df)


@pytest.mark.parametrize(("strand", "pairs"), [(1, {1: 1010, 41: 1050, 42: 1100, 122: 1180, 0: 0, -1: 0, 123: 0}), (-1, {1: 1180, 81: 1100, 82: 1050, 122: 1010})])
def test_positions(spark, strand, pairs):
    t = transcript(spark, strand)
    for cds, genomic in pairs.items():
        assert t.select(coords.genomic_of_cds(L(cds))).first()[0] == genomic
        if genomic:
            assert t.select(coords.cds_position(L(genomic))).first()[0] == cds
    assert t.select(coords.notation(L(1053))).first()[0] == ("41+3" if strand == 1 else "82-3")
    assert t.select(coords.splice_site(L(1051))).first()[0] == ("splice_donor_variant" if strand == 1 else "splice_acceptor_variant")
