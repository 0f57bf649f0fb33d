"""Plans, sources and sinks end to end on small inputs, and the driver's entry."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from allelic import session
from allelic.operators import lookups, writers
from allelic.plans import overlap, pick, predict, reverse
from allelic.sources import tables, variants

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tx(spark):
    """A coding transcript on +, its mirror on -, and a non-coding one."""
    cds = "ATGGGCAAAGGGTTTTAA"

    def row(i, chrom, strand, coding=True):
        return (f"T{i}.1", f"G{i}", f"GENE{i}", chrom, 990, 1030, strand, "protein_coding" if coding else "miRNA", True, i != 3, False, 1000 if coding else 0, 1017 if coding else 0, "", "", [(1, 990, 1030, 1000 if coding else 0, 1017 if coding else 0, 0)], [(1000, 1017, 0)] if coding else [], [0], cds if coding else "", "CCCTAA" if coding else "")

    return spark.createDataFrame([row(1, "1", 1), row(2, "2", -1), row(3, "1", 1, False)], "transcript_id string, gene_id string, gene_name string, chrom string, start bigint, end bigint, strand int, biotype string, canonical boolean, msk_canonical boolean, mane_select boolean, cds_start bigint, cds_end bigint, protein_id string, entrez_id string, exons array<struct<number:int,start:bigint,end:bigint,cds_start:bigint,cds_end:bigint,frame:int>>, cds_regions array<struct<start:bigint,end:bigint,offset:bigint>>, exon_cum array<bigint>, cds_sequence string, utr3_sequence string")


def annotated(spark, tx, *rows, **options):
    v = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "record_id long, chrom string, pos long, ref string, alt string")
    return predict.annotate(v, tx, **options)


@pytest.mark.parametrize(
    ("variant", "gene", "consequence", "hgvsp", "hgvsc"),
    [
        (("chr1", 1003, "G", "T"), "GENE1", "missense_variant", "p.Gly2Cys", "c.4G>T"),
        (("1", 1005, "C", "T"), "GENE1", "synonymous_variant", "p.Gly2=", "c.6C>T"),
        (("1", 1015, "T", "C"), "GENE1", "stop_lost", "p.Ter6Glnext*2", "c.16T>C"),
        (("1", 1000, "A", "G"), "GENE1", "start_lost", "p.Met1?", "c.1A>G"),
        (("1", 1006, "A", "T"), "GENE1", "stop_gained", "p.Lys3Ter", "c.7A>T"),
        (("1", 995, "A", "T"), "GENE1", "5_prime_UTR_variant", "", "c.-5A>T"),
        (("1", 1020, "A", "T"), "GENE1", "3_prime_UTR_variant", "", "c.*3A>T"),
        (("1", 1005, "CAAA", "C"), "GENE1", "inframe_deletion", "p.Lys3del", "c.7_9del"),
        (("1", 1002, "G", "GG"), "GENE1", "frameshift_variant", None, "c.5dup"),
        (("1", 998, "GGATG", "G"), "GENE1", "start_lost", "p.Met1?", None),
        (("2", 1014, "C", "A"), "GENE2", "missense_variant", "p.Gly2Cys", "c.4G>T"),
        (("1", 1003, "G", "T"), "GENE3", "mature_miRNA_variant", "", "n.14G>T"),
        (("9", 5, "A", "T"), "", "intergenic_variant", "", ""),
    ],
)
def test_prediction(spark, tx, variant, gene, consequence, hgvsp, hgvsc):
    r = annotated(spark, tx, variant).where(F.col("gene_name") == gene).first()
    assert r["consequence"] == consequence or r["consequence"] == f"{consequence},splice_region_variant"
    assert hgvsp is None or r["hgvsp"] == hgvsp
    assert hgvsc is None or r["hgvsc"] == hgvsc


def test_interval_join_finds_long_transcripts(spark):
    t = spark.createDataFrame([("a", "1", 1, 500000), ("b", "1", 5, 6)], "transcript_id string, chrom string, start long, end long")
    v = spark.createDataFrame([(i, "1", p) for i, p in enumerate([1, 5, 6, 50, 262144, 500000, 500001])], "record_id long, chrom string, pos long")
    got = {(r["pos"], r["transcript_id"]) for r in overlap.interval_join(v, t, 1024).collect()}
    assert got == {(1, "a"), (5, "a"), (5, "b"), (6, "a"), (6, "b"), (50, "a"), (262144, "a"), (500000, "a"), (500001, None)}
    # the plan beyond the broadcast bound
    assert {(r["pos"], r["transcript_id"]) for r in overlap.interval_join(v, t, 1024, broadcast_bytes=1).collect()} == got
    wide = t.withColumn("exons", F.array("start"))
    assert {(r["pos"], r["transcript_id"], r["exons"] is None) for r in overlap.interval_join(v, wide, 1024, broadcast_bytes=200).collect()} == {(p, i, i is None) for p, i in got}
    assert overlap.interval_join(v, wide, 1024, how="inner", broadcast_bytes=1).count() == 8


def test_no_python_on_the_single_base_path(spark, tx):
    v = spark.createDataFrame([(1, "1", 1003, "G", "T")], "record_id long, chrom string, pos long, ref string, alt string")
    plan = predict.annotate_snvs(v, tx)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_canonical_only_and_pick(spark, tx):
    a = annotated(spark, tx, ("1", 1003, "G", "T"), canonical_only=True)
    assert [r["gene_name"] for r in a.collect()] == ["GENE1"]
    a = annotated(spark, tx, ("1", 1003, "G", "T"))
    assert pick.pick_best(a, ["record_id"]).first()["gene_name"] == "GENE1"
    assert pick.all_effects(a, ["record_id"]).first()["all_effects"].count(";") == 1


@pytest.mark.parametrize(
    ("spec", "want"),
    [("GENE1 G2C", {("1", 1003, "G", "T")}), ("GENE2 p.Gly2Cys", {("2", 1014, "C", "A")}), ("T1.9:c.4G>T", {("1", 1003, "G", "T")}), ("GENE1:c.7_9del", {("1", 1005, "CAAA", "C")}), ("1:g.1003_1004insTT", {("1", 1003, "G", "GTT")}), ("1:g.1003G>T", {("1", 1003, "G", "T")}), ("1:1003:G:T", {("1", 1003, "G", "T")})],
)
def test_reverse(spark, tx, spec, want):
    got = reverse.resolve(spark.createDataFrame([(1, spec)], "id long, input string"), tx).collect()
    assert {(r["chrom"], r["pos"], r["ref"], r["alt"]) for r in got} == want and not any(r["error"] for r in got)


@pytest.mark.parametrize(("spec", "error"), [("NOPE G2C", "not found"), ("GENE1 A2C", "mismatch"), ("GENE1:c.5_6insA", "unsupported"), ("GENE1:c.400del", "out of range"), ("what", "unknown"), ("1:g.5del", "no coding sequence")])
def test_reverse_errors(spark, tx, spec, error):
    assert error in reverse.resolve(spark.createDataFrame([(1, spec)], "id long, input string"), tx).first()["error"]


def test_reverse_then_predict(spark, tx):
    """Whatever a protein change maps to predicts that change."""
    inputs = spark.createDataFrame([(i, f"GENE{1 + i % 2} {s}") for i, s in enumerate(["G2C", "G2D", "K3E", "F5L", "G4V"] * 2)], "id long, input string")
    found = reverse.resolve(inputs, tx).where("error = ''").join(inputs, "id")
    back = predict.annotate(found.select("id", "input", "chrom", "pos", "ref", "alt"), tx).where("biotype = 'protein_coding'")
    rows = back.collect()
    assert rows and all(r["amino_acid_change"] == r["input"].split()[1] for r in rows)


VCF = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\n\nchr1\t1003\trs1\tG\tT,A\t50\tPASS\tDP=5;CSQ=old\tGT\t0/1\n9\t5\t.\tA\tT\t.\t.\t."


def test_vcf(spark, tx, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    assert variants.vcf_header(spark, str(tmp_path / "a.vcf"))[1] == ["S1"]
    v = variants.read_vcf(spark, str(tmp_path / "a.vcf"))
    assert [(r["pos"], r["alt"], r["qual"]) for r in v.orderBy("record_id", "ord").collect()] == [(1003, "T", 50.0), (1003, "A", 50.0), (5, "T", 0.0)]
    lines = [r["value"] for r in writers.vcf_lines(predict.annotate(v, tx)).orderBy("record_id").collect()]
    assert lines[0].startswith("chr1\t1003\trs1\tG\tT,A\t50\tPASS\tDP=5;CSQ=T|") or lines[0].startswith("1\t1003\trs1\tG\tT,A\t50\tPASS\tDP=5;CSQ=T|")
    assert lines[0].endswith("GT\t0/1") and lines[0].count("|missense_variant|") == 2 and "old" not in lines[0]
    (tmp_path / "b.vcf").write_text("chr1\t5\t.\tA\tT\t.\t.\t.\n")
    with pytest.raises(ValueError):
        variants.read_vcf(spark, str(tmp_path / "b.vcf"))


def test_maf(spark, tmp_path):
    (tmp_path / "a.maf").write_text("#v\nHugo_Symbol\tChromosome\tStart_Position\tReference_Allele\tTumor_Seq_Allele2\tX\nA\tchr1\t7\tG\t-\tx\nB\t2\t8\t-\tTT")
    rows, header = variants.read_maf(spark, str(tmp_path / "a.maf"))
    got = [(r["chrom"], r["pos"], r["ref"], r["alt"], r["maf_gene"], len(r["raw"])) for r in rows.orderBy("record_id").collect()]
    assert got == [("chr1", 7, "G", "", "A", 6), ("2", 8, "", "TT", "B", 5)] and header[-1] == "X"
    (tmp_path / "b.maf").write_text("Hugo_Symbol\n")
    with pytest.raises(ValueError):
        variants.read_maf(spark, str(tmp_path / "b.maf"))


def test_reference_tables(spark, tmp_path):
    read = lambda name, text: ((tmp_path / name).write_text(text), tables.read(spark, str(tmp_path / name)))[1]
    h = tables.hotspots(read("h", "hugo_symbol\tamino_acid_position\ttype\tq_value\ttranscript_id\nA\t12\t3d\t0.1\tT1.2\nA\t12\tsingle residue\t0.1\tT1\nA\tx\t3d\t0\tT1\n"))
    assert [tuple(r) for r in lookups.best_hotspots(h).select("transcript_id", "position", "type").collect()] == [("T1", 12, "single residue")]
    g = tables.gene_list(read("g", "Hugo Symbol\tGene Type\nA\tTSG\nA\tONCOGENE\n"))
    assert lookups.keep_last(g, ["gene_name"], "line").first()["gene_type"] == "ONCOGENE"
    row = ["A", "", "ENST1.3", *[""] * 8, "ENST2.1", *[""] * 15, "77"]
    c = tables.canonical_table(read("c", "head\n" + "\t".join(row) + "\n"))
    assert tuple(c.first()) == ("A", "ENST1", "ENST2", "77")
    s = tables.signal(read("s", "Chromosome\tStart_Position\tReference_Allele\tAlternate_Allele\tn_impact\tf_impact\n1\t5\tA\t-\t3\t0.5\n1\t6\tA\tT\t0\t0.5\n"))
    assert [(r["pos"], r["alt"], r["signal_status"]) for r in s.collect()] == [(5, "", "germline")]
    u = tables.uniprot(read("u", "enst_id\tid\nT1.2\tP1\nT1\tP2\n"))
    assert tuple(u.first()) == ("T1", "P2")
    p = tables.pfam(read("p1", "PF1\tName\tDesc\n"), read("p2", "g\tt\tn\tp\ts\te\nG\tT1\tN\tPF1\t3\t9\n"))
    assert p.first()["name"] == "Name"
    (tmp_path / "ptm.json").write_text('{"uniprot_entry":"E","position":5,"type":"P","ensembl_transcript_ids":["T1","T2"]}\nbroken\n')
    assert tables.ptm(spark, str(tmp_path / "ptm.json")).count() == 2


def test_json_model(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"ID":"T1","GeneName":"A","Chrom":"chr1","Start":1,"End":9,"Strand":-1,"CDSStart":2,"CDSEnd":8,"Exons":[{"Number":1,"Start":1,"End":9,"CDSStart":2,"CDSEnd":8,"Frame":0}],"CDSSequence":"ATGTAA"}]')
    r = tables.json_transcripts(spark, str(tmp_path / "t.json")).first()
    assert (r["chrom"], r["strand"], r["exons"][0]["cds_end"], r["utr3_sequence"]) == ("1", -1, 8, "")


def test_export_is_sorted_and_pruned(spark, tx, tmp_path):
    a = annotated(spark, tx, *[("1", 1000 + i % 18, "A", "T") for i in range(40)], ("9", 5, "A", "T"))
    path = str(tmp_path / "x.parquet")
    writers.write_parquet(a, path, 2)
    df = session.register(spark, path)
    plan = session.at_variant(df, "1", 1003, "A", "T")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(pos,1003)" in plan
    assert spark.sql("select count(*) from annotations").first()[0] == a.count()
    for part in df.select("chrom_numeric", "pos", F.input_file_name().alias("f")).collect():
        assert part["f"]
    keys = [(r["f"], r["chrom_numeric"], r["pos"]) for r in df.select("chrom_numeric", "pos", F.input_file_name().alias("f")).collect()]
    by_file = {}
    for f, *k in keys:
        by_file.setdefault(f, []).append(k)
    assert all(v == sorted(v) for v in by_file.values())


def test_configuration():
    assert session.assembly("HG19") == "GRCh37"
    assert session.Config(assembly="grch37", sources={"signal"}).uses_index() and not session.Config(assembly="GRCh38", sources={"signal"}).uses_index()
    with pytest.raises(ValueError):
        session.assembly("mm10")


def test_excluded_columns_are_checked():
    with pytest.raises(ValueError):
        writers.check_columns(["nope"], writers.CORE)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["gene_name", "consequence", "n"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def run_command(spark, *argv):
    from allelic import __main__ as command

    command.main(list(map(str, argv)))


def test_export_picks_for_each_allele(spark, tx, tmp_path):
    """Of a line with two alternate alleles, both have a row."""
    tx.write.parquet(f"{tmp_path}/model")
    (tmp_path / "a.vcf").write_text(VCF)
    run_command(spark, "export", tmp_path / "a.vcf", tmp_path / "out", "--model", tmp_path / "model", "--pick")
    assert sorted((r["pos"], r["alt"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(5, "T"), (1003, "A"), (1003, "T")]


def test_long_headers_and_equal_names(spark, tmp_path):
    head = ["##fileformat=VCFv4.2", *(f"##contig=<ID={i}>" for i in range(100_001))]
    column = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"
    (tmp_path / "a.vcf").write_text("\n".join([*head, column, "1\t5\t.\tA\tT\t.\t.\t."]))
    meta, _ = variants.vcf_header(spark, str(tmp_path / "a.vcf"))
    assert meta == head and variants.read_vcf(spark, str(tmp_path / "a.vcf")).count() == 1
    for folder in ("x y", "z"):  # files of one name in two folders keep apart
        (tmp_path / "two" / folder).mkdir(parents=True)
        (tmp_path / "two" / folder / "part.txt").write_text(f"{folder} 1\n{folder} 2\n")
    lines = variants.lines_of(spark, f"{tmp_path}/two/*").collect()
    assert [r["value"] for r in sorted(lines, key=lambda r: r["line"])] == ["x y 1", "x y 2", "z 1", "z 2"]


def test_long_genomic_spans(spark):
    """A deletion of more than a hundred thousand covered bases keeps them all."""
    n = 120_000
    bases = "ACGT" * (n // 4)
    row = ("T1.1", "1", 1, n, 1, 1, n, [(1, n, 0)], bases)
    t = spark.createDataFrame([row], "transcript_id string, chrom string, start bigint, end bigint, strand int, cds_start bigint, cds_end bigint, cds_regions array<struct<start:bigint,end:bigint,offset:bigint>>, cds_sequence string")
    specs = spark.createDataFrame([(1, "1:g.2_110000del")], "id long, input string").select("id", F.explode(F.array(reverse.parse_spec(F.col("input")))).alias("spec"))
    got = reverse.hgvsg_to_variants(specs, t).first()
    assert (got["pos"], got["ref"], got["alt"], got["error"]) == (1, bases[:110_000], "A", "")


def test_segments_agree_with_whole_transcripts(spark, monkeypatch):
    """Plain transcripts by segments, and the same ones as if they weren't plain."""
    from allelic import synth
    from allelic.functions import coords

    v = synth.variants(spark, SF).where("record_id % 7 = 0").select("record_id", "chrom", "pos", "ref", "alt")
    t = synth.transcripts(spark, SF).drop("k", "n")
    assert coords.with_plan(t).where("not _plain").count() == 0
    got = sorted(map(str, predict.annotate(v, t, width=1024).collect()))
    real = coords.with_plan
    monkeypatch.setattr(coords, "with_plan", lambda df: real(df).withColumn("_plain", F.lit(False)))
    assert got == sorted(map(str, predict.annotate(v, t, width=1024).collect()))


def test_odd_transcripts_are_not_plain(spark, tx):
    """Exons of two bases, short introns, gaps between coding parts, and exons that don't fill the transcript."""
    from allelic.functions import coords

    exon = lambda n, a, b, c=0, d=0: (n, a, b, c, d, 0)
    base = tx.where("gene_name = 'GENE1'").first().asDict(recursive=True)
    rows = []
    for i, (exons, regions, cum) in enumerate([
        ([exon(1, 990, 1004, 1000, 1004), exon(2, 1016, 1030, 1016, 1028)], [(1000, 1004, 0), (1016, 1028, 5)], [0, 15]),
        ([exon(1, 990, 1004, 1000, 1004), exon(2, 1010, 1030, 1010, 1022)], [(1000, 1004, 0), (1010, 1022, 5)], [0, 15]),
        ([exon(1, 990, 1010, 1000, 1010), exon(2, 1029, 1030)], [(1000, 1010, 0)], [0, 21]),
        ([exon(1, 995, 1030, 1000, 1017)], [(1000, 1017, 0)], [0]),
        ([exon(1, 990, 1030, 1000, 1017)], [(1000, 1005, 0), (1010, 1017, 6)], [0]),
    ]):
        rows.append((*(base[c] if c not in ("transcript_id", "exons", "cds_regions", "exon_cum", "cds_end") else {"transcript_id": f"T{i}", "exons": exons, "cds_regions": regions, "exon_cum": cum, "cds_end": regions[-1][1]}[c] for c in tx.columns),))
    t = spark.createDataFrame(rows, tx.schema)
    assert {r["transcript_id"] for r in coords.with_plan(t).where("_plain").collect()} == {"T0"}
    v = spark.createDataFrame([(p, "1", p, "A", "C") for p in range(988, 1033)], "record_id long, chrom string, pos long, ref string, alt string")
    a = predict.annotate(v, t)
    assert a.where("transcript_id = ''").count() == 4 and a.where("transcript_id <> ''").count() == 41 * 5
    near = {(r["transcript_id"], r["pos"]): r["consequence"] for r in a.collect()}
    assert near["T2", 1028] == "splice_acceptor_variant" and near["T1", 1007].startswith("splice_") and near["T3", 992].startswith("splice_region")
