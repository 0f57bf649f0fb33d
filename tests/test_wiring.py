"""Commands, configuration and sources together, on small files."""

import pytest
from pyspark.sql import functions as F

from allelic import __main__ as command
from allelic import session
from allelic.operators import lookups, writers
from allelic.plans import compare, pick
from allelic.sources import tables, variants
from tests.test_engine import VCF, annotated, tx  # noqa: F401


def run(*argv):
    command.main(list(map(str, argv)))


def lines(spark, path):
    return [r["value"] for r in spark.read.text(f"{path}").collect()]


def test_configuration(tmp_path, monkeypatch):
    (tmp_path / "c").write_text("assembly = hg19  # a comment\nclinvar=off\nsignal = yes\nexclude = hgvsc,hgvsp\n")
    c = session.Config.load(str(tmp_path / "c"), {"ALLELIC_GNOMAD": "1", "OTHER": "x"})
    assert c.assembly == "GRCh37" and "clinvar" not in c.sources and {"signal", "gnomad", "hotspots"} <= c.sources and c.exclude == ["hgvsc", "hgvsp"] and c.uses_index()
    assert session.Config.load() == session.Config()
    assert not session.Config.from_options({"alphamissense": "no", "clinvar": "no", "signal": "on"}).uses_index()


def test_annotate_joins_the_sources(spark, tx, tmp_path):  # noqa: F811
    tx.write.parquet(f"{tmp_path}/model")
    (tmp_path / "a.maf").write_text("Hugo_Symbol\tChromosome\tStart_Position\tReference_Allele\tTumor_Seq_Allele2\nGENE1\tchr1\t1003\tG\tT\nGENE9\t9\t5\tA\tT")
    (tmp_path / "clinvar.vcf").write_text("1\t1003\t7\tG\tT\t.\t.\tCLNSIG=Pathogenic;CLNREVSTAT=r;CLNDN=d")
    (tmp_path / "am.tsv").write_text("#\n#\n#\n#CHROM\nchr1\t1003\tG\tT\thg38\tu\tt\tp\t0.91\tlikely_pathogenic\n")
    (tmp_path / "hot.tsv").write_text("hugo_symbol\ttranscript_id\tamino_acid_position\ttype\tq_value\nGENE1\tT1\t2\tsingle residue\t0.01\n")
    (tmp_path / "genes.tsv").write_text("Hugo Symbol\tGene Type\nGENE1\tTSG\n")
    run("index", tmp_path / "index", "--clinvar", tmp_path / "clinvar.vcf", "--alphamissense", tmp_path / "am.tsv")
    run("annotate", "maf", tmp_path / "a.maf", tmp_path / "out", "--model", tmp_path / "model", "--index", tmp_path / "index", "--hotspots", tmp_path / "hot.tsv", "--genes", tmp_path / "genes.tsv")
    head, *rows = (x.split("\t") for x in lines(spark, tmp_path / "out"))
    at = {c: rows[0][i] for i, c in enumerate(head)}
    assert at["allelic.consequence"].startswith("missense_variant") and at["allelic.clinvar_significance"] == "Pathogenic" and at["allelic.am_class"] == "likely_pathogenic"
    assert (at["allelic.hotspot"], at["allelic.gene_type"]) == ("Y", "TSG")
    assert len(rows) == 2 and rows[1][head.index("allelic.clinvar_significance")] == ""
    (tmp_path / "config").write_text("clinvar = off\ngenes = off\n")
    run("annotate", "maf", tmp_path / "a.maf", tmp_path / "less", "--model", tmp_path / "model", "--index", tmp_path / "index", "--genes", tmp_path / "genes.tsv", "--config", tmp_path / "config")
    assert not any(c.endswith(("clinvar_significance", "gene_type")) for c in lines(spark, tmp_path / "less")[0].split("\t"))
    with pytest.raises(SystemExit):
        run("index", tmp_path / "none")


GTF = '1\tx\ttranscript\t100\t200\t.\t+\t.\tgene_id "G1"; transcript_id "T1.1"; gene_name "A"; transcript_type "protein_coding"; tag "Ensembl_canonical";\n1\tx\texon\t100\t200\t.\t+\t.\tgene_id "G1"; transcript_id "T1.1"; gene_name "A"; transcript_type "protein_coding";\n'


def test_prepare_leaves_an_unchanged_model(spark, tmp_path):
    (tmp_path / "a.gtf").write_text(GTF)
    run("prepare", tmp_path / "a.gtf", tmp_path / "model")
    files = sorted(p.name for p in (tmp_path / "model").glob("*.parquet"))
    run("prepare", tmp_path / "a.gtf", tmp_path / "model")
    assert files and sorted(p.name for p in (tmp_path / "model").glob("*.parquet")) == files
    (tmp_path / "a.gtf").write_text(GTF + GTF.replace("T1.1", "T2.1"))
    run("prepare", tmp_path / "a.gtf", tmp_path / "model")
    assert spark.read.parquet(f"{tmp_path}/model").count() == 2


def test_compare_and_cache_commands(spark, tx, tmp_path, capsys):  # noqa: F811
    (tmp_path / "a.vcf").write_text(VCF.replace("##fileformat", '##INFO=<ID=DP,Number=1,Type=Integer>\n##fileformat'))
    (tmp_path / "b.vcf").write_text(VCF.replace("##fileformat", '##INFO=<ID=DP,Number=1,Type=Integer>\n##fileformat').replace("DP=5", "DP=6").replace("PASS", "q10"))
    run("compare", tmp_path / "a.vcf", tmp_path / "b.vcf", tmp_path / "diff", "--simple")
    got = lines(spark, tmp_path / "diff")
    assert any("1:1003 G>T,A" in x for x in got) and sum("mismatch" in x for x in got) == 1
    rows, columns = variants.vcf_for_compare(spark, str(tmp_path / "a.vcf"))
    assert columns == ["QUAL", "FILTER", "DP"] and [tuple(r)[2:] for r in rows.orderBy("record_id").collect()] == [("50", "PASS", "5"), (".", ".", "")]
    tx.write.parquet(f"{tmp_path}/model")
    run("cache", tmp_path / "cache", "--input", tmp_path / "a.vcf", "--model", tmp_path / "model")
    run("cache", tmp_path / "cache", "--input", tmp_path / "a.vcf", "--model", tmp_path / "model", "--export", tmp_path / "export")
    assert spark.read.parquet(f"{tmp_path}/export").count() == 5
    run("clean", tmp_path / "cache")
    assert writers.read_cache(spark, f"{tmp_path}/cache") is None
    with pytest.raises(ValueError):
        run("cache", tmp_path / "cache", "--export", tmp_path / "export")
    run("version")
    run("config")
    assert "GRCh38" in capsys.readouterr().out


def test_prediction_dumps(spark, tmp_path):
    """Every byte, escaped as a dump does, and lines that aren't kept."""
    body = bytes(range(256)) * 2
    escape = lambda b: b.replace(b"\\", b"\\\\").replace(b"\0", b"\\0").replace(b"\n", b"\\n").replace(b"\t", b"\\t").replace(b"\r", b"\\r")
    (tmp_path / "md5").write_text("7\taa\nx\tbb\n8\tcc\n")
    rows = [b"7\t267\t" + escape(body), b"7\t267\tlater", b"7\t268\tnot kept", b"8\t269\t" + escape(body[::-1]), b"9\t267\tno digest", b"broken"]
    (tmp_path / "dump").write_bytes(b"\n".join(rows) + b"\n")
    got = tables.prediction_dump(spark, str(tmp_path / "dump"), tables.translation_md5(tables.read(spark, str(tmp_path / "md5"))))
    assert {(r["md5"], r["analysis"]): bytes(r["matrix"]) for r in got.collect()} == {("aa", "sift"): body, ("cc", "polyphen"): body[::-1]}
    assert lookups.explode_matrix(got).count() > 0


def test_reports_of_responses(spark, tx):  # noqa: F811
    a = annotated(spark, tx, ("1", 1003, "G", "T")).withColumns({c: F.lit("") for c in ("sift_score", "sift_prediction", "polyphen_score", "polyphen_prediction")})
    kind = "record_id long, transcript_consequences array<struct<transcript_id:string,gene_symbol:string,biotype:string,canonical:string,consequence_terms:array<string>,amino_acids:string,protein_start:long,hgvsc:string,hgvsp:string,sift_score:double,sift_prediction:string,polyphen_score:double,polyphen_prediction:string>>"
    t = lambda i, canonical, biotype, **more: (i, more.get("gene", "GENE1"), biotype, canonical, ["missense_variant"], "G/C", 2, f"{i}:c.4G>T", "P:p.Gly2Cys", None, None, None, None)
    responses = spark.createDataFrame([(0, [t("T3.1", None, "miRNA"), t("T1.9", "1", "protein_coding"), t("T9.1", "1", "protein_coding")]), (5, [])], kind)
    pairs = compare.response_pairs(responses, a, "record_id").collect()
    assert [(r["record_id"], r["theirs"]["transcript_id"], r["ours"]["transcript_id"]) for r in pairs] == [(0, "T1.9", "T1.1")]
    fields = compare.response_fields(compare.response_pairs(responses, a, "record_id"), "record_id")
    assert fields.where("not same").count() == 0
    report = compare.response_text(fields, "record_id", 1)
    assert "Full matches: 1 (100.0%)" in report and "| gene_symbol | 1 | 1 | 0 | 0 | 100.0% |" in report
    other = spark.createDataFrame([(0, [t("T8.1", None, "miRNA", gene="X")])], kind)
    fields = compare.response_fields(compare.response_pairs(other, a, "record_id"), "record_id")
    best = pick.pick_best(a, ["record_id"]).first()["transcript_id"]
    assert compare.response_pairs(other, a, "record_id").first()["ours"]["transcript_id"] == best
    assert "- gene_symbol: X / GENE1 [mismatch]" in compare.response_text(fields, "record_id", 1)


def test_local_frequencies_come_first(spark):
    a = spark.createDataFrame([("1", 5, "A", "T", "rs1", 0.0), ("1", 6, "A", "T", "", 0.0), ("1", 7, "A", "T", None, None)], "chrom string, pos long, ref string, alt string, dbsnp_id string, gnomad_af double")
    body = '{"dbsnp": {"rsid": "rs9"}, "gnomad_exome": {"af": {"af": 0.2}}}'
    remote = session.reshape_remote(spark.createDataFrame([("1", 5, "A", "T", body), ("1", 6, "A", "T", body)], "chrom string, pos long, ref string, alt string, response string"))
    got = {r["pos"]: (r["dbsnp_id"], r["gnomad_af"], r["frequency_source"]) for r in session.local_first(a, remote).collect()}
    assert got == {5: ("rs1", 0.0, "local"), 6: ("rs9", 0.2, "remote"), 7: ("", 0.0, "")}
    assert {r["frequency_source"] for r in session.local_first(a).collect()} == {"local", ""}
