"""gzip and block-compressed files, told by their first bytes."""

import gzip
import io
import random
import sys

import pytest

from allelic.sources import compressed, tables, variants

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def text_of(n: int, seed: int = 1) -> bytes:
    rng = random.Random(seed)
    lines = [f"{i}\té{rng.random()}\t{'x' * rng.randrange(60)}" + ("\r" if rng.random() < 0.1 else "") + ("\n" if rng.random() < 0.05 else "") for i in range(n)]
    return ("\n".join(lines) + "\n").encode() if n else b""


def plain_lines(text: bytes) -> list[str]:
    out = [x.removesuffix(b"\r").decode() for x in text.split(b"\n")]
    return out[:-1] if out[-1] == "" else out


def read(spark, path) -> list[str]:
    rows = variants.lines_of(spark, str(path)).orderBy("line").collect()
    assert len({r["line"] for r in rows}) == len(rows)
    return [r["value"] for r in rows]


@pytest.mark.parametrize("text", [text_of(20_000), text_of(3), b"", b"\n", b"\n\n\n" * 50_000, b"no feed", text_of(9000) + b"L" * 400_000 + b"\n" + text_of(9000, 2) + b"tail without feed"], ids=["many", "few", "none", "feed", "feeds", "open", "long"])
def test_blocks_give_the_plain_lines(spark, tmp_path, small_splits, text):
    for name in ("a.vcf.bgz", "no-ending"):
        (tmp_path / name).write_bytes(compressed.compressed(text) + compressed.LAST)
        assert read(spark, tmp_path / name) == plain_lines(text)


def test_blocks_are_read_in_several_tasks(spark, tmp_path, small_splits):
    (tmp_path / "a.bgz").write_bytes(compressed.compressed(text_of(60_000)) + compressed.LAST)
    blocks = compressed.block_lines(spark, [f"file:{tmp_path}/a.bgz"])
    own = blocks.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(1 for n in own if n > 1000) >= 8


def test_gzip_of_any_name_and_of_several_members(spark, tmp_path):
    text = text_of(20_000)
    (tmp_path / "x.vcf").write_bytes(gzip.compress(text[:100_001]) + gzip.compress(b"") + gzip.compress(text[100_001:]))
    (tmp_path / "x.vcf.gz").write_bytes(compressed.compressed(text) + compressed.LAST)
    assert read(spark, tmp_path / "x.vcf") == read(spark, tmp_path / "x.vcf.gz") == plain_lines(text)


def test_files_of_all_kinds_keep_their_order(spark, tmp_path):
    parts = {"a": text_of(5000, 1), "b": text_of(4000, 2), "c": text_of(3000, 3), "d.gz": text_of(2000, 4), "e": b""}
    (tmp_path / "a").write_bytes(compressed.compressed(parts["a"]) + compressed.LAST + compressed.LAST)
    (tmp_path / "b").write_bytes(parts["b"])
    (tmp_path / "c").write_bytes(gzip.compress(parts["c"]))
    (tmp_path / "d.gz").write_bytes(gzip.compress(parts["d.gz"]))
    (tmp_path / "e").write_bytes(b"")
    assert read(spark, tmp_path) == [line for p in parts.values() for line in plain_lines(p)]


@pytest.mark.parametrize("harm", ["cut", "bit", "behind", "cut gzip", "bit gzip"])
def test_broken_files_are_errors(spark, tmp_path, harm):
    text = text_of(20_000)
    raw = gzip.compress(text) if "gzip" in harm else compressed.compressed(text) + compressed.LAST
    at = len(raw) // 2
    broken = raw[:at] if harm.startswith("cut") else raw[:at] + bytes([raw[at] ^ 4]) + raw[at + 1 :] if harm.startswith("bit") else raw + b"garbage"
    (tmp_path / "x.bgz").write_bytes(broken)
    with pytest.raises(Exception, match="block|gzip"):
        variants.lines_of(spark, str(tmp_path / "x.bgz")).count()


def test_a_block_inside_a_block_is_no_boundary(spark, tmp_path):
    inner = b"1\t2\n" + compressed.HEAD + b"\xff\xff\n3\n"
    part = compressed.compressed(inner, level=0)
    assert part.count(compressed.HEAD) == 2
    (tmp_path / "x.bgz").write_bytes(part + compressed.compressed(b"end\n") + compressed.LAST)
    rows = variants.lines_of(spark, str(tmp_path / "x.bgz")).orderBy("line").selectExpr("cast(value as binary) as v").collect()
    assert [bytes(r["v"]) for r in rows] == (inner + b"end").split(b"\n")


def test_frequency_file_in_blocks(spark, tmp_path):
    body = "".join(f"chr1\t{i}\trs{i}\tA\tC\t.\tPASS\tAC={i};AF=0.25;AN=100\n" for i in range(1, 5001))
    (tmp_path / "g.vcf.bgz").write_bytes(compressed.compressed((HEAD + body).encode()) + compressed.LAST)
    path = str(tmp_path / "g.vcf.bgz")
    assert variants.vcf_header(spark, path) == (["##fileformat=VCFv4.2"], [])
    assert variants.read_vcf(spark, path).count() == variants.gnomad(variants.lines_of(spark, path)).count() == 5000


def test_written_blocks_are_sound(spark, tmp_path):
    df = spark.range(30_000).selectExpr("concat('line ', id, repeat('é', id % 7)) as value").repartition(3)
    compressed.write_blocks(df, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    want = sorted(r["value"] for r in df.collect())
    assert len(parts) == 3 and all(p.read_bytes().endswith(compressed.LAST) for p in parts)
    assert sorted(gzip.decompress(b"".join(p.read_bytes() for p in parts)).decode().split("\n")[:-1]) == want
    assert sorted(read(spark, tmp_path / "out")) == want
    compressed.write_blocks(df.limit(0), str(tmp_path / "none"))
    assert read(spark, tmp_path / "none") == []


def test_standard_input(spark, monkeypatch):
    class Stdin:
        buffer = io.BytesIO(gzip.compress(HEAD.encode() + b"1\t5\t.\tA\tC\t.\t.\tX\n"))

    monkeypatch.setattr(sys, "stdin", Stdin)
    lines = variants.lines_of(spark, "-")
    assert [r["chrom"] for r in variants.parse_vcf_lines(lines).collect()] == ["1"]


def test_readers_of_other_records_refuse_what_they_cannot_read(spark, tmp_path):
    (tmp_path / "x.fa.bgz").write_bytes(compressed.compressed(b">a\nACGT\n") + compressed.LAST)
    with pytest.raises(ValueError, match="compressed"):
        tables.fasta(spark, str(tmp_path / "x.fa.bgz"))
