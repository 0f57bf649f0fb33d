"""Lines of gzip and block-compressed (BGZF) files, told by their first bytes and not by their names.

A BGZF file is a row of gzip members of at most 64 KB, each of which says in its header how long it is. Spark's text scan
reads the file as bytes in splits, with the header's fixed part as the record separator, so that each block is a row of the
split in which it begins; the size field then says whether a row is a whole block (one that only looked like the start of
another is put together again), and the member's own checksum whether it is sound. So a split inflates its own blocks and
nothing else. Lines that lie across splits are mended: each split gives its open first and last piece, of which there are
two a split, and the pieces between two line feeds are joined. For them only a split's outer blocks are inflated.

A file that is named .gz is inflated by Spark's own codec, which the name alone chooses, in one task; to read BGZF in
parallel, name it .bgz or anything else. Plain gzip under another name can only be inflated from its start: its bytes are
brought in order and streamed, one task a file.

A cut or damaged file is an error, never a short result. Lines end with a line feed, before which one carriage return is
dropped."""

from __future__ import annotations

import sys
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.overlap import with_size_check
from ..store import file_system

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the public formats: gzip's first bytes, the fixed part of a block's header (deflate, extra field of six
# bytes, subfield BC of two bytes), and the empty block that ends a file.
GZIP = bytes.fromhex("1f8b")
HEAD = bytes.fromhex("1f8b08040000000000ff060042430200")[:16]
LAST = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bytes of text in a block, at most.
BLOCK = 0xFF00
#: Blocks that are kept unread behind a split's last line feed before they are looked into.
KEPT = 1024
PLAIN, BLOCKS, STREAM = "plain", "blocks", "stream"


def first_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    fs, p = file_system(spark, path)
    if ":/" in path:  # as Spark lists files: a URI, with blanks and the like encoded
        p = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
    stream = fs.open(p)
    try:
        out = bytearray()
        while len(out) < n and (b := stream.read()) >= 0:
            out.append(b)
        return bytes(out)
    finally:
        stream.close()


def kind(spark: SparkSession, path: str) -> str:
    """How a file is read: plain (as Spark does, by its name), blocks or stream."""
    if path.endswith(".gz") or first_bytes(spark, path, len(GZIP)) != GZIP:
        return PLAIN
    return BLOCKS if first_bytes(spark, path, len(HEAD)) == HEAD else STREAM


def kinds(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The kind of each file; many files are looked at side by side."""
    with ThreadPoolExecutor(16) as pool:
        return dict(zip(paths, pool.map(lambda p: kind(spark, p), paths), strict=True))


def must_be_plain(spark: SparkSession, paths: list[str]) -> None:
    """For readers that cut a file into records of their own."""
    for p, k in kinds(spark, paths).items():
        if k != PLAIN:
            raise ValueError(f"{p}: compressed, but not named .gz")


def _scan(spark: SparkSession, paths: list[str], separator: bytes) -> DataFrame:
    """The bytes between separators: file, start (of the split), n (the row's place in its split) and value."""
    n = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = spark.read.option("lineSep", separator.decode("latin-1")).option("encoding", "ISO-8859-1").text(paths)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), n.alias("n"), F.col("value").cast("binary").alias("value"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("file", "start", "value")), strict=True)


def _blocks(file: str, rows: Iterator[bytes], first: bool) -> Iterator[bytes]:
    """Whole blocks from the rows of a split, by their size fields."""
    if first and next(rows, b""):
        raise ValueError(f"{file}: bytes before the first block")
    block = b""
    for value in rows:
        block += HEAD + value
        size = int.from_bytes(block[16:18], "little") + 1 if len(block) >= 18 else len(block) + 1
        if size == len(block):
            yield block
            block = b""
        elif size < len(block):
            raise ValueError(f"{file}: {len(block) - size} bytes behind a block")
    if block:
        raise ValueError(f"{file}: a block is cut off")


def _inflated(file: str, block: bytes) -> bytes:
    try:
        return zlib.decompress(block, wbits=31)
    except zlib.error as e:
        raise ValueError(f"{file}: a damaged block ({e})") from e


OUT = ["file", "start", "place", "left", "right", "value"]
OUT_SCHEMA = "file string, start long, place long, left boolean, right boolean, value binary"
KINDS = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]


def _batch(file: str, start: int, places: list[int], lines: list[bytes], left: bool = False, right: bool = False) -> pa.RecordBatch:
    n = len(lines)
    values = lines if left or right else [s.removesuffix(b"\r") for s in lines]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([file] * n, [start] * n, places, [left] * n, [right] * n, values), KINDS, strict=True)], OUT)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """The rows of a task by the splits that they come from."""
    rows = _rows(batches)
    ahead = next(rows, None)
    while ahead is not None:
        file, start = ahead[:2]

        def values(key=(file, start)):
            nonlocal ahead
            while ahead is not None and ahead[:2] == key:
                yield ahead[2]
                ahead = next(rows, None)

        own = values()
        yield file, start, own
        for _ in own:
            pass


class _Cutter:
    """Lines of texts that come one after the other, each with its place: the number of the text in which it begins, and
    its number among the lines that begin there."""

    def __init__(self, number: int):
        self.number, self.rest, self.place = number, [], number << 16

    def add(self, text: bytes) -> tuple[list[int], list[bytes]]:
        first, now = self.place, self.number << 16
        self.number += 1
        if b"\n" not in text:
            self.rest.append(text)
            return [], []
        lines = (b"".join(self.rest) + text).split(b"\n")
        self.rest, self.place = [lines.pop()], now + len(lines)
        return [first, *range(now + 1, now + len(lines))], lines


def _whole_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that lie within a split, between its first and its last line feed."""
    for file, start, values in _splits(batches):
        cutter, seen = _Cutter(start), False
        for block in _blocks(file, values, start == 0):
            places, lines = cutter.add(_inflated(file, block))
            if lines and not seen:  # the first one may begin in the split before
                seen, places, lines = True, places[1:], lines[1:]
            if lines:
                yield _batch(file, start, places, lines)


def _open_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands before the first and behind the last line feed of each split. Blocks between them stay as they are."""
    for file, start, values in _splits(batches):
        head, last, later, n = b"", None, [], start
        for block in _blocks(file, values, start == 0):
            if last is None:
                text = _inflated(file, block)
                head += text.partition(b"\n")[0]
                if b"\n" in text:
                    last = text.rpartition(b"\n")[2], (n << 16) + text.count(b"\n")
            else:
                later.append((n, block))
                if len(later) >= KEPT:
                    last, later = _behind(file, last, later), []
            n += 1
        if last is None:
            yield _batch(file, start, [start << 16], [head], left=True, right=True)
        else:
            text, place = _behind(file, last, later)
            yield _batch(file, start, [start << 16], [head], left=True)
            yield _batch(file, start, [place], [text], right=True)


def _behind(file: str, last: tuple[bytes, int], later: list[tuple[int, bytes]]) -> tuple[bytes, int]:
    """The text behind the last line feed, and its place; of the later blocks only the last ones are inflated."""
    after = b""
    for n, block in reversed(later):
        text = _inflated(file, block)
        if b"\n" in text:
            return text.rpartition(b"\n")[2] + after, (n << 16) + text.count(b"\n")
        after = text + after
    return last[0] + after, last[1]


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of plain gzip files, whose pieces come in order and lack the two bytes between them."""
    for file, _, values in _splits(batches):
        if next(values, b""):
            raise ValueError(f"{file}: not gzip")
        member, cutter = zlib.decompressobj(31), _Cutter(0)

        def inflate(data: bytes, file=file):
            nonlocal member
            while data:
                if member.eof:
                    member = zlib.decompressobj(31)
                try:
                    yield member.decompress(data, 1 << 16)
                except zlib.error as e:
                    raise ValueError(f"{file}: damaged gzip ({e})") from e
                data = member.unused_data if member.eof else member.unconsumed_tail

        for value in values:
            for text in inflate(GZIP + value):
                places, lines = cutter.add(text)
                if lines:
                    yield _batch(file, 0, places, lines)
        if not member.eof:
            raise ValueError(f"{file}: gzip is cut off")
        if rest := b"".join(cutter.rest):
            yield _batch(file, 0, [cutter.place], [rest])


def _mended(pieces: DataFrame) -> DataFrame:
    """Lines from the open pieces of splits: a piece that isn't open on its left begins a line. The text behind a file's
    last line feed is a line unless it is empty."""
    order = Window.partitionBy("file").orderBy("start", "right")
    # the first piece of a file has nothing on its left
    marked = pieces.withColumns({"begins": (~F.col("left") | (F.row_number().over(order) == 1)).cast("int"), "final": F.lead("start").over(order).isNull()})
    numbered = marked.withColumn("group", F.sum("begins").over(order))
    lines = numbered.groupBy("file", "group").agg(F.sort_array(F.collect_list(F.struct("start", "right", "place", "value"))).alias("p"), F.max("final").alias("final"))
    text = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["value"]))
    lines = lines.select("file", F.col("p")[0]["place"].alias("place"), text.alias("value"), "final").where(~F.col("final") | (F.length("value") > 0))
    bare = F.when(F.expr("endswith(value, X'0D')"), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    return lines.select("file", "place", bare.alias("value"))


def plain_path(c: Column) -> Column:
    """A path as it is compared: a local one may have one slash or three."""
    return F.regexp_replace(c, r"^(\w+):/+", "$1:/")


def block_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, place and value (binary) of the lines of BGZF files. A place is a number that is not above the block's offset,
    times 65,536, and the line's number among those that begin in the block."""
    blocks = _scan(spark, paths, HEAD).select("file", "start", "value")
    whole = blocks.mapInArrow(_whole_lines, OUT_SCHEMA).select("file", "place", "value")
    return whole.unionByName(_mended(blocks.mapInArrow(_open_pieces, OUT_SCHEMA)))


def stream_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same of plain gzip files under any name: bytes in order, one task a file."""
    pieces = _scan(spark, paths, GZIP)
    pieces = pieces.repartition("file").sortWithinPartitions("file", "start", "n").select("file", F.lit(0).cast("long").alias("start"), "value")
    return pieces.mapInArrow(_streamed, OUT_SCHEMA).select("file", "place", "value")


def lines(spark: SparkSession, found: dict[str, str]) -> DataFrame:
    """value and line of files of any kinds, in the order of their paths; found: path to kind. line leaves each file as many
    numbers as it has bytes, 65,536 times (a block of text has no more lines)."""
    paths = sorted(found)
    sizes = [fs.getFileStatus(p).getLen() for fs, p in (file_system(spark, p) for p in paths)]
    of = lambda k: [p for p in paths if found[p] == k]
    parts = [f(spark, of(k)) for k, f in ((BLOCKS, block_lines), (STREAM, stream_lines)) if of(k)]
    if of(PLAIN):
        n = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        parts.append(spark.read.text(of(PLAIN)).select(F.col("_metadata.file_path").alias("file"), F.shiftleft(F.col("_metadata.file_block_start") + n, 16).alias("place"), F.col("value").cast("binary").alias("value")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    value = F.col("value").cast("string").alias("value")
    if len(paths) == 1:
        return rows.select(value, F.col("place").alias("line"))
    bases = [b << 16 for b in accumulate((size + 1 for size in sizes), initial=0)]
    files = with_size_check(spark.createDataFrame(list(zip(bases, paths)), "_base long, _path string").withColumn("_path", plain_path(F.col("_path"))))
    return rows.withColumn("_path", plain_path(F.col("file"))).join(files, "_path").select(value, (F.col("_base") + F.col("place")).alias("line"))


def compressed(text: bytes, level: int = 6) -> bytes:
    """A text as blocks."""
    out = []
    for i in range(0, len(text), BLOCK):
        part = text[i : i + BLOCK]
        c = zlib.compressobj(level, zlib.DEFLATED, -15)
        data = c.compress(part) + c.flush()
        if len(data) > 0xFFFF - 26:  # what doesn't get smaller is stored
            c = zlib.compressobj(0, zlib.DEFLATED, -15)
            data = c.compress(part) + c.flush()
        out.append(HEAD + (len(data) + 25).to_bytes(2, "little") + data + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little"))
    return b"".join(out)


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([compressed(b"".join(held))], pa.binary())], ["value"])

    for b in batches:
        for value in b.column(0).to_pylist():
            held += (value, b"\n")
            size += len(value) + 1
            if size >= 16 * BLOCK:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def write_blocks(lines: DataFrame, path: str) -> None:
    """Writes a column of lines, in the order in which its partitions have them, as one BGZF file a partition. Rows are blocks
    and the separator behind each is the empty block, so that the files are sound and may be put one behind the other."""
    value = lines.select(F.col(lines.columns[0]).cast("binary").alias("value"))
    blocks = value.mapInArrow(_pressed, "value binary").select(F.col("value").cast("string").alias("value"))
    blocks.write.option("lineSep", LAST.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def spool(spark: SparkSession, stream, folder: str) -> str:
    """Copies a stream of bytes, such as standard input, to a file in a shared folder, a megabyte at a time."""
    path = f"{folder}/input-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    out = fs.create(p)
    try:
        while data := stream.read(1 << 20):
            out.write(bytearray(data))
    finally:
        out.close()
    return path
