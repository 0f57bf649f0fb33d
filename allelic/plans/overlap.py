"""The interval join: variants with the transcripts that hold them.

Transcripts are listed once for each bin that they touch; a position has exactly one bin, so a pair comes out once. The
join is an equi-join on (chrom, bin) with the exact bounds as a residual condition.

What is broadcast is bounded by its measured bytes. A small model is broadcast as it is. A larger one whose transcripts touch
a few bins each is dealt by (chrom, bin) as it is, so that only the two tables are shuffled, never their many pairs; adaptive
execution splits skewed bins, and rows come out bin by bin. Spark's estimate would still broadcast such a model. If its transcripts touch many bins, the ids and bounds alone take part in the interval join,
broadcast if they are below the bound, and the exons and sequences are joined by id afterwards, so that a row that isn't in a
transcript never meets them and long transcripts aren't copied to all of their bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BIN = 1 << 17
BROADCAST_BYTES = 64 << 20
#: Bins that a transcript touches on average, up to which whole transcripts are dealt to their bins.
COPIES = 8
#: Bytes of a value of fixed width, and of what a row or an array holds besides its values.
WIDTH = 8


def binned(transcripts: DataFrame, width: int = BIN) -> DataFrame:
    return transcripts.withColumn("_bin", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"end div {width}"))))


def bytes_of(kind: T.DataType, c: Column) -> Column:
    """About how many bytes a value takes in a row."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return WIDTH + F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        each = WIDTH * (1 + len(inner.fields)) if isinstance(inner, T.StructType) else 4 * WIDTH
        return WIDTH + F.greatest(F.size(c), F.lit(0)) * each
    return F.lit(WIDTH)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    each = F.lit(2 * WIDTH)
    for f in df.schema.fields:
        each = each + bytes_of(f.dataType, F.col(f"`{f.name}`"))
    return each.cast("long")


def total_bytes(df: DataFrame) -> int:
    """The measured bytes of a table's rows."""
    return int(df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()[0])


def with_size_check(df: DataFrame, bytes_at_most: int = BROADCAST_BYTES) -> DataFrame:
    """df hinted for broadcast if its measured bytes are below the bound, else for a join of shuffled rows: Spark's own estimate
    is of its files' bytes, not of what is worked out from them."""
    return hinted(df, total_bytes(df) <= bytes_at_most)


def hinted(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df.hint("merge")


def touches_few(transcripts: DataFrame, width: int) -> bool:
    """Whether transcripts touch few bins each, by their bounds alone."""
    n = transcripts.select(F.expr(f"end div {width} - start div {width} + 1").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    return n[0] <= COPIES * n[1]


KEY = ["transcript_id", "chrom", "start"]


def interval_join(variants: DataFrame, transcripts: DataFrame, width: int = BIN, how: str = "left", broadcast_bytes: int = BROADCAST_BYTES, size: int | None = None, keep_bin: bool = False) -> DataFrame:
    """Each variant with each transcript of its chromosome with start <= pos <= end; with `left`, variants without any
    stay, with null transcript columns (transcript_id null). `size` is the measured bytes of the transcripts where they are
    known already; `keep_bin` keeps the variant's bin as _vbin, by which the rows of a shuffled join lie together."""
    clash = set(variants.columns) & set(transcripts.columns) - {"chrom"}
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}")
    own = ["_vbin"] if keep_bin else []
    v = variants.withColumn("_vbin", F.expr(f"pos div {width}"))
    on = (F.col("chrom") == F.col("_chrom")) & (F.col("_vbin") == F.col("_bin")) & F.col("pos").between(F.col("start"), F.col("end"))
    whole = binned(transcripts, width).withColumnRenamed("chrom", "_chrom")
    narrow = [*KEY, "end"]
    small = (total_bytes(whole) if size is None else size) <= broadcast_bytes
    if small or set(transcripts.columns) <= set(narrow) or touches_few(transcripts, width):
        return v.join(hinted(whole, small), on, how).drop("_chrom", "_bin", *({"_vbin"} - {*own}))
    ids = binned(transcripts.select(*narrow), width).withColumnRenamed("chrom", "_chrom")
    found = v.join(with_size_check(ids, broadcast_bytes), on, how).drop("_chrom", "_bin", *({"_vbin"} - {*own}))
    rest = transcripts.withColumnsRenamed({"transcript_id": "_id", "chrom": "_chrom", "start": "_start"}).drop("end")
    # variants without a transcript are dealt to all tasks by a key that no transcript has
    key = F.coalesce("transcript_id", F.concat(F.lit("-"), F.pmod(F.xxhash64("chrom", "pos"), F.lit(4096)).cast("string")))
    joined = found.withColumn("_key", key).join(hinted(rest, False), (F.col("_key") == F.col("_id")) & (F.col("chrom") == F.col("_chrom")) & (F.col("start") == F.col("_start")), how)
    return joined.select(*variants.columns, *own, *(c for c in transcripts.columns if c != "chrom" or "chrom" not in variants.columns))
