"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import uuid
from functools import cache

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(module_name: str) -> None:
    """Pickle a module's functions by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master (tests, one
    machine) gets a folder that goes with the process; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return at.rstrip("/") if at else _local()


@cache
def _local() -> str:
    folder = tempfile.TemporaryDirectory(prefix="allelic-")
    atexit.register(folder.cleanup)
    return folder.name


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what `materialize` wrote, once nothing reads it any more."""
    for df in tables:
        path = df.__dict__.pop("_written", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


#: Where a worker process keeps a tokenizer from task to task.
HELD = "_allelic_coder"


def let_go() -> None:
    """Called by tasks that need no tokenizer: a worker that is used again gives up the one it kept for an earlier stage."""
    sys.__dict__.pop(HELD, None)


def free_name(taken: list[str], name: str) -> str:
    """The name, with underscores in front while a column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def ascii_lower(c):
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id):
    """crc32 of the id as text, modulo 5: fold 0 is held out from training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


#: Rows of an Arrow batch, since one text can be very long.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows in this session, the same for every operator; a size that the user has set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's default
        spark.conf.set(name, str(BATCH_ROWS))
