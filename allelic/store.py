"""Folders that driver and executors share, and commits by rename."""

from __future__ import annotations

import atexit
import re
import tempfile
from functools import cache

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local master (tests, one machine) gets a folder that goes with the process,
    and a cluster an error: there is no local folder that executors would see."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return at.rstrip("/") if at else _local()


@cache
def _local() -> str:
    folder = tempfile.TemporaryDirectory(prefix="allelic-")
    atexit.register(folder.cleanup)
    return folder.name


def file_system(spark: SparkSession, path: str):
    """(file system, path) of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, sorted; nothing if there is none."""
    fs, p = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, draft: str, final: str) -> bool:
    """Renames a finished folder to a name that must not exist. Of two that try, one succeeds; the other gets False, and its
    draft stays."""
    fs, p = file_system(spark, draft)
    _, q = file_system(spark, final)
    fs.mkdirs(q.getParent())
    jvm = spark._jvm
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(p), fs.makeQualified(q), none)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        return False
    return True
