"""Token counts as delta-maintained rollups.

A rollup holds the documents and tokens of each (source, language, tokenizer version). Changes come in batches of signed
rows: an insert adds a document and its tokens, a delete takes them away, a revision takes the old count away and adds
the new one. A batch's changes are summed on the map side into one row for each group and committed as one partition of a
Parquet log, named by the batch; committing a batch again changes nothing. Totals are the sum of the log; `compact` folds
committed batches into one base partition, of which the log keeps the names.

A commit is a rename of a finished folder to a name that must not exist yet, so a lost executor or driver leaves either the
whole batch or none of it, and of two drivers that commit one batch one succeeds. Counting tokens is not this module's work:
it takes counts (`bpe.token_counts` gives those of a vocabulary).

Defined results: null sources, languages and versions are groups of their own; groups whose sums are all zero vanish from
the totals; null token counts count as 0; an empty batch commits and changes nothing. Repeated rows count as often as they
occur. Sums don't depend on the order of rows, so there are no ties; a text's length doesn't matter, since no text is read.
Only source, lang and the given columns are read, whatever others are named.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "version"]
SCHEMA = "source string, lang string, version string, docs long, tokens long"


def changes(df: DataFrame, kind: str, version: Column, tokens: Column, was: Column | None = None) -> DataFrame:
    """Signed rows of one kind: insert (+), delete (-), revise (-was, +tokens)."""
    rows = lambda sign, n, docs: df.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), version.cast("string").alias("version"), F.lit(docs).cast("long").alias("docs"), (F.coalesce(n, F.lit(0)) * sign).cast("long").alias("tokens"))
    if kind == "insert":
        return rows(1, tokens, 1)
    if kind == "delete":
        return rows(-1, tokens, -1)
    if kind == "revise":
        return rows(1, tokens - F.coalesce(was, F.lit(0)), 0)
    raise ValueError(f"kind of change: {kind}")


class Rollup:
    """A rollup in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _rename(self, a: str, b: str) -> bool:
        """Renames a folder to a name that must not exist: False if it does."""
        fs, p = self._fs(a)
        _, q = self._fs(b)
        fs.mkdirs(q.getParent())
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(p), fs.makeQualified(q), none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            fs.delete(p, True)
            return False
        return True

    def _bases(self) -> list[str]:
        return self._names("base")

    def _names_of(self, base: str) -> DataFrame:
        return self.spark.read.schema("batch string").parquet(f"{self.path}/base/{base}/names")

    def is_committed(self, batch: str) -> bool:
        fs, p = self._fs(f"{self.path}/log/batch-{batch}")
        return fs.exists(p) or any(not self._names_of(b).where(F.col("batch") == batch).isEmpty() for b in self._bases()[-1:])

    def committed(self) -> set[str]:
        """The names of all committed batches: one for each commit, however much it holds."""
        held = {r["batch"] for b in self._bases()[-1:] for r in self._names_of(b).collect()}
        return held | {n.removeprefix("batch-") for n in self._names("log")}

    def commit(self, batch: str, delta: DataFrame) -> bool:
        """Adds a batch of signed rows once; False if it is already there."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
            raise ValueError(f"name of a batch: {batch!r}")
        if self.is_committed(batch):
            return False
        draft = f"{self.path}/draft/{uuid.uuid4().hex}"
        sums = delta.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.parquet(draft)
        return self._rename(draft, f"{self.path}/log/batch-{batch}")

    def _deltas(self) -> tuple[DataFrame, list[str], DataFrame | None]:
        """The rows that make up the totals, the batches of the log among them, and the names that the base holds."""
        out, names = self.spark.createDataFrame([], SCHEMA), None
        log = self._names("log")
        for base in self._bases()[-1:]:
            out, names = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/base/{base}/totals"), self._names_of(base)
            if log:  # a batch that the base holds may still be in the log
                own = self.spark.createDataFrame([(n,) for n in log], "log string")
                log = sorted(r[0] for r in own.join(names, own["log"] == F.concat(F.lit("batch-"), "batch"), "left_anti").collect())
        if log:
            out = out.unionByName(self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/log/{n}" for n in log)))
        return out, log, names

    def totals(self, *by: str) -> DataFrame:
        """Documents and tokens of each group, or of coarser groups: the sums are additive."""
        by = by or tuple(KEYS)
        sums = self._deltas()[0].groupBy(*by).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs != 0 or tokens != 0")

    def compact(self) -> None:
        """Folds all committed batches into a new base; a batch of the log that the base names isn't read again. The base
        before stays for those who read it now; older ones go."""
        deltas, log, names = self._deltas()
        bases = self._bases()
        number = int(bases[-1]) + 1 if bases else 0
        draft = f"{self.path}/draft/{uuid.uuid4().hex}"
        deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{draft}/totals")
        new = self.spark.createDataFrame([(n.removeprefix("batch-"),) for n in log], "batch string")
        (new if names is None else names.unionAll(new)).write.parquet(f"{draft}/names")
        if self._rename(draft, f"{self.path}/base/{number:08d}"):
            for old in [*(f"log/{n}" for n in log), *(f"base/{b}" for b in bases[:-1])]:
                fs, p = self._fs(f"{self.path}/{old}")
                fs.delete(p, True)
