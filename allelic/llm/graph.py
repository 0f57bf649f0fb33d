"""Connected components of a graph given as a table of edges.

Edges are first reduced in place: each partition keeps a spanning forest of its own edges. Where no more than FEW edges
are left (a bound on one task's memory), one task joins them by union-find. Beyond that, alternating large and small
stars replace a node's links by links to the least node it knows, with joins and map-side aggregates only; hubs are
skewed join keys, which adaptive execution splits. Rounds are written to the shared folder."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, ship

#: Edges (16 bytes each as Arrow, about 300 in a task's dictionary) that one task may join.
FEW = 1_000_000


def forest(batches):
    """Star edges (a, least node) that connect what the batches' edges connect."""
    up: dict[int, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in list(up)]
    pairs = [p for p in pairs if p[0] != p[1]]
    for i in range(0, len(pairs), 100_000):
        part = pairs[i : i + 100_000]
        yield pa.record_batch([pa.array([p[k] for p in part], pa.int64()) for k in (0, 1)], names=["a", "b"])


def is_star_forest(e: DataFrame) -> bool:
    """Whether each node has one link and every link's target has none."""
    n = e.agg(F.count("*").alias("n"), F.count_distinct("a").alias("k")).first()
    return n["n"] == n["k"] and e.join(e.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def stars(e: DataFrame) -> DataFrame:
    while not is_star_forest(e):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = materialize(small.where("a != b").distinct(), "edges")
        discard(e)
        e = new
    return e


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """edges: a, b. Returns (node, root) for every node that has a link to another one; root is the least node."""
    e = materialize(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a != b").mapInArrow(forest, "a long, b long"), "edges")
    if e.count() <= few:
        one = materialize(e.coalesce(1).mapInArrow(forest, "a long, b long"), "edges")
        discard(e)
        e = one
    else:
        e = stars(e.distinct())
    roots = e.select("b").distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


ship(__name__)
