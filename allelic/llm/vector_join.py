"""Near-duplicate embeddings by an exact metric range join.

Angles between vectors are a metric. Pivots partition the vectors into cells of about CELL by the nearest pivot. For each
cell the spans of its vectors' angles to its own pivot and to the NEAR pivots next to it are measured; by the triangle
inequality a vector can link into the cell only if its own angle to each of these pivots lies within the link angle of the
span, and its angle to the cell's pivot within twice the link angle of that to its own pivot. Cells that lie next to each
other are dealt to one block of about BLOCK vectors; large cells are cut into several blocks.

A block's own vectors are held in memory; vectors that may link into any of its cells visit it, and are streamed past it in
Arrow batches, so that a task's memory does not grow with a hot cell. A visitor meets the cells that it may link into only;
`pruned_share` tells how many comparisons that saves. Of two blocks, one hosts the other by parity, so that each pair is
compared once.

Equal vectors are one class from the start. A block emits one row for each vector that it held or saw (a link count, and
one link of the block's own spanning forest), never the pairs. Products are taken in single precision; those within
rounding of the threshold are repeated in double precision.

Where vectors point in all directions, as in high dimensions, the spans are wide and the bounds exclude about half; what is
left is a blocked comparison, which an exact answer costs there. Clustered vectors meet their own cluster's cells only.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different length don't link. Equal rows stay as many rows, each counting the others. A null vec_id is not kept. Ties go to
the least id. Other columns aren't read, whatever their names.

An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship
from .graph import components

BLOCK, CELL = 2048, 128
#: Pivots, vectors of the sample (by hash) for each that they are chosen from, and neighbours of a pivot that bound its cell.
MOST_PIVOTS, SAMPLE, NEAR = 2048, 16, 8
EPS = 1e-6
#: Parts in which a component's or a class's result is dealt to its rows.
PARTS = 32


def unit(rows: list) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(sample: list, n: int) -> dict[int, np.ndarray]:
    """For each dimension: pivots, refined by a few rounds of spherical k-means on the sample, in an order in which
    neighbours lie near to each other."""
    out = {}
    for dim in sorted({len(v) for v in sample}):
        u = unit([v for v in sample if len(v) == dim])
        k = max(1, min(MOST_PIVOTS, round(n * len(u) / len(sample) / CELL)))
        p = u[np.linspace(0, len(u) - 1, min(k, len(u))).astype(int)]
        for _ in range(8):
            own = (u @ p.T).argmax(1)
            sums = np.zeros_like(p)
            np.add.at(sums, own, u)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            p = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), p)
        out[dim] = p[_path(p)]
    return out


def _path(p: np.ndarray) -> list[int]:
    """From pivot to the nearest that isn't on the path yet."""
    like = p @ p.T
    at, left = 0, np.ones(len(p), bool)
    path = []
    for _ in range(len(p)):
        path.append(at)
        left[at] = False
        if left.any():
            at = int(np.where(left, like[at], -2).argmax())
    return path


def _by_dim(column):
    """(dim, positions, vectors) of a column of lists, straight from its buffers."""
    dims = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(dims) - dims
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield int(d), at, flat.reshape(-1, d) if len(at) == len(dims) else flat[starts[at][:, None] + np.arange(d)]


class Cells:
    """The pivots and spans of one dimension's cells, and the blocks that they belong to."""

    def __init__(self, pivots: np.ndarray):
        self.p = pivots
        k = len(pivots)
        # a cell's own pivot first, then those next to it
        self.refs = np.argsort(-(pivots @ pivots.T), axis=1, kind="stable")[:, : 1 + min(NEAR, k - 1)]
        own = np.arange(k)[:, None]
        self.refs = np.concatenate([own, np.array([[r for r in row if r != c][: self.refs.shape[1] - 1] for c, row in enumerate(self.refs.tolist())], int).reshape(k, -1)], axis=1)
        self.lo, self.hi = np.full(self.refs.shape, np.inf), np.full(self.refs.shape, -np.inf)
        self.n = np.zeros(k, int)
        self.first, self.many = np.zeros(k, int), np.zeros(k, int)

    def angles(self, u: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(u @ self.p.T, -1, 1))

    def spans(self, a: np.ndarray, own: np.ndarray):
        """(cell, place of the pivot, lowest and highest angle, vectors) of a batch."""
        for c in np.unique(own):
            mine = a[own == c][:, self.refs[c]]
            for r in range(mine.shape[1]):
                yield int(c), r, float(mine[:, r].min()), float(mine[:, r].max()), len(mine)

    def may(self, u: np.ndarray, own: np.ndarray, ids: np.ndarray, alpha: float) -> np.ndarray:
        """(vectors, ids): whether a vector can link into the cell; always into its own."""
        need, at = np.unique(self.refs[ids], return_inverse=True)
        a = np.arccos(np.clip(u @ self.p[need].T, -1, 1))
        near = np.arccos(np.clip(np.einsum("ij,ij->i", u, self.p[own]), -1, 1))
        at = at.reshape(len(ids), -1)
        ok = a[:, at[:, 0]] <= near[:, None] + 2 * alpha + EPS
        for r in range(at.shape[1]):
            to = a[:, at[:, r]]
            ok &= (to <= self.hi[ids, r] + alpha + EPS) & (to >= self.lo[ids, r] - alpha - EPS)
        return ok | (own[:, None] == ids)

    def deal(self, first: int) -> int:
        """Numbers the blocks from `first` on: cells side by side up to BLOCK vectors, or several for a large cell."""
        room = 0
        for c in np.flatnonzero(self.n):
            if self.n[c] > BLOCK:
                self.first[c], self.many[c] = first, -(-self.n[c] // BLOCK)
                first, room = first + self.many[c], 0
            else:
                if room < self.n[c]:
                    first, room = first + 1, BLOCK
                self.first[c], self.many[c] = first - 1, 1
                room -= self.n[c]
        return first


def plan(classes: DataFrame, n: int) -> dict[int, Cells]:
    """The cells of each dimension; what comes to the driver is bounded by MOST_PIVOTS and the number of dimensions."""
    sample = [r["v"] for r in classes.orderBy("cls").limit(max(256, SAMPLE * min(MOST_PIVOTS, -(-n // CELL)))).select("v").collect()]
    cells = {d: Cells(p) for d, p in choose_pivots(sample, n).items()} if sample else {}

    def measure(batches):
        for batch in batches:
            out = []
            for d, _, v in _by_dim(batch.column("v")):
                u = unit(v)
                if d in cells:
                    a = cells[d].angles(u)
                    out += [(d, *x) for x in cells[d].spans(a, a.argmin(1))]
                else:  # a dimension that isn't in the sample is one cell
                    out.append((d, 0, 0, 0.0, 0.0, len(u)))
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64()])], names=["d", "c", "r", "lo", "hi", "n"])

    found = classes.select("v").mapInArrow(measure, "d int, c int, r int, lo double, hi double, n long").groupBy("d", "c", "r").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect()
    for r in found:
        x = cells.setdefault(r["d"], None)
        if x is None:
            x = cells[r["d"]] = Cells(np.eye(1, r["d"]))
            x.lo[:], x.hi[:] = 0, np.pi
        if len(x.p) > 1 or r["lo"] or r["hi"]:
            x.lo[r["c"], r["r"]], x.hi[r["c"], r["r"]] = r["lo"], r["hi"]
        if r["r"] == 0:
            x.n[r["c"]] = r["n"]
    first = 0
    for d in sorted(cells):
        first = cells[d].deal(first)
    return cells


def pruned_share(vectors: list, threshold: float = 0.9) -> float:
    """The share of all ordered pairs of vectors of one length that the bounds exclude, on a table that fits into memory."""
    u = unit(vectors)
    cells = Cells(choose_pivots(vectors, len(u))[u.shape[1]])
    a = cells.angles(u)
    own = a.argmin(1)
    for c, r, lo, hi, n in cells.spans(a, own):
        cells.lo[c, r], cells.hi[c, r], cells.n[c] = lo, hi, n
    may = cells.may(u, own, np.arange(len(cells.p)), float(np.arccos(threshold)) + EPS)
    return 1 - float((may * cells.n).sum()) / len(u) ** 2


def near_vectors(df: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, n_links, component_id and kept for every row of df."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("id"), F.when(F.coalesce(fine, F.lit(False)), v).alias("v")).withColumn("cls", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    grouped = lambda rows: materialize(rows.where("cls is not null").groupBy("cls").agg(F.min("v").alias("v"), F.max("v").alias("_w"), F.count("*").alias("n"), F.min("id").alias("rep")), "vectors")
    classes = grouped(rows)
    if not classes.where("v != _w").isEmpty():  # different vectors with one hash: a second hash tells them apart
        twice = classes.where("v != _w").select(F.col("cls").alias("_c"))
        rows = rows.join(twice.hint("merge"), F.col("cls") == F.col("_c"), "left").withColumn("cls", F.when(F.col("_c").isNull(), F.col("cls")).otherwise(F.xxhash64(F.lit(7), "v"))).drop("_c")
        classes = grouped(rows)
    classes = classes.drop("_w")
    cells = plan(classes, classes.count())
    alpha = float(np.arccos(threshold)) + EPS

    def deal(batches):
        for batch in batches:
            cls = batch.column("cls").to_numpy()
            block, visit, take, cell = [], [], [], []
            for d, at, v in _by_dim(batch.column("v")):
                x, u = cells[d], unit(v)
                own = x.angles(u).argmin(1)
                mine = (x.first[own] + ((cls[at].astype(np.uint64) >> np.uint64(7)) % x.many[own].astype(np.uint64)).astype(int)).astype(int)
                block.append(mine)
                visit.append(np.zeros(len(at), int))
                cell.append(own)
                take.append(at)
                full = np.flatnonzero(x.n)
                may = x.may(u, own, full, alpha)
                # by blocks: cells that share one, or a large cell's several
                for b in np.unique(x.first[full]):
                    inside = full[x.first[full] == b]
                    able = may[:, x.first[full] == b].any(1)
                    for t in range(b, b + x.many[inside[0]]):
                        host = np.where((mine + t) % 2 == 0, np.minimum(mine, t), np.maximum(mine, t))
                        go = np.flatnonzero(able & (mine != t) & (host == t))
                        block.append(np.full(len(go), t))
                        visit.append(np.ones(len(go), int))
                        cell.append(own[go])
                        take.append(at[go])
            if take:
                out = batch.take(pa.array(np.concatenate(take)))
                yield pa.record_batch([pa.array(np.concatenate(block), pa.int32()), pa.array(np.concatenate(visit), pa.int32()), pa.array(np.concatenate(cell), pa.int32()), out.column("cls"), out.column("n"), out.column("v")], names=["block", "visit", "cell", "cls", "n", "v"])

    kind = dict(classes.dtypes)["v"]
    dealt = classes.select("cls", "n", "v").mapInArrow(deal, f"block int, visit int, cell int, cls long, n long, v {kind}")
    dealt = dealt.repartition("block").sortWithinPartitions("block", "visit", "cell")

    class Host:
        """A block's own vectors, and what has been found of them."""

        def __init__(self):
            self.cls, self.n, self.v, self.cell, self.u, self.links, self.up = [], [], [], [], None, None, None

        def add(self, cls, n, v, cell):
            self.cls += cls
            self.n += n
            self.v.append(v)
            self.cell += cell

        def close(self):
            self.u = unit(np.concatenate(self.v))
            self.v, self.n, self.links, self.up = None, np.array(self.n), np.zeros(len(self.u), np.int64), list(range(len(self.u)))
            self.u32 = self.u.astype(np.float32)
            cell = np.array(self.cell)
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1), len(cell)]  # rows come by cell
            self.spans = [(int(cell[i]), i, j) for i, j in zip(cuts, cuts[1:], strict=False)]
            for k in range(0, len(self.u), BLOCK):
                h, w = self.pairs(self.u[k : k + BLOCK], self.u32[k : k + BLOCK], cell[k : k + BLOCK])
                w = w + k
                keep = h != w
                h, w = h[keep], w[keep]
                np.add.at(self.links, h, self.n[w])
                self.join(h, w)

        def pairs(self, u, u32, own):
            """(host, visitor) of the links: each cell meets the visitors that may link into it. own: the visitors' cells."""
            x = cells[u.shape[1]]
            ids = np.array([c for c, _, _ in self.spans])
            may = x.may(u, own, ids, alpha)
            slack = 2e-7 * max(64, u.shape[1])
            hosts, visitors = [], []
            for k, (_, i, j) in enumerate(self.spans):
                go = np.flatnonzero(may[:, k])
                if not len(go):
                    continue
                some = len(go) < len(u)
                s = self.u32[i:j] @ (u32[go] if some else u32).T
                h, w = np.nonzero(s >= threshold - slack)
                unsure = np.flatnonzero(s[h, w] <= threshold + slack)
                h, w = h + i, go[w]
                if len(unsure):
                    sure = np.ones(len(h), bool)
                    sure[unsure] = np.einsum("ij,ij->i", self.u[h[unsure]], u[w[unsure]]) >= threshold
                    h, w = h[sure], w[sure]
                hosts.append(h)
                visitors.append(w)
            return (np.concatenate(hosts), np.concatenate(visitors)) if hosts else (np.empty(0, int), np.empty(0, int))

        def root(self, i):
            while self.up[i] != i:
                self.up[i] = self.up[self.up[i]]
                i = self.up[i]
            return i

        def join(self, a, b):
            for x in np.unique(np.minimum(a, b).astype(np.int64) * len(self.up) + np.maximum(a, b)):
                i, j = self.root(int(x) // len(self.up)), self.root(int(x) % len(self.up))
                if i != j:
                    self.up[max(i, j)] = min(i, j)

        def see(self, cls, n, v, cell):
            """Visitors: (cls, links, a link) of those that link here."""
            u = unit(v)
            h, w = self.pairs(u, u.astype(np.float32), cell)
            np.add.at(self.links, h, n[w])
            seen = np.bincount(w, weights=self.n[h].astype(float), minlength=len(n)).astype(np.int64)
            least = np.full(len(n), len(self.up))
            np.minimum.at(least, w, h)
            self.join(least[w], h)
            return [(int(cls[i]), int(seen[i]), self.cls[least[i]]) for i in np.flatnonzero(seen)]

        def rows(self):
            return [(c, int(k), self.cls[self.root(i)]) for i, (c, k) in enumerate(zip(self.cls, self.links, strict=True)) if k]

    def compare(batches):
        at, host, out = None, None, []
        for batch in batches:
            block, visit = batch.column("block").to_numpy(), batch.column("visit").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(visit) != 0)) + 1), len(block)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if block[i] != at:
                    out += _finish(host)
                    at, host = block[i], Host()
                part = batch.slice(i, j - i)
                cls, n, cell = (part.column(c).to_numpy() for c in ("cls", "n", "cell"))
                for d, here, v in _by_dim(part.column("v")):
                    if not visit[i]:  # a block's own vectors have one dimension
                        host.add(cls[here].tolist(), n[here].tolist(), v, cell[here].tolist())
                    elif host.cls:
                        if host.u is None:
                            host.close()
                        if d == host.u.shape[1]:
                            for k in range(0, len(here), BLOCK):
                                to = here[k : k + BLOCK]
                                out += host.see(cls[to], n[to], v[k : k + BLOCK], cell[to])
            yield _links(out)
            out = []
        yield _links(_finish(host))

    def _finish(host):
        if host is None or not host.cls:
            return []
        if host.u is None:
            host.close()
        return host.rows()

    def _links(out):
        return pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["cls", "links", "to"])

    found = materialize(dealt.mapInArrow(compare, "cls long, links long, to long"), "found")
    counted = found.groupBy("cls").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("cls").alias("a"), F.col("to").alias("b")))
    # the joins by class stay sort-merge joins, whose hot keys adaptive execution splits
    named = labels.join(classes.select("cls", "rep"), labels["node"] == F.col("cls")).select("cls", "root", "rep")
    # a component's least id, dealt to its vectors in parts, since one component may hold many
    part = F.pmod(F.xxhash64("cls"), F.lit(PARTS)).cast("int")
    least = named.groupBy("root").agg(F.min("rep").alias("least")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    named = named.withColumn("part", part).join(least, ["root", "part"]).select("cls", "least")
    known = classes.select("cls", "n", "rep").join(counted, "cls", "left").join(named, "cls", "left")
    known = known.select("cls", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    linked = rows.where("cls is not null").select("id", "cls").join(known.hint("merge"), "cls", "left").select("id", "n_links", "component_id")
    alone = rows.where("cls is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionAll(alone).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


ship(__name__)
