"""The prefix trie of conversations, without building a tree: smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations that start with it. Each node belongs to
its smallest member, and since members only become fewer along a path, the nodes that a conversation owns are a suffix of
its path. So every sum over a subtree is a sum over the members of its top:

    tokens saved  = tokens of all its turns from there on, less the tokens of those turns whose nodes it owns
    leaves        = 1 if it owns its last node and nobody goes on from there
    children      = 1 if it owns the node below

Windows along each conversation give these three, and one group-by by prefix adds them up.

How it is dealt: texts are hashed where they are read, and only 16-byte digests move. A prefix is named by its depth and
the running exclusive-or of two 64-bit hashes of (depth, turn), so that a window gives all prefixes of a conversation in
one pass. The least member of a prefix is found over (prefix, salt of the conversation) first and then over at most
SALTS rows a prefix, so the root, which every conversation meets, is no hot key; the same rows are joined back by (prefix,
salt). Group-bys combine on the map side. The ids that end at a node are joined in runs of ids that are close together and
go through one digest in order, a run at a time, so that no list of copies is ever held.

Defined results: turns are ordered by (turn, role, digest of the text), null turns first; null roles and texts are empty
ones; rows with a null conversation id belong to no conversation; repeated rows are turns of their own; a conversation
without turns is a member of the root alone; an empty table gives no node; texts of any length are read whole and
measured in UTF-8 bytes; columns beyond the named ones are not read, whatever their names. One conversation's turns are
numbered in one task (in a window that spills).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship

ship(__name__)

#: Parts that the members of a prefix are dealt to before its least member is known.
SALTS = 128
#: Ids that are joined into one run of a digest: distinct ids of a span of this width.
RUN = 4096


def numbered(df: DataFrame, key: str, turn: str, role: str, text: str, group: Column) -> DataFrame:
    """Narrow turns (conv, grp, i, size, a, b): a turn's number from 1, the bytes of its text and its digest in two halves.
    Rows are dealt by `grp`, which must depend on the conversation alone."""
    say = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.length(say(role)).cast("string"), F.lit(":"), say(role), say(text)))
    half = lambda at: F.conv(F.substring(F.col("digest"), at, 16), 16, -10).cast("long")
    t = df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), say(role).alias("role"), F.octet_length(say(text)).cast("long").alias("size"), digest.alias("digest"))
    t = t.select(group.alias("grp"), "conv", "turn", "role", "size", half(1).alias("a"), half(17).alias("b"))
    order = Window.partitionBy("grp", "conv").orderBy(F.col("turn").asc_nulls_first(), "role", "a", "b")
    return t.repartition("grp").withColumn("i", F.row_number().over(order)).select("conv", "grp", "i", "size", "a", "b")


def occurrences(turns: DataFrame) -> DataFrame:
    """(conv, depth, size, last, p, q) of each conversation's prefixes, the root among them: (p, q) names the prefix of that
    depth, `last` is the conversation's depth. turns: (conv, grp, depth, size, a, b), a row of depth 0 for each conversation."""
    w = Window.partitionBy("grp", "conv")
    along = w.orderBy("depth")
    lane = lambda seed: F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "a", "b")).otherwise(F.lit(0).cast("long"))
    t = turns.withColumns({"p": F.bit_xor(lane(1)).over(along), "q": F.bit_xor(lane(2)).over(along), "last": F.max("depth").over(w)})
    return t.select("conv", "depth", "size", "last", "p", "q", F.pmod(F.xxhash64("conv"), F.lit(SALTS)).cast("int").alias("salt"))


def owners(seen: DataFrame) -> DataFrame:
    """The least member of each prefix and the greatest depth that a member reaches, on a row for each (prefix, salt)."""
    node = ["depth", "p", "q"]
    part = seen.groupBy(*node, "salt").agg(F.min("conv").alias("owner"), F.max("last").alias("deepest"))
    w = Window.partitionBy(*node)
    return part.select(*node, "salt", F.min("owner").over(w).alias("owner"), F.max("deepest").over(w).alias("deepest"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, p, q, run, ids), sorted, to one digest a prefix."""
    now, sha, out = None, None, []
    names = ["depth", "p", "q", "ends_sha256"]

    def batch(rows: list) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for b in batches:
        for depth, p, q, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "p", "q", "ids")), strict=True):
            if (depth, p, q) == now:
                sha.update(f",{ids}".encode())
                continue
            if now is not None:
                out.append((*now, sha.hexdigest()))
            now, sha = (depth, p, q), hashlib.sha256(ids.encode())
        if len(out) >= 4096:
            yield batch(out)
            out = []
    if now is not None:
        out.append((*now, sha.hexdigest()))
    if out:
        yield batch(out)


def ends(seen: DataFrame) -> DataFrame:
    """A digest of the ids that end at each prefix, in ascending order, joined by commas. `div` keeps the order of ids."""
    runs = seen.where("depth = last").groupBy("depth", "p", "q", F.expr(f"conv div {RUN}").alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    dealt = runs.repartition("depth", "p", "q").sortWithinPartitions("depth", "p", "q", "run")
    return dealt.mapInArrow(_digests, "depth int, p long, q long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of conversations given as (conv, grp, depth, size, a, b): conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    node = ["depth", "p", "q"]
    seen = materialize(occurrences(turns), "prefixes")
    owned = seen.join(owners(seen), [*node, "salt"])
    along = Window.partitionBy("conv").orderBy("depth")
    below = Window.partitionBy("conv").orderBy(F.desc("depth"))
    mine = F.col("owner") == F.col("conv")
    marked = owned.withColumns({"mine": mine, "parent": F.lag("owner").over(along), "child": F.lag(mine.cast("int"), 1, 0).over(below), "saved": F.sum(F.when(mine, 0).otherwise(F.col("size"))).over(below), "leaf": F.max((mine & (F.col("depth") == F.col("last")) & (F.col("deepest") == F.col("last"))).cast("int")).over(below)})
    nodes = marked.groupBy(*node).agg(F.min("conv").alias("conv_id"), F.max(F.when(F.col("mine"), F.col("parent"))).alias("parent_conv_id"), F.count("*").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    none = F.sha2(F.lit(""), 256)
    return nodes.join(ends(seen), node, "left").select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def conversation_trie(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations of a table of turns, as they are."""
    t = numbered(df, key, turn, role, text, F.col("conv"))
    return trie(_with_roots(t.select("conv", "grp", F.col("i").alias("depth"), "size", "a", "b"), F.col("depth") == 1))


def _with_roots(t: DataFrame, first: Column) -> DataFrame:
    """Adds a row of depth 0 beside the row of each conversation that `first` marks."""
    row = lambda **x: F.struct(*((x.get(c, F.col(c)).cast(k)).alias(c) for c, k in (("depth", "int"), ("size", "long"), ("a", "long"), ("b", "long"))))
    root = row(depth=F.lit(0), size=F.lit(0), a=F.lit(0), b=F.lit(0))
    rows = F.when(first, F.array(root, row())).otherwise(F.array(row()))
    return t.select("conv", "grp", F.explode(rows).alias("r")).select("conv", "grp", "r.*")


def spliced(df: DataFrame, every: int, most: int, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations rebuilt, as `trie` takes them: the first h turns of conversation c - c % every (all if fewer, none if it
    is absent), then c's own turns behind its first h, where h = crc32(decimal c) % most. A conversation may end up without
    turns. All of a family is dealt together; of its base only the first most - 1 turns are copied."""
    t = numbered(df, key, turn, role, text, F.col("conv") - F.col("conv") % every)
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    of_base = (F.col("conv") == F.col("grp")) & (F.col("i") < most)
    head = F.collect_list(F.when(of_base, F.struct("i", "size", "a", "b"))).over(Window.partitionBy("grp"))
    t = t.withColumns({"h": h, "head": F.array_sort(head)})
    taken = F.filter("head", lambda x: x["i"] <= F.col("h"))
    t = t.withColumn("taken", taken).drop("head")
    turn_ = lambda depth, x: F.struct(depth.cast("int").alias("depth"), x("size").alias("size"), x("a").alias("a"), x("b").alias("b"))
    zero = F.lit(0).cast("long")
    root = F.array(F.struct(F.lit(0).alias("depth"), zero.alias("size"), zero.alias("a"), zero.alias("b")))
    shared = F.transform("taken", lambda x: turn_(x["i"], lambda c: x[c]))
    own = F.array(turn_(F.size("taken") + F.col("i") - F.col("h"), F.col))
    rows = F.concat(F.when(F.col("i") == 1, F.concat(root, shared)).otherwise(F.array().cast(TURNS)), F.when(F.col("i") > F.col("h"), own).otherwise(F.array().cast(TURNS)))
    return t.select("conv", "grp", F.explode(rows).alias("r")).select("conv", "grp", "r.*")


TURNS = "array<struct<depth:int,size:bigint,a:bigint,b:bigint>>"
