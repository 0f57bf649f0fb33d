"""Conversations as training text, by relational formatting in Spark expressions only.

The turns of a conversation are collected as structs and sorted; neighbours of the same role are merged by array functions
into one block that keeps its messages apart; and everything is concatenated:

    ### user: first message</turn> second message</turn>
    ### assistant: answer</turn>

Control strings inside a text are replaced, so that they never occur there: a backslash by \\b, ### by \\h, </turn> by \\t,
and in roles a colon by \\c. Each backslash of an escaped text so begins a pair, and replacing the pairs back (the
backslash last) gives the exact text. `parse` reads the turns back out of a formatted text, `under_mask` the texts under
the loss mask; neither needs the turns.

The loss mask is a list of runs (skip, take) over code points, one for each message: `take` is the length of the escaped
message if its role is learned from, and `skip` what lies between it and the run before.

The shuffle moves each text once, to the one row of its conversation. All steps but the reading of a mask are linear in a
conversation's length; a conversation must fit into one row, since its formatted text is one string.

Defined results: turns are ordered by (turn, role, text), null turns first, so that ties have one order and repeated rows
are turns of their own; null and empty roles and texts are empty ones; rows with a null conversation id are one
conversation; texts of any length are formatted whole; an empty table gives an empty one; columns beyond the four named
ones are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template, and what stands for each inside a text. The backslash is replaced first and put back last.
HEAD, END, COLON = "### ", "</turn>", ": "
PAIRS = {"\\": "\\b", "###": "\\h", END: "\\t"}
ROLE_PAIRS = PAIRS | {":": "\\c"}


def escape(c: Column, pairs: dict[str, str] = PAIRS) -> Column:
    for plain, pair in pairs.items():
        c = F.replace(c, F.lit(plain), F.lit(pair))
    return c


def unescape(c: Column, pairs: dict[str, str] = PAIRS) -> Column:
    for plain, pair in reversed(pairs.items()):
        c = F.replace(c, F.lit(pair), F.lit(plain))
    return c


def _text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))


def format_chats(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: its id, `formatted` and `loss_mask`; roles in `learned` are those that a model learns from."""
    rows = df.select(F.col(f"`{key}`").alias("conv"), F.struct(F.col(f"`{turn}`").alias("turn"), _text(role).alias("role"), _text(text).alias("text")).alias("t"))
    turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))  # nulls come first
    turns = turns.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["role"].isin(*learned).alias("learned"), escape(t["text"]).alias("text"))))
    # a block begins where the role changes
    before = lambda i: F.element_at("turns", i)["role"]
    numbers = F.sequence(F.lit(1), F.size("turns"))
    begins = F.filter(numbers, lambda i: F.when(i == 1, True).otherwise(before(F.greatest(i - 1, F.lit(1))) != before(i)))
    blocks = turns.withColumn("begins", F.concat(begins, F.array(F.size("turns") + 1)))
    merged = F.transform(F.slice("begins", F.lit(1), F.size("begins") - 1), lambda at, k: F.struct(F.element_at("turns", at)["role"].alias("role"), F.element_at("turns", at)["learned"].alias("learned"), F.transform(F.slice("turns", at, F.element_at("begins", k + 2) - at), lambda t: t["text"]).alias("texts")))
    blocks = blocks.select("conv", F.transform(merged, lambda b: F.struct(F.concat(F.lit(HEAD), escape(b["role"], ROLE_PAIRS), F.lit(COLON)).alias("head"), b["learned"].alias("learned"), b["texts"].alias("texts"))).alias("blocks"))
    lines = F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(b["texts"], END + " "), F.lit(END + "\n")))
    # behind a block's last message stand its end and the next line's head; between messages of a block an end and a space
    run = lambda b, first: F.transform(b["texts"], lambda x, i: F.struct(F.when(i == 0, F.length(b["head"]) + first).otherwise(len(END) + 1).alias("skip"), F.when(b["learned"], F.length(x)).otherwise(0).alias("take"), F.length(x).alias("chars")))
    runs = F.flatten(F.transform("blocks", lambda b, k: run(b, F.when(k == 0, 0).otherwise(len(END) + 1))))
    mask = blocks.select("conv", F.array_join(lines, "").alias("formatted"), runs.alias("runs"))
    # what isn't learned from belongs to the skip of the next run
    skipped = lambda i: F.when(i == 0, 0).otherwise(F.element_at("runs", F.greatest(i, F.lit(1)))["chars"] - F.element_at("runs", F.greatest(i, F.lit(1)))["take"])
    loss = F.transform("runs", lambda r, i: F.struct((r["skip"] + skipped(i)).alias("skip"), r["take"].alias("take")))
    return mask.select(F.col("conv").alias(key), "formatted", loss.alias("loss_mask"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text, in order."""
    blocks = F.slice(F.split(formatted, HEAD), F.lit(2), F.length(formatted))

    def turns(block: Column) -> Column:
        role = F.substring_index(block, COLON, 1)
        messages = F.split(F.substring(block, F.length(role) + 1 + len(COLON), F.length(block)), END)
        n = F.size(messages) - 1
        return F.transform(F.slice(messages, F.lit(1), n), lambda m, i: F.struct(unescape(role, ROLE_PAIRS).alias("role"), unescape(F.when(i == 0, m).otherwise(F.substring(m, F.lit(2), F.length(m)))).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def under_mask(formatted: Column, loss_mask: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("texts"))
    take = lambda at, r: F.substring(formatted, at + r["skip"] + 1, r["take"])
    step = lambda acc, r: F.struct((acc["at"] + r["skip"] + r["take"]).alias("at"), F.when(r["take"] > 0, F.concat(acc["texts"], F.array(take(acc["at"], r)))).otherwise(acc["texts"]).alias("texts"))
    return F.transform(F.aggregate(loss_mask, start, step)["texts"], lambda t: unescape(t))
