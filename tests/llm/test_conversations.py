"""Prefix trie, fill-in-the-middle and chat formatting, against plain versions of their contracts."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from allelic.llm import chat_format, fill_in_middle, prefix_trie, queries
from allelic.llm.queries import table

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def by_conversation(rows, text_key=lambda t: t):
    """The turns of each conversation, in the operators' order."""
    out = {}
    for c, n, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", text_key(r[3] or ""))):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def tree(convs):
    """Nodes by definition: (smallest member, depth) to the other columns."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for k, m in members.items():
        below = [u for u in members if u[: len(k)] == k]
        childless = [u for u in below if not any(len(v) == len(u) + 1 and v[: len(u)] == u for v in below)]
        saved = sum((len(members[u]) - 1) * len(u[-1][1].encode()) for u in below if u)
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k))))
        out[min(m), len(k)] = (min(members[k[:-1]]) if k else None, len(m), sum(len(u) == len(k) + 1 for u in below), len(childless), saved, sha(ends))
    return out


def nodes(df):
    rows = df.collect()
    out = {(r[0], r[1]): tuple(r)[2:] for r in rows}
    assert len(out) == len(rows)
    return out


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    return out


def odd_rows():
    """Copies in hundreds, prefixes of each other, nulls, ties, repeated rows, a conversation without its base."""
    rng = random.Random(3)
    say = lambda d: ("user" if d % 2 == 0 else "assistant", f"é{d}{rng.choice('aab')}")
    rows = [(c, d, "user", f"copy {d}") for c in range(100, 420) for d in range(3)]
    for c in [*range(0, 60), 9000, 9003, 9004, 5_000_000_000]:
        rows += [(c, d, *say(d)) for d in range(rng.randrange(1, 14))]
    rows += [(70, None, None, None), (70, None, "user", "x"), (70, 0, "user", ""), (71, 1, "user", "same"), (71, 1, "user", "same"), (None, 0, "user", "lost"), (72, 0, "user", "word " * 40_000)]
    return rows


def test_trie_of_odd_conversations(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("depth", "p", "conv", "grp", "i", "size", "owner", "last")}).repartition(7)
    convs = by_conversation([r for r in rows if r[0] is not None])
    assert nodes(prefix_trie.conversation_trie(df)) == tree(convs)
    got = nodes(prefix_trie.trie(prefix_trie.spliced(df, 5, 9)))
    assert got == tree(rebuilt(convs))
    assert any(v[1] > 320 for v in got.values())


def test_trie_keeps_conversations_without_turns(spark):
    alone = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2][:6]
    rows = [(c, d, "user", str(c)) for c in alone for d in range(2)]
    got = nodes(prefix_trie.trie(prefix_trie.spliced(spark.createDataFrame(rows, TURNS), 5, 9)))
    assert got == {(alone[0], 0): (None, 6, 0, 1, 0, sha(",".join(map(str, alone))))}


def test_runs_of_many_ids_go_through_one_digest_in_order(spark):
    ids = [*range(-9000, 9000, 7), *range(10**12, 10**12 + 9000)]
    df = spark.createDataFrame([(c, 0, "user", "hello") for c in ids], TURNS)
    got = nodes(prefix_trie.conversation_trie(df))
    assert got[min(ids), 1] == (min(ids), len(ids), 0, 1, 5 * (len(ids) - 1), sha(",".join(map(str, ids))))


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert nodes(prefix_trie.conversation_trie(none)) == {} and nodes(prefix_trie.trie(prefix_trie.spliced(none, 5, 9))) == {}


def test_prefix_trie_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(queries.op11_prefix_trie(spark, SF)) == tree(rebuilt(by_conversation(rows)))


def plain_fim(key, text, seed=1, rate=90, spm=20, starts=None):
    n = len(text) if starts is None else len(starts)
    cut = lambda k: (k if starts is None else starts[k] if k < n else len(text))
    digest = sha(f"{seed}:{key}")
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    i, j = (cut(k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    p, m, s = text[:i], text[i:j], text[j:]
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_units_are_cut_where_a_plain_scan_cuts(unit):
    rng = random.Random(5)
    blank = "\t\n\v\f\r "
    begins = {"char": lambda t, i: True, "line": lambda t, i: i == 0 or t[i - 1] == "\n", "word": lambda t, i: i == 0 or (t[i] in blank and t[i - 1] not in blank)}[unit]
    for key in range(3000):
        t = "".join(rng.choice("ab \n\té😀\x00<PSM>") for _ in range(rng.randrange(40)))
        starts = [i for i in range(len(t)) if begins(t, i)]
        got = fill_in_middle.transformed(t.encode(), str(key), seed=7, rate=95, spm=50, unit=unit)
        assert (*got[:4], got[4].decode()) == plain_fim(key, t, 7, 95, 50, starts)


def test_marks_are_found_by_rank():
    text = ("é " * 100_000).encode()
    marks = fill_in_middle.boundaries(text)
    assert [fill_in_middle.nth_mark(marks, len(text), k) for k in (0, 1, 2, 123_456, 199_999, 200_000)] == [0, 2, 3, 185_184, 299_999, 300_000]
    assert fill_in_middle.nth_mark(0, 0, 0) == 0


def test_fill_in_middle_of_odd_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "null key"), (4, "word " * 60_000), (5, "😀" * 50_000), (6, "a <P> b"), (7, "<M>"), (8, "\x00 ﻿ é"), (9, "< S > <S<S")] + [(i, f"ab<S{i}") for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("n", "Form", "prefix_chars", "output", "_fim", "_output"):
        df = df.withColumn(c, F.lit("clash"))
    out = fill_in_middle.fill_in_middle(df, "doc_id", "text")
    assert out.columns[: len(df.columns)] == df.columns and out.columns[-5:] == ["_n", "_form", "_prefix_chars", "middle_chars", "__output"]
    out = out.withColumn("restored", fill_in_middle.restore(F.col("__output"), F.col("_form")))
    got = sorted((tuple(r[c] for c in ("_n", "_form", "_prefix_chars", "middle_chars", "__output", "restored")) for r in out.collect()), key=str)
    want = sorted(((*plain_fim("" if k is None else k, t or ""), t or "") for k, t in rows), key=str)
    assert got == want and {g[1] for g in got} == {"plain", "psm", "spm"}
    assert all(r["n"] == r["Form"] == r["output"] == "clash" for r in out.collect())


def test_fill_in_middle_of_nothing_and_bad_parameters(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fill_in_middle.fill_in_middle(none, "doc_id", "text").count() == 0
    with pytest.raises(ValueError, match="sentinels"):
        fill_in_middle.fill_in_middle(none, "doc_id", "text", sentinels=("<P>", "<P>", "<M>"))
    with pytest.raises(ValueError, match="unit"):
        fill_in_middle.boundaries(b"a", "page")


def test_fill_in_middle_query(spark):
    want = {}
    for r in table(spark, SF, "documents").collect():
        n, form, p, m, output = plain_fim(r["doc_id"], r["text"] or "")
        want[r["doc_id"]] = (n, form, p, m, sha(output), sha(r["text"] or ""))
    assert {r[0]: tuple(r)[1:] for r in queries.op12_fill_in_middle(spark, SF).collect()} == want


def hostile_rows():
    rng = random.Random(11)
    parts = ["\\", "#", "###", "### ", "</turn>", "</turn", "b", "h", "t", "c", ":", ": ", " ", "\n", "<", "é😀", "user"]
    text = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
    rows = [(c, d, rng.choice(["user", "assistant", "system", None, "", text()]), rng.choice([None, "", text(), text()])) for c in range(150) for d in range(rng.randrange(1, 9))]
    rows += [(500, d % 40, "assistant", "tie") for d in range(90)] + [(501, None, "user", "first"), (501, 0, "assistant", "word " * 40_000), (None, 1, "assistant", "no id"), (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    return rows


def test_chats_are_read_back_from_their_formatted_text(spark):
    rows = hostile_rows()
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("conv", "turns", "blocks", "begins", "runs", "formatted", "t")}).repartition(5)
    out = chat_format.format_chats(df)
    assert out.columns == ["conv_id", "formatted", "loss_mask"]
    got = out.withColumns({"t": chat_format.parse(F.col("formatted")), "l": chat_format.under_mask(F.col("formatted"), F.col("loss_mask"))}).collect()
    want = by_conversation(rows)
    assert {r["conv_id"] for r in got} == set(want) and len(got) == len(want)
    escape = lambda s: s.replace("\\", "\\b").replace("###", "\\h").replace("</turn>", "\\t")
    for r in got:
        turns = want[r["conv_id"]]
        assert [tuple(t) for t in r["t"]] == turns
        assert r["l"] == [t for role, t in turns if role == "assistant" and t]
        text, before = "", None
        for role, t in turns:
            text += (" " if role == before else ("\n" if text else "") + f"### {escape(role).replace(':', chr(92) + 'c')}: ") + escape(t) + "</turn>"
            before = role
        assert r["formatted"] == text + "\n"
        assert sum(x["skip"] + x["take"] for x in r["loss_mask"]) <= len(r["formatted"]) and len(r["loss_mask"]) == len(turns)


def test_chats_are_formatted_without_python(spark):
    df = spark.createDataFrame(hostile_rows(), TURNS)
    plan = chat_format.format_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") <= 2
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_format_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()] + queries.HOSTILE
    got = {r["conv_id"]: r for r in queries.op13_chat_format(spark, SF).collect()}
    want = by_conversation(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        learned = "".join(t for role, t in turns if role == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(learned), sha(learned))
