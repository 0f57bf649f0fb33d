import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelic.llm import packing, token_counts, url_filters, vector_join
from allelic.llm.queries import RULES


def test_pack_lengths():
    r = random.Random(3)
    lengths = [r.randint(1, 2048) for _ in range(500)]
    got = packing.pack_lengths(lengths)
    bins = {}
    for n, (b, offset, c) in zip(lengths, got, strict=True):
        bins.setdefault(b, []).append((offset, n, c))
    for items in bins.values():
        items.sort()
        assert all(a + n == b for (a, n, _), (b, _, _) in zip(items, items[1:], strict=False)) and items[0][0] == 0
        used = sum(n for _, n, _ in items)
        assert {c for _, _, c in items} == {next(c for c in packing.CAPACITIES if c >= used)}
    assert sum(lengths) / sum(x[0][2] for x in bins.values()) > 0.93


def test_pack_table(spark):
    r = random.Random(4)
    rows = [(i, r.choice([0, 1, 50, 300, 2048, 5000, 9000])) for i in range(400)] + [(7, 50), (None, 20), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, n long")
    got = packing.pack(df, ["doc_id"], F.col("n")).collect()
    assert sum(x["length"] for x in got) == sum(n or 0 for _, n in rows)
    assert all((x["bin_id"] is None) == (x["length"] == 0) for x in got)
    used = {}
    for x in got:
        if x["length"]:
            assert x["offset"] + x["length"] <= x["capacity"]
            used.setdefault(x["bin_id"], []).append((x["offset"], x["length"]))
    for items in used.values():
        items.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(items, items[1:], strict=False))
    assert packing.pack(df.limit(0), ["doc_id"], F.col("n")).count() == 0


def vectors(seed=5, dim=24):
    g = np.random.default_rng(seed)
    x = list(g.normal(size=(150, dim)))
    base = g.normal(size=dim)
    x += [base + 0.15 * g.normal(size=dim) for _ in range(60)]
    x += [base * 2] * 5 + [x[0]] * 3
    return [list(map(float, np.float32(v))) for v in x]


@pytest.mark.parametrize(("block", "cell"), [(2048, 32), (16, 40), (64, 5)])
def test_vector_join_is_exact(spark, monkeypatch, block, cell):
    monkeypatch.setattr(vector_join, "BLOCK", block)
    monkeypatch.setattr(vector_join, "CELL", cell)
    x = vectors()
    odd = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [1.0] * 7, [2.0] * 7]
    rows = list(enumerate(x + odd))
    got = {r["vec_id"]: r for r in vector_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()}
    good = {i: np.array(v, float) for i, v in rows if v and all(a is not None and np.isfinite(a) for a in v) and any(v)}
    link = {i: {j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.9} for i in good}
    for i, _ in rows:
        assert got[i]["n_links"] == len(link.get(i, ()))
        seen, todo = {i}, [i]
        while todo:
            for j in link.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i]["component_id"] == min(seen) and got[i]["kept"] == (i == min(seen))


def test_vector_join_of_clusters_at_its_own_sizes(spark):
    """Some thousands of vectors, a third of them copies of one, in clusters with many links, and the blocks of the query."""
    g = np.random.default_rng(2)
    centres = g.normal(size=(50, 64))
    x = np.float32(centres[g.integers(0, 50, 3500)] + 0.32 * g.normal(size=(3500, 64)))
    x = np.concatenate([x, g.normal(size=(700, 64)).astype(np.float32), np.repeat(x[:1], 2000, 0)])
    x = x[g.permutation(len(x))]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    least = np.arange(len(x))
    while True:  # the least id spreads along links
        new = np.minimum(least, np.where(near, least[None], len(x)).min(1))
        if (new == least).all():
            break
        least = new
    got = vector_join.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (int(near[i].sum()), int(least[i])) for i in range(len(x))}
    assert near.sum() > 20000
    # most comparisons between clusters are excluded, and some between vectors in all directions
    assert vector_join.pruned_share(x[: 3000].tolist()) > 0.5


def test_vectors_with_one_hash(spark, monkeypatch):
    """Different vectors whose hashes collide stay apart."""
    real = F.xxhash64
    monkeypatch.setattr(vector_join.F, "xxhash64", lambda *c: real(*c) if len(c) > 1 else real(*c).bitwiseAND(F.lit(3)))
    x = vectors()
    got = {r["vec_id"]: r["n_links"] for r in vector_join.near_vectors(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>")).collect()}
    u = vector_join.unit(x)
    assert got == {i: int((u @ u[i] >= 0.9).sum()) - 1 for i in range(len(x))}


def test_vector_join_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert vector_join.near_vectors(df).count() == 2
    assert vector_join.near_vectors(df.limit(0)).count() == 0


def judge(url, rules=RULES):
    """The rules by hand."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = tail[: min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://", "HTTP://A.Com", "http://a.com/", "http://example.com/en/1", "http://WWW.example.com/en/1?x=1", "https://m.example.com/en/2#top", "http://notexample.com/en/", "http://com/x", "http://a.net/es/1", "http://net/fr/", "http://x.org/a/b", "http://a.net?q=/es/", "http://a.net#f", "ftp://b.net/ES/", "x://y.com://z/en/", "http://a.com/a\nb?c"]
    rows = [(i, u) for i, u in enumerate(urls)]
    got = url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("template", F.lit("clash")), RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule = judge(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r["url"]
        assert r["verdict"] == (RULES[rule] if rule else r["verdict"]) and r["verdict"] in ("allow", "block")


def test_url_templates(spark):
    """A path that is blocked wherever it is labelled is rejected by its template where no rule judges."""
    urls = [f"http://s.org/spam/{i}" for i in range(60)] + [f"http://s.org/spam/x{i}" for i in range(40)] + [f"http://s.org/news/{i}" for i in range(60)]
    rules = {f"s.org/spam/{i}": "block" for i in range(1, 8)} | {f"s.org/news/{i}": "allow" for i in range(1, 8)}
    got = {r["url"]: r for r in url_filters.filter_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), rules).collect()}
    assert got["http://s.org/spam/0"]["verdict"] == "block" and got["http://s.org/spam/0"]["rule"] is None
    assert got["http://s.org/news/0"]["verdict"] == "allow"
    assert got["http://s.org/spam/x1"]["verdict"] == "block" and got["http://s.org/spam/x1"]["judged_by"] == "template"


def judged_by_hand(urls, rules):
    """The whole method on a few urls, in plain Python: (verdict, judged by, purity) of each."""
    def kinds(seg):
        seg = re.sub(r"^[0-9]+(?=$|\.[A-Za-z]{1,5}$)", "{n}", seg)
        return re.sub(r"^(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F-]{8,}(?=$|\.[A-Za-z]{1,5}$)", "{h}", seg)

    rows = []
    for u in urls:
        host, path, rule = judge(u, rules)
        rows.append((host, tuple(kinds(x) for x in path.split("/") if x), rule))
    paths = {}
    for host, typed, rule in rows:
        n, k, b = paths.get((host, typed), (0, 0, 0))
        paths[host, typed] = (n + 1, k + (rule is not None), b + (rule is not None and rules[rule] == "block"))
    template, done = {p: () for p in paths}, set()
    for d in range(max((len(t) for _, t in paths), default=0)):
        nodes, rests = {}, {}
        for (host, typed), (n, _, _) in paths.items():
            if (host, typed) not in done:
                at = (host, template[host, typed])
                rests.setdefault(at, set()).add(typed[d:])
                if len(typed) > d:
                    nodes.setdefault(at, {}).setdefault(typed[d], []).append(n)
        wild = {x for x, kids in nodes.items() if len(kids) > url_filters.CHILDREN or (len(kids) > url_filters.FEW and len(kids) > url_filters.SHARE * sum(map(sum, kids.values())))}
        for host, typed in paths.keys() - done:
            at = (host, template[host, typed])
            if len(rests[at]) == 1:  # what nothing beside it differs from is one last element
                done.add((host, typed))
                template[host, typed] = (*at[1], *(["/".join(typed[d:])] if len(typed) > d else []))
            elif len(typed) > d:
                template[host, typed] = (*at[1], "*" if at in wild else typed[d])
            if len(typed) <= d + 1:
                done.add((host, typed))
    deepest = max((len(template[p]) for p, x in paths.items() if x[1]), default=0)
    for d in range(deepest, 0, -1):
        branch = {}
        for p, (_, k, b) in paths.items():
            if len(template[p]) >= d and k:
                x = branch.setdefault((p[0], template[p][: d - 1]), {}).setdefault(template[p][d - 1], [0, 0])
                x[0], x[1] = x[0] + k, x[1] + b
        alike = set()
        for up, kids in branch.items():
            all_k, all_b = (sum(x[i] for x in kids.values()) for i in (0, 1))
            r = all_b / all_k
            alike |= {(*up, s) for s, (k, b) in kids.items() if k < all_k and abs(b / k - r) <= url_filters.Z * (r * (1 - r) / k) ** 0.5 + 1e-12}
        for p in paths:
            t = template[p]
            if len(t) >= d and (p[0], t[: d - 1], t[d - 1]) in alike:
                template[p] = (*t[: d - 1], "*", *t[d:])
    total_k, total_b = sum(x[1] for x in paths.values()), sum(x[2] for x in paths.values())
    sums = {}
    for p, (_, k, b) in paths.items():
        for d in range(len(template[p]) + 1):
            x = sums.setdefault((p[0], template[p][:d]), [0, 0])
            x[0], x[1] = x[0] + k, x[1] + b
    out = []
    for host, typed, rule in rows:
        t = template[host, typed]
        purity = total_b / total_k if total_k else 0.0
        for d in range(len(t) + 1):
            k, b = sums[host, t[:d]]
            if k:
                purity = (b + url_filters.PRIOR * purity) / (k + url_filters.PRIOR)
        known = sums[host, ()][0] >= url_filters.LABELS
        own = "block" if known and purity >= url_filters.PURITY else "allow"
        out.append((rules[rule] if rule else own, "rule" if rule else "template" if known else "nothing", round(purity, 9), "/" + "/".join(t)))
    return out


def test_url_tree_against_brute_force(spark):
    r = random.Random(11)
    parts = ["spam", "news", "a", "b", "c", "en", "de", "x.html"]
    urls = []
    for _ in range(900):
        n = r.choice([0, 1, 1, 2, 2, 3, 4, 7])
        segs = [r.choice(parts) if r.random() < 0.7 else str(r.randint(0, 999)) if r.random() < 0.5 else f"u{r.randint(0, 60)}" for _ in range(n)]
        urls.append(f"http://{r.choice(['h', 'i', 'j', 'k.h'])}.org/" + "/".join(segs))
    urls += ["http://h.org/" + "/".join(f"s{i}" for i in range(400)), "http://h.org/" + "/".join(f"s{i}" for i in range(3)), None, ""]
    rules = {"h.org/spam/": "block", "h.org/news": "allow", "i.org/a": "block", "i.org/b/c": "allow", "k.h.org/": "block", "h.org/a/b/c/d": "block"}
    got = {x["i"]: (x["verdict"], x["judged_by"], round(x["purity"], 9), x["template"]) for x in url_filters.filter_urls(spark.createDataFrame(list(enumerate(urls)), "i int, url string").repartition(3), rules).collect()}
    want = judged_by_hand(urls, rules)
    assert [got[i] for i in range(len(urls))] == want
    assert {x[1] for x in want} == {"rule", "template", "nothing"} and {x[0] for x in want if x[1] == "template"} == {"allow", "block"}


def test_url_columns_and_empty_tables(spark):
    """Columns of any name pass through, but for those of the results."""
    df = spark.createDataFrame([(1, "http://h.org/a", "k", "t", "h", "y"), (1, "http://h.org/a", "k", "t", "h", "y"), (2, None, None, None, None, None)], "page_id int, url string, _k string, _t string, _host string, `_typed` string").withColumn("verdict", F.lit(3))
    got = url_filters.filter_urls(df, RULES)
    assert got.columns == ["page_id", "url", "_k", "_t", "_host", "_typed", "host", "path", "rule", "verdict", "template", "purity", "judged_by"]
    assert sorted((x["page_id"], x["_k"], x["_typed"], x["verdict"]) for x in got.where("page_id = 1").collect()) == [(1, "k", "y", "allow")] * 2
    assert got.count() == 3 and url_filters.filter_urls(df.limit(0), RULES).count() == 0
    assert url_filters.filter_urls(df, {}).where("verdict = 'allow'").count() == 3


def test_url_branches_merge_whole(spark):
    """Unlabelled paths go with their branch, and branches with children merge too."""
    urls = [f"http://s.org/u{i}/{x}" for i in range(60) for x in ("spam", "scam")] + [f"http://t.org/user/{x}/{i}" for x in ("ann", "bob") for i in range(8)]
    rules = {f"s.org/u{i}/{x}": "block" for i in range(1, 10) for x in ("spam", "scam")} | {f"t.org/user/{x}/{i}": "block" for x in ("ann", "bob") for i in range(1, 5)}
    got = {r["url"]: r for r in url_filters.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert got["http://s.org/u0/spam"]["rule"] is None and got["http://s.org/u0/spam"]["verdict"] == "block"
    assert {got[f"http://t.org/user/{x}/0"]["template"] for x in ("ann", "bob")} == {"/user/*/{n}"}
    assert got["http://t.org/user/ann/0"]["verdict"] == "block"


def test_rollup(spark, tmp_path):
    df = spark.createDataFrame([("a", "en", 3), ("a", "en", 4), ("b", None, 5)], "source string, lang string, n long")
    r = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    add = token_counts.changes(df, "insert", F.lit("v1"), F.col("n"))
    assert r.totals().count() == 0
    assert r.commit("1", add) and not r.commit("1", add)
    assert r.commit("2", token_counts.changes(df.where("n = 4"), "revise", F.lit("v1"), F.lit(10), F.col("n")))
    r.compact()
    assert not r.commit("2", add)
    assert r.commit("3", token_counts.changes(df.where("lang is null"), "delete", F.lit("v1"), F.col("n")))
    assert r.commit("4", add.limit(0))
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 2, 13)]
    r.compact()
    assert [tuple(x) for x in r.totals("source").collect()] == [("a", 2, 13)]
    assert r.committed() == {"1", "2", "3", "4"}
    with pytest.raises(ValueError):
        r.commit("no/slash", add)
