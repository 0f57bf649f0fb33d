"""URL filters: host rules first, then a tree of path templates for each host.

Rules `host/path` fit their host and its subdomains where the url's path starts with the rule's path; the longest wins.
The urls that a rule judges are the labelled rows. For each host, path segments become typed (numbers, hashes), and below
each node of the tree segments that vary are generalised into a wildcard, level by level, as deep as paths go. Sibling
branches whose labelled rates differ from their parent's by no more than chance merge into it.

A template's purity is the share of blocked labels in it, drawn towards the purity of the templates above it, from the host
down; the labels of what stands above are evidence for it too. A template is rejected if there is enough evidence on its
way and its purity reaches a bound. So a host whose labelled branches are nearly all blocked loses its unlabelled ones, and
a template with allowed labels of its own outweighs its host.

Everything after the first aggregate works on distinct (host, typed path) pairs, so a host with a third of all rows costs
what its distinct templates cost; what is joined back is a row for each such pair. A path leaves the walk as soon as nothing
beside it differs, so that levels are few even where paths are long.

Defined results: a null url and one without `://` have an empty host and path, no rule, and are allowed. Very long urls and
paths are read whole. Repeated rows stay. Ties between rules of one length can't be: two such rules never fit one url with
the same host and path, except as the same rule. Columns named like the results (host, path, rule, verdict, template,
purity) give way to them; all others pass through, whatever their names.

An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, materialize

#: Distinct children of a node, by which its segments count as varying: so many, or so large a share of its urls.
CHILDREN, SHARE, FEW = 24, 0.5, 4
#: Labels that a template needs on its way, weight of the template above it, and purity from which it is rejected.
LABELS, PRIOR, PURITY = 5, 4.0, 0.8
#: Standard errors within which a branch's rate is its parent's.
Z = 1.96


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: str, h: Column, p: Column) -> Column:
    name, _, rest = rule.partition("/")
    return ((h == name) | h.endswith("." + name)) & p.startswith("/" + rest)


def judge(h: Column, p: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        out = F.when(fits(rule, h, p), F.lit(rule)).otherwise(out)
    return out


def typed(p: Column) -> Column:
    """A path's segments, with numbers and hashes replaced by their kind."""

    def kind(s):
        s = F.regexp_replace(s, r"^[0-9]+(?=$|\.[A-Za-z]{1,5}$)", "{n}")
        return F.regexp_replace(s, r"^(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F-]{8,}(?=$|\.[A-Za-z]{1,5}$)", "{h}")

    return F.transform(F.filter(F.split(p, "/"), lambda s: s != ""), kind)


def generalise(paths: DataFrame) -> DataFrame:
    """paths: host, typed, n, labelled, blocked. Adds template (array): varying segments are `*`, level by level. A path is
    done where it ends, or where all paths of its node go on alike: what is left of it is the template's last element. So
    there are as many levels as different paths of a host agree in, and one more."""
    active, done, d = paths.withColumn("template", F.expr("cast(array() as array<string>)")), None, 0
    while True:
        rest = F.slice("typed", F.lit(d + 1), F.greatest(F.size("typed"), F.lit(1)))
        t = active.withColumns({"_s": F.get("typed", F.lit(d)), "_rest": F.array_join(rest, "/")}).withColumn("_h", F.xxhash64("_rest"))
        kids = t.groupBy("host", "template", "_s").agg(F.sum("n").alias("n"), F.min("_h").alias("lo"), F.max("_h").alias("hi"))
        nodes = kids.groupBy("host", "template").agg(F.count("_s").alias("kids"), F.sum(F.when(F.col("_s").isNotNull(), F.col("n"))).alias("urls"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        wild = (F.col("kids") > CHILDREN) | ((F.col("kids") > FEW) & (F.col("kids") > SHARE * F.col("urls")))
        nodes = nodes.select("host", "template", F.coalesce(wild, F.lit(False)).alias("_wild"), (F.col("lo") == F.col("hi")).alias("_alike"))
        more = F.when(F.col("_s").isNull(), F.array().cast("array<string>")).when(F.col("_alike"), F.array("_rest")).otherwise(F.array(F.when(F.col("_wild"), F.lit("*")).otherwise(F.col("_s"))))
        t = t.join(nodes.hint("merge"), ["host", "template"]).withColumns({"template": F.concat("template", more), "_done": F.col("_alike") | (F.size("typed") <= d + 1)})
        t = materialize(t.drop("_s", "_rest", "_h", "_wild", "_alike"), "level")
        own = t.where("_done").drop("_done")
        done = own if done is None else done.unionAll(own)
        active, d = t.where("not _done").drop("_done"), d + 1
        if active.isEmpty():
            return done


def merge(t: DataFrame) -> DataFrame:
    """Replaces a branch's segment by `*` in every template that passes through it, where the branch's labelled rate is,
    within chance, that of all branches of its parent; from the deepest level up. Branches without labels stay as they are."""
    depth = t.where("labelled > 0").agg(F.coalesce(F.max(F.size("template")), F.lit(0))).first()[0]
    for d in range(depth, 0, -1):
        through = F.size("template") >= d
        at = t.withColumns({"_up": F.when(through, F.slice("template", 1, d - 1)), "_s": F.get("template", F.lit(d - 1))})
        branch = at.where(through & (F.col("labelled") > 0)).groupBy("host", "_up", "_s").agg(F.sum("labelled").alias("k"), F.sum("blocked").alias("b"))
        parent = branch.groupBy("host", "_up").agg(F.sum("k").alias("all_k"), F.sum("b").alias("all_b"))
        rate = F.col("all_b") / F.col("all_k")
        alike = branch.join(parent, ["host", "_up"]).where(F.abs(F.col("b") / F.col("k") - rate) <= Z * F.sqrt(rate * (1 - rate) / F.col("k")) + 1e-12)
        alike = alike.where(F.col("k") < F.col("all_k")).select("host", "_up", "_s", F.lit(True).alias("_alike"))
        alike = materialize(alike, "alike")
        if alike.isEmpty():
            continue
        merged = F.concat("_up", F.array(F.lit("*")), F.slice("template", F.lit(d + 1), F.greatest(F.lit(1), F.size("template"))))
        t = at.join(alike, ["host", "_up", "_s"], "left").withColumn("template", F.when(F.col("_alike"), merged).otherwise(F.col("template"))).drop("_alike", "_up", "_s")
        t = materialize(t, "level")
    return t


def purities(t: DataFrame) -> DataFrame:
    """purity and evidence of each (host, template): the labels that stand on its way, at the host, and at each level. The
    sums are of whole branches; each level's purity is drawn towards the one above it, the host's towards the table's."""
    total = float(t.agg(F.coalesce(F.sum("blocked") / F.nullif(F.sum("labelled"), F.lit(0)), F.lit(0.0))).first()[0])
    own = t.groupBy("host", "template").agg(F.sum("labelled").alias("_k"), F.sum("blocked").alias("_b"))
    # a node for each beginning of a template; the templates of a path without labels add nothing to sums
    at = lambda df: df.select("host", "template", "_k", "_b", F.explode(F.sequence(F.lit(0), F.size("template"))).alias("_d")).withColumn("_up", F.expr("slice(template, 1, _d)"))
    sums = at(own.where("_k > 0")).groupBy("host", "_up").agg(F.sum("_k").alias("_sk"), F.sum("_b").alias("_sb"))
    levels = at(own).join(sums, ["host", "_up"]).groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("_d", "_sk", "_sb"))).alias("_path"))
    purity = F.aggregate("_path", F.lit(total), lambda up, x: (x["_sb"] + PRIOR * up) / (x["_sk"] + PRIOR))
    known = levels.select("host", "template", purity.alias("purity"), F.get("_path", F.lit(0))["_sk"].alias("evidence"))
    return own.select("host", "template").join(known, ["host", "template"], "left").select("host", "template", F.coalesce("purity", F.lit(total)).alias("purity"), F.coalesce("evidence", F.lit(0)).alias("evidence"))


def filter_urls(pages: DataFrame, rules: dict[str, str], url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict, template and purity (of the template), and judged_by: rule, template (one with
    labels on its way), or nothing."""
    results = ("host", "path", "rule", "verdict", "template", "purity", "judged_by")
    kept = [c for c in pages.columns if c.lower() not in results]
    mark = free_name(pages.columns, "_typed")
    source = F.col(f"`{url}`")
    rows = pages.select(*(F.col(f"`{c}`") for c in kept), host(source).alias("host"), path(source).alias("path"))
    rows = rows.withColumn("rule", judge(F.col("host"), F.col("path"), rules)).withColumn(mark, typed(F.col("path")))
    blocked = F.coalesce(F.col("rule").isin([r for r, v in rules.items() if v == "block"]), F.lit(False))
    paths = rows.groupBy("host", F.col(mark).alias("typed")).agg(F.count("*").alias("n"), F.sum(F.col("rule").isNotNull().cast("long")).alias("labelled"), F.sum(blocked.cast("long")).alias("blocked"))
    t = merge(generalise(materialize(paths, "paths")))
    names = [free_name(rows.columns, c) for c in ("_host", "_t", "_k")]
    judged = t.join(purities(t), ["host", "template"]).select(F.col("host").alias(names[0]), F.col("typed").alias(names[1]), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity", F.col("evidence").alias(names[2]))
    judged = materialize(judged, "judged")
    out = rows.join(judged, (rows["host"] == judged[names[0]]) & (rows[mark] == judged[names[1]]), "left")
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    known = F.col(names[2]) >= LABELS
    own = F.when(known & (F.col("purity") >= PURITY), F.lit("block")).otherwise(F.lit("allow"))
    by = F.when(F.col("rule").isNotNull(), F.lit("rule")).when(known, F.lit("template")).otherwise(F.lit("nothing"))
    return out.withColumns({"verdict": F.coalesce(by_rule, own), "judged_by": by}).select(*(F.col(f"`{c}`") for c in kept), *results)
