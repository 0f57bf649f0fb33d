"""The queries of this subpackage's operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, chat_format, fill_in_middle, html_extract, lang_id, minhash_dedup, packing, prefix_trie, simhash, token_counts, toxicity, url_filters, vector_join
from .common import discard, fold, materialize, shared_dir, table


RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "template", "purity", "judged_by")


def vocabulary(path: str | None) -> str:
    """A tokenizer file: the public byte-level one unless another is named."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


def op2_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Totals after four batches: all documents under two tokenizers (the vocabulary's tokens, and the words of its split),
    the takedown of documents labelled toxic, revised counts of documents of low quality (an end-of-text token counts now),
    and a batch that is delivered twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    counted = materialize(bpe.token_counts(docs, vocabulary(path)), "counts")
    known = counted.join(labels, "doc_id")
    rollup = token_counts.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    both = lambda df, kind: token_counts.changes(df, kind, F.lit("byte-bpe-50k"), F.col("n_tokens")).unionAll(token_counts.changes(df, kind, F.lit("byte-split"), F.col("n_pieces")))
    takedown = both(known.where("toxic = 1"), "delete")
    rollup.commit("0001", both(counted, "insert"))
    rollup.commit("0002", takedown)
    rollup.compact()
    rollup.commit("0003", token_counts.changes(known.where("quality = 0 and toxic = 0"), "revise", F.lit("byte-bpe-50k"), F.col("n_tokens") + 1, F.col("n_tokens")))
    rollup.commit("0002", takedown)
    discard(counted)
    return rollup.totals()


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word 4-shingles, Jaccard similarity of 0.8 or more."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80).drop("text_hash", "first")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs)
    return lang_id.identify(docs.select("doc_id", "text"), model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


#: The pieces of the byte-level split; a fixed value of the public format, in the words of Java's expressions.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{Z}\p{L}\p{N}]+|[\s\p{Z}]+(?![^\s\p{Z}])|[\s\p{Z}]+"


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths are the numbers of words that the byte-level split gives; the pipeline packs tokens of the vocabulary."""
    return packing.pack(table(spark, sf_dir, "documents"), ["doc_id"], F.regexp_count("text", F.lit(PIECES)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the likenesses: n_within, for rows whose id is divisible by 50 the number of other documents whose
    fingerprint differs in at most three bits, by block tables (null for other rows)."""
    near = simhash.with_next(table(spark, sf_dir, "documents"), "doc_id", "text")
    n, half = F.length("text").cast("long"), F.expr("cast(length(text) div 2 as int)")
    edited = F.when(~F.col("guest"), F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    near = near.select("range", "seat", "guest", "doc_id", n.alias("n_chars"), "text", edited.alias("edited"))
    both = F.array(F.struct(F.lit("").alias("sha"), F.col("text").alias("t")), F.struct(F.sha2("edited", 256).alias("sha"), F.col("edited").alias("t")))
    own = ["range", "seat", "guest", "doc_id", "n_chars"]
    near = near.select(*own, F.explode(F.filter(both, lambda x: x["t"].isNotNull())).alias("x")).select(*own, "x.sha", "x.t")
    # all within a range, so that nothing is shuffled but the texts
    fps = simhash.fingerprints(near, [*own, "sha"], "t")
    in_order = Window.partitionBy("range").orderBy("seat", "sha")  # a text stands before its edited one
    rows = fps.select(*own, "sha", F.col("fingerprint").alias("fp"), F.lead("fingerprint", 1).over(in_order).alias("efp"), F.lead("fingerprint", 2).over(in_order).alias("nfp"), F.lead("sha", 1).over(in_order).alias("edited_sha256"))
    rows = materialize(rows.where("sha = '' and not guest").select("doc_id", "n_chars", "edited_sha256", "fp", "efp", "nfp"), "fingerprints")
    asks = rows.where("doc_id % 50 = 0")
    found = simhash.near_counts(rows.select("fp"), asks.select("fp"), fp="fp").select(F.col("fp").alias("_fp"), F.lit(0).alias("_ask"), (F.col("n_within") - 1).alias("n_within"))
    rows = rows.join(found, (F.col("fp") == F.col("_fp")) & (F.col("doc_id") % 50 == F.col("_ask")), "left")
    return rows.select("doc_id", "n_chars", "edited_sha256", simhash.as_hex(F.col("fp")).alias("fingerprint"), simhash.as_hex(F.col("efp")).alias("edited_fingerprint"), simhash.likeness(F.col("fp"), F.col("efp")).alias("near_edited"), simhash.likeness(F.col("fp"), F.col("nfp")).alias("near_next"), "n_within")


def op9_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op10_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary(path))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations that share up to eight first turns with every fifth one."""
    return prefix_trie.trie(prefix_trie.spliced(table(spark, sf_dir, "conversations"), every=5, most=9))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fill_in_middle.fill_in_middle(docs, "doc_id", "text")
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


#: A conversation that says the template's own control strings.
HOSTILE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame(HOSTILE, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(turns.unionByName(hostile))
    out = out.withColumns({"turns": chat_format.parse(F.col("formatted")), "learned": F.array_join(chat_format.under_mask(F.col("formatted"), F.col("loss_mask")), "")})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_token_counts": op2_token_counts,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_html_extract": op4_html_extract,
    "op5_lang_id": op5_lang_id,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_vector_join": op9_vector_join,
    "op10_bpe": op10_bpe,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_chat_format": op13_chat_format,
}
#: Components of links (x, y) among all nodes (id).
REACH = """
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT id AS a, id AS b FROM nodes WHERE id IN (SELECT x FROM sides) UNION SELECT reach.a, sides.y FROM reach JOIN sides ON reach.b = sides.x),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
nodes AS (SELECT doc_id AS id FROM documents),""" + REACH + """
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN least ON a = d.doc_id
"""

OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
nodes AS (SELECT vec_id AS id FROM embeddings),""" + REACH + """, deg AS (SELECT x, count(*) AS k FROM sides GROUP BY x)
SELECT v.vec_id, coalesce(k, 0) AS n_links, coalesce(component_id, v.vec_id) AS component_id, v.vec_id = coalesce(component_id, v.vec_id) AS kept
FROM v LEFT JOIN deg ON x = v.vec_id LEFT JOIN least ON a = v.vec_id
"""

#: The tree by its definition: nodes are distinct chains of digests, subtrees the chains that begin alike. crc32 goes bit by bit.
OP11_SQL = """
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS i, octet_length(encode(coalesce(text, ''))) AS size, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS h FROM conversations WHERE conv_id IS NOT NULL),
steps AS (SELECT DISTINCT conv_id, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS s FROM conversations WHERE conv_id IS NOT NULL),
cuts AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(s, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END, 4294967295), 4294967295) % 9 AS h FROM steps),
sewn AS (SELECT c.conv_id, 0 AS part, t.i, t.size, t.h FROM cuts c JOIN turns t ON t.conv_id = c.base AND t.i <= c.h UNION ALL SELECT c.conv_id, 1, t.i, t.size, t.h FROM cuts c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h),
path AS (SELECT conv_id, row_number() OVER w AS depth, size, string_agg(h, '') OVER w AS k FROM sewn WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)),
seen AS (SELECT conv_id, depth, size, k FROM path UNION ALL SELECT conv_id, 0, 0, '' FROM cuts),
ended AS (SELECT conv_id, max(depth) AS depth, arg_max(k, depth) AS k FROM seen GROUP BY conv_id),
nodes AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM seen GROUP BY depth, k),
kids AS (SELECT substr(k, 1, 32 * (depth - 1)) AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (SELECT v.k, sum((u.n_convs - 1) * u.size) AS saved, count(*) FILTER (WHERE kids.k IS NULL) AS leaves FROM nodes u LEFT JOIN kids ON kids.k = u.k, LATERAL (SELECT substr(u.k, 1, 32 * CAST(d AS INTEGER)) AS k FROM range(0, u.depth + 1) r(d)) v GROUP BY v.k),
ends AS (SELECT k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM ended GROUP BY k)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN below ON below.k = n.k LEFT JOIN kids ON kids.k = n.k LEFT JOIN ends ON ends.k = n.k LEFT JOIN nodes p ON n.depth > 0 AND p.k = substr(n.k, 1, 32 * (CAST(n.depth AS INTEGER) - 1))
"""

OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256(concat('1:', doc_id)) AS h FROM documents),
e AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM d),
f AS (SELECT *, least(h1, h2) AS i, greatest(h1, h2) AS j, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substr(t, 1, i) AS p, substr(t, i + 1, j - i) AS m, substr(t, j + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM g
"""

OP13_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
u AS (SELECT *, row_number() OVER w = 1 OR lag(role) OVER w <> role AS begins FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
v AS (SELECT *, length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) + CASE WHEN begins THEN 14 + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c')) ELSE 8 END AS chars FROM u)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM v GROUP BY conv_id
"""

ORACLE_SQL: dict[str, str] = {"op3_minhash_dedup": OP3_SQL, "op9_vector_join": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_chat_format": OP13_SQL}
