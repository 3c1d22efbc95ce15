"""Queries of retrieval, similarity joins and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as T
from quillgraph.operators import retrieval as R
from quillgraph.operators import similarity as X
from quillgraph.plans import sqltext as S
from quillgraph.plans.registry import query
from quillgraph.runtime import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.content_tokens(T.normalize(F.coalesce("text", F.lit("")))).alias("tokens"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.content_tokens(T.normalize(F.coalesce("text", F.lit("")))).alias("tokens"))


_TOKENS = f"""
WITH d AS (SELECT doc_id, {S.content_tokens(S.normalized("coalesce(text, '')"))} AS t FROM documents), q AS (SELECT item_id, {S.content_tokens(S.normalized("coalesce(text, '')"))} AS t FROM benchmark)
"""


@query("token_df", _TOKENS + """
, c AS (SELECT doc_id, unnest(t) AS token FROM d), f AS (SELECT doc_id, token, count(*) AS tf FROM c GROUP BY ALL)
SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, CAST(max(tf) AS BIGINT) AS max_tf FROM f GROUP BY token
""")  # fmt: skip
def token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and collection frequency of every token (O122)."""
    return R.token_counts(_docs(spark, sf_dir), "doc_id", "tokens").groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


_BM25 = _TOKENS + """
, n AS (SELECT count(*) AS n, avg(len(t)) AS al FROM d), w AS (SELECT item_id, unnest(list_distinct(t)) AS token FROM q),
c AS (SELECT doc_id, len(t) AS l, unnest(t) AS token FROM d), f AS (SELECT doc_id, l, token, count(*) AS tf FROM c WHERE token IN (SELECT token FROM w) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM f GROUP BY token),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))), 6) AS score FROM w JOIN f USING (token) JOIN df USING (token), n GROUP BY ALL),
bm AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10)
"""


@query("bm25_topk", _BM25 + "SELECT item_id, doc_id, score, rank FROM bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of each benchmark item by BM25 over one field (O134, O135)."""
    return R.bm25(_docs(spark, sf_dir), _queries(spark, sf_dir), "doc_id", "item_id", "tokens", 10).select("item_id", "doc_id", "score", "rank")


_GOLD_SQL = """, gold AS (SELECT b.item_id, d.doc_id, 2 AS grade FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's whole text: found by a word inside it, then checked.

    The words between a passage's first and last stand whole in a document that holds it, whatever the white space, so its longest one is looked
    up. Passages without such a word are few words long; they are a stated list that each document is checked against.
    """
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = lambda c: F.filter(F.split(F.col(c), r"\s+"), lambda x: x != "")
    inner = F.when(F.size(words("passage")) > 2, F.slice(words("passage"), F.lit(2), F.size(words("passage")) - 2)).otherwise(F.array().cast("array<string>"))
    keyed = bench.where("passage <> ''").withColumn("key", F.try_element_at(F.transform(F.array_sort(F.transform(inner, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w")))), lambda y: y["w"]), F.lit(1)))
    keys = keyed.where("key is not null").select("item_id", "key")
    seen = docs.select("doc_id", F.explode(F.array_distinct(words("text"))).alias("key")).join(keys.select("key").distinct(), "key", "left_semi")
    found = seen.join(keys, "key").select("item_id", "doc_id").distinct()
    short = [(r["item_id"], r["passage"]) for r in keyed.where("key is null").select("item_id", "passage").collect()]  # items of two words at most
    if short:
        held = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(p)), F.lit(i)) for i, p in short]))
        found = found.unionByName(docs.select(F.explode(held).alias("item_id"), "doc_id"))
    checked = found.join(docs, "doc_id").join(bench, "item_id").where(F.contains("text", "passage"))
    return checked.select("item_id", "doc_id", F.lit(2).alias("grade"))


@query("ir_metrics", _BM25 + _GOLD_SQL + """
, rel AS (SELECT item_id, count(*) AS relevant FROM gold GROUP BY item_id), k AS (SELECT unnest([1, 5, 10]) AS k),
h AS (SELECT bm.item_id, rank, coalesce(grade, 0) AS grade, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY bm.item_id ORDER BY rank) AS so_far FROM bm LEFT JOIN gold USING (item_id, doc_id)),
a AS (SELECT item_id, k, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) AS found, min(CASE WHEN grade > 0 THEN rank END) AS first, sum(CASE WHEN grade > 0 THEN so_far / CAST(rank AS DOUBLE) END) AS ap, sum(grade / log2(rank + 1)) AS dcg FROM h, k WHERE rank <= k GROUP BY ALL),
i AS (SELECT item_id, k, sum(2 / log2(p + 1)) AS ideal FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS p FROM gold), k WHERE p <= k GROUP BY ALL)
SELECT rel.item_id, k.k, CAST(coalesce(found, 0) > 0 AS DOUBLE) AS hit, round(coalesce(found, 0) / CAST(k.k AS DOUBLE), 6) AS precision, round(coalesce(found, 0) / CAST(relevant AS DOUBLE), 6) AS recall,
  round(coalesce(2.0 * found / (k.k + relevant), 0), 6) AS f1, round(coalesce(1.0 / first, 0), 6) AS mrr, round(coalesce(ap / least(relevant, k.k), 0), 6) AS map, round(coalesce(dcg / ideal, 0), 6) AS ndcg
FROM rel CROSS JOIN k LEFT JOIN a USING (item_id, k) LEFT JOIN i USING (item_id, k)
""")  # fmt: skip
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval metrics of BM25 against the documents that hold the passage (O119)."""
    m = R.ranking_metrics(bm25_topk(spark, sf_dir), _gold(spark, sf_dir), "item_id", "doc_id", (1, 5, 10))
    return m.select("item_id", "k", *[F.round(c, 6).alias(c) for c in ("hit", "precision", "recall", "f1", "mrr", "map", "ndcg")])


@query("gold_misses", _BM25 + _GOLD_SQL + """
SELECT g.item_id, g.doc_id FROM gold g ANTI JOIN (SELECT * FROM bm WHERE rank <= 1) bm ON bm.item_id = g.item_id AND bm.doc_id = g.doc_id
""")
def gold_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant documents that the first place of the ranking lacks, by an anti join (O121)."""
    return _gold(spark, sf_dir).join(bm25_topk(spark, sf_dir).where("rank <= 1"), ["item_id", "doc_id"], "left_anti").select("item_id", "doc_id")


_DENSE = """
WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e, label FROM embeddings), q AS (SELECT vec_id AS query_id, e FROM v WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, round(list_dot_product(q.e, v.e), 6) AS score FROM q JOIN v ON vec_id <> query_id),
dn AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10)
"""


@query("cosine_topk", _DENSE + "SELECT query_id, vec_id, score, rank FROM dn")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of the query set (ids divisible by 20) among all rows (O134, O182)."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.dense_top_k(v, q, "vec_id", "query_id", "embedding", 10).select("query_id", "vec_id", "score", "rank")


_LEX = """, lx AS (SELECT * FROM (SELECT q.query_id, v.vec_id, CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY abs(v.vec_id - q.query_id), v.vec_id) AS INTEGER) AS rank FROM q JOIN v ON v.vec_id BETWEEN q.query_id - 10 AND q.query_id + 10 AND v.vec_id <> q.query_id) WHERE rank <= 10)
, f AS (SELECT coalesce(lx.query_id, dn.query_id) AS query_id, coalesce(lx.vec_id, dn.vec_id) AS vec_id, lx.rank AS lr, dn.rank AS dr, round(coalesce(1.0 / (60 + lx.rank), 0) + coalesce(1.0 / (60 + dn.rank), 0), 8) AS score FROM lx FULL OUTER JOIN dn ON lx.query_id = dn.query_id AND lx.vec_id = dn.vec_id),
rrf AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dr NULLS LAST, lr NULLS LAST, vec_id) AS INTEGER) AS rank FROM f)"""


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second ranking: neighbours by id."""
    v = table(spark, sf_dir, "embeddings").select("vec_id")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    near = q.select("query_id", F.explode(F.sequence(F.col("query_id") - 10, F.col("query_id") + 10)).alias("vec_id")).join(v, "vec_id").where("vec_id <> query_id")
    w = Window.partitionBy("query_id").orderBy(F.abs(F.col("vec_id") - F.col("query_id")), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


@query("rrf_fusion", _DENSE + _LEX + "SELECT query_id, vec_id, score, rank FROM rrf")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of two rankings."""
    return R.reciprocal_rank_fusion(_lexical(spark, sf_dir), cosine_topk(spark, sf_dir), "query_id", "vec_id").select("query_id", "vec_id", "score", "rank")


@query("rerank_join", _DENSE + """
, r AS (SELECT query_id, vec_id, rank AS new_rank FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS rank FROM dn WHERE vec_id % 2 = 0))
SELECT dn.query_id, dn.vec_id, dn.rank AS base_rank, CAST(row_number() OVER (PARTITION BY dn.query_id ORDER BY new_rank NULLS LAST, dn.rank) AS INTEGER) AS rank FROM dn LEFT JOIN r USING (query_id, vec_id)
""")  # fmt: skip
def rerank_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranked rows first, the rest in base order."""
    base = cosine_topk(spark, sf_dir)
    new = base.where("vec_id % 2 = 0").select("query_id", "vec_id", F.row_number().over(Window.partitionBy("query_id").orderBy("vec_id")).alias("rank"))
    return R.rerank(base, new, "query_id", "vec_id").select("query_id", "vec_id", "base_rank", "rank")


@query("macro_average", """
WITH m AS (SELECT l.doc_id, d.lang, d.source, CAST(l.quality AS DOUBLE) AS a, CASE WHEN l.toxic = 1 THEN NULL ELSE 1.0 END AS b FROM labels l JOIN documents d USING (doc_id))
SELECT lang, source, count(*) AS n, round(avg(coalesce(a, 0)), 6) AS quality, round(avg(coalesce(b, 0)), 6) AS clean FROM m GROUP BY ROLLUP (lang, source)
""")
def macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of metrics (missing counts as 0), overall and by slice (O120)."""
    m = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    clean = F.when(F.col("toxic") != 1, 1.0)
    return m.rollup("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(F.col("quality").cast("double"), F.lit(0.0))), 6).alias("quality"), F.round(F.avg(F.coalesce(clean, F.lit(0.0))), 6).alias("clean"))


_PREDICTED = "CASE WHEN contains(coalesce(d.text, ''), '|') OR contains(coalesce(d.text, ''), '!!') OR contains(coalesce(d.text, ''), '%%%') THEN 0 ELSE 1 END"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    rule = F.when(F.contains(t, F.lit("|")) | F.contains(t, F.lit("!!")) | F.contains(t, F.lit("%%%")), 0).otherwise(1)
    docs = table(spark, sf_dir, "documents").select("doc_id", rule.alias("predicted"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("quality").alias("gold"), "predicted")


@query("classifier_confusion", f"SELECT quality AS gold, {_PREDICTED} AS predicted, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL")
def classifier_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts of a rule against labels (O125)."""
    return R.confusion(_predicted(spark, sf_dir), "gold", "predicted")


@query("classifier_scores", f"""
WITH p AS (SELECT quality AS gold, {_PREDICTED} AS predicted FROM labels l JOIN documents d USING (doc_id)), u AS (SELECT unnest([0, 1]) AS label),
c AS (SELECT label, sum(CASE WHEN gold = label AND predicted = label THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN gold = label THEN 1 ELSE 0 END) AS support, sum(CASE WHEN predicted = label THEN 1 ELSE 0 END) AS said FROM u, p GROUP BY label)
SELECT label, round(coalesce(tp / CAST(nullif(said, 0) AS DOUBLE), 0), 6) AS precision, round(coalesce(tp / CAST(nullif(support, 0) AS DOUBLE), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(said + support, 0), 0), 6) AS f1, CAST(support AS BIGINT) AS support FROM c
""")  # fmt: skip
def classifier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of each label (O125)."""
    s = R.label_scores(_predicted(spark, sf_dir), "gold", "predicted")
    return s.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("ranking_auc", """
WITH p AS (SELECT doc_id, n_chars AS score, quality FROM labels JOIN documents USING (doc_id)), r AS (SELECT quality, avg(rn) OVER (PARTITION BY score) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score) AS rn FROM p))
SELECT count(*) AS n, CAST(sum(quality) AS BIGINT) AS positives, round((sum(CASE WHEN quality = 1 THEN rank END) - sum(quality) * (sum(quality) + 1) / 2.0) / (sum(quality) * (count(*) - sum(quality))), 6) AS auc FROM r
""")  # fmt: skip
def ranking_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise AUC with ties at a half, from counts by score: no pair is formed and no global sort is needed beyond distinct scores (a part of O124)."""
    p = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score")), "doc_id")
    by = p.groupBy("score").agg(F.sum("quality").alias("pos"), F.sum(1 - F.col("quality")).alias("neg"))
    return X.auc_of_counts(by)


@query("blocked_pairs", f"""
WITH t AS (SELECT doc_id AS id, {S.content_tokens(S.normalized("split_part(coalesce(text, ''), '.', 1)"))} AS t FROM documents),
o AS (SELECT id, tok, min(place) AS place FROM (SELECT id, unnest(t) AS tok, unnest(range(1, len(t) + 1)) AS place FROM t) WHERE length(tok) >= 4 GROUP BY ALL),
b AS (SELECT id, tok FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) <= 8), f AS (SELECT tok FROM b GROUP BY tok HAVING count(*) BETWEEN 2 AND 48),
p AS (SELECT DISTINCT x.id AS a, y.id AS b FROM b x JOIN b y ON x.tok = y.tok AND x.id < y.id JOIN f ON f.tok = x.tok)
SELECT a, b, round({S.jaccard("list_distinct(x.t)", "list_distinct(y.t)")}, 3) AS score FROM p JOIN t x ON x.id = a JOIN t y ON y.id = b WHERE {S.jaccard("list_distinct(x.t)", "list_distinct(y.t)")} >= 0.35
""")  # fmt: skip
def blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar titles among documents whose first eight long words include one of two to 48 documents, as the operator defines."""
    titles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring_index(F.coalesce("text", F.lit("")), ".", 1).alias("name"))
    return X.blocked_pairs(titles, "id", T.content_tokens(T.normalize(F.col("name"))), 0.35)


_THEMED = "CASE p_partkey % 4 WHEN 0 THEN 'sparse adapter ' WHEN 1 THEN 'graph planning ' WHEN 2 THEN 'robust retrieval ' ELSE 'plain ' END || p_name"
_LIMITED = "CASE s_suppkey % 3 WHEN 0 THEN 'slow and costly ' WHEN 1 THEN 'noisy evidence ' ELSE 'other ' END || s_name"


@query("theme_join", """
WITH m AS (SELECT p_brand AS method, unnest(CASE p_partkey % 4 WHEN 0 THEN ['efficiency'] WHEN 1 THEN ['structure'] WHEN 2 THEN ['robustness', 'evidence'] ELSE [] END) AS theme FROM part),
l AS (SELECT s_suppkey AS limitation, unnest(CASE s_suppkey % 3 WHEN 0 THEN ['efficiency'] WHEN 1 THEN ['robustness', 'evidence'] ELSE [] END) AS theme FROM supplier), mm AS (SELECT DISTINCT method, theme FROM m)
SELECT limitation, method, array_to_string(list_sort(list(theme)), ',') AS themes, round(0.55 + 0.15 * count(*), 2) AS score FROM l JOIN mm USING (theme) GROUP BY limitation, method
""")  # fmt: skip
def theme_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limitations and the methods that share a theme with them."""
    k, j = F.col("p_partkey") % 4, F.col("s_suppkey") % 3
    method = F.concat(F.when(k == 0, "sparse adapter ").when(k == 1, "graph planning ").when(k == 2, "robust retrieval ").otherwise("plain "), F.col("p_name"))
    limit = F.concat(F.when(j == 0, "slow and costly ").when(j == 1, "noisy evidence ").otherwise("other "), F.col("s_name"))
    m = table(spark, sf_dir, "part").select(F.col("p_brand").alias("method"), T.themes(method, T.METHOD_THEMES).alias("themes"))
    li = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("limitation"), T.themes(limit, T.LIMITATION_THEMES).alias("themes"))
    return X.theme_join(li, m, "limitation", "method")


@query("method_transfer", f"""
WITH m AS (SELECT DISTINCT p_name AS method FROM part), p AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS problem FROM part), t AS (SELECT method, {S.content_tokens("method")} AS t FROM m), u AS (SELECT problem, {S.content_tokens("problem")} AS u FROM p)
SELECT method, problem, round({S.jaccard("t", "u")}, 3) AS score FROM t, u WHERE {S.jaccard("t", "u")} >= 0.22 AND NOT starts_with(problem, method || ' ')
""")  # fmt: skip
def method_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods for problems that they are not applied to yet; pairs come from shared tokens, not from a cross join."""
    part = table(spark, sf_dir, "part")
    m = part.select(F.col("p_name").alias("method")).distinct().withColumn("t", T.content_tokens(T.normalize(F.col("method"))))
    p = part.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("problem")).distinct().withColumn("u", T.content_tokens(T.normalize(F.col("problem"))))
    pairs = X.sharing_pairs(m, p, "method", "problem", "t", "u").where(~F.startswith("problem", F.concat("method", F.lit(" "))))
    return pairs.withColumn("score", T.jaccard(F.col("t"), F.col("u"))).where("score >= 0.22").select("method", "problem", F.round("score", 3).alias("score"))


@query("fuzzy_titles", """
WITH r AS (SELECT DISTINCT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' revisited' END AS title FROM part), t AS (SELECT DISTINCT p_name FROM part)
SELECT p_partkey, title, t.p_name AS target, CASE WHEN title = t.p_name THEN 'exact' ELSE 'contained' END AS how FROM r JOIN t ON title = t.p_name OR (p_partkey % 2 = 1 AND title = t.p_name || ' revisited')
""")  # fmt: skip
def fuzzy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to titles: exact, else a title contained in the other among those that share tokens."""
    part = table(spark, sf_dir, "part")
    refs = part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" revisited"))).alias("title"))
    return X.title_links(refs, part.select(F.col("p_name").alias("target")).distinct(), "p_partkey", "title", "target")


@query("identity_overlap", """
WITH i AS (SELECT o_orderkey AS id, unnest(['custkey:' || o_custkey, 'day:' || strftime(o_orderdate, '%Y%m%d')]) AS ident FROM orders)
SELECT x.id AS a, y.id AS b, count(*) AS shared FROM i x JOIN i y ON x.ident = y.ident AND x.id < y.id GROUP BY ALL HAVING count(*) >= 2
""")  # fmt: skip
def identity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that share every identity, found through the joint identity."""
    i = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws("|", "o_custkey", F.date_format("o_orderdate", "yyyyMMdd")).alias("ident"))
    return i.alias("x").join(i.alias("y"), "ident").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(2).cast("long").alias("shared"))


@query("relation_hints", """
WITH o AS (SELECT o_orderkey AS id, o_custkey AS work, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)
SELECT a.id AS a, b.id AS b, CASE WHEN a.y < b.y THEN 'preprint_of' WHEN a.y > b.y THEN 'has_preprint' ELSE 'same_work_candidate' END AS hint FROM o a JOIN o b ON a.work = b.work AND a.id < b.id AND abs(a.y - b.y) <= 1
""")  # fmt: skip
def relation_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one work within a year of each other."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("work"), F.year("o_orderdate").alias("y"))
    near = X.near_in_range(o, "work", "id", "y", 1)
    return near.select("a", "b", F.when(F.col("ya") < F.col("yb"), "preprint_of").when(F.col("ya") > F.col("yb"), "has_preprint").otherwise("same_work_candidate").alias("hint"))


@query("hash_embeddings")
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic embeddings of part names: bucket and sign from SHA-256, 1 + ln(tf), unit length (O181)."""
    tokens = T.content_tokens(T.normalize(F.concat_ws(" ", "p_name", "p_type")))
    return X.hash_embeddings(table(spark, sf_dir, "part").select("p_partkey", tokens.alias("tokens")), "p_partkey", "tokens")
