"""Queries of the lexical score, its candidates, gold matching and predicted links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators import lexical as L
from quillgraph.plans import sqltext as S
from quillgraph.plans.registry import query
from quillgraph.runtime import table

# ---- papers are documents: the title is the text before the first full stop, the abstract the rest -------


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    title = F.substring_index(text, ".", 1)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), title.alias("title"), F.substring(text, F.length(title) + 2, F.length(text)).alias("abstract"), F.array(F.concat(F.lit("id:"), F.col("doc_id") % 97)).alias("ids"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    facet = F.element_at(F.array(*[F.lit(x) for x in ("background", "method", "result")]), (F.col("item_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text", facet.alias("facet"), F.array(F.concat(F.lit("id:"), F.col("item_id") % 97)).alias("ids"))


_FACET = "CASE facet " + " ".join(f"WHEN '{name}' THEN least(2.0, ({' + '.join(f'''CAST(contains(whole, '{t}') AS INTEGER)''' for t in terms)}) / {len(terms)}.0)" for name, terms in L.FACETS.items()) + " ELSE 0 END"
_LEXICAL = f"""
WITH raw AS (SELECT doc_id AS doc, coalesce(text, '') AS x, split_part(coalesce(text, ''), '.', 1) AS title FROM documents),
p AS (SELECT doc, title, substr(x, length(title) + 2) AS abstract, doc % 97 AS pid FROM raw),
d AS (SELECT doc, pid, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS ct, lower(title || ' ' || abstract) AS whole, {S.content_tokens(S.normalized("title"))} AS t, {S.content_tokens(S.normalized("abstract"))} AS a FROM p),
q AS (SELECT item_id AS query, item_id % 97 AS qid, ['background', 'method', 'result'][item_id % 3 + 1] AS facet, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS cq, {S.content_tokens(S.normalized("coalesce(text, '')"))} AS t FROM benchmark),
w AS (SELECT query, qid, facet, cq, token, count(*) AS m, any_value(len(t)) AS nq, any_value(len(list_distinct(t))) AS uq FROM (SELECT *, unnest(t) AS token FROM q WHERE len(t) > 0) GROUP BY query, qid, facet, cq, token),
e AS (SELECT doc, unnest(t) AS token, 1 AS in_t, 0 AS in_a FROM d UNION ALL SELECT doc, unnest(a), 0, 1 FROM d),
f AS (SELECT doc, token, sum(in_t) AS tf_t, sum(in_a) AS tf_a FROM e WHERE token IN (SELECT token FROM w) GROUP BY doc, token),
df AS (SELECT token, count(*) FILTER (tf_t > 0) AS df_t, count(*) FILTER (tf_a > 0) AS df_a, count(*) AS df FROM f GROUP BY token),
n AS (SELECT count(*) AS n, avg(len(t)) AS lt, avg(len(a)) AS la FROM d),
z AS (SELECT doc, pid, ct, whole, len(t) AS n_t, len(a) AS n_a, len(list_distinct(t)) AS u_t FROM d),
m AS (SELECT w.query, f.doc, w.token, w.m, f.tf_t, f.tf_a, df.df_t, df.df_a, df.df FROM w JOIN f USING (token) JOIN df USING (token)),
r AS (SELECT query, doc, min((df, token)) AS rarest FROM m GROUP BY query, doc),
"""


def _candidates_sql(limit: int, scan: int) -> str:
    return f"""
c0 AS (SELECT query, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY rarest, doc) AS INTEGER) AS place FROM r QUALIFY place <= {scan}),
c1 AS (SELECT query, max(place) AS k FROM c0 GROUP BY query HAVING max(place) < {limit}),
h AS (SELECT c1.query, k, d.doc FROM c1 CROSS JOIN (SELECT doc FROM d ORDER BY doc LIMIT {2 * limit}) d),
c2 AS (SELECT h.* FROM h ANTI JOIN c0 ON c0.query = h.query AND c0.doc = h.doc),
c3 AS (SELECT query, doc, CAST(k + row_number() OVER (PARTITION BY query ORDER BY doc) AS INTEGER) AS place FROM c2 QUALIFY place <= {limit}),
c AS (SELECT * FROM c0 UNION ALL SELECT * FROM c3)
"""


@query("scan_limited_candidates", _LEXICAL + _candidates_sql(20, 30) + "SELECT query, doc, place FROM c")
def scan_limited_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each query by its rarest tokens, within a scan limit, filled up from the head of the corpus (O136)."""
    docs, wanted = L.prepared_papers(_papers(spark, sf_dir)), L.query_tokens(_asked(spark, sf_dir))
    posting = L.postings(docs, wanted)
    matched = wanted.select("query", "token").join(posting.select("doc", "token"), "token").join(posting.groupBy("token").agg(F.count("*").alias("df")), "token")
    return L.scan_limited(matched, docs, 20, 30)


_MIX = _LEXICAL + _candidates_sql(10, L.SCAN_LIMIT) + f""",
g AS (SELECT query, doc, sum(CASE WHEN tf_t > 0 THEN m ELSE 0 END) AS in_t, sum(CASE WHEN tf_a > 0 THEN m ELSE 0 END) AS in_a, sum(m) AS in_c, count(*) FILTER (tf_t > 0) AS shared,
  sum(CASE WHEN tf_t > 0 THEN ln(1 + (n - df_t + 0.5) / (df_t + 0.5)) * tf_t * 2.2 / (tf_t + 1.2 * (0.25 + 0.75 * n_t / lt)) ELSE 0 END) AS bm_t,
  sum(CASE WHEN tf_a > 0 THEN ln(1 + (n - df_a + 0.5) / (df_a + 0.5)) * tf_a * 2.2 / (tf_a + 1.2 * (0.25 + 0.75 * n_a / la)) ELSE 0 END) AS bm_a,
  sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf_t + tf_a) * 2.2 / (tf_t + tf_a + 1.2 * (0.25 + 0.75 * (n_t + n_a) / (lt + la)))) AS bm_c
  FROM m JOIN z USING (doc), n GROUP BY query, doc),
qq AS (SELECT DISTINCT query, qid, facet, cq, nq, uq FROM w),
s AS (SELECT query, doc, round(2.5 * coalesce(in_t, 0) / nq + 1.25 * coalesce(in_a, 0) / nq + 1.5 * coalesce(in_c, 0) / nq + CASE WHEN u_t > 0 THEN coalesce(shared, 0) / CAST(uq + u_t - coalesce(shared, 0) AS DOUBLE) ELSE 0 END
  + 2.25 * coalesce(bm_t, 0) + 1.5 * coalesce(bm_a, 0) + coalesce(bm_c, 0) + CASE WHEN cq = ct THEN 2.5 ELSE 0 END + CASE WHEN ct <> '' AND contains(ct, cq) THEN 1.5 ELSE 0 END
  + {_FACET} + CASE WHEN pid = qid THEN 2.5 ELSE 0 END, 6) AS score
  FROM c JOIN qq USING (query) JOIN z USING (doc) LEFT JOIN g USING (query, doc))
SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM s QUALIFY rank <= 10
"""


@query("lexical_mix", _MIX)
def lexical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of each benchmark item by the whole lexical score (O154)."""
    return L.lexical_mix(_papers(spark, sf_dir), _asked(spark, sf_dir), 10)


# ---- a supplier's parts by revenue are candidates; its discounted parts are gold ---------------------------


def _ranked_and_gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    key, alias = F.concat(F.lit("p"), F.col("p_partkey")), F.lower(F.concat_ws(" ", "p_brand", "p_type", "p_size"))
    described = part.select(F.col("p_partkey").alias("part"), F.col("p_name").alias("title"), F.array(key).alias("ids"), F.array(alias).alias("aliases"))
    sold = line.groupBy(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("part")).agg(F.round(F.sum("l_quantity"), 2).alias("sold"), F.max("l_discount").alias("discount"))
    by_sales = Window.partitionBy("query").orderBy(F.desc("sold"), "part")
    ranked = sold.withColumn("rank", F.row_number().over(by_sales)).where("rank <= 20").join(described, "part").select("query", "rank", "title", "ids", "aliases")
    # a third of the gold papers keep their identifier, a third their alias
    bare = described.select("part", "title", F.when(F.col("part") % 3 == 0, F.col("ids")).otherwise(F.array().cast("array<string>")).alias("ids"), F.when(F.col("part") % 3 == 1, F.col("aliases")).otherwise(F.array().cast("array<string>")).alias("aliases"))
    gold = sold.where("discount >= 0.1").join(bare, "part").select("query", F.col("part").alias("gold"), "title", "ids", "aliases", (1 + F.col("part") % 2).cast("int").alias("grade"))
    return ranked, gold


_GOLD = """
WITH sold AS (SELECT l_suppkey AS query, l_partkey AS part, round(sum(l_quantity), 2) AS sold, max(l_discount) AS discount FROM lineitem GROUP BY ALL),
x AS (SELECT p_partkey AS part, p_name AS title, 'p' || p_partkey AS id, lower(p_brand || ' ' || p_type || ' ' || p_size) AS alias, lower(p_name) AS ct, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 -]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda t: t <> '')) AS tk FROM part),
c AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY sold DESC, part) AS INTEGER) AS rank, part FROM sold QUALIFY rank <= 20),
cand AS (SELECT c.query, c.rank, x.* EXCLUDE (part) FROM c JOIN x USING (part)),
gold AS (SELECT query, part AS gold, title, ct, tk, CASE WHEN part % 3 = 0 THEN id END AS id, CASE WHEN part % 3 = 1 THEN alias END AS alias, CAST(1 + part % 2 AS INTEGER) AS grade FROM sold JOIN x USING (part) WHERE discount >= 0.1),
near AS (SELECT a.query, a.rank, g.gold, CASE WHEN a.ct = g.ct THEN 1.0 ELSE len(list_intersect(a.tk, g.tk)) / CAST(len(a.tk) + len(g.tk) - len(list_intersect(a.tk, g.tk)) AS DOUBLE) END AS sim, coalesce(a.id = g.id, false) AS same_id, coalesce(a.alias = g.alias, false) AS same_alias FROM cand a JOIN gold g USING (query)),
m AS (SELECT query, rank, min(gold) FILTER (same_id) AS by_id, min(gold) FILTER (same_alias) AS by_alias, min(gold) FILTER (sim >= 0.96) AS by_title, arg_min(sim, gold) FILTER (sim >= 0.96) AS sim FROM near GROUP BY query, rank),
ev AS (SELECT c.query, c.rank, coalesce(by_id, by_alias, by_title) AS gold, CASE WHEN by_id IS NOT NULL THEN 'identifier' WHEN by_alias IS NOT NULL THEN 'alias' WHEN sim = 1 THEN 'title_exact' WHEN sim IS NOT NULL THEN 'title_similarity' END AS reason FROM c LEFT JOIN m USING (query, rank)),
e AS (SELECT ev.query, ev.rank, ev.gold, reason, ev.gold IS NOT NULL AND row_number() OVER (PARTITION BY ev.query, ev.gold ORDER BY ev.rank) = 1 AS relevant, g.grade AS g FROM ev LEFT JOIN gold g ON g.query = ev.query AND g.gold = ev.gold)
"""


@query("gold_events", _GOLD + "SELECT query, rank, gold, reason, relevant, CASE WHEN relevant THEN g ELSE 0 END AS grade FROM e")
def gold_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which gold paper each candidate is, by identifier, alias or title, each counted once."""
    return L.rank_events(*_ranked_and_gold(spark, sf_dir))


_DIAGNOSED = _GOLD + """,
b AS (SELECT query, gold, arg_max((sim, same_id OR same_alias, rank), (CAST(same_id AS INTEGER) * 2 + CAST(same_alias AS INTEGER) * 1.5 + sim, -rank)) AS b FROM near WHERE sim > 0 OR same_id OR same_alias GROUP BY query, gold),
miss AS (SELECT g.query, g.gold, b.b[1] AS sim, b.b[2] AS same, b.b[3] AS rank, p.first_rank FROM gold g ANTI JOIN (SELECT query, gold FROM e WHERE relevant) r ON r.query = g.query AND r.gold = g.gold LEFT JOIN b ON b.query = g.query AND b.gold = g.gold LEFT JOIN (SELECT query, min(rank) AS first_rank FROM c GROUP BY query) p ON p.query = g.query)
SELECT query, gold, CASE WHEN first_rank IS NULL THEN 'no_candidates' WHEN same THEN 'identity_match_not_ranked' WHEN sim >= 0.96 THEN 'title_match_not_ranked' WHEN sim >= 0.81 THEN 'near_title_match_below_threshold' WHEN sim > 0 THEN 'weak_title_overlap' ELSE 'not_in_candidate_pool' END AS reason, CAST(coalesce(rank, first_rank) AS INTEGER) AS best_rank FROM miss
"""


@query("gold_diagnosis", _DIAGNOSED)
def gold_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each gold paper that no candidate is was missed (O121)."""
    ranked, gold = _ranked_and_gold(spark, sf_dir)
    return L.gold_misses(ranked, gold, L.rank_events(ranked, gold))


# ---- predicted links: supplier and part by discount; early and late shipments are positives and negatives -


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    line = table(spark, sf_dir, "lineitem")
    source, target = F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("p"), F.col("l_partkey"))
    pair = F.concat_ws("|", F.least(source, target), F.greatest(source, target))
    predictions = line.where("l_discount > 0.02").select(source.alias("source"), target.alias("target"), (F.col("l_discount") * 12).alias("score"))
    pairs = line.groupBy(pair.alias("pair")).agg(F.min(F.year("l_shipdate")).alias("year"))
    return predictions, pairs.where("year <= 1994"), pairs.where("year > 1994").select("pair")


_LINKS = """
WITH l AS (SELECT least('s' || l_suppkey, 'p' || l_partkey) || '|' || greatest('s' || l_suppkey, 'p' || l_partkey) AS pair, l_discount, year(l_shipdate) AS y FROM lineitem),
best AS (SELECT pair, max(least(1.0, l_discount * 12)) AS score FROM l WHERE l_discount > 0.02 GROUP BY pair),
pr AS (SELECT pair, score, row_number() OVER (ORDER BY score DESC, pair) AS rank FROM best),
ps AS (SELECT pair, min(y) AS year FROM l GROUP BY pair), pos AS (SELECT * FROM ps WHERE year <= 1994), neg AS (SELECT pair FROM ps WHERE year > 1994)
"""


@query("prediction_ranks", _LINKS + "SELECT pair, round(score, 6) AS score, rank FROM pr")
def prediction_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External predictions, clamped and ranked by pair (O183)."""
    return L.normalized_predictions(_links(spark, sf_dir)[0]).select("pair", F.round("score", 6).alias("score"), "rank")


_LINK_METRICS = _LINKS + """,
a AS (SELECT count(*) AS n, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 10) AS h10, count(*) FILTER (rank <= 50) AS hk, sum(coalesce(1.0 / rank, 0)) AS rr, count(*) FILTER (rank IS NULL) AS missing, count(*) FILTER (year <= 1992) AS leaked, count(*) FILTER (year IS NULL) AS undated FROM pos LEFT JOIN pr USING (pair)),
sp AS (SELECT coalesce(score, 0) AS s, count(*) AS p FROM pos LEFT JOIN pr USING (pair) GROUP BY 1), sn AS (SELECT coalesce(score, 0) AS s, count(*) AS q FROM neg LEFT JOIN pr USING (pair) GROUP BY 1),
u AS (SELECT coalesce(sum(CASE WHEN sp.s > sn.s THEN 1.0 WHEN sp.s = sn.s THEN 0.5 ELSE 0 END * p * q), 0) AS wins, coalesce(sum(p * q), 0) AS pairs FROM sp, sn)
SELECT round(CASE WHEN n > 0 THEN h1 / n ELSE 0 END, 4) AS hits_at_1, round(CASE WHEN n > 0 THEN h10 / n ELSE 0 END, 4) AS hits_at_10, round(CASE WHEN n > 0 THEN hk / n ELSE 0 END, 4) AS hits_at_k, round(CASE WHEN n > 0 THEN rr / n ELSE 0 END, 4) AS mrr,
  round(CASE WHEN pairs > 0 THEN wins / pairs ELSE 0 END, 4) AS pair_accuracy, CAST(pairs AS BIGINT) AS pairs, missing, leaked, undated FROM a, u
"""


@query("link_metrics", _LINK_METRICS)
def link_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, mean reciprocal rank, pair accuracy and leakage of predicted links (O124)."""
    predictions, positives, negatives = _links(spark, sf_dir)
    return L.link_metrics(L.normalized_predictions(predictions), positives, negatives, 50, 1992)
