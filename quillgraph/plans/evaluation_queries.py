"""Queries of evaluation, candidate relations and material: answers, relations, lineage benchmarks, labels, costs, gaps, requisitions, watch lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators import evaluation as E
from quillgraph.plans import sqltext as S
from quillgraph.plans.paper_queries import _PAPERS, _papers
from quillgraph.plans.registry import query
from quillgraph.runtime import table

_COMPARABLE = lambda x: rf"trim(regexp_replace(regexp_replace(lower({x}), '[`*_{{}}\[\]()<>\"''“”‘’,.;:!?\\/-]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query("answer_metrics", f"""
WITH a AS (SELECT p_partkey AS query, p_name || CASE WHEN p_size % 2 = 0 THEN ' (' || p_type || ')' ELSE '.' END AS answer, CASE WHEN p_size % 5 = 0 THEN [] ELSE [p_name, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_name || '!' END] END AS refs FROM part),
c AS (SELECT query, {_COMPARABLE("answer")} AS a, list_distinct({S.content_tokens(S.normalized("answer"))}) AS atk, refs, [{_COMPARABLE("r")} FOR r IN refs] AS r FROM a), w AS (SELECT *, list_distinct(flatten([{S.content_tokens(S.normalized("z"))} FOR z IN refs])) AS w FROM c)
SELECT query, round(CASE WHEN len(w) = 0 OR len(atk) = 0 THEN 0 ELSE len(list_intersect(w, atk)) / CAST(len(w) AS DOUBLE) END, 6) AS coverage, CAST(CASE WHEN a = '' OR len(r) = 0 THEN NULL WHEN list_contains(r, a) OR len(list_filter(r, lambda z: NOT contains(a, z))) = 0 THEN 1 ELSE 0 END AS INTEGER) AS exact FROM w
""")  # fmt: skip
def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token coverage and exact match of answers (O123)."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query"), F.concat("p_name", F.when(size % 2 == 0, F.concat(F.lit(" ("), "p_type", F.lit(")"))).otherwise(".")).alias("answer"), F.when(size % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("p_name", F.when(size % 3 == 0, F.col("p_type")).otherwise(F.concat("p_name", F.lit("!"))))).alias("references"))
    return E.answer_metrics(rows)


@query("citation_metrics", """
WITH p AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS i FROM lineitem WHERE l_returnflag <> 'N'), g AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS i FROM lineitem WHERE l_discount > 0.03),
n AS (SELECT coalesce(a.q, b.q) AS q, coalesce(said, 0) AS said, coalesce(wanted, 0) AS wanted, coalesce(hit, 0) AS hit FROM (SELECT q, count(*) AS said FROM p GROUP BY q) a FULL JOIN (SELECT q, count(*) AS wanted FROM g GROUP BY q) b ON a.q = b.q LEFT JOIN (SELECT q, count(*) AS hit FROM p JOIN g USING (q, i) GROUP BY q) h ON h.q = coalesce(a.q, b.q))
SELECT q AS l_orderkey, round(CASE WHEN said > 0 THEN hit / CAST(said AS DOUBLE) ELSE 0 END, 6) AS precision, round(CASE WHEN wanted > 0 THEN hit / CAST(wanted AS DOUBLE) ELSE 0 END, 6) AS recall, round(CASE WHEN hit > 0 THEN 2.0 * hit / (said + wanted) ELSE 0 END, 6) AS f1, CASE WHEN hit = said AND hit = wanted AND hit > 0 THEN 1 ELSE 0 END AS success FROM n
""")  # fmt: skip
def citation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of what an answer cites (O123)."""
    line = table(spark, sf_dir, "lineitem")
    return E.set_metrics(line.where("l_returnflag <> 'N'"), line.where("l_discount > 0.03"), "l_orderkey", "l_partkey")


@query("relation_matching")
def relation_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted relations that are gold ones, each taken once in the order of predictions (O123)."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    r = rows.select(F.col("l_orderkey").alias("query"), F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey").alias("place"), F.col("s_name").alias("source"), F.col("p_name").alias("target"), F.when(F.col("l_tax") > 0.04, "USES").otherwise("EXTENDS").alias("type"), "l_returnflag", "l_discount")
    gold = r.where("l_discount > 0.03").withColumn("type", F.lit("USES")).withColumnRenamed("place", "gold").drop("l_returnflag", "l_discount")
    return E.relation_matches(r.where("l_returnflag <> 'N'").drop("l_returnflag", "l_discount"), gold)


@query("label_agreement", """
WITH l AS (SELECT l_partkey AS pair, CASE l_returnflag WHEN 'A' THEN 'left' WHEN 'R' THEN 'right' ELSE CASE WHEN l_tax > 0.06 THEN 'tie' ELSE 'skip' END END AS side FROM lineitem), n AS (SELECT pair, side, count(*) AS n FROM l WHERE side <> 'skip' GROUP BY ALL)
SELECT pair, CAST(sum(n) AS BIGINT) AS labels, arg_min(side, (-n, side)) AS choice, round(max(n) / CAST(sum(n) AS DOUBLE), 4) AS share FROM n GROUP BY pair HAVING sum(n) >= 2
""")  # fmt: skip
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The majority of human labels of each pair and how many agree (O129)."""
    flag = F.col("l_returnflag")
    return E.agreement(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pair"), F.when(flag == "A", "left").when(flag == "R", "right").when(F.col("l_tax") > 0.06, "tie").otherwise("skip").alias("side")))


def _followed(df: DataFrame, key: str, name: str, width: int = 10_000) -> DataFrame:
    """Each different key with the next larger one: by ranges of ``width`` keys, and one row a range for the step to the next."""
    rows = df.select(key).distinct().withColumn("_range", F.floor(F.col(key) / width))
    firsts = rows.groupBy("_range").agg(F.min(key).alias("_first"))
    after = firsts.select("_range", F.lead("_first").over(Window.orderBy("_range")).alias("_next"))
    inside = F.lead(key).over(Window.partitionBy("_range").orderBy(key))
    return rows.withColumn("_in", inside).join(after, "_range").select(key, F.coalesce("_in", "_next").alias(name))


@query("lineage_benchmark", """
WITH RECURSIVE x AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst, l_returnflag, l_discount, l_quantity FROM lineitem), e AS (SELECT DISTINCT src, dst FROM x WHERE dst IS NOT NULL AND l_returnflag <> 'N'),
gn AS (SELECT p_partkey AS gold FROM part WHERE p_size <= 5), mt AS (SELECT p_partkey AS gold, p_partkey AS node FROM part WHERE p_size <= 5 AND p_size <> 3), o AS (SELECT gold, lead(gold) OVER (ORDER BY gold) AS nxt FROM gn), ge AS (SELECT gold AS source, nxt AS target FROM o WHERE nxt IS NOT NULL),
ch AS (SELECT l_orderkey AS chain, p_partkey AS gold, lead(p_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt FROM lineitem JOIN gn ON gold = l_partkey JOIN part ON p_partkey = l_partkey),
w AS (SELECT DISTINCT m.node AS s, m.node AS "end", 0 AS hops FROM ge JOIN mt m ON m.gold = ge.source UNION SELECT w.s, e.dst, hops + 1 FROM w JOIN e ON e.src = w."end" WHERE hops < 3),
edg AS (SELECT ge.source, bool_or(coalesce(w.hops > 0, false)) AS ok FROM ge LEFT JOIN mt a ON a.gold = ge.source LEFT JOIN mt b ON b.gold = ge.target LEFT JOIN w ON w.s = a.node AND w."end" = b.node GROUP BY ge.source),
st AS (SELECT chain, CASE WHEN e.src IS NOT NULL THEN 1 ELSE 0 END AS ok FROM ch LEFT JOIN mt a ON a.gold = ch.gold LEFT JOIN mt b ON b.gold = ch.nxt LEFT JOIN e ON e.src = a.node AND e.dst = b.node WHERE nxt IS NOT NULL),
ev AS (SELECT src AS key, max(CASE WHEN l_discount > 0.01 THEN 1 ELSE 0 END) AS q, max(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS h FROM x WHERE dst IS NOT NULL AND l_returnflag <> 'N' GROUP BY src),
r AS (SELECT 'nodes' AS metric, CAST(count(node) AS DOUBLE) AS hits, CAST(count(*) AS DOUBLE) AS total, CAST(0.7 AS DOUBLE) AS least FROM gn LEFT JOIN mt USING (gold) UNION ALL SELECT 'edges', coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END), 0), count(*), 0.6 FROM edg UNION ALL SELECT 'paths', coalesce(sum(ok), 0), count(*), 0.7 FROM st
  UNION ALL SELECT 'chains', coalesce(sum(a), 0), count(*), 0.7 FROM (SELECT avg(ok) AS a FROM st GROUP BY chain) UNION ALL SELECT 'quotes', coalesce(sum(q), 0), count(*), 0.9 FROM ev UNION ALL SELECT 'evidence', coalesce(sum(h), 0), count(*), 0.75 FROM ev)
SELECT metric, round(hits, 4) AS hits, total, round(CASE WHEN total > 0 THEN hits / total END, 4) AS value, coalesce(round(CASE WHEN total > 0 THEN hits / total END, 4) >= least, false) AS passed FROM r
""")  # fmt: skip
def lineage_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a gold lineage the graph has; gold methods are parts of size five at most, of which those of size three are not found (O127)."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    line = table(spark, sf_dir, "lineitem")
    held = line.withColumn("dst", F.lead("l_partkey").over(order)).where("dst is not null and l_returnflag <> 'N'")
    small = table(spark, sf_dir, "part").where("p_size <= 5")
    gold = small.select(F.col("p_partkey").alias("gold"))
    after = _followed(gold, "gold", "target")
    chains = line.join(gold, F.col("gold") == F.col("l_partkey")).select(F.col("l_orderkey").alias("chain"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"), "gold")
    evidence = held.select(F.col("l_partkey").alias("key"), (F.col("l_discount") > 0.01).alias("quoted"), (F.col("l_quantity") > 45).alias("whole"))
    matched = small.where("p_size <> 3").select(F.col("p_partkey").alias("gold"), F.col("p_partkey").alias("node"))
    return E.lineage_benchmark(gold, after.where("target is not null").select(F.col("gold").alias("source"), "target"), chains, matched, held.select(F.col("l_partkey").alias("src"), "dst"), evidence)


@query("candidate_relations", """
WITH c AS (SELECT p_partkey AS id, p_brand AS subproblem, lower(p_name) AS mechanism, string_split(p_name, ' ') AS terms, ['s' || p_size] AS papers, [p_type] AS failures FROM part),
k AS (SELECT id, unnest(list_distinct(list_concat(['subproblem:' || subproblem], list_concat(['paper:' || z FOR z IN papers], list_concat(['mechanism:' || z FOR z IN terms], ['failure:' || z FOR z IN failures]))))) AS block FROM c), q AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY id) AS n FROM k QUALIFY n <= 25),
f AS (SELECT x.id AS a, y.id AS b FROM q x JOIN q y ON x.block = y.block AND x.id < y.id QUALIFY row_number() OVER (PARTITION BY x.block ORDER BY x.id, y.id) <= 24), d AS (SELECT DISTINCT a, b FROM f),
s AS (SELECT a, b, x.subproblem = y.subproblem AS sub, x.mechanism = y.mechanism AS mech, len(list_intersect(x.terms, y.terms)) AS nt, len(list_intersect(x.papers, y.papers)) > 0 AS pap, len(list_intersect(x.failures, y.failures)) > 0 AS fai FROM d JOIN c x ON x.id = a JOIN c y ON y.id = b),
r AS (SELECT a, b, array_to_string(list_filter([CASE WHEN NOT sub AND (mech OR nt > 0 OR pap OR fai) THEN 'COMPLEMENTS' END, CASE WHEN sub THEN 'SUBSTITUTES' END, CASE WHEN mech OR nt > 0 OR pap THEN 'SHARES_MECHANISM' END, CASE WHEN fai THEN 'SHARES_FAILURE_MODE' END, CASE WHEN sub AND (mech OR pap OR nt >= 2) THEN 'NOVELTY_COLLISION' END], lambda z: z IS NOT NULL), ',') AS types,
  round(least(0.95, 0.35 + CASE WHEN sub THEN 0.12 ELSE 0 END + CASE WHEN mech THEN 0.18 ELSE 0 END + CASE WHEN pap THEN 0.12 ELSE 0 END + CASE WHEN nt > 0 THEN 0.1 ELSE 0 END + CASE WHEN fai THEN 0.08 ELSE 0 END), 3) AS confidence FROM s)
SELECT a, b, types, confidence FROM r WHERE types <> '' ORDER BY confidence DESC, a, b LIMIT 40
""")  # fmt: skip
def candidate_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed relations of candidates that share a block; the forty surest are the feature (O218)."""
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("subproblem"), F.lower("p_name").alias("mechanism"), F.split("p_name", " ").alias("terms"), F.array(F.concat(F.lit("s"), "p_size")).alias("papers"), F.array("p_type").alias("failures"), none.alias("metrics"), none.alias("costs"))
    return E.candidate_relations(rows)


@query("cost_signals", _PAPERS.replace("' points on the Open'", "' hours on 8 V100 GPUs with batch size of 32 over 3 epochs and 5k images of Open'") + ", u AS (" + " UNION ALL ".join(f"SELECT doc AS paper, '{k}' AS signal, regexp_extract_all(text, '({p})', 1) AS h FROM p" for k, p in E.COSTS.items()) + """)
SELECT paper, signal, len(h) AS n, CASE WHEN len(h) > 0 THEN 'reported' ELSE 'not_reported' END AS status, h[1] AS first FROM u
""")  # fmt: skip
def cost_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hardware, run time, epochs and the like that papers report (O228)."""
    text = F.regexp_replace("text", " points on the Open", " hours on 8 V100 GPUs with batch size of 32 over 3 epochs and 5k images of Open")
    return E.cost_signals(_papers(spark, sf_dir).select(F.col("doc").alias("paper"), F.lit(1).alias("place"), text.alias("text")))


@query("gap_map", f"""
WITH i AS (SELECT DISTINCT l_suppkey AS pack, l_partkey AS place, l_partkey AS paper, p_name || ' of ' || p_type AS text, CASE p_size % 4 WHEN 0 THEN 'Limitation' WHEN 1 THEN 'Claim' WHEN 2 THEN 'Assumption' END AS kind, CASE WHEN p_size % 4 < 3 THEN p_name || CASE WHEN p_size % 8 = 0 THEN ' assumption' ELSE '' END END AS name FROM lineitem JOIN part ON p_partkey = l_partkey),
t AS (SELECT *, CASE WHEN kind IN ('Limitation', 'Assumption') THEN CASE WHEN contains(lower(name), 'assum') THEN 'assumption_risk' ELSE 'limitation' END WHEN kind = 'Claim' THEN 'evidence_verification_needed' ELSE 'source_verification_needed' END AS type, CASE WHEN kind = 'Claim' THEN 'Evidence boundary for claim: ' || name WHEN kind IS NOT NULL THEN name ELSE text END AS statement FROM i),
f AS (SELECT pack, type, {S.normalized("statement")} AS key, paper, min((place, name, statement)) AS f FROM t GROUP BY ALL)
SELECT pack, CAST(row_number() OVER (PARTITION BY pack ORDER BY f[1], CASE WHEN type = 'evidence_verification_needed' THEN 1 ELSE 0 END, f[2], paper) AS INTEGER) AS place, type, f[3] AS statement, paper FROM f QUALIFY place <= 12
""".replace("GROUP BY ALL)\nSELECT pack", "GROUP BY 1, 2, 3, 4)\nSELECT pack"))  # fmt: skip
def gap_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve gaps that each pack's papers name; a pack is a supplier, its papers the parts (O227)."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pack"), "l_partkey").distinct().join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    kind = F.when(size % 4 == 0, "Limitation").when(size % 4 == 1, "Claim").when(size % 4 == 2, "Assumption")
    name = F.when(size % 4 < 3, F.concat("p_name", F.when(size % 8 == 0, " assumption").otherwise("")))
    return E.gap_map(rows.select("pack", F.col("l_partkey").alias("place"), F.col("l_partkey").alias("paper"), F.concat(F.col("p_name"), F.lit(" of "), F.col("p_type")).alias("text"), kind.alias("kind"), name.alias("name")))


@query("import_requisitions", """
WITH w AS (SELECT l_partkey AS key, CASE l_returnflag WHEN 'A' THEN 'target_prior' WHEN 'R' THEN 'near_source_method' ELSE 'far_source_story' END AS role, l_linenumber AS hits FROM lineitem), r AS (SELECT * FROM w WHERE key NOT IN (SELECT p_partkey FROM part WHERE p_size > 20)),
g AS (SELECT key, CASE min(CASE role WHEN 'target_prior' THEN 0 WHEN 'near_source_method' THEN 1 ELSE 2 END) WHEN 0 THEN 'target_prior' WHEN 1 THEN 'near_source_method' ELSE 'far_source_story' END AS role, max(hits) AS hits, count(*) AS requests FROM r GROUP BY key)
SELECT key, role, CASE WHEN role = 'target_prior' THEN 'P0' WHEN role = 'near_source_method' OR hits >= 3 THEN 'P1' ELSE 'P2' END AS priority, requests FROM g
""")  # fmt: skip
def import_requisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that are wanted and missing, with their priority (O229)."""
    flag = F.col("l_returnflag")
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.when(flag == "A", "target_prior").when(flag == "R", "near_source_method").otherwise("far_source_story").alias("role"), F.col("l_linenumber").alias("hits"))
    return E.requisitions(wanted, table(spark, sf_dir, "part").where("p_size > 20").select(F.col("p_partkey").alias("key")))


@query("regression_watchlist", f"""
WITH s AS (SELECT l_orderkey AS lineage, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place, l_partkey AS node, p_type || ' cost' AS bottleneck FROM lineitem JOIN part ON p_partkey = l_partkey), a AS (SELECT *, lead(node) OVER (PARTITION BY lineage ORDER BY place) AS ancestor, {S.normalized("bottleneck")} AS key FROM s),
f AS (SELECT key, node, min((lineage, place, bottleneck, ancestor)) AS f FROM a WHERE ancestor IS NOT NULL GROUP BY key, node), o AS (SELECT * FROM f ORDER BY f[1], f[2], node LIMIT 16)
SELECT CAST(row_number() OVER (ORDER BY f[1], f[2], node) AS INTEGER) AS place, f[3] AS capability, node AS step, f[4] AS ancestor, CASE WHEN contains(key, 'steel') THEN 'candidate_mentions_protected_capability' ELSE 'counterfactual_not_yet_tested' END AS status FROM o
""")  # fmt: skip
def regression_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What earlier steps mended and a candidate may break; sixteen are the feature (O232)."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    steps = rows.select(F.col("l_orderkey").alias("lineage"), F.row_number().over(order).alias("place"), F.col("l_partkey").alias("node"), F.concat("p_type", F.lit(" cost")).alias("bottleneck"))
    return E.regression_watchlist(steps, "steel frames")
