"""Queries of assessment, verdicts, failures, bounded subgraphs, the evolution of a field, contradictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as T
from quillgraph.operators import assessment as A
from quillgraph.operators import similarity as X
from quillgraph.operators.graph import graph_of_tables
from quillgraph.plans import sqltext as S
from quillgraph.plans.registry import query
from quillgraph.runtime import table

_CHAIN = """
WITH p AS (SELECT p_brand AS hypothesis, p_partkey AS prediction, CASE WHEN p_size < 30 THEN 'target' ELSE 'proxy' END AS role FROM part), o AS (SELECT l_partkey AS prediction, l_orderkey AS run, l_tax < 0.01 AS valid FROM lineitem)
"""


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("prediction"), F.col("l_orderkey").alias("run"), (F.col("l_tax") < 0.01).alias("valid"))


@query("evidence_chain", _CHAIN + """
, s AS (SELECT prediction, count(*) AS n, bool_or(valid) AS ok FROM o GROUP BY prediction), r AS (SELECT p.*, coalesce(n, 0) AS n, CASE WHEN ok THEN 'observed' WHEN n > 0 THEN 'unassessable' ELSE 'not_measured' END AS status FROM p LEFT JOIN s USING (prediction)),
g AS (SELECT hypothesis, count(*) FILTER (role = 'target') AS t, count(*) FILTER (role = 'target' AND status = 'observed') AS h FROM r GROUP BY hypothesis)
SELECT r.*, CASE WHEN t = 0 THEN 'not_registered' WHEN h = t THEN 'observed' WHEN h > 0 THEN 'partially_observed' ELSE 'not_measured' END AS target_status FROM r JOIN g USING (hypothesis)
""")  # fmt: skip
def evidence_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions and a hypothesis's targets by whether they were observed (O200)."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("hypothesis"), F.col("p_partkey").alias("prediction"), F.when(F.col("p_size") < 30, "target").otherwise("proxy").alias("role"))
    return A.evidence_chain(p, _observations(spark, sf_dir))


@query("proxy_links", _CHAIN + """
, x AS (SELECT p_partkey AS prediction, (SELECT min(p_partkey) FROM part) AS target FROM part WHERE p_size >= 30), v AS (SELECT DISTINCT prediction, run FROM o WHERE valid)
SELECT x.prediction, x.target, coalesce(string_agg(CAST(a.run AS VARCHAR), ',' ORDER BY CAST(a.run AS VARCHAR)) FILTER (b.run IS NOT NULL), '') AS runs FROM x LEFT JOIN v a ON a.prediction = x.prediction LEFT JOIN v b ON b.prediction = x.target AND b.run = a.run GROUP BY x.prediction, x.target
""")  # fmt: skip
def proxy_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in which a proxy and its target were both observed (O200)."""
    part = table(spark, sf_dir, "part")
    first = part.agg(F.min("p_partkey").alias("target"))
    proxies = part.where("p_size >= 30").select(F.col("p_partkey").alias("prediction"), F.lit(1).alias("one")).join(first.withColumn("one", F.lit(1)), "one").select("prediction", "target")
    return A.proxy_links(proxies, _observations(spark, sf_dir))


@query("protocol_checks", """
WITH r AS (SELECT o_orderkey AS run, o_custkey AS action, CASE WHEN o_totalprice > 50000 THEN o_orderpriority END AS f1, o_orderstatus AS f2, CASE WHEN c_acctbal > 0 THEN '1-URGENT' END AS w1, CASE WHEN c_mktsegment < 'F' THEN 'O' ELSE 'F' END AS w2 FROM orders JOIN customer ON c_custkey = o_custkey),
s AS (SELECT run, action, array_to_string(list_filter([CASE WHEN w1 <> f1 THEN 'priority' END, CASE WHEN w2 <> f2 THEN 'status' END], lambda z: z IS NOT NULL), ',') AS mismatch, CASE WHEN w1 IS NULL OR f1 IS NULL THEN 'priority' ELSE '' END AS unknown FROM r)
SELECT *, CASE WHEN mismatch <> '' THEN 'mismatch' WHEN unknown <> '' THEN 'unknown' ELSE 'matched' END AS status FROM s
""")  # fmt: skip
def protocol_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by whether they kept to the planned protocol: a run is an order, an action its customer (O201, O202)."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    run, action = F.col("o_orderkey").alias("run"), F.col("c_custkey").alias("action")
    fields = lambda a, b: F.explode(F.array(F.struct(F.lit("priority").alias("field"), a.alias("value")), F.struct(F.lit("status").alias("field"), b.alias("value")))).alias("x")
    planned = customer.select(action, fields(F.when(F.col("c_acctbal") > 0, "1-URGENT"), F.when(F.col("c_mktsegment") < "F", "O").otherwise("F"))).select("action", "x.*")
    recorded = orders.select(run, fields(F.when(F.col("o_totalprice") > 50000, F.col("o_orderpriority")), F.col("o_orderstatus"))).select("run", "x.*")
    return A.protocol_status(orders.select(run, F.col("o_custkey").alias("action")), planned.select("action", "field"), planned, recorded)


@query("observation_assessment", """
WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, o_orderstatus = 'F' AS done, l_returnflag = 'R' AS matched, l_tax > 0.02 AS testable, CASE WHEN l_discount > 0 THEN l_quantity END AS e, CASE WHEN l_tax > 0.03 THEN l_quantity - 2 END AS lo, l_quantity + 2 AS hi, p_size - 5 AS low, p_size + 5 AS high, l_linestatus = 'F' AS v, l_discount > 0.05 AS c, l_discount > 0.08 AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
x AS (SELECT *, array_to_string(list_filter([CASE WHEN NOT done THEN 'run_not_completed' END, CASE WHEN NOT matched THEN 'protocol_mismatch' END, CASE WHEN NOT testable THEN 'action_design_incomplete' END, CASE WHEN e IS NULL THEN 'missing_measurement' WHEN lo IS NULL THEN 'missing_uncertainty_interval' END], lambda z: z IS NOT NULL), ',') AS reasons FROM r),
y AS (SELECT *, CASE WHEN reasons <> '' THEN 'inconclusive' WHEN hi < low OR lo > high THEN 'inconsistent' WHEN lo >= low AND hi <= high THEN 'compatible' ELSE 'inconclusive' END AS relation FROM x)
SELECT id, reasons, relation, CASE WHEN reasons <> '' THEN 'unassessable' WHEN relation = 'compatible' THEN 'compatible' WHEN relation = 'inconsistent' AND v AND c AND n THEN 'excluded_in_scope' WHEN relation = 'inconsistent' AND v THEN 'weakened_in_scope' ELSE 'inconclusive' END AS status FROM y
""")  # fmt: skip
def observation_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an observation says about a prediction, and why it says nothing (O201)."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    q, tax, off = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    rows = line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("run_status"), F.when(F.col("l_returnflag") == "R", "matched").otherwise("mismatch").alias("protocol"),
        F.when(tax > 0.02, "testable").alias("action_design"), F.lit("testable").alias("hypothesis_design"), F.lit(None).cast("boolean").alias("reproduced"), F.when(off > 0, q).alias("estimate"), F.when(tax > 0.03, q - 2).alias("lower"), (q + 2).alias("upper"),
        (F.col("p_size") - 5).alias("low"), (F.col("p_size") + 5).alias("high"), F.lit(True).alias("ready"), (F.col("l_linestatus") == "F").alias("verified"), F.lit(True).alias("reviewed"), (off > 0.05).alias("confirmatory"), (off > 0.08).alias("necessary"),
    )
    return A.assessed_observations(rows).select("id", F.array_join("reasons", ",").alias("reasons"), "relation", "status")


@query("performance_claims", """
WITH r AS (SELECT l_orderkey AS claim, CASE WHEN l_linenumber <= 5 THEN 'target' ELSE 'proxy' END AS er, CASE WHEN l_linenumber = 3 THEN 'guardrail' ELSE 'primary' END AS ou, CASE WHEN l_linenumber % 2 = 1 THEN 'original' ELSE 'control' END AS ro, l_linenumber // 2 AS q, l_tax < 0.08 AS m, l_discount < 0.1 AS c,
  CASE WHEN l_quantity > 30 THEN 'meets_target' WHEN l_quantity > 5 THEN 'below_target' ELSE 'inconclusive' END AS res, l_quantity - 10 AS e FROM lineitem),
f AS (SELECT *, er = 'target' AND ou = 'primary' AS p, er = 'target' AND ou = 'primary' AND ro = 'original' AS o, ou = 'guardrail' AS g FROM r), k AS (SELECT claim, q, bool_or(p) AS p, bool_or(o) AS o, bool_or(o AND NOT m) AS um, bool_or((o OR g) AND NOT c) AS lo, bool_or(o AND res = 'below_target') AS b, bool_or(p AND ro = 'control' AND res = 'meets_target') AS ct,
  bool_or((o OR g) AND c AND e > 0 AND res = 'meets_target') AS gain, bool_or((o OR g) AND res = 'below_target') AS loss, bool_or((o OR g) AND res <> 'meets_target') AS short FROM f GROUP BY claim, q),
x AS (SELECT claim, bool_or(b) AS b, bool_or(gain) AS gain, bool_or(loss) AS loss, bool_or(short) AS short, bool_or(b AND ct) AS part, count(*) FILTER (gain OR loss) AS moved, array_to_string(list_filter([CASE WHEN NOT bool_or(p) THEN 'target_outcome_not_registered' END, CASE WHEN bool_or(p AND NOT o) THEN 'original_target_comparison_missing' END,
  CASE WHEN bool_or(um) THEN 'target_outcome_not_measured' END, CASE WHEN bool_or(lo) THEN 'target_evidence_not_confirmatory' END], lambda z: z IS NOT NULL), ',') AS reasons FROM k GROUP BY claim)
SELECT claim, CASE WHEN reasons <> '' THEN 'not_established' WHEN gain AND loss AND moved > 1 THEN 'tradeoff' WHEN part THEN 'partial_recovery' WHEN NOT short THEN 'improved_in_scope' WHEN b THEN 'below_target_in_scope' ELSE 'inconclusive' END AS status, reasons FROM x
""")  # fmt: skip
def performance_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comparisons establish about a claim of performance (O202)."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("claim"), F.when(n <= 5, "target").otherwise("proxy").alias("evidence_role"), F.when(n == 3, "guardrail").otherwise("primary").alias("outcome_role"), F.when(n % 2 == 1, "original").otherwise("control").alias("role"), F.floor(n / 2).alias("quantity"), F.lit("points").alias("unit"),
        (F.col("l_tax") < 0.08).alias("measured"), (F.col("l_discount") < 0.1).alias("confirmatory"), F.when(q > 30, "meets_target").when(q > 5, "below_target").otherwise("inconclusive").alias("result"), F.lit(True).alias("difference"), (q - 10).alias("estimate"), F.lit(True).alias("higher"),
    )
    return A.performance_claims(rows)


_VERDICTS = """
WITH d AS (SELECT l_partkey AS id, arg_max(CASE WHEN l_quantity > 49 THEN 'drop' WHEN l_quantity > 20 THEN 'rename' ELSE 'keep' END, (l_orderkey, l_linenumber, l_quantity, l_tax)) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey),
n AS (SELECT p_partkey AS id, p_name AS old, CASE WHEN v = 'rename' THEN upper(p_brand) ELSE p_name END AS name, v FROM part LEFT JOIN d ON d.id = p_partkey WHERE coalesce(v, 'keep') <> 'drop')
"""


def _verdicts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    q = F.col("l_quantity")
    said = line.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"), F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_tax").alias("place"), F.when(q > 49, " Drop").when(q > 20, "rename").otherwise("fine").alias("verdict"))
    decisions = said.join(part.select(F.col("p_partkey").alias("id"), F.upper("p_brand").alias("name")), "id")
    nodes = part.select(F.col("p_partkey").alias("id"), F.lit("Method").alias("type"), F.col("p_name").alias("name"), F.array(F.col("p_type"), F.col("p_name")).alias("aliases"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    edges = line.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), F.lit("USES").alias("type")).where("dst is not null")
    return A.applied_decisions(nodes, edges, decisions)


@query("node_verdicts", _VERDICTS + f"""
SELECT n.id, 'Method' AS type, name, {S.normalized("name")} AS normalized, array_to_string(list_filter(list_distinct([p_type, p_name]), lambda z: z <> name), ',') AS aliases, v IS NOT NULL AS checked, coalesce(v, 'keep') AS verdict FROM n JOIN part ON p_partkey = n.id
""".replace("list_filter(list_distinct([p_type, p_name])", "list_filter([p_type, p_name]"))  # fmt: skip
def node_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes after the last verdict on each: kept, renamed with the old name as an alias, or gone (O111)."""
    return _verdicts(spark, sf_dir)[0].withColumn("aliases", F.array_join("aliases", ","))


@query("edge_verdicts", _VERDICTS + """
, e AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) SELECT src, dst, 'USES' AS type, count(*) AS n FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) GROUP BY src, dst
""")  # fmt: skip
def edge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of one kind between nodes that stay, as one (O111)."""
    return _verdicts(spark, sf_dir)[1]


_REASONS = ["Timed out after 30 s", "HTTP 429 Too Many Requests", "Unauthorized: API key", "Unexpected token < in JSON", "no result", "malformed query", "socket hang up", "strange", ""]


@query("provider_failures", f"""
WITH r AS (SELECT 'p' || user_id % 6 AS provider, ({_REASONS!r})[event_id % {len(_REASONS)} + 1] AS reason, CASE WHEN event_id % 10 = 0 THEN 503 WHEN event_id % 10 = 1 THEN 401 END AS status FROM events WHERE event_type = 'error'), t AS (SELECT provider, CASE WHEN reason = '' THEN 'provider-failed' ELSE reason END AS reason, status, lower(CASE WHEN reason = '' THEN 'provider-failed' ELSE reason END || coalesce(' ' || status, '')) AS x FROM r)
SELECT provider, CASE WHEN status = 401 OR contains(x, 'unauthorized') THEN 'auth' WHEN contains(x, '429') THEN 'rate_limit' WHEN contains(x, 'malformed') THEN 'bad_query' WHEN contains(x, 'no result') THEN 'not_found' WHEN contains(x, 'json') THEN 'schema' WHEN status >= 500 OR contains(x, 'timed out') OR contains(x, 'socket') THEN 'network' ELSE 'unknown' END AS category, reason, count(*) AS n FROM t GROUP BY ALL
""")  # fmt: skip
def provider_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of providers by class and reason (O130)."""
    k = F.col("event_id")
    reason = F.get(F.array(*map(F.lit, _REASONS)), (k % len(_REASONS)).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("p"), F.col("user_id") % 6).alias("provider"), (F.col("event_type") != "error").alias("ok"), reason.alias("reason"), F.when(k % 10 == 0, 503).when(k % 10 == 1, 401).alias("status"))
    return A.failure_counts(rows)


@query("analysis_subgraph")
def analysis_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes around the first thirty ids within budgets, in the order of a queue; the budgets are the feature."""
    nodes, edges = graph_of_tables(spark, sf_dir)
    owned = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p:"), "l_suppkey").alias("id"), F.concat(F.lit("o:"), "l_orderkey").alias("paper")).groupBy("id").agg(F.array(F.min("paper")).alias("papers"))
    papers = nodes.select("id", "type", "year").join(owned, "id", "left")
    return A.analysis_subgraph(papers, edges.withColumn("id", F.concat_ws(">", "src", "type", "dst")), first=1993, last=1997)[0]


_FIELD = """
WITH RECURSIVE m AS (SELECT p_partkey AS id, CASE WHEN p_size > 3 THEN 1990 + p_size % 12 END AS year FROM part), x AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS source, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS target, l_returnflag FROM lineitem),
able AS (SELECT * FROM m WHERE year IS NULL OR year BETWEEN 1991 AND 1999), r AS (SELECT x.id, source, target, CASE l_returnflag WHEN 'A' THEN 'ADAPTS_METHOD' WHEN 'R' THEN 'REPLACES_METHOD' ELSE 'EXTENDS_METHOD' END AS type FROM x JOIN able a ON a.id = source JOIN able b ON b.id = target WHERE NOT coalesce(a.year > b.year, false)),
core AS (SELECT id FROM able WHERE id IN (SELECT p_partkey FROM part WHERE p_size = 7)), u AS (SELECT source AS a, target AS b FROM r UNION SELECT target, source FROM r), w AS (SELECT id, 0 AS depth FROM core UNION SELECT b, depth + 1 FROM w JOIN u ON u.a = w.id WHERE depth < 2),
f AS (SELECT w.id, year, CAST(min(depth) AS INTEGER) AS depth FROM w JOIN able USING (id) GROUP BY w.id, year), k AS (SELECT * FROM f ORDER BY depth, coalesce(year, 9999), id LIMIT 180), q AS (SELECT r.* FROM r WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k))
"""


def _field(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    owners = line.groupBy(F.col("l_partkey").alias("id")).agg(F.array(F.min("l_orderkey")).alias("papers"))
    methods = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 3, 1990 + F.col("p_size") % 12).alias("year")).join(owners, "id", "left")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    kind = F.when(F.col("l_returnflag") == "A", "ADAPTS_METHOD").when(F.col("l_returnflag") == "R", "REPLACES_METHOD").otherwise("EXTENDS_METHOD")
    relations = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("source"), F.lead("l_partkey").over(order).alias("target"), kind.alias("type")).where("target is not null")
    core = part.where("p_size = 7").select(F.col("p_partkey").alias("id"))
    return A.field_methods(methods, relations, core.where("false"), core, 1991, 1999)


@query("field_methods", _FIELD + "SELECT id, year, CASE WHEN depth = 0 THEN 'core' ELSE 'boundary' END AS role, depth FROM k")
def field_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core and boundary methods of a field within its budget."""
    return _field(spark, sf_dir)[0].drop("papers")


@query("field_turning_points", _FIELD + """
SELECT 'branch' AS type, source AS method, count(DISTINCT target) AS n FROM q GROUP BY source HAVING count(DISTINCT target) >= 2 UNION ALL SELECT 'convergence', target, count(DISTINCT source) FROM q GROUP BY target HAVING count(DISTINCT source) >= 2
UNION ALL SELECT CASE WHEN type = 'REPLACES_METHOD' THEN 'replacement' ELSE 'adaptation' END, target, count(*) FROM q WHERE type <> 'EXTENDS_METHOD' GROUP BY 1, 2
""")  # fmt: skip
def field_turning_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches, convergences, replacements and adaptations of a field."""
    return A.turning_points(_field(spark, sf_dir)[1])


@query("field_papers", _FIELD + """
, o AS (SELECT l_partkey AS id, min(l_orderkey) AS paper FROM lineitem GROUP BY l_partkey)
SELECT a.paper AS source, b.paper AS target, q.type, count(*) AS n FROM q JOIN o a ON a.id = q.source JOIN o b ON b.id = q.target WHERE a.paper <> b.paper GROUP BY ALL
""")  # fmt: skip
def field_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of a field's methods between their papers."""
    return A.paper_relations(*_field(spark, sf_dir))


@query("field_families")
def field_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of a field's methods with their longest line."""
    return A.families(*_field(spark, sf_dir))


_CLAIMED = "p_name || CASE p_size % 3 WHEN 0 THEN ' better than others' WHEN 1 THEN ' worse than others' ELSE ' with others' END || ' lot' || CAST(CAST(floor(p_partkey / 12) AS BIGINT) AS VARCHAR)"


@query("claim_contradictions", f"""
WITH c AS (SELECT p_partkey AS id, p_brand AS paper, {_CLAIMED} AS x FROM part), t AS (SELECT id, {S.content_tokens(S.normalized("x"))} AS t FROM c), o AS (SELECT id, tok, min(place) AS place FROM (SELECT id, unnest(t) AS tok, unnest(range(1, len(t) + 1)) AS place FROM t) WHERE length(tok) >= 4 GROUP BY id, tok),
b AS (SELECT id, tok FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) <= 8), f AS (SELECT tok FROM b GROUP BY tok HAVING count(*) BETWEEN 2 AND 48), p AS (SELECT DISTINCT x.id AS a, y.id AS b FROM b x JOIN b y ON x.tok = y.tok AND x.id < y.id JOIN f ON f.tok = x.tok),
s AS (SELECT id, paper, CASE WHEN regexp_matches(lower(x), '{T.POSITIVE}') AND NOT regexp_matches(lower(x), '{T.NEGATIVE}') THEN 1 WHEN regexp_matches(lower(x), '{T.NEGATIVE}') AND NOT regexp_matches(lower(x), '{T.POSITIVE}') THEN -1 ELSE 0 END AS side FROM c)
SELECT a, b, round({S.jaccard("list_distinct(x.t)", "list_distinct(y.t)")}, 3) AS score FROM p JOIN t x ON x.id = a JOIN t y ON y.id = b JOIN s m ON m.id = a JOIN s n ON n.id = b WHERE m.paper <> n.paper AND m.side * n.side = -1 AND {S.jaccard("list_distinct(x.t)", "list_distinct(y.t)")} >= 0.32
""")  # fmt: skip
def claim_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar claims of different papers with opposite polarity."""
    size = F.col("p_size") % 3
    text = F.concat("p_name", F.when(size == 0, " better than others").when(size == 1, " worse than others").otherwise(" with others"), F.lit(" lot"), F.floor(F.col("p_partkey") / 12).cast("string"))
    return X.contradictions(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("paper"), text.alias("text")), "id", "text", "paper")
