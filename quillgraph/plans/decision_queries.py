"""Queries of selection, preference, ledgers, certificates and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as T
from quillgraph.operators import select as L
from quillgraph.plans.registry import query
from quillgraph.runtime import table


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as candidates: utility by balance, domains and mechanisms by what they supply."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), ((F.col("s_acctbal") + 1000) / 11000).alias("utility"), F.array(F.col("s_nationkey").cast("string")).alias("domains"))
    made = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand"), "l_partkey")
    sets = made.groupBy(F.col("l_suppkey").cast("string").alias("id")).agg(F.array_sort(F.collect_set("p_type")).alias("mechanisms"), F.array_sort(F.collect_set("p_brand")).alias("aspects"))
    return s.join(sets, "id")


def _frame(spark: SparkSession, chosen: list[dict]) -> DataFrame:
    return spark.createDataFrame([(i, c["id"], round(float(c["utility"]), 6)) for i, c in enumerate(chosen, 1)], "place int, id string, utility double")


@query("select_mmr")
def select_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal marginal relevance of five candidates (O138, O141)."""
    return _frame(spark, L.mmr(_candidates(spark, sf_dir), 5, ["domains", "mechanisms", "aspects"]))


@query("select_submodular")
def select_submodular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy coverage selection of five candidates (O139)."""
    return _frame(spark, L.submodular(_candidates(spark, sf_dir), 5, ["domains", "mechanisms"], {"domains": 0.35, "mechanisms": 0.4, "aspects": 0.25}))


@query("select_dpp")
def select_dpp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Determinantal selection of five candidates (O140)."""
    return _frame(spark, L.determinantal(_candidates(spark, sf_dir), 5, "aspects"))


@query("select_topk", """
SELECT CAST(s_suppkey AS VARCHAR) AS id, round((s_acctbal + 1000) / 11000, 6) AS utility, CAST(row_number() OVER (ORDER BY s_acctbal DESC, CAST(s_suppkey AS VARCHAR)) AS INTEGER) AS place FROM supplier WHERE s_acctbal <= 9000 ORDER BY place LIMIT 10
""")
def select_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best suppliers whose balance passes a gate (O141)."""
    s = table(spark, sf_dir, "supplier").where("s_acctbal <= 9000").select(F.col("s_suppkey").cast("string").alias("id"), "s_acctbal")
    best = s.orderBy(F.desc("s_acctbal"), "id").limit(10)
    return best.select("id", F.round((F.col("s_acctbal") + 1000) / 11000, 6).alias("utility"), F.row_number().over(Window.orderBy(F.desc("s_acctbal"), "id")).alias("place"))


_DECISIONS = """
WITH d AS (SELECT l_suppkey % 50 AS winner, (l_suppkey + l_partkey + 1) % 50 AS loser, l_linenumber % 4 = 0 AS tie, l_discount * 5 + 0.1 AS weight FROM lineitem WHERE l_suppkey % 50 <> (l_suppkey + l_partkey + 1) % 50)
"""


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("winner"), ((F.col("l_suppkey") + F.col("l_partkey") + 1) % 50).alias("loser"), (F.col("l_linenumber") % 4 == 0).alias("tie"), (F.col("l_discount") * 5 + 0.1).alias("weight"))
    return d.where("winner <> loser")


@query("bradley_terry")
def bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abilities from weighted pairwise decisions (O209)."""
    return L.bradley_terry(_decisions(spark, sf_dir))


@query("beta_posterior", _DECISIONS + """
, r AS (SELECT winner AS id, CASE WHEN tie THEN greatest(0.05, weight) / 2 ELSE greatest(0.05, weight) END AS a, CASE WHEN tie THEN greatest(0.05, weight) / 2 ELSE 0 END AS b FROM d
UNION ALL SELECT loser, CASE WHEN tie THEN greatest(0.05, weight) / 2 ELSE 0 END, CASE WHEN tie THEN greatest(0.05, weight) / 2 ELSE greatest(0.05, weight) END FROM d), s AS (SELECT id, 1 + sum(a) AS a, 1 + sum(b) AS b FROM r GROUP BY id)
SELECT id, round(a / (a + b), 6) AS mean, round(a * b / ((a + b) * (a + b) * (a + b + 1)), 9) AS variance FROM s
""")  # fmt: skip
def beta_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior mean and variance of each candidate (O210)."""
    return L.beta_posterior(_decisions(spark, sf_dir)).select("id", F.round("mean", 6).alias("mean"), F.round("variance", 9).alias("variance"))


@query("posterior_groups", """
WITH v AS (SELECT s_nationkey AS grp, s_suppkey AS id, round(s_acctbal / 10000, 6) AS value FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY value DESC, id) AS rn FROM v)
SELECT grp, count(*) AS n, round(avg(value), 6) AS mean, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) FILTER (rn <= 5) AS best FROM r GROUP BY grp
""")  # fmt: skip
def posterior_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each group and its five best ids (O211)."""
    v = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("id"), F.round(F.col("s_acctbal") / 10000, 6).alias("value"))
    w = Window.partitionBy("grp").orderBy(F.desc("value"), "id")
    top = v.withColumn("rn", F.row_number().over(w)).where("rn <= 5").groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"].cast("string")), ",").alias("best"))
    return v.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).join(top, "grp")


@query("offline_bandit", """
WITH p AS (SELECT l_suppkey % 25 AS arm, (l_quantity - 1) / 49 AS reward FROM lineitem), n AS (SELECT count(*) AS n FROM p)
SELECT arm, count(*) AS pulls, CAST(sum(CASE WHEN reward >= 0.55 THEN 1 ELSE 0 END) AS BIGINT) AS successes, round(avg(reward), 6) AS mean, round(avg(reward) + sqrt(2 * ln(any_value(n)) / count(*)), 6) AS ucb,
  round((sum(CASE WHEN reward >= 0.55 THEN 1 ELSE 0 END) + 1) / CAST(count(*) + 2 AS DOUBLE), 6) AS thompson FROM p, n GROUP BY arm
""")  # fmt: skip
def offline_bandit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UCB index and Thompson mean of each arm (O216)."""
    p = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 25).alias("arm"), ((F.col("l_quantity") - 1) / 49).alias("reward"))
    return L.bandit_arms(p, "arm", "reward", p.count())


@query("budget_ledger", """
WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS spent, round(sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE 0 END), 2) AS committed, round(2000000 - sum(o_totalprice), 2) AS remaining FROM r WHERE rn <= 5 GROUP BY o_custkey
""")  # fmt: skip
def budget_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spent, committed and remaining over each owner's five latest runs (O203)."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    r = table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    price, done = F.col("o_totalprice"), F.col("o_orderstatus") == "F"
    return r.groupBy("o_custkey").agg(F.round(F.sum(F.when(done, price).otherwise(0)), 2).alias("spent"), F.round(F.sum(F.when(~done, price).otherwise(0)), 2).alias("committed"), F.round(2000000 - F.sum(price), 2).alias("remaining"))


@query("usage_summary", """
SELECT l_returnflag AS phase, l_linestatus AS model, count(*) AS requests, CAST(sum(l_quantity) AS BIGINT) AS tokens FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus))
""")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals overall, by phase and by model in one pass (O131, O132, O133)."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("phase"), F.col("l_linestatus").alias("model"), "l_quantity")
    return line.groupingSets([[], [F.col("phase")], [F.col("model")]], "phase", "model").agg(F.count("*").alias("requests"), F.sum("l_quantity").cast("long").alias("tokens"))


@query("latest_state", """
SELECT user_id, event_type, event_id AS last_event, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn = 1
""")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered events folded into the present state of each key: one aggregation, no window (O176, O177)."""
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"), F.count("*").alias("n"))
    return g.select("user_id", F.col("last.event_type").alias("event_type"), F.col("last.event_id").alias("last_event"), "n")


@query("import_queue", """
WITH q AS (SELECT event_id, event_type, ts, CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status FROM events)
SELECT event_id, status, CAST(row_number() OVER (ORDER BY CASE status WHEN 'running' THEN 0 ELSE 1 END, ts, event_id) AS INTEGER) AS place FROM q WHERE status IN ('running', 'queued') ORDER BY place LIMIT 50
""")  # fmt: skip
def import_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next batch of tasks: running first, then oldest; the batch size is the feature (O172)."""
    kind = F.col("event_type")
    q = table(spark, sf_dir, "events").select("event_id", "ts", F.when(kind == "click", "running").when(kind == "view", "queued").when(kind == "error", "failed").otherwise("completed").alias("status")).where("status in ('running', 'queued')")
    order = [F.when(F.col("status") == "running", 0).otherwise(1), F.col("ts"), F.col("event_id")]
    return q.orderBy(*order).limit(50).withColumn("place", F.row_number().over(Window.orderBy(*order))).select("event_id", "status", "place")


@query("coverage_matrix", """
WITH a AS (SELECT r_regionkey AS area, r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)), k AS (SELECT DISTINCT c_mktsegment AS kind FROM customer), n AS (SELECT n_regionkey AS area, c_mktsegment AS kind, count(*) FILTER (c_acctbal > 9000) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT a.r_name AS area, k.kind, coalesce(n.n, 0) AS n, CASE WHEN coalesce(n.n, 0) >= 3 THEN 'strong' WHEN coalesce(n.n, 0) >= 1 THEN 'partial' ELSE 'none' END AS coverage FROM a CROSS JOIN k LEFT JOIN n USING (area, kind)
""")  # fmt: skip
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas by kinds of evidence: none, partial, strong (O225, O226)."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_mktsegment").alias("kind"), (F.col("c_acctbal") > 9000).cast("int").alias("hit"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("area"))
    n = c.groupBy("c_nationkey", "kind").agg(F.sum("hit").alias("n")).join(places, "c_nationkey").groupBy("area", "kind").agg(F.sum("n").alias("n"))
    every = lambda df: df.distinct().withColumn("all", F.lit(1))
    grid = every(places.select("area")).join(every(c.select("kind")), "all").drop("all")  # the matrix is every area by every kind
    full = grid.join(n, ["area", "kind"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select("area", "kind", "n", F.when(F.col("n") >= 3, "strong").when(F.col("n") >= 1, "partial").otherwise("none").alias("coverage"))


@query("storyline", """
SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around FROM conversations
""")
def storyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered beats with the next one and a window of two around: the windows that proposal_storyline uses."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("next_role"), F.count("*").over(w.rowsBetween(-2, 2)).alias("around"))


@query("chain_status", """
WITH p AS (SELECT DISTINCT l_partkey AS metric FROM lineitem), o AS (SELECT p_partkey AS metric, p_size FROM part WHERE p_size > 10)
SELECT p.metric, CASE WHEN o.metric IS NULL THEN 'not_measured' WHEN o.p_size > 40 THEN 'unassessable' ELSE 'observed' END AS status FROM p LEFT JOIN o USING (metric)
""")  # fmt: skip
def chain_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by whether they were observed."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("metric")).distinct()
    o = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("metric"), "p_size")
    return p.join(o, "metric", "left").select("metric", F.when(F.col("p_size").isNull(), "not_measured").when(F.col("p_size") > 40, "unassessable").otherwise("observed").alias("status"))


@query("judge_consistency", """
WITH a AS (SELECT doc_id, quality AS verdict FROM labels), b AS (SELECT doc_id, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS verdict, lang FROM documents)
SELECT lang, count(*) AS n, round(avg(CASE WHEN a.verdict = b.verdict THEN 1.0 ELSE 0 END), 6) AS match_rate FROM a JOIN b USING (doc_id) GROUP BY lang
""")  # fmt: skip
def judge_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match rate of two sets of verdicts (O219)."""
    b = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 300, 1).otherwise(0).alias("said"), "lang")
    return table(spark, sf_dir, "labels").join(b, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("quality") == F.col("said"), 1.0).otherwise(0.0)), 6).alias("match_rate"))


@query("assumption_groups", """
WITH a AS (SELECT DISTINCT lower(p_type) AS assumption, l_orderkey AS paper, p_brand AS method FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT assumption, count(DISTINCT paper) AS papers, count(DISTINCT method) AS methods, CASE WHEN count(DISTINCT method) >= 3 THEN 'high' WHEN count(DISTINCT method) >= 2 OR count(DISTINCT paper) >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM a GROUP BY assumption
""")  # fmt: skip
def assumption_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assumptions by papers and methods that share them (O230)."""
    a = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand"), "l_partkey")
    m, p = F.countDistinct("p_brand"), F.countDistinct("l_orderkey")
    g = a.groupBy(F.lower("p_type").alias("assumption")).agg(p.alias("papers"), m.alias("methods"))
    return g.withColumn("confidence", F.when(F.col("methods") >= 3, "high").when((F.col("methods") >= 2) | (F.col("papers") >= 3), "medium").otherwise("low"))


@query("invariants", """
SELECT 'orders_have_lines' AS invariant, count(*) = 0 AS passed, count(*) AS errors FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'lines_have_parts', count(*) = 0, count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'discount_in_range', count(*) = 0, count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 1
""")  # fmt: skip
def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named checks with their errors (O208)."""
    line, orders, part = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    checks = {
        "orders_have_lines": orders.join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"),
        "lines_have_parts": line.join(part, F.col("l_partkey") == F.col("p_partkey"), "left_anti"),
        "discount_in_range": line.where("l_discount < 0 or l_discount > 1"),
    }
    rows = [d.agg(F.count("*").alias("errors")).select(F.lit(k).alias("invariant"), (F.col("errors") == 0).alias("passed"), "errors") for k, d in checks.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("fragment_ideas", f"""
WITH l AS (SELECT s_suppkey AS limitation, s_nationkey AS area FROM supplier WHERE s_acctbal < 2000), m AS (SELECT n_nationkey AS area, n_regionkey FROM nation), c AS (SELECT c_nationkey AS area, count(*) AS support FROM customer GROUP BY ALL)
SELECT limitation, support, round(1.4 * least(5, 2.4 + support / 20.0) + 1.3 * 4.2 + 1.1 * least(5, 2 + 0.8 * support / 20.0) + 1.2 * least(5, 1.6 + 0.5 * support / 20.0) - 0.9 * (1.7 + CASE WHEN support < 40 THEN 1.2 ELSE 0.4 END) - 0.6 * 1.5, 2) AS score FROM l JOIN m USING (area) JOIN c USING (area)
""")  # fmt: skip
def fragment_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One template of ideas, from limitations, with the weighted idea score (a part of O146)."""
    support = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("area")).agg(F.count("*").alias("support"))
    lim = table(spark, sf_dir, "supplier").where("s_acctbal < 2000").select(F.col("s_suppkey").alias("limitation"), F.col("s_nationkey").alias("area"))
    s = F.col("support") / 20.0
    five = lambda x: F.least(F.lit(5.0), x)
    risk = 1.7 + F.when(F.col("support") < 40, 1.2).otherwise(0.4)
    score = 1.4 * five(2.4 + s) + 1.3 * 4.2 + 1.1 * five(2 + 0.8 * s) + 1.2 * five(1.6 + 0.5 * s) - 0.9 * risk - 0.6 * 1.5
    return lim.join(support, "area").select("limitation", "support", F.round(score, 2).alias("score"))
