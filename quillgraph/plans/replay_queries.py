"""Queries of replayed cases, ablations and relevance files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators import replay as R
from quillgraph.plans.registry import query
from quillgraph.runtime import table
from quillgraph.sources import citations

_CASES = """
WITH l AS (SELECT l_orderkey AS c, CASE WHEN l_linestatus = 'F' THEN 'baseline' ELSE 'candidate' END AS s, l_partkey AS paper, l_discount, l_tax, l_quantity, CAST(year(l_shipdate) AS INTEGER) AS y, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem),
k AS (SELECT DISTINCT o_orderkey AS c, s, CAST(CASE WHEN o_totalprice > 100000 THEN year(o_orderdate) END AS INTEGER) AS ly FROM orders JOIN l ON l.c = o_orderkey), g AS (SELECT DISTINCT c, paper FROM l WHERE l_discount > 0.05),
w AS (SELECT c, count(*) AS wanted FROM g GROUP BY c), h AS (SELECT c, s, count(*) AS hits FROM (SELECT DISTINCT c, s, paper FROM l WHERE place <= 2) JOIN g USING (c, paper) GROUP BY c, s),
nv AS (SELECT c, s, avg(1 - abs(l_discount * 10 - l_tax * 10)) FILTER (place > 1) AS a, avg(l_discount * 10) AS b FROM (SELECT c, s, place, least(1.0, l_discount * 10) / 10 AS l_discount, least(1.0, l_tax * 10) / 10 AS l_tax FROM l WHERE place <= 3) GROUP BY c, s),
gr AS (SELECT c, s, avg(CASE WHEN l_quantity > 20 THEN 1.0 ELSE 0 END) AS grounding FROM l WHERE l_returnflag = 'R' GROUP BY c, s), tr AS (SELECT c, s, avg(CASE WHEN l_quantity > 30 THEN 1.0 ELSE 0 END) AS traceability FROM l GROUP BY c, s), lt AS (SELECT l.c, l.s, count(*) AS late FROM l JOIN k ON k.c = l.c AND k.s = l.s WHERE y > ly GROUP BY l.c, l.s),
m AS (SELECT k.c AS "case", k.s AS system, CASE WHEN wanted IS NOT NULL THEN coalesce(hits, 0) / CAST(wanted AS DOUBLE) END AS recall, CAST(coalesce(a, b) AS DOUBLE) AS novelty, CAST(grounding AS DOUBLE) AS grounding, CAST(traceability AS DOUBLE) AS traceability, CAST(CASE WHEN ly IS NOT NULL THEN CASE WHEN late > 0 THEN 0 ELSE 1 END END AS DOUBLE) AS leakless
  FROM k LEFT JOIN w USING (c) LEFT JOIN h USING (c, s) LEFT JOIN nv USING (c, s) LEFT JOIN gr USING (c, s) LEFT JOIN tr USING (c, s) LEFT JOIN lt USING (c, s)),
r AS (SELECT "case", system, round(recall + 1e-9, 4) AS recall, round(novelty + 1e-9, 4) AS novelty, round(grounding + 1e-9, 4) AS grounding, round(traceability + 1e-9, 4) AS traceability, round(leakless + 1e-9, 4) AS leakless, round(list_avg(list_filter([recall, novelty, grounding, traceability, leakless], lambda z: z IS NOT NULL)) + 1e-9, 4) AS score FROM m)
"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").withColumns({"case": F.col("l_orderkey"), "system": F.when(F.col("l_linestatus") == "F", "baseline").otherwise("candidate"), "place": F.row_number().over(Window.partitionBy("l_orderkey", "l_linestatus").orderBy("l_linenumber", "l_partkey", "l_suppkey"))})
    year = F.when(F.col("o_totalprice") > 100000, F.year("o_orderdate"))
    cases = line.select("case", "system").distinct().join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case"), year.alias("last_year")), "case")
    cited = line.select("case", "system", "place", F.col("l_partkey").alias("paper"), F.year("l_shipdate").alias("year"))
    few, dimension = line.where("place <= 3"), F.concat_ws(":", "system", "place").alias("dimension")
    return R.replay_metrics(
        cases, cited, line.where("l_discount > 0.05").select("case", F.col("l_partkey").alias("paper")), line.where("l_returnflag = 'R'").select("case", "system", (F.col("l_quantity") > 20).alias("spanned")),
        line.select("case", "system", F.when(F.col("l_quantity") > 30, F.array(F.lit("claim"))).otherwise(F.array().cast("array<string>")).alias("refs")), few.select("case", "system", dimension, (F.col("l_discount") * 10).alias("score")), few.where("place > 1").select("case", dimension, (F.col("l_tax") * 10).alias("score")), 2,
    )


@query("replay_metrics", _CASES + "SELECT * FROM r")
def replay_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, novelty, grounding, traceability and leakage of replayed cases; a case is an order (O128)."""
    return _metrics(spark, sf_dir)


@query("replay_lift", _CASES + ", u AS (" + " UNION ALL ".join(f"SELECT \"case\", system, '{m}' AS metric, {m} AS v FROM r" for m in (*R.METRICS, "score")) + """), p AS (SELECT "case", metric, max(v) FILTER (system = 'candidate') AS c, max(v) FILTER (system = 'baseline') AS b FROM u GROUP BY "case", metric)
SELECT metric, round(avg(c) + 1e-9, 4) AS candidate, round(avg(b) + 1e-9, 4) AS baseline, round(avg(c - b), 4) AS lift FROM p GROUP BY metric
""")  # fmt: skip
def replay_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of candidates and baselines and the lift between them (O128)."""
    return R.replay_lift(_metrics(spark, sf_dir))


@query("ablation_deltas", """
WITH m AS (SELECT l_returnflag AS ablation, 'supplier ' || l_suppkey % 20 AS metric, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY 1, 2), b AS (SELECT metric, value AS base FROM m WHERE ablation = 'A')
SELECT ablation, m.metric, value, round(value - base, 6) AS delta FROM m LEFT JOIN b ON b.metric = m.metric WHERE ablation <> 'A'
""")  # fmt: skip
def ablation_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each ablation changes against the control (a part of O206)."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("ablation"), F.concat(F.lit("supplier "), F.col("l_suppkey") % 20).alias("metric")).agg(F.round(F.avg("l_quantity"), 6).alias("value"))
    return R.ablation_deltas(rows, "A")


@query("qrels", """
SELECT CAST(l_orderkey AS VARCHAR) AS query_id, 'd' || l_partkey AS corpus_id, l_linenumber - 1 AS score, count(*) AS n FROM lineitem WHERE l_linenumber > 1 AND l_returnflag <> 'N' GROUP BY ALL
""")
def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance judgements from lines in both common forms; lines that are none, and those without relevance, go."""
    q, d, s = F.col("l_orderkey").cast("string"), F.concat(F.lit("d"), "l_partkey"), (F.col("l_linenumber") - 1).cast("string")
    line = F.when(F.col("l_returnflag") == "R", F.concat_ws("\t", q, d, s)).when(F.col("l_returnflag") == "A", F.concat_ws(" ", q, F.lit("0"), d, s)).otherwise("query-id\tcorpus-id\tscore")
    return citations.parsed_qrels(table(spark, sf_dir, "lineitem").select(line.alias("value"))).groupBy("query_id", "corpus_id", "score").agg(F.count("*").alias("n"))


@query("replay_gates", """
WITH s AS (SELECT 's' || o_custkey AS suite, o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus <> 'P') AS cut, count(*) FILTER (o_orderpriority <> '1-URGENT') AS gold FROM orders GROUP BY ALL),
g AS (
  SELECT suite, 'replay_cases_present' AS gate, true AS ok FROM s UNION ALL SELECT suite, 'strict_time_cutoffs_present', cut = n FROM s UNION ALL SELECT suite, 'gold_labels_present', gold = n FROM s
  UNION ALL SELECT suite, 'statistical_significance_present', o_custkey % 3 > 0 FROM s UNION ALL SELECT suite, 'suite_status_passed', o_custkey % 2 = 0 FROM s
)
SELECT gate, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS incomplete FROM g GROUP BY gate
""")  # fmt: skip
def replay_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suites of customers with their orders as cases, in records of three shapes; suites by gate and verdict (O207)."""
    from quillgraph.operators import replay_suite as R

    o = table(spark, sf_dir, "orders")
    case = F.struct(
        F.struct(F.lit(1).alias("a")).alias("candidate"), F.struct(F.lit(1).alias("a")).alias("baseline"), F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("time_cutoff"),
        F.struct(F.when(F.col("o_orderpriority") != "1-URGENT", F.array(F.col("o_orderkey"))).alias("must_cite_set")).alias("gold"),
    )
    k = F.col("o_custkey")
    numbers = lambda p: F.struct(F.lit("paired bootstrap").alias("test"), F.lit(p).alias("p_value"), F.lit("9").alias("n"), F.lit(0.2).alias("delta"))
    metric = "must_cite_recall_at_k_improvement"
    shapes = [F.to_json(F.struct(F.struct(F.struct(numbers(0.2).alias(metric)).alias("tests")).alias("statistical_significance"))), F.to_json(F.struct(F.array(F.struct(F.lit("recall_at_20_improvement").alias("metric"), F.lit("wilcoxon").alias("method"), F.lit(0.01).alias("pValue"), F.lit(5).alias("caseCount"), F.lit(1.5).alias("lift"))).alias("statistical_tests"))), F.to_json(F.struct(F.struct(F.struct(numbers(0.01).alias("mustCiteRecallAtKImprovement")).alias("significance")).alias("statistics")))]
    # one record a part of the cases, and one with the rest, so that a suite of any size is rows of bounded size
    held = o.groupBy("o_custkey", (F.col("o_orderkey") % 4).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("o_orderkey").cast("string"), case))).alias("cases"))
    suite = F.concat(F.lit("s"), k).alias("suite")
    records = held.select(suite, F.to_json(F.struct("cases")).alias("value"))
    heads = o.select("o_custkey").distinct()
    status = heads.select(suite, F.to_json(F.struct(F.when(k % 2 == 0, "passed").otherwise("failed").alias("status"), F.struct(F.lit("masterset").alias("source")).alias("dataset"))).alias("value"))
    tests = heads.select(suite, F.get(F.array(*shapes), (k % 3).cast("int")).alias("value"))
    wanted = ["replay_cases_present", "strict_time_cutoffs_present", "gold_labels_present", "statistical_significance_present", "suite_status_passed"]
    found = R.gates(records.unionByName(status).unionByName(tests)).where(F.col("gate").isin(wanted))
    return found.groupBy("gate").agg(F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") == "incomplete").alias("incomplete"))
