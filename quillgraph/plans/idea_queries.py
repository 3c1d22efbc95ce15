"""Queries of research ideas by template."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators import ideas as I
from quillgraph.plans import sqltext as S
from quillgraph.plans.registry import query
from quillgraph.runtime import table

_METHODS = f"""
WITH u AS (SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS uses, count(DISTINCT l_suppkey) AS problems FROM lineitem GROUP BY 1),
m AS (SELECT p_partkey AS method, p_name AS name, coalesce(uses, 0) AS uses, coalesce(problems, 0) AS problems, list_distinct({S.content_tokens(S.normalized("p_name"))}) AS w FROM part LEFT JOIN u ON u.id = p_partkey),
l AS (SELECT p_partkey AS seed, p_name || ' cost' AS name, p_size AS papers, list_distinct({S.content_tokens(S.normalized("p_name || ' cost'"))}) AS w FROM part),
"""


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("method")).agg(F.countDistinct("l_orderkey").alias("uses"), F.countDistinct("l_suppkey").alias("problems"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("method"), F.col("p_name").alias("name"))
    return part.join(used, "method", "left").fillna(0, ["uses", "problems"])


def _limitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seed"), F.concat("p_name", F.lit(" cost")).alias("name"), F.col("p_size").alias("papers"))


@query("limitation_ideas", _METHODS + f"""
r AS (SELECT DISTINCT seed, method FROM (SELECT l_partkey AS seed, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS method FROM lineitem) WHERE method IN (SELECT method FROM m)),
p AS (SELECT seed, method FROM r UNION ALL SELECT l.seed, m.method FROM l, m WHERE l.seed NOT IN (SELECT seed FROM r)), b AS (SELECT l.seed, m.*, papers, problems * 2 + uses + {S.jaccard("l.w", "m.w")} AS score FROM p JOIN l ON l.seed = p.seed JOIN m ON m.method = p.method QUALIFY row_number() OVER (PARTITION BY l.seed ORDER BY problems * 2 + uses + {S.jaccard("l.w", "m.w")} DESC, m.method) = 1)
SELECT 'limitation_reversal' AS template, seed, method, round(1.4 * least(5, 2.4 + score) + 1.3 * 4.2 + 1.1 * least(5, 2 + uses * 0.8) + 1.2 * least(5, 1.6 + papers * 0.7 + uses * 0.5) - 0.9 * (1.7 + CASE WHEN uses < 2 THEN 1.2 ELSE 0.4 END) - 0.6 * CASE WHEN regexp_matches(lower(name), '\\b(graph|retrieval|large|planning)\\b') THEN 2.2 ELSE 1.5 END + 1e-9, 2) AS total FROM b
""")  # fmt: skip
def limitation_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limitations with the method that may lift them (a part of O146)."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    remedies = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("seed"), F.lead("l_partkey").over(order).alias("method")).where("method is not null")
    return I.limitation_ideas(_limitations(spark, sf_dir), remedies, _methods(spark, sf_dir))


@query("transfer_ideas", _METHODS + f"""
b AS (SELECT l.seed, m.*, problems + uses + {S.jaccard("l.w", "m.w")} AS score FROM l, m QUALIFY row_number() OVER (PARTITION BY l.seed ORDER BY problems + uses + {S.jaccard("l.w", "m.w")} DESC, method) = 1)
SELECT 'cross_problem_transfer' AS template, seed, method, round(1.4 * least(5, 2 + score * 0.8) + 1.3 * 4.3 + 1.1 * least(5, 2.2 + uses * 0.6) + 1.2 * least(5, 1.8 + uses * 0.8) - 0.9 * 2.1 - 0.6 * CASE WHEN regexp_matches(lower(name), '\\b(graph|retrieval|planning)\\b') THEN 2.2 ELSE 1.6 END + 1e-9, 2) AS total FROM b
""")  # fmt: skip
def transfer_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods that may serve a problem (a part of O146)."""
    return I.transfer_ideas(_limitations(spark, sf_dir).select("seed", "name"), _methods(spark, sf_dir))


@query("evidence_ideas", """
WITH c AS (SELECT l_orderkey AS seed, count(*) FILTER (l_returnflag = 'R') AS e, count(*) FILTER (l_returnflag = 'A') AS d, count(*) FILTER (l_linestatus = 'F') AS m FROM lineitem GROUP BY 1)
SELECT 'evidence_gap' AS template, seed, round(1.4 * 4.2 + 1.3 * 3.3 + 1.1 * 4.1 + 1.2 * greatest(1.2, 3.8 - e * 0.9) - 0.9 * (1.5 + CASE WHEN e > 0 THEN 0.4 ELSE 1.1 END) - 0.6 * (1.7 + CASE WHEN d = 0 THEN 0.8 ELSE 0.2 END) + 1e-9, 2) AS total FROM c WHERE NOT (e >= 2 AND d >= 1 AND m >= 1)
""")  # fmt: skip
def evidence_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose evidence is thin (a part of O146)."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("seed")).agg(n("l_returnflag", "R").alias("evidence"), n("l_returnflag", "A").alias("datasets"), n("l_linestatus", "F").alias("metrics"))
    return I.evidence_ideas(rows)


@query("coverage_ideas", """
WITH p AS (SELECT o_orderkey AS seed, count(DISTINCT l_partkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT 'problem_method_gap' AS template, seed, round(1.4 * 4.1 + 1.3 * 4 + 1.1 * 3.4 + 1.2 * greatest(1.8, 4.2 - n * 0.8) - 0.9 * 2.1 - 0.6 * 2.1 + 1e-9, 2) AS total FROM p WHERE n <= 2
""")  # fmt: skip
def coverage_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems that few methods cover (a part of O146)."""
    linked = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("seed")).agg(F.countDistinct("l_partkey").alias("methods"))
    return I.coverage_ideas(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seed")).join(linked, "seed", "left").fillna(0, ["methods"]), True)
