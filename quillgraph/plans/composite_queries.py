"""Queries that put operators together: communities, lineages, candidate scores, adaptation, collisions, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators import community as Y
from quillgraph.plans.registry import query
from quillgraph.runtime import table


@query("communities")
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leiden communities of part names that occur in the same orders; the projection's caps are its definition (O101)."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("concept"))
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity"), "l_partkey").join(part, "l_partkey")
    seeds = m.groupBy("concept").agg(F.count("*").alias("score"))
    edges = [(r["a"], r["b"], r["weight"]) for r in Y.projected(m, seeds).collect()]
    return spark.createDataFrame(sorted(Y.leiden(edges).items()), "concept string, community int")


@query("method_lineage", """
WITH RECURSIVE x AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst, l_discount, l_quantity FROM lineitem),
e AS (SELECT src, dst, round(max(l_discount) * 5 + 0.4 + min(l_quantity) / 500, 6) AS confidence FROM x WHERE src <> dst GROUP BY ALL),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst) AS rn FROM e) WHERE rn <= 3),
p AS (SELECT [CAST(7 AS BIGINT)] AS path, CAST(7 AS BIGINT) AS last, 0 AS hops, CAST(0 AS DOUBLE) AS total UNION ALL SELECT list_append(path, s.dst), s.dst, hops + 1, total + confidence FROM p JOIN s ON s.src = p.last WHERE hops < 3 AND NOT list_contains(path, s.dst))
SELECT array_to_string(path, '>') AS path, hops, round(total / hops, 6) AS score FROM p WHERE hops > 0 ORDER BY round(total / hops, 6) DESC, hops DESC, p.path LIMIT 5
""")  # fmt: skip
def method_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best five lineages of one method, three branches a step; the caps are the operator's definition. A method leads to the next one of an order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), "l_discount", "l_quantity").where("src <> dst")
    e = line.groupBy("src", "dst").agg(F.round(F.max("l_discount") * 5 + 0.4 + F.min("l_quantity") / 500, 6).alias("confidence"))
    out = Y.lineages(e, F.lit(7).cast("long"))
    return out.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "hops", "score")


@query("method_adaptation", """
WITH need AS (SELECT s_nationkey AS problem, list_sort(list_distinct(list(s_suppkey % 12))) AS terms FROM supplier GROUP BY s_nationkey), have AS (SELECT p_brand AS method, list_distinct(list(p_size % 12)) AS terms FROM part GROUP BY p_brand)
SELECT problem, method, round(len(list_intersect(n.terms, h.terms)) / CAST(len(n.terms) AS DOUBLE), 6) AS fit, CASE WHEN len(list_intersect(n.terms, h.terms)) = len(n.terms) THEN 'hypothesis' ELSE 'needs_evidence' END AS status
FROM need n, have h WHERE len(list_intersect(n.terms, h.terms)) > 0
""")  # fmt: skip
def method_adaptation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a problem's terms that a method meets, found by an equi-join on terms (O153)."""
    need = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("problem"), (F.col("s_suppkey") % 12).cast("int").alias("term")).distinct()
    have = table(spark, sf_dir, "part").select(F.col("p_brand").alias("method"), (F.col("p_size") % 12).alias("term")).distinct()
    met = need.join(have, "term").groupBy("problem", "method").agg(F.count("*").alias("met"))
    total = need.groupBy("problem").agg(F.count("*").alias("terms"))
    return met.join(total, "problem").select("problem", "method", F.round(F.col("met") / F.col("terms"), 6).alias("fit"), F.when(F.col("met") == F.col("terms"), "hypothesis").otherwise("needs_evidence").alias("status"))


@query("composition_collisions", """
WITH t AS (SELECT DISTINCT l_orderkey AS prior, p_type AS component FROM lineitem JOIN part ON p_partkey = l_partkey), one AS (SELECT component AS components, count(*) AS hits FROM t GROUP BY component),
two AS (SELECT a.component || '+' || b.component AS components, count(*) AS hits FROM t a JOIN t b ON a.prior = b.prior AND a.component < b.component GROUP BY 1),
everything AS (SELECT '*' AS components, count(*) AS hits FROM (SELECT prior FROM t GROUP BY prior HAVING count(*) = (SELECT count(DISTINCT p_type) FROM part)))
SELECT *, CASE WHEN hits >= 1000 THEN 'high' WHEN hits >= 1 THEN 'medium' ELSE 'low' END AS risk FROM (FROM one UNION ALL FROM two UNION ALL FROM everything)
""")  # fmt: skip
def composition_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior work that has one component, two, or all (O226)."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("component")), "l_partkey").select(F.col("l_orderkey").alias("prior"), "component").distinct()
    kinds = table(spark, sf_dir, "part").select("p_type").distinct().count()
    one = t.groupBy(F.col("component").alias("components")).agg(F.count("*").alias("hits"))
    two = t.alias("a").join(t.alias("b"), "prior").where("a.component < b.component").groupBy(F.concat("a.component", F.lit("+"), "b.component").alias("components")).agg(F.count("*").alias("hits"))
    full = t.groupBy("prior").agg(F.count("*").alias("n")).where(F.col("n") == kinds).agg(F.count("*").alias("hits")).select(F.lit("*").alias("components"), "hits")
    return one.unionByName(two).unionByName(full).withColumn("risk", F.when(F.col("hits") >= 1000, "high").when(F.col("hits") >= 1, "medium").otherwise("low"))


@query("node_decisions", """
WITH d AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'drop' WHEN 1 THEN 'rename' ELSE 'keep' END AS verdict FROM part)
SELECT d.verdict, count(DISTINCT l_partkey) AS nodes, count(*) AS edges, min(CASE WHEN d.verdict = 'rename' THEN upper(p_name) ELSE p_name END) AS first_name FROM lineitem JOIN d ON d.p_partkey = l_partkey JOIN part p ON p.p_partkey = l_partkey WHERE d.verdict <> 'drop' GROUP BY d.verdict
""")  # fmt: skip
def node_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of nodes and edges by verdict; node_verdicts applies verdicts."""
    k = F.col("p_partkey") % 5
    verdict = F.when(k == 0, "drop").when(k == 1, "rename").otherwise("keep")
    kept = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), verdict.alias("verdict"), F.when(k == 1, F.upper("p_name")).otherwise(F.col("p_name")).alias("name")).where("verdict <> 'drop'")
    return table(spark, sf_dir, "lineitem").select("l_partkey").join(kept, "l_partkey").groupBy("verdict").agg(F.countDistinct("l_partkey").alias("nodes"), F.count("*").alias("edges"), F.min("name").alias("first_name"))
