"""Queries of the evolution of methods. Methods are parts; an order leads from each line's part to the next line's, which gives the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators import methods as M
from quillgraph.plans import sqltext as S
from quillgraph.plans.registry import query
from quillgraph.runtime import table


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = line.withColumn("target", F.lead("l_partkey").over(w)).where("target is not null")
    kind = F.when(F.col("l_linestatus") == "F", F.get(F.array(*[F.lit(x) for x in M.STRONG]), (F.col("l_linenumber") % 5).cast("int"))).otherwise("COMPARES_METHOD")
    flag = F.col("l_returnflag")
    edges = steps.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("edge"), F.col("l_partkey").alias("source"), "target", kind.alias("type"), F.when(flag == "A", "accepted").when(flag == "R", "validated").otherwise("candidate").alias("status"),
        F.when(F.col("l_tax") > 0, F.concat(F.lit("quote "), F.col("l_tax"))).alias("quote"), (F.col("l_discount") != 0.07).alias("exact"), F.round(0.5 + F.col("l_discount") * 4, 6).alias("confidence"), "l_suppkey", "l_quantity",
    )
    years = line.groupBy(F.col("l_partkey").alias("node")).agg(F.min(F.year("l_shipdate")).alias("year"))
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_size") > 5, "Method").otherwise("Model").alias("type"), "p_name", "p_type", "p_size", "p_brand").join(years, "node", "left")
    return edges, nodes


_EDGES = f"""
WITH x AS (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS target FROM lineitem),
yr AS (SELECT l_partkey AS node, CAST(min(year(l_shipdate)) AS INTEGER) AS year FROM lineitem GROUP BY l_partkey), nd AS (SELECT p_partkey AS node, CASE WHEN p_size > 5 THEN 'Method' ELSE 'Model' END AS type, p_name, p_type, p_size, p_brand, year FROM part LEFT JOIN yr ON node = p_partkey),
e AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS edge, l_partkey AS source, target, CASE WHEN l_linestatus = 'F' THEN {list(M.STRONG)}[l_linenumber % 5 + 1] ELSE 'COMPARES_METHOD' END AS type, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'validated' ELSE 'candidate' END AS status,
  l_tax > 0 AS quoted, l_discount <> 0.07 AS exact, round(0.5 + l_discount * 4, 6) AS confidence, l_suppkey, l_quantity FROM x WHERE target IS NOT NULL),
v AS (SELECT e.*, s.year AS sy, t.year AS ty, list_filter([CASE WHEN coalesce(s.type, '') <> 'Method' OR coalesce(t.type, '') <> 'Method' THEN 'non_method_endpoint' END, CASE WHEN status = 'candidate' THEN 'not_accepted_or_validated' END, CASE WHEN NOT quoted THEN 'missing_exact_quote' END,
  CASE WHEN NOT exact THEN 'quote_not_exact_match' END, CASE WHEN e.type <> 'COMPARES_METHOD' AND s.year < t.year THEN 'reverse_temporal_direction' END], lambda r: r IS NOT NULL) AS reasons FROM e LEFT JOIN nd s ON s.node = e.source LEFT JOIN nd t ON t.node = e.target)
"""


@query("edge_validation", _EDGES + "SELECT edge, source, target, type, len(reasons) = 0 AS accepted, array_to_string(reasons, ',') AS reasons FROM v")
def edge_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which edges of methods hold, and why others do not."""
    return M.validate_edges(*_edges(spark, sf_dir)).select("edge", "source", "target", "type", "accepted", F.array_join("reasons", ",").alias("reasons"))


@query("edge_conflicts", _EDGES + """
, s AS (SELECT DISTINCT source AS a, target AS b FROM v WHERE len(reasons) = 0 AND type <> 'COMPARES_METHOD' AND source <> target)
SELECT s.a, s.b, r.a IS NOT NULL AS demoted FROM s LEFT JOIN s r ON r.a = s.b AND r.b = s.a
""")  # fmt: skip
def edge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong edges that hold in both directions demote each other."""
    held = M.validate_edges(*_edges(spark, sf_dir)).where(F.col("accepted") & F.col("type").isin(list(M.STRONG)) & (F.col("source") != F.col("target")))
    e = held.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    back = e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("demoted"))
    return e.join(back, ["a", "b"], "left").select("a", "b", F.coalesce("demoted", F.lit(False)).alias("demoted"))


@query("candidate_validation", _EDGES + """
, c AS (SELECT edge, type, type <> 'COMPARES_METHOD' AS strong, quoted, l_quantity < 48 AS has_context, exact, confidence, CASE WHEN sy IS NULL OR ty IS NULL THEN 'unknown' WHEN sy < ty THEN 'reverse' ELSE 'forward' END AS direction, l_suppkey % 4 = 0 AS stub, l_suppkey % 3 <> 0 AS resolved, l_quantity > 10 AS bd, l_suppkey % 7 <> 0 AS td FROM v),
r AS (SELECT *, list_filter([CASE WHEN strong AND NOT bd THEN 'missing_evidence_bottleneck_dimension' END, CASE WHEN strong AND NOT td THEN 'missing_evidence_tradeoff_dimension' END], lambda z: z IS NOT NULL) AS m FROM c),
z AS (SELECT *, list_concat(list_filter([CASE WHEN stub THEN 'target_method_stub' END, CASE WHEN strong AND NOT quoted THEN 'missing_exact_quote' END, CASE WHEN NOT has_context THEN 'missing_citation_context' END, CASE WHEN quoted AND has_context AND NOT exact THEN 'quote_not_exact_match' END, CASE WHEN confidence < 0.55 THEN 'low_semantic_confidence' END,
  CASE WHEN strong AND direction = 'unknown' THEN 'missing_temporal_year' END, CASE WHEN strong AND direction = 'reverse' THEN 'reverse_temporal_direction' END], lambda q: q IS NOT NULL), m) AS reasons FROM r)
SELECT edge, CASE WHEN NOT strong THEN 'not_required' WHEN len(m) > 0 THEN 'incomplete' ELSE 'complete' END AS completeness, CASE WHEN len(reasons) > 0 THEN 'candidate' WHEN strong AND resolved AND confidence >= 0.78 THEN 'authoritative' ELSE 'validated' END AS status, array_to_string(reasons, ',') AS reasons FROM z
""")  # fmt: skip
def candidate_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons, completeness and status of each candidate of evolution."""
    e = M.validate_edges(*_edges(spark, sf_dir)).drop("reasons", "accepted", "status")
    sy, ty, supp = F.col("source_year"), F.col("target_year"), F.col("l_suppkey")
    quote = F.coalesce("quote", F.lit(""))
    context = F.when(F.col("l_quantity") < 48, F.concat(F.lit("as "), F.when(F.col("exact"), quote).otherwise("another"), F.lit(" says"))).otherwise("")
    rows = e.withColumns({
        "context": context, "direction": F.when(sy.isNull() | ty.isNull(), "unknown").when(sy < ty, "reverse").otherwise("forward"), "stub": supp % 4 == 0, "resolved": supp % 3 != 0, "bottleneck_dimension": F.when(F.col("l_quantity") > 10, "cost"),
        "bottleneck_description": F.lit("too slow"), "mechanism_type": F.lit("sparse"), "mechanism_description": F.lit("skips work"), "tradeoff_dimension": F.when(supp % 7 != 0, "memory"),
    })
    return M.validate_candidates(rows).select("edge", "completeness", "status", F.array_join("reasons", ",").alias("reasons"))


@query("method_evidence", _EDGES + """
, r AS (SELECT target, edge, source AS key, len(reasons) = 0 AS accepted, confidence, coalesce(round(greatest(0.0, 1 - least(abs(sy - ty), 50) / 50.0), 4), 0) AS near, CASE WHEN type = 'COMPARES_METHOD' THEN 0.6 WHEN quoted THEN 1.0 ELSE 0.25 END AS whole, status = 'validated' AS dag FROM v),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY target, key ORDER BY accepted DESC, confidence DESC, near DESC, whole DESC, dag DESC, edge) = 1)
SELECT target, edge, accepted, near, whole, CAST(row_number() OVER (PARTITION BY target ORDER BY accepted DESC, confidence DESC, near DESC, whole DESC, dag DESC, edge) AS INTEGER) AS place FROM k QUALIFY place <= 10
""")  # fmt: skip
def method_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best pieces of evidence of each method, one a citing method (O142)."""
    e = M.validate_edges(*_edges(spark, sf_dir))
    whole = F.when(F.col("type") == "COMPARES_METHOD", "not_required").when(F.col("quote").isNotNull(), "complete").otherwise("incomplete")
    rows = e.select("target", "edge", F.col("source").cast("string").alias("key"), "accepted", "confidence", "source_year", "target_year", whole.alias("completeness"), (F.col("status") == "validated").alias("dag"))
    return M.ranked_evidence(rows, "target").select("target", "edge", "accepted", "near", "whole", "place")


_ASKED = [("a", "red widget"), ("b", "steel"), ("c", "17"), ("d", "small blue gadget of tin")]
_RESOLVE = " UNION ALL ".join(
    f"SELECT '{n}' AS query, node, p_name, year, CASE WHEN CAST(node AS VARCHAR) = '{q}' THEN 1.2 WHEN list_contains(norms, '{q}') THEN 1.0 WHEN len(list_filter(norms, lambda a: a <> '' AND (contains(a, '{q}') OR contains('{q}', a)))) > 0 THEN 0.82 ELSE round(CASE WHEN len(tk) = 0 OR len({S.content_tokens(f"'{q}'")}) = 0 THEN 0 ELSE len(list_filter({S.content_tokens(f"'{q}'")}, lambda u: list_contains(tk, u))) / CAST(greatest(1, len({S.content_tokens(f"'{q}'")})) AS DOUBLE) END, 4) END AS score FROM nm"
    for n, q in _ASKED
)


@query("method_resolution", _EDGES + f"""
, nm AS (SELECT node, p_name, year, list_distinct([{S.normalized("p_name")}, {S.normalized("p_name || ' ' || p_type")}]) AS norms, {S.content_tokens(S.normalized("p_name || ' ' || p_name || ' ' || p_type || ' ' || p_brand"))} AS tk FROM nd),
h AS (SELECT * FROM ({_RESOLVE}) WHERE score >= 0.25), b AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, coalesce(year, 9999), p_name, CAST(node AS VARCHAR)) AS INTEGER) AS place FROM h QUALIFY place <= 5)
SELECT query, CAST(node AS VARCHAR) AS node, score, CASE WHEN score >= 1.2 THEN 'id' WHEN score >= 1 THEN 'exact-or-alias' WHEN score >= 0.8 THEN 'alias-overlap' ELSE 'token-overlap' END AS reason, place, CASE WHEN sum(CASE WHEN round(mx - score, 6) < 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY query) > 1 THEN 'ambiguous' ELSE 'resolved' END AS ambiguity
FROM (SELECT *, max(score) OVER (PARTITION BY query) AS mx FROM b)
""")  # fmt: skip
def method_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods that four names may mean; the five best are the feature (O143)."""
    nodes = _edges(spark, sf_dir)[1]
    rows = nodes.select(F.col("node").cast("string").alias("node"), F.col("p_name").alias("name"), F.array(F.concat_ws(" ", "p_name", "p_type")).alias("aliases"), F.col("p_brand").alias("text"), "year")
    return M.resolve_methods(rows, _ASKED)


@query("evolution_axes", _EDGES + """
, a AS (SELECT v.edge, s.p_type AS bottleneck, CASE WHEN t.p_size % 6 = 0 THEN '' ELSE 'size ' || t.p_size % 6 END AS tradeoff FROM v JOIN nd s ON s.node = v.source JOIN nd t ON t.node = v.target WHERE len(reasons) = 0)
SELECT 'bottleneck' AS axis, CASE WHEN trim(bottleneck) = '' THEN 'bottleneck' ELSE bottleneck END AS dimension, count(*) AS n, count(DISTINCT edge) AS edges FROM a GROUP BY ALL UNION ALL SELECT 'tradeoff', CASE WHEN trim(tradeoff) = '' THEN 'tradeoff' ELSE tradeoff END, count(*), count(DISTINCT edge) FROM a GROUP BY ALL
""")  # fmt: skip
def evolution_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions of bottlenecks and trade-offs over edges that hold (O118)."""
    a = _axes(spark, sf_dir)
    side = lambda c: M.axis(a, c).select(F.lit(c).alias("axis"), "dimension", "n", "edges")
    return side("bottleneck").unionByName(side("tradeoff"))


def _axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = _edges(spark, sf_dir)
    held = M.validate_edges(edges, nodes).where("accepted")
    size = F.col("p_size") % 6
    source, target = nodes.select(F.col("node").alias("source"), F.col("p_type").alias("bottleneck")), nodes.select(F.col("node").alias("target"), F.when(size == 0, "").otherwise(F.concat(F.lit("size "), size)).alias("tradeoff"))
    return held.select("edge", "source", "target").join(source, "source").join(target, "target")


@query("evolution_gaps", _EDGES + """
, a AS (SELECT v.edge, s.p_type AS bottleneck, CASE WHEN t.p_size % 6 = 0 THEN 'tradeoff' ELSE 'size ' || t.p_size % 6 END AS tradeoff FROM v JOIN nd s ON s.node = v.source JOIN nd t ON t.node = v.target WHERE len(reasons) = 0),
tp AS (SELECT bottleneck, count(*) AS n FROM a GROUP BY bottleneck ORDER BY n DESC, bottleneck LIMIT 5), sh AS (SELECT bottleneck, tradeoff, count(DISTINCT edge) AS shared FROM a WHERE bottleneck IN (SELECT bottleneck FROM tp) GROUP BY ALL),
b AS (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY bottleneck ORDER BY shared DESC, tradeoff) = 1), g AS (SELECT b.bottleneck, count(DISTINCT a.edge) AS grounding FROM b JOIN a ON a.bottleneck = b.bottleneck OR a.tradeoff = b.tradeoff GROUP BY b.bottleneck)
SELECT bottleneck, tradeoff, shared, grounding, round(least(1.0, grounding / 3.0), 4) AS confidence, 'reduce ' || bottleneck || ' bottlenecks without increasing ' || tradeoff || ' costs' AS gap FROM b JOIN g USING (bottleneck)
""")  # fmt: skip
def evolution_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps that the commonest bottlenecks and the trade-offs on the same edges give; five are the feature (O118, O231)."""
    return M.gap_candidates(_axes(spark, sf_dir))


_NAMED = "p_name || CASE p_size % 4 WHEN 0 THEN ' mechanism' WHEN 1 THEN '-based strategy' WHEN 2 THEN ' module' ELSE '' END"


@query("mechanism_merge", f"""
WITH p AS (SELECT p_partkey AS node, {_NAMED} AS name, coalesce(n, 0) % 13 AS papers, coalesce(s, 0) AS nodes FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey),
k AS (SELECT *, array_to_string(list_filter(string_split(replace({S.normalized("name")}, '-', ' '), ' '), lambda t: t <> '' AND t NOT IN {M.GENERIC}), ' ') AS key, round(papers * 10 + nodes * 4 - length(name) / 1000.0, 6) AS rank FROM p),
b AS (SELECT key, node AS keeper FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank DESC, name, node) = 1), m AS (SELECT node, keeper FROM k JOIN b USING (key)),
e AS (SELECT DISTINCT l_partkey AS src, 'NEXT' AS type, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem), r AS (SELECT DISTINCT x.keeper AS src, type, y.keeper AS dst FROM e JOIN m x ON x.node = e.src JOIN m y ON y.node = e.dst WHERE x.keeper <> y.keeper OR e.src = e.dst)
SELECT keeper, count(*) AS merged, any_value(coalesce(o, 0)) AS edges FROM m LEFT JOIN (SELECT src, count(*) AS o FROM r GROUP BY src) ON src = keeper GROUP BY keeper
""")  # fmt: skip
def mechanism_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate mechanisms merge into the best supported one and edges follow (O112, O46)."""
    line = table(spark, sf_dir, "lineitem")
    used = line.groupBy(F.col("l_partkey").alias("node")).agg((F.count("*") % 13).alias("papers"), F.countDistinct("l_suppkey").alias("nodes"))
    size = F.col("p_size") % 4
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.concat("p_name", F.when(size == 0, " mechanism").when(size == 1, "-based strategy").when(size == 2, " module").otherwise("")).alias("name"))
    merged = M.merged_mechanisms(named.join(used, "node", "left"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    edges = line.select(F.col("l_partkey").alias("src"), F.lit("NEXT").alias("type"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null").distinct()
    out = M.remapped(edges, merged).groupBy(F.col("src").alias("keeper")).agg(F.count("*").alias("edges"))
    return merged.groupBy("keeper").agg(F.count("*").alias("merged")).join(out, "keeper", "left").select("keeper", "merged", F.coalesce("edges", F.lit(0)).alias("edges"))
