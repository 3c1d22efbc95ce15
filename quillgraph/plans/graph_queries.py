"""Queries on the graph that the star schema means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as T
from quillgraph.operators import graph as G
from quillgraph.plans import sqltext as S
from quillgraph.plans.registry import query
from quillgraph.runtime import cut, table

_SEARCH = "red widget"


@query("search_groups", f"""
WITH q AS (SELECT {S.content_tokens(f"'{_SEARCH}'")} AS q),
h AS (SELECT p_partkey, p_brand, p_name, {S.content_tokens(S.normalized("p_name || ' ' || p_brand || ' ' || p_type"))} AS t, lower(p_name || chr(10) || p_brand || chr(10) || p_type) AS hay FROM part),
s AS (SELECT p_partkey, p_brand, len(list_filter(q, lambda x: list_contains(t, x))) / CAST(len(q) AS DOUBLE) AS overlap, CASE WHEN lower(p_name) = '{_SEARCH}' THEN 4 WHEN contains(lower(p_name), '{_SEARCH}') THEN 2 WHEN contains(hay, '{_SEARCH}') THEN 1 ELSE 0 END AS bonus FROM h, q),
g AS (SELECT p_brand AS scope, count(*) AS match_count, sum(overlap * 3 + bonus + 0.85) AS score, min(p_partkey) AS first_id FROM s WHERE overlap > 0 GROUP BY p_brand)
SELECT scope, match_count, round(score, 6) AS score, first_id FROM g ORDER BY round(score, 6) DESC, match_count DESC, scope LIMIT 5
""")  # fmt: skip
def search_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped keyword search: methods by brand; the best five groups are the feature (O105, O57, O58)."""
    hay = F.lower(F.concat_ws("\n", "p_name", "p_brand", "p_type"))
    q = T.content_tokens(T.normalize(F.lit(_SEARCH)))
    name = F.lower("p_name")
    hits = table(spark, sf_dir, "part").select("p_partkey", "p_brand", T.token_overlap(q, T.content_tokens(T.normalize(hay))).alias("overlap"), F.when(name == _SEARCH, 4).when(name.contains(_SEARCH), 2).when(hay.contains(_SEARCH), 1).otherwise(0).alias("bonus"))
    score = F.col("overlap") * 3 + F.col("bonus") + 0.85
    groups = hits.where("overlap > 0").groupBy(F.col("p_brand").alias("scope")).agg(F.count("*").alias("match_count"), F.round(F.sum(score), 6).alias("score"), F.min("p_partkey").alias("first_id"))
    return groups.orderBy(F.desc("score"), F.desc("match_count"), "scope").limit(5)


@query("context_1hop", S.GRAPH + """
, c AS (SELECT 'outgoing' AS direction, type AS relation, dst AS id FROM edges WHERE src = 'sub:3' UNION ALL SELECT 'incoming', type, src FROM edges WHERE dst = 'sub:3')
SELECT direction, relation, c.id, coalesce(n.name, c.id) AS name, coalesce(n.type, 'Unknown') AS node_type FROM c LEFT JOIN nodes n USING (id)
""")  # fmt: skip
def context_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions of one node."""
    nodes, edges = G.graph_of_tables(spark, sf_dir)
    return G.context(nodes, edges, "sub:3")


@query("impact_bfs", S.GRAPH + """
, walk AS (SELECT 'sub:5' AS id, 0 AS depth UNION SELECT e.src, w.depth + 1 FROM walk w JOIN edges e ON e.dst = w.id WHERE w.depth < 3),
r AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id), g AS (SELECT depth, n.type, count(*) AS n FROM r JOIN nodes n USING (id) WHERE depth > 0 GROUP BY depth, n.type)
SELECT depth, type, n, CASE WHEN sum(n) OVER () >= 18 THEN 'CRITICAL' WHEN sum(n) OVER () >= 10 THEN 'HIGH' WHEN sum(n) OVER () >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM g
""")  # fmt: skip
def impact_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upstream impact to depth 3, by depth and type, with the risk class."""
    nodes, edges = G.graph_of_tables(spark, sf_dir)
    seed = nodes.where("id = 'sub:5'")
    reached = G.bfs(edges, seed, 3, "in").where("depth > 0").join(nodes.select("id", "type"), "id").groupBy("depth", "type").agg(F.count("*").alias("n"))
    total = reached.agg(F.sum("n")).first()[0] or 0
    return reached.withColumn("risk", G.impact_risk(F.lit(total)))


@query("neighborhood_bfs", S.GRAPH + """
, u AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges), walk AS (SELECT 'p:7' AS id, 0 AS depth UNION SELECT u.b, w.depth + 1 FROM walk w JOIN u ON u.a = w.id WHERE w.depth < 2)
SELECT id, min(depth) AS depth FROM walk GROUP BY id
""")  # fmt: skip
def neighborhood_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected two-hop neighbourhood."""
    nodes, edges = G.graph_of_tables(spark, sf_dir)
    return G.bfs(edges, nodes.where("id = 'p:7'"), 2, "both")


@query("path_trace", S.GRAPH + """
, p AS (SELECT ['b:12'] AS path, 'b:12' AS last, 0 AS hops UNION ALL SELECT list_append(p.path, e.dst), e.dst, p.hops + 1 FROM p JOIN edges e ON e.src = p.last WHERE p.hops < 4 AND NOT list_contains(p.path, e.dst) AND NOT starts_with(p.last, 'dom:'))
SELECT array_to_string(path, '>') AS path, hops, round(1.0 / hops, 6) AS score FROM p WHERE last = 'dom:2'
""")  # fmt: skip
def path_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple paths of at most four hops from a benchmark to a domain."""
    nodes, edges = G.graph_of_tables(spark, sf_dir)
    paths = G.simple_paths(edges, nodes.where("id = 'b:12'"), nodes.where("id = 'dom:2'"), 4)
    return paths.select(F.array_join("path", ">").alias("path"), "hops", F.round("score", 6).alias("score"))


@query("layer_summary", S.GRAPH + """
SELECT layer, type, CAST(grouping(layer, type) AS BIGINT) AS level, count(*) AS n, min(year) AS first_year, max(year) AS last_year FROM nodes GROUP BY ROLLUP (layer, type)
""")
def layer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by layer and type with subtotals (O106, O107)."""
    nodes, _ = G.graph_of_tables(spark, sf_dir)
    return nodes.rollup("layer", "type").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("edge_cube", S.GRAPH + """
SELECT type, layer_scope, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges GROUP BY CUBE (type, layer_scope)
""")
def edge_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by type and layer scope, every combination (O54, O107)."""
    _, edges = G.graph_of_tables(spark, sf_dir)
    return G.edge_cube(edges)


@query("layer_and_year_filter", S.GRAPH + """
SELECT layer, type, year, count(*) AS n FROM nodes WHERE layer IN ('paper', 'problem') AND (year IS NULL OR year BETWEEN 1996 AND 1999) GROUP BY ALL
""")
def layer_and_year_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers from a list, a window of years that undated nodes pass."""
    nodes, _ = G.graph_of_tables(spark, sf_dir)
    return G.year_window(G.layer_filter(nodes, "paper, problem"), 1996, 1999).groupBy("layer", "type", "year").agg(F.count("*").alias("n"))


@query("induced_edges", S.GRAPH + """
, k AS (SELECT id FROM nodes WHERE layer IN ('problem', 'domain'))
SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)
""")
def induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges inside a node set, by two semi joins."""
    nodes, edges = G.graph_of_tables(spark, sf_dir)
    keep = G.layer_filter(nodes, "problem,domain").select("id")
    inside = edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return inside.select("src", "dst", "type")


@query("domain_distance", """
WITH m AS (SELECT DISTINCT s_suppkey AS entity, s_nationkey AS domain FROM supplier UNION SELECT s_suppkey, (s_nationkey + s_suppkey) % 25 FROM supplier),
adj AS (SELECT DISTINCT x.domain AS a, y.domain AS b FROM m x JOIN m y USING (entity) WHERE x.domain <> y.domain), c AS (SELECT * FROM adj UNION SELECT a, a FROM adj), s AS (SELECT a, count(*) AS n FROM c GROUP BY a),
o AS (SELECT x.a, y.a AS b, count(*) AS shared FROM c x JOIN c y ON x.b = y.b AND x.a < y.a GROUP BY ALL)
SELECT o.a, o.b, round(1 - shared / CAST(s.n + t.n - shared AS DOUBLE), 4) AS distance FROM o JOIN s ON s.a = o.a JOIN s t ON t.a = o.b
""")  # fmt: skip
def domain_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of domains by closed neighbourhoods (O100)."""
    s = table(spark, sf_dir, "supplier")
    m = s.select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").cast("long").alias("domain")).union(s.select("s_suppkey", ((F.col("s_nationkey") + F.col("s_suppkey")) % 25).cast("long"))).distinct()
    return G.domain_distance(m, G.domains_sharing_entities(m))


@query("paper_support", """
SELECT l_suppkey AS problem, count(DISTINCT l_orderkey) AS papers, count(DISTINCT l_partkey) AS methods, round(sum(l_quantity), 2) AS weight FROM lineitem GROUP BY l_suppkey
""")
def paper_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct papers and methods of each problem (O117)."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("problem")).agg(F.countDistinct("l_orderkey").alias("papers"), F.countDistinct("l_partkey").alias("methods"), F.round(F.sum("l_quantity"), 2).alias("weight"))


@query("global_nodes", """
SELECT 'Method' AS type, lower(p_name) AS name, count(*) AS mention_count, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS brands, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS types, max(p_retailprice) AS confidence FROM part GROUP BY lower(p_name)
""")
def global_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions with one type and normalised name become one node: unions, maximum, mentions (O156)."""
    union = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  brands and types are few, whatever the data's size
    return table(spark, sf_dir, "part").groupBy(F.lit("Method").alias("type"), F.lower("p_name").alias("name")).agg(F.count("*").alias("mention_count"), union("p_brand").alias("brands"), union("p_type").alias("types"), F.max("p_retailprice").alias("confidence"))


@query("similar_node_merge", """
WITH k AS (SELECT p_partkey, p_name, regexp_replace(lower(p_name), 's$', '') AS key FROM part), d AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS degree FROM lineitem GROUP BY l_partkey),
r AS (SELECT key, p_partkey, 10 * coalesce(degree, 0) + length(p_name) / 1000.0 AS score FROM k LEFT JOIN d ON l_partkey = p_partkey),
b AS (SELECT key, p_partkey AS representative, row_number() OVER (PARTITION BY key ORDER BY score DESC, p_partkey) AS rn FROM r),
m AS (SELECT k.p_partkey, b.representative FROM k JOIN b USING (key) WHERE rn = 1)
SELECT m.representative, l_suppkey AS target, count(DISTINCT l_orderkey) AS edges FROM lineitem JOIN m ON l_partkey = m.p_partkey GROUP BY ALL
""")  # fmt: skip
def similar_node_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with one key merge into the best-connected; edges are remapped and grouped (O110, O112)."""
    line = table(spark, sf_dir, "lineitem")
    keyed = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.regexp_replace(F.lower("p_name"), "s$", "").alias("key"))
    degree = line.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_orderkey").alias("degree"))
    score = 10 * F.coalesce("degree", F.lit(0)) + F.length("p_name") / 1000.0
    best = keyed.join(degree, "p_partkey", "left").groupBy("key").agg(F.max(F.struct(score.alias("s"), (-F.col("p_partkey")).alias("k"))).alias("best")).select("key", (-F.col("best.k")).alias("representative"))
    to = keyed.join(best, "key").select(F.col("p_partkey").alias("l_partkey"), "representative")
    return line.join(to, "l_partkey").groupBy("representative", F.col("l_suppkey").alias("target")).agg(F.countDistinct("l_orderkey").alias("edges"))


@query("graph_diff", """
WITH o AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 10 <> 1), n AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 2 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 10 <> 3)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM o FULL OUTER JOIN n ON o.c_custkey = n.c_custkey WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR o.c_acctbal <> n.c_acctbal
""")  # fmt: skip
def graph_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two states of a table differ in (O89, O157)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    key = F.col("c_custkey") % 10
    new = c.where(key != 3).withColumn("c_acctbal", F.when(key == 2, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return G.diff(c.where(key != 1), new, "c_custkey")


@query("refcount_delete", """
WITH r AS (SELECT DISTINCT l_orderkey AS source, l_partkey || '-' || l_suppkey AS id FROM lineitem), changed AS (SELECT o_orderkey AS source FROM orders WHERE o_orderstatus = 'P')
SELECT id FROM r GROUP BY id HAVING count(*) = 1 AND min(source) IN (SELECT source FROM changed)
""")
def refcount_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that only one changed source refers to (O158, O160)."""
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("id"))
    return G.deletable(refs, table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("source")))


@query("delta_apply", """
WITH e AS (SELECT DISTINCT l_orderkey AS src, l_suppkey AS dst FROM lineitem)
SELECT dst, count(*) AS n, min(src) AS first_src FROM (SELECT * FROM e WHERE dst % 10 <> 4 AND src NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 4) AND NOT (src % 7 = 0 AND dst % 3 = 0) UNION SELECT o_orderkey, 1000000 FROM orders WHERE o_orderkey % 50 = 0) GROUP BY dst
""")
def delta_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions with cascade, then upserts (O159, O161)."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("ADDRESSES").alias("type")).distinct()
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    fresh = table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("src"), F.lit(1000000).cast("long").alias("dst"), F.lit("ADDRESSES").alias("type"))
    _, after = G.apply_delta(nodes, edges, nodes.where("id % 10 = 4"), edges.where("src % 7 = 0 and dst % 3 = 0"), nodes.limit(0), fresh)
    return after.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("first_src"))


@query("evidence_chains", """
WITH x AS (SELECT l_orderkey, l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)
SELECT o_orderkey, o_orderpriority, l_suppkey AS problem, l_partkey AS method, rn AS place FROM orders JOIN x ON l_orderkey = o_orderkey WHERE rn <= 3
""")
def evidence_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper, problem, method: the three strongest of each paper."""
    best = G.first_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")], 3, "place")
    chained = table(spark, sf_dir, "orders").join(best, F.col("o_orderkey") == F.col("l_orderkey"))
    return chained.select("o_orderkey", "o_orderpriority", F.col("l_suppkey").alias("problem"), F.col("l_partkey").alias("method"), "place")


@query("chronology", """
SELECT o_custkey, o_orderkey, CAST(date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS INTEGER) AS gap_days, row_number() OVER w AS place FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations in time with the gap to the one before (O34, O144)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).alias("gap_days"), F.row_number().over(w).alias("place"))


@query("node_resolution", S.GRAPH + """
, h AS (SELECT id, type, name, lower(name) = 'red widget' OR id = 'red widget' AS exact, CASE type WHEN 'Problem' THEN 0 WHEN 'Method' THEN 5 WHEN 'Paper' THEN 8 WHEN 'Benchmark' THEN 15 ELSE 20 END AS priority FROM nodes WHERE contains(lower(name), 'red widget') OR id = 'red widget')
SELECT id, type, exact, CAST(row_number() OVER (ORDER BY exact DESC, priority, name, id) AS INTEGER) AS place FROM h ORDER BY place LIMIT 20
""")  # fmt: skip
def node_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for a name: exact first, then type priority, then name; at most twenty by definition (O137)."""
    nodes, _ = G.graph_of_tables(spark, sf_dir)
    name = F.lower("name")
    priority = F.when(F.col("type") == "Problem", 0).when(F.col("type") == "Method", 5).when(F.col("type") == "Paper", 8).when(F.col("type") == "Benchmark", 15).otherwise(20)
    hits = nodes.where(name.contains("red widget") | (F.col("id") == "red widget")).select("id", "type", "name", ((name == "red widget") | (F.col("id") == "red widget")).alias("exact"), priority.alias("priority"))
    best = hits.orderBy(F.desc("exact"), "priority", "name", "id").limit(20)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("exact"), "priority", "name", "id"))).select("id", "type", "exact", "place")


@query("relation_rules", S.GRAPH + """
, r(source_type, type, target_type) AS (VALUES ('Paper', 'USES', 'Method'), ('Paper', 'ADDRESSES', 'Problem'), ('Problem', 'BELONGS_TO_DOMAIN', 'Domain'))
SELECT s.type AS source_type, e.type AS relation, t.type AS target_type, r.type IS NOT NULL AS allowed, count(*) AS n FROM edges e JOIN nodes s ON s.id = e.src JOIN nodes t ON t.id = e.dst
LEFT JOIN r ON r.source_type = s.type AND r.type = e.type AND r.target_type = t.type GROUP BY ALL
""")  # fmt: skip
def relation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations by whether a rule allows their types."""
    nodes, edges = G.graph_of_tables(spark, sf_dir)
    rules = spark.createDataFrame([("Paper", "USES", "Method"), ("Paper", "ADDRESSES", "Problem"), ("Problem", "BELONGS_TO_DOMAIN", "Domain")], "source_type string, relation string, target_type string").withColumn("allowed", F.lit(True))
    end = lambda c, name: nodes.select(F.col("id").alias(c), F.col("type").alias(name))
    typed = edges.withColumnRenamed("type", "relation").join(end("src", "source_type"), "src").join(end("dst", "target_type"), "dst")
    counts = typed.groupBy("source_type", "relation", "target_type").agg(F.count("*").alias("n"))
    return counts.join(rules, ["source_type", "relation", "target_type"], "left").select("source_type", "relation", "target_type", F.coalesce("allowed", F.lit(False)).alias("allowed"), "n")


@query("provenance_audit", """
WITH a AS (SELECT d.doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE substr(coalesce(text, ''), 1, 30) END AS quote, CASE WHEN doc_id % 11 = 0 THEN -1 ELSE doc_id END AS source_id FROM documents d),
s AS (SELECT a.doc_id, CASE WHEN quote IS NULL THEN 'missing-quote' WHEN t.doc_id IS NULL THEN 'dangling-source' WHEN contains(coalesce(t.text, ''), quote) THEN 'pass' ELSE 'quote-mismatch' END AS status FROM a LEFT JOIN documents t ON t.doc_id = a.source_id)
SELECT status, count(*) AS n FROM s GROUP BY status
""")  # fmt: skip
def provenance_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by whether their quote stands in their source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    claims = docs.select(F.when(F.col("doc_id") % 9 != 0, F.substring("text", 1, 30)).alias("quote"), F.when(F.col("doc_id") % 11 == 0, -1).otherwise(F.col("doc_id")).alias("source_id"))
    joined = claims.join(docs, F.col("source_id") == F.col("doc_id"), "left")
    status = F.when(F.col("quote").isNull(), "missing-quote").when(F.col("doc_id").isNull(), "dangling-source").when(F.contains("text", "quote"), "pass").otherwise("quote-mismatch")
    return joined.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("domain_propagation", """
WITH d AS (SELECT l_partkey AS node, list_sort(list_distinct(list('nation ' || s_nationkey))) AS tags FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey)
SELECT node, CAST(len(tags) AS INTEGER) AS n_domains, tags[1] AS first_domain, CASE WHEN len(tags) >= 3 THEN 'high' WHEN len(tags) = 2 THEN 'medium' ELSE 'low' END AS transfer_potential FROM d
""")  # fmt: skip
def domain_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods inherit the domains of what they are used for; transfer potential by their number (O45, O113)."""
    tagged = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("node"), F.concat(F.lit("nation "), "s_nationkey").alias("tag"))
    tags = tagged.groupBy("node").agg(F.countDistinct("tag").cast("int").alias("n_domains"), F.min("tag").alias("first_domain"))
    return tags.withColumn("transfer_potential", F.when(F.col("n_domains") >= 3, "high").when(F.col("n_domains") == 2, "medium").otherwise("low"))


@query("domain_coverage", """
SELECT n_regionkey AS domain, count(DISTINCT s_suppkey) AS problems, count(DISTINCT c_custkey) AS benchmarks FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey
""")
def domain_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each type in each domain, by pivot (O115, O116)."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.lit("problems").alias("kind"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.lit("benchmarks").alias("kind"))
    placed = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("domain")).join(s.unionByName(c), "n_nationkey", "left")
    return placed.groupBy("domain").pivot("kind", ["problems", "benchmarks"]).count().fillna(0)


@query("transfer_edges", """
WITH m AS (SELECT DISTINCT p_name AS mechanism, p_brand AS domain FROM part), p AS (SELECT a.domain AS a, b.domain AS b, count(*) AS support FROM m a JOIN m b ON a.mechanism = b.mechanism AND a.domain < b.domain GROUP BY ALL)
SELECT a, b, support, round(least(0.95, 0.3 + 0.08 * support + CASE WHEN support > 1 THEN 0.05 ELSE 0 END), 4) AS score FROM p
""")  # fmt: skip
def transfer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains that share mechanisms, with a score by support."""
    m = table(spark, sf_dir, "part").select(F.col("p_name").alias("mechanism"), F.col("p_brand").alias("domain")).distinct()
    pairs = m.alias("x").join(m.alias("y"), "mechanism").where("x.domain < y.domain").groupBy(F.col("x.domain").alias("a"), F.col("y.domain").alias("b")).agg(F.count("*").alias("support"))
    bonus = F.when(F.col("support") > 1, 0.05).otherwise(0.0)
    return pairs.withColumn("score", F.round(F.least(F.lit(0.95), 0.3 + 0.08 * F.col("support") + bonus), 4))


#: Neighbours in one list of a shared node, and pairs that one task counts.
_LIST, _TASK_PAIRS = 1024, 4_000_000


def likely_links(edges: DataFrame) -> DataFrame:
    """a, b, common, score of all pairs a < b that share a neighbour in edges(s, m).

    Each a is sent the lists of its neighbours' other neighbours, not a row a pair, and its pairs are counted and scored where the lists arrive; the number of
    such places grows with the number of pairs. A neighbour's list is cut into pieces of some ``_LIST``, so no row holds that of a hub."""
    e = edges.where("s is not null").repartition("s").distinct()
    e = cut(e.join(e.groupBy("s").agg(F.count("*").cast("int").alias("deg")), "s").where("m is not null"), "link-edges")
    sizes = e.groupBy("m").agg(F.count("*").alias("n"))
    pairs = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    # lists in order, so that each neighbour takes what stands behind it
    cell = F.pmod(F.xxhash64("s"), F.ceil(F.col("n") / _LIST))
    lists = e.join(sizes, "m").groupBy("m", cell.alias("cell")).agg(F.array_sort(F.collect_list(F.struct("s", "deg"))).alias("x"))
    lists = lists.select("m", F.col("x.s").alias("to"), F.col("x.deg").alias("degs"), F.element_at("x.s", -1).alias("last"))
    sent = e.join(lists, "m").where("last > s").select(F.col("s").alias("a"), F.col("deg").alias("da"), "to", "degs")
    behind = F.size(F.filter("to", lambda b: b <= F.col("a"))) + 1
    sent = sent.select("a", "da", F.slice("to", behind, F.size("to")).alias("to"), F.slice("degs", behind, F.size("to")).alias("degs"))
    held = sent.repartition(int(pairs // _TASK_PAIRS) + 1, "a").select("a", "da", F.explode(F.arrays_zip("to", "degs")).alias("x"))
    c = F.col("common")
    both = held.groupBy("a", F.col("x.to").alias("b"), "da", F.col("x.degs").alias("db")).agg(F.count("*").alias("common"))
    score = 0.28 + 0.35 * c / (F.col("da") + F.col("db") - c) + F.least(F.lit(0.35), 0.08 * c)
    return both.select("a", "b", "common", F.round(score, 6).alias("score"))


@query("link_prediction", """
WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS m FROM lineitem), d AS (SELECT s, count(*) AS deg FROM e GROUP BY s),
c AS (SELECT x.s AS a, y.s AS b, count(*) AS common FROM e x JOIN e y ON x.m = y.m AND x.s < y.s GROUP BY ALL),
r AS (SELECT a, b, common, round(0.28 + 0.35 * common / (da.deg + db.deg - common) + least(0.35, 0.08 * common), 6) AS score FROM c JOIN d da ON da.s = a JOIN d db ON db.s = b)
SELECT a, b, common, score FROM r ORDER BY score DESC, a, b LIMIT 100
""")  # fmt: skip
def link_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best hundred pairs by prior, Jaccard and common neighbours; the top list is the feature (O145)."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("m"))
    return likely_links(e).orderBy(F.desc("score"), "a", "b").limit(100)
