"""Queries around communities of concepts. Concepts are part types (methods), brands (problems), sizes (limitations) and nations of suppliers (assumptions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators import neighborhoods as N
from quillgraph.plans.registry import query
from quillgraph.runtime import cut, table


def _concepts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """relations, papers with their concepts, and nodes: a paper is an order, its concepts are those of the parts and suppliers of its lines.

    Lines meet parts by key and then each other by paper, once; the concepts of a paper are written as one row of short codes, which all else reads.
    """
    t = lambda n: table(spark, sf_dir, n)
    kinds = [("m:", "p_type", "Method"), ("b:", "p_brand", "Problem"), ("z:", "p_size", "Limitation"), ("n:", "n_name", "Assumption")]
    of = lambda df, p, c, kind: df.where(F.col(c).isNotNull()).select(F.concat(F.lit(p), c).alias("node"), F.concat_ws(" ", F.lit(kind), c).alias("name"), F.lit(kind).alias("type")).distinct()
    part = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand", "p_size")
    supplier = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")).join(t("nation").select("n_nationkey", "n_name"), "n_nationkey")
    tables = {"p_type": part, "p_brand": part, "p_size": part, "n_name": t("nation")}
    named = reduce(DataFrame.unionByName, [of(tables[c], p, c, kind) for p, c, kind in kinds])
    named = cut(named.withColumn("code", F.row_number().over(Window.orderBy("node"))), "concept-names")  # the concepts alone: distinct values of four columns
    code = lambda df, p, c: df.withColumn("node", F.concat(F.lit(p), c)).join(named.select("node", F.col("code").alias(f"{c}_code")), "node", "left").drop("node")
    coded = reduce(lambda df, k: code(df, k[0], k[1]), kinds[:3], part).select("l_partkey", "p_type_code", "p_brand_code", "p_size_code")
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag").join(code(supplier, "n:", "n_name").select("l_suppkey", "n_name_code"), "l_suppkey").join(coded, "l_partkey")
    each = F.array_compact(F.array(*[F.col(f"{c}_code") for _, c, _ in kinds])).alias("concepts")
    papers = cut(N.gathered(lines.select(F.col("l_orderkey").alias("paper"), each)), "concept-papers")
    support = papers.select(F.explode("concepts").alias("code")).groupBy("code").agg(F.count("*").alias("support"))
    nodes = named.join(support, "code")
    top = nodes.agg(F.max("support")).first()[0] or 1
    nodes = cut(nodes.select("node", "code", "name", "type", F.round(F.col("support") * 10 / top, 3).alias("score"), "support"), "concept-nodes")
    relation = F.when(F.col("l_returnflag") == "R", "APPLIES_TO").when(F.col("l_returnflag") == "A", "RELATED_TO").otherwise("MENTIONS").alias("type")
    told = t("lineitem").select("l_partkey", "l_suppkey", relation).join(supplier.select("l_suppkey"), "l_suppkey", "left_semi").select("l_partkey", "type").distinct()
    relations = told.join(part, "l_partkey").select(F.concat(F.lit("m:"), "p_type").alias("src"), F.concat(F.lit("b:"), "p_brand").alias("dst"), "type").distinct()
    return relations, papers, nodes


_CONCEPTS = """
WITH line AS (SELECT l_orderkey AS paper, l_returnflag, p_type, p_brand, p_size, n_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
rows AS (SELECT DISTINCT paper, 'm:' || p_type AS node, 'Method ' || p_type AS name, 'Method' AS type FROM line UNION SELECT paper, 'b:' || p_brand, 'Problem ' || p_brand, 'Problem' FROM line
  UNION SELECT paper, 'z:' || p_size, 'Limitation ' || p_size, 'Limitation' FROM line UNION SELECT paper, 'n:' || n_name, 'Assumption ' || n_name, 'Assumption' FROM line),
n0 AS (SELECT node, name, type, count(*) AS support FROM rows GROUP BY ALL), nodes AS (SELECT node, name, type, round(support * 10 / CAST(max(support) OVER () AS DOUBLE), 3) AS score, support FROM n0),
rel AS (SELECT DISTINCT 'm:' || p_type AS src, 'b:' || p_brand AS dst, CASE l_returnflag WHEN 'R' THEN 'APPLIES_TO' WHEN 'A' THEN 'RELATED_TO' ELSE 'MENTIONS' END AS type FROM line),
top AS (SELECT *, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 -]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda t: t <> '')) AS tk FROM nodes ORDER BY score DESC, support DESC, name, node LIMIT 128),
ex AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(CASE type WHEN 'APPLIES_TO' THEN 2.4 ELSE 1.8 END) AS weight FROM rel WHERE type <> 'MENTIONS' AND src IN (SELECT node FROM top) AND dst IN (SELECT node FROM top) GROUP BY 1, 2),
m AS (SELECT r.paper, t.* FROM rows r JOIN top t USING (node) QUALIFY row_number() OVER (PARTITION BY r.paper ORDER BY t.score DESC, t.support DESC, t.name, t.node) <= 12),
pr AS (SELECT x.node AS a, y.node AS b, len(list_intersect(x.tk, y.tk)) / CAST(len(list_distinct(list_concat(x.tk, y.tk))) AS DOUBLE) AS sim FROM m x JOIN m y ON x.paper = y.paper AND x.node < y.node),
wk AS (SELECT a, b, 0.35 + least(0.35, 0.18 * (count(*) - 1)) + least(0.22, 0.3 * max(sim)) AS weight FROM pr GROUP BY a, b),
edges AS (SELECT a, b, round(sum(weight), 3) AS weight FROM (SELECT * FROM ex UNION ALL SELECT * FROM wk) GROUP BY a, b ORDER BY weight DESC, a, b LIMIT 600)
"""


@query("concept_projection", _CONCEPTS + "SELECT a, b, weight FROM edges")
def concept_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest edges of the best concepts, from relations and shared papers (O102)."""
    return N.projection(*_concepts(spark, sf_dir), paper_concepts=N.PAPER_CONCEPTS)


@query("subcommunities")
def subcommunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities by modularity and their parts by the constant Potts model (O101)."""
    return N.partition(N.projection(*_concepts(spark, sf_dir), paper_concepts=N.PAPER_CONCEPTS))


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """edges, labels, nodes and seeds; the labels are a hash of the node, so that SQL has them too."""
    relations, papers, nodes = _concepts(spark, sf_dir)
    edges = cut(N.projection(relations, papers, nodes, paper_concepts=N.PAPER_CONCEPTS), "concept-edges")
    digit = lambda k: F.conv(F.substring(F.sha1("node"), k, 1), 16, 10).cast("int")
    labels = nodes.select("node", F.concat(F.lit("community:"), digit(1) % 4).alias("community"), F.concat(F.lit("community:"), digit(1) % 4, F.lit(":"), digit(2) % 2).alias("cluster"))
    top = nodes.orderBy(F.desc("score"), F.desc("support"), "name", "node").limit(128)
    seeds = top.where(digit(3) < 4).select("node")
    return edges, labels.join(top.select("node"), "node", "left_semi"), top, seeds


_LABELLED = _CONCEPTS + """,
hex AS (SELECT node, instr('0123456789abcdef', substr(sha1(node), 1, 1)) - 1 AS d1, instr('0123456789abcdef', substr(sha1(node), 2, 1)) - 1 AS d2, instr('0123456789abcdef', substr(sha1(node), 3, 1)) - 1 AS d3 FROM top),
labels AS (SELECT node, 'community:' || d1 % 4 AS community, 'community:' || d1 % 4 || ':' || d2 % 2 AS cluster FROM hex), seeds AS (SELECT node FROM hex WHERE d3 < 4),
st AS (SELECT a AS node, b AS "to", weight FROM edges UNION ALL SELECT b, a, weight FROM edges),
cl AS (SELECT least(x.cluster, y.cluster) AS x, greatest(x.cluster, y.cluster) AS y, sum(weight) AS weight FROM edges JOIN labels x ON x.node = a JOIN labels y ON y.node = b WHERE x.cluster <> y.cluster GROUP BY 1, 2),
co AS (SELECT least(x.community, y.community) AS x, greatest(x.community, y.community) AS y, sum(weight) AS weight FROM edges JOIN labels x ON x.node = a JOIN labels y ON y.node = b WHERE x.community <> y.community GROUP BY 1, 2),
bs AS (SELECT st.node, l.cluster, o.cluster AS other, sum(weight) AS w FROM st JOIN labels l ON l.node = st.node JOIN labels o ON o.node = st."to" GROUP BY ALL),
bd AS (SELECT node, round(max(w) FILTER (other <> cluster) + sum(w) FILTER (other = cluster) + any_value(score), 3) AS score FROM bs JOIN top USING (node) GROUP BY node HAVING sum(w) FILTER (other = cluster) > 0.4 AND max(w) FILTER (other <> cluster) >= 0.65),
home AS (SELECT DISTINCT community FROM labels JOIN seeds USING (node)), nr AS (SELECT community, max(weight) AS link FROM (SELECT x AS home, y AS community, weight FROM co UNION ALL SELECT y, x, weight FROM co) WHERE home IN (SELECT community FROM home) GROUP BY community),
seen AS (SELECT DISTINCT "to" AS node FROM st JOIN seeds USING (node)),
la AS (SELECT node, round(score + CASE WHEN community IN (SELECT community FROM home) THEN 2.1 ELSE 1.25 + least(1.1, 0.2 * link) END + CASE WHEN node IN (SELECT node FROM seen) THEN 0.6 ELSE 1.6 END + CASE WHEN node IN (SELECT node FROM bd) THEN 0.6 ELSE 0 END, 3) AS score
  FROM top JOIN labels USING (node) LEFT JOIN nr USING (community) WHERE node NOT IN (SELECT node FROM seeds) AND (community IN (SELECT community FROM home) OR link >= 1.2))
"""


@query("boundary_nodes", _LABELLED + "SELECT node, score FROM bd")
def boundary_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts on the edge of their cluster (O103)."""
    edges, labels, nodes, _ = _labelled(spark, sf_dir)
    return N.boundary_nodes(edges, labels, nodes)


@query("latent_neighbors", _LABELLED + "SELECT node, score FROM la")
def latent_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts that communities bring near the seeds (O103)."""
    edges, labels, nodes, seeds = _labelled(spark, sf_dir)
    return N.latent_neighbors(edges, labels, nodes, seeds, N.boundary_nodes(edges, labels, nodes))


_BRIDGED = _LABELLED + """,
sr AS (SELECT *, CAST(row_number() OVER (PARTITION BY node ORDER BY weight DESC, least(node, "to"), greatest(node, "to")) AS INTEGER) AS rank FROM st),
p1 AS (SELECT s.node AS source, t.type AS st_, s."to" AS "end", [s.node, s."to"] AS path, [s.rank] AS ranks, s.weight FROM sr s JOIN top t ON t.node = s.node WHERE s.node IN (SELECT node FROM seeds) AND t.type IN ('Method', 'Problem', 'Limitation')),
p2 AS (SELECT source, st_, s."to" AS "end", list_append(path, s."to") AS path, list_append(ranks, s.rank) AS ranks, p1.weight + s.weight AS weight FROM p1 JOIN top t ON t.node = p1."end" AND t.type <> 'Method' JOIN sr s ON s.node = p1."end" WHERE NOT list_contains(path, s."to")),
p3 AS (SELECT source, st_, s."to" AS "end", list_append(path, s."to") AS path, list_append(ranks, s.rank) AS ranks, p2.weight + s.weight AS weight FROM p2 JOIN top t ON t.node = p2."end" AND t.type <> 'Method' JOIN sr s ON s.node = p2."end" WHERE NOT list_contains(path, s."to")),
al AS (SELECT p.*, x.cluster AS cx, y.cluster AS cy FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) p JOIN top e ON e.node = p."end" AND e.type = 'Method' JOIN labels x ON x.node = p.source JOIN labels y ON y.node = p."end" WHERE x.cluster <> y.cluster AND (st_ = 'Method' OR p."end" NOT IN (SELECT node FROM seeds))),
bb AS (SELECT source, st_, "end", cx, cy, arg_min({'path': path, 'w': weight}, (len(path), ranks)) AS p FROM al GROUP BY source, st_, "end", cx, cy HAVING st_ <> 'Method' OR min(len(path)) > 2),
bf AS (SELECT lower(st_) || '_method' AS kind, CASE WHEN st_ = 'Method' THEN least(source, "end") ELSE source END AS source, CASE WHEN st_ = 'Method' THEN greatest(source, "end") ELSE "end" END AS target, round(p.w + coalesce(cl.weight, 0), 3) AS score,
  array_to_string(CASE WHEN st_ = 'Method' AND source > "end" THEN list_reverse(p.path) ELSE p.path END, '>') AS path, source < "end" AS forward FROM bb LEFT JOIN cl ON cl.x = least(cx, cy) AND cl.y = greatest(cx, cy)),
br AS (SELECT kind, source, target, score, path FROM bf QUALIFY row_number() OVER (PARTITION BY kind, source, target ORDER BY forward DESC) = 1)
"""


@query("community_bridges", _BRIDGED + "SELECT kind, source, target, score, path FROM br")
def community_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest paths between clusters, from seeds to methods (O103, O96)."""
    return N.bridges(*_labelled(spark, sf_dir))


_DOMAINS = """, dm AS (SELECT node, 'domain ' || d1 % 5 AS domain FROM hex UNION SELECT node, 'domain ' || (d2 % 3 + 2) FROM hex)"""


def _domains(nodes: DataFrame) -> DataFrame:
    digit = lambda k: F.conv(F.substring(F.sha1("node"), k, 1), 16, 10).cast("int")
    return nodes.select("node", F.explode(F.array(F.concat(F.lit("domain "), digit(1) % 5), F.concat(F.lit("domain "), digit(2) % 3 + 2))).alias("domain")).distinct()


@query("domain_profile", _BRIDGED + _DOMAINS + """,
own AS (SELECT node, min(domain) AS domain FROM dm GROUP BY node), cr AS (SELECT x.domain AS dx, y.domain AS dy, score FROM br JOIN own x ON x.node = source JOIN own y ON y.node = target WHERE x.domain <> y.domain),
w AS (SELECT domain, round(sum(score), 4) AS bridge_weight, count(*) AS bridges FROM (SELECT dx AS domain, score FROM cr UNION ALL SELECT dy, score FROM cr) GROUP BY domain),
ln AS (SELECT domain, count(*) AS latent FROM la JOIN dm USING (node) GROUP BY domain), bn AS (SELECT domain, count(*) AS boundary FROM bd JOIN dm USING (node) GROUP BY domain),
hm AS (SELECT domain, string_agg(DISTINCT community, ',' ORDER BY community) AS communities FROM labels JOIN dm USING (node) GROUP BY domain)
SELECT domain, round(coalesce(bridge_weight, 0) + 0.65 * coalesce(latent, 0) + 0.4 * coalesce(boundary, 0), 4) AS score, coalesce(bridge_weight, 0) AS bridge_weight, coalesce(bridges, 0) AS bridges, coalesce(latent, 0) AS latent, coalesce(boundary, 0) AS boundary, coalesce(communities, '') AS communities
FROM w FULL JOIN ln USING (domain) FULL JOIN bn USING (domain) LEFT JOIN hm USING (domain) ORDER BY 2 DESC, 3 DESC, domain LIMIT 10
""")  # fmt: skip
def domain_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains by the bridges, latent neighbours and boundary nodes they have (O104)."""
    edges, labels, nodes, seeds = _labelled(spark, sf_dir)
    boundary = N.boundary_nodes(edges, labels, nodes)
    return N.domain_profile(_domains(nodes), labels, N.bridges(edges, labels, nodes, seeds), N.latent_neighbors(edges, labels, nodes, seeds, boundary), boundary)


@query("community_domains", _LABELLED + _DOMAINS + """
, n AS (SELECT community, domain, count(*) AS n FROM labels JOIN dm USING (node) GROUP BY ALL) SELECT community, domain, n, round(n / CAST(sum(n) OVER (PARTITION BY community) AS DOUBLE), 4) AS share FROM n
""")
def community_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of each community with their shares (O104)."""
    _, labels, nodes, _ = _labelled(spark, sf_dir)
    return N.community_domains(_domains(nodes), labels)


@query("community_structure")
def community_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities that the concepts really form, with their boundary nodes, latent neighbours and the share of each domain (O101, O103, O104). All concepts of a paper meet, however many it has."""
    relations, papers, nodes = _concepts(spark, sf_dir)
    edges = cut(N.projection(relations, papers, nodes), "concept-edges")
    labels = N.partition(edges)
    top = nodes.join(labels.select("node"), "node", "left_semi")
    seeds = top.orderBy(F.desc("score"), F.desc("support"), "name", "node").limit(8).select("node")
    boundary = cut(N.boundary_nodes(edges, labels, top), "boundary")
    latent = N.latent_neighbors(edges, labels, top, seeds, boundary)
    row = lambda df, part, score: df.select(F.lit(part).alias("part"), "node", score.cast("double").alias("score"))
    return row(boundary, "boundary", F.col("score")).unionByName(row(latent, "latent", F.col("score"))).join(labels, "node", "left").select("part", "node", "community", "cluster", "score")
