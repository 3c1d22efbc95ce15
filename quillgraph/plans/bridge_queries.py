"""Queries of bridges between domains. Parts are methods and suppliers problems; a part's domain is its brand, a supplier's its nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import bridges as B
from quillgraph.plans import sqltext as S
from quillgraph.plans.registry import query
from quillgraph.runtime import table

_CHALLENGE, _REQUESTED, _TARGET = "red widget urgent", ["type steel", "status F"], "Brand#11"


def _graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = lambda n: table(spark, sf_dir, n)
    part, supplier, line = t("part"), t("supplier"), t("lineitem")
    m, p = F.concat(F.lit("m:"), F.col("p_partkey")), F.concat(F.lit("p:"), F.col("s_suppkey"))
    nodes = part.select(m.alias("id"), F.col("p_name").alias("name"), F.lit("Method").alias("type"), F.col("p_brand").alias("domain"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    nodes = nodes.unionByName(supplier.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(p.alias("id"), F.col("s_name").alias("name"), F.lit("Problem").alias("type"), F.col("n_name").alias("domain"), F.concat_ws(" ", "s_name", "n_name").alias("text")))
    mechanisms = part.select(m.alias("id"), F.concat(F.lit("type "), F.lower("p_type")).alias("mechanism")).unionByName(line.select(F.concat(F.lit("m:"), F.col("l_partkey")).alias("id"), F.concat(F.lit("status "), F.col("l_linestatus")).alias("mechanism"))).unionByName(
        line.where("l_returnflag = 'R'").select(F.concat(F.lit("p:"), F.col("l_suppkey")).alias("id"), F.concat(F.lit("status "), F.col("l_linestatus")).alias("mechanism"))
    )
    orders = line.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    challenges = orders.where("l_discount > 0.08").select(F.concat(F.lit("m:"), F.col("l_partkey")).alias("id"), F.lower("o_orderpriority").alias("challenge"))
    snippets = line.where("l_discount < 0.02").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat(F.lit("m:"), F.col("l_partkey")).alias("id"), F.concat_ws(" ", F.lit("widget lot of"), "s_name", F.lit("order"), "l_orderkey").alias("snippet"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    takeaways = line.where("l_returnflag = 'A' and l_discount = 0.05").select(F.concat(F.lit("m:"), F.col("l_partkey")).alias("id"))
    distances = nodes.select("domain").distinct().withColumn("distance", F.round(F.conv(F.substring(F.sha1("domain"), 1, 1), 16, 10).cast("int") / 15, 4))
    support = mechanisms.distinct().groupBy("mechanism").agg((F.count("*") % 7).alias("papers"))
    return {"nodes": nodes, "mechanisms": mechanisms, "challenges": challenges, "snippets": snippets, "takeaways": takeaways, "distances": distances, "support": support}


def _sim(q: str, text: str, phrase: float = 0.2) -> str:
    """Text similarity of a constant and an SQL expression."""
    a, b = S.content_tokens(f"'{q}'"), S.content_tokens(S.normalized(text))
    return f"round(CASE WHEN len({b}) = 0 THEN 0.0 ELSE least(1.0, len(list_filter({a}, lambda u: list_contains({b}, u))) / CAST(len({a}) AS DOUBLE) + CASE WHEN contains(lower({text}), '{q}') THEN {phrase} ELSE 0 END) END, 4)"


_QUALITY = r"CASE WHEN trim(snippet) = '' THEN 0.0 WHEN regexp_matches(snippet, '[A-Za-z]{32,}') THEN 0.45 WHEN length(regexp_replace(snippet, '[^A-Za-z]', '', 'g')) / CAST(length(snippet) AS DOUBLE) < 0.45 THEN 0.6 WHEN len(string_split(snippet, ' ')) < 4 THEN 0.65 ELSE 1.0 END"
_GRAPH = f"""
WITH nodes AS (SELECT 'm:' || p_partkey AS id, p_name AS name, 'Method' AS type, p_brand AS domain, p_name || ' ' || p_type AS text FROM part UNION ALL SELECT 'p:' || s_suppkey, s_name, 'Problem', n_name, s_name || ' ' || n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey),
mech AS (SELECT 'm:' || p_partkey AS id, 'type ' || lower(p_type) AS mechanism FROM part UNION SELECT 'm:' || l_partkey, 'status ' || l_linestatus FROM lineitem UNION SELECT 'p:' || l_suppkey, 'status ' || l_linestatus FROM lineitem WHERE l_returnflag = 'R'),
chal AS (SELECT DISTINCT 'm:' || l_partkey AS id, lower(o_orderpriority) AS challenge FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_discount > 0.08),
snip AS (SELECT 'm:' || l_partkey AS id, 'widget lot of ' || s_name || ' order ' || l_orderkey AS snippet, l_orderkey * 10 + l_linenumber AS place FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_discount < 0.02),
take AS (SELECT DISTINCT 'm:' || l_partkey AS id, true AS takeaway FROM lineitem WHERE l_returnflag = 'A' AND l_discount = 0.05),
dist AS (SELECT domain, round((instr('0123456789abcdef', substr(sha1(domain), 1, 1)) - 1) / 15.0, 4) AS distance FROM (SELECT DISTINCT domain FROM nodes)),
supp AS (SELECT mechanism, count(*) % 7 AS papers FROM mech GROUP BY mechanism),
ms AS (SELECT id, list(mechanism ORDER BY mechanism) AS mechs, avg(least(1.0, papers / 4.0)) AS all_s, avg(least(1.0, papers / 4.0)) FILTER (mechanism IN ('type steel', 'status F')) AS mat_s FROM mech JOIN supp USING (mechanism) GROUP BY id),
cs AS (SELECT id, list(challenge ORDER BY challenge) AS chals, max({_sim(_CHALLENGE, "challenge")}) AS met FROM chal GROUP BY id),
sn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS n FROM snip),
es AS (SELECT id, count(*) AS snippets, max({_sim(_CHALLENGE, "snippet")}) AS evidenced, round(avg({_QUALITY}) FILTER (n <= 6), 4) AS quality FROM sn GROUP BY id),
r AS (SELECT n.*, coalesce(mechs, []) AS mechs, coalesce(chals, []) AS chals, coalesce(snippets, 0) AS snippets, coalesce(quality, 0) AS quality, coalesce(takeaway, false) AS takeaway, met, evidenced, all_s, mat_s, distance, list_filter(coalesce(mechs, []), lambda x: x IN ('type steel', 'status F')) AS matched
  FROM nodes n LEFT JOIN ms USING (id) LEFT JOIN cs USING (id) LEFT JOIN es USING (id) LEFT JOIN take USING (id) LEFT JOIN dist USING (domain) WHERE domain <> '{_TARGET}'),
s AS (SELECT *, round(coalesce(distance, 0), 4) AS novelty, {_sim(_CHALLENGE, "(name || ' ' || text || ' ' || array_to_string(mechs, ' ') || ' ' || array_to_string(chals, ' '))")} AS retrieval, greatest({_sim(_CHALLENGE, "name")}, coalesce(met, 0), coalesce(evidenced, 0)) AS coverage,
  round(len(matched) / 2.0, 4) AS mechanism, round(least(1.0, snippets / 2.0) * quality, 4) AS evidence, round(coalesce(CASE WHEN len(matched) > 0 THEN mat_s ELSE all_s END, 0), 4) AS support FROM r),
g AS (SELECT *, round(0.35 * mechanism + 0.35 * coverage + 0.15 * evidence + 0.15 * support, 4) AS graph, round((CAST(len(matched) > 0 AS INTEGER) + CAST(len(chals) > 0 OR takeaway AS INTEGER) + 1 + CAST(snippets > 0 AS INTEGER)) / 4.0, 4) AS complete,
  list_filter([CASE WHEN len(chals) > 0 AND takeaway THEN 'challenge-takeaway' END, CASE WHEN len(matched) > 0 AND (len(chals) > 0 OR takeaway) THEN 'mechanism-transfer' END, CASE WHEN snippets > 0 THEN 'evidence-grounding' END], lambda x: x IS NOT NULL) AS motifs FROM s),
c AS (SELECT *, round((0.4 * retrieval + 0.4 * graph + 0.2 * novelty) * CASE WHEN coverage > 0 THEN 1.0 ELSE 0.65 END, 4) AS combined FROM g),
best AS (SELECT * FROM c ORDER BY combined DESC, graph DESC, name, id LIMIT 20),
a AS (SELECT *, {_sim(_CHALLENGE, "(array_to_string(chals, ' ') || ' ' || name)", 0.15)} AS aligned, round(CASE WHEN len(matched) > 0 THEN len(matched) ELSE 2 END / 2.0, 4) AS shared, round(len(motifs) / 4.0, 4) AS motif FROM best),
an AS (SELECT *, round(0.4 * aligned + 0.3 * shared + 0.2 * motif + 0.1 * round(least(1.0, least(snippets, 2) / 2.0), 4), 4) AS analogy FROM a)
"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.best_candidates(B.bridge_candidates(**_graph(spark, sf_dir), target=_TARGET, challenge=_CHALLENGE, requested=_REQUESTED), 20)


@query("bridge_retrieval", _GRAPH + "SELECT id, type, domain, array_to_string(matched, ',') AS matched, retrieval, coverage, mechanism, evidence, support, novelty, graph, complete, combined FROM best")
def bridge_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of other domains for a challenge, by text, mechanisms, evidence and distance (O149, O48)."""
    return _candidates(spark, sf_dir).select("id", "type", "domain", F.array_join("matched", ",").alias("matched"), "retrieval", "coverage", "mechanism", "evidence", "support", "novelty", "graph", "complete", "combined")


@query("structural_analogy", _GRAPH + "SELECT id, array_to_string(motifs, ',') AS motifs, aligned, shared, motif, analogy FROM an")
def structural_analogy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each candidate's path is an analogy (O150, O49)."""
    return B.analogies(_candidates(spark, sf_dir), _CHALLENGE, _REQUESTED).select("id", F.array_join("motifs", ",").alias("motifs"), "aligned", "shared", "motif", "analogy")


@query("interdisciplinary_ranking", _GRAPH + """
, f AS (SELECT *, round(least(1.0, 0.55 * evidence + 0.45 * support), 4) AS grounding, round(least(1.0, 0.65 * complete + 0.35 * motif), 4) AS story FROM an)
SELECT id, grounding, story, round(least(1.0, 0.22 * novelty + 0.24 * grounding + 0.22 * coverage + 0.16 * analogy + 0.16 * story), 4) AS potential FROM f
""")
def interdisciplinary_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Potential of each candidate from novelty, grounding, coverage, analogy and story (O148)."""
    return B.interdisciplinary(B.analogies(_candidates(spark, sf_dir), _CHALLENGE, _REQUESTED)).select("id", "grounding", "story", "potential")


_CHALLENGES = ["steel widget", "urgent small gadget"]
_CROSS = _GRAPH + f"""
, tm AS (SELECT DISTINCT mechanism FROM nodes JOIN mech USING (id) WHERE domain = '{_TARGET}'),
h AS (SELECT id, list(mechanism ORDER BY mechanism) AS mechs, list_sort(list(mechanism) FILTER (mechanism IN (SELECT mechanism FROM tm))) AS shared FROM mech GROUP BY id),
x AS (SELECT n.id, name, type, domain, coalesce(h.mechs, []) AS mechs, coalesce(h.shared, []) AS shared, coalesce(distance, 0) AS distance FROM nodes n LEFT JOIN h USING (id) LEFT JOIN dist USING (domain) WHERE domain <> '{_TARGET}' AND coalesce(distance, 0) >= 0.3),
y AS (SELECT *, {S.content_tokens(S.normalized("lower(name || ' ' || array_to_string(mechs, ' ') || ' ' || domain)"))} AS tk, distance + CASE WHEN len(shared) > 0 THEN 1.0 WHEN len(mechs) > 0 THEN 0.25 ELSE 0 END AS rest FROM x),
z AS (SELECT *, round(2 * len(list_filter(['steel', 'widget'], lambda u: list_contains(tk, u))) / 2.0 + rest, 4) AS s1, round(2 * len(list_filter(['urgent', 'small', 'gadget'], lambda u: list_contains(tk, u))) / 3.0 + rest, 4) AS s2 FROM y),
cd AS (SELECT *, greatest(s1, s2) AS score, round(greatest(s1, s2) / 4, 4) AS ratio, CASE WHEN s1 >= s2 THEN 'steel widget' ELSE 'urgent small gadget' END AS challenge FROM z ORDER BY score DESC, id LIMIT 15)
"""


def _cross(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    g = _graph(spark, sf_dir)
    return g, B.cross_domain(g["nodes"], g["mechanisms"], g["distances"], _TARGET, _CHALLENGES, 0.3, 15)


@query("cross_domain_bridges", _CROSS + "SELECT id, domain, array_to_string(shared, ',') AS shared, distance, score, ratio, challenge FROM cd")
def cross_domain_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of distant domains that share mechanisms with the target domain."""
    return _cross(spark, sf_dir)[1].select("id", "domain", F.array_join("shared", ",").alias("shared"), "distance", "score", "ratio", "challenge")


_TAKEN = _CROSS + """
, ta AS (SELECT id, domain AS source_domain, coalesce(mechs[1], name) AS mechanism, CASE WHEN len(mechs) > 0 THEN mechs[1] || ': shared by ' || papers ELSE name || ' represents a transferable pattern from ' || domain END AS explanation,
  'In ' || domain || ', ' || name || ' addresses this challenge' || CASE WHEN len(mechs) > 0 THEN ' through ' || array_to_string(mechs, ' and ') ELSE '' END || '.' AS formulation, name || ' was selected because it directly matches the challenge "' || challenge || '" in ' || domain || '.' AS rationale, challenge FROM cd LEFT JOIN supp ON supp.mechanism = mechs[1])
"""


def _taken(g: dict[str, DataFrame], bridged: DataFrame) -> DataFrame:
    return B.takeaways(bridged, g["support"].select("mechanism", F.concat(F.lit("shared by "), "papers").alias("description")), _CHALLENGES[0])


@query("bridge_takeaways", _TAKEN + "SELECT id, source_domain, mechanism, explanation, formulation, rationale, challenge FROM ta")
def bridge_takeaways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each bridge node teaches (O189)."""
    return _taken(*_cross(spark, sf_dir))


@query("interdisciplinary_report", _TAKEN + f"""
, cm AS (SELECT domain, avg(score) AS score, count(*) AS bridges FROM cd GROUP BY domain), cl AS (SELECT domain, count(DISTINCT u) AS n_shared FROM (SELECT domain, unnest(CASE WHEN len(shared) > 0 THEN shared ELSE mechs END) AS u FROM cd) GROUP BY domain),
pf AS (SELECT domain, round(count(*) / 3.0, 4) AS bridge_weight, count(*) % 5 AS latent FROM nodes GROUP BY domain), tk AS (SELECT source_domain AS domain, least(count(*), 3) AS takeaways FROM ta GROUP BY 1),
kn AS (SELECT domain FROM (SELECT domain FROM cm UNION SELECT domain FROM pf) WHERE domain <> '{_TARGET}'),
v AS (SELECT domain, coalesce(bridges, 0) AS bridges, coalesce(bridge_weight, 0) AS bridge_weight, coalesce(takeaways, 0) AS takeaways, coalesce(distance, 0) AS distance, round(coalesce(latent, 0) / CAST(greatest(1, sum(coalesce(latent, 0)) OVER ()) AS DOUBLE), 4) AS overlap, round(least(1.0, round(coalesce(score, 0), 4) / 4.5), 4) AS strength, round(least(1.0, coalesce(takeaways, 0) / 3.0), 4) AS taken, least(coalesce(n_shared, 0), 8) AS ns
  FROM kn LEFT JOIN cm USING (domain) LEFT JOIN cl USING (domain) LEFT JOIN pf USING (domain) LEFT JOIN tk USING (domain) LEFT JOIN dist USING (domain)),
q AS (SELECT *, round(least(1.0, 0.4 * strength + 0.35 * round(least(1.0, ns / 3.0), 4) + 0.25 * taken), 4) AS depth, round(least(1.0, 0.45 * round(least(1.0, bridges / 3.0), 4) + 0.35 * taken + 0.2 * overlap), 4) AS stages, round(least(1.0, 0.45 * round(distance, 4) + 0.3 * strength + 0.25 * taken), 4) AS payoff,
  round(least(1.0, 0.34 * strength + 0.24 * round(distance, 4) + 0.18 * round(least(1.0, bridge_weight / 6), 4) + 0.12 * taken + 0.12 * overlap), 4) AS potential FROM v)
SELECT domain, potential, depth, stages, payoff, round(least(1.0, 0.55 * payoff + 0.25 * depth + 0.2 * stages), 4) AS promise, bridges, takeaways FROM q ORDER BY potential DESC, bridge_weight DESC, bridges DESC, domain LIMIT 5
""")  # fmt: skip
def interdisciplinary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best source domains with the parts of their potential (O190)."""
    g, bridged = _cross(spark, sf_dir)
    profile = g["nodes"].groupBy("domain").agg(F.round(F.count("*") / 3, 4).alias("bridge_weight"), (F.count("*") % 5).alias("latent"))
    return B.potential_report(B.candidate_domains(bridged), profile, g["distances"], _taken(g, bridged), _TARGET)


@query("mechanism_transfer", _GRAPH + """
SELECT mechanism, count(*) AS instances, count(DISTINCT domain) AS domains, CASE WHEN count(DISTINCT domain) >= 3 THEN 'high' WHEN count(DISTINCT domain) >= 2 THEN 'medium' ELSE 'low' END AS potential FROM mech JOIN nodes USING (id) GROUP BY mechanism
""")
def mechanism_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How widely each mechanism is used, and so how transferable it is."""
    g = _graph(spark, sf_dir)
    return B.transferability(g["nodes"], g["mechanisms"])


@query("mechanism_support", _GRAPH + """
, mm AS (SELECT mechanism, id, name, type, domain FROM mech JOIN nodes USING (id)), sa AS (SELECT mechanism, string_agg(id, ',' ORDER BY n) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY mechanism ORDER BY name, id) AS n FROM mm) WHERE n <= 8 GROUP BY mechanism),
tt AS (SELECT DISTINCT mechanism, 'paper ' || l_orderkey AS title FROM mm JOIN lineitem ON mm.id = 'm:' || l_partkey WHERE l_discount = 0.1), tn AS (SELECT mechanism, count(*) AS papers, string_agg(title, '|' ORDER BY title) FILTER (n <= 12) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY mechanism ORDER BY title) AS n FROM tt) GROUP BY mechanism)
SELECT mechanism, nodes, domains, types, sample, coalesce(papers, 0) AS papers, coalesce(titles, '') AS titles FROM (SELECT mechanism, count(*) AS nodes, string_agg(DISTINCT domain, '|' ORDER BY domain) AS domains, string_agg(DISTINCT type, '|' ORDER BY type) AS types FROM mm GROUP BY mechanism) JOIN sa USING (mechanism) LEFT JOIN tn USING (mechanism)
""")  # fmt: skip
def mechanism_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, domains, types and papers behind each mechanism (O114)."""
    g = _graph(spark, sf_dir)
    papers = table(spark, sf_dir, "lineitem").where("l_discount = 0.1").select(F.concat(F.lit("m:"), F.col("l_partkey")).alias("id"), F.concat(F.lit("paper "), F.col("l_orderkey")).alias("title"))
    return B.mechanism_support(g["nodes"], g["mechanisms"], papers)
