"""Queries of proposals, controller batches and scored candidates.

A proposal is a customer: its orders are papers and claims, its returned lines spans. For maturity a proposal is an order and its lines are the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as T
from quillgraph.operators import controller as K
from quillgraph.operators import proposals as P
from quillgraph.operators import scoring as C
from quillgraph.plans import sqltext as S
from quillgraph.plans.registry import query
from quillgraph.runtime import cut, dealt, table


def _proposals(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = lambda n: table(spark, sf_dir, n)
    o = t("orders").select(F.col("o_custkey").alias("proposal"), "o_orderkey", "o_totalprice", "o_orderpriority", F.year("o_orderdate").alias("year"), "o_orderstatus")
    place = F.row_number().over(Window.partitionBy("proposal").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    key = F.concat(F.lit("o"), F.col("o_orderkey"))
    papers = o.select("proposal", place.alias("place"), key.alias("key"), F.concat(F.lit("paper "), F.col("o_orderkey")).alias("title"), "year")
    lines = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    lines, owners = dealt(t("lineitem").count(), (lines, "o_orderkey"), (o.select("o_orderkey", "proposal"), "o_orderkey"))
    back = lines.join(owners, "o_orderkey")
    spans = back.select("proposal", F.concat_ws(":", "o_orderkey", "l_linenumber").alias("span"), key.alias("key"), F.lit(None).cast("string").alias("title"))
    per_claim = t("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_linenumber").alias("spans"))
    tier = F.when(F.col("o_orderpriority").startswith("1"), "strong").when(F.col("o_orderpriority").startswith("2"), "moderate").when(F.col("o_orderpriority").startswith("3"), "weak").otherwise("missing")
    claims = o.select("proposal", "o_orderkey", tier.alias("tier")).join(per_claim, "o_orderkey", "left").select("proposal", key.alias("claim"), F.coalesce("spans", F.lit(0)).alias("spans"), "tier")
    fragments = o.select("proposal", F.round(F.col("o_totalprice") / 600000, 6).alias("novelty"), F.round((F.col("year") - 1992) / 8, 6).alias("usefulness"))
    return {"proposals": t("customer").select(F.col("c_custkey").alias("proposal")), "papers": papers, "spans": spans, "claims": claims, "fragments": fragments}


_PROPOSALS = """
WITH o AS (SELECT o_custkey AS proposal, *, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders), pa AS (SELECT proposal, row_number() OVER (PARTITION BY proposal ORDER BY o_totalprice DESC, o_orderkey) AS n, 'o' || o_orderkey AS key, y FROM o),
sp AS (SELECT DISTINCT proposal, o_orderkey || ':' || l_linenumber AS span, 'o' || o_orderkey AS key FROM lineitem JOIN o ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'),
mc AS (SELECT p.proposal, CAST(p.n AS INTEGER) AS place, p.key, CASE WHEN p.n = 1 THEN 'baseline_or_method_anchor' ELSE 'supporting_prior' END AS obligation, count(s.span) AS spans, count(s.span) > 0 AS covered, p.y > 1998 AS future FROM pa p LEFT JOIN sp s ON s.proposal = p.proposal AND s.key = p.key WHERE p.n <= 8 GROUP BY ALL),
cl AS (SELECT o.proposal, 'o' || o_orderkey AS claim, coalesce(k.n, 0) AS spans, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0.9 WHEN '2' THEN 0.7 WHEN '3' THEN 0.35 ELSE 0.45 END AS tier FROM o LEFT JOIN (SELECT key, count(*) AS n FROM sp GROUP BY key) k ON k.key = 'o' || o_orderkey),
fr AS (SELECT proposal, avg(least(1.0, greatest(0, round(o_totalprice / 600000, 6)))) AS novelty, avg(least(1.0, greatest(0, CASE WHEN round((y - 1992) / 8.0, 6) > 1 THEN round((y - 1992) / 8.0, 6) / 5 ELSE round((y - 1992) / 8.0, 6) END))) AS significance FROM o GROUP BY proposal),
ca AS (SELECT proposal, avg(tier) AS feasibility, avg(CASE WHEN spans > 0 THEN 1.0 ELSE 0 END) AS grounding, count(*) AS claims, count(*) FILTER (spans = 0) AS unsupported FROM cl GROUP BY proposal),
ma AS (SELECT proposal, avg(CASE WHEN covered THEN 1.0 ELSE 0 END) AS completeness, count(*) FILTER (future) AS leaks, count(*) AS must_cites FROM mc GROUP BY proposal),
ct AS (SELECT c_custkey AS proposal, round(coalesce(novelty, 0) + 1e-9, 4) AS novelty, round(coalesce(significance, 0) + 1e-9, 4) AS significance, round(coalesce(feasibility, 0) + 1e-9, 4) AS feasibility, round(coalesce(grounding, 0) + 1e-9, 4) AS grounding, round(coalesce(completeness, 0) + 1e-9, 4) AS completeness, CASE WHEN coalesce(leaks, 0) > 0 THEN 0 ELSE 1 END AS temporal,
  coalesce(claims, 0) AS claims, coalesce(unsupported, 0) AS unsupported, coalesce(must_cites, 0) AS must_cites, coalesce(leaks, 0) AS leaks FROM customer LEFT JOIN fr ON fr.proposal = c_custkey LEFT JOIN ca ON ca.proposal = c_custkey LEFT JOIN ma ON ma.proposal = c_custkey),
cn AS (SELECT proposal, 'reproducibility' AS role, 'major' AS severity, 'source_span_ids' AS gap, claim AS about FROM cl WHERE spans = 0 UNION ALL SELECT proposal, 'novelty', 'minor', 'citation_context', key FROM mc WHERE NOT covered UNION ALL SELECT proposal, 'methods', 'major', 'temporal_cutoff', key FROM mc WHERE future)
"""


@query("must_cite", _PROPOSALS + "SELECT proposal, place, key, obligation, spans, covered, future FROM mc")
def must_cite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight papers of each proposal with their spans and leaks (O192)."""
    p = _proposals(spark, sf_dir)
    return P.must_cite(p["papers"], p["spans"], cutoff_year=1998)


def _certified(p: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    cited = P.must_cite(p["papers"], p["spans"], cutoff_year=1998)
    return P.certificate(p["proposals"], p["fragments"], p["claims"], cited), cited


@query("novelty_certificate", _PROPOSALS + "SELECT * FROM ct")
def novelty_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six axes of each proposal's certificate (O191)."""
    return _certified(_proposals(spark, sf_dir))[0]


@query("review_packet", _PROPOSALS + """
, k AS (SELECT proposal, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (role = 'novelty') AS a, count(*) FILTER (role = 'methods') AS b, count(*) FILTER (role = 'reproducibility') AS c FROM cn GROUP BY proposal)
SELECT proposal, novelty AS novelty_score, feasibility AS methods_score, grounding AS reproducibility_score, round((significance + grounding) / 2 + 1e-9, 4) AS outsider_score, coalesce(a, 0) AS novelty_concerns, coalesce(b, 0) AS methods_concerns, coalesce(c, 0) AS reproducibility_concerns, coalesce(major, 0) AS major,
  CASE WHEN coalesce(major, 0) > 0 THEN 'major_revision' WHEN grounding >= 0.75 THEN 'weak_accept' ELSE 'borderline' END AS recommendation FROM ct LEFT JOIN k USING (proposal)
""")  # fmt: skip
def review_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewers' scores, concerns and recommendation of each proposal (O194)."""
    p = _proposals(spark, sf_dir)
    claims = cut(p["claims"], "claims")
    cited = cut(P.must_cite(p["papers"], p["spans"], cutoff_year=1998), "cited")
    return P.review(P.certificate(p["proposals"], p["fragments"], claims, cited), P.concerns(claims, cited))


_STORY = _PROPOSALS + """,
rf AS (SELECT proposal, 'claim' AS kind, claim AS ref FROM cl WHERE spans > 0 UNION ALL SELECT proposal, 'challenge', 'z' || o_orderkey FROM o WHERE o_orderstatus = 'P' UNION ALL SELECT proposal, 'takeaway', 't' || o_orderkey FROM o WHERE o_orderpriority LIKE '5%' UNION ALL SELECT proposal, 'concern', about FROM cn WHERE severity = 'major'),
rn AS (SELECT *, row_number() OVER (PARTITION BY proposal, kind ORDER BY ref) AS n FROM (SELECT DISTINCT * FROM rf) QUALIFY n <= 8),
li AS (SELECT c_custkey AS proposal, coalesce(list(ref ORDER BY n) FILTER (kind = 'claim'), []) AS c, coalesce(list(ref ORDER BY n) FILTER (kind = 'challenge'), []) AS h, coalesce(list(ref ORDER BY n) FILTER (kind = 'takeaway'), []) AS t, coalesce(list(ref ORDER BY n) FILTER (kind = 'concern'), []) AS r FROM customer LEFT JOIN rn ON rn.proposal = c_custkey GROUP BY c_custkey),
be AS (SELECT proposal, unnest([{'place': 1, 'beat': 'problem', 'next_beat': 'gap', 'refs': CASE WHEN len(h) > 0 THEN h ELSE c[1:1] END}, {'place': 2, 'beat': 'gap', 'next_beat': 'bridge_principle', 'refs': CASE WHEN len(h) > 0 THEN h ELSE list_concat(r, c)[1:4] END},
  {'place': 3, 'beat': 'bridge_principle', 'next_beat': 'hypothesis', 'refs': CASE WHEN len(t) > 0 THEN t ELSE c[1:4] END}, {'place': 4, 'beat': 'hypothesis', 'next_beat': 'validation_plan', 'refs': c}, {'place': 5, 'beat': 'validation_plan', 'next_beat': 'risk', 'refs': list_concat(r, c)[1:8]},
  {'place': 6, 'beat': 'risk', 'next_beat': 'why_now', 'refs': list_concat(r, c)[1:8]}, {'place': 7, 'beat': 'why_now', 'next_beat': NULL, 'refs': list_concat(list_concat(c, t), list_concat(h, r))[1:8]}]) AS b FROM li)
SELECT proposal, b.place AS place, b.beat AS beat, b.next_beat AS next_beat, array_to_string(b.refs, ',') AS refs, len(b.refs) > 0 AS supported FROM be
"""


@query("proposal_storyline", _STORY)
def proposal_storyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven beats of each proposal with what they refer to (O193)."""
    p = _proposals(spark, sf_dir)
    claims = cut(p["claims"], "claims")
    raised = P.concerns(claims, P.must_cite(p["papers"], p["spans"], cutoff_year=1998)).where("severity = 'major'")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("proposal"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    row = lambda df, kind, ref: df.select("proposal", F.lit(kind).alias("kind"), ref.alias("place"), ref.alias("ref")).distinct()
    refs = row(claims.where("spans > 0"), "claim", F.col("claim")).unionByName(row(o.where("o_orderstatus = 'P'"), "challenge", F.concat(F.lit("z"), F.col("o_orderkey")))).unionByName(row(o.where("o_orderpriority like '5%'"), "takeaway", F.concat(F.lit("t"), F.col("o_orderkey")))).unionByName(row(raised, "concern", F.col("about")))
    return P.storyline(p["proposals"], refs)


_TYPES = ["Problem", "Hypothesis", "Mechanism", "Method", "NoveltyClaim", "EvalPlan", "Risk", "StoryBeat", "EvidenceNeed"]


@query("proposal_maturity", f"""
WITH RECURSIVE l AS (SELECT l_orderkey AS proposal, l_linenumber AS n, min(l_discount) AS d, min(l_tax) AS t, min(l_quantity) AS q, min(l_returnflag) AS f, min(l_linestatus) AS s FROM lineitem GROUP BY ALL),
n0 AS (SELECT proposal, n * 10 + u AS node, CASE u WHEN 0 THEN {_TYPES}[1 + (n - 1) % 7] ELSE {_TYPES}[7 + u] END AS type, u = 0 AND d >= 0.1 AS rejected, u = 0 AND f = 'R' AS supported, q > 45 AS high, d = 0 AS limited, t < 0.05 AS ready FROM l, (SELECT unnest([0, 1, 2]) AS u) WHERE u = 0 OR (u = 1 AND t >= 0.06) OR (u = 2 AND t <= 0.01)),
e AS (SELECT proposal, (n - 1) * 10 AS src, n * 10 AS dst, CASE WHEN d = 0.09 THEN 'CONTRADICTS' WHEN d = 0.08 THEN 'REPAIRS' WHEN t = 0.08 THEN 'FALSIFIED_BY' WHEN d <= 0.01 THEN 'OVERLAPS_PRIOR' WHEN s = 'F' THEN 'GROUNDED_IN' ELSE 'SUPPORTS' END AS type, d = 0.07 AS rejected FROM l WHERE n > 1),
a AS (SELECT * FROM e WHERE NOT rejected), v AS (SELECT * FROM n0 WHERE NOT rejected), i AS (SELECT a.proposal, src, dst FROM a JOIN v x ON x.proposal = a.proposal AND x.node = src JOIN v y ON y.proposal = a.proposal AND y.node = dst),
w AS (SELECT proposal, min(node) AS node FROM v WHERE type = 'Problem' GROUP BY proposal UNION SELECT w.proposal, CASE WHEN i.src = w.node THEN i.dst ELSE i.src END FROM w JOIN i ON i.proposal = w.proposal AND (i.src = w.node OR i.dst = w.node)),
cx AS (SELECT w.proposal, count(DISTINCT v.type) FILTER (list_contains({_TYPES[:7]}, v.type)) = 7 AS connected FROM w JOIN v ON v.proposal = w.proposal AND v.node = w.node GROUP BY w.proposal),
rp AS (SELECT DISTINCT proposal, dst AS node FROM a WHERE type = 'REPAIRS'), gr AS (SELECT DISTINCT proposal, src AS node FROM a WHERE type = 'GROUNDED_IN'),
z AS (SELECT v.*, rp.node IS NOT NULL AS repaired, gr.node IS NOT NULL AS grounded FROM v LEFT JOIN rp ON rp.proposal = v.proposal AND rp.node = v.node LEFT JOIN gr ON gr.proposal = v.proposal AND gr.node = v.node),
p AS (SELECT proposal, count(DISTINCT type) FILTER (list_contains({_TYPES[:7]}, type)) AS present, count(*) FILTER (supported) AS claims, count(*) FILTER (supported AND NOT grounded) AS ungrounded, count(*) FILTER (type = 'EvalPlan' AND ready) AS plans, count(*) FILTER (type = 'Risk' AND high AND NOT limited AND NOT repaired) AS risks, count(*) FILTER (type = 'StoryBeat') AS beats, count(*) FILTER (type = 'EvidenceNeed') AS needs FROM z GROUP BY proposal),
c AS (SELECT a.proposal, count(*) FILTER (type = 'CONTRADICTS' AND x.node IS NULL AND y.node IS NULL) AS contradictions, count(*) FILTER (type = 'FALSIFIED_BY') AS falsifiers, count(*) FILTER (type = 'OVERLAPS_PRIOR') AS contrasts FROM a LEFT JOIN rp x ON x.proposal = a.proposal AND x.node = src LEFT JOIN rp y ON y.proposal = a.proposal AND y.node = dst GROUP BY a.proposal),
r AS (SELECT k.proposal, coalesce(present, 0) AS present, coalesce(claims, 0) AS claims, coalesce(ungrounded, 0) AS ungrounded, coalesce(plans, 0) AS plans, coalesce(risks, 0) AS risks, coalesce(beats, 0) AS beats, coalesce(needs, 0) AS needs, coalesce(contradictions, 0) AS contradictions, coalesce(falsifiers, 0) AS falsifiers, coalesce(contrasts, 0) AS contrasts, coalesce(connected, false) AS connected
  FROM (SELECT DISTINCT proposal FROM n0) k LEFT JOIN p USING (proposal) LEFT JOIN c USING (proposal) LEFT JOIN cx USING (proposal)),
b AS (SELECT *, list_filter([CASE WHEN NOT connected THEN 'required_subgraph_not_connected' END, CASE WHEN present < 7 THEN 'missing_required_node_types' END, CASE WHEN ungrounded > 0 THEN 'ungrounded_evidence_supported_claims' END, CASE WHEN contradictions > 0 THEN 'unresolved_contradictions' END, CASE WHEN risks > 0 THEN 'unresolved_high_severity_risks' END,
  CASE WHEN plans = 0 THEN 'evaluation_plan_not_ready' END, CASE WHEN falsifiers = 0 THEN 'missing_falsification_route' END, CASE WHEN contrasts = 0 THEN 'missing_novelty_contrast' END, CASE WHEN beats = 0 THEN 'missing_storyline' END], lambda x: x IS NOT NULL) AS bl FROM r)
SELECT proposal, round(CASE WHEN claims > 0 THEN (claims - ungrounded) / CAST(claims AS DOUBLE) ELSE 1.0 END, 4) AS grounding, round(least(1.0, contradictions / 3.0), 4) AS contradiction_load, round(present / 7.0, 4) AS completeness, CASE WHEN contrasts > 0 THEN 0.0 ELSE 1.0 END AS novelty_risk, round(greatest(0.0, 1 - risks / 3.0), 4) AS feasibility,
  CASE WHEN plans > 0 AND falsifiers > 0 THEN 1.0 ELSE 0.0 END AS readiness, CASE WHEN beats > 0 THEN 1.0 ELSE 0.5 END AS coherence, 1.0 AS diversity, CASE WHEN needs > 3 THEN 0.5 ELSE 1.0 END AS evidence_cost, CASE WHEN len(bl) = 0 THEN 'committed' ELSE 'continue' END AS status, array_to_string(bl, ',') AS blocking FROM b
""")  # fmt: skip
def proposal_maturity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine scores and the commit gate of each proposal's graph (O196, O197)."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("proposal"), F.col("l_linenumber").alias("n")).agg(*[F.min(c).alias(a) for c, a in (("l_discount", "d"), ("l_tax", "t"), ("l_quantity", "q"), ("l_returnflag", "f"), ("l_linestatus", "s"))])
    u, d, t = F.col("u"), F.col("d"), F.col("t")
    kinds = F.array(*[F.lit(x) for x in _TYPES])
    rows = line.withColumn("u", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("u = 0 or (u = 1 and t >= 0.06) or (u = 2 and t <= 0.01)")
    kind = F.when(u == 0, F.get(kinds, ((F.col("n") - 1) % 7).cast("int"))).otherwise(F.get(kinds, (6 + u).cast("int")))
    nodes = rows.select("proposal", (F.col("n") * 10 + u).alias("node"), kind.alias("type"), ((u == 0) & (d >= 0.1)).alias("rejected"), ((u == 0) & (F.col("f") == "R")).alias("supported"), (F.col("q") > 45).alias("high"), (d == 0).alias("limited"), (t < 0.05).alias("ready"))
    type_ = F.when(d == 0.09, "CONTRADICTS").when(d == 0.08, "REPAIRS").when(t == 0.08, "FALSIFIED_BY").when(d <= 0.01, "OVERLAPS_PRIOR").when(F.col("s") == "F", "GROUNDED_IN").otherwise("SUPPORTS")
    edges = line.where("n > 1").select("proposal", ((F.col("n") - 1) * 10).alias("src"), (F.col("n") * 10).alias("dst"), type_.alias("type"), (d == 0.07).alias("rejected"))
    return P.maturity(nodes, edges)


# ---- parts as candidates of a controller --------------------------------------------------------------------

_PART_STATS = """
WITH st AS (SELECT l_partkey AS id, count(*) AS n, count(DISTINCT l_suppkey) AS s, round(avg(l_discount), 6) AS d, round(avg(l_quantity) / 50, 6) AS q, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END), 6) AS r, count(DISTINCT l_orderkey) AS o, max(CAST(year(l_shipdate) AS INTEGER)) AS y FROM lineitem GROUP BY l_partkey),
c AS (SELECT st.*, p_name, p_brand, p_type, p_size, round(least(1.0, n / 40.0), 6) AS evidence, round(least(1.0, s / 10.0), 6) AS mechanism, q AS feasibility, round(greatest(0.0, 1 - n / 60.0), 6) AS novelty, round(d * 10, 6) AS preference, round(least(1.0, p_size / 50.0), 6) AS readiness, r AS risk, CASE WHEN r > 0.45 THEN 'reject' WHEN r > 0.4 THEN 'needs_evidence' ELSE 'keep' END AS verdict FROM st JOIN part ON p_partkey = id)
"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(
        F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("s"), F.round(F.avg("l_discount"), 6).alias("d"), F.round(F.avg("l_quantity") / 50, 6).alias("q"), F.round(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)), 6).alias("r"), F.countDistinct("l_orderkey").alias("o"), F.max(F.year("l_shipdate")).alias("y"),
    )
    one = F.lit(1.0)
    rows = line.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type", "p_size"), "id")
    return rows.withColumns({
        "evidence": F.round(F.least(one, F.col("n") / 40), 6), "mechanism": F.round(F.least(one, F.col("s") / 10), 6), "feasibility": F.col("q"), "novelty": F.round(F.greatest(F.lit(0.0), 1 - F.col("n") / 60), 6), "preference": F.round(F.col("d") * 10, 6), "readiness": F.round(F.least(one, F.col("p_size") / 50), 6), "risk": F.col("r"),
        "verdict": F.when(F.col("r") > 0.45, "reject").when(F.col("r") > 0.4, "needs_evidence").otherwise("keep"), "far": F.col("p_brand").endswith("5"), "bridged": F.col("s") >= 5,
    })


@query("candidate_utility", _PART_STATS + """
SELECT id, round(greatest(0.0, least(1.0, 0.07 + 0.28 * evidence + 0.24 * mechanism + 0.18 * feasibility + 0.14 * novelty + 0.1 * preference + 0.12 * readiness - 0.16 * risk)), 3) AS utility,
  verdict = 'reject' OR (risk >= 0.85 AND feasibility < 0.35) OR (p_brand LIKE '%5' AND mechanism < 0.6 AND s < 5) AS hard_gate, verdict = 'needs_evidence' OR evidence < 0.35 OR readiness < 0.35 OR (p_brand LIKE '%5' AND mechanism < 0.6 AND s < 5) AS needs_evidence FROM c
""")  # fmt: skip
def candidate_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utility of each candidate with its gates (O212, O64)."""
    return C.candidate_utility(_parts(spark, sf_dir)).select("id", "utility", "hard_gate", "needs_evidence")


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = C.candidate_utility(_parts(spark, sf_dir))
    low = lambda x: F.lower(F.col(x))
    rows = c.select("id", "utility", "hard_gate", F.col("p_brand").alias("subproblem"), low("p_type").alias("mechanism"), (F.col("p_size") % 10).cast("string").alias("source_domain"), F.split("p_name", " ")[0].alias("aspect"), (F.col("n") % 5).cast("string").alias("cluster"),
                    T.content_tokens(T.normalize(F.col("p_name"))).alias("tokens"), F.array(low("p_type")).alias("mechanisms"), F.array("p_brand").alias("bridges"), F.split("p_name", " ").alias("aspects"))
    near = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(near).alias("b"), "l_returnflag", "l_discount").where("b is not null and a <> b")
    kind = F.when(F.col("l_returnflag") == "R", "CONFLICTS_WITH").when(F.col("l_returnflag") == "A", "COMPLEMENTS").otherwise("SUBSTITUTES")
    return rows, pairs.select("a", "b", kind.alias("type"), (F.col("l_discount") * 10).alias("confidence"))


@query("selector_ablation")
def selector_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of the best, of MMR and of the coverage selection, and where they agree (O213, O214, O215)."""
    return K.selector_ablation(*_batch(spark, sf_dir))


@query("beam_search", """
WITH h0 AS (SELECT o_orderpriority AS subproblem, l_linenumber AS query, l_partkey AS id, max(l_extendedprice) AS price, CASE WHEN min(l_returnflag) = 'N' THEN 'node' ELSE 'paper' END AS scope FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
h AS (SELECT *, CAST(row_number() OVER (PARTITION BY subproblem, query ORDER BY price DESC, id) AS INTEGER) AS place FROM h0 QUALIFY place <= 8),
f AS (SELECT subproblem, id, min((query, place)) AS f FROM h WHERE scope = 'paper' GROUP BY ALL), k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY subproblem ORDER BY f, id) <= 4)
SELECT h.subproblem, h.query, h.place, h.id, CASE WHEN scope <> 'paper' THEN 'non_paper_scope' WHEN k.f IS NULL THEN 'beam_width_limit' WHEN k.f = (h.query, h.place) THEN 'kept' ELSE 'duplicate_paper' END AS outcome FROM h LEFT JOIN k ON k.subproblem = h.subproblem AND k.id = h.id
""")  # fmt: skip
def beam_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a beam of four papers keeps of each subproblem's hits and why others go; eight hits a query are the search's definition (O217)."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    found = joined.groupBy(F.col("o_orderpriority").alias("subproblem"), F.col("l_linenumber").alias("query"), F.col("l_partkey").alias("id")).agg(F.max("l_extendedprice").alias("price"), F.when(F.min("l_returnflag") == "N", "node").otherwise("paper").alias("scope"))
    w = Window.partitionBy("subproblem", "query").orderBy(F.desc("price"), "id")
    return K.beam_search(found.withColumn("place", F.row_number().over(w)).where("place <= 8"), 4)


_TOPIC, _SEARCHES, _PREFERRED = "red steel widget", [("blue gadget", "related_work"), ("small brass plate", "core")], ["Brand#11", "Brand#22", "Brand#33"]


def _overlap(q: str, tk: str) -> str:
    return f"len(list_filter({q.split()}, lambda u: list_contains({tk}, u))) / {len(q.split())}.0"


@query("candidate_scores", _PART_STATS + f"""
, x AS (SELECT *, {S.content_tokens(S.normalized("p_name"))} AS tt, {S.content_tokens(S.normalized("p_type || ' ' || p_brand"))} AS ta FROM c),
z AS (SELECT *, {_overlap("red steel widget", "tt")} + least(0.5, {_overlap("red steel widget", "ta")} * 0.5) AS topic, {_overlap("blue gadget", "tt")} AS s1, least(0.5, {_overlap("blue gadget", "ta")} * 0.5) AS a1, {_overlap("small brass plate", "tt")} + least(0.5, {_overlap("small brass plate", "ta")} * 0.5) AS s2 FROM x)
SELECT id, round(greatest(topic, least(1.15, greatest(0, s1 + a1 + CASE WHEN s1 >= 0.5 THEN 0.15 ELSE 0 END, s2))) + least(0.3, greatest(1, s) * 0.08) + CASE WHEN n > 0 THEN least(0.3, log10(n + 1) / 20) ELSE 0 END + CASE WHEN y >= 1996 THEN 0.12 ELSE 0 END + CASE WHEN r < 0.3 THEN 0.12 ELSE 0 END + CASE WHEN p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') THEN 0.12 ELSE 0 END, 4) AS score FROM z
""")  # fmt: skip
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovery score of each candidate (O151)."""
    rows = _parts(spark, sf_dir).select("id", F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_brand").alias("abstract"), F.col("s").alias("providers"), F.col("n").alias("citations"), F.col("y").alias("year"), (F.col("r") < 0.3).alias("open_access"), F.array("p_brand").alias("packs"))
    return C.discovery_score(rows, _TOPIC, _SEARCHES, _PREFERRED, 1998).select("id", "score")


_CARDS = [
    {"pattern": "swap-material", "kinds": ["additive"], "types": ["steel", "brass"], "terms": ["steel", "brass", "plate"]},
    {"pattern": "shrink", "kinds": ["subtractive"], "types": ["tin"], "terms": ["small", "mini", "widget"]},
    {"pattern": "recolor", "kinds": ["additive", "subtractive"], "types": ["nickel"], "terms": ["red", "blue", "green"]},
    {"pattern": "merge-parts", "kinds": ["subtractive"], "types": ["copper"], "terms": ["gadget", "widget"]},
]


def _card_sql(card: dict) -> str:
    hits = " + ".join(f"CAST(contains(norm, '{t}') AS INTEGER)" for t in card["terms"])
    return f"{{'s': -round(least(1.0, CASE WHEN kind IN {tuple([*card['kinds'], ''])} THEN 0.15 ELSE 0 END + CASE WHEN type IN {tuple([*card['types'], ''])} THEN 0.45 ELSE 0 END + least(0.4, 0.14 * ({hits}))), 4), 'pattern': '{card['pattern']}'}}"


@query("gap_patterns", f"""
WITH g AS (SELECT l_suppkey AS gap, CASE WHEN avg(l_discount) > 0.05 THEN 'additive' ELSE 'subtractive' END AS kind, lower(min(p_type)) AS type, string_agg(DISTINCT p_name, ' ' ORDER BY p_name) AS text FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey),
n AS (SELECT gap, kind, type, {S.normalized("text")} AS norm FROM g), m AS (SELECT gap, unnest(list_sort(list_filter([{', '.join(map(_card_sql, _CARDS))}], lambda x: x.s <= -0.25))[1:2]) AS m, generate_subscripts(list_sort(list_filter([{', '.join(map(_card_sql, _CARDS))}], lambda x: x.s <= -0.25))[1:2], 1) AS place FROM n)
SELECT gap, m.pattern AS pattern, -m.s AS score, CAST(place AS INTEGER) AS place FROM m
""")  # fmt: skip
def gap_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best of a stated list of patterns for each gap; a supplier's gap is told by its parts (O233). Discounts are summed as decimals, as a mean of just .05 else hangs on the order of the rows."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    gaps = rows.groupBy(F.col("l_suppkey").alias("gap")).agg(F.when(F.sum(F.col("l_discount").cast("decimal(18,6)")) > F.count("l_discount") * F.lit("0.05").cast("decimal(4,2)"), "additive").otherwise("subtractive").alias("kind"), F.lower(F.min("p_type")).alias("type"), F.array_join(F.array_sort(F.collect_set("p_name")), " ").alias("text"))
    return C.pattern_matches(gaps, _CARDS)


@query("semantic_admission", f"""
WITH r AS (SELECT conv_id AS paper, turn AS id, CASE turn % 3 WHEN 0 THEN 'Claim' WHEN 1 THEN 'Method' ELSE 'Problem' END AS type, split_part(coalesce(text, ''), '.', 1) AS name, coalesce(text, '') AS text, 0.5 + 0.02 * (length(coalesce(text, '')) % 20) AS confidence, role = 'user' AS explicit, CASE role WHEN 'user' THEN 'abstract' WHEN 'assistant' THEN 'results' ELSE 'inferred' END AS section, length(coalesce(text, '')) % 2 = 0 AS linked FROM conversations),
s AS (SELECT *, CASE WHEN trim(name) = '' THEN trim(name) ELSE trim(name) END AS nm, length(trim(text)) AS len FROM r), t AS (SELECT *, {S.normalized("nm")} AS norm FROM s), u AS (SELECT *, len({S.content_tokens("norm")}) AS nt FROM t),
k AS (SELECT * FROM u WHERE norm <> '' AND CASE WHEN type = 'Claim' THEN len >= 32 ELSE nt >= CASE WHEN section = 'inferred' THEN 3 ELSE 2 END END),
c AS (SELECT *, round(greatest(0.0, least(0.99, confidence + CASE WHEN explicit THEN 0.04 ELSE 0 END + CASE section WHEN 'abstract' THEN 0.06 WHEN 'results' THEN 0.04 ELSE -0.08 END + CASE WHEN nt >= 3 THEN 0.08 WHEN nt = 2 THEN 0.03 ELSE 0 END + CASE WHEN type = 'Claim' AND len >= 48 THEN 0.06 ELSE 0 END + CASE WHEN linked THEN 0.04 ELSE 0 END)), 3) AS score FROM k),
d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY paper, type, norm ORDER BY confidence DESC, len DESC, id) = 1)
SELECT paper, id, type, score, CASE WHEN score >= 0.86 THEN 'high' WHEN score >= 0.72 THEN 'medium' ELSE 'low' END AS tier, CAST(row_number() OVER (PARTITION BY paper, type ORDER BY confidence DESC, len DESC, id) AS INTEGER) AS place FROM d QUALIFY place <= CASE type WHEN 'Claim' THEN 5 WHEN 'Method' THEN 3 ELSE 4 END
""")  # fmt: skip
def semantic_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that are admitted, with score, tier and their slot in a paper."""
    text, n = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit("")))
    kind = F.when(F.col("turn") % 3 == 0, "Claim").when(F.col("turn") % 3 == 1, "Method").otherwise("Problem")
    section = F.when(F.col("role") == "user", "abstract").when(F.col("role") == "assistant", "results").otherwise("inferred")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper"), F.col("turn").alias("id"), kind.alias("type"), F.substring_index(text, ".", 1).alias("name"), text.alias("text"), (0.5 + 0.02 * (n % 20)).alias("confidence"), (F.col("role") == "user").alias("explicit"), section.alias("section"), (n % 2 == 0).alias("linked"))
    return C.admitted_records(rows)


@query("proposal_merge", """
WITH l AS (SELECT l_orderkey AS p, l_linenumber AS k, min(l_returnflag) AS f FROM lineitem GROUP BY ALL), t AS (SELECT *, 'n' || k AS id, 'a' || k AS a, (['Problem', 'Hypothesis', 'Mechanism', 'Method', 'NoveltyClaim', 'EvalPlan', 'Risk'])[(k - 1) % 7 + 1] AS type FROM l),
e AS (SELECT t.p, t.id AS src, CASE WHEN x.p IS NULL THEN NULL ELSE 'n1' END AS dst FROM t LEFT JOIN t x ON x.p = t.p AND x.id = 'n1' WHERE t.f = 'A'), ok AS (SELECT *, 'edge:' || substr(sha256(src || chr(31) || 'supports' || chr(31) || dst), 1, 18) AS id FROM e WHERE dst IS NOT NULL),
h AS (
  SELECT p, sha256(concat_ws(chr(31), 'node', id, type, 'line', CASE WHEN f = 'N' THEN 'new ' || k ELSE 'old ' || k END, CASE WHEN f = 'R' THEN 'rejected' ELSE 'active' END, CASE WHEN f = 'R' THEN 'rejected' ELSE '' END, CASE f WHEN 'N' THEN 'previous_text=old ' || k || chr(30) || 'revision_action=' || a WHEN 'R' THEN 'label_reason=returned' ELSE '' END)) AS h FROM t
  UNION SELECT p, sha256(concat_ws(chr(31), 'edge', id, src, dst, 'supports', 'active', '')) FROM ok
), a4 AS (SELECT p, substr(h, 1, 4) || sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY p, substr(h, 1, 4)), a2 AS (SELECT p, substr(h, 1, 2) || sha256(string_agg(h, '' ORDER BY h)) AS h FROM a4 GROUP BY p, substr(h, 1, 2)),
g AS (SELECT p, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM a2 GROUP BY p)
SELECT g.p AS proposal, digest, count(*) AS nodes, count(*) FILTER (f = 'R') AS rejected, any_value(coalesce(n, 0)) AS edges FROM g JOIN t USING (p) LEFT JOIN (SELECT p, count(*) AS n FROM ok GROUP BY p) c USING (p) GROUP BY g.p, digest
""")  # fmt: skip
def proposal_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round of actions on each order's proposal, checked against its graph, merged and hashed (O196)."""
    from quillgraph.operators import proposal_graph as G

    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("proposal"), F.col("l_linenumber").alias("k")).agg(F.min("l_returnflag").alias("f"))
    line = cut(line, "proposal-lines")
    none, empty = F.lit(None).cast("string"), F.create_map().cast("map<string,string>")
    name = lambda p: F.concat(F.lit(p), F.col("k"))
    kinds = F.array(*[F.lit(x) for x in _TYPES[:7]])
    nodes = line.select("proposal", name("n").alias("id"), F.get(kinds, ((F.col("k") - 1) % 7).cast("int")).alias("type"), F.lit("line").alias("title"), name("old ").alias("text"), F.lit("active").alias("status"), none.alias("label"), empty.alias("properties"))
    edges = nodes.where("false").select("proposal", "id", F.col("id").alias("src"), F.col("id").alias("dst"), "type", "status", "properties")
    digests = G.graph_digest(nodes, edges)
    slates = digests.select("proposal", F.lit("s").alias("slate"), F.lit("1").alias("round"), F.lit("critic").alias("role"), F.col("digest").alias("snapshot"), F.lit(False).alias("skip"))
    f = F.col("f")
    kind = F.when(f == "A", "add_support_edge").when(f == "R", "reject_claim").otherwise("revise_node_text")
    actions = line.select(
        "proposal", F.lit("s").alias("slate"), name("a").alias("action"), kind.alias("type"), name("n").alias("source"), F.when(f == "A", "n1").otherwise(name("n")).alias("target"), F.lit(None).cast("struct<id:string,type:string,title:string,text:string>").alias("node"),
        F.lit(None).cast("struct<id:string,src:string,dst:string,type:string>").alias("edge"), name("new ").alias("text"), F.when(f == "R", "returned").alias("reason"), F.lit(False).alias("must_cite"),
    )
    after, ties, _ = G.merge_actions(nodes, edges, G.checked_actions(actions, slates, nodes, digests))
    after, ties = cut(after, "proposal-nodes"), cut(ties, "proposal-edges")
    counts = after.groupBy("proposal").agg(F.count("*").alias("nodes"), F.count_if(F.col("status") == "rejected").alias("rejected"))
    return G.graph_digest(after, ties).join(counts, "proposal").join(ties.groupBy("proposal").agg(F.count("*").alias("edges")), "proposal", "left").fillna(0, ["edges"])
