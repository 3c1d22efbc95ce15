"""Proposals: prior work to cite, certificates of novelty, review concerns, storylines, and the maturity of a proposal's graph.

Every table has a ``proposal`` column, so that all proposals are assessed together. Null scores count as .5 where the certificate says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.runtime import cut

#: What a claim's evidence is worth, papers that must be cited, beats of a story, references of a beat.
TIERS = {"strong": 0.9, "moderate": 0.7, "weak": 0.35}
MISSING_TIER, MUST_CITE, MOST_CITE, TRACE = 0.45, 8, 50, 8
BEATS = ("problem", "gap", "bridge_principle", "hypothesis", "validation_plan", "risk", "why_now")


def must_cite(papers: DataFrame, spans: DataFrame, k: int = MUST_CITE, cutoff_year: int | None = None) -> DataFrame:
    """proposal, place, key, obligation, spans, covered, future of the first k papers(proposal, place, key, title, year); spans(proposal, span, key, title).

    A paper is covered if a span of its proposal has its key or its title. One after the cutoff leaks the future.
    """
    first = papers.where((F.coalesce("key", F.lit("")) != "") | (F.coalesce("title", F.lit("")) != "")).withColumn("n", F.row_number().over(Window.partitionBy("proposal").orderBy("place")))
    first = first.where(F.col("n") <= min(max(1, k), MOST_CITE))
    # both names of a paper, or of a span, are looked up by one join
    named = lambda df, *keep: df.select(*keep, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{c}:"), F.col(c))) for c in ("key", "title")]))).alias("name"))
    found = named(first, "proposal", "n", "key", "year").join(named(spans, "proposal", "span"), ["proposal", "name"], "left")
    out = found.groupBy("proposal", "n", "key", "year").agg(F.countDistinct("span").alias("spans"))
    future = F.coalesce(F.col("year") > F.lit(cutoff_year).cast("int"), F.lit(False))
    return out.select("proposal", F.col("n").alias("place"), "key", F.when(F.col("n") == 1, "baseline_or_method_anchor").otherwise("supporting_prior").alias("obligation"), "spans", (F.col("spans") > 0).alias("covered"), future.alias("future"))


def _tier(c: Column) -> Column:
    out = F.lit(MISSING_TIER)
    for name, value in TIERS.items():
        out = F.when(F.lower(F.trim(c)) == name, value).otherwise(out)
    return out


def certificate(proposals: DataFrame, fragments: DataFrame, claims: DataFrame, cited: DataFrame) -> DataFrame:
    """Six axes for each of proposals(proposal): novelty, significance, feasibility, grounding, completeness of citations, temporal validity; 0 where nothing is there.

    fragments(proposal, novelty, usefulness); claims(proposal, claim, spans, tier); cited from must_cite.
    """
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(F.col(c) > 1, F.col(c) / 5).otherwise(F.col(c)), F.lit(0.5))))
    wide = lambda df, **have: df.select("proposal", *[have.get(c, F.lit(None)).cast("double").alias(c) for c in ("listed", "novelty", "usefulness", "tier", "spans", "covered", "future", "is_claim", "is_cited")])
    all_ = wide(proposals, listed=F.lit(1)).unionByName(wide(fragments, novelty=unit("novelty"), usefulness=unit("usefulness")))
    all_ = all_.unionByName(wide(claims, is_claim=F.lit(1), tier=_tier(F.col("tier")), spans=F.col("spans"))).unionByName(wide(cited, is_cited=F.lit(1), covered=F.col("covered").cast("int"), future=F.col("future").cast("int")))
    rows = all_.groupBy("proposal").agg(
        F.max("listed").alias("listed"), F.avg("novelty").alias("novelty"), F.avg("usefulness").alias("significance"), F.avg("tier").alias("feasibility"), F.avg((F.col("spans") > 0).cast("int")).alias("grounding"), F.count("is_claim").alias("claims"), F.count_if(F.col("spans") == 0).alias("unsupported"),
        F.avg("covered").alias("completeness"), F.count_if(F.col("future") > 0).alias("leaks"), F.count("is_cited").alias("must_cites"),
    ).where("listed = 1").fillna(0)
    return rows.select("proposal", *[F.round(F.col(x) + 1e-9, 4).alias(x) for x in ("novelty", "significance", "feasibility", "grounding", "completeness")], F.when(F.col("leaks") > 0, 0).otherwise(1).alias("temporal"), "claims", "unsupported", "must_cites", "leaks")


def concerns(claims: DataFrame, cited: DataFrame) -> DataFrame:
    """proposal, role, severity, gap, about: claims without spans and future citations (major), citations without spans (minor)."""
    of = lambda df, role, severity, gap, about: df.select("proposal", F.lit(role).alias("role"), F.lit(severity).alias("severity"), F.lit(gap).alias("gap"), F.col(about).cast("string").alias("about"))
    return (
        of(claims.where("spans = 0"), "reproducibility", "major", "source_span_ids", "claim")
        .unionByName(of(cited.where("not covered"), "novelty", "minor", "citation_context", "key"))
        .unionByName(of(cited.where("future"), "methods", "major", "temporal_cutoff", "key"))
    )


def review(certified: DataFrame, raised: DataFrame) -> DataFrame:
    """proposal, four reviewers' scores and concerns, major concerns, recommendation."""
    n = raised.groupBy("proposal").agg(F.count_if(F.col("severity") == "major").alias("major"), *[F.count_if(F.col("role") == r).alias(f"{r}_concerns") for r in ("novelty", "methods", "reproducibility")])
    rows = certified.join(n, "proposal", "left").fillna(0, ["major", "novelty_concerns", "methods_concerns", "reproducibility_concerns"])
    verdict = F.when(F.col("major") > 0, "major_revision").when(F.col("grounding") >= 0.75, "weak_accept").otherwise("borderline")
    return rows.select("proposal", F.col("novelty").alias("novelty_score"), F.col("feasibility").alias("methods_score"), F.col("grounding").alias("reproducibility_score"), F.round((F.col("significance") + F.col("grounding")) / 2 + 1e-9, 4).alias("outsider_score"), "novelty_concerns", "methods_concerns", "reproducibility_concerns", "major", verdict.alias("recommendation"))


def storyline(proposals: DataFrame, refs: DataFrame) -> DataFrame:
    """proposal, place, beat, next_beat, refs, supported: seven beats in order with what each refers to, eight at most.

    refs(proposal, kind, place, ref) of kinds claim, challenge, takeaway and concern, eight of each at most. Problem and gap lean on challenges,
    the bridge on takeaways, the hypothesis on claims, plan and risk on concerns and claims, why now on everything.
    """
    first = refs.withColumn("n", F.row_number().over(Window.partitionBy("proposal", "kind").orderBy("place", "ref"))).where(F.col("n") <= TRACE)
    lists = first.groupBy("proposal").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("n", "ref")))), lambda x: x["ref"]).alias(k) for k in ("claim", "challenge", "takeaway", "concern")])
    rows = proposals.select("proposal").distinct().join(lists, "proposal", "left")
    empty = F.array().cast("array<string>")
    claim, challenge, takeaway, concern = (F.coalesce(k, empty) for k in ("claim", "challenge", "takeaway", "concern"))
    has = lambda x: F.size(x) > 0
    traces = {
        "problem": F.when(has(challenge), challenge).otherwise(F.slice(claim, 1, 1)), "gap": F.when(has(challenge), challenge).otherwise(F.slice(F.concat(concern, claim), 1, 4)), "bridge_principle": F.when(has(takeaway), takeaway).otherwise(F.slice(claim, 1, 4)), "hypothesis": claim,
        "validation_plan": F.slice(F.concat(concern, claim), 1, TRACE), "risk": F.slice(F.concat(concern, claim), 1, TRACE), "why_now": F.slice(F.concat(claim, takeaway, challenge, concern), 1, TRACE),
    }
    after = dict(zip(BEATS, [*BEATS[1:], None]))
    beats = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(b).alias("beat"), F.lit(after[b]).cast("string").alias("next_beat"), traces[b].alias("refs")) for i, b in enumerate(BEATS, 1)])).alias("x")
    return rows.select("proposal", beats).select("proposal", "x.place", "x.beat", "x.next_beat", F.array_join("x.refs", ",").alias("refs"), (F.size("x.refs") > 0).alias("supported"))


#: Types that a whole proposal has.
REQUIRED = ("Problem", "Hypothesis", "Mechanism", "Method", "NoveltyClaim", "EvalPlan", "Risk")


def _connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """proposal, node of what is reached, undirected, from each proposal's first problem. Steps end when none of them reaches more."""
    both = cut(edges.select("proposal", F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select("proposal", F.col("dst").alias("a"), F.col("src").alias("b"))), "proposal-edges")
    seen = cut(nodes.where("type = 'Problem'").groupBy("proposal").agg(F.min("node").alias("node")), "proposal-seen")
    frontier = seen
    while True:
        fresh = frontier.join(both.withColumnRenamed("a", "node"), ["proposal", "node"]).select("proposal", F.col("b").alias("node")).distinct()
        frontier = cut(fresh.join(seen, ["proposal", "node"], "left_anti"), "proposal-step")
        if not frontier.limit(1).count():
            return seen
        seen = seen.unionByName(frontier)


def maturity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nine scores and the gate of each proposal.

    nodes(proposal, node, type, rejected, supported (an evidence-supported claim), high (severity), limited, ready (a whole evaluation plan));
    edges(proposal, src, dst, type, rejected). Rejected rows are inactive.
    """
    live = nodes.where(~F.coalesce("rejected", F.lit(False)))
    active = edges.where(~F.coalesce("rejected", F.lit(False)))
    inside = active.join(live.select("proposal", F.col("node").alias("src")), ["proposal", "src"], "left_semi").join(live.select("proposal", F.col("node").alias("dst")), ["proposal", "dst"], "left_semi")
    repaired = active.where("type = 'REPAIRS'").select("proposal", F.col("dst").alias("node")).distinct().withColumn("repaired", F.lit(True))
    grounded = active.where("type = 'GROUNDED_IN'").select("proposal", F.col("src").alias("node")).distinct().withColumn("grounded", F.lit(True))
    rows = live.join(repaired, ["proposal", "node"], "left").join(grounded, ["proposal", "node"], "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    is_type = lambda t: F.col("type") == t
    risk = is_type("Risk") & flag("high") & ~flag("limited") & ~flag("repaired")
    per = rows.groupBy("proposal").agg(
        F.size(F.collect_set(F.when(F.col("type").isin(list(REQUIRED)), F.col("type")))).alias("present"), F.count_if(flag("supported")).alias("claims"), F.count_if(flag("supported") & ~flag("grounded")).alias("ungrounded"),
        F.count_if(is_type("EvalPlan") & flag("ready")).alias("plans"), F.count_if(risk).alias("risks"), F.count_if(is_type("StoryBeat")).alias("beats"), F.count_if(is_type("EvidenceNeed")).alias("needs"),
    )
    ends = active.where("type = 'CONTRADICTS'")
    for end in ("src", "dst"):
        ends = ends.join(repaired.select("proposal", F.col("node").alias(end)), ["proposal", end], "left_anti")
    needed = active.where("type = 'REQUIRES_EVIDENCE'").join(nodes.where("type = 'EvidenceNeed'").select("proposal", F.col("node").alias("dst")), ["proposal", "dst"], "left_semi")
    count = lambda df, name: df.groupBy("proposal").agg(F.count("*").alias(name))
    edge_counts = count(ends, "contradictions").join(count(active.where("type = 'FALSIFIED_BY'"), "falsifiers"), "proposal", "full_outer").join(count(active.where("type = 'OVERLAPS_PRIOR'").select("proposal").unionByName(needed.select("proposal")), "contrasts"), "proposal", "full_outer")
    reached = _connected(live, inside).join(live.select("proposal", "node", "type"), ["proposal", "node"]).groupBy("proposal").agg((F.size(F.collect_set(F.when(F.col("type").isin(list(REQUIRED)), F.col("type")))) == len(REQUIRED)).alias("connected"))
    out = nodes.select("proposal").distinct().join(per, "proposal", "left").join(edge_counts, "proposal", "left").fillna(0).join(reached, "proposal", "left").withColumn("connected", flag("connected"))
    reasons = {
        "required_subgraph_not_connected": ~F.col("connected"), "missing_required_node_types": F.col("present") < len(REQUIRED), "ungrounded_evidence_supported_claims": F.col("ungrounded") > 0, "unresolved_contradictions": F.col("contradictions") > 0, "unresolved_high_severity_risks": F.col("risks") > 0,
        "evaluation_plan_not_ready": F.col("plans") == 0, "missing_falsification_route": F.col("falsifiers") == 0, "missing_novelty_contrast": F.col("contrasts") == 0, "missing_storyline": F.col("beats") == 0,
    }
    blocking = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in reasons.items()]))
    return out.select(
        "proposal", F.round(F.when(F.col("claims") > 0, (F.col("claims") - F.col("ungrounded")) / F.col("claims")).otherwise(1.0), 4).alias("grounding"), F.round(F.least(F.lit(1.0), F.col("contradictions") / 3), 4).alias("contradiction_load"),
        F.round(F.col("present") / len(REQUIRED), 4).alias("completeness"), F.when(F.col("contrasts") > 0, 0.0).otherwise(1.0).alias("novelty_risk"), F.round(F.greatest(F.lit(0.0), 1 - F.col("risks") / 3), 4).alias("feasibility"),
        F.when((F.col("plans") > 0) & (F.col("falsifiers") > 0), 1.0).otherwise(0.0).alias("readiness"), F.when(F.col("beats") > 0, 1.0).otherwise(0.5).alias("coherence"), F.lit(1.0).alias("diversity"), F.when(F.col("needs") > 3, 0.5).otherwise(1.0).alias("evidence_cost"),
        F.when(F.size(blocking) == 0, "committed").otherwise("continue").alias("status"), F.array_join(blocking, ",").alias("blocking"),
    )
