"""Bridges between domains: candidates for a challenge of a target domain, their analogies, rankings, takeaways and a report by domain.

Tables: nodes(id, name, type, domain, text); mechanisms(id, mechanism); challenges(id, challenge); snippets(id, snippet) in the order of
``place``; takeaways(id); distances(domain, distance) from the target domain; support(mechanism, papers). The challenge and the requested
mechanisms are constants of a call. Texts are compared by content tokens; scores are rounded to 4 decimals, as the ties are decided on those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as T

#: What a phrase adds in retrieval and in alignment, snippets that count for quality.
SIMILAR_PHRASE, ALIGNED_PHRASE, QUALITY_SNIPPETS = 0.2, 0.15, 6


def similarity(query: Column, text: Column, phrase: float = SIMILAR_PHRASE) -> Column:
    """Share of the query's content tokens that the text has, and a bonus if it holds the query as it stands; 1 at most."""
    q, t = F.lower(F.trim(F.coalesce(query, F.lit("")))), F.lower(F.trim(F.coalesce(text, F.lit(""))))
    a, b = T.content_tokens(T.normalize(q)), T.content_tokens(T.normalize(t))
    bonus = F.when((q != "") & F.contains(t, q), phrase).otherwise(0.0)
    return F.round(F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.least(F.lit(1.0), T.token_overlap(a, b) + bonus)), 4)


def alignment(query: Column, text: Column) -> Column:
    return similarity(query, text, ALIGNED_PHRASE)


def _lists(df: DataFrame, value: str, name: str) -> DataFrame:
    return df.groupBy("id").agg(F.array_sort(F.collect_set(value)).alias(name))


def bridge_candidates(
    nodes: DataFrame, mechanisms: DataFrame, challenges: DataFrame, snippets: DataFrame, takeaways: DataFrame, distances: DataFrame, support: DataFrame, target: str, challenge: str, requested: list[str]
) -> DataFrame:
    """One row for each node outside the target domain: the parts of its score, matched mechanisms, motifs of its path, combined score.

    Combined: .4 retrieval + .4 graph + .2 distance, times .65 if nothing covers the challenge. Graph: .35 mechanisms + .35 challenge +
    .15 density of evidence + .15 support of the mechanisms. Lists of a node are bounded by its own links.
    """
    ask, want = F.lit(challenge), F.array(*[F.lit(m) for m in requested]).cast("array<string>")
    rows = nodes.where((F.col("domain") != "") & (F.col("domain") != target))
    per_mechanism = mechanisms.distinct().join(support, "mechanism", "left").select("id", "mechanism", F.least(F.lit(1.0), F.coalesce("papers", F.lit(0)) / 4).alias("share"))
    wanted = F.array_contains(want, F.col("mechanism"))
    of_mechanisms = per_mechanism.groupBy("id").agg(F.array_sort(F.collect_list("mechanism")).alias("all_mechanisms"), F.avg("share").alias("all_support"), F.avg(F.when(wanted, F.col("share"))).alias("matched_support"))
    met = challenges.distinct().groupBy("id").agg(F.array_sort(F.collect_list("challenge")).alias("challenges"), F.max(similarity(ask, F.col("challenge"))).alias("met"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("place"))
    ranked = snippets.withColumn("n", place)
    evidence = ranked.groupBy("id").agg(F.count("*").alias("snippets"), F.max(similarity(ask, F.col("snippet"))).alias("evidenced"), F.round(F.avg(F.when(F.col("n") <= QUALITY_SNIPPETS, T.evidence_quality(F.col("snippet")))), 4).alias("quality"))
    rows = rows.join(of_mechanisms, "id", "left").join(met, "id", "left").join(evidence, "id", "left").join(takeaways.select("id", F.lit(True).alias("takeaway")).distinct(), "id", "left").join(distances, "domain", "left")
    empty = F.array().cast("array<string>")
    rows = rows.withColumns({"all_mechanisms": F.coalesce("all_mechanisms", empty), "challenges": F.coalesce("challenges", empty), "snippets": F.coalesce("snippets", F.lit(0)), "quality": F.coalesce("quality", F.lit(0.0)), "takeaway": F.coalesce("takeaway", F.lit(False))})
    matched = F.array_intersect("all_mechanisms", want) if requested else F.slice("all_mechanisms", 1, 4)
    rows = rows.withColumn("matched", matched).withColumn("has_matched", F.size("matched") > 0)
    whole = F.concat_ws(" ", "name", "text", F.array_join("all_mechanisms", " "), F.array_join("challenges", " "))
    scored = rows.select(
        "id", "name", "type", "domain", "matched", "challenges", "all_mechanisms", "snippets", "takeaway", F.round(F.coalesce("distance", F.lit(0.0)), 4).alias("novelty"),
        similarity(ask, whole).alias("retrieval"),
        F.greatest(similarity(ask, F.col("name")), F.coalesce("met", F.lit(0.0)), F.coalesce("evidenced", F.lit(0.0))).alias("coverage"),
        F.round(F.size("matched") / len(requested) if requested else F.least(F.lit(1.0), F.size("all_mechanisms") / 3), 4).alias("mechanism"),
        F.round(F.least(F.lit(1.0), F.col("snippets") / 2) * F.col("quality"), 4).alias("evidence"),
        F.round(F.coalesce(F.when(F.col("has_matched") & F.lit(bool(requested)), F.col("matched_support")).otherwise(F.col("all_support")), F.lit(0.0)), 4).alias("support"),
    )
    graph = F.round(0.35 * F.col("mechanism") + 0.35 * F.col("coverage") + 0.15 * F.col("evidence") + 0.15 * F.col("support"), 4)
    has_mechanism, has_story, has_snippet = F.size("matched") > 0, (F.size("challenges") > 0) | F.col("takeaway"), F.col("snippets") > 0
    place_of_type = F.col("type").isin("Method", "Problem", "Limitation", "IdeaFragment")
    complete = sum((c.cast("int") for c in (has_story, place_of_type, has_snippet)), has_mechanism.cast("int")) / 4
    motifs = F.array_compact(F.array(
        F.when((F.size("challenges") > 0) & F.col("takeaway"), F.lit("challenge-takeaway")), F.when(F.col("takeaway") & (F.col("type") == "IdeaFragment"), F.lit("takeaway-idea-transfer")),
        F.when(has_mechanism & (has_story | (F.col("type") == "IdeaFragment")), F.lit("mechanism-transfer")), F.when(has_snippet, F.lit("evidence-grounding")),
    ))
    out = scored.withColumns({"graph": graph, "complete": F.round(complete, 4), "motifs": motifs})
    return out.withColumn("combined", F.round((0.4 * F.col("retrieval") + 0.4 * F.col("graph") + 0.2 * F.col("novelty")) * F.when(F.col("coverage") > 0, 1.0).otherwise(0.65), 4))


def best_candidates(candidates: DataFrame, limit: int = 8) -> DataFrame:
    return candidates.orderBy(F.desc("combined"), F.desc("graph"), "name", "id").limit(limit)


def analogies(candidates: DataFrame, challenge: str, requested: list[str]) -> DataFrame:
    """The candidates with analogy (.4 challenge + .3 mechanisms + .2 motifs + .1 evidence) and its parts. Without a matched mechanism the requested ones count as transferable."""
    want = F.array(*[F.lit(m) for m in requested]).cast("array<string>")
    transferable = F.when(F.size("matched") > 0, F.col("matched")).otherwise(want)
    aligned = alignment(F.lit(challenge), F.concat_ws(" ", F.array_join("challenges", " "), "name"))
    shared = F.round(F.size(F.array_intersect(transferable, want)) / len(requested) if requested else F.least(F.lit(1.0), F.size(transferable) / 2), 4)
    motif, evidence = F.round(F.size("motifs") / 4, 4), F.round(F.least(F.lit(1.0), F.least(F.col("snippets"), F.lit(2)) / 2), 4)
    out = candidates.withColumns({"aligned": aligned, "shared": shared, "motif": motif})
    return out.withColumn("analogy", F.round(0.4 * F.col("aligned") + 0.3 * F.col("shared") + 0.2 * F.col("motif") + 0.1 * evidence, 4))


def _unit(c: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 4)


def interdisciplinary(analogous: DataFrame) -> DataFrame:
    """Adds grounding, story and potential (.22 novelty + .24 grounding + .22 coverage + .16 analogy + .16 story)."""
    out = analogous.withColumns({"grounding": _unit(0.55 * F.col("evidence") + 0.45 * F.col("support")), "story": _unit(0.65 * F.col("complete") + 0.35 * F.col("motif"))})
    return out.withColumn("potential", _unit(0.22 * F.col("novelty") + 0.24 * F.col("grounding") + 0.22 * F.col("coverage") + 0.16 * F.col("analogy") + 0.16 * F.col("story")))


def cross_domain(nodes: DataFrame, mechanisms: DataFrame, distances: DataFrame, target: str, challenges: list[str], least_distance: float = 0.0, limit: int = 8) -> DataFrame:
    """The best nodes of other domains: id, name, domain, shared (mechanisms that the target domain has too), distance, score, ratio, challenge.

    Score: 2 overlap with the best challenge + distance + 1 if a mechanism is shared, .25 if there is any.
    """
    in_target = nodes.where(F.col("domain") == target).join(mechanisms, "id").select("mechanism").distinct().withColumn("known", F.lit(True))
    held = mechanisms.distinct().join(in_target, "mechanism", "left").groupBy("id").agg(F.array_sort(F.collect_list("mechanism")).alias("all_mechanisms"), F.array_sort(F.collect_list(F.when(F.col("known"), F.col("mechanism")))).alias("shared"))
    empty = F.array().cast("array<string>")
    rows = nodes.where((F.col("domain") != "") & (F.col("domain") != target)).join(held, "id", "left").join(distances, "domain", "left")
    rows = rows.withColumns({"all_mechanisms": F.coalesce("all_mechanisms", empty), "shared": F.coalesce("shared", empty), "distance": F.coalesce("distance", F.lit(0.0))}).where(F.col("distance") >= least_distance)
    text = T.content_tokens(T.normalize(F.lower(F.concat_ws(" ", "name", F.array_join("all_mechanisms", " "), "domain"))))
    rows = rows.withColumn("tokens", text)
    boost = F.when(F.size("shared") > 0, 1.0).when(F.size("all_mechanisms") > 0, 0.25).otherwise(0.0)
    tried = [F.struct(F.round(2 * T.token_overlap(T.content_tokens(T.normalize(F.lit(c))), F.col("tokens")) + F.col("distance") + boost, 4).alias("score"), F.lit(-i).alias("first"), F.lit(c).alias("challenge")) for i, c in enumerate(challenges or [""])]
    best = F.greatest(*tried) if len(tried) > 1 else tried[0]
    out = rows.withColumn("best", best).select("id", "name", "type", "domain", "all_mechanisms", "shared", "distance", F.col("best.score").alias("score"), F.round(F.col("best.score") / 4, 4).alias("ratio"), F.nullif(F.col("best.challenge"), F.lit("")).alias("challenge"))
    return out.orderBy(F.desc("score"), "id").limit(limit)


def candidate_domains(bridged: DataFrame) -> DataFrame:
    """domain, score and ratio (means), bridges, mechanisms (shared ones where there are any) of bridge nodes."""
    used = F.when(F.size("shared") > 0, F.col("shared")).otherwise(F.col("all_mechanisms"))
    return bridged.groupBy("domain").agg(F.round(F.avg("score"), 4).alias("score"), F.round(F.avg("ratio"), 4).alias("ratio"), F.count("*").alias("bridges"), F.max("distance").alias("distance"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(used)))).alias("mechanisms"))


def takeaways(bridged: DataFrame, described: DataFrame, first_challenge: str) -> DataFrame:
    """A row for each bridge node: mechanism (its first by name, else its own name), explanation, formulation, rationale, challenge. described(mechanism, description)."""
    first = F.when(F.size("all_mechanisms") > 0, F.element_at("all_mechanisms", 1))
    rows = bridged.withColumn("mechanism", first).join(described, "mechanism", "left")
    explained = F.when(F.col("mechanism").isNotNull(), F.concat_ws(": ", "mechanism", F.coalesce("description", F.lit("domain-agnostic mechanism")))).otherwise(F.concat(F.col("name"), F.lit(" represents a transferable pattern from "), F.col("domain")))
    through = F.when(F.size("all_mechanisms") > 0, F.concat(F.lit(" through "), F.array_join("all_mechanisms", " and "))).otherwise("")
    formulated = F.concat(F.lit("In "), F.col("domain"), F.lit(", "), F.col("name"), F.lit(" addresses this challenge"), through, F.lit("."))
    why = F.when(F.col("challenge").isNotNull(), F.concat(F.col("name"), F.lit(' was selected because it directly matches the challenge "'), F.col("challenge"), F.lit('" in '), F.col("domain"), F.lit("."))).otherwise(F.concat(F.col("name"), F.lit(" was selected as transferable evidence from "), F.col("domain"), F.lit(".")))
    return rows.select("id", F.col("domain").alias("source_domain"), F.coalesce("mechanism", "name").alias("mechanism"), explained.alias("explanation"), formulated.alias("formulation"), why.alias("rationale"), F.coalesce("challenge", F.lit(first_challenge)).alias("challenge"))


def potential_report(domains: DataFrame, profile: DataFrame, distances: DataFrame, taken: DataFrame, target: str, limit: int = 5) -> DataFrame:
    """The best source domains by interdisciplinary potential, with its parts. domains from candidate_domains, profile(domain, bridge_weight, latent), taken from takeaways."""
    count = taken.groupBy(F.col("source_domain").alias("domain")).agg(F.least(F.count("*"), F.lit(3)).alias("takeaways"))
    known = domains.select("domain").union(profile.select("domain")).distinct().where((F.col("domain") != "") & (F.col("domain") != target))
    rows = known.join(domains.drop("distance"), "domain", "left").join(profile.select("domain", "bridge_weight", "latent"), "domain", "left").join(count, "domain", "left").join(distances, "domain", "left").fillna(0, ["score", "bridges", "bridge_weight", "latent", "takeaways", "distance"])
    total = F.greatest(F.lit(1), F.sum("latent").over(Window.partitionBy()))  # a row a domain
    rows = rows.withColumns({"overlap": F.round(F.col("latent") / total, 4), "strength": _unit(F.col("score") / 4.5), "taken": _unit(F.col("takeaways") / 3), "n_shared": F.least(F.size(F.coalesce("mechanisms", F.array().cast("array<string>"))), F.lit(8))})
    far = _unit(F.col("distance"))
    depth = _unit(0.4 * F.col("strength") + 0.35 * _unit(F.col("n_shared") / 3) + 0.25 * F.col("taken"))
    stages = _unit(0.45 * _unit(F.col("bridges") / 3) + 0.35 * F.col("taken") + 0.2 * F.col("overlap"))
    payoff = _unit(0.45 * far + 0.3 * F.col("strength") + 0.25 * F.col("taken"))
    potential = _unit(0.34 * F.col("strength") + 0.24 * far + 0.18 * _unit(F.col("bridge_weight") / 6) + 0.12 * F.col("taken") + 0.12 * F.col("overlap"))
    out = rows.withColumns({"depth": depth, "stages": stages, "payoff": payoff, "potential": potential}).withColumn("promise", _unit(0.55 * F.col("payoff") + 0.25 * F.col("depth") + 0.2 * F.col("stages")))
    return out.orderBy(F.desc("potential"), F.desc("bridge_weight"), F.desc("bridges"), "domain").limit(limit).select("domain", "potential", "depth", "stages", "payoff", "promise", "bridges", "takeaways")


def transferability(nodes: DataFrame, mechanisms: DataFrame) -> DataFrame:
    """mechanism, instances, domains, potential: high from three domains on, medium from two."""
    n = mechanisms.distinct().join(nodes.select("id", "domain"), "id").groupBy("mechanism").agg(F.count("*").alias("instances"), F.countDistinct(F.when(F.col("domain") != "", F.col("domain"))).alias("domains"))
    return n.withColumn("potential", F.when(F.col("domains") >= 3, "high").when(F.col("domains") >= 2, "medium").otherwise("low"))


def mechanism_support(nodes: DataFrame, mechanisms: DataFrame, papers: DataFrame, sample: int = 8, most_papers: int = 12) -> DataFrame:
    """mechanism, nodes, papers, domains, types, sample of nodes (by name) and of paper titles. papers(id, title)."""
    m = mechanisms.distinct().join(nodes.select("id", "name", "type", "domain"), "id")
    by_name = m.withColumn("n", F.row_number().over(Window.partitionBy("mechanism").orderBy("name", "id"))).where(F.col("n") <= sample).groupBy("mechanism").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]), ",").alias("sample"))
    titles = m.select("mechanism", "id").join(papers, "id").select("mechanism", "title").distinct()
    first = titles.withColumn("n", F.row_number().over(Window.partitionBy("mechanism").orderBy("title"))).groupBy("mechanism").agg(F.count("*").alias("papers"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") <= most_papers, F.col("title")))), "|").alias("titles"))
    sets = m.groupBy("mechanism").agg(F.count("*").alias("nodes"), F.array_join(F.array_sort(F.collect_set("domain")), "|").alias("domains"), F.array_join(F.array_sort(F.collect_set("type")), "|").alias("types"))
    return sets.join(by_name, "mechanism").join(first, "mechanism", "left").fillna({"papers": 0, "titles": ""})
