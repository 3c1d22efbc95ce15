"""Evaluation of answers, lineages and human labels; relations between candidates; gaps, costs and watch lists of material."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as T
from quillgraph.operators.corpus import reachable

#: Thresholds of a lineage benchmark, similarity of relations, words of costs.
THRESHOLDS = {"nodes": 0.7, "edges": 0.6, "paths": 0.7, "quotes": 0.9, "evidence": 0.75, "chains": 0.7}
RELATION_MATCH = 0.72
COSTS = {
    "hardware": r"(?i)\b(?:A100|H100|V100|T4|P100|RTX\s?\d{4}|GPU(?:s)?|TPU(?:s)?)\b", "runtime": r"(?i)\b\d+(?:\.\d+)?\s*(?:hours?|hrs?|days?|minutes?|mins?)\b", "epochs": r"(?i)\b\d+(?:\.\d+)?\s*epochs?\b", "batch_size": r"(?i)\bbatch\s*size\s*(?:of\s*)?\d+\b",
    "dataset_scale": r"(?i)\b\d+(?:\.\d+)?\s*(?:k|m|million|thousand)?\s*(?:images|samples|examples|instances|papers|documents)\b", "backbone": r"(?i)\b(?:ResNet-\d+|ViT-[A-Z0-9/.-]+|BERT|RoBERTa|CLIP|ConvNeXt|Swin|DINOv2)\b",
    "code_availability": r"(?i)\b(?:code\s+is\s+available|source\s+code|github\.com|available\s+at\s+https?:\/\/)\b",
}
#: What relations between candidates add to a confidence of .35, and their order.
RELATIONS = ("CONFLICTS_WITH", "PREREQUISITE", "COST_COUPLED", "COMPLEMENTS", "SUBSTITUTES", "SHARES_MECHANISM", "SHARES_FAILURE_MODE", "NOVELTY_COLLISION", "EVALUATION_COMPATIBLE")


def _ratio(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of).otherwise(0.0)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def comparable(c: Column) -> Column:
    """Decomposed lower case without punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(T.folded(F.coalesce(c, F.lit(""))), "[`*_{}\\[\\]()<>\"'“”‘’,.;:!?\\\\/-]+", " "), r"\s+", " "))


def answer_metrics(answers: DataFrame) -> DataFrame:
    """query, coverage, exact of answers(query, answer, references): share of the references' content tokens that the answer has; 1 if it equals one or holds all, null without either."""
    tokens = lambda c: T.content_tokens(T.normalize(c))
    refs = F.filter(F.transform(F.coalesce("references", F.array().cast("array<string>")), comparable), lambda r: r != "")
    wanted = F.array_distinct(F.flatten(F.transform(F.coalesce("references", F.array().cast("array<string>")), lambda r: tokens(F.coalesce(r, F.lit(""))))))
    rows = answers.select("query", comparable(F.col("answer")).alias("a"), F.array_distinct(tokens(F.coalesce("answer", F.lit("")))).alias("at"), refs.alias("r"), wanted.alias("w"))
    coverage = F.when((F.size("w") == 0) | (F.size("at") == 0), 0.0).otherwise(F.size(F.array_intersect("w", "at")) / F.size("w"))
    exact = F.when((F.col("a") == "") | (F.size("r") == 0), None).when(F.array_contains("r", F.col("a")) | F.forall("r", lambda r: F.contains(F.col("a"), r)), 1).otherwise(0)
    return rows.select("query", F.round(coverage, 6).alias("coverage"), exact.cast("int").alias("exact"))


def set_metrics(predicted: DataFrame, gold: DataFrame, by: str, item: str) -> DataFrame:
    """by, precision, recall, f1, success of sets of items (citations, labels): each counts once."""
    p, g = predicted.select(by, item).distinct(), gold.select(by, item).distinct()
    n = lambda df, name: df.groupBy(by).agg(F.count("*").alias(name))
    rows = n(p, "said").join(n(g, "wanted"), by, "full_outer").join(n(p.join(g, [by, item]), "hit"), by, "left").fillna(0)
    precision, recall = _ratio(F.col("hit"), F.col("said")), _ratio(F.col("hit"), F.col("wanted"))
    return rows.select(by, F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(_f1(precision, recall), 6).alias("f1"), ((precision == 1) & (recall == 1)).cast("int").alias("success"))


def relation_matches(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """query, place, gold, similarity of predicted(query, place, source, target, type) and gold(query, gold, source, target, type).

    Similarity: a third each of the ends' and types' token Jaccard, from .72 on. Predictions choose in order of place, each gold relation once; a prediction whose
    first choices are taken by earlier ones takes its next.
    """
    words = lambda c: F.array_distinct(T.tokens(T.normalize(F.coalesce(F.col(c), F.lit("")))))
    # a text is normalised once, not once a pair
    read = lambda df, at, *names: df.distinct().select("query", at, F.col("type").alias(names[3]), *[words(c).alias(n) for c, n in zip(("source", "target", "type"), names)])
    p, g = read(predicted, "place", "s1", "t1", "w1", "k1"), read(gold, "gold", "s2", "t2", "w2", "k2")
    # targets of a match share a token, as the other two parts are 1 at most; a pair is met at the first one that they share
    keyed = lambda df, c: df.select("*", F.explode(c).alias("key"))
    near = keyed(p, "t1").join(keyed(g, "t2"), ["query", "key"]).where(F.col("key") == F.array_min(F.array_intersect("t1", "t2")))
    kind = F.when(F.col("k1") == F.col("k2"), 1.0).otherwise(T.jaccard(F.col("w1"), F.col("w2")))
    similarity = F.round((T.jaccard(F.col("s1"), F.col("s2")) + T.jaccard(F.col("t1"), F.col("t2")) + kind) / 3, 6)
    scored = near.select("query", "place", "gold", similarity.alias("similarity")).where((F.col("similarity") >= RELATION_MATCH) & F.col("gold").isNotNull())
    choices = scored.repartition("query").groupBy("query", "place").agg(F.array_sort(F.collect_list(F.struct("gold", "similarity"))).alias("choices")).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "choices"))).alias("rows"))

    def take(acc: Column, row: Column) -> Column:
        free = F.filter(row["choices"], lambda c: ~F.exists(acc, lambda t: t["gold"] == c["gold"]))
        return F.when(F.size(free) > 0, F.array_append(acc, F.struct(row["place"].alias("place"), F.get(free, F.lit(0))["gold"].alias("gold"), F.filter(free, lambda c: c["gold"] == F.get(free, F.lit(0))["gold"]).alias("same")))).otherwise(acc)

    kinds = dict(predicted.dtypes)["place"], dict(gold.dtypes)["gold"]
    start = F.array().cast(f"array<struct<place: {kinds[0]}, gold: {kinds[1]}, same: array<struct<gold: {kinds[1]}, similarity: double>>>>")
    taken = choices.select("query", F.explode(F.aggregate("rows", start, take)).alias("t")).where("t.place is not null")
    return taken.select("query", "t.place", "t.gold", F.explode("t.same.similarity").alias("similarity"))


def agreement(labels: DataFrame) -> DataFrame:
    """pair, labels, choice, share of labels(pair, side) with left, right or tie: pairs of two labels at least, the commonest choice (the first by name on ties)."""
    n = labels.where(F.col("side").isin("left", "right", "tie")).groupBy("pair", "side").agg(F.count("*").alias("n"))
    g = n.groupBy("pair").agg(F.sum("n").alias("labels"), F.min_by("side", F.struct((-F.col("n")).alias("n"), "side")).alias("choice"), F.max("n").alias("most")).where("labels >= 2")
    return g.select("pair", "labels", "choice", F.round(F.col("most") / F.col("labels"), 4).alias("share"))


def lineage_benchmark(gold_nodes: DataFrame, gold_edges: DataFrame, chains: DataFrame, matched: DataFrame, edges: DataFrame, evidence: DataFrame, depth: int = 3) -> DataFrame:
    """metric, hits, total, value, passed of a benchmark of lineages.

    gold_nodes(gold), gold_edges(source, target) and chains(chain, place, gold) name gold nodes; matched(gold, node) the methods found for them; edges(src, dst) those that
    hold; evidence(key, quoted, whole) their pieces. An edge counts if a path of ``depth`` edges joins its ends, a step of a chain if one edge does.
    """
    to = lambda c, name: matched.select(F.col("gold").alias(c), F.col("node").alias(name))
    pairs = gold_edges.join(to("source", "s"), "source", "left").join(to("target", "t"), "target", "left")
    w = Window.partitionBy("chain").orderBy("place")
    links = chains.withColumn("next", F.lead("gold").over(w)).where("next is not null").join(to("gold", "s"), "gold", "left").join(to("next", "t"), "next", "left")
    held = lambda df, d: df.join(reachable(edges, df.select(F.col("s").alias("source"), F.col("t").alias("target")), d).select(F.col("source").alias("s"), F.col("target").alias("t"), F.lit(1).alias("ok")), ["s", "t"], "left")
    count = lambda df, hit, name: df.agg(F.coalesce(F.sum(hit), F.lit(0)).cast("double").alias("hits"), F.count("*").cast("double").alias("total")).select(F.lit(name).alias("metric"), "hits", "total")
    steps = held(links, 1).withColumn("ok", F.coalesce("ok", F.lit(0)))
    rows = [
        count(gold_nodes.join(matched, "gold", "left"), F.col("node").isNotNull().cast("int"), "nodes"), count(held(pairs, depth), F.coalesce("ok", F.lit(0)), "edges"), count(steps, F.col("ok"), "paths"),
        count(steps.groupBy("chain").agg(F.avg("ok").alias("ok")), F.col("ok"), "chains"), count(evidence.groupBy("key").agg(F.max(F.col("quoted").cast("int")).alias("ok")), F.col("ok"), "quotes"), count(evidence.groupBy("key").agg(F.max(F.col("whole").cast("int")).alias("ok")), F.col("ok"), "evidence"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    least = F.element_at(F.create_map(*[x for k, v in THRESHOLDS.items() for x in (F.lit(k), F.lit(v))]), F.col("metric"))
    value = F.round(F.when(F.col("total") > 0, F.col("hits") / F.col("total")), 4)
    return out.select("metric", F.round("hits", 4).alias("hits"), "total", value.alias("value"), F.coalesce(value >= least, F.lit(False)).alias("passed"))


def candidate_relations(candidates: DataFrame, per_block: int = 24, most: int = 40) -> DataFrame:
    """a, b, types, confidence of candidates(id, subproblem, mechanism, terms, papers, failures, metrics, costs), the surest first.

    Pairs share a block (subproblem, paper, term, failure, metric or cost); a block gives its first pairs by id, as the operator defines, and ``most`` relations come out.
    """
    empty = F.array().cast("array<string>")
    c = candidates.withColumns({k: F.coalesce(k, empty) for k in ("terms", "papers", "failures", "metrics", "costs")})
    tagged = lambda k, tag: F.transform(F.array_distinct(F.col(k)), lambda x: F.concat(F.lit(f"{tag}:"), x))
    blocks = F.concat(F.when(F.coalesce("subproblem", F.lit("")) != "", F.array(F.concat(F.lit("subproblem:"), "subproblem"))).otherwise(empty), tagged("papers", "paper"), tagged("terms", "mechanism"), tagged("failures", "failure"), tagged("metrics", "metric"), tagged("costs", "cost"))
    # a block's first pairs by (a, b) lie among its first ``per_block`` + 1 ids, so longer blocks are cut before the join
    keyed = c.select("id", F.explode(F.array_distinct(blocks)).alias("block")).withColumn("n", F.row_number().over(Window.partitionBy("block").orderBy("id"))).where(F.col("n") <= per_block + 1)
    x, y = keyed.select("block", F.col("id").alias("a")), keyed.select("block", F.col("id").alias("b"))
    first = x.join(y, "block").where("a < b").withColumn("n", F.row_number().over(Window.partitionBy("block").orderBy("a", "b"))).where(F.col("n") <= per_block)
    side = lambda s: c.select(F.col("id").alias(s), *[F.col(k).alias(f"{k}_{s}") for k in ("subproblem", "mechanism", "terms", "papers", "failures", "metrics", "costs")])
    p = first.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    share = lambda k: F.size(F.array_intersect(f"{k}_a", f"{k}_b"))
    same = lambda k: (F.coalesce(f"{k}_a", F.lit("")) != "") & (F.col(f"{k}_a") == F.col(f"{k}_b"))
    p = p.withColumns({"sub": F.coalesce(same("subproblem"), F.lit(False)), "mech": F.coalesce(same("mechanism"), F.lit(False)), **{f"n_{k}": share(k) for k in ("terms", "papers", "failures", "metrics", "costs")}})
    sub, mech, terms, papers, failures, metrics, costs = (F.col("sub"), F.col("mech"), *(F.col(f"n_{k}") > 0 for k in ("terms", "papers", "failures", "metrics", "costs")))
    holds = {
        "COST_COUPLED": costs, "SUBSTITUTES": sub, "COMPLEMENTS": ~sub & (mech | terms | papers | failures | metrics), "SHARES_MECHANISM": mech | terms | papers,
        "NOVELTY_COLLISION": sub & (mech | papers | (F.col("n_terms") >= 2)), "SHARES_FAILURE_MODE": failures, "EVALUATION_COMPATIBLE": metrics,
    }
    types = F.array_join(F.array_compact(F.array(*[F.when(holds[r], F.lit(r)) for r in RELATIONS if r in holds])), ",")
    confidence = 0.35 + sum((F.when(c, v).otherwise(0.0) for c, v in ((costs, 0.08), (sub, 0.12), (mech, 0.18), (papers, 0.12), (terms, 0.1), (failures, 0.08), (metrics, 0.08))), F.lit(0.0))
    out = p.select("a", "b", types.alias("types"), F.round(F.least(F.lit(0.95), confidence), 3).alias("confidence")).where("types <> ''")
    return out.orderBy(F.desc("confidence"), "a", "b").limit(most)


def cost_signals(texts: DataFrame) -> DataFrame:
    """paper, signal, n, status, first of texts(paper, text): mentions of hardware, run time, epochs, batch size, scale, backbone and code."""
    text = F.coalesce("text", F.lit(""))
    hits = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), F.regexp_extract_all(text, F.lit(f"({p})"), 1).alias("hits")) for k, p in COSTS.items()])).alias("h")
    rows = texts.select("paper", "place", hits).select("paper", "place", "h.signal", F.size("h.hits").alias("n"), F.get("h.hits", F.lit(0)).alias("first"))
    out = rows.groupBy("paper", "signal").agg(F.sum("n").alias("n"), F.min_by("first", F.when(F.col("n") > 0, F.col("place"))).alias("first"))
    return out.select("paper", "signal", "n", F.when(F.col("n") > 0, "reported").otherwise("not_reported").alias("status"), "first")


def gap_map(items: DataFrame, most: int = 12) -> DataFrame:
    """pack, place, type, statement, paper of items(pack, place, paper, text, kind, name): limitations and claims that the items of a pack name, each once, the first twelve.

    A limitation is a gap (an assumption's name makes it a risk), a claim needs evidence; an item without either gives its text to verify.
    """
    kind = F.when(F.col("kind").isin("Limitation", "Assumption", "Challenge"), F.when(F.contains(F.lower("name"), F.lit("assum")), "assumption_risk").otherwise("limitation")).when(F.col("kind").isin("Claim", "Finding"), "evidence_verification_needed").otherwise("source_verification_needed")
    statement = F.when(F.col("kind").isin("Claim", "Finding"), F.concat(F.lit("Evidence boundary for claim: "), "name")).when(F.col("kind").isNotNull(), F.col("name")).otherwise(F.substring(F.coalesce("text", F.lit("")), 1, 420))
    rows = items.withColumns({"type": kind, "statement": statement}).where("statement <> ''").withColumn("key", T.normalize(F.col("statement")))
    first = rows.groupBy("pack", "type", "key", "paper").agg(F.min(F.struct("place", "name", "statement")).alias("f"))
    order = Window.partitionBy("pack").orderBy("f.place", F.when(F.col("type") == "evidence_verification_needed", 1).otherwise(0), "f.name", "paper")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("pack", "place", "type", F.substring("f.statement", 1, 320).alias("statement"), "paper")


def requisitions(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """key, role, priority, requests of wanted(key, role, hits): papers that present(key) lacks, once each. P0 for targets, P1 for near sources and from three hits on, else P2."""
    rows = wanted.join(present.select("key"), "key", "left_anti").groupBy("key").agg(F.min_by("role", F.when(F.col("role") == "target_prior", 0).when(F.col("role") == "near_source_method", 1).otherwise(2)).alias("role"), F.max("hits").alias("hits"), F.count("*").alias("requests"))
    priority = F.when(F.col("role") == "target_prior", "P0").when((F.col("role") == "near_source_method") | (F.col("hits") >= 3), "P1").otherwise("P2")
    return rows.select("key", "role", priority.alias("priority"), "requests")


def regression_watchlist(steps: DataFrame, candidate: str = "", most: int = 16) -> DataFrame:
    """place, capability, step, ancestor, status of steps(lineage, place, node, bottleneck): what each step of a backward lineage mended, once for each step, the first sixteen.

    The candidate's words decide whether it mentions the capability; without one it is still to be named.
    """
    w = Window.partitionBy("lineage").orderBy("place")
    rows = steps.withColumn("ancestor", F.lead("node").over(w)).where("ancestor is not null").withColumn("key", T.normalize(F.coalesce("bottleneck", F.lit("")))).where("key not in ('', 'bottleneck')")
    first = rows.groupBy("key", "node").agg(F.min(F.struct("lineage", "place", "bottleneck", "ancestor")).alias("f"))
    said = T.normalize(F.lit(candidate))
    mentions = F.exists(F.split("key", " "), lambda t: (F.length(t) > 2) & F.contains(said, t))
    status = F.lit("requires_candidate_mechanism") if not candidate.strip() else F.when(mentions, "candidate_mentions_protected_capability").otherwise("counterfactual_not_yet_tested")
    order = ["f.lineage", "f.place", "node"]
    out = first.orderBy(*order).limit(most).withColumn("n", F.row_number().over(Window.orderBy(*order)))
    return out.select(F.col("n").alias("place"), F.col("f.bottleneck").alias("capability"), F.col("node").alias("step"), F.col("f.ancestor").alias("ancestor"), status.alias("status"))
