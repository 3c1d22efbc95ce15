"""The batch that a controller selects, how selectors differ, and a beam search over hits.

candidates(id, utility, hard_gate, subproblem, mechanism, source_domain, aspect, cluster, tokens, mechanisms, bridges, aspects): a selection is
sequential in k, which is small; each step is one distributed arg max, and nothing but the chosen rows reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.text import jaccard

#: Weight of utility, bonuses for what is not covered yet, weights of relations with what is chosen, their bounds.
BASE = 0.62
COVERAGE = {"subproblem": 0.16, "mechanism": 0.08, "source_domain": 0.06, "aspect": 0.05, "cluster": 0.05}
POSITIVE = {"COMPLEMENTS": 0.08, "PREREQUISITE": 0.05, "EVALUATION_COMPATIBLE": 0.05, "SHARES_MECHANISM": 0.03, "SHARES_FAILURE_MODE": 0.02}
NEGATIVE = {"CONFLICTS_WITH": 0.18, "NOVELTY_COLLISION": 0.12, "SUBSTITUTES": 0.08, "COST_COUPLED": 0.05}
MOST_POSITIVE, MOST_NEGATIVE, LAMBDA = 0.16, 0.24, 0.68


def eligible(candidates: DataFrame) -> DataFrame:
    return candidates.where(~F.coalesce("hard_gate", F.lit(False)))


def _best(rows: DataFrame, value: Column) -> dict | None:
    row = rows.withColumn("gain", F.round(value, 3)).orderBy(F.desc("gain"), F.desc("utility"), "id").first()
    return None if row is None else row.asDict()


def _relation_effect(edges: DataFrame, chosen: list[str]) -> DataFrame:
    """id, relation: bounded bonuses less bounded penalties of edges(a, b, type, confidence) between an id and the chosen ones."""
    both = edges.select("a", "b", "type", "confidence").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "type", "confidence"))
    near = both.where(F.col("b").isin(chosen))
    weight = lambda w: F.coalesce(F.sum(F.element_at(F.create_map(*[x for k, v in w.items() for x in (F.lit(k), F.lit(v))]), F.col("type")) * F.coalesce("confidence", F.lit(0.5))), F.lit(0.0))
    effect = F.least(F.lit(MOST_POSITIVE), weight(POSITIVE)) - F.least(F.lit(MOST_NEGATIVE), weight(NEGATIVE))
    return near.groupBy(F.col("a").alias("id")).agg(effect.alias("relation"))


def greedy_batch(candidates: DataFrame, edges: DataFrame, k: int = 3) -> list[dict]:
    """k candidates by .62 utility + bonuses for new subproblem, mechanism, domain, aspect and cluster + relations with what is chosen."""
    rows, chosen = eligible(candidates), []
    for _ in range(k):
        rest, value = rows, BASE * F.col("utility")
        if chosen:
            ids = [c["id"] for c in chosen]
            rest = rows.where(~F.col("id").isin(ids)).join(_relation_effect(edges, ids), "id", "left")
            value = value + F.coalesce("relation", F.lit(0.0))
        for column, bonus in COVERAGE.items():
            seen = sorted({c[column] for c in chosen if c[column]})
            new = (F.coalesce(F.col(column), F.lit("")) != "") & (~F.col(column).isin(seen) if seen else F.lit(True))
            value = value + F.when(new, bonus).otherwise(0.0)
        best = _best(rest, value)
        if best is None:
            break
        chosen.append(best)
    return chosen


def similarity(chosen: dict) -> Column:
    """Of a row to a chosen one: .35 text + .2 same domain + .2 mechanisms + .15 bridges + .1 aspects."""
    sets = lambda c: jaccard(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))), F.array(*[F.lit(x) for x in sorted(set(chosen[c] or []))]).cast("array<string>"))
    same = F.when((F.coalesce("source_domain", F.lit("")) != "") & (F.col("source_domain") == F.lit(chosen["source_domain"])), 1.0).otherwise(0.0)
    return F.round(0.35 * sets("tokens") + 0.2 * same + 0.2 * sets("mechanisms") + 0.15 * sets("bridges") + 0.1 * sets("aspects"), 3)


def mmr_batch(candidates: DataFrame, k: int = 3, lam: float = LAMBDA) -> list[dict]:
    """k candidates by lam * utility less (1 - lam) times the largest similarity to a chosen one."""
    rows, chosen = eligible(candidates), []
    for _ in range(k):
        rest = rows.where(~F.col("id").isin([c["id"] for c in chosen])) if chosen else rows
        nearest = F.greatest(F.lit(0.0), *[similarity(c) for c in chosen]) if chosen else F.lit(0.0)
        best = _best(rest, lam * F.col("utility") - (1 - lam) * nearest)
        if best is None:
            break
        chosen.append(best)
    return chosen


def top_batch(candidates: DataFrame, k: int = 3) -> list[dict]:
    return [r.asDict() for r in eligible(candidates).orderBy(F.desc("utility"), "id").limit(k).collect()]


def selector_ablation(candidates: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """selector, place, id, utility, shared: each selector's batch, and how many selectors chose the candidate."""
    batches = {"topk": top_batch(candidates, k), "mmr": mmr_batch(candidates, k), "greedy": greedy_batch(candidates, edges, k)}
    rows = [(name, i, str(c["id"]), float(c["utility"])) for name, batch in batches.items() for i, c in enumerate(batch, 1)]  # 3 k rows
    out = candidates.sparkSession.createDataFrame(rows, "selector string, place int, id string, utility double")
    return out.withColumn("shared", F.count("*").over(Window.partitionBy("id")))


def beam_search(hits: DataFrame, width: int = 4) -> DataFrame:
    """subproblem, id, outcome of hits(subproblem, query, place, id, scope), in the order of query and place.

    Papers are kept in the order they first appear, ``width`` of them; other hits are pruned: no paper, a paper that is kept already, or beyond the beam.
    """
    papers = hits.where("scope = 'paper'")
    first = papers.groupBy("subproblem", "id").agg(F.min(F.struct("query", "place")).alias("first"))
    kept = first.withColumn("n", F.row_number().over(Window.partitionBy("subproblem").orderBy("first.query", "first.place", "id"))).where(F.col("n") <= width)
    rows = hits.join(kept.select("subproblem", "id", "first"), ["subproblem", "id"], "left")
    is_first = (F.col("query") == F.col("first.query")) & (F.col("place") == F.col("first.place"))
    outcome = F.when(F.col("scope") != "paper", "non_paper_scope").when(F.col("first").isNull(), "beam_width_limit").when(is_first, "kept").otherwise("duplicate_paper")
    return rows.select("subproblem", "query", "place", "id", outcome.alias("outcome"))
