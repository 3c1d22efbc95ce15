"""Selection and preference: MMR, submodular, DPP, Bradley-Terry, posteriors, bandit arms.

Greedy selections are sequential in k, which is small; each step is one distributed arg max over the candidates, whose similarity to what
is chosen so far is kept as a column, so nothing but the chosen rows reaches the driver. Ties go to the higher utility, then the smaller id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import jaccard

LAMBDA = 0.65  #: Fixed value.


def _similarity(chosen: dict, sets: list[str]) -> Column:
    """Largest Jaccard over the set columns to a chosen row."""
    sims = [jaccard(F.array_distinct(F.col(c)), F.array(*[F.lit(x) for x in sorted(set(chosen[c]))]) if chosen[c] else F.array().cast("array<string>")) for c in sets]
    return F.greatest(*sims, F.lit(0.0))


def _covered(chosen: list[dict], column: str) -> Column:
    seen = sorted({x for c in chosen for x in c[column]})
    return F.size(F.array_except(column, F.array(*[F.lit(x) for x in seen]))) if seen else F.size(F.array_distinct(column))


def coverage(chosen: list[dict], weights: dict[str, float]) -> Column:
    """Weighted number of new values (three at most in each column), a third at most 1."""
    gain = reduce(lambda a, b: a + b, [w * F.least(F.lit(3), _covered(chosen, c)) for c, w in weights.items()])
    return F.least(F.lit(1.0), gain / 3)


def greedy(candidates: DataFrame, k: int, gain, key: str = "id", utility: str = "utility") -> list[dict]:
    """k rows by the largest ``gain(chosen)`` at each step, where gain gives a Column."""
    chosen: list[dict] = []
    for _ in range(k):
        rest = candidates.where(~F.col(key).isin([c[key] for c in chosen])) if chosen else candidates
        best = rest.withColumn("gain", F.round(gain(chosen), 10)).orderBy(F.desc("gain"), F.desc(utility), key).first()
        if best is None or best["gain"] == -np.inf:
            break
        chosen.append(best.asDict())
    return chosen


def mmr(candidates: DataFrame, k: int, sets: list[str], key: str = "id", utility: str = "utility", lam: float = LAMBDA) -> list[dict]:
    """lam * utility - (1 - lam) * largest similarity to what is chosen."""
    return greedy(candidates, k, lambda chosen: lam * F.col(utility) - (1 - lam) * (F.greatest(F.lit(0.0), *[_similarity(c, sets) for c in chosen]) if chosen else F.lit(0.0)), key, utility)


def submodular(candidates: DataFrame, k: int, sets: list[str], weights: dict[str, float], key: str = "id", utility: str = "utility") -> list[dict]:
    """.65 utility + .35 coverage - .15 largest similarity."""
    return greedy(candidates, k, lambda chosen: 0.65 * F.col(utility) + 0.35 * coverage(chosen, weights) - 0.15 * (F.greatest(F.lit(0.0), *[_similarity(c, sets) for c in chosen]) if chosen else F.lit(0.0)), key, utility)


def determinantal(candidates: DataFrame, k: int, tokens: str, key: str = "id", utility: str = "utility") -> list[dict]:
    """Greedy log-determinant gain over all candidates: quality times token cosine, with a small ridge.

    The gain of a candidate is the log of its Schur complement in the kernel of the chosen rows, of which there are k at most: one
    forward substitution with their Cholesky factor, as columns.
    """
    quality = F.greatest(F.lit(0.05), F.coalesce(F.col(utility), F.lit(0.0)))
    own = F.array_distinct(F.coalesce(F.col(tokens), F.array().cast("array<string>")))

    def cosine(sets: list[set], i: int) -> Column:
        seen = F.array(*[F.lit(x) for x in sorted(sets[i])]) if sets[i] else F.array().cast("array<string>")
        size = F.size(own) * F.lit(len(sets[i]))
        return F.when(size > 0, F.size(F.array_intersect(own, seen)) / F.sqrt(size)).otherwise(0.0)

    def gain(chosen: list[dict]) -> Column:
        q = [max(0.05, c[utility] or 0.0) for c in chosen]
        sets = [set(c[tokens] or []) for c in chosen]
        cos = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b)) if a and b else 0.0
        m = np.array([[q[i] * q[j] * (cos(sets[i], sets[j]) if i != j else 1.0) for j in range(len(q))] for i in range(len(q))]).reshape(len(q), len(q))
        factor = np.linalg.cholesky(m + (1e-6 + 1e-8) * np.eye(len(q))) if chosen else m
        rest = quality * quality + F.lit(1e-6 + 1e-8)
        if chosen:
            kernel = F.array(*[quality * F.lit(q[i]) * cosine(sets, i) for i in range(len(q))])
            inverse = np.linalg.inv(factor)
            for row in inverse:
                y = F.aggregate(F.zip_with(kernel, F.array(*[F.lit(float(x)) for x in row]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
                rest = rest - y * y
        return F.when(rest > 0, F.ln(rest)).otherwise(F.lit(float("-inf")))

    return greedy(candidates, k, gain, key, utility)


def dpp(candidates: list[dict], k: int, tokens: str, key: str = "id", utility: str = "utility") -> list[dict]:
    """The selection of ``determinantal`` by determinants of rows on the driver."""

    def kernel(x: dict, y: dict) -> float:
        q = max(0.05, x[utility]) * max(0.05, y[utility])
        if x[key] == y[key]:
            return q + 1e-6
        a, b = set(x[tokens]), set(y[tokens])
        return q * len(a & b) / np.sqrt(len(a) * len(b)) if a and b else 0.0

    def log_det(rows: list[dict]) -> float:
        m = np.array([[kernel(x, y) for y in rows] for x in rows]) + 1e-8 * np.eye(len(rows))
        sign, value = np.linalg.slogdet(m)
        return value if sign > 0 else -np.inf

    rest = sorted(candidates, key=lambda c: (-c[utility], c[key]))
    chosen = rest[:1]
    rest = rest[1:]
    while rest and len(chosen) < k:
        now = log_det(chosen)
        gains = [(log_det([*chosen, c]) - now, c) for c in rest]
        best = max(g for g, _ in gains)
        if not np.isfinite(best):
            break
        pick = min((c for g, c in gains if g == best), key=lambda c: (-c[utility], c[key]))
        chosen.append(pick)
        rest.remove(pick)
    return chosen


def bradley_terry(decisions: DataFrame, rounds: int = 30, prior: float = 0.5) -> DataFrame:
    """id, ability (mean 1) and score in [.25, .75] from decisions(winner, loser, tie, weight), by minorise-maximise steps.

    Decisions are first added up by pair; each step joins the pair weights with the abilities and adds up by candidate, with a lineage cut.
    """
    from quillgraph.runtime import cut

    d = decisions.select("winner", "loser", "tie", "weight")
    part = lambda c, won: d.select(F.col(c).alias("id"), F.when(F.col("tie"), F.col("weight") / 2).otherwise(won).alias("won"))
    wins = cut(part("winner", F.col("weight")).unionByName(part("loser", F.lit(0.0))).groupBy("id").agg(F.sum("won").alias("won")), "bt-wins")
    pairs = d.select(F.least("winner", "loser").alias("x"), F.greatest("winner", "loser").alias("y"), "weight").groupBy("x", "y").agg(F.sum("weight").alias("w"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("id"), F.col("y").alias("other")), F.struct(F.col("y").alias("id"), F.col("x").alias("other")))).alias("p"), "w").select("p.id", "p.other", "w")
    both = cut(both, "bt-pairs")
    ability = wins.select("id", F.lit(1.0).alias("a"))
    for _ in range(rounds):
        terms = both.join(ability, "id").join(ability.select(F.col("id").alias("other"), F.col("a").alias("ao")), "other").groupBy("id").agg(F.sum(F.col("w") / (F.col("a") + F.col("ao"))).alias("s"))
        fresh = cut(wins.join(terms, "id").select("id", ((prior + F.col("won")) / (prior + F.col("s"))).alias("a")), "bt-step")
        ability = fresh.withColumn("a", F.col("a") / F.lit(fresh.agg(F.avg("a")).first()[0]))
    low, high = ability.agg(F.min("a"), F.max("a")).first()
    score = F.lit(0.5) if low is None or high <= low else 0.25 + 0.5 * (F.col("a") - F.lit(low)) / F.lit(high - low)
    return ability.select("id", F.round("a", 4).alias("ability"), F.round(score, 3).alias("score"))


def beta_posterior(decisions: DataFrame) -> DataFrame:
    """id, mean, variance, bonus of each candidate: prior 1 and 1, weights at least .05, half for ties; bonus at most .25."""
    w = F.greatest(F.lit(0.05), F.col("weight"))
    half = F.when(F.col("tie"), w / 2)
    rows = decisions.select(F.col("winner").alias("id"), F.coalesce(half, w).alias("a"), F.coalesce(half, F.lit(0.0)).alias("b")).unionByName(decisions.select(F.col("loser").alias("id"), F.coalesce(half, F.lit(0.0)).alias("a"), F.coalesce(half, w).alias("b")))
    s = rows.groupBy("id").agg((1 + F.sum("a")).alias("a"), (1 + F.sum("b")).alias("b"))
    total = F.col("a") + F.col("b")
    variance = F.col("a") * F.col("b") / (total * total * (total + 1))
    return s.select("id", (F.col("a") / total).alias("mean"), variance.alias("variance"), F.least(F.lit(0.25), F.sqrt(variance) * F.ln(2 + total) / 2).alias("bonus"))


def bandit_arms(pulls: DataFrame, arm: str, reward: str, total: int) -> DataFrame:
    """Per arm: pulls, successes (from .55), mean, UCB index and Thompson mean."""
    g = pulls.groupBy(arm).agg(F.count("*").alias("pulls"), F.sum((F.col(reward) >= 0.55).cast("int")).alias("successes"), F.avg(reward).alias("mean"))
    return g.select(arm, "pulls", "successes", F.round("mean", 6).alias("mean"), F.round(F.col("mean") + F.sqrt(2 * F.ln(F.lit(max(2, total))) / F.col("pulls")), 6).alias("ucb"), F.round((F.col("successes") + 1) / (F.col("pulls") + 2), 6).alias("thompson"))
