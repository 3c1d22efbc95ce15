"""Metrics of replayed cases, their lift over a baseline, and what an ablation changes.

A metric that a case has nothing for is null and does not count in its score. Null flags count as false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the papers of an answer that count for recall.
CUTOFF = 20
METRICS = ("recall", "novelty", "grounding", "traceability", "leakless")


def replay_metrics(cases: DataFrame, cited: DataFrame, gold: DataFrame, claims: DataFrame, beats: DataFrame, certificates: DataFrame, gold_certificates: DataFrame, cutoff: int = CUTOFF) -> DataFrame:
    """case, system, the five METRICS and score (their mean) of cases(case, system, last_year).

    recall: gold(case, paper) among the first ``cutoff`` of cited(case, system, place, paper, year). novelty: mean agreement of certificates(case, system,
    dimension, score) with gold_certificates(case, dimension, score), the mean score where none is known. grounding: the share of claims(case, system,
    claim, spanned) with a source span. traceability: the share of beats(case, system, beat, refs) with references. leakless: 1 if no cited paper is later than last_year.
    """
    on = ["case", "system"]
    papers = gold.select("case", "paper").distinct()
    wanted = papers.groupBy("case").agg(F.count("*").alias("wanted"))
    top = cited.where(F.col("place") <= cutoff).select(*on, "paper").distinct()
    hits = top.join(papers, ["case", "paper"]).groupBy(*on).agg(F.count("*").alias("hits"))
    bound = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    known = gold_certificates.select("case", "dimension", bound(F.col("score")).alias("truth"))
    both = certificates.where("score is not null").withColumn("score", bound(F.col("score"))).join(known, ["case", "dimension"], "left")
    novelty = both.groupBy(*on).agg(F.coalesce(F.avg(1 - F.abs(F.col("score") - F.col("truth"))), F.avg("score")).alias("novelty"))
    share = lambda df, c, name: df.groupBy(*on).agg((F.count_if(F.coalesce(c, F.lit(False))) / F.count("*")).alias(name))
    grounding, tracing = share(claims, F.col("spanned"), "grounding"), share(beats, F.size("refs") > 0, "traceability")
    late = cited.join(cases.select(*on, "last_year"), on).where("year > last_year").groupBy(*on).agg(F.count("*").alias("late"))
    rows = reduce(lambda a, b: a.join(b, on, "left"), (hits, novelty, grounding, tracing, late), cases.join(wanted, "case", "left"))
    rows = rows.withColumns({"recall": F.when(F.col("wanted").isNotNull(), F.coalesce("hits", F.lit(0)) / F.col("wanted")), "leakless": F.when(F.col("last_year").isNotNull(), F.when(F.col("late") > 0, 0.0).otherwise(1.0))})
    values = F.array_compact(F.array(*METRICS))
    mean = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))
    return rows.select(*on, *[_rounded(F.col(m)).alias(m) for m in METRICS], _rounded(mean).alias("score"))


def _rounded(c: Column) -> Column:
    return F.round(c + 1e-9, 4)


def replay_lift(metrics: DataFrame, candidate: str = "candidate", baseline: str = "baseline") -> DataFrame:
    """metric, candidate, baseline (means) and lift: the mean difference over the cases that have both."""
    names = [*METRICS, "score"]
    long = metrics.select("case", "system", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])).alias("m")).select("case", "system", "m.*")
    pick = lambda s: F.max(F.when(F.col("system") == s, F.col("value")))
    pairs = long.groupBy("case", "metric").agg(pick(candidate).alias("c"), pick(baseline).alias("b"))
    return pairs.groupBy("metric").agg(_rounded(F.avg("c")).alias("candidate"), _rounded(F.avg("b")).alias("baseline"), F.round(F.avg(F.col("c") - F.col("b")), 4).alias("lift"))


def ablation_deltas(reports: DataFrame, control: str = "full") -> DataFrame:
    """ablation, metric, value, delta of reports(ablation, metric, value): the difference from the control's value, null where either is missing."""
    base = reports.where(F.col("ablation") == control).select("metric", F.col("value").alias("base"))
    return reports.where(F.col("ablation") != control).join(base, "metric", "left").select("ablation", "metric", "value", F.round(F.col("value") - F.col("base"), 6).alias("delta"))
