"""Ideas for research from limitations, problems and claims, by templates with one weighted score.

The best method of a seed is found without pairing every seed with every method: a method that shares no word with the seed's name is scored by itself alone,
so the best of those is one row, and the others meet the seed by a shared word, once for each set of words. Ties go to the smaller id; null names count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T

#: Weights of relevance, novelty, feasibility, evidence, risk and cost; names whose methods cost more to try.
WEIGHTS = (1.4, 1.3, 1.1, 1.2, -0.9, -0.6)
COSTLY, COSTLY_TRANSFER = r"(?i)\b(graph|retrieval|large|planning)\b", r"(?i)\b(graph|retrieval|planning)\b"


def idea_score(*dimensions: Column) -> Column:
    return F.round(sum((w * d for w, d in zip(WEIGHTS, dimensions)), F.lit(0.0)) + 1e-9, 2)


def _five(c: Column) -> Column:
    return F.least(F.lit(5.0), c)


def _tokens(c: str) -> Column:
    return F.array_sort(F.array_distinct(T.content_tokens(T.normalize(F.coalesce(c, F.lit(""))))))


def best_methods(seeds: DataFrame, methods: DataFrame) -> DataFrame:
    """seed, method, score of seeds(seed, name) and methods(method, name, base): the method with the largest base plus the names' Jaccard."""
    s = seeds.select("seed", _tokens("name").alias("words"))
    m = methods.select("method", _tokens("name").alias("words"), F.col("base").cast("double").alias("base"))
    order = lambda score, method: F.struct(score, (-F.col(method)).alias("first"))
    kinds = m.groupBy("words").agg(F.max(order(F.col("base"), "method")).alias("top")).select("words", "top.base", (-F.col("top.first")).alias("method"))
    asked = s.select("words").distinct()
    words = lambda df, c: df.select(F.col("words").alias(c), F.explode("words").alias("word"))
    met = words(asked, "mine").join(words(kinds, "theirs"), "word").groupBy("mine", "theirs").agg(F.count("*").alias("n"))
    score = F.col("base") + F.col("n") / (F.size("mine") + F.size("theirs") - F.col("n"))
    near = met.join(kinds.withColumnRenamed("words", "theirs"), "theirs").groupBy("mine").agg(F.max(order(score, "method")).alias("near")).withColumnRenamed("mine", "words")
    top = m.agg(F.max(order(F.col("base"), "method")).alias("far")).where("far is not null").withColumn("one", F.lit(1))  # one row
    both = s.join(near, "words", "left").withColumn("one", F.lit(1)).join(F.broadcast(top), "one")
    best = both.select("seed", F.greatest("near", F.col("far").cast(both.schema["near"].dataType)).alias("b"))
    return best.select("seed", (-F.col("b.first")).alias("method"), F.col("b").getField(both.schema["near"].dataType.fieldNames()[0]).alias("score"))


def limitation_ideas(limitations: DataFrame, remedies: DataFrame, methods: DataFrame) -> DataFrame:
    """template, seed, method, total: limitations(seed, name, papers) with the best of their remedies(seed, method), or of all methods where none is among them.

    methods(method, name, uses, problems) are those that are not in use yet. Score: twice the problems, the uses, and the names' Jaccard.
    """
    base = methods.withColumn("base", F.col("problems") * 2 + F.col("uses"))
    own = remedies.distinct().join(base.withColumn("theirs", _tokens("name")), "method").join(limitations.select("seed", _tokens("name").alias("words")), "seed")
    score = F.col("base").cast("double") + T.jaccard(F.col("words"), F.col("theirs"))
    first = own.groupBy("seed").agg(F.max(F.struct(score.alias("score"), (-F.col("method")).alias("first"))).alias("b")).select("seed", (-F.col("b.first")).alias("method"), F.col("b.score").alias("score"))
    rest = best_methods(limitations.join(first.select("seed"), "seed", "left_anti"), base)
    rows = first.unionByName(rest).join(limitations.select("seed", "papers"), "seed").join(methods.select("method", "name", "uses"), "method")
    uses = F.col("uses")
    risk, cost = 1.7 + F.when(uses < 2, 1.2).otherwise(0.4), F.when(F.coalesce("name", F.lit("")).rlike(COSTLY), 2.2).otherwise(1.5)
    total = idea_score(_five(2.4 + F.col("score")), F.lit(4.2), _five(2 + uses * 0.8), _five(1.6 + F.col("papers") * 0.7 + uses * 0.5), risk, cost)
    return rows.select(F.lit("limitation_reversal").alias("template"), "seed", "method", total.alias("total"))


def transfer_ideas(problems: DataFrame, methods: DataFrame) -> DataFrame:
    """template, seed, method, total: problems(seed, name) with the method that has most problems and uses, and a like name."""
    best = best_methods(problems, methods.withColumn("base", F.col("problems") + F.col("uses")))
    rows, uses = best.join(methods.select("method", "name", "uses"), "method"), F.col("uses")
    cost = F.when(F.coalesce("name", F.lit("")).rlike(COSTLY_TRANSFER), 2.2).otherwise(1.6)
    total = idea_score(_five(2 + F.col("score") * 0.8), F.lit(4.3), _five(2.2 + uses * 0.6), _five(1.8 + uses * 0.8), F.lit(2.1), cost)
    return rows.select(F.lit("cross_problem_transfer").alias("template"), "seed", "method", total.alias("total"))


def evidence_ideas(claims: DataFrame) -> DataFrame:
    """template, seed, total of claims(seed, evidence, datasets, metrics) that lack two pieces of evidence, a data set or a metric."""
    n, d = F.col("evidence"), F.col("datasets")
    thin = claims.where("not (evidence >= 2 and datasets >= 1 and metrics >= 1)")
    total = idea_score(F.lit(4.2), F.lit(3.3), F.lit(4.1), F.greatest(F.lit(1.2), 3.8 - n * 0.9), 1.5 + F.when(n > 0, 0.4).otherwise(1.1), 1.7 + F.when(d == 0, 0.8).otherwise(0.2))
    return thin.select(F.lit("evidence_gap").alias("template"), "seed", total.alias("total"))


def coverage_ideas(problems: DataFrame, suggested: bool) -> DataFrame:
    """template, seed, total of problems(seed, methods) with two methods at most; ``suggested`` if there is a method to try."""
    novelty, feasibility, risk, cost = (4.0, 3.4, 2.1, 2.1) if suggested else (3.2, 4.0, 1.7, 1.4)
    total = idea_score(F.lit(4.1), F.lit(novelty), F.lit(feasibility), F.greatest(F.lit(1.8), 4.2 - F.col("methods") * 0.8), F.lit(risk), F.lit(cost))
    return problems.where("methods <= 2").select(F.lit("problem_method_gap").alias("template"), "seed", total.alias("total"))
