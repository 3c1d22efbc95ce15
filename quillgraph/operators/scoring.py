"""Scores of candidates from columns that describe them: discovery, controller utility, admission of records, matches of patterns.

Every function adds columns to a table; null numbers count as 0, null texts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T

#: Families of queries whose hits count for more.
FAMILIES = r"related_work|synonym|terminology|review|artifact|acronym"


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def discovery_score(candidates: DataFrame, topic: str, evidence: list[tuple[str, str]], preferred: list[str], this_year: int) -> DataFrame:
    """Adds score to candidates(title, abstract, providers, citations, year, open_access, packs). evidence: (query, family) of the searches.

    The better of topic and best search (title share + half the abstract's, .15 for some families), providers .08 each to .3, citations
    log10(n + 1) / 20 to .3, .12 for the last two years, .12 for open access, .12 a preferred venue to .25.
    """
    title, abstract = (T.content_tokens(T.normalize(F.coalesce(F.col(c), F.lit("")))) for c in ("title", "abstract"))
    rows = candidates.withColumns({"title_tokens": title, "abstract_tokens": abstract})

    def text(query: str) -> tuple[Column, Column]:
        q = T.content_tokens(T.normalize(F.lit(query)))
        of_title = T.token_overlap(q, F.col("title_tokens"))
        return of_title, of_title + F.least(F.lit(0.5), T.token_overlap(q, F.col("abstract_tokens")) * 0.5)

    searches = []
    for query, family in evidence:
        of_title, both = text(query)
        searches.append(both + F.when(F.lit(family).rlike(FAMILIES) & (of_title >= 0.5), 0.15).otherwise(0.0))
    best = F.least(F.lit(1.15), F.greatest(F.lit(0.0), *searches)) if searches else F.lit(0.0)
    venues = F.size(F.array_intersect(F.coalesce("packs", F.array().cast("array<string>")), F.array(*[F.lit(p) for p in preferred]).cast("array<string>")))
    score = (
        F.greatest(text(topic)[1], best) + F.least(F.lit(0.3), F.greatest(F.lit(1), _zero("providers")) * 0.08) + F.when(_zero("citations") > 0, F.least(F.lit(0.3), F.log10(F.col("citations") + 1) / 20)).otherwise(0.0)
        + F.when(F.col("year") >= this_year - 2, 0.12).otherwise(0.0) + F.when(F.coalesce("open_access", F.lit(False)), 0.12).otherwise(0.0) + F.least(F.lit(0.25), venues * 0.12)
    )
    return rows.withColumn("score", F.round(score, 4)).drop("title_tokens", "abstract_tokens")


#: Weights of a candidate's utility.
UTILITY = {"evidence": 0.28, "mechanism": 0.24, "feasibility": 0.18, "novelty": 0.14, "preference": 0.1, "readiness": 0.12, "risk": -0.16}


def candidate_utility(candidates: DataFrame) -> DataFrame:
    """Adds utility, hard_gate and needs_evidence to candidates with the columns of UTILITY, verdict, far and bridged.

    A far source needs a mechanism fit of .6 or a bridge; a candidate is gated if it is rejected, too risky for its feasibility or such a source.
    """
    total = sum((w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in UTILITY.items()), F.lit(0.07))
    blocked = F.coalesce("far", F.lit(False)) & (F.col("mechanism") < 0.6) & ~F.coalesce("bridged", F.lit(False))
    gate = (F.col("verdict") == "reject") | ((F.col("risk") >= 0.85) & (F.col("feasibility") < 0.35)) | blocked
    needs = (F.col("verdict") == "needs_evidence") | (F.col("evidence") < 0.35) | (F.col("readiness") < 0.35) | blocked
    return candidates.withColumns({"utility": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3), "hard_gate": gate, "needs_evidence": needs})


#: What a section adds to a record's confidence, records of a type that a paper keeps, types that are sentences.
SECTION_BONUS = {"title": 0.08, "abstract": 0.06, "results": 0.04, "analysis": 0.04, "discussion": 0.04, "inferred": -0.08}
SLOTS = {"Problem": 4, "Method": 3, "Dataset": 6, "Benchmark": 6, "Metric": 6, "Claim": 5, "Finding": 6, "ResearchGoal": 4, "Limitation": 5, "Assumption": 5, "Evidence": 8, "FutureDirection": 4}
SENTENCES = ("Claim", "Finding", "Limitation", "Assumption", "Evidence", "FutureDirection", "ResearchGoal")


def admitted_records(records: DataFrame) -> DataFrame:
    """records(paper, id, type, name, text, confidence, explicit, section, linked) that are admitted, with score and tier.

    Names without content are rejected, sentences under 32 characters and other records under two content tokens (three if inferred; data sets
    and benchmarks need two only if inferred, metrics none). Of a paper's records of a type with one normalised name, the surest counts, and so many types allow.
    """
    from pyspark.sql.window import Window

    name, text = F.trim(F.coalesce("name", "text", F.lit(""))), F.trim(F.coalesce("text", "name", F.lit("")))
    rows = records.withColumns({"norm": T.normalize(name), "length": F.length(text), "section": F.lower(F.trim(F.coalesce("section", F.lit(""))))})
    rows = rows.withColumn("n_tokens", F.size(T.content_tokens(F.col("norm"))))
    inferred, sentence = F.col("section") == "inferred", F.col("type").isin(list(SENTENCES))
    least = F.when(F.col("type") == "Metric", 0).when(F.col("type").isin("Dataset", "Benchmark"), F.when(inferred, 2).otherwise(1)).otherwise(F.when(inferred, 3).otherwise(2))
    kept = rows.where((F.col("norm") != "") & F.when(sentence, F.col("length") >= 32).otherwise(F.col("n_tokens") >= least))
    bonus = sum((F.when(F.col("section") == s, b).otherwise(0.0) for s, b in SECTION_BONUS.items()), F.lit(0.0))
    score = (
        F.coalesce("confidence", F.lit(0.55)) + F.when(F.coalesce("explicit", F.lit(False)), 0.04).otherwise(0.0) + bonus + F.when(F.col("n_tokens") >= 3, 0.08).when(F.col("n_tokens") == 2, 0.03).otherwise(0.0)
        + F.when(sentence & (F.col("length") >= 48), 0.06).otherwise(0.0) + F.when(F.coalesce("linked", F.lit(False)), 0.04).otherwise(0.0)
    )
    scored = kept.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), score)), 3))
    slots = F.element_at(F.create_map(*[x for k, v in SLOTS.items() for x in (F.lit(k), F.lit(v))]), F.col("type"))
    order = [F.desc("confidence"), F.desc("length"), F.asc("id")]
    one = scored.withColumn("copy", F.row_number().over(Window.partitionBy("paper", "type", "norm").orderBy(*order))).where("copy = 1")
    out = one.withColumn("place", F.row_number().over(Window.partitionBy("paper", "type").orderBy(*order))).where(F.col("place") <= slots)
    return out.select("paper", "id", "type", "score", F.when(F.col("score") >= 0.86, "high").when(F.col("score") >= 0.72, "medium").otherwise("low").alias("tier"), "place")


def pattern_matches(gaps: DataFrame, cards: list[dict], most: int = 2, least: float = 0.25) -> DataFrame:
    """gap, pattern, score, place of gaps(gap, kind, type, text) and cards(pattern, kinds, types, terms): .15 for the kind, .45 for the type, .14 a term to .4.

    The cards are a list that the caller states; each gap keeps its best, ties by pattern.
    """
    text = T.normalize(F.coalesce("text", F.lit("")))
    rows = gaps.withColumn("norm", text)
    scored = []
    for card in cards:
        hits = sum((F.contains("norm", F.lit(t)).cast("int") for t in card["terms"]), F.lit(0))
        score = F.when(F.col("kind").isin(card["kinds"]), 0.15).otherwise(0.0) + F.when(F.col("type").isin(card["types"]), 0.45).otherwise(0.0) + F.least(F.lit(0.4), 0.14 * hits)
        scored.append(F.struct((-F.round(F.least(F.lit(1.0), score), 4)).alias("s"), F.lit(card["pattern"]).alias("pattern")))
    best = F.slice(F.array_sort(F.filter(F.array(*scored), lambda x: x["s"] <= -least)), 1, most)
    return rows.select("gap", F.posexplode(best).alias("place", "m")).select("gap", F.col("m.pattern").alias("pattern"), (-F.col("m.s")).alias("score"), (F.col("place") + 1).alias("place"))
