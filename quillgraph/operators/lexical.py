"""Lexical score of a paper corpus, its candidate scan, gold matching and why gold was missed.

Inputs are tables of papers, queries, ranked candidates and gold papers; columns are named in each function. Null titles, abstracts and
texts count as empty; repeated rows of one id are not expected, as an id names one paper; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as T
from quillgraph.operators.retrieval import B, K1, top_k, total_before
from quillgraph.runtime import cut

#: Weights of the mix, candidates scanned, candidates returned.
OVERLAP = {"title": 2.5, "abstract": 1.25, "combined": 1.5}
BM25 = {"title": 2.25, "abstract": 1.5, "combined": 1.0}
EXACT_TITLE, PHRASE, IDENTIFIER = 2.5, 1.5, 2.5
SCAN_LIMIT, LIMIT = 50_000, 20
#: Terms of the facets of a query.
FACETS = {
    "background": ("problem", "task", "domain", "motivation", "challenge", "survey"),
    "method": ("method", "model", "algorithm", "architecture", "approach", "framework"),
    "result": ("result", "dataset", "benchmark", "metric", "evaluation", "performance", "finding"),
}
#: Fixed value: title similarity from which a candidate is a gold paper.
TITLE_MATCH = 0.96


def compact(c: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def prepared_papers(papers: DataFrame) -> DataFrame:
    """papers(doc, title, abstract, ids): content tokens of both fields, compact title, facet hits. Written once, as statistics and postings both read it."""
    text = F.lower(F.concat_ws(" ", _empty("title"), _empty("abstract")))
    hits = F.struct(*[sum((F.contains(text, F.lit(t)).cast("int") for t in terms[1:]), F.contains(text, F.lit(terms[0])).cast("int")).alias(k) for k, terms in FACETS.items()])
    tokens = lambda c: T.content_tokens(T.normalize(_empty(c)))
    out = papers.select("doc", "ids", tokens("title").alias("t"), tokens("abstract").alias("a"), compact(F.col("title")).alias("compact_title"), hits.alias("facets"))
    return cut(out, "papers")


def postings(papers: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, token, tf_t, tf_a of prepared papers, for the wanted tokens."""
    side = lambda c: papers.select("doc", F.explode(c).alias("token"), F.lit(c).alias("field"))
    both = side("t").unionByName(side("a")).join(wanted.select("token").distinct(), "token", "left_semi")
    count = lambda c: F.count(F.when(F.col("field") == c, 1))
    return cut(both.groupBy("doc", "token").agg(count("t").alias("tf_t"), count("a").alias("tf_a")), "postings")


def query_tokens(queries: DataFrame) -> DataFrame:
    """query, token, m (how often the query has it), nq (its tokens), uq (distinct ones)."""
    tokens = queries.select("query", T.content_tokens(T.normalize(_empty("text"))).alias("q")).where(F.size("q") > 0)
    return tokens.select("query", F.size("q").alias("nq"), F.size(F.array_distinct("q")).alias("uq"), F.explode("q").alias("token")).groupBy("query", "nq", "uq", "token").agg(F.count("*").alias("m"))


def scan_limited(matched: DataFrame, papers: DataFrame, limit: int = LIMIT, scan_limit: int = SCAN_LIMIT) -> DataFrame:
    """query, doc, place: candidates by the query's rarest token that a paper has, at most ``scan_limit``; fewer than ``limit`` are filled up with the head of the corpus.

    matched(query, doc, token, df). The window orders a query's candidates, which the scan limit bounds in what follows.
    """
    first = matched.groupBy("query", "doc").agg(F.min(F.struct("df", "token")).alias("rarest"))
    w = Window.partitionBy("query").orderBy("rarest.df", "rarest.token", "doc")
    found = first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= scan_limit).select("query", "doc", "place")
    n = found.groupBy("query").agg(F.max("place").alias("n")).where(F.col("n") < limit)
    head = [r["doc"] for r in papers.select("doc").orderBy("doc").limit(2 * limit).collect()]  # so many, as at most ``limit`` of them are candidates already
    if not head:
        return found
    spare = n.select("query", "n", F.explode(F.array(*[F.lit(d) for d in head])).alias("doc")).join(found.select("query", "doc"), ["query", "doc"], "left_anti")
    filled = spare.withColumn("place", F.col("n") + F.row_number().over(Window.partitionBy("query").orderBy("doc"))).where(F.col("place") <= limit)
    return found.unionByName(filled.select("query", "doc", F.col("place").cast("int")))


def lexical_mix(papers: DataFrame, queries: DataFrame, k: int = LIMIT, scan_limit: int = SCAN_LIMIT) -> DataFrame:
    """Best k papers of each query: query, doc, score, rank. papers(doc, title, abstract, ids); queries(query, text, facet, ids).

    Overlap of the query's tokens with title, abstract and both; Jaccard similarity with the title's tokens; BM25 over each field;
    bonuses for an equal title, a title that holds the query, facet terms and a common identifier.
    """
    docs, wanted = prepared_papers(papers), query_tokens(queries)
    n, len_t, len_a = docs.agg(F.count("*"), F.avg(F.size("t")), F.avg(F.size("a"))).first()
    posting = postings(docs, wanted)
    df = posting.groupBy("token").agg(F.count(F.when(F.col("tf_t") > 0, 1)).alias("df_t"), F.count(F.when(F.col("tf_a") > 0, 1)).alias("df_a"), F.count("*").alias("df"))
    sizes = docs.select("doc", "ids", "compact_title", "facets", F.size("t").alias("n_t"), F.size("a").alias("n_a"), F.size(F.array_distinct("t")).alias("u_t"))
    matched = wanted.join(posting, "token").join(df, "token")
    pairs = scan_limited(matched, docs, k, scan_limit).select("query", "doc")

    def gain(tf: Column, found_in: str, length: Column, mean: float) -> Column:
        idf = F.ln(1 + (F.lit(n) - F.col(found_in) + 0.5) / (F.col(found_in) + 0.5))
        return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean or 1.0)))).otherwise(0.0)

    tf_t, tf_a, m = F.col("tf_t"), F.col("tf_a"), F.col("m")
    scored = matched.join(sizes.select("doc", "n_t", "n_a"), "doc").groupBy("query", "doc").agg(
        F.sum(F.when(tf_t > 0, m).otherwise(0)).alias("in_t"), F.sum(F.when(tf_a > 0, m).otherwise(0)).alias("in_a"), F.sum(m).alias("in_c"), F.count(F.when(tf_t > 0, 1)).alias("both"),
        F.sum(gain(tf_t, "df_t", F.col("n_t"), len_t)).alias("bm_t"), F.sum(gain(tf_a, "df_a", F.col("n_a"), len_a)).alias("bm_a"), F.sum(gain(tf_t + tf_a, "df", F.col("n_t") + F.col("n_a"), (len_t or 0) + (len_a or 0))).alias("bm_c"),
    )
    asked = queries.select("query", "facet", F.col("ids").alias("q_ids"), compact(F.col("text")).alias("compact_query"))
    size = wanted.select("query", "nq", "uq").distinct()
    rows = pairs.join(scored, ["query", "doc"], "left").fillna(0).join(sizes, "doc").join(asked, "query").join(size, "query")
    share = lambda c: F.col(c) / F.col("nq")
    similarity = F.when(F.col("u_t") > 0, F.col("both") / (F.col("uq") + F.col("u_t") - F.col("both"))).otherwise(0.0)
    facet = sum((F.when(F.col("facet") == name, F.least(F.lit(2.0), F.col(f"facets.{name}") / len(terms))).otherwise(0.0) for name, terms in FACETS.items()), F.lit(0.0))
    score = (
        OVERLAP["title"] * share("in_t") + OVERLAP["abstract"] * share("in_a") + OVERLAP["combined"] * share("in_c") + similarity
        + BM25["title"] * F.col("bm_t") + BM25["abstract"] * F.col("bm_a") + BM25["combined"] * F.col("bm_c")
        + F.when(F.col("compact_query") == F.col("compact_title"), EXACT_TITLE).otherwise(0.0)
        + F.when((F.col("compact_title") != "") & F.contains("compact_title", "compact_query"), PHRASE).otherwise(0.0)
        + facet + F.when(F.coalesce(F.arrays_overlap("ids", "q_ids"), F.lit(False)), IDENTIFIER).otherwise(0.0)
    )
    return top_k(rows.select("query", "doc", score.alias("score")), "query", "score", "doc", k)


# ---- gold -----------------------------------------------------------------------------------------------


def title_tokens(c: str) -> Column:
    return F.array_distinct(T.tokens(T.normalize(F.coalesce(F.col(c), F.lit("")))))


def _similar_titles(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """query, rank, gold, similarity (1 for equal titles, else Jaccard over tokens) of candidates and gold of a query that share a word."""
    c = candidates.select("query", "rank", compact(F.col("title")).alias("ct"), title_tokens("title").alias("c_tokens"))
    g = gold.select("query", "gold", compact(F.col("title")).alias("gt"), title_tokens("title").alias("g_tokens"))
    x, y = c.select("query", "rank", F.explode("c_tokens").alias("token")), g.select("query", "gold", F.explode("g_tokens").alias("token"))
    shared = x.join(y, ["query", "token"]).groupBy("query", "rank", "gold").agg(F.count("*").alias("both"))
    out = shared.join(c, ["query", "rank"]).join(g, ["query", "gold"])
    return out.select("query", "rank", "gold", F.when(F.col("ct") == F.col("gt"), 1.0).otherwise(F.col("both") / (F.size("c_tokens") + F.size("g_tokens") - F.col("both"))).alias("similarity"))


def _shared_keys(candidates: DataFrame, gold: DataFrame, keys: str) -> DataFrame:
    """query, rank, gold: the first gold paper that has one of the candidate's keys, by the order of the keys."""
    x = candidates.select("query", "rank", F.posexplode(keys).alias("at", "key"))
    y = gold.select("query", "gold", F.explode(keys).alias("key")).groupBy("query", "key").agg(F.min("gold").alias("gold"))
    return x.join(y, ["query", "key"]).groupBy("query", "rank").agg(F.min(F.struct("at", "gold")).alias("best")).select("query", "rank", F.col("best.gold").alias("gold"))


def rank_events(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """query, rank, gold, reason, relevant, grade of ranked candidates: the gold paper that each is, by identifier, alias or title.

    candidates(query, rank, title, ids, aliases); gold(query, gold, title, ids, aliases, grade), gold in the order of its numbers. A gold
    paper counts once, for the first candidate that is it; later ones are not relevant.
    """
    similar = _similar_titles(candidates, gold).where(F.col("similarity") >= TITLE_MATCH)
    by_title = similar.groupBy("query", "rank").agg(F.min(F.struct("gold", "similarity")).alias("t")).select("query", "rank", F.col("t.gold").alias("by_title"), F.when(F.col("t.similarity") == 1, "title_exact").otherwise("title_similarity").alias("kind"))
    by = lambda keys, name: _shared_keys(candidates, gold, keys).withColumnRenamed("gold", name)
    rows = candidates.select("query", "rank").join(by("ids", "by_id"), ["query", "rank"], "left").join(by("aliases", "by_alias"), ["query", "rank"], "left").join(by_title, ["query", "rank"], "left")
    rows = rows.withColumn("gold", F.coalesce("by_id", "by_alias", "by_title")).withColumn("reason", F.when(F.col("by_id").isNotNull(), "identifier").when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_title").isNotNull(), F.col("kind")))
    first = F.col("gold").isNotNull() & (F.row_number().over(Window.partitionBy("query", "gold").orderBy("rank")) == 1)
    graded = rows.withColumn("relevant", first).join(gold.select("query", "gold", "grade"), ["query", "gold"], "left")
    return graded.select("query", "rank", "gold", "reason", "relevant", F.when(F.col("relevant"), F.greatest(F.coalesce("grade", F.lit(1)), F.lit(0))).otherwise(0).alias("grade"))


def gold_misses(candidates: DataFrame, gold: DataFrame, events: DataFrame) -> DataFrame:
    """query, gold, reason, best_rank of gold papers that no candidate is: what the nearest candidate lacked.

    The nearest has the largest 2 (same identifier) + 1.5 (same alias) + title similarity; the first one of a query that shares nothing.
    """
    missed = gold.join(events.where("relevant").select("query", "gold"), ["query", "gold"], "left_anti")
    key_pairs = lambda keys, name: candidates.select("query", "rank", F.explode(keys).alias("key")).join(missed.select("query", "gold", F.explode(keys).alias("key")), ["query", "key"]).select("query", "gold", "rank", F.lit(True).alias(name)).distinct()
    near = _similar_titles(candidates, missed).join(key_pairs("ids", "same_id"), ["query", "gold", "rank"], "full_outer").join(key_pairs("aliases", "same_alias"), ["query", "gold", "rank"], "full_outer")
    near = near.select("query", "gold", "rank", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("same_id", F.lit(False)).alias("same_id"), F.coalesce("same_alias", F.lit(False)).alias("same_alias"))
    score = F.col("same_id").cast("int") * 2 + F.col("same_alias").cast("int") * 1.5 + F.col("similarity")
    best = near.groupBy("query", "gold").agg(F.max_by(F.struct("similarity", "same_id", "same_alias", "rank"), F.struct(score, -F.col("rank"))).alias("b"))
    pool = candidates.groupBy("query").agg(F.min("rank").alias("first_rank"))
    rows = missed.select("query", "gold").join(best, ["query", "gold"], "left").join(pool, "query", "left")
    s = F.coalesce("b.similarity", F.lit(0.0))
    reason = (
        F.when(F.col("first_rank").isNull(), "no_candidates").when(F.coalesce(F.col("b.same_id") | F.col("b.same_alias"), F.lit(False)), "identity_match_not_ranked")
        .when(s >= TITLE_MATCH, "title_match_not_ranked").when(s >= max(0.5, TITLE_MATCH - 0.15), "near_title_match_below_threshold").when(s > 0, "weak_title_overlap").otherwise("not_in_candidate_pool")
    )
    return rows.select("query", "gold", reason.alias("reason"), F.coalesce("b.rank", "first_rank").alias("best_rank"))


# ---- predicted links ------------------------------------------------------------------------------------


def normalized_predictions(predictions: DataFrame) -> DataFrame:
    """pair, score in [0, 1], rank of predictions(source, target, score): no self-links or nulls, the best score of a pair, ties by pair."""
    pair = F.concat_ws("|", F.least("source", "target"), F.greatest("source", "target"))
    rows = predictions.where("source is not null and target is not null and source <> target and score is not null and not isnan(score)")
    best = rows.groupBy(pair.alias("pair")).agg(F.max(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score"))).alias("score"))
    before = total_before(best.withColumn("one", F.lit(1)), [F.desc("score"), F.asc("pair")], "one", "before")
    return before.select("pair", "score", (F.col("before") + 1).alias("rank"))


def link_metrics(predictions: DataFrame, positives: DataFrame, negatives: DataFrame, top_k: int = 10, cutoff_year: int | None = None) -> DataFrame:
    """One row: hits at 1, 10 and k, mean reciprocal rank, share of positive-negative pairs in the right order (ties half), missing positives, leakage.

    predictions(pair, score, rank); positives(pair, year); negatives(pair). Pairs are never multiplied: wins come from counts by score.
    """
    pos = positives.join(predictions, "pair", "left")
    one = pos.agg(
        F.count("*").alias("n"), F.count(F.when(F.col("rank") <= 1, 1)).alias("h1"), F.count(F.when(F.col("rank") <= 10, 1)).alias("h10"), F.count(F.when(F.col("rank") <= top_k, 1)).alias("hk"),
        F.sum(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("rr"), F.count(F.when(F.col("rank").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("year") <= F.lit(cutoff_year).cast("int"), 1)).alias("leaked"), F.count(F.when(F.col("year").isNull(), 1)).alias("undated"),
    )
    scored = lambda df, name: df.join(predictions.select("pair", "score"), "pair", "left").groupBy(F.coalesce("score", F.lit(0.0)).alias("s")).agg(F.count("*").alias(name))
    both = scored(positives, "p").join(scored(negatives, "q"), "s", "full_outer").fillna(0)
    below = total_before(both, [F.asc("s")], "q", "below")
    wins = below.agg(F.sum(F.col("p") * (F.col("below") + 0.5 * F.col("q"))).alias("wins"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    share = lambda c: F.round(F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0), 4)
    auc = F.round(F.when(F.col("np") * F.col("nq") > 0, F.col("wins") / (F.col("np") * F.col("nq"))).otherwise(0.0), 4)
    return one.join(wins).select(share("h1").alias("hits_at_1"), share("h10").alias("hits_at_10"), share("hk").alias("hits_at_k"), share("rr").alias("mrr"), auc.alias("pair_accuracy"), F.coalesce(F.col("np") * F.col("nq"), F.lit(0)).alias("pairs"), F.col("missing"), F.col("leaked"), F.col("undated"))
