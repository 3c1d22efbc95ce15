"""Retrieval: token statistics, BM25, dense top-k, rank fusion, reranking, metrics.

The query side is explicit and bounded by the caller; documents are never multiplied by queries: lexical scores come from an equi-join on
tokens, dense ones from one pass of the documents against the query vectors in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.runtime import cut

K1, B, RRF_K = 1.2, 0.75, 60  #: Fixed values.
COLUMNS = 256  #: Queries whose scores a task holds at once.


def token_counts(docs: DataFrame, doc: str, tokens: str) -> DataFrame:
    """doc, token, tf."""
    return docs.select(doc, F.explode(tokens).alias("token")).groupBy(doc, "token").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("token").agg(F.count("*").alias("df"))


def bm25(docs: DataFrame, queries: DataFrame, doc: str, query: str, tokens: str, k: int) -> DataFrame:
    """Best k documents of each query: query, doc, score, rank (ties by doc). Query tokens count once.

    The documents' tokens are written once, as both the collection's statistics and the postings need them; the postings are cut down to
    the queries' tokens before they are counted. No documents or queries give no rows.
    """
    docs = cut(docs.select(F.col(doc), F.col(tokens)), "tokens")
    n, mean = docs.agg(F.count("*"), F.avg(F.size(tokens))).first()
    wanted = queries.select(query, F.explode(F.array_distinct(tokens)).alias("token"))
    posting = docs.select(doc, F.size(tokens).alias("len"), F.explode(tokens).alias("token")).join(wanted.select("token").distinct(), "token", "left_semi")
    counts = cut(posting.groupBy(doc, "len", "token").agg(F.count("*").alias("tf")), "postings")
    df = document_frequency(counts)
    idf = F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean or 1.0)))
    weighted = counts.join(df, "token").select(doc, "token", gain.alias("gain"))
    scored = wanted.join(weighted, "token").groupBy(query, doc).agg(F.sum("gain").alias("score"))
    return top_k(scored, query, "score", doc, k)


def top_k(scored: DataFrame, query: str, score: str, tie: str, k: int) -> DataFrame:
    """Rows ranked 1 to k in each query, by falling score (6 decimals), ties by id. Spark cuts each task's rows to k before the shuffle."""
    rounded = scored.withColumn(score, F.round(score, 6))
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(tie))
    return rounded.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def total_before(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows that come before in an order: rows are dealt by ranges, and only a total a range is put in line."""
    part = "range_of_order"
    parts = cut(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    totals = parts.groupBy(part).agg(F.sum(value).alias("range_total"))  # as many rows as there are partitions
    offset = F.coalesce(F.sum("range_total").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = parts.withColumn(name, inside).join(totals.select(part, offset.alias("range_offset")), part)
    return joined.withColumn(name, F.col(name) + F.col("range_offset")).drop(part, "range_offset")


def best_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the k best rows of each column by (score rounded to 6 decimals, row), so rows stand in order of id."""
    scores = np.trunc(scores * 1e6 + np.copysign(0.5, scores)) / 1e6
    if k >= len(scores):
        keep = np.ones(scores.shape, bool)
    else:
        last = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
        above, equal = scores > last, scores == last
        keep = above | (equal & (np.cumsum(equal, axis=0) <= k - above.sum(axis=0)))
    rows, cols = np.nonzero(keep)
    return rows, cols, scores[rows, cols]


def dense_top_k(vectors: DataFrame, queries: DataFrame, doc: str, query: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """Best k vectors of each query by dot product. The queries are the explicit query set, taken in blocks of ``block`` rows;
    each batch keeps its own best k (and one, for the query itself) by the order of ``top_k``, so the shuffle carries few rows a query and batch."""
    total = queries.count()
    blocks = max(1, -(-total // block))
    found = None
    for i in range(blocks):
        part = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == i)).select(query, vector).toPandas()
        if not len(part):
            continue
        ids, matrix = part[query].to_numpy(), np.stack(part[vector].to_numpy()).astype(np.float64)

        def best(batches: Iterator[pd.DataFrame], ids=ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf = pdf.sort_values(doc, kind="stable")
                e = np.stack(pdf[vector].to_numpy()).astype(np.float64)
                for at in range(0, len(ids), COLUMNS):
                    rows, cols, scores = best_rows(e @ matrix[at : at + COLUMNS].T, k + 1)
                    yield pd.DataFrame({query: ids[at + cols], doc: pdf[doc].to_numpy()[rows], "score": scores})

        kinds = dict(vectors.dtypes) | dict(queries.dtypes)
        scored = vectors.select(doc, vector).mapInPandas(best, f"{query} {kinds[query]}, {doc} {kinds[doc]}, score double")
        found = scored if found is None else found.unionByName(scored)
    if found is None:  # no queries, no rows
        kinds = dict(vectors.dtypes) | dict(queries.dtypes)
        found = vectors.sparkSession.createDataFrame([], f"{query} {kinds[query]}, {doc} {kinds[doc]}, score double")
    return top_k(found.where(F.col(query) != F.col(doc)), query, "score", doc, k)


def reciprocal_rank_fusion(lexical: DataFrame, dense: DataFrame, query: str, doc: str, k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank); ties by dense rank, then lexical rank, then id."""
    side = lambda df, c: df.select(query, doc, F.col("rank").alias(c))
    both = side(lexical, "lexical_rank").join(side(dense, "dense_rank"), [query, doc], "full_outer")
    score = F.coalesce(1 / (k + F.col("lexical_rank")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("dense_rank")), F.lit(0.0))
    w = Window.partitionBy(query).orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"), F.asc(doc))
    return both.withColumn("score", F.round(score, 8)).withColumn("rank", F.row_number().over(w))


def rerank(base: DataFrame, reranked: DataFrame, query: str, doc: str) -> DataFrame:
    """Reranked rows first by their new rank, the rest in the order they had."""
    both = base.withColumnRenamed("rank", "base_rank").join(reranked.select(query, doc, F.col("rank").alias("new_rank")), [query, doc], "left")
    w = Window.partitionBy(query).orderBy(F.asc_nulls_last("new_rank"), F.asc("base_rank"))
    return both.withColumn("rank", F.row_number().over(w))


def ranking_metrics(ranked: DataFrame, gold: DataFrame, query: str, doc: str, cutoffs: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Per query and cutoff: hit, precision, recall, f1, mrr, map (by min(relevant, k)), ndcg (linear gain). gold(query, doc, grade)."""
    marked = ranked.join(gold, [query, doc], "left").select(query, "rank", F.coalesce("grade", F.lit(0)).alias("grade"))
    hits = marked.withColumn("so_far", F.sum(F.when(F.col("grade") > 0, 1).otherwise(0)).over(Window.partitionBy(query).orderBy("rank")))
    ideal = gold.where("grade > 0").withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("grade"), F.asc(doc))))
    at = F.explode(F.array(*[F.lit(k) for k in cutoffs])).alias("k")
    best = ideal.select(query, "place", "grade", at).where("place <= k").groupBy(query, "k").agg(F.sum(F.col("grade") / F.log2(F.col("place") + 1)).alias("ideal"))
    total = ideal.groupBy(query).agg(F.count("*").alias("relevant"))
    one = lambda c: F.coalesce(c, F.lit(0.0))
    is_hit = F.col("grade") > 0
    seen = hits.select("*", at).where("rank <= k").groupBy(query, "k").agg(
        F.sum(is_hit.cast("int")).alias("found"), F.min(F.when(is_hit, F.col("rank"))).alias("first"), F.sum(F.when(is_hit, F.col("so_far") / F.col("rank"))).alias("precisions"), F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    out = total.select(query, "relevant", at).join(seen, [query, "k"], "left").join(best, [query, "k"], "left")
    found = F.coalesce("found", F.lit(0))
    precision, recall = found / F.col("k"), found / F.col("relevant")
    return out.select(
        query, "k", (found > 0).cast("double").alias("hit"), precision.alias("precision"), recall.alias("recall"), F.when(found > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"),
        one(1 / F.col("first")).alias("mrr"), one(F.col("precisions") / F.least("relevant", "k")).alias("map"), one(F.col("dcg") / F.col("ideal")).alias("ndcg"),
    )


def confusion(predictions: DataFrame, gold: str, predicted: str) -> DataFrame:
    return predictions.groupBy(gold, predicted).agg(F.count("*").alias("n"))


def label_scores(predictions: DataFrame, gold: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1, support, over the union of labels."""
    tp = predictions.where(F.col(gold) == F.col(predicted)).groupBy(F.col(gold).alias("label")).agg(F.count("*").alias("tp"))
    of = lambda c, name: predictions.groupBy(F.col(c).alias("label")).agg(F.count("*").alias(name))
    rows = of(gold, "support").join(of(predicted, "said"), "label", "full_outer").join(tp, "label", "left").fillna(0)
    p = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return rows.select("label", p.alias("precision"), r.alias("recall"), F.when(F.col("tp") > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), "support")
