"""Similarity joins by blocking: pairs come from shared keys, never from a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as T


def blocked_pairs(nodes: DataFrame, key: str, tokens: Column, threshold: float, least: int = 2, most: int = 48, per_node: int | None = 8) -> DataFrame:
    """a, b, score of pairs that share a token (four letters at least) of ``least`` to ``most`` nodes, with Jaccard from ``threshold`` on.

    The bounds on a token's nodes belong to the operator's definition; they bound the pairs of each token too.
    """
    t = nodes.select(F.col(key).alias("id"), tokens.alias("t"))
    block = F.filter(F.array_distinct("t"), lambda x: F.length(x) >= 4)
    keyed = t.select("id", F.explode(F.slice(block, 1, per_node) if per_node else block).alias("tok"))
    kept = keyed.groupBy("tok").agg(F.count("*").alias("n")).where(F.col("n").between(least, most)).select("tok")
    usable = keyed.join(kept, "tok")
    pairs = usable.alias("x").join(usable.alias("y"), "tok").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    both = pairs.join(t.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(t.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    score = T.jaccard(F.col("ta"), F.col("tb"))
    return both.withColumn("s", score).where(F.col("s") >= threshold).select("a", "b", F.round("s", 3).alias("score"))


def contradictions(claims: DataFrame, key: str, text: str, paper: str, threshold: float = 0.32) -> DataFrame:
    """Blocked pairs of claims from different papers whose polarities are opposite."""
    pairs = blocked_pairs(claims, key, T.content_tokens(T.normalize(F.col(text))), threshold)
    side = lambda s: claims.select(F.col(key).alias(s), F.col(paper).alias(f"paper_{s}"), T.polarity(F.col(text)).alias(f"polarity_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where("not (paper_a <=> paper_b) and polarity_a <> 'mixed' and polarity_b <> 'mixed' and polarity_a <> polarity_b").select("a", "b", "score")


def sharing_pairs(left: DataFrame, right: DataFrame, a: str, b: str, ta: str, tb: str) -> DataFrame:
    """Distinct pairs that share a token, with both token arrays; others have similarity 0."""
    x = left.select(a, F.explode(F.array_distinct(ta)).alias("tok"))
    y = right.select(b, F.explode(F.array_distinct(tb)).alias("tok"))
    return x.join(y, "tok").select(a, b).distinct().join(left.select(a, ta), a).join(right.select(b, tb), b)


def theme_join(limitations: DataFrame, methods: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs on shared themes; score .55 + .15 for each. Both sides have ``themes``."""
    x = limitations.select(a, F.explode("themes").alias("theme")).distinct()
    y = methods.select(b, F.explode("themes").alias("theme")).distinct()
    found = x.join(y, "theme").groupBy(a, b).agg(F.array_join(F.array_sort(F.collect_set("theme")), ",").alias("themes"), F.count("*").alias("n"))
    return found.select(a, b, "themes", F.round(0.55 + 0.15 * F.col("n"), 2).alias("score"))


def title_links(refs: DataFrame, papers: DataFrame, ref: str, title: str, target: str, candidates: int = 12) -> DataFrame:
    """Exact normalised titles, else among the ``candidates`` papers that share most tokens the first whose title contains the other or is contained."""
    r = refs.select(ref, title, T.normalize(F.col(title)).alias("rn"))
    p = papers.select(target, T.normalize(F.col(target)).alias("pn"))
    exact = r.join(p, F.col("rn") == F.col("pn")).select(ref, title, target, F.lit("exact").alias("how"))
    rest = r.join(exact.select(ref), ref, "left_anti")
    long_tokens = lambda c: F.slice(F.filter(F.array_distinct(T.content_tokens(F.col(c))), lambda x: F.length(x) >= 3), 1, 10)
    shared = rest.select(ref, title, "rn", F.explode(long_tokens("rn")).alias("tok")).join(p.select(target, "pn", F.explode(long_tokens("pn")).alias("tok")), "tok").groupBy(ref, title, "rn", target, "pn").agg(F.count("*").alias("n"))
    w = Window.partitionBy(ref).orderBy(F.desc("n"), F.asc(target))
    near = shared.withColumn("place", F.row_number().over(w)).where(F.col("place") <= candidates).where(F.contains("rn", "pn") | F.contains("pn", "rn"))
    first = near.withColumn("best", F.row_number().over(Window.partitionBy(ref).orderBy("place"))).where("best = 1")
    return exact.unionByName(first.select(ref, title, target, F.lit("contained").alias("how")))


def near_in_range(df: DataFrame, block: str, key: str, value: str, reach: int) -> DataFrame:
    """a, b and their values for rows of one block with values at most ``reach`` apart: an equi-join on the block and the value's bucket,
    where each row looks into its own bucket and the next, so a large block still spreads over buckets."""
    width = max(1, reach)
    bucket = F.floor(F.col(value) / width)
    rows = df.select(F.col(block).alias("blk"), F.col(key).alias("k"), F.col(value).alias("v"), bucket.alias("bucket"))
    probe = rows.select("blk", F.col("k").alias("a"), F.col("v").alias("ya"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    found = probe.join(rows.select("blk", F.col("k").alias("b"), F.col("v").alias("yb"), "bucket"), ["blk", "bucket"])
    return found.where((F.col("a") < F.col("b")) & (F.abs(F.col("ya") - F.col("yb")) <= reach)).select("a", "b", "ya", "yb")


def auc_of_counts(by_score: DataFrame) -> DataFrame:
    """n, positives, auc from counts (score, pos, neg). Running counts go by ranges of scores: within a range by window, across
    ranges by the ranges' totals, so that no task sorts all scores."""
    ranges = by_score.withColumn("range", F.floor(F.log2(F.greatest(F.col("score"), F.lit(1)).cast("double")) * 16))
    totals = ranges.groupBy("range").agg(F.sum("neg").alias("neg_in"))
    before = totals.withColumn("neg_before", F.coalesce(F.sum("neg_in").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # some hundreds of rows
    inner = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranges.withColumn("below", F.coalesce(F.sum("neg").over(inner), F.lit(0))).join(before.select("range", "neg_before"), "range")
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg_before") + F.col("neg") / 2))
    return rows.agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("positives"), F.round(wins / (F.sum("pos") * F.sum("neg")), 6).alias("auc"))


def hash_embeddings(docs: DataFrame, key: str, tokens: str, dim: int = 128) -> DataFrame:
    """key, vector: each token adds (1 + ln tf) with a sign to a bucket, both from its SHA-256; unit length, ten decimals."""
    tf = docs.select(key, F.explode(tokens).alias("tok")).groupBy(key, "tok").agg(F.count("*").alias("tf"))
    digest = F.sha2("tok", 256)
    bucket = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    cells = tf.select(key, bucket.alias("b"), (sign * (1 + F.ln("tf"))).alias("v")).groupBy(key, "b").agg(F.sum("v").alias("v"))
    sparse = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.round(F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.greatest("norm", F.lit(1e-12)), 10))
    return sparse.select(key, dense.alias("vector"))
