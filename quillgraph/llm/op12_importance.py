"""Target-distribution importance resampling on hashed n-grams, in Spark SQL functions alone.

Word triples are laid out by zipping the word array with itself shifted by one and by two, and exploded; a triple gives
the features that begin at its first word, of one, two and three words. Their crc32 modulo ``buckets`` is counted for
the raw and for the target texts (partial counts of at most ``buckets`` rows a task). The gains, one row a bucket, are broadcast:
their number is a parameter and never grows with the data. A document's gains are summed; its rows are
next to each other, so a task sends one row a document. Scores add Gumbel noise from the document's id, so the highest ones are a draw
without replacement. Ranks come from a distributed sort: rows are dealt by range and sorted within partitions, and written
with the number of their partition and their place in it; a partition's offset is the number of rows in those before it. What
is fetched or windowed without a key is one row a partition of the sort.

Cases: null, empty and wordless texts have no features and weight 0; their score is the noise. A row that is there more than once
is one row as often as it is there: copies get equal scores and ranks of their own. A null doc_id hashes as the empty text and comes before all
others among equal scores. Without raw or target rows their counts are 0; without documents there are no rows. Long texts are arrays of
words within one row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 5, 42
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLACE = (1 << 33) - 1


def words(text: str | Column) -> Column:
    """Words of a text with A-Z lower-cased; a null text has none."""
    low = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(low, _BREAKS), "")


def triples(name: str) -> Column:
    """Each word of an array column with the two after it, null beyond the end."""
    most = F.greatest(F.size(name), F.lit(1))
    return F.arrays_zip(name, F.slice(name, F.lit(2), most), F.slice(name, F.lit(3), most))


def n_features(w: Column) -> Column:
    """Runs of one, two and three words."""
    n = F.size(w).cast("long")
    return n + F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))


def _buckets(buckets: int) -> Column:
    """The buckets of the features that begin at a triple's first word; null where there are fewer words."""
    a, b, c = (F.col(f"_t.{i}") for i in ("_w", "1", "2"))
    two = F.concat(a, F.lit(" "), b)
    return F.array(*[F.pmod(F.crc32(x.cast("binary")), F.lit(buckets)).cast("int") for x in (a, two, F.concat(two, F.lit(" "), c))])


def _exploded(df: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """One row a feature: the keys, ``first`` (1 at the first row of a text, features or none), and the bucket."""
    zipped = df.select(*keys, triples("_w").alias("_z"))
    rows = zipped.select(*keys, F.posexplode_outer("_z").alias("_at", "_t"))
    parts = rows.select(*keys, F.coalesce("_at", F.lit(0)).alias("_at"), _buckets(buckets).alias("_b"))
    flat = parts.select(*keys, "_at", F.posexplode("_b").alias("_k", "bucket"))
    return flat.select(*keys, (F.col("_at") + F.col("_k") == 0).cast("long").alias("first"), "bucket")


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: the features of all texts by bucket."""
    rows = _exploded(texts.select(words("text").alias("_w")), buckets)
    return rows.where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gain_table(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for every bucket: thousandths of the log of the ratio of smoothed shares, rounded down."""
    spark = raw.sparkSession
    s, t = (bucket_counts(x, buckets).select("bucket", F.col("n").alias(name)) for x, name in ((raw, "s"), (target, "t")))
    all_buckets = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = all_buckets.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    every = Window.partitionBy()  # one row a bucket
    s1, t1 = (F.col(c).cast("double") + 1 for c in ("s", "t"))
    ratio = t1 * (F.sum("s").over(every).cast("double") + buckets) / (s1 * (F.sum("t").over(every).cast("double") + buckets))
    return counts.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from the id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score."""
    texts = docs.select("doc_id", "text")
    gains = C.materialize(gain_table(texts, target, buckets).coalesce(1), "importance-gains")
    worded = texts.select("doc_id", F.xxhash64("text").alias("_h"), words("text").alias("_w"))
    worded = worded.select("doc_id", "_h", "_w", F.size("_w").cast("long").alias("n_words"), n_features(F.col("_w")).alias("n_features"))
    keys = ("doc_id", "_h", "n_words", "n_features")
    rows = _exploded(worded, buckets, *keys).join(F.broadcast(gains), "bucket", "left")
    sums = rows.groupBy(*keys).agg(F.sum(F.coalesce("gain", F.lit(0))).alias("_sum"), F.sum("first").alias("_copies"))
    each = sums.select("doc_id", "n_words", "n_features", F.expr("_sum div _copies").alias("weight"), F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return each.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))


def importance_resample(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """All documents with n_features, weight, score and rank: 1, 2, 3 ... of those drawn, null for the others."""
    may = F.col("n_words") >= least_words
    dealt = scored(docs, target, buckets, seed).withColumn("_may", may)
    order = [F.col("_may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    placed = dealt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.select("doc_id", "n_features", "weight", "score", "_may", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit(_PLACE)).alias("_place"))
    placed = C.materialize(placed, "importance-order")
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.count_if("_may").alias("_able"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition of the sort
    parts = parts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_able").over(Window.partitionBy()).alias("_able"))
    ranked = placed.join(F.broadcast(parts), "_part").withColumn("_rank", F.col("_before") + F.col("_place") + 1)
    drawn = F.col("_may") & (F.col("_rank") <= F.expr(f"({percent} * _able) div 100"))
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("_rank")).alias("rank"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT range AS i, range AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8
), texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), w AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), f AS (
  SELECT kind, id, unnest([array_to_string(w[k : k + n - 1], ' ') FOR k IN range(1, len(w) - n + 2)]) AS f FROM w, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n
), g AS (SELECT kind, id, f, count(*) AS n FROM f GROUP BY kind, id, f
), h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM g)
), b AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, [CAST('0x' || substr(h, CAST(2 * k - 1 AS BIGINT), 2) AS BIGINT) FOR k IN range(1, length(h) // 2 + 1)]), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295) % 10000 AS b FROM h, tab
), n AS (SELECT b, sum(CASE WHEN kind = 'd' THEN n ELSE 0 END) AS s, sum(CASE WHEN kind = 'b' THEN n ELSE 0 END) AS t FROM g JOIN b USING (f) GROUP BY b
), total AS (SELECT CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM n
), gain AS (SELECT n.b, CAST(floor(1000 * ln((n.t + 1.0::DOUBLE) * (total.s + 10000) / ((n.s + 1.0::DOUBLE) * (total.t + 10000)))) AS BIGINT) AS gain FROM n, total
), weight AS (SELECT id, CAST(sum(n * gain) AS BIGINT) AS weight FROM g JOIN b USING (f) JOIN gain USING (b) WHERE kind = 'd' GROUP BY id
), score AS (
  SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS words, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN weight USING (id) WHERE kind = 'd'
), r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY words >= 20) AS able FROM score)
SELECT doc_id, words + greatest(words - 1, 0) + greatest(words - 2, 0) AS n_features, weight, score, CASE WHEN words >= 20 AND place <= 5 * able // 100 THEN place END AS rank FROM r
"""
