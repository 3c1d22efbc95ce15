"""Queries on event time: windows, as-of and range joins, set operations, and the same windows as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.plans.registry import query
from quillgraph.runtime import shared_dir, table
from quillgraph.streaming import logs


def _stamp(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("tumbling_window", """
SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
""")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by type."""
    out = logs.tumbling(table(spark, sf_dir, "events"), "1 hour", ["event_type"])
    return out.select(_stamp("start").alias("start"), "event_type", "n", "total")


@query("sliding_window", """
WITH e AS (SELECT ts, value, unnest(range(0, 4)) AS k FROM events)
SELECT strftime(time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '15 minutes' * k, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY 1
""")
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that begin every quarter of an hour."""
    return logs.sliding(table(spark, sf_dir, "events"), "1 hour", "15 minutes", []).select(_stamp("start").alias("start"), "n", "total")


@query("session_windows", """
WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session
""")  # fmt: skip
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user with gaps of half an hour."""
    return logs.sessions(table(spark, sf_dir, "events"), "30 minutes", ["user_id"]).select("user_id", _stamp("start").alias("start"), "n", "total")


@query("asof_join", """
SELECT c.event_id, p.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON c.user_id = p.user_id AND c.ts >= p.ts
""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view before each purchase: one union and one window, no pair is formed."""
    e = table(spark, sf_dir, "events").where("event_type in ('purchase', 'view')")
    view = F.col("event_type") == "view"
    w = Window.partitionBy("user_id").orderBy("ts", F.when(view, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(view, F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("view_id", last).where(~view).select("event_id", "view_id")


@query("stale_leases", """
WITH l AS (SELECT user_id, max(ts) AS heartbeat FROM events GROUP BY user_id) SELECT user_id, strftime(heartbeat, '%Y-%m-%d %H:%M:%S') AS heartbeat FROM l WHERE heartbeat < (SELECT max(ts) FROM events) - INTERVAL '6 hours'
""")
def stale_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers whose last heartbeat is older than six hours at the log's end (O91, O169)."""
    e = table(spark, sf_dir, "events")
    end = e.agg(F.max("ts")).first()[0]
    return e.groupBy("user_id").agg(F.max("ts").alias("at")).where(F.col("at") < F.lit(end) - F.expr("interval 6 hours")).select("user_id", _stamp("at").alias("heartbeat"))


@query("set_operations", """
WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
SELECT 'union' AS op, count(*) AS n FROM (FROM a UNION FROM b) UNION ALL SELECT 'intersect', count(*) FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'except', count(*) FROM (FROM a EXCEPT FROM b)
""")  # fmt: skip
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of id sets (O155, O156, O157)."""
    e = table(spark, sf_dir, "events")
    a, b = (e.where(F.col("event_type") == t).select("user_id") for t in ("purchase", "error"))
    ops = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    rows = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, d in ops.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("event_props", """
SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS bucket, count(*) AS n FROM events GROUP BY ALL
""")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON properties by a typed read."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type", F.floor(k / 10).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


@query("source_changes", """
SELECT CASE WHEN c_custkey % 10 = 1 THEN 'added' WHEN c_custkey % 10 = 3 THEN 'removed' WHEN c_custkey % 10 = 5 THEN 'changed' ELSE 'unchanged' END AS state, count(*) AS n FROM customer GROUP BY 1
""")
def source_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change detection of sources against a manifest."""
    from quillgraph.sources.files import source_changes as changes

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source_key"), F.col("c_acctbal").cast("string").alias("fingerprint"), (F.col("c_custkey") % 10).alias("k"))
    found = c.where("k <> 3").select("source_key", F.when(F.col("k") == 5, "other").otherwise(F.col("fingerprint")).alias("fingerprint"))
    return changes(found, c.where("k <> 1").select("source_key", "fingerprint")).groupBy("state").agg(F.count("*").alias("n"))


# ---- the same as streams ----------------------------------------------------------------------------


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream: the folder is the log, the glob picks the table's files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_tumbling", """
SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts from a stream, in complete mode (O166, O168, O173, O174)."""
    out = logs.run_to_table(logs.tumbling(_log(spark, sf_dir), "1 hour", ["event_type"]), "complete")
    last = out.select(_stamp("start").alias("start"), "event_type", "n", "total")
    return last.groupBy("start", "event_type").agg(F.max(F.struct("n", "total")).alias("m")).select("start", "event_type", "m.n", "m.total")


@query("stream_folded_state", """
SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id
""")
def stream_folded_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user state by a custom stateful operator (O176, O177)."""
    out = logs.run_to_table(logs.folded_state(_log(spark, sf_dir)), "update")
    return out.groupBy("user_id").agg(F.max("events").alias("events"), F.max("errors").alias("errors"))


@query("stream_upsert", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest row of each key by idempotent micro-batches (O162, O173)."""
    from quillgraph.runtime import scratch

    target = scratch(spark, "upsert")
    logs.run_to_table(_log(spark, sf_dir), "append", logs.upsert_sink(target))
    return logs.upserted(spark, target).select("user_id", "event_id", "event_type")


@query("event_tail", """
SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events, round(sum(value), 4) AS total FROM events GROUP BY event_type
""")
def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as JSON-lines logs, read as a stream with a cursor in three runs, between which the logs grow (O168)."""
    from quillgraph.runtime import scratch
    from quillgraph.streaming.event_log import event_stream

    e = table(spark, sf_dir, "events")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    root = scratch(spark, "events")
    for k in range(3):  # files that come in between are growth; the tests let files themselves grow
        e.where(F.pmod("event_id", F.lit(3)) == k).select(line.alias("value")).write.mode("append").text(f"{root}/log")
        stream = event_stream(spark, f"{root}/log").select(F.from_json("event", "event_id long, event_type string, value double").alias("e")).select("e.*")
        writer = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.schema("event_id long, event_type string, value double").parquet(f"{root}/out")
    return seen.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"), F.round(F.sum("value"), 4).alias("total"))
