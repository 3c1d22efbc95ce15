"""Queries of a corpus's state: identities, quality view, contributions, read views, dates, reachability, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as T
from quillgraph.operators import corpus as C
from quillgraph.operators.graph import graph_of_tables
from quillgraph.plans import sqltext as S
from quillgraph.plans.registry import query
from quillgraph.runtime import cut, table


@query("identity_merge", """
WITH r AS (SELECT l_orderkey AS grp, l_linenumber * 1000000 + l_partkey AS place, CASE WHEN l_linestatus = 'F' THEN '21' || lpad(CAST(l_suppkey % 12 + 1 AS VARCHAR), 2, '0') || '.' || lpad(CAST(l_orderkey % 10000 AS VARCHAR), 5, '0') || 'v' || l_linenumber END AS arxiv, CASE WHEN l_returnflag = 'R' THEN '10.5/' || l_partkey END AS doi,
  CASE WHEN l_tax > 0.05 THEN CAST(l_orderkey AS VARCHAR) END AS pmid, CASE WHEN l_discount = 0.1 THEN 'PMC' || l_suppkey END AS pmcid, CASE WHEN l_linenumber % 2 = 0 THEN 'Order ' || l_orderkey END AS title FROM lineitem),
b AS (SELECT *, regexp_replace(arxiv, 'v[0-9]+$', '') AS base, CAST(regexp_extract(arxiv, 'v([0-9]+)$', 1) AS INTEGER) AS v FROM (SELECT * FROM r)),
o AS (SELECT grp, arg_min(doi, place) FILTER (doi IS NOT NULL) AS doi, arg_min(pmid, place) FILTER (pmid IS NOT NULL) AS pmid, arg_min(pmcid, place) FILTER (pmcid IS NOT NULL) AS pmcid, arg_min(base, place) FILTER (base IS NOT NULL) AS base, arg_min(lower(title), place) FILTER (title IS NOT NULL) AS title,
  count(DISTINCT doi) AS nd, count(DISTINCT pmid) AS np, count(DISTINCT pmcid) AS nc, count(DISTINCT base) AS na FROM b GROUP BY grp),
x AS (SELECT grp, base, arg_max(arxiv, (v, -place)) AS arxiv FROM b WHERE arxiv IS NOT NULL GROUP BY grp, base)
SELECT o.grp, x.arxiv, doi, pmid, pmcid, CASE WHEN o.base IS NOT NULL THEN 'arxiv:' || o.base WHEN doi IS NOT NULL THEN 'doi:' || doi WHEN pmid IS NOT NULL THEN 'pmid:' || pmid WHEN pmcid IS NOT NULL THEN 'pmcid:' || pmcid WHEN title IS NOT NULL THEN 'title:' || title ELSE '' END AS canonical,
  CASE WHEN o.base IS NOT NULL THEN 'arxiv' WHEN doi IS NOT NULL THEN 'doi' WHEN pmid IS NOT NULL THEN 'pmid' WHEN pmcid IS NOT NULL THEN 'pmcid' WHEN title IS NOT NULL THEN 'title' ELSE '' END AS source,
  array_to_string(list_filter([CASE WHEN na > 1 THEN 'arxiv' END, CASE WHEN nd > 1 THEN 'doi' END, CASE WHEN np > 1 THEN 'pmid' END, CASE WHEN nc > 1 THEN 'pmcid' END], lambda z: z IS NOT NULL), ',') AS conflicts FROM o LEFT JOIN x ON x.grp = o.grp AND x.base = o.base
""")  # fmt: skip
def identity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of the records of one paper, merged, with conflicts and the canonical name; a paper is an order, its records its lines (O163)."""
    key, two = F.col("l_orderkey"), lambda c: F.lpad(c.cast("string"), 2, "0")
    arxiv = F.concat(F.lit("21"), two(F.col("l_suppkey") % 12 + 1), F.lit("."), F.lpad((key % 10000).cast("string"), 5, "0"), F.lit("v"), "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        key.alias("grp"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("place"), F.when(F.col("l_linestatus") == "F", arxiv).alias("arxiv"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("10.5/"), "l_partkey")).alias("doi"), F.when(F.col("l_tax") > 0.05, key).cast("string").alias("pmid"),
        F.when(F.col("l_discount") == 0.1, F.concat(F.lit("PMC"), "l_suppkey")).alias("pmcid"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Order "), key)).alias("title"),
    )
    return C.merged_identity(rows)


@query("duplicate_papers")
def duplicate_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stands for each: the same name, size, or first line and source, the longest first (O85). A document without a size is named by its title."""
    d = table(spark, sf_dir, "documents")
    title = T.valid_title(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))
    size = F.concat(F.lit("size:"), "n_chars")
    rows = d.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("score"), (F.col("lang") == "en").alias("markdown"), title.alias("title"), F.when(F.col("source") != "src0", F.array("source")).alias("authors"), F.array(size).alias("ids"))
    name = F.nullif(T.normalize(F.col("title")), F.lit(""))
    rows = rows.withColumn("canonical", F.coalesce(F.get("ids", F.lit(0)), F.concat(F.lit("title:"), name)))
    return C.duplicate_papers(rows)


_QUALITY = """
WITH p AS (SELECT o_orderkey AS paper, CASE WHEN o_orderstatus = 'P' THEN 'untitled' ELSE 'paper ' || o_orderkey END AS title, CASE WHEN o_orderpriority LIKE '5%' THEN 'test' END AS purpose, CASE WHEN o_totalprice > 100000 THEN '2101.' || lpad(CAST(o_custkey AS VARCHAR), 5, '0') || 'v' || (o_orderkey % 3 + 1) END AS arxiv,
  CASE WHEN year(o_orderdate) = 1995 THEN '10.2/' || o_orderkey WHEN year(o_orderdate) > 1995 THEN '10.48550/x' || o_custkey ELSE '10.1/' || o_custkey END AS doi FROM orders),
a AS (SELECT *, array_to_string(list_filter([CASE WHEN title = 'untitled' THEN 'placeholder-title' END, CASE WHEN purpose = 'test' THEN 'test-source' END], lambda z: z IS NOT NULL), ',') AS reasons, CASE WHEN arxiv IS NOT NULL THEN 'arxiv:' || regexp_replace(arxiv, 'v[0-9]+$', '') ELSE 'doi:' || doi END AS key, coalesce(CAST(regexp_extract(arxiv, 'v([0-9]+)$', 1) AS INTEGER), 0) AS v FROM p),
g AS (SELECT key, count(*) AS n, count(DISTINCT doi) FILTER (NOT starts_with(doi, '10.48550/')) AS public, arg_max(paper, (v, -paper)) AS best FROM a WHERE reasons = '' GROUP BY key HAVING count(*) > 1),
s AS (SELECT a.paper, CASE WHEN reasons <> '' THEN 'quarantined' WHEN n IS NULL THEN 'kept' WHEN public > 1 THEN 'conflict' WHEN a.paper = best THEN 'kept' ELSE 'merged' END AS state, CASE WHEN reasons = '' THEN CASE WHEN coalesce(public, 0) <= 1 THEN coalesce(best, a.paper) ELSE a.paper END END AS representative, reasons FROM a LEFT JOIN g ON g.key = a.key AND reasons = '')
"""


def _quality(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key, cust, year = F.col("o_orderkey"), F.col("o_custkey"), F.year("o_orderdate")
    papers = table(spark, sf_dir, "orders").select(
        key.alias("paper"), F.when(F.col("o_orderstatus") == "P", "untitled").otherwise(F.concat(F.lit("paper "), key)).alias("title"), F.when(F.col("o_orderpriority").startswith("5"), "test").alias("purpose"),
        F.when(F.col("o_totalprice") > 100000, F.concat(F.lit("2101."), F.lpad(cust.cast("string"), 5, "0"), F.lit("v"), key % 3 + 1)).alias("arxiv"), F.when(year == 1995, F.concat(F.lit("10.2/"), key)).when(year > 1995, F.concat(F.lit("10.48550/x"), cust)).otherwise(F.concat(F.lit("10.1/"), cust)).alias("doi"),
    )
    return C.quality_view(papers, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("node")))


@query("quality_view", _QUALITY + "SELECT paper, state, representative, reasons FROM s")
def quality_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that are quarantined, merged, kept or in conflict."""
    return _quality(spark, sf_dir)[0]


@query("quality_nodes", _QUALITY + "SELECT l_partkey AS node, CASE WHEN bool_and(state = 'quarantined') THEN 'quarantined' ELSE 'kept' END AS state FROM lineitem JOIN s ON paper = l_orderkey GROUP BY l_partkey")
def quality_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that only quarantined papers own go with them."""
    return _quality(spark, sf_dir)[1]


@query("relation_admission", """
WITH r AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'USES' WHEN 1 THEN 'EXTENDS_METHOD' ELSE 'MENTIONS' END AS type, CASE l_returnflag WHEN 'R' THEN 'comparison' WHEN 'A' THEN 'method' END AS context, CASE WHEN l_tax > 0.06 THEN 'uncertain' ELSE 'fact' END AS status FROM lineitem)
SELECT type, CASE WHEN type <> 'MENTIONS' AND context = 'comparison' THEN 'relation-context-comparison' WHEN type <> 'MENTIONS' AND status = 'uncertain' THEN 'epistemic-status-uncertain' END AS reason, count(*) AS n FROM r GROUP BY ALL
""")  # fmt: skip
def relation_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations by whether they are admitted, and why not."""
    n, flag = F.col("l_linenumber") % 3, F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(F.when(n == 0, "USES").when(n == 1, "EXTENDS_METHOD").otherwise("MENTIONS").alias("type"), F.when(flag == "R", "comparison").when(flag == "A", "method").alias("context"), F.when(F.col("l_tax") > 0.06, "uncertain").otherwise("fact").alias("status"))
    return C.admitted_relations(rows).groupBy("type", "reason").agg(F.count("*").alias("n"))


_LISTS, _FIRSTS = ["titles", "fields", "tags", "mechanisms", "problems", "domains", "challenges", "takeaways", "addressed", "aliases"], ["description", "category"]


def _contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    one = lambda c: F.array(c.cast("string"))
    return line.select(
        F.lit("Method").alias("type"), F.concat_ws(" ", "p_name", "p_size").alias("name"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("place"), F.col("l_discount").alias("confidence"), one(F.concat(F.lit("paper "), F.col("l_orderkey") % 50)).alias("titles"), one(F.col("p_brand")).alias("fields"), one(F.col("p_type")).alias("tags"), one(F.col("l_returnflag")).alias("mechanisms"),
        one(F.col("s_nationkey")).alias("problems"), one(F.col("l_linestatus")).alias("domains"), one(F.year("l_shipdate")).alias("challenges"), one(F.col("l_linenumber")).alias("takeaways"), one(F.month("l_shipdate")).alias("addressed"), F.array(F.upper("p_name")).alias("aliases"),
        F.when(F.col("l_tax") > 0.04, F.concat(F.lit("tax "), F.col("l_linenumber"))).alias("description"), F.when(F.col("l_quantity") > 25, F.col("p_type")).otherwise("").alias("category"),
    )


_SORTED = {"titles": "'paper ' || l_orderkey % 50", "fields": "p_brand", "tags": "p_type", "mechanisms": "l_returnflag", "problems": "CAST(s_nationkey AS VARCHAR)", "domains": "l_linestatus", "challenges": "CAST(year(l_shipdate) AS VARCHAR)", "takeaways": "CAST(l_linenumber AS VARCHAR)", "addressed": "CAST(month(l_shipdate) AS VARCHAR)", "aliases": "upper(p_name)"}
_GLOBAL = f"""
SELECT 'Method' AS type, {S.normalized("p_name || ' ' || p_size")} AS key, {", ".join(f"array_to_string(list_sort(list_distinct(list({v}))), ',') AS {k}" for k, v in _SORTED.items())},
  arg_min('tax ' || l_linenumber, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) FILTER (l_tax > 0.04) AS description, arg_min(p_type, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) FILTER (l_quantity > 25) AS category, max(l_discount) AS confidence, count(*) AS mentions
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL
""".replace("GROUP BY ALL", "GROUP BY 2")


def _flat(df: DataFrame) -> DataFrame:
    return df.select("type", "key", *[F.array_join(c, ",").alias(c) for c in _LISTS], *_FIRSTS, "confidence", "mentions")


@query("global_contributions", _GLOBAL)
def global_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions of one type and name become one node, with ten unions (O108)."""
    return _flat(C.aggregated(_contributions(spark, sf_dir), _LISTS, _FIRSTS))


@query("contribution_delta", _GLOBAL.replace("(l_orderkey, l_linenumber", "(l_orderkey % 4 = 0, l_orderkey, l_linenumber"))
def contribution_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a state and what came later, without the earlier contributions (O109)."""
    rows = _contributions(spark, sf_dir)
    late = F.col("place.l_orderkey") % 4 == 0  # one order in four comes in the second batch
    state = cut(C.aggregated(rows.where(~late), _LISTS, _FIRSTS), "contributions")
    return _flat(C.merged_aggregates(state, C.aggregated(rows.where(late), _LISTS, _FIRSTS), _LISTS, _FIRSTS))


_INDEX = f"""
WITH d AS (SELECT doc_id AS id, {S.content_tokens(S.normalized("coalesce(text, '')"))} AS t FROM documents), o AS (SELECT id, tok, min(place) AS place FROM (SELECT id, unnest(t) AS tok, unnest(range(1, len(t) + 1)) AS place FROM d) GROUP BY ALL),
ix AS (SELECT id, tok AS token FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) <= 64)
"""


@query("token_index", _INDEX + "SELECT token, count(*) AS nodes, min(id) AS first, max(id) AS last FROM ix GROUP BY token")
def token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the first 64 tokens of each document."""
    rows = C.token_index(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return rows.groupBy("token").agg(F.count("*").alias("nodes"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("index_search", _INDEX + f", q AS (SELECT item_id AS query, unnest(list_distinct({S.content_tokens(S.normalized('text'))})) AS token FROM benchmark) SELECT query, id, count(*) AS hits FROM ix JOIN (SELECT DISTINCT * FROM q) q USING (token) GROUP BY query, id")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that share tokens with each benchmark item, by a join with the postings."""
    postings = C.token_index(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return C.search(postings, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text"))


@query("graph_store", S.GRAPH + "SELECT n.type, count(*) AS nodes, min(id) AS first, max(length(name)) AS longest FROM nodes n GROUP BY n.type")
def graph_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph saved by type, loaded again and read through the lite view."""
    import uuid

    from quillgraph.runtime import shared_dir
    from quillgraph.sources import files

    root = f"{shared_dir(spark)}/quillgraph/graph-{uuid.uuid4().hex}"
    files.save_graph(*graph_of_tables(spark, sf_dir), root)
    nodes, _ = files.load_graph(spark, root)
    return files.lite_view(nodes).groupBy("type").agg(F.count("*").alias("nodes"), F.min("id").alias("first"), F.max(F.length("name")).alias("longest"))


@query("brainstorm_view", """
WITH n AS (SELECT p_partkey AS id, ['Problem', 'Method', 'Claim', 'Finding', 'Paper', 'Corpus', 'Dataset'][p_size % 7 + 1] AS type, p_size > 10 AS eligible FROM part)
SELECT type, count(*) AS n, min(id) AS first, max(id) AS last FROM n WHERE eligible AND type NOT IN ('Paper', 'Corpus') GROUP BY type
""")  # fmt: skip
def brainstorm_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that a brainstorm may use, by type."""
    kinds = F.array(*[F.lit(x) for x in ("Problem", "Method", "Claim", "Finding", "Paper", "Corpus", "Dataset")])
    return C.brainstorm_view(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get(kinds, F.col("p_size") % 7).alias("type"), (F.col("p_size") > 10).alias("eligible")))


@query("publication_join", """
WITH h AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_returnflag <> 'N' THEN l_orderkey END AS paper FROM lineitem), p AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y') ELSE 'soon' END AS d, o_orderkey % 3 AS k FROM orders),
q AS (SELECT id, CASE k WHEN 0 THEN d WHEN 1 THEN d || '-01-01' END AS published, CASE k WHEN 0 THEN 3 ELSE 1 END AS precision FROM p WHERE k < 2)
SELECT h.id, h.paper, coalesce(a.published, b.published) AS published, CAST(coalesce(a.precision, b.precision, 0) AS INTEGER) AS precision FROM h LEFT JOIN q a ON a.id = h.id LEFT JOIN q b ON b.id = h.paper
""")  # fmt: skip
def publication_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication dates of search hits, by their own id or their paper's."""
    k = F.col("o_orderkey") % 3
    papers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy")).otherwise("soon").alias("date"))
    hits = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_returnflag") != "N", F.col("l_orderkey")).alias("paper"))
    return C.dated_hits(hits, papers).select("id", "paper", "published", "precision")


@query("method_reachability", """
WITH RECURSIVE x AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem), e AS (SELECT DISTINCT src, dst FROM x WHERE dst IS NOT NULL),
p AS (SELECT p_partkey AS source, p_partkey % (SELECT max(p_partkey) FROM part) + 1 AS target FROM part), w AS (SELECT source, source AS "end", 0 AS hops FROM p UNION SELECT w.source, e.dst, hops + 1 FROM w JOIN e ON e.src = w."end" WHERE hops < 3)
SELECT p.source, p.target, CAST(min(hops) AS INTEGER) AS hops FROM p JOIN w ON w.source = p.source AND w."end" = p.target WHERE hops > 0 GROUP BY p.source, p.target
""")  # fmt: skip
def method_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which methods lead to the next one by key within three edges (O98). An edge joins parts that follow one another in an order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).where("dst is not null")
    part = table(spark, sf_dir, "part")
    top = part.agg(F.max("p_partkey")).first()[0] or 1
    return C.reachable(edges, part.select(F.col("p_partkey").alias("source"), (F.col("p_partkey") % top + 1).alias("target")), 3)


_TASKS = "SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'done' WHEN 'view' THEN 'pending' WHEN 'error' THEN 'failed' ELSE 'done' END AS status, CASE WHEN event_id % 3 = 0 THEN 'queued' ELSE '' END AS stage, ts AS updated, event_id % 5 + 1 AS files, CAST(value * 100 AS BIGINT) AS bytes FROM events"


@query("queue_reservation", f"""
WITH t AS ({_TASKS}), f AS (SELECT * FROM t WHERE status = 'pending' ORDER BY updated, id LIMIT 16), c AS (SELECT *, row_number() OVER (ORDER BY updated, id) AS place, sum(files) OVER (ORDER BY updated, id) AS sf FROM f),
s AS (SELECT *, max(CASE WHEN place > 1 AND sf > 20 THEN 1 ELSE 0 END) OVER (ORDER BY updated, id) AS stopped FROM c) SELECT id, CAST(place AS INTEGER) AS place FROM s WHERE stopped = 0
""")  # fmt: skip
def queue_reservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks that are reserved together within limits of tasks and files; the batch is the feature (O167, O172)."""
    kind, k = F.col("event_type"), F.col("event_id")
    tasks = table(spark, sf_dir, "events").select(k.alias("id"), F.when(kind == "view", "pending").when(kind == "error", "failed").otherwise("done").alias("status"), F.when(k % 3 == 0, "queued").otherwise("").alias("stage"), F.col("ts").alias("updated"), (k % 5 + 1).alias("files"), (F.col("value") * 100).cast("long").alias("bytes"))
    return C.reserved_batch(tasks, 16, 20)


@query("sync_jobs", """
WITH r AS (SELECT event_id AS place, user_id % 40 AS token, 's' || event_id % 7 AS source, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'queued' END AS status, ts FROM events),
j AS (SELECT *, coalesce(sum(CASE WHEN status IN ('completed', 'failed') THEN 1 ELSE 0 END) OVER (PARTITION BY token ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS job FROM r)
SELECT token, CAST(job AS BIGINT) AS job, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, count(*) AS requests, arg_max(status, place) AS status FROM j GROUP BY token, job
""")  # fmt: skip
def sync_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that join the open job of their token (O170, O171)."""
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("place"), (F.col("user_id") % 40).alias("token"), F.array(F.concat(F.lit("s"), F.col("event_id") % 7)).alias("sources"), F.when(kind == "error", "failed").when(kind == "purchase", "completed").otherwise("queued").alias("status"), F.col("ts").alias("at"))
    return C.merged_jobs(rows).select("token", "job", "sources", "requests", "status")


@query("lease_recovery", """
WITH j AS (SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'running' ELSE 'queued' END AS status, user_id AS worker, CASE WHEN event_id % 4 <> 0 THEN ts END AS reserved, ts AS updated, event_id % 3 AS recoveries FROM events), s AS (SELECT *, status = 'running' AND epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(CAST(date_trunc('second', coalesce(reserved, updated)) AS TIMESTAMP)) >= 86400 AS stale FROM j)
SELECT id, CASE WHEN stale THEN 'queued' ELSE status END AS status, CASE WHEN NOT stale THEN worker END AS worker, CAST(recoveries + CASE WHEN stale THEN 1 ELSE 0 END AS BIGINT) AS recoveries, stale AS recovered FROM s
""")  # fmt: skip
def lease_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running jobs whose lease ended a day before a stated time are queued again (O169)."""
    k = F.col("event_id")
    jobs = table(spark, sf_dir, "events").select(k.alias("id"), F.when(F.col("event_type") == "click", "running").otherwise("queued").alias("status"), F.col("user_id").alias("worker"), F.when(k % 4 != 0, F.col("ts")).alias("reserved"), F.col("ts").alias("updated"), (k % 3).alias("recoveries"))
    return C.recovered_jobs(jobs, "2024-01-20 00:00:00", 86400)
