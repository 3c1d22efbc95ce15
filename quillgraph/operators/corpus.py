"""State of a corpus: identities, quality view, contributions, read views, publication dates, reachability, queues.

Null texts and identifiers count as empty; ties are decided by the stated order, so results do not depend on layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import identifiers as I
from quillgraph.functions import text as T
from quillgraph.runtime import cut

#: Identifiers by priority; public DOIs do not begin so; purposes that are no research; relations that adopt; contexts and statuses that do not count.
IDENTIFIERS = ("arxiv", "doi", "pmid", "pmcid")
ARCHIVE_DOI = "10.48550/"
TEST_PURPOSES = ("test", "validation", "benchmark-fixture")
ADOPTION = ("USES", "USES_COMPONENT_METHOD", "COMPONENT_OF", "EXTENDS_METHOD", "IMPROVES_METHOD", "REPLACES_METHOD", "ADAPTS_METHOD", "VARIANT_OF", "SPECIALIZES")
NO_METHOD_CONTEXTS = ("ablation", "comparison", "hypothesis", "background")
NO_FACTS = ("refuted", "hypothesis", "uncertain")
#: Search tokens of a node, characters of a text in the read view, types of the brainstorm view.
NODE_TOKENS, LITE_CHARS = 64, 240
BRAINSTORM = ("Problem", "Method", "Claim", "Finding", "Limitation", "Assumption", "FutureDirection", "ResearchGoal", "Dataset", "Benchmark")


def normalized_identifiers(records: DataFrame) -> DataFrame:
    """The identifier columns in their normal form; null where there is none."""
    forms = {"arxiv": I.arxiv(F.col("arxiv")), "doi": I.doi(F.col("doi")), "pmid": I.pmid(F.col("pmid").cast("string")), "pmcid": I.pmcid(F.col("pmcid"))}
    return records.withColumns({k: F.nullif(v, F.lit("")) for k, v in forms.items()})


def merged_identity(records: DataFrame) -> DataFrame:
    """grp, arxiv, doi, pmid, pmcid, canonical, source, conflicts of records(grp, place, arxiv, doi, pmid, pmcid, title) in the order of place.

    The first value of each identifier wins and others are conflicts; versions of one arXiv paper are no conflict, the latest wins. The canonical
    name is the first identifier by priority, else the title.
    """
    rows = normalized_identifiers(records)
    version = F.coalesce(F.regexp_extract("arxiv", r"v(\d+)$", 1).try_cast("int"), F.lit(0))
    base = F.regexp_replace("arxiv", r"v\d+$", "")
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("place"))).alias(c) for c in ("doi", "pmid", "pmcid")]
    n = [F.countDistinct(c).alias(f"n_{c}") for c in ("doi", "pmid", "pmcid")] + [F.countDistinct(base).alias("n_arxiv")]
    title = F.min_by(F.nullif(T.normalize(F.coalesce("title", F.lit(""))), F.lit("")), F.when(F.coalesce("title", F.lit("")) != "", F.col("place"))).alias("title")
    one = rows.groupBy("grp").agg(*first, *n, title, F.min_by(base, F.when(F.col("arxiv").isNotNull(), F.col("place"))).alias("base"))
    best = rows.withColumn("base", base).where("arxiv is not null").groupBy("grp", "base").agg(F.max_by("arxiv", F.struct(version, -F.col("place"))).alias("arxiv"))
    out = one.join(best, ["grp", "base"], "left")
    canonical, source = F.when(F.col("title").isNotNull(), F.concat(F.lit("title:"), "title")).otherwise(""), F.when(F.col("title").isNotNull(), "title").otherwise("")
    for c in reversed(IDENTIFIERS):
        value = F.col("base") if c == "arxiv" else F.col(c)
        canonical, source = F.when(value.isNotNull(), F.concat(F.lit(f"{c}:"), value)).otherwise(canonical), F.when(value.isNotNull(), c).otherwise(source)
    conflicts = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"n_{c}") > 1, F.lit(c)) for c in IDENTIFIERS])), ",")
    return out.select("grp", "arxiv", "doi", "pmid", "pmcid", canonical.alias("canonical"), source.alias("source"), conflicts.alias("conflicts"))


def duplicate_papers(papers: DataFrame) -> DataFrame:
    """id, keeper of papers(id, score, markdown, title, authors, ids, canonical if there is one): the best papers take their duplicates, in the order of score (100,000 more for Markdown) and id.

    Duplicates share the canonical name or an identifier ``kind:value``, or a title and an author by normal name (or one has no authors), unless they differ in an identifier of
    one kind. Titles that are none (``valid_title``) have to be null. A paper that a better one has taken takes none. Each round decides all papers whose better neighbours are decided. Papers that are
    described alike go as one, since whoever takes the best of them takes all, so a group of copies makes no pairs. Papers with a title and identifiers
    of one kind either share one of these, which links them without the title, or differ in it; so a title tells something only if some of
    its papers have no kind in common, and papers of other titles are described by their identifiers alone. Titles go as digests.
    """
    rank = F.coalesce("score", F.lit(0)) + F.when(F.coalesce("markdown", F.lit(False)), 100_000).otherwise(0)
    empty = F.array().cast("array<string>")
    sorted_ = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, empty))))
    kinds = lambda c: F.array_distinct(F.transform(c, lambda x: F.substring_index(x, ":", 1)))
    named = F.nullif(T.normalize(F.coalesce("title", F.lit(""))), F.lit(""))
    authors = F.filter(F.transform(sorted_("authors"), T.normalize), lambda a: a != "")
    canonical = F.coalesce(F.trim("canonical"), F.lit("")) if "canonical" in papers.columns else F.lit("")
    rows = cut(papers.select("id", rank.alias("rank"), F.coalesce(F.sha2(named, 256), F.lit("")).alias("title"), sorted_(authors).alias("authors"), sorted_("ids").alias("ids"), canonical.alias("canonical")), "duplicates-papers")
    sets = rows.where("title <> ''").select("title", kinds("ids").alias("kinds")).distinct()
    apart = sets.alias("x").join(sets.alias("y"), "title").where(~F.arrays_overlap("x.kinds", "y.kinds")).select("title").distinct()
    open_title = rows.join(apart.withColumn("open", F.lit(True)), "title", "left")
    told = F.coalesce("open", F.lit(False))
    whole = open_title.select("id", "rank", F.when(told, F.col("title")).otherwise("").alias("title"), F.when(told, F.col("authors")).otherwise(empty).alias("authors"), "ids", "canonical")
    alone = F.when((F.col("title") == "") & (F.size("ids") == 0) & (F.col("canonical") == ""), F.col("id"))
    best = whole.groupBy("title", "authors", "ids", "canonical", alone.alias("alone")).agg(F.max_by("id", F.struct("rank", -F.col("id"))).alias("id"), F.max("rank").alias("rank"))
    p = cut(best.select("id", "rank", "title", "authors", "ids", "canonical", "alone"), "duplicates-described")
    named_ = lambda c, key: F.when(F.col(c) != "", F.array(key)).otherwise(empty)
    keys = p.select("id", F.explode(F.array_distinct(F.concat(F.col("ids"), named_("title", F.concat(F.lit("title:"), "title")), named_("canonical", F.col("canonical"))))).alias("key"))
    sides = keys.alias("x").join(keys.alias("y"), "key").where("x.id <> y.id").select(F.col("x.id").alias("id"), F.col("y.id").alias("other")).distinct()
    mine, theirs = p.select("id", "rank", "title", "authors", "ids", "canonical"), p.select(F.col("id").alias("other"), *[F.col(c).alias(f"{c}2") for c in ("rank", "title", "authors", "ids", "canonical")])
    kinds = lambda c: F.transform(c, lambda x: F.substring_index(x, ":", 1))
    shared = F.array_intersect("ids", "ids2")
    conflict = F.size(F.array_except(F.array_intersect(kinds("ids"), kinds("ids2")), kinds(shared))) > 0
    same_title = (F.col("title") != "") & (F.col("title") == F.col("title2")) & ((F.size("authors") == 0) | (F.size("authors2") == 0) | F.arrays_overlap("authors", "authors2"))
    same_name = (F.col("canonical") != "") & (F.col("canonical") == F.col("canonical2"))
    better = (F.col("rank2") > F.col("rank")) | ((F.col("rank2") == F.col("rank")) & (F.col("other") < F.col("id")))
    pairs = cut(sides.join(mine, "id").join(theirs, "other").where(~conflict & ((F.size(shared) > 0) | same_name | same_title) & better).select("id", "other", "rank2"), "duplicates")  # other is the better one
    decided = cut(p.select("id").join(pairs.select("id").distinct(), "id", "left_anti").select("id", F.col("id").alias("keeper")), "duplicates-seeds")
    while True:
        open_ = pairs.join(decided.select("id"), "id", "left_anti").join(decided.select(F.col("id").alias("other"), F.col("keeper").alias("k")), "other", "left")
        state = open_.groupBy("id").agg(F.count_if(F.col("k").isNull()).alias("waiting"), F.max(F.when(F.col("k") == F.col("other"), F.col("rank2"))).alias("top"))
        best = open_.where("k = other").join(state.select("id", "top"), "id").where("rank2 = top").groupBy("id").agg(F.min("other").alias("seed"))
        ready = state.where("waiting = 0").join(best, "id", "left").select("id", F.coalesce("seed", "id").alias("keeper"))
        fresh = cut(ready, "duplicates-round")
        if not fresh.limit(1).count():
            break
        decided = cut(decided.unionByName(fresh), "duplicates-decided")
    on = ["title", "authors", "ids", "canonical"]
    classes = p.join(decided, "id").select(*on, F.col("alone").alias("single"), "keeper")
    return whole.withColumn("single", alone).join(classes.withColumnRenamed("single", "other"), [*on]).where(F.col("single").eqNullSafe(F.col("other"))).select("id", "keeper")


def assessed_papers(papers: DataFrame) -> DataFrame:
    """Adds reasons to papers(paper, title, purpose, arxiv, doi): placeholder or error titles, test sources."""
    checks = [T.title_problem(F.coalesce("title", F.lit(""))), F.when(F.col("purpose").isin(list(TEST_PURPOSES)), "test-source")]
    return papers.withColumn("reasons", F.array_compact(F.array(*checks)))


def quality_view(papers: DataFrame, owned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """papers as (paper, state, representative, reasons) and owned(paper, node) as (node, state).

    Papers with reasons are quarantined, and so are nodes that only they own. Others with one arXiv paper, else one DOI, are merged into the latest
    version (ties by id), unless they have several public DOIs, which is a conflict.
    """
    rows = assessed_papers(papers).withColumns({"arxiv": F.nullif(I.arxiv(F.col("arxiv")), F.lit("")), "doi": F.nullif(I.doi(F.col("doi")), F.lit(""))})
    good = rows.where(F.size("reasons") == 0)
    key = F.when(F.col("arxiv").isNotNull(), F.concat(F.lit("arxiv:"), F.regexp_replace("arxiv", r"v\d+$", ""))).when(F.col("doi").isNotNull(), F.concat(F.lit("doi:"), "doi"))
    version = F.coalesce(F.regexp_extract(F.coalesce("arxiv", F.lit("")), r"v(\d+)$", 1).try_cast("int"), F.lit(0))
    keyed = good.withColumns({"key": key, "version": version})
    groups = keyed.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.countDistinct(F.when(~F.col("doi").startswith(ARCHIVE_DOI), F.col("doi"))).alias("public"), F.max_by("paper", F.struct("version", (-F.col("paper")))).alias("best")).where("n > 1")
    out = rows.join(keyed.select("paper", "key"), "paper", "left").join(groups, "key", "left")
    state = F.when(F.size("reasons") > 0, "quarantined").when(F.col("n").isNull(), "kept").when(F.col("public") > 1, "conflict").when(F.col("paper") == F.col("best"), "kept").otherwise("merged")
    seen = out.select("paper", state.alias("state"), F.when((F.coalesce("public", F.lit(0)) <= 1) & (F.size("reasons") == 0), F.coalesce("best", "paper")).when(F.size("reasons") == 0, F.col("paper")).alias("representative"), F.array_join("reasons", ",").alias("reasons"))
    nodes = owned.distinct().join(seen.select("paper", (F.col("state") == "quarantined").alias("bad")), "paper").groupBy("node").agg(F.when(F.bool_and("bad"), "quarantined").otherwise("kept").alias("state"))
    return seen, nodes


def admitted_relations(relations: DataFrame) -> DataFrame:
    """Adds admitted and reason to relations(type, context, status): adoption is no background, comparison, ablation or hypothesis, and a fact."""
    reason = F.when(F.col("type").isin(list(ADOPTION)) & F.col("context").isin(list(NO_METHOD_CONTEXTS)), F.concat(F.lit("relation-context-"), "context")).when(F.col("type").isin(list(ADOPTION)) & F.col("status").isin(list(NO_FACTS)), F.concat(F.lit("epistemic-status-"), "status"))
    return relations.withColumns({"reason": reason, "admitted": reason.isNull()})


# ---- contributions --------------------------------------------------------------------------------------------


def aggregated(contributions: DataFrame, lists: list[str], firsts: list[str]) -> DataFrame:
    """One node for each (type, normalised name) of contributions(type, name, place, confidence, lists..., firsts...): sorted unions, first values that are there, largest confidence, mentions."""
    key = T.normalize(F.coalesce("name", F.lit("")))
    rows = contributions.where("type is not null and coalesce(name, '') <> ''").withColumn("key", key)
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    return rows.groupBy("type", "key").agg(
        F.min_by("name", "place").alias("name"), *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>")))))).alias(c) for c in lists], *[F.min_by(c, F.when(has(c), F.col("place"))).alias(c) for c in firsts],
        F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.count("*").alias("mentions"), F.min("place").alias("place"),
    )


def merged_aggregates(state: DataFrame, fresh: DataFrame, lists: list[str], firsts: list[str]) -> DataFrame:
    """Two results of ``aggregated`` as one: names and first values of the state come before those of the fresh one."""
    both = state.withColumn("turn", F.lit(0)).unionByName(fresh.withColumn("turn", F.lit(1)))
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    return both.groupBy("type", "key").agg(
        F.min_by("name", "turn").alias("name"), *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists], *[F.min_by(c, F.when(has(c), F.col("turn"))).alias(c) for c in firsts],
        F.max("confidence").alias("confidence"), F.sum("mentions").alias("mentions"), F.min("place").alias("place"),
    )


# ---- read views -------------------------------------------------------------------------------------------------


def search_tokens(c: Column) -> Column:
    """The first 64 different content tokens."""
    return F.slice(F.array_distinct(T.content_tokens(T.normalize(F.coalesce(c, F.lit(""))))), 1, NODE_TOKENS)


def token_index(nodes: DataFrame) -> DataFrame:
    """token, id of nodes(id, text): the postings that a search joins."""
    return nodes.select(F.explode(search_tokens(F.col("text"))).alias("token"), "id").distinct()


def search(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """query, id and hits of the nodes that share tokens with queries(query, text), by a join of tokens with the postings."""
    wanted = queries.select("query", F.explode(F.array_distinct(T.content_tokens(T.normalize(F.coalesce("text", F.lit("")))))).alias("token")).distinct()
    return postings.join(wanted, "token").groupBy("query", "id").agg(F.count("*").alias("hits"))


def brainstorm_view(nodes: DataFrame) -> DataFrame:
    """type, n, first, last of nodes(id, type, eligible) that a brainstorm may use, by type."""
    return nodes.where(F.coalesce("eligible", F.lit(False)) & F.col("type").isin(list(BRAINSTORM))).groupBy("type").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def dated_hits(hits: DataFrame, papers: DataFrame) -> DataFrame:
    """Adds published and precision to hits(id, paper): of the hit itself where it is a paper, else of the paper it belongs to. papers(id, date)."""
    dates = papers.select(F.col("id").alias("pid"), I.date_key(F.col("date")).alias("published"), I.date_precision(F.col("date")).alias("precision")).where("published is not null")
    own = hits.join(dates.withColumnRenamed("pid", "id").withColumnsRenamed({"published": "p1", "precision": "q1"}), "id", "left")
    out = own.join(dates.withColumnsRenamed({"pid": "paper", "published": "p2", "precision": "q2"}), "paper", "left")
    return out.withColumns({"published": F.coalesce("p1", "p2"), "precision": F.coalesce("q1", "q2", F.lit(0))}).drop("p1", "p2", "q1", "q2")


#: Neighbours that one row of lists holds.
LISTED = 1000


def _listed(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, list: the values of rows in lists of about ``LISTED``, so that no row holds all of a large group."""
    parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / LISTED).alias("_parts"))
    return rows.join(parts, keys).groupBy(*keys, F.pmod(F.xxhash64(value), "_parts").alias("_part")).agg(F.collect_list(value).alias("list")).drop("_part")


def reachable(edges: DataFrame, pairs: DataFrame, depth: int = 3) -> DataFrame:
    """source, target, hops of pairs(source, target) that a directed path of at most ``depth`` edges(src, dst) joins; the fewest hops.

    Paths are met in the middle: what a source reaches in half of the steps and what reaches a target in the rest are joined by one edge, as lists, so of three
    steps neither side takes more than one. Pairs that fewer steps join are not looked for again.
    """
    steps = cut(edges.select("src", "dst").distinct(), "reach-edges")
    open_ = cut(pairs.select("source", "target").distinct().where("source is not null and target is not null"), "reach-pairs")
    out = cut(_listed(steps, ["src"], "dst").withColumnRenamed("list", "onward"), "reach-lists")
    ahead, behind, found = [open_.select("source", F.col("source").alias("at")).distinct()], [open_.select("target", F.col("target").alias("at")).distinct()], None
    for hop in range(1, depth + 1):
        back = (hop - 1) // 2
        if hop - 1 - back == len(ahead):
            ahead.append(cut(ahead[-1].join(steps, F.col("at") == F.col("src")).select("source", F.col("dst").alias("at")).distinct(), "reach-ahead"))
        if back == len(behind):
            behind.append(cut(behind[-1].join(steps, F.col("at") == F.col("dst")).select("target", F.col("src").alias("at")).distinct(), "reach-behind"))
        rest = open_ if found is None else open_.join(found, ["source", "target"], "left_anti")
        ends = _listed(rest.join(behind[back], "target"), ["source", "target"], "at")
        tried = ahead[hop - 1 - back].join(ends, "source").join(out, F.col("at") == F.col("src"))
        hit = cut(tried.where(F.arrays_overlap("list", "onward")).select("source", "target").distinct().withColumn("hops", F.lit(hop)), "reach-found")
        found = hit if found is None else found.unionByName(hit)
    return found


# ---- queues -----------------------------------------------------------------------------------------------------


def reserved_batch(tasks: DataFrame, most_tasks: int = 16, most_files: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """id, place of the tasks(id, status, stage, updated, files, bytes) that are reserved together.

    A running task goes first and alone, the oldest; else pending ones that are queued, by age, while files and bytes stay within their limits (the first
    always goes). At most 16; what comes after the first one that does not fit waits.
    """
    most = min(most_tasks, 16)
    running = tasks.where("status = 'running'").orderBy("updated", "id").limit(1).select("id", F.lit(1).alias("place"))
    if running.count():
        return running
    first = tasks.where("status = 'pending' and coalesce(stage, 'queued') in ('', 'queued')").orderBy("updated", "id").limit(most)  # 16 rows at most
    w = Window.orderBy("updated", "id")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    over = F.lit(False)
    for column, limit in (("files", most_files), ("bytes", most_bytes)):
        if limit is not None:
            over = over | (F.sum(F.coalesce(column, F.lit(0))).over(up_to) > limit)
    rows = first.withColumn("place", F.row_number().over(w)).withColumn("over", (F.col("place") > 1) & over)
    return rows.withColumn("stopped", F.max(F.col("over").cast("int")).over(up_to)).where("stopped = 0").select("id", "place")


TERMINAL = ("completed", "failed", "cancelled")


def merged_jobs(requests: DataFrame) -> DataFrame:
    """token, job, sources, requests, updated of requests(place, token, sources, status, at): requests join the open job of their token; after one that ended it a new job begins."""
    by = Window.partitionBy("token").orderBy("place")
    ended = F.coalesce(F.sum(F.col("status").isin(list(TERMINAL)).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = requests.withColumn("job", ended)
    return rows.groupBy("token", "job").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))), ",").alias("sources"), F.count("*").alias("requests"), F.max("at").alias("updated"), F.max_by("status", "place").alias("status"))


def recovered_jobs(jobs: DataFrame, now: str, stale_seconds: int) -> DataFrame:
    """jobs(id, status, worker, reserved, updated, recoveries) with running ones whose lease ended queued again."""
    beat = F.coalesce("reserved", "updated")
    stale = (F.col("status") == "running") & beat.isNotNull() & (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(beat) >= max(1, stale_seconds))
    return jobs.select("id", F.when(stale, "queued").otherwise(F.col("status")).alias("status"), F.when(~stale, F.col("worker")).alias("worker"), (F.coalesce("recoveries", F.lit(0)) + stale.cast("int")).alias("recoveries"), stale.alias("recovered"))
