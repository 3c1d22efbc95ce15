"""Graphs of proposals: slates of actions checked, merged and hashed, for all proposals at once.

Actions of a round are merged by what they say, not by when they come: new nodes and edges are sets by id, of several revisions of a text the one with the smallest action counts and
the others are conflicts, a claim that any action rejects is rejected. So any order of the actions gives the same graph. The graph's digest is a Merkle hash: every node
and edge is hashed by its fields with sorted properties; the sorted hashes are joined and hashed by their first four hex digits, then by the first two, then as a whole, so that no
step sorts more than a share of a proposal's elements. Order and partitions play no part in it.

A log keeps, for each round of a proposal, the digest of its actions and that of the graph after it, and a chain: the hash of the chain before and both digests. ``verify`` runs along
the log once, in the order of rounds, and names the first entry that does not follow.

nodes(proposal, id, type, title, text, status, label, properties map<string,string>); edges(proposal, id, src, dst, type, status, properties); slates(proposal, slate, round, role, snapshot, skip);
actions(proposal, slate, action, type, source, target, node struct<id,type,title,text>, edge struct<id,src,dst,type>, text, reason, must_cite).

Cases: a proposal without nodes and edges has the digest of nothing; null fields hash as empty; repeated nodes and actions count once; actions of unknown slates or of slates that are skipped or wrong are not merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.runtime import cut

#: Types of nodes and edges, what an edge's ends must be, and actions by what they need.
NODE_TYPES = ("Problem", "Hypothesis", "Mechanism", "Method", "EvidenceNeed", "EvidenceAttachment", "NoveltyClaim", "EvalPlan", "Risk", "Assumption", "Repair", "StoryBeat")
EDGE_TYPES = ("supports", "contradicts", "depends_on", "requires_evidence", "repairs", "refines", "transfers_from", "overlaps_prior", "evaluated_by", "falsified_by", "grounded_in", "must_cite", "storyline_next")
TARGET_TYPE = {"grounded_in": "EvidenceAttachment", "must_cite": "EvidenceAttachment", "evaluated_by": "EvalPlan", "falsified_by": "EvalPlan", "storyline_next": "StoryBeat"}
SOURCE_TYPE = {"repairs": "Repair", "storyline_next": "StoryBeat"}
PAIRS = {"add_support_edge": "supports", "add_contradiction_edge": "contradicts", "add_dependency_edge": "depends_on"}
#: Actions that add a node of a type beside a target, by an edge of a type; a repair points at its target, the others are pointed at.
BESIDE = {"attach_evidence": ("EvidenceAttachment", "grounded_in"), "add_prior_overlap": ("EvidenceAttachment", "overlaps_prior"), "add_eval_plan": ("EvalPlan", "evaluated_by"), "add_falsifier": ("EvalPlan", "falsified_by"), "propose_repair": ("Repair", "repairs")}
TEXTS, MARKS = ("revise_node_text", "narrow_claim"), ("mark_speculative", "reject_claim")
ACTIONS = ("add_node", "add_edge", *PAIRS, *BESIDE, *TEXTS, *MARKS, "skip")
NODE = ("id", "type", "title", "text", "status", "label", "properties")
EDGE = ("id", "src", "dst", "type", "status", "properties")
START = hashlib.sha256(b"proposal").hexdigest()


def _of(table: dict, key: Column) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()], F.lit(None).cast("string"))


def _element(kind: str, fields: tuple[str, ...]) -> Column:
    props = F.array_join(F.array_sort(F.transform(F.map_entries(F.coalesce("properties", F.create_map().cast("map<string,string>"))), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit(""))))), "\x1e")
    return F.sha2(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields if c != "properties"], props), 256)


def merkle(hashes: DataFrame, key: str = "proposal") -> DataFrame:
    """key, digest of hashes(key, h): sorted and joined by four hex digits, by two, and as a whole."""
    rows = hashes
    for digits in (4, 2, 0):
        rows = rows.groupBy(key, F.substring("h", 1, digits).alias("_p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("_d")).select(key, F.concat("_p", "_d").alias("h"))
    return rows.select(key, F.col("h").alias("digest"))


def graph_digest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """proposal, digest of each graph."""
    n = nodes.select("proposal", _element("node", NODE).alias("h")).distinct()
    return merkle(n.unionByName(edges.select("proposal", _element("edge", EDGE).alias("h")).distinct()))


def graph_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """proposal, id, error of nodes of unknown type and of edges without ends or between types that they may not join."""
    bad = nodes.where(~F.coalesce(F.col("type").isin(*NODE_TYPES), F.lit(False))).select("proposal", "id", F.lit("node_type").alias("error"))
    end = lambda c: nodes.select("proposal", F.col("id").alias(c), F.col("type").alias(f"{c}_type")).dropDuplicates(["proposal", c])
    e = edges.join(end("src"), ["proposal", "src"], "left").join(end("dst"), ["proposal", "dst"], "left")
    kind = F.col("type")
    wrong = F.when(~F.coalesce(kind.isin(*EDGE_TYPES), F.lit(False)), "edge_type").when(F.col("src_type").isNull() | F.col("dst_type").isNull(), "missing_end").when(_of(SOURCE_TYPE, kind) != F.col("src_type"), "source_type").when(_of(TARGET_TYPE, kind) != F.col("dst_type"), "target_type")
    return bad.unionByName(e.select("proposal", "id", wrong.alias("error")).where("error is not null"))


def checked_actions(actions: DataFrame, slates: DataFrame, nodes: DataFrame, digests: DataFrame) -> DataFrame:
    """The actions, once each, with ``slate_error`` and ``error`` (null where there is none). A slate must name round, role and the graph's digest; an action's ends must be in the graph or be added by its slate."""
    s = slates.join(digests, "proposal", "left")
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    slate_error = F.when(blank("round"), "missing_round").when(blank("role"), "missing_role").when(~F.coalesce(F.col("snapshot") == F.col("digest"), F.lit(False)), "other_snapshot").when(F.coalesce("skip", F.lit(False)), "skipped")
    a = actions.dropDuplicates(["proposal", "slate", "action"]).join(s.select("proposal", "slate", "round", "role", slate_error.alias("slate_error"), F.lit(True).alias("_slate")), ["proposal", "slate"], "left")
    a = a.withColumn("slate_error", F.when(F.col("_slate").isNull(), "unknown_slate").otherwise(F.col("slate_error"))).drop("_slate")
    kind = F.col("type")
    src, dst = F.when(kind == "add_edge", F.coalesce("edge.src", "source")).otherwise(F.col("source")), F.when(kind == "add_edge", F.coalesce("edge.dst", "target")).otherwise(F.col("target"))
    a = a.withColumns({"_src": src, "_dst": dst})
    planned = a.where("type = 'add_node' and node.id is not null").select("proposal", "slate", F.col("node.id").alias("id"))
    have = nodes.select("proposal", "id").distinct()
    for c in ("_src", "_dst"):
        a = a.join(have.select("proposal", F.col("id").alias(c), F.lit(True).alias(f"{c}_in")), ["proposal", c], "left").join(planned.select("proposal", "slate", F.col("id").alias(c), F.lit(True).alias(f"{c}_new")).distinct(), ["proposal", "slate", c], "left")
        a = a.withColumn(f"{c}_ok", F.coalesce(f"{c}_in", f"{c}_new", F.lit(False))).drop(f"{c}_in", f"{c}_new")
    pair, one = kind.isin("add_edge", *PAIRS), kind.isin(*BESIDE, *TEXTS, *MARKS)
    error = (
        F.when(~F.coalesce(kind.isin(*ACTIONS), F.lit(False)), "action_type").when((kind == "add_node") & ~F.coalesce(F.col("node.type").isin(*NODE_TYPES), F.lit(False)), "node_type").when((kind == "add_edge") & ~F.coalesce(F.col("edge.type").isin(*EDGE_TYPES), F.lit(False)), "edge_type")
        .when(pair & ~F.col("_src_ok"), "missing_source").when((pair | one) & ~F.col("_dst_ok"), "missing_target")
    )
    return a.withColumn("error", error).drop("_src_ok", "_dst_ok")


def _made(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 18))


def merge_actions(nodes: DataFrame, edges: DataFrame, checked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes and edges after the valid actions of a round, and effects(proposal, action, effect): added, reused, updated, conflict."""
    # read by each kind of action, so checked once and not once a kind
    ok = cut(checked.where("error is null and slate_error is null and type <> 'skip'"), "proposal-actions")
    none, active = F.lit(None).cast("string"), F.lit("active")
    kind = F.col("type")
    props = lambda *x: F.map_filter(F.create_map(*x), lambda k, v: v.isNotNull())
    fresh = ok.where("type = 'add_node'").select("proposal", "action", F.coalesce("node.id", _made("node", F.col("node.type"), F.col("node.title"), F.col("node.text"))).alias("id"), F.col("node.type").alias("type"), F.col("node.title").alias("title"), F.col("node.text").alias("text"), props(F.lit("role"), F.col("role")).alias("properties"), F.lit(0).alias("_order"))
    beside = ok.where(kind.isin(*BESIDE)).select("proposal", "action", "_dst", "must_cite", kind.alias("_kind"), F.coalesce("node.id", _made("node", _of({k: v[0] for k, v in BESIDE.items()}, kind), F.col("action"))).alias("id"), _of({k: v[0] for k, v in BESIDE.items()}, kind).alias("type"), F.col("node.title").alias("title"), F.coalesce("node.text", "text").alias("text"), props(F.lit("role"), F.col("role"), F.lit("falsifier"), F.when(kind == "add_falsifier", "true")).alias("properties"), F.lit(1).alias("_order"))
    added = fresh.unionByName(beside.select(fresh.columns))
    known = nodes.select("proposal", "id").distinct().withColumn("_known", F.lit(True))
    first = added.withColumn("_n", F.row_number().over(Window.partitionBy("proposal", "id").orderBy("_order", "action"))).join(known, ["proposal", "id"], "left")
    new = first.where("_n = 1 and _known is null").select("proposal", "id", "type", "title", "text", active.alias("status"), none.alias("label"), "properties")
    pairs = ok.where(kind.isin("add_edge", *PAIRS)).select("proposal", "action", F.col("_src").alias("src"), F.col("_dst").alias("dst"), F.coalesce(_of(PAIRS, kind), "edge.type").alias("type"), F.col("edge.id").alias("id"))
    repair = F.col("_kind") == "propose_repair"
    ties = beside.select("proposal", "action", F.when(repair, F.col("id")).otherwise(F.col("_dst")).alias("src"), F.when(repair, F.col("_dst")).otherwise(F.col("id")).alias("dst"), _of({k: v[1] for k, v in BESIDE.items()}, F.col("_kind")).alias("type"), none.alias("id"))
    cites = beside.where("must_cite and type = 'EvidenceAttachment'").select("proposal", "action", F.col("_dst").alias("src"), F.col("id").alias("dst"), F.lit("must_cite").alias("type"), none.alias("id"))
    drawn = pairs.unionByName(ties).unionByName(cites).withColumn("id", F.coalesce("id", _made("edge", F.col("src"), F.col("type"), F.col("dst"))))
    known_edges = edges.select("proposal", "id").distinct().withColumn("_known", F.lit(True))
    first_edge = drawn.withColumn("_n", F.row_number().over(Window.partitionBy("proposal", "id").orderBy("action"))).join(known_edges, ["proposal", "id"], "left")
    new_edges = first_edge.where("_n = 1 and _known is null").select("proposal", "id", "src", "dst", "type", active.alias("status"), F.create_map().cast("map<string,string>").alias("properties"))
    texts = ok.where(kind.isin(*TEXTS)).select("proposal", "action", F.col("_dst").alias("id"), F.nullif(F.trim("text"), F.lit("")).alias("said"), (kind == "narrow_claim").alias("narrow")).withColumn("_n", F.row_number().over(Window.partitionBy("proposal", "id").orderBy("action")))
    said = texts.where("_n = 1").select("proposal", "id", "said", "narrow", F.col("action").alias("_by"))
    marks = ok.where(kind.isin(*MARKS)).groupBy("proposal", F.col("_dst").alias("id")).agg(F.bool_or(kind == "reject_claim").alias("rejected"), F.min_by("reason", F.struct((kind != "reject_claim").alias("o"), "action")).alias("why"))
    every = nodes.select("proposal", *NODE).dropDuplicates(["proposal", "id"]).unionByName(new)
    rows = every.join(said, ["proposal", "id"], "left").join(marks, ["proposal", "id"], "left")
    more = props(F.lit("previous_text"), F.when(F.col("_by").isNotNull(), F.coalesce("text", F.lit(""))), F.lit("revision_action"), F.col("_by"), F.lit("narrowed"), F.when(F.col("narrow"), "true"), F.lit("label_reason"), F.col("why"))
    old = F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(more, k))
    out = rows.select("proposal", "id", "type", "title", F.coalesce("said", "text").alias("text"), F.when(F.col("rejected"), "rejected").otherwise(F.col("status")).alias("status"), F.when(F.col("rejected"), "rejected").when(F.col("rejected").isNotNull(), "speculative").otherwise(F.col("label")).alias("label"), F.map_concat(old, more).alias("properties"))
    effect = lambda df, e: df.select("proposal", "action", e.alias("effect"))
    effects = (
        effect(first, F.when((F.col("_n") == 1) & F.col("_known").isNull(), "added").otherwise("reused")).unionByName(effect(first_edge, F.when((F.col("_n") == 1) & F.col("_known").isNull(), "added_edge").otherwise("reused_edge")))
        .unionByName(effect(texts, F.when(F.col("_n") == 1, "updated").otherwise("conflict"))).unionByName(effect(ok.where(kind.isin(*MARKS)), F.lit("updated")))
    )
    return out, edges.select("proposal", *EDGE).dropDuplicates(["proposal", "id"]).unionByName(new_edges), effects


def action_digest(checked: DataFrame) -> DataFrame:
    """proposal, digest of the actions that were merged."""
    ok = checked.where("error is null and slate_error is null")
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("action", "type", "_src", "_dst", "text", "reason", "must_cite")] + [F.coalesce(F.to_json(c), F.lit("")) for c in ("node", "edge")]
    return merkle(ok.select("proposal", F.sha2(F.concat_ws("\x1f", *fields), 256).alias("h")).distinct())


def chained(before: Column, actions: Column, graph: Column) -> Column:
    """The chain after a round."""
    return F.sha2(F.concat(F.coalesce(before, F.lit(START)), F.coalesce(actions, F.lit("")), F.coalesce(graph, F.lit(""))), 256)


def verify(log: DataFrame) -> DataFrame:
    """proposal, rounds, broken (the first round whose chain does not follow, or null) of log(proposal, round int, actions, graph, chain). Rows run by in order; nothing of a proposal is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain, rounds, broken, out = None, START, 0, None, []
        for batch in batches:
            for proposal, k, actions, graph, said in zip(*(batch.column(c).to_pylist() for c in ("proposal", "round", "actions", "graph", "chain"))):
                if proposal != now:
                    if rounds:
                        out.append((now, rounds, broken))
                    now, chain, rounds, broken = proposal, START, 0, None
                chain, rounds = hashlib.sha256(f"{chain}{actions or ''}{graph or ''}".encode()).hexdigest(), rounds + 1
                if broken is None and chain != said:
                    broken = k
        if rounds:
            out.append((now, rounds, broken))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, (pa.string(), pa.int64(), pa.int32()))], ["proposal", "rounds", "broken"])

    rows = log.select(F.col("proposal").cast("string").alias("proposal"), F.col("round").cast("int").alias("round"), "actions", "graph", "chain")
    return rows.repartition("proposal").sortWithinPartitions("proposal", "round").mapInArrow(run, "proposal string, rounds long, broken int")
