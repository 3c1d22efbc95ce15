"""Merging in any order, digests, and a log that is changed."""

import hashlib
import random

from pyspark.sql import functions as F

from quillgraph.operators import proposal_graph as G

NODES = "proposal string, id string, type string, title string, text string, status string, label string, properties map<string,string>"
EDGES = "proposal string, id string, src string, dst string, type string, status string, properties map<string,string>"
SLATES = "proposal string, slate string, round string, role string, snapshot string, skip boolean"
ACTIONS = "proposal string, slate string, action string, type string, source string, target string, node struct<id:string,type:string,title:string,text:string>, edge struct<id:string,src:string,dst:string,type:string>, text string, reason string, must_cite boolean"


def start(spark):
    nodes = [(p, f"n{i}", t, "t", f"text {i}", "active", None, {"b": "1", "a": None} if i else None) for p in "pq" for i, t in enumerate(["Problem", "Method", "EvalPlan"])]
    edges = [("p", "e0", "n1", "n0", "supports", "active", None)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def acts(r, n=40):
    out = []
    for i in range(n):
        kind = r.choice([*G.ACTIONS, "unknown"])
        ref = lambda: r.choice(["n0", "n1", "n2", "new1", "nowhere"])
        node = (r.choice(["new1", "new2", None]), r.choice(["Risk", "Repair", "Nothing"]), "title", r.choice(["x", "y"])) if kind == "add_node" else None
        edge = (r.choice([None, "e0", "e1"]), ref(), ref(), r.choice(["supports", "refines", "odd"])) if kind == "add_edge" else None
        out.append((r.choice("pq"), r.choice(["s1", "s2", "bad", "none"]), f"a{i:02d}", kind, ref(), ref(), node, edge, r.choice(["new text", " ", None]), "because", r.choice([True, None])))
    return out


def merged(spark, nodes, edges, rows, digests):
    slates = [(p, s, "1", "" if s == "bad" else "critic", digests[p], False) for p in "pq" for s in ("s1", "s2", "bad")]
    checked = G.checked_actions(spark.createDataFrame(rows, ACTIONS), spark.createDataFrame(slates, SLATES), nodes, spark.createDataFrame(list(digests.items()), "proposal string, digest string"))
    return checked, *G.merge_actions(nodes, edges, checked)


def test_any_order_gives_one_graph(spark):
    nodes, edges = start(spark)
    digests = {r.proposal: r.digest for r in G.graph_digest(nodes, edges).collect()}
    rows, seen, effects = acts(random.Random(1)), set(), set()
    for seed in range(2):
        mixed = random.Random(seed).sample(rows, len(rows)) + rows[:seed]
        checked, n, e, done = merged(spark, nodes.repartition(seed + 1), edges, mixed, digests)
        seen.add(tuple(sorted((r.proposal, r.digest) for r in G.graph_digest(n, e).collect())))
        effects.add(tuple(sorted(map(tuple, done.collect()))))
    assert len(seen) == len(effects) == 1
    assert all(d != digests[p] for p, d in seen.pop())
    errors = {r.error for r in checked.collect()}
    assert {"action_type", "node_type", "missing_target", None} <= errors
    assert {r.slate_error for r in checked.collect()} == {None, "missing_role", "unknown_slate"}


def test_what_actions_do(spark):
    nodes, edges = start(spark)
    digests = {r.proposal: r.digest for r in G.graph_digest(nodes, edges).collect()}
    one = lambda a, kind, target=None, source=None, node=None, edge=None, text=None, cite=None: ("p", "s1", a, kind, source, target, node, edge, text, "why", cite)
    rows = [
        one("a1", "add_node", node=("new1", "Risk", "r", "x")), one("a2", "add_node", node=("new1", "Risk", "r", "other")), one("a3", "add_support_edge", "n0", "new1"), one("a4", "revise_node_text", "n0", text="second"), one("a0", "narrow_claim", "n0", text="first"),
        one("a5", "mark_speculative", "n1"), one("a6", "reject_claim", "n1"), one("a7", "attach_evidence", "n1", text="proof", cite=True), one("a8", "propose_repair", "n2", text="mend"), one("a9", "add_edge", edge=("e0", "n0", "n1", "refines")),
    ]
    _, n, e, done = merged(spark, nodes, edges, rows, digests)
    p = {r.id: r for r in n.where("proposal = 'p'").collect()}
    assert p["n0"].text == "first" and p["n0"].properties == {"previous_text": "text 0", "revision_action": "a0", "narrowed": "true"}
    assert (p["n1"].status, p["n1"].label, p["n1"].properties["label_reason"]) == ("rejected", "rejected", "why")
    assert p["new1"].text == "x" and len(p) == 6
    got = {(r.src, r.type, r.dst) for r in e.collect()}
    proof, repair = next(i for i in p if p[i].type == "EvidenceAttachment"), next(i for i in p if p[i].type == "Repair")
    assert got == {("n1", "supports", "n0"), ("new1", "supports", "n0"), ("n1", "grounded_in", proof), ("n1", "must_cite", proof), (repair, "repairs", "n2")}
    assert dict(done.groupBy("effect").count().collect()) == {"added": 3, "reused": 1, "added_edge": 4, "reused_edge": 1, "updated": 3, "conflict": 1}
    assert G.graph_errors(n, e).count() == 0
    wrong = spark.createDataFrame([("p", "x", "n0", "n1", "grounded_in", "active", None), ("p", "y", "n0", "gone", "supports", "active", None), ("p", "z", "n0", "n1", "odd", "active", None)], EDGES)
    assert {(r.id, r.error) for r in G.graph_errors(n, wrong).collect()} == {("x", "target_type"), ("y", "missing_end"), ("z", "edge_type")}


def test_the_digest_is_that_of_sorted_hashes(spark):
    rows = [("a", hashlib.sha256(str(i).encode()).hexdigest()) for i in range(700)]
    level = [h for _, h in rows]
    for digits in (4, 2, 0):
        parts = {}
        for h in level:
            parts.setdefault(h[:digits], []).append(h)
        level = [k + hashlib.sha256("".join(sorted(v)).encode()).hexdigest() for k, v in parts.items()]
    assert [r.digest for r in G.merkle(spark.createDataFrame(rows, "proposal string, h string").repartition(5)).collect()] == level


def test_a_changed_log_is_found(spark):
    log, chain = [], {}
    for k in range(1, 6):
        for p in ("p", "q", "r"):
            before, row = chain.get(p), (f"{p}{k}", f"g{k}")
            chain[p] = hashlib.sha256(f"{before or G.START}{row[0]}{row[1]}".encode()).hexdigest()
            log.append([p, k, *row, chain[p]])
    schema = "proposal string, round int, actions string, graph string, chain string"
    sound = spark.createDataFrame(log, schema)
    assert {tuple(r) for r in G.verify(sound.repartition(4)).collect()} == {("p", 5, None), ("q", 5, None), ("r", 5, None)}
    changed = sound.withColumn("actions", F.when((F.col("proposal") == "q") & (F.col("round") == 3), "forged").otherwise(F.col("actions"))).where("not (proposal = 'r' and round = 2)")
    assert {tuple(r) for r in G.verify(changed).collect()} == {("p", 5, None), ("q", 5, 3), ("r", 4, 3)}
    one = sound.where("round = 1").select(G.chained(F.lit(None).cast("string"), F.col("actions"), F.col("graph")).alias("c"), "chain").collect()
    assert all(r.c == r.chain for r in one)


def test_actions_are_checked_once_for_all_kinds(spark):
    nodes, edges = start(spark)
    actions = spark.createDataFrame(acts(random.Random(2)), ACTIONS)
    digests = G.graph_digest(nodes, edges)
    slates = digests.select("proposal", F.lit("s1").alias("slate"), F.lit("1").alias("round"), F.lit("critic").alias("role"), F.col("digest").alias("snapshot"), F.lit(False).alias("skip"))
    after, ties, effects = G.merge_actions(nodes, edges, G.checked_actions(actions, slates, nodes, digests))
    for df in (after, ties, effects):
        assert "snapshot" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert any("proposal-actions" in f for f in df.inputFiles())
