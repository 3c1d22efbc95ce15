"""Operators on papers, methods, proposals, candidates and communities, against values worked out by hand."""

import math
import random

from pyspark.sql import functions as F

from quillgraph.operators import bridges as B
from quillgraph.operators import controller as K
from quillgraph.operators import lexical as L
from quillgraph.operators import methods as M
from quillgraph.operators import neighborhoods as N
from quillgraph.operators import papers as P
from quillgraph.operators import proposals as R
from quillgraph.operators import scoring as C
from quillgraph.operators.retrieval import total_before


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_total_before_is_a_running_total(spark):
    r = random.Random(3)
    rows = [(i, r.randint(0, 9)) for i in range(300)]
    df = frame(spark, rows, "k int, v int").repartition(7)
    got = {x["k"]: x["b"] for x in total_before(df, [F.desc("k")], "v", "b").collect()}
    assert got == {k: sum(v for j, v in rows if j > k) for k, _ in rows}
    assert total_before(df.limit(0), [F.desc("k")], "v", "b").count() == 0


def test_lexical_mix_by_hand(spark):
    papers = frame(spark, [(1, "Sparse retrieval", "graph noise", ["x"]), (2, "Dense vectors", "sparse retrieval works", []), (3, None, None, None)], "doc int, title string, abstract string, ids array<string>")
    queries = frame(spark, [(7, "Sparse  retrieval", "method", ["x"]), (8, "", None, None)], "query int, text string, facet string, ids array<string>")
    got = {(r["query"], r["doc"]): r["score"] for r in L.lexical_mix(papers, queries, 5).collect()}
    n, lt, la = 3, 4 / 3, 5 / 3
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    gain = lambda df, length, mean: idf(df) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / mean))
    one = 2.5 + 0 + 1.5 + 1 + 2.25 * 2 * gain(1, 2, lt) + 2 * gain(2, 4, lt + la) + 2.5 + 1.5 + 0 + 2.5
    two = 0 + 1.25 + 1.5 + 0 + 1.5 * 2 * gain(1, 3, la) + 2 * gain(2, 5, lt + la)
    assert got == {(7, 1): round(one, 6), (7, 2): round(two, 6), (7, 3): 0.0}
    assert L.lexical_mix(papers.limit(0), queries).count() == 0 and L.lexical_mix(papers, queries.limit(0)).count() == 0


def test_gold_counts_once_and_misses_are_told(spark):
    kind = "title string, ids array<string>, aliases array<string>"
    ranked = frame(spark, [(1, 1, "A b", ["d1"], []), (1, 2, "A b", ["d1"], []), (1, 3, "other", [], ["al"]), (1, 4, "red green blue", [], [])], f"query int, rank int, {kind}")
    gold = frame(spark, [(1, 10, "zzz", ["d1"], [], 2), (1, 11, "yyy", [], ["al"], 1), (1, 12, "Red  green blue", [], [], None), (1, 13, "red green", [], [], 1), (1, 14, "nothing", [], [], 1), (2, 20, "x", [], [], 1)], f"query int, gold int, {kind}, grade int")
    events = L.rank_events(ranked, gold)
    got = [(r["rank"], r["gold"], r["reason"], r["relevant"], r["grade"]) for r in events.orderBy("rank").collect()]
    assert got == [(1, 10, "identifier", True, 2), (2, 10, "identifier", False, 0), (3, 11, "alias", True, 1), (4, 12, "title_exact", True, 1)]
    missed = {r["gold"]: (r["reason"], r["best_rank"]) for r in L.gold_misses(ranked, gold, events).collect()}
    assert missed == {13: ("weak_title_overlap", 4), 14: ("not_in_candidate_pool", 1), 20: ("no_candidates", None)}


def test_link_metrics_by_hand(spark):
    raw = frame(spark, [("b", "a", 2.0), ("a", "b", 0.1), ("a", "c", 0.5), ("c", "c", 1.0), (None, "a", 1.0), ("d", "a", 0.5)], "source string, target string, score double")
    ranked = L.normalized_predictions(raw)
    assert {(r["pair"], r["score"], r["rank"]) for r in ranked.collect()} == {("a|b", 1.0, 1), ("a|c", 0.5, 2), ("a|d", 0.5, 3)}
    positives = frame(spark, [("a|b", 1990), ("x|y", None), ("a|d", 2005)], "pair string, year int")
    negatives = frame(spark, [("a|c",), ("q|r",)], "pair string")
    r = L.link_metrics(ranked, positives, negatives, 2, 1995).first()
    wins = (1 + 1) + (0 + 0.5) + (0.5 + 1)
    assert (r["hits_at_1"], r["hits_at_k"], r["mrr"], r["pair_accuracy"], r["pairs"], r["missing"], r["leaked"], r["undated"]) == (round(1 / 3, 4), round(1 / 3, 4), round((1 + 1 / 3) / 3, 4), round(wins / 6, 4), 6, 1, 1, 1)


EDGES = [("a", "b", 1.0), ("b", "c", 0.7), ("c", "d", 1.5), ("a", "d", 0.2), ("d", "e", 2.0)]
CLUSTERS = {"a": ("A", "A"), "b": ("A", "A"), "c": ("B", "B"), "d": ("B", "B"), "e": ("C", "C")}
TYPES = {"a": "Method", "b": "Problem", "c": "Method", "d": "Problem", "e": "Method"}


def around(spark):
    edges = frame(spark, EDGES, "a string, b string, weight double")
    labels = frame(spark, [(v, *c) for v, c in CLUSTERS.items()], "node string, community string, cluster string")
    nodes = frame(spark, [(v, v, t, 0.5, 1) for v, t in TYPES.items()], "node string, name string, type string, score double, support int")
    return edges, labels, nodes, frame(spark, [("a",)], "node string")


def test_boundary_latent_and_bridges(spark):
    edges, labels, nodes, seeds = around(spark)
    boundary = N.boundary_nodes(edges, labels, nodes)
    assert {(r["node"], r["score"]) for r in boundary.collect()} == {("b", 2.2), ("c", 2.7), ("d", 4.0)}
    latent = {r["node"]: r["score"] for r in N.latent_neighbors(edges, labels, nodes, seeds, boundary).collect()}
    assert latent == {"b": round(0.5 + 2.1 + 0.6 + 0.6, 3)}  # the link to B weighs .9, under 1.2
    found = {(r["kind"], r["source"], r["target"], r["score"], r["path"]) for r in N.bridges(edges, labels, nodes, seeds).collect()}
    assert found == {("method_method", "a", "c", round(1.7 + 0.9, 3), "a>b>c"), ("method_method", "a", "e", 2.2, "a>d>e")}
    assert N.bridges(edges.limit(0), labels, nodes, seeds).count() == 0


def test_constant_potts_splits_two_cliques():
    clique = lambda names: [(a, b, 1.0) for i, a in enumerate(names) for b in names[i + 1 :]]
    parts = N.cpm_parts([*clique("abcd"), *clique("wxyz"), ("d", "w", 0.1)], 0.8)
    assert len(set(parts.values())) == 2 and len({parts[v] for v in "abcd"}) == 1 and parts["a"] != parts["z"]
    assert len(set(N.cpm_parts(clique("abcd"), 1.4).values())) > 1


def test_similarity_of_texts(spark):
    row = frame(spark, [("Sparse graph", "a sparse graph of tokens", "sparse")], "q string, t string, u string")
    r = row.select(B.similarity(F.col("q"), F.col("t")).alias("x"), B.similarity(F.col("q"), F.col("u")).alias("y"), B.alignment(F.col("q"), F.lit(None).cast("string")).alias("z")).first()
    assert (r["x"], r["y"], r["z"]) == (1.0, 0.5, 0.0)


def test_greedy_batch_weighs_relations_and_coverage(spark):
    kind = "id string, utility double, hard_gate boolean, subproblem string, mechanism string, source_domain string, aspect string, cluster string, tokens array<string>, mechanisms array<string>, bridges array<string>, aspects array<string>"
    row = lambda i, u, gate=False, sub="s", mech="m": (i, u, gate, sub, mech, "d", "p", "c", ["t" + i], [mech], [], ["p"])
    rows = frame(spark, [row("a", 0.9), row("b", 0.8), row("c", 0.7, sub="other"), row("d", 0.75, mech="n"), row("z", 1.0, True)], kind)
    edges = frame(spark, [("a", "d", "CONFLICTS_WITH", 1.0), ("b", "c", "COMPLEMENTS", 0.5)], "a string, b string, type string, confidence double")
    assert [x["id"] for x in K.greedy_batch(rows, edges, 3)] == ["a", "c", "b"]  # c: .62 * .7 + .16; b: .62 * .8 + .04; d: .62 * .75 + .08 - .18
    assert [x["id"] for x in K.top_batch(rows, 2)] == ["a", "b"]
    assert [x["id"] for x in K.mmr_batch(rows, 2)] == ["a", "d"]  # .68 u - .32 sim: b .8 and .5, d .75 and .3, c .7 and .5
    assert K.greedy_batch(rows.limit(0), edges) == []


def test_mmr_prefers_what_differs(spark):
    kind = "id string, utility double, hard_gate boolean, source_domain string, tokens array<string>, mechanisms array<string>, bridges array<string>, aspects array<string>"
    rows = frame(spark, [("a", 0.9, False, "d", ["x"], ["m"], ["q"], ["p"]), ("b", 0.89, None, "d", ["x"], ["m"], ["q"], ["p"]), ("c", 0.6, False, "e", ["y"], ["n"], [], [])], kind)
    assert [x["id"] for x in K.mmr_batch(rows, 2)] == ["a", "c"]  # .68 * .89 - .32 * 1 against .68 * .6


def test_beam_counts_why_hits_go(spark):
    hits = frame(spark, [("s", 1, 1, "p", "paper"), ("s", 1, 2, "n", "node"), ("s", 1, 3, "q", "paper"), ("s", 2, 1, "p", "paper"), ("s", 2, 2, "r", "paper"), ("s", 2, 3, "r", "paper")], "subproblem string, query int, place int, id string, scope string")
    got = [r["outcome"] for r in K.beam_search(hits, 2).orderBy("query", "place").collect()]
    assert got == ["kept", "non_paper_scope", "kept", "duplicate_paper", "beam_width_limit", "beam_width_limit"]


def test_maturity_of_a_whole_proposal(spark):
    types = [*R.REQUIRED, "StoryBeat"]
    nodes = [(1, i, t, False, t == "NoveltyClaim", t == "Risk", False, True) for i, t in enumerate(types)] + [(2, 0, "Problem", False, True, False, False, False), (3, 0, "Risk", True, True, True, False, False)]
    edges = [(1, i, i + 1, "FALSIFIED_BY" if i == 0 else "OVERLAPS_PRIOR" if i == 1 else "SUPPORTS", False) for i in range(6)] + [(1, 4, 0, "GROUNDED_IN", False), (1, 0, 6, "REPAIRS", False), (2, 0, 0, "CONTRADICTS", False)]
    out = {r["proposal"]: r for r in R.maturity(frame(spark, nodes, "proposal int, node int, type string, rejected boolean, supported boolean, high boolean, limited boolean, ready boolean"), frame(spark, edges, "proposal int, src int, dst int, type string, rejected boolean")).collect()}
    assert out[1]["status"] == "committed" and out[1]["completeness"] == out[1]["grounding"] == out[1]["readiness"] == 1
    assert out[2]["status"] == "continue" and out[2]["grounding"] == 0 and out[2]["contradiction_load"] == 0.3333
    assert out[3]["completeness"] == 0 and "required_subgraph_not_connected" in out[3]["blocking"]


def test_validation_reasons(spark):
    nodes = frame(spark, [(1, "Method", 2000), (2, "Method", 1990), (3, "Paper", 1980)], "node int, type string, year int")
    edges = frame(spark, [(1, 1, 2, "EXTENDS_METHOD", "accepted", "q", None), (2, 2, 1, "EXTENDS_METHOD", "accepted", " ", False), (3, 1, 9, "X", None, "q", True), (4, 3, 1, "X", "validated", "q", True)], "edge int, source int, target int, type string, status string, quote string, exact boolean")
    got = {r["edge"]: list(r["reasons"]) for r in M.validate_edges(edges, nodes).collect()}
    assert got == {1: [], 2: ["missing_exact_quote", "quote_not_exact_match", "reverse_temporal_direction"], 3: ["non_method_endpoint", "not_accepted_or_validated"], 4: ["non_method_endpoint"]}
    assert {r["edge"] for r in M.validate_edges(edges, nodes, True).where("accepted").collect()} == {1}


def test_mechanisms_merge_by_their_words(spark):
    rows = frame(spark, [(1, "Sparse attention mechanism", 1, 1), (2, "sparse-attention module", 2, 0), (3, "Strategy", 0, 0), (4, "Other", None, None)], "node int, name string, papers int, nodes int")
    merged = M.merged_mechanisms(rows)
    assert {(r["node"], r["keeper"]) for r in merged.collect()} == {(1, 2), (2, 2), (3, 3), (4, 4)}
    edges = frame(spark, [(1, "T", 2), (1, "T", 4), (2, "T", 4), (3, "T", 3)], "src int, type string, dst int")
    assert {tuple(r) for r in M.remapped(edges, merged).collect()} == {(2, "T", 4), (3, "T", 3)}


def test_mentions_contexts_and_spans(spark):
    text = "First one. It holds [1, 3-5] and [7-40]. See (Smith et al. 2019; Lee 2020b) too. (no year)"
    docs = frame(spark, [(1, text), (2, None), (3, "")], "doc int, text string")
    assert {(r["raw"], r["reference"]) for r in P.citation_mentions(docs).collect()} == {("[1]", "1"), ("[3]", "3"), ("[4]", "4"), ("[5]", "5"), ("Smith et al. 2019", "al 2019"), ("Lee 2020b", "lee 2020b")}
    got = {(r["raw"], r["context"]) for r in P.citation_contexts(docs).collect()}
    window = "First one. It holds [1, 3-5] and [7-40]. See (Smith et al."  # a digit after a full stop begins a sentence
    assert got == {("[1, 3-5]", window), ("[7-40]", window), ("(Smith et al. 2019; Lee 2020b)", "First one.")}
    spans = docs.withColumn("spans", F.array(F.struct(F.lit(12).alias("start"), F.lit(14).alias("end"), F.lit("r").alias("ref")), F.struct(F.lit(9000).alias("start"), F.lit(9001).alias("end"), F.lit("s").alias("ref"))))
    out = {r["ref"]: (r["pos"], r["context"]) for r in P.span_contexts(spans).collect()}
    assert out["r"][0] == 1 and out["r"][1].startswith("First one. It holds") and out["s"][1].endswith("(no year)")


def test_claims_take_the_best_evidence_near(spark):
    text = "A plain start of text here. We show that sparse adapters improve accuracy on many tasks. Results reach 93.1 % on the benchmark. Nothing more to say of it."
    rows = P.claims(frame(spark, [(1, 0, "results", text), (1, 1, "results", text), (2, 0, "body", None)], "doc int, section int, role string, text string")).collect()
    first = next(r for r in rows if r["pos"] == 1)
    assert first["section"] == 0 and first["evidence_at"] == 1 and len({(r["doc"], r["pos"]) for r in rows}) == len(rows)


def test_claim_metrics_by_hand(spark):
    said = frame(spark, [(1, 1, "sparse adapters help", "finding"), (1, 2, "something else entirely", "method")], "paper int, id int, text string, type string")
    gold = frame(spark, [(1, 5, "sparse adapters help much", "finding"), (1, 6, "sparse adapters help", "method"), (2, 7, "x y", "method")], "paper int, gold int, text string, type string")
    out = {r["paper"]: r for r in P.claim_metrics(said, gold).collect()}
    assert (out[1]["precision"], out[1]["recall"], out[1]["type_accuracy"]) == (0.5, 0.5, 1.0) and out[2]["recall"] == out[2]["f1"] == 0


def test_scientific_tokens(spark):
    r = frame(spark, [("Studies of Tokenization, training papers’ naïve speeds",)], "t string").select(P.scientific_tokens(F.col("t")).alias("k")).first()
    assert list(r["k"]) == ["tokenize", "train", "naive", "speed", "tokenize_train", "train_naive", "naive_speed"]  # study and paper carry nothing


def test_utility_and_patterns(spark):
    rows = frame(spark, [(1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, "keep", False, False), (2, 0.1, 0.5, 0.3, None, 0.0, 0.5, 0.9, "keep", False, False), (3, 1.0, 0.5, 1.0, 0.0, 0.0, 1.0, 0.0, "keep", True, False)], "id int, evidence double, mechanism double, feasibility double, novelty double, preference double, readiness double, risk double, verdict string, far boolean, bridged boolean")
    got = {r["id"]: (r["utility"], r["hard_gate"], r["needs_evidence"]) for r in C.candidate_utility(rows).collect()}
    assert got[1] == (1.0, False, False) and got[2] == (round(0.07 + 0.028 + 0.12 + 0.054 + 0.06 - 0.144, 3), True, True) and got[3][1:] == (True, True)
    cards = [{"pattern": "b", "kinds": ["k"], "types": [], "terms": ["cost", "slow"]}, {"pattern": "a", "kinds": ["k"], "types": ["t"], "terms": []}, {"pattern": "c", "kinds": [], "types": [], "terms": ["cost"]}]
    gaps = frame(spark, [(1, "k", "t", "Cost is high and SLOW"), (2, "x", "y", None)], "gap int, kind string, type string, text string")
    assert [(r["gap"], r["pattern"], r["score"], r["place"]) for r in C.pattern_matches(gaps, cards).collect()] == [(1, "a", 0.6, 1), (1, "b", 0.43, 2)]
