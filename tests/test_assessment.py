"""Assessment, verdicts, failures and bounded subgraphs, against plain Python and values worked out by hand."""

import random

import pytest

from quillgraph.operators import assessment as A


def plain_subgraph(nodes, edges, seeds, depth, most):
    """The definition: a queue; from each node its papers, then its edges by id."""
    able = {n: p for n, kind, p in nodes if kind != "Corpus"}
    queue, at, why = [], {}, set()

    def add(n, d):
        if n in at or n not in able:
            return
        if len(at) >= most:
            why.add("maxNodes")
            return
        at[n] = d
        queue.append(n)

    for s in seeds:
        add(s, 0)
    for n in queue:
        near = list(able[n] or []) + [b if a == n else a for _, a, b in sorted(e for e in edges if n in e[1:])]
        for m in near:
            if m in able and m not in at:
                if at[n] >= depth:
                    why.add("maxDepth")
                else:
                    add(m, at[n] + 1)
    return [(n, i, at[n]) for i, n in enumerate(queue)], sorted(why)


@pytest.mark.parametrize("seed", [1, 2])
def test_analysis_subgraph(spark, seed):
    r = random.Random(seed)
    names = [f"n{i:02d}" for i in range(40)]
    nodes = [(n, "Corpus" if r.random() < 0.1 else "Method", r.sample(names, r.randint(0, 2)) or None) for n in names]
    edges = [(f"e{i:03d}", r.choice(names), r.choice(names)) for i in range(60)]
    seeds = r.sample(names, 3) + ["nobody"]
    n = spark.createDataFrame([(a, b, None, p) for a, b, p in nodes], "id string, type string, year int, papers array<string>")
    e = spark.createDataFrame(edges, "id string, src string, dst string")
    for depth, most in ((2, 12), (1, 100), (0, 2)):
        kept, inside, why = A.analysis_subgraph(n, e, seeds, depth, most)
        want, reasons = plain_subgraph(nodes, edges, seeds, depth, most)
        assert sorted(map(tuple, kept.select("id", "place", "depth").collect())) == sorted(want) and why == reasons
        ids = {x for x, _, _ in want}
        assert {x["id"] for x in inside.collect()} == {i for i, a, b in edges if a in ids and b in ids}


def test_chain_and_links(spark):
    p = spark.createDataFrame([("h", "a", "target"), ("h", "b", "target"), ("h", "c", "proxy"), ("g", "d", None)], "hypothesis string, prediction string, role string")
    o = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, False), ("b", 3, None), ("c", 1, True), ("c", 2, True)], "prediction string, run int, valid boolean")
    got = {x["prediction"]: (x["n"], x["status"], x["target_status"]) for x in A.evidence_chain(p, o).collect()}
    assert got == {"a": (2, "observed", "partially_observed"), "b": (2, "unassessable", "partially_observed"), "c": (2, "observed", "partially_observed"), "d": (0, "not_measured", "not_registered")}
    links = spark.createDataFrame([("c", "a"), ("c", "b")], "prediction string, target string")
    assert {(x["target"], x["runs"]) for x in A.proxy_links(links, o).collect()} == {("a", "1"), ("b", "")}


def test_observations(spark):
    names = "id int, run_status string, protocol string, action_design string, hypothesis_design string, reproduced boolean, estimate double, lower double, upper double, low double, high double, ready boolean, verified boolean, reviewed boolean, confirmatory boolean, necessary boolean"
    ok = ("completed", "matched", "testable", "testable", None)
    rows = [
        (1, *ok, 5.0, 4.0, 6.0, 0.0, 9.0, True, True, True, True, True), (2, *ok, 5.0, 4.0, 6.0, 7.0, 9.0, True, True, True, True, True), (3, *ok, 5.0, 4.0, 6.0, 7.0, 9.0, True, True, True, None, True),
        (4, *ok, 5.0, 4.0, 6.0, 5.0, 9.0, True, True, True, True, True), (5, *ok, None, None, None, 5.0, 9.0, True, True, True, True, True), (6, None, None, None, "testable", False, 5.0, 6.0, 4.0, 0.0, 9.0, True, True, True, True, True),
        (7, *ok, 5.0, 4.0, 6.0, 0.0, 9.0, False, True, True, True, True), (8, *ok, 5.0, None, 6.0, 0.0, 9.0, True, True, True, True, True),
    ]
    got = {x["id"]: (x["relation"], x["status"], list(x["reasons"])) for x in A.assessed_observations(spark.createDataFrame(rows, names)).collect()}
    assert got[1] == ("compatible", "compatible", []) and got[2][:2] == ("inconsistent", "excluded_in_scope") and got[3][:2] == ("inconsistent", "weakened_in_scope")
    assert got[4][:2] == ("inconclusive", "inconclusive") and got[5] == ("inconclusive", "unassessable", ["missing_measurement"]) and got[7][:2] == ("compatible", "inconclusive")
    assert got[6][2] == ["run_not_completed", "protocol_unknown", "action_design_incomplete", "baseline_not_reproduced", "invalid_measurement_interval"] and got[8][2] == ["missing_uncertainty_interval"]


def test_performance_claims(spark):
    names = "claim int, evidence_role string, outcome_role string, role string, quantity string, unit string, measured boolean, confirmatory boolean, result string, difference boolean, estimate double, higher boolean"
    row = lambda c, q, result, est=1.0, role="original", outcome="primary", kind="target", conf=True, measured=True: (c, kind, outcome, role, q, "u", measured, conf, result, True, est, True)
    rows = [
        row(1, "a", "meets_target"), row(2, "a", "below_target", -1.0), row(2, "g", "meets_target", outcome="guardrail", role=None), row(3, "a", "below_target", -1.0), row(3, "a", "meets_target", role="control"), row(4, "a", "below_target", -1.0),
        row(5, "a", "meets_target", role="control"), row(6, "a", "meets_target", conf=None), row(7, "a", "meets_target", kind="proxy"), row(8, "a", "inconclusive"), row(9, "a", "meets_target", measured=False),
    ]
    got = {x["claim"]: (x["status"], x["reasons"]) for x in A.performance_claims(spark.createDataFrame(rows, names)).collect()}
    assert got == {
        1: ("improved_in_scope", ""), 2: ("tradeoff", ""), 3: ("partial_recovery", ""), 4: ("below_target_in_scope", ""), 5: ("not_established", "original_target_comparison_missing"),
        6: ("not_established", "target_evidence_not_confirmatory"), 7: ("not_established", "target_outcome_not_registered"), 8: ("inconclusive", ""), 9: ("not_established", "target_outcome_not_measured"),
    }


def test_applied_decisions(spark):
    nodes = spark.createDataFrame([("a", "Method", "Old", ["x", "New"]), ("b", "Method", "B", None), ("c", "Claim", "C", []), ("d", "Claim", None, [])], "id string, type string, name string, aliases array<string>")
    edges = spark.createDataFrame([("a", "b", "USES"), ("a", "b", "USES"), ("a", "c", "USES"), ("a", "zz", "USES")], "src string, dst string, type string")
    said = spark.createDataFrame([("a", 1, "drop", None), ("a", 2, " Rename ", "New"), ("c", 1, "DROP", None), ("b", 1, "rename", None), ("q", 1, "drop", None)], "id string, place int, verdict string, name string")
    out, kept = A.applied_decisions(nodes, edges, said)
    assert {x["id"]: (x["name"], x["aliases"], x["checked"], x["verdict"]) for x in out.collect()} == {"a": ("New", ["x", "Old"], True, "rename"), "b": ("B", [], True, "rename"), "d": (None, [], False, "keep")}
    assert [tuple(x) for x in kept.collect()] == [("a", "b", "USES", 2)]


def test_failures(spark):
    rows = [("p", False, "timed out", None), ("p", False, None, 429), (None, False, "bad request", 400), ("p", True, "x", None), ("p", False, "x", 500), ("p", False, "no auth", None), ("p", False, "?", None), ("p", False, "timed out", None)]
    got = {tuple(x) for x in A.failure_counts(spark.createDataFrame(rows, "provider string, ok boolean, reason string, status int")).collect()}
    assert got == {("p", "network", "timed out", 2), ("p", "rate_limit", "provider-failed", 1), ("unknown", "bad_query", "bad request", 1), ("p", "network", "x", 1), ("p", "auth", "no auth", 1), ("p", "unknown", "?", 1)}


def test_field(spark):
    methods = spark.createDataFrame([(1, 1990, ["p"]), (2, 1995, ["q"]), (3, 1996, ["r"]), (4, None, None), (5, 2010, []), (6, 1991, ["q"]), (7, 1992, [])], "id int, year int, papers array<string>")
    relations = spark.createDataFrame([(1, 1, 2, "ADAPTS_METHOD"), (2, 2, 3, "EXTENDS_METHOD"), (3, 1, 3, "EXTENDS_METHOD"), (4, 3, 4, "REPLACES_METHOD"), (5, 3, 1, "EXTENDS_METHOD"), (6, 4, 5, "EXTENDS_METHOD"), (7, 6, 2, "EXTENDS_METHOD")], "id int, source int, target int, type string")
    none = spark.createDataFrame([], "id string")
    kept, held = A.field_methods(methods, relations, spark.createDataFrame([("p",)], "id string"), none.selectExpr("cast(id as int) id"), 1990, 2000, 2)
    assert {x["id"]: (x["role"], x["depth"]) for x in kept.collect()} == {1: ("core", 0), 2: ("boundary", 1), 3: ("boundary", 1), 4: ("boundary", 2), 6: ("boundary", 2)}
    assert {x["id"] for x in held.collect()} == {1, 2, 3, 4, 7}  # 5 runs against time, 6 leaves the years
    assert {tuple(x) for x in A.turning_points(held).collect()} == {("branch", 1, 2), ("convergence", 2, 2), ("convergence", 3, 2), ("adaptation", 2, 1), ("replacement", 4, 1)}
    assert {tuple(x) for x in A.paper_relations(kept, held).collect()} == {("p", "q", "ADAPTS_METHOD", 1), ("q", "r", "EXTENDS_METHOD", 1), ("p", "r", "EXTENDS_METHOD", 1)}
    assert [tuple(x) for x in A.families(kept, held).collect()] == [("1", 5, "1>2>3>4")]
    loop = spark.createDataFrame([(1, 1, 2, "X"), (2, 2, 1, "X")], "id int, source int, target int, type string")
    assert [tuple(x) for x in A.families(kept, loop).collect()] == [("1", 2, "")]
