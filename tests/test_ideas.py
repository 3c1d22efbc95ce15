"""Ideas against plain Python."""

import random

from quillgraph.operators import ideas as I


def jaccard(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b) / len(a | b) if a and b else 0.0


def test_best_methods_equal_all_pairs(spark):
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    name = lambda: " ".join(r.sample(words, r.randint(0, 3)))
    seeds, methods = [(i, name()) for i in range(40)] + [(99, "")], [(i, name(), r.randint(0, 2)) for i in range(60)]
    got = {x["seed"]: (x["method"], round(x["score"], 9)) for x in I.best_methods(spark.createDataFrame(seeds, "seed int, name string"), spark.createDataFrame(methods, "method int, name string, base int")).collect()}
    want = {}
    for s, n in seeds:
        score, first = max((b + jaccard(n, m), -k) for k, m, b in methods)
        want[s] = (-first, round(score, 9))
    assert got == want
    none = spark.createDataFrame([], "method int, name string, base int")
    assert I.best_methods(spark.createDataFrame(seeds, "seed int, name string"), none).count() == 0


def test_templates(spark):
    methods = spark.createDataFrame([(1, "graph planner", 3, 0), (2, None, 0, 1), (3, "simple cost model", 1, 0)], "method int, name string, uses int, problems int")
    limits = spark.createDataFrame([(10, "cost model", 2), (11, None, 0)], "seed int, name string, papers int")
    remedies = spark.createDataFrame([(11, 2), (11, 2), (11, 77)], "seed int, method int")
    got = {r["seed"]: (r["method"], r["total"]) for r in I.limitation_ideas(limits, remedies, methods).collect()}
    score = lambda r, n, f, e, k, c: round(1.4 * min(5, r) + 1.3 * n + 1.1 * min(5, f) + 1.2 * min(5, e) - 0.9 * k - 0.6 * c, 2)
    assert got == {10: (1, score(2.4 + 3, 4.2, 2 + 2.4, 1.6 + 1.4 + 1.5, 2.1, 2.2)), 11: (2, score(2.4 + 2, 4.2, 2, 1.6, 2.9, 1.5))}
    assert {r["seed"]: r["method"] for r in I.transfer_ideas(limits.select("seed", "name"), methods).collect()} == {10: 1, 11: 1}
    claims = spark.createDataFrame([(1, 0, 0, 0), (2, 2, 1, 1), (3, 2, 1, 0)], "seed int, evidence int, datasets int, metrics int")
    assert {r["seed"]: r["total"] for r in I.evidence_ideas(claims).collect()} == {1: score(4.2, 3.3, 4.1, 3.8, 2.6, 2.5), 3: score(4.2, 3.3, 4.1, 2.0, 1.9, 1.9)}
    problems = spark.createDataFrame([(1, 0), (2, 3)], "seed int, methods int")
    assert [(r["seed"], r["total"]) for r in I.coverage_ideas(problems, False).collect()] == [(1, score(4.1, 3.2, 4.0, 4.2, 1.7, 1.4))]
