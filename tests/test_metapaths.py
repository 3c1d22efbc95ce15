"""Counts of typed paths against enumeration, with a hub."""

import random
from itertools import product

from quillgraph.operators import metapaths as P


def graph(r, n=12, m=60):
    return [(f"n{r.randrange(n)}", f"n{r.randrange(n)}", r.choice("ABC")) for _ in range(m)] + [("hub", f"n{i}", "A") for i in range(n)] + [(f"n{i}", "hub", "A") for i in range(n)] * 2


def test_chains_are_counted_as_enumerated(spark):
    r = random.Random(3)
    edges = graph(r)
    allowed = [f"n{i}" for i in range(0, 12, 2)] + ["hub"]
    steps = [(["A"], "out", None), (["A", "B"], "in", allowed), (["A", "C"], "out", None), (["A"], "out", None)]
    walks = {("hub", "hub"): 1, ("n1", "n1"): 1}
    for types, way, may in steps:
        then = {}
        for (start, at), n in walks.items():
            for a, b, t in edges:
                x, y = (a, b) if way == "out" else (b, a)
                if x == at and t in types and (may is None or y in may):
                    then[start, y] = then.get((start, y), 0) + n
        walks = then
    frame = spark.createDataFrame([(x,) for x in allowed], "id string")
    got = P.path_counts(spark.createDataFrame(edges, "src string, dst string, type string"), spark.createDataFrame([("hub",), ("n1",), ("hub",)], "id string"), [(t, w, frame if m else None) for t, w, m in steps])
    assert {(x.start, x.node): int(x.n) for x in got.collect()} == walks
    assert max(walks.values()) > 400


def made(r):
    nodes = [(f"i{i}", f"name {i % 7}", r.choice(["Method", "Problem"])) for i in range(20)] + [("hub", "a hub", "Method")]
    supports = [(f"m{r.randrange(4)}", f"i{r.randrange(22)}", "method") for _ in range(40)] + [(f"m{i}", "hub", "method") for i in range(4)] * 2
    domains = [(f"i{r.randrange(22)}", r.choice(["x", "y", "z", None])) for _ in range(40)] + [("hub", d) for d in "xyz"]
    papers = [(f"i{r.randrange(22)}", f"p{r.randrange(9)}") for _ in range(60)] + [("hub", f"p{i}") for i in range(50)] * 2
    return nodes, supports, domains, papers


def test_traversal_and_bridges(spark):
    r = random.Random(8)
    nodes, supports, domains, papers = made(r)
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    tables = (frame(supports, "mechanism string, node string, role string"), frame(nodes, "node string, name string, type string"), frame(domains, "node string, domain string"))
    known, ms = {n for n, _, _ in nodes}, [(f"m{i}", "x") for i in range(5)]
    got = P.traversal(frame(ms, "mechanism string, name string"), *tables, frame(papers, "node string, paper string"), 3).collect()
    name = {n: (x, n) for n, x, _ in nodes}
    want = {}
    for (m, i, _), (j, d) in product(set(supports), set(domains) | {(n, "*") for n in known}):
        if i == j and i in known and d:
            want.setdefault((m, None if d == "*" else d), set()).add(i)
    paths = {k: sum(1 for i in v for j, _ in set(papers) if i == j) for k, v in want.items()}
    assert {(x.mechanism, x.domain): (x.support, x.paths, x.witnesses) for x in got} == {k: (len(v), paths[k], sorted(v, key=name.get)[:3]) for k, v in want.items()} | {("m4", None): (0, 0, [])}
    communities, one = P.bridges(*tables, "x")
    kind = {n: t for n, _, t in nodes}
    for row in one.collect():
        a, b = want[row.mechanism, "x"], want[row.mechanism, row.domain]
        assert (row.target_support, row.source_support) == (len(a), len(b))
        assert row.strength == round(1.2 * len(a) + 1.3 * len(b) + 0.7 + 0.25 * len({kind[i] for i in a | b}), 4)
    assert {x.mechanism for x in communities.collect()} == {m for m, d in want if d == "x" and any((m, o) in want for o in "yz")}
    for row in communities.collect():
        others = [want[row.mechanism, d] for d in "yz" if (row.mechanism, d) in want]
        assert (row.source_support, row.source_domains) == (sum(map(len, others)), len(others))
