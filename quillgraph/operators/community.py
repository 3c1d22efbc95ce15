"""Communities of a projected concept graph, and lineages of methods.

The projection is bounded by the operator's own definition (the strongest ``MOST_EDGES`` edges), so local moving and refinement run on the driver;
building the projection is distributed.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_CONCEPTS, MOST_EDGES = 128, 600  #: Fixed values.


def projected(memberships: DataFrame, seeds: DataFrame, concepts: int = MOST_CONCEPTS, edges: int = MOST_EDGES) -> DataFrame:
    """a, b, weight of concepts that occur in the same entity: .35 + min(.35, .18 (c - 1)), the strongest first.

    memberships(entity, concept); seeds(concept, score) ranks the concepts that take part.
    """
    top = seeds.orderBy(F.desc("score"), "concept").limit(concepts).select("concept")
    m = memberships.select("entity", "concept").distinct().join(top, "concept")
    pairs = m.alias("x").join(m.alias("y"), "entity").where("x.concept < y.concept").groupBy(F.col("x.concept").alias("a"), F.col("y.concept").alias("b")).agg(F.count("*").alias("c"))
    weight = 0.35 + F.least(F.lit(0.35), 0.18 * (F.col("c") - 1))
    return pairs.select("a", "b", weight.alias("weight")).orderBy(F.desc("weight"), "a", "b").limit(edges)


def _move(adj: dict, size: dict, total: float, label: dict, resolution: float) -> dict:
    """Local moving until no node gains modularity; nodes in order of name."""
    mass = defaultdict(float)
    for v, c in label.items():
        mass[c] += size[v]
    moved = True
    while moved:
        moved = False
        for v in sorted(adj):
            here = label[v]
            mass[here] -= size[v]
            to = defaultdict(float)
            for u, w in adj[v].items():
                if u != v:
                    to[label[u]] += w
            best = max([(to[here] - resolution * size[v] * mass[here] / total, True, here)] + [(w - resolution * size[v] * mass[c] / total, False, c) for c, w in to.items() if c != here], key=lambda x: (round(x[0], 12), x[1], str(x[2])))
            label[v] = best[2]
            mass[best[2]] += size[v]
            moved |= best[2] != here
    return label


def leiden(edges: list[tuple], resolution: float = 1.0) -> dict:
    """Community of each node: local moving, refinement into connected parts, aggregation, until nothing moves."""
    adj: dict = defaultdict(dict)
    for a, b, w in edges:
        adj[a][b] = adj[a].get(b, 0) + w
        adj[b][a] = adj[b].get(a, 0) + w
    total = sum(sum(x.values()) for x in adj.values())
    if not total:
        return {}
    place = {v: v for v in adj}
    graph = {v: dict(n) for v, n in adj.items()}
    size = {v: sum(n.values()) for v, n in graph.items()}
    while True:
        label = _move(graph, size, total, {v: v for v in graph}, resolution)
        refined: dict = {}
        for v in sorted(graph):  # a community that is not connected falls apart
            if v in refined:
                continue
            stack = [v]
            while stack:
                u = stack.pop()
                if u in refined:
                    continue
                refined[u] = v
                stack += [x for x in graph[u] if x not in refined and label[x] == label[v]]
        if len(set(refined.values())) == len(graph):
            break
        place = {v: refined[c] for v, c in place.items()}
        merged: dict = {c: defaultdict(float) for c in refined.values()}
        for v, n in graph.items():
            for u, w in n.items():
                merged[refined[v]][refined[u]] += w
        size_new: dict = defaultdict(float)
        for v, s in size.items():
            size_new[refined[v]] += s
        graph, size = {c: dict(n) for c, n in merged.items()}, dict(size_new)
    names = {c: i for i, c in enumerate(sorted(set(place.values())))}
    return {v: names[c] for v, c in place.items()}


def modularity(edges: list[tuple], label: dict) -> float:
    total = 2 * sum(w for _, _, w in edges)
    inside, mass = defaultdict(float), defaultdict(float)
    for a, b, w in edges:
        mass[label[a]] += w
        mass[label[b]] += w
        if label[a] == label[b]:
            inside[label[a]] += 2 * w
    return sum(inside[c] / total - (m / total) ** 2 for c, m in mass.items())


def lineages(edges: DataFrame, root: Column | str, depth: int = 3, branch: int = 3, best: int = 5) -> DataFrame:
    """Paths from a root along accepted edges (src, dst, confidence): the ``branch`` surest edges of each end at each step, scored by mean confidence; the ``best`` of the longest extensions."""
    w = Window.partitionBy("src").orderBy(F.desc("confidence"), "dst")
    steps = edges.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= branch).select(F.col("src").alias("end"), "dst", "confidence")
    open_ = edges.sparkSession.range(1).select((F.lit(root) if not isinstance(root, Column) else root).alias("end")).select(F.array("end").alias("path"), "end", F.array().cast("array<double>").alias("confidences"))
    found = None
    for _ in range(depth):
        open_ = open_.join(steps, "end").where(~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("end"), F.array_append("confidences", F.col("confidence")).alias("confidences"))
        found = open_ if found is None else found.unionByName(open_)
    score = F.aggregate("confidences", F.lit(0.0), lambda a, x: a + x) / F.size("confidences")
    return found.select("path", F.size("confidences").alias("hops"), F.round(score, 6).alias("score")).orderBy(F.desc("score"), F.desc("hops"), "path").limit(best)
