"""Typed property graph as two DataFrames, nodes and edges, and the operators on it.

nodes(id, type, name, layer, year); edges(src, dst, type, layer_scope). Traversals are frontier loops: each step joins the
frontier with the edges and keeps ids not seen before; a step's result is cut into the shared folder, so the plan stays short. The number
of steps is a small constant, whatever the graph's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.runtime import cut, table


def graph_of_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The graph that the star schema means: orders are papers, parts methods, suppliers problems, customers benchmarks, places domains."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda df, prefix, key, kind, name, layer, year=None: df.select(
        F.concat(F.lit(prefix), F.col(key)).alias("id"), F.lit(kind).alias("type"), name.alias("name"), F.lit(layer).alias("layer"), (F.year(year) if year else F.lit(None).cast("int")).alias("year")
    )
    nodes = (
        node(t("region"), "dom:", "r_regionkey", "Domain", F.col("r_name"), "domain")
        .unionByName(node(t("nation"), "sub:", "n_nationkey", "Domain", F.col("n_name"), "domain"))
        .unionByName(node(t("part"), "m:", "p_partkey", "Method", F.col("p_name"), "method"))
        .unionByName(node(t("supplier"), "p:", "s_suppkey", "Problem", F.col("s_name"), "problem"))
        .unionByName(node(t("customer"), "b:", "c_custkey", "Benchmark", F.col("c_name"), "evaluation"))
        .unionByName(node(t("orders"), "o:", "o_orderkey", "Paper", F.concat(F.lit("paper "), F.col("o_orderkey")), "paper", "o_orderdate"))
    )
    edge = lambda df, a, b, kind, scope: df.select(F.concat(F.lit(a[0]), F.col(a[1])).alias("src"), F.concat(F.lit(b[0]), F.col(b[1])).alias("dst"), F.lit(kind).alias("type"), F.lit(scope).alias("layer_scope"))
    line = t("lineitem")
    edges = (
        edge(line.select("l_orderkey", "l_partkey").distinct(), ("o:", "l_orderkey"), ("m:", "l_partkey"), "USES", "cross-layer")
        .unionByName(edge(line.select("l_orderkey", "l_suppkey").distinct(), ("o:", "l_orderkey"), ("p:", "l_suppkey"), "ADDRESSES", "cross-layer"))
        .unionByName(edge(t("orders"), ("b:", "o_custkey"), ("o:", "o_orderkey"), "CONTAINS", "cross-layer"))
        .unionByName(edge(t("supplier"), ("p:", "s_suppkey"), ("sub:", "s_nationkey"), "BELONGS_TO_DOMAIN", "cross-layer"))
        .unionByName(edge(t("customer"), ("b:", "c_custkey"), ("sub:", "c_nationkey"), "BELONGS_TO_DOMAIN", "cross-layer"))
        .unionByName(edge(t("nation"), ("sub:", "n_nationkey"), ("dom:", "n_regionkey"), "BELONGS_TO_DOMAIN", "intra-layer"))
    )
    return nodes, edges


def layer_filter(nodes: DataFrame, layers: str | None) -> DataFrame:
    """Nodes whose layer is in the comma-separated list; all for an empty list."""
    wanted = [x.strip() for x in (layers or "").split(",") if x.strip()]
    return nodes.where(F.col("layer").isin(wanted)) if wanted else nodes


def layer_mode(edges: DataFrame, mode: str = "any") -> DataFrame:
    scope = {"intra": "intra-layer", "cross": "cross-layer"}.get(mode)
    return edges.where(F.col("layer_scope") == scope) if scope else edges


def year_window(df: DataFrame, first: int | None, last: int | None, year: str = "year") -> DataFrame:
    """Rows of these years; undated ones pass."""
    keep: Column = F.lit(True)
    if first is not None:
        keep &= F.col(year) >= first
    if last is not None:
        keep &= F.col(year) <= last
    return df.where(F.col(year).isNull() | keep)


def context(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """One hop both ways: direction, relation, id, name, type; an unknown neighbour keeps its id as name."""
    out = edges.where(F.col("src") == node_id).select(F.lit("outgoing").alias("direction"), F.col("type").alias("relation"), F.col("dst").alias("id"))
    into = edges.where(F.col("dst") == node_id).select(F.lit("incoming").alias("direction"), F.col("type").alias("relation"), F.col("src").alias("id"))
    known = nodes.select("id", "name", F.col("type").alias("node_type"))
    return out.unionByName(into).join(known, "id", "left").select("direction", "relation", "id", F.coalesce("name", "id").alias("name"), F.coalesce("node_type", F.lit("Unknown")).alias("node_type"))


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """a, b: every step from a to b in this direction."""
    out, into = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """id and depth of what is reached from ``seeds.id`` within so many steps (8 at most); direction out, in or both.

    The edges are written once, so that a step reads two columns and does not build them again; the frontier is the small side of each
    join, and where it is not, skewed hubs are split by the adaptive plan. Unknown seeds are reached at depth 0; null ids match nothing.
    """
    steps = cut(_steps(edges, direction), "edges")
    frontier = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    seen = frontier
    for k in range(1, min(depth, 8) + 1):
        fresh = steps.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        frontier = cut(fresh.join(seen, "id", "left_anti").withColumn("depth", F.lit(k)), "bfs")
        seen = seen.unionByName(frontier)
    return seen


def impact_risk(n: Column) -> Column:
    """How many nodes are hit."""
    return F.when(n >= 18, "CRITICAL").when(n >= 10, "HIGH").when(n >= 5, "MEDIUM").otherwise("LOW")


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, depth: int, most: int | None = None, between: DataFrame | None = None) -> DataFrame:
    """Simple paths of at most ``depth`` hops from ``sources.id`` to ``targets.id``: path (array), hops, score 1 / hops.

    most: so many paths in all, fewest hops first, then by path (3 by default in a trace, 25 at most; None for all). between: ids that
    paths may pass through. A node that no target can be reached from in the hops that are left is never entered: those that can are found
    backwards from the targets first, so the open paths are those that have an end.
    """
    steps = cut(edges.select(F.col("src").alias("end"), F.col("dst").alias("next")), "edges")
    goal = targets.select(F.col("id").alias("end"))
    back = bfs(steps.select(F.col("end").alias("src"), F.col("next").alias("dst")), targets, depth - 1, "in").select(F.col("id").alias("next"), F.col("depth").alias("_left")) if depth > 2 else None
    open_ = sources.select(F.array("id").alias("path"), F.col("id").alias("end"))
    found = None
    for hop in range(1, depth + 1):
        last = steps.join(goal.select(F.col("end").alias("next")), "next", "left_semi") if hop == depth else steps if back is None else steps.join(back.where(F.col("_left") <= depth - hop), "next", "left_semi")
        grown = open_.join(last, "end").where(~F.array_contains("path", F.col("next")))
        open_ = grown.select(F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("end"))
        done = open_.join(goal, "end", "left_semi").select("path", F.lit(hop).alias("hops"), F.lit(1.0 / hop).alias("score"))
        found = done if found is None else found.unionByName(done)
        open_ = open_.join(goal, "end", "left_anti")
        if between is not None:
            open_ = open_.join(between.select(F.col("id").alias("end")), "end", "left_semi")
    return found if most is None else found.orderBy("hops", "path").limit(min(most, 25))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def domain_distance(memberships: DataFrame, adjacency: DataFrame) -> DataFrame:
    """a, b, distance: 1 - Jaccard of the closed neighbour sets of adjacent domains. memberships(entity, domain) gives adjacency where none is passed."""
    closed = adjacency.select("a", "b").unionByName(adjacency.select(F.col("a"), F.col("a").alias("b"))).distinct()
    sizes = closed.groupBy("a").agg(F.count("*").alias("n"))
    shared = closed.alias("x").join(closed.alias("y"), F.col("x.b") == F.col("y.b")).where("x.a < y.a").groupBy(F.col("x.a").alias("a"), F.col("y.a").alias("b")).agg(F.count("*").alias("both"))
    out = shared.join(sizes.withColumnRenamed("n", "na"), "a").join(sizes.select(F.col("a").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", F.round(1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 4).alias("distance"))


def domains_sharing_entities(memberships: DataFrame) -> DataFrame:
    """Adjacent domains (a, b), both ways: an entity belongs to both."""
    m = memberships.select("entity", "domain").distinct()
    return m.alias("x").join(m.alias("y"), "entity").where("x.domain <> y.domain").select(F.col("x.domain").alias("a"), F.col("y.domain").alias("b")).distinct()


# ---- set operations and mutation -------------------------------------------------------------------


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key and change (added, deleted, changed) of two states of a table with the same columns."""
    digest = lambda df: F.xxhash64(*[F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns) if c != key]))])
    both = old.select(key, digest(old).alias("old_h")).join(new.select(key, digest(new).alias("new_h")), key, "full_outer")
    change = F.when(F.col("old_h").isNull(), "added").when(F.col("new_h").isNull(), "deleted").when(F.col("old_h") != F.col("new_h"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def deletable(references: DataFrame, changed: DataFrame) -> DataFrame:
    """Ids that one source alone refers to, where that source has changed. references(source, id), changed(source)."""
    alone = references.groupBy("id").agg(F.countDistinct("source").alias("n"), F.min("source").alias("source")).where("n = 1")
    return alone.join(changed.select("source").distinct(), "source", "left_semi").select("id")


def apply_delta(nodes: DataFrame, edges: DataFrame, delete_nodes: DataFrame, delete_edges: DataFrame, upsert_nodes: DataFrame, upsert_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete edges, delete nodes with their edges, then upsert; new rows win by id."""
    keep = edges.join(delete_edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti")
    for end in ("src", "dst"):
        keep = keep.join(delete_nodes.select(F.col("id").alias(end)), end, "left_anti")
    keep = keep.join(upsert_edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti").unionByName(upsert_edges)
    rest = nodes.join(delete_nodes.select("id"), "id", "left_anti").join(upsert_nodes.select("id"), "id", "left_anti")
    return rest.unionByName(upsert_nodes), keep


def edge_cube(edges: DataFrame, by: tuple[str, str] = ("type", "layer_scope")) -> DataFrame:
    """The two columns, n, sources, targets: edges(src, dst) and their distinct ends in every combination of two columns of few values; null where a column is left out.

    Ends are counted by the set of values that they occur with, so each edge is shuffled once an end, and not once a combination and count; combinations are made of the sets.
    """
    x, y = by
    combos = lambda g: F.array(*[F.struct(F.lit(k).alias("level"), (g[x] if k in (0, 1) else F.lit(None)).alias(x), (g[y] if k in (0, 2) else F.lit(None)).alias(y)) for k in range(4)])
    zero = F.lit(0).cast("long")

    def spread(groups: DataFrame, name: str) -> DataFrame:
        each = groups.select("k", F.explode(F.array_distinct(F.flatten(F.transform("g", combos)))).alias("c"))
        return each.select("c.*", *[(F.col("k") if c == name else zero).alias(c) for c in ("n", "sources", "targets")])

    def ends(end: str) -> DataFrame:
        of = edges.where(F.col(end).isNotNull()).select(end, F.struct(*by).alias("g")).repartition(end).distinct().groupBy(end).agg(F.array_sort(F.collect_set("g")).alias("g"))
        return of.groupBy("g").agg(F.count("*").alias("k"))

    rows = spread(edges.groupBy(*by).agg(F.count("*").alias("k")).select("k", F.array(F.struct(*by)).alias("g")), "n")
    rows = rows.unionByName(spread(ends("src"), "sources")).unionByName(spread(ends("dst"), "targets"))
    return rows.groupBy("level", *by).agg(*[F.sum(c).alias(c) for c in ("n", "sources", "targets")]).drop("level")
