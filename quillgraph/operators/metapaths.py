"""Counts along typed paths of a graph as products of factor tables: mechanism, instantiators, domains, papers.

A path mechanism - instantiator - (domain, paper) branches at the instantiator, so the number of paths between a mechanism and a domain is the sum over their common
instantiators of the number of papers: the papers of an instantiator are counted once, and no path is ever a row. ``path_counts`` does the same for chains of any length:
it carries one row a pair of start and present node, with the number of ways so far, and adds up after each step, so a hub costs one row a start and not one a path.
Witnesses of a count are the first few by name, cut to that number before they are shuffled.

mechanisms(mechanism, name), supports(mechanism, node, role), nodes(node, name, type), domains(node, domain), papers(node, paper). Repeated rows count once.

Cases: instantiators without domain count for their mechanism alone, those without paper have no paths; nodes that are unknown are left out; a mechanism
without instantiators has counts of 0; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def path_counts(edges: DataFrame, starts: DataFrame, steps: list[tuple[list[str], str, DataFrame | None]]) -> DataFrame:
    """start, node, n: the number of walks from each start that follow the steps (edge types, 'out' or 'in', nodes(id) that may be entered or None)."""
    now = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(1).cast("decimal(38,0)").alias("n")).dropDuplicates(["start"])
    for types, direction, allowed in steps:
        a, b = ("src", "dst") if direction == "out" else ("dst", "src")
        step = edges.where(F.col("type").isin(types)).select(F.col(a).alias("node"), F.col(b).alias("to")).groupBy("node", "to").agg(F.count("*").alias("ways"))
        if allowed is not None:
            step = step.join(allowed.select(F.col("id").alias("to")).distinct(), "to", "left_semi")
        now = now.join(step, "node").groupBy("start", F.col("to").alias("node")).agg(F.sum((F.col("n") * F.col("ways")).cast("decimal(38,0)")).cast("decimal(38,0)").alias("n"))
    return now


def strength(target: Column, source: Column, domains: Column, types: Column) -> Column:
    """How well a mechanism bridges to a domain: its support there and elsewhere, the domains, the types of nodes."""
    return F.round(target * 1.2 + source * 1.3 + domains * 0.7 + types * 0.25, 4)


def _members(supports: DataFrame, nodes: DataFrame) -> DataFrame:
    """mechanism, node, name, type, once each."""
    return supports.select("mechanism", "node").distinct().join(nodes.select("node", "name", "type").dropDuplicates(["node"]), "node")


def traversal(mechanisms: DataFrame, supports: DataFrame, nodes: DataFrame, domains: DataFrame, papers: DataFrame, witnesses: int = 8) -> DataFrame:
    """mechanism, domain, support (instantiators), paths (to papers), papers (most of one instantiator), witnesses; domain null holds the mechanism's own counts."""
    members = _members(supports, nodes)
    factor = papers.select("node", "paper").distinct().groupBy("node").agg(F.count("*").alias("papers"))
    weighed = members.join(factor, "node", "left").withColumn("papers", F.coalesce("papers", F.lit(0)))
    placed = weighed.withColumn("domain", F.lit(None).cast("string")).unionByName(weighed.join(domains.where("domain is not null").select("node", "domain").distinct(), "node"))
    counts = placed.groupBy("mechanism", "domain").agg(F.count("*").alias("support"), F.sum("papers").alias("paths"), F.max("papers").alias("papers"))
    first = placed.withColumn("_r", F.row_number().over(Window.partitionBy("mechanism", "domain").orderBy("name", "node"))).where(F.col("_r") <= witnesses)
    names = first.groupBy("mechanism", "domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "node"))), lambda x: x["node"]).alias("witnesses"))
    keys = [F.col("a.mechanism") == F.col("b.mechanism"), F.col("a.domain").eqNullSafe(F.col("b.domain"))]
    found = counts.alias("a").join(names.alias("b"), keys[0] & keys[1]).select("a.*", "b.witnesses")
    empty = mechanisms.select("mechanism").distinct().join(supports.select("mechanism").distinct(), "mechanism", "left_anti")
    zero = F.lit(0).cast("long")
    return found.unionByName(empty.select("mechanism", F.lit(None).cast("string").alias("domain"), zero.alias("support"), zero.alias("paths"), zero.alias("papers"), F.array().cast("array<string>").alias("witnesses")))


def bridges(supports: DataFrame, nodes: DataFrame, domains: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Communities (mechanism, target_support, source_support, source_domains, strength) of mechanisms that the target domain and others instantiate, and
    bridges (mechanism, domain, target_support, source_support, strength) from each other domain. Supports are counted by (mechanism, domain, type); nodes are not paired."""
    members = _members(supports, nodes).join(domains.where("domain is not null").select("node", "domain").distinct(), "node")
    cells = members.groupBy("mechanism", "domain", "type").agg(F.count("*").alias("n"))
    own = cells.where(F.col("domain") == target).groupBy("mechanism").agg(F.sum("n").alias("target_support"), F.collect_set("type").alias("target_types"))
    other = cells.where(F.col("domain") != target).groupBy("mechanism", "domain").agg(F.sum("n").alias("source_support"), F.collect_set("type").alias("types")).join(own, "mechanism")
    kinds = lambda a, b: F.size(F.array_union(a, b))
    one = other.select("mechanism", "domain", "target_support", "source_support", strength(F.col("target_support"), F.col("source_support"), F.lit(1), kinds("target_types", "types")).alias("strength"))
    all_ = other.groupBy("mechanism").agg(F.first("target_support").alias("target_support"), F.sum("source_support").alias("source_support"), F.count("*").alias("source_domains"), F.first("target_types").alias("target_types"), F.array_distinct(F.flatten(F.collect_list("types"))).alias("types"))
    communities = all_.select("mechanism", "target_support", "source_support", "source_domains", strength(F.col("target_support"), F.col("source_support"), F.col("source_domains"), kinds("target_types", "types")).alias("strength"))
    return communities, one
