"""Queries on small tables that show what only large ones did."""

import datetime

import random

import duckdb
import pandas as pd
from compare import connect, rows
from pyspark.sql import functions as F

from quillgraph.operators import corpus as C
from quillgraph.operators import papers as P
from quillgraph.plans import registry

PARTS = ["red ring", "red bolt", "old plate", "hot ring", "blue plate"]


def tables(path, lines, parts=PARTS):
    """lineitem(orderkey, linenumber, partkey, suppkey, discount) and part as files."""
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount"]
    lineitem = pd.DataFrame(lines, columns=columns).assign(l_quantity=24.0, l_tax=0.02, l_extendedprice=10.0, l_returnflag="N", l_linestatus="F", l_shipdate=pd.Timestamp(datetime.date(1996, 5, 1)))
    part = pd.DataFrame({"p_partkey": range(len(parts)), "p_name": parts, "p_brand": "Brand#1", "p_type": "SMALL", "p_size": range(1, len(parts) + 1), "p_retailprice": 1.0})
    for name, df in (("lineitem", lineitem), ("part", part)):
        duckdb.sql(f"COPY (SELECT * FROM df) TO '{path}/{name}.parquet' (FORMAT parquet)")
    return str(path)


def same(spark, name, sf):
    got, want = registry.queries()[name](spark, sf).toPandas(), connect(sf).execute(registry.oracle_sql()[name]).df()
    assert len(got) and rows(got) == rows(want)
    return got


def test_citation_mentions_of_keys_like_years(spark, tmp_path):
    got = same(spark, "citation_mentions", tables(tmp_path, [(1, 1, 0, 1912, 0.05), (1, 2, 1, 20011, 0.05), (2, 1, 2, 7, 0.05)]))
    assert {"supplier 1912", "supplier 2001", "supplier7 1996"} <= set(got["reference"])


def test_gap_patterns_of_a_mean_at_the_bound(spark, tmp_path):
    # summed as doubles in this order the mean of .05 is above .05, so the gap was additive and lost its pattern
    path = tables(tmp_path, [(1, k, 0, 7, d) for k, d in enumerate([0.0, 0.05, 0.1])], ["small ring"])
    got = registry.queries()["gap_patterns"](spark, path).toPandas()
    assert list(got["pattern"]) == ["shrink"]


def test_claim_matches_equal_all_pairs_and_join_few(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choices(["sparse", "dense", "graph", "model", "helps", "fails", "small", "large"], k=rng.choice([1, 2, 3, 4, 6, 9])))
    said, gold = ([(k % 3, k, text(), rng.choice("fm")) for k in range(90)] for _ in range(2))
    sets = lambda x: set(x[2].split())
    score = lambda g, p: round(len(sets(g) & sets(p)) / len(sets(g) | sets(p)), 6)
    best = {}
    for g in gold:
        like = sorted((-score(g, p), p[1]) for p in said if p[0] == g[0] and score(g, p) >= 0.55)
        if like:
            best.setdefault((g[0], like[0][1]), (g[1], -like[0][0]))
    a, b = spark.createDataFrame(said, "paper int, id int, text string, type string"), spark.createDataFrame(gold, "paper int, gold int, text string, type string")
    assert {(r["paper"], r["id"]): (r["gold"], r["score"]) for r in P.claim_matches(a, b).collect()} == best
    # a word that all claims of a paper share joined all of them with each other
    wide = spark.range(300).select(F.lit(1).alias("paper"), "id", F.array(F.lit("claim"), *[F.concat(F.lit(x), "id") for x in "uvw"]).alias("x"))
    df = wide.select(F.explode("x").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    keys = P._pair_keys(wide, "id", "x", df, 0.55)
    assert keys.alias("a").join(keys.alias("b"), ["paper", "key"]).select("a.id", "b.id").distinct().count() == 300


def test_reachable_in_lists_of_few(spark, monkeypatch):
    monkeypatch.setattr(C, "LISTED", 3)
    rng = random.Random(7)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(160)}
    pairs = [(a, (a * 7 + k) % 40) for a in range(40) for k in range(3)]
    want = {}
    for s, t in pairs:
        at = {s}
        for hop in range(1, 6):
            at = {b for a, b in edges if a in at}
            if t in at:
                want.setdefault((s, t), hop)
    got = C.reachable(spark.createDataFrame(sorted(edges), "src int, dst int"), spark.createDataFrame(pairs, "source int, target int"), 5)
    assert {(x["source"], x["target"]): x["hops"] for x in got.collect()} == want
