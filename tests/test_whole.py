"""Queries take all rows of their tables, on small fixtures against brute force."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from quillgraph.operators import community as Y
from quillgraph.operators import retrieval as R
from quillgraph.operators import select as L
from quillgraph.plans import registry


def test_communities_count_every_order_and_line(spark, tmp_path):
    names = {1: "red", 2: "blue", 3: "green", 4: "plain", 5: "dark"}
    orders = {1: [1, 2], 2: [1, 2, 3], 3: [3, 4], 8: [4, 5, 3], 14: [1, 5], 15: [2, 1]}
    lines = [(o, p, n) for o, parts in orders.items() for n, p in enumerate(parts, 1)]
    spark.createDataFrame(list(names.items()), "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber long").write.parquet(str(tmp_path / "lineitem.parquet"))
    together = Counter(pair for parts in orders.values() for pair in combinations(sorted({names[p] for p in parts}), 2))
    edges = [(a, b, 0.35 + min(0.35, 0.18 * (c - 1))) for (a, b), c in sorted(together.items(), key=lambda x: (-min(x[1], 3), x[0]))]
    got = dict(registry.queries()["communities"](spark, str(tmp_path)).collect())
    assert got == Y.leiden(edges) and set(got) == set(names.values())


def test_select_dpp_looks_past_the_fifty_best(spark, tmp_path):
    """60 suppliers of one brand and a worse one of another brand, which adds more than any further copy."""
    keys = range(1, 62)
    spark.createDataFrame([(k, 9000.0 - 10 * k if k < 61 else 3000.0, 1) for k in keys], "s_suppkey long, s_acctbal double, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(1, "t", "same"), (2, "t", "other")], "p_partkey long, p_type string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(k, 1, 2 if k == 61 else 1, k) for k in keys], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = [r["id"] for r in registry.queries()["select_dpp"](spark, str(tmp_path)).orderBy("place").collect()]
    assert got[:2] == ["1", "61"]


def test_determinantal_equals_determinants_of_all_rows(spark):
    r = random.Random(3)
    rows = [(f"c{i:03}", round(r.uniform(-0.1, 1), 4), sorted(r.sample("abcdefgh", r.randint(0, 5)))) for i in range(90)]
    c = spark.createDataFrame(rows, "id string, utility double, tokens array<string>")
    expected = L.dpp([x.asDict() for x in c.collect()], 6, "tokens")
    assert [x["id"] for x in L.determinantal(c, 6, "tokens")] == [x["id"] for x in expected]
    assert L.determinantal(c.limit(0), 3, "tokens") == []


def test_dense_top_k_of_copies_has_the_smallest_ids(spark):
    """40 copies and 40 rows that are equal to them after rounding, whatever the batches and the order of rows."""
    ids = random.Random(5).sample(range(1, 81), 80)
    v = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [1.0 - 1e-9 * i, 0.0]) for i in ids] + [(100, [0.5, 0.5]), (200, [1.0, 0.0])], "id int, e array<double>")
    q = v.where("id in (7, 200)").select(F.col("id").alias("q"), "e")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows, parts in ((10000, 1), (13, 1), (10000, 6)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            got = R.dense_top_k(v.repartition(parts), q, "id", "q", "e", 5).orderBy("q", "rank").collect()
            assert [(r["q"], r["id"]) for r in got] == [(7, i) for i in (1, 2, 3, 4, 5)] + [(200, i) for i in (1, 2, 3, 4, 5)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_best_rows_equal_a_full_sort():
    r = np.random.default_rng(1)
    scores = r.integers(-4, 5, (60, 300)) / 128 + r.choice([0, 1e-9], (60, 300))
    rows, cols, kept = R.best_rows(scores, 7)
    rounded = np.trunc(scores * 1e6 + np.copysign(0.5, scores)) / 1e6
    for c in range(300):
        assert sorted(rows[cols == c]) == sorted(np.lexsort((np.arange(60), -rounded[:, c]))[:7])
    assert (kept == rounded[rows, cols]).all()
