import math

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.operators import retrieval as R
from quillgraph.operators import select as L
from quillgraph.operators import similarity as X
from quillgraph.sources import citations, files, markdown
from quillgraph.streaming import logs


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, "R", "intra-layer") for a, b in pairs], "src string, dst string, type string, layer_scope string")


def test_bfs_directions_and_cycles(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")])
    seed = spark.createDataFrame([("a",)], "id string")
    depth = lambda d: dict(G.bfs(e, seed, 3, d).collect())
    assert depth("out") == {"a": 0, "b": 1, "c": 2}
    assert depth("in") == {"a": 0, "c": 1, "d": 1, "b": 2}
    assert depth("both") == {"a": 0, "b": 1, "c": 1, "d": 1}


def test_simple_paths_do_not_repeat_nodes(spark):
    e = edges_of(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("a", "c")])
    ids = lambda x: spark.createDataFrame([(x,)], "id string")
    assert sorted((r["path"], r["hops"]) for r in G.simple_paths(e, ids("a"), ids("c"), 4).collect()) == [(["a", "b", "c"], 2), (["a", "c"], 1)]


def test_context_keeps_unknown_neighbours(spark):
    nodes = spark.createDataFrame([("a", "Paper", "A", "paper", None)], "id string, type string, name string, layer string, year int")
    assert [tuple(r) for r in G.context(nodes, edges_of(spark, [("a", "zz")]), "a").collect()] == [("outgoing", "R", "zz", "zz", "Unknown")]


def test_year_window_passes_undated(spark):
    df = spark.createDataFrame([(1, 1999), (2, None), (3, 2005)], "id int, year int")
    assert [r["id"] for r in G.year_window(df, 2000, None).orderBy("id").collect()] == [2, 3]


def test_diff_and_deletable(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, None), (4, "d")], "id int, v string")
    assert dict(G.diff(old, new, "id").collect()) == {2: "changed", 3: "deleted", 4: "added"}
    refs = spark.createDataFrame([("s", 1), ("s", 1), ("t", 2), ("s", 2)], "source string, id int")
    assert [r["id"] for r in G.deletable(refs, spark.createDataFrame([("s",)], "source string")).collect()] == [1]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, ["x", "y"]), (2, ["x", "x", "z", "z"]), (3, ["q"])], "doc int, t array<string>")
    queries = spark.createDataFrame([(7, ["x", "x"])], "q int, t array<string>")
    got = {r["doc"]: r["score"] for r in R.bm25(docs, queries, "doc", "q", "t", 5).collect()}
    idf, mean = math.log(1 + (3 - 2 + 0.5) / 2.5), 7 / 3
    gain = lambda tf, n: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    assert got == pytest.approx({1: gain(1, 2), 2: gain(2, 4)}, abs=1e-6)


def test_dense_top_k_in_blocks_is_the_same(spark):
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(30)], "id int, e array<double>")
    q = v.where("id % 7 = 0").select(F.col("id").alias("q"), "e")
    a = R.dense_top_k(v, q, "id", "q", "e", 3).orderBy("q", "rank").collect()
    assert a == R.dense_top_k(v, q, "id", "q", "e", 3, block=2).orderBy("q", "rank").collect() and len(a) == 15
    best = max((i for i in range(30) if i != 7), key=lambda i: math.cos(i - 7))
    assert [r["id"] for r in a if r["q"] == 7][0] == best


def test_fusion_and_rerank(spark):
    one = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "q int, d string, rank int")
    two = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "q int, d string, rank int")
    assert [r["d"] for r in R.reciprocal_rank_fusion(one, two, "q", "d").orderBy("rank").collect()] == ["b", "a", "c"]
    assert [r["d"] for r in R.rerank(one, two, "q", "d").orderBy("rank").collect()] == ["b", "a"]


def test_ranking_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "q int, d string, rank int")
    gold = spark.createDataFrame([(1, "b", 1), (1, "z", 2)], "q int, d string, grade int")
    r = R.ranking_metrics(ranked, gold, "q", "d", (2,)).first()
    assert (r["hit"], r["precision"], r["recall"], r["f1"], r["mrr"], r["map"]) == (1.0, 0.5, 0.5, 0.5, 0.5, 0.25)
    assert r["ndcg"] == pytest.approx((1 / math.log2(3)) / (2 + 1 / math.log2(3)))


def test_blocked_pairs_contradictions_ranges(spark):
    claims = spark.createDataFrame([(1, "sparse methods improve recall", "p"), (2, "sparse methods fail recall", "q"), (3, "sparse methods improve recall", "p")], "id int, text string, paper string")
    assert {tuple(r)[:2] for r in X.contradictions(claims, "id", "text", "paper").collect()} == {(1, 2), (2, 3)}
    years = spark.createDataFrame([(i, "w", y) for i, y in enumerate([2000, 2001, 2003, 2004, 2010])], "id int, work string, y int")
    assert {(r["a"], r["b"]) for r in X.near_in_range(years, "work", "id", "y", 2).collect()} == {(0, 1), (1, 2), (2, 3)}


def test_auc_of_counts(spark):
    by = spark.createDataFrame([(1, 1, 2), (5, 2, 1), (500, 3, 0)], "score long, pos long, neg long")
    pos, neg = [1, 5, 5, 500, 500, 500], [1, 1, 5]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / 18
    assert X.auc_of_counts(by).first()["auc"] == pytest.approx(auc, abs=1e-6)


def test_selections(spark):
    rows = [("a", 0.9, ["x"], ["m"]), ("b", 0.89, ["x"], ["m"]), ("c", 0.6, ["y"], ["n"])]
    c = spark.createDataFrame(rows, "id string, utility double, domains array<string>, mechanisms array<string>")
    assert [r["id"] for r in L.mmr(c, 2, ["domains", "mechanisms"])] == ["a", "c"]
    assert [r["id"] for r in L.submodular(c, 2, ["domains"], {"domains": 0.35, "mechanisms": 0.4})] == ["a", "c"]
    assert [r["id"] for r in L.dpp([r.asDict() for r in c.collect()], 2, "domains")] == ["a", "c"]


def test_bradley_terry_by_hand(spark):
    """Three steps of minorise-maximise on the driver."""
    d = spark.createDataFrame([("a", "b", False, 1.0), ("b", "c", False, 1.0), ("a", "c", True, 0.5)], "winner string, loser string, tie boolean, weight double")
    near = {r["id"]: (r["ability"], r["score"]) for r in L.bradley_terry(d, rounds=3).collect()}
    wins, pairs, a = {"a": 1.25, "b": 1.0, "c": 0.25}, {("a", "b"): 1.0, ("b", "c"): 1.0, ("a", "c"): 0.5}, dict.fromkeys("abc", 1.0)
    for _ in range(3):
        new = {k: (0.5 + wins[k]) / (0.5 + sum(w / (a[x] + a[y]) for (x, y), w in pairs.items() if k in (x, y))) for k in a}
        mean = sum(new.values()) / 3
        a = {k: v / mean for k, v in new.items()}
    low, high = min(a.values()), max(a.values())
    assert near == {k: (round(v, 4), round(0.25 + 0.5 * (v - low) / (high - low), 3)) for k, v in a.items()}
    assert L.bradley_terry(d.limit(0)).count() == 0


def test_markdown():
    text = "intro\n\n# One\n\npara a\n\n```\n# no heading\n\nx\n```\n\n## Two\n" + "w" * 1300 + "\n\nshort"
    assert [(a, b) for a, b, _ in markdown.split_sections(text)] == [(0, ""), (1, "One"), (2, "Two")]
    assert [len(c) for c in markdown.chunks(markdown.split_sections(text)[2][2])] == [1300, 5]
    assert markdown.reference("Smith, J. and Doe (2019). A fine title. Journal") == ("Smith", 2019, "A fine title")
    assert markdown.tables("Table 1: x\n| a | b |\n|---|---|\n| 1 | 2 |\n") == [("Table 1: x", 1, 2)]


def test_files_and_graph_store(spark, tmp_path):
    for name in ("a.md", "sub/b.md", "c.txt", ".hidden.md"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text("x")
    found = files.list_files(spark, str(tmp_path / "in"), (".md",))
    assert sorted(r["source_key"].rsplit("/", 1)[1] for r in found.collect()) == ["a.md", "b.md"]
    assert {r["state"] for r in files.source_changes(found, found).collect()} == {"unchanged"}
    nodes = spark.createDataFrame([("a", "Paper", "A", "paper")], "id string, type string, name string, layer string")
    files.save_graph(nodes, edges_of(spark, [("a", "a")]), str(tmp_path / "g"))
    n, e = files.load_graph(spark, str(tmp_path / "g"))
    assert n.count() == e.count() == 1 and files.lite_view(n).columns == ["id", "type", "name", "layer"]


def test_citation_sources(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\n")
    (tmp_path / "t.txt").write_text("q1 0 d1 1\n")
    assert [tuple(r) for r in citations.read_qrels(spark, str(tmp_path / "q.tsv")).collect()] == [("q1", "d1", 2)]
    assert [tuple(r) for r in citations.read_qrels(spark, str(tmp_path / "t.txt")).collect()] == [("q1", "d1", 1)]
    rows = spark.createDataFrame([("10.1/A", "doi:10.1/b"), ("10.1/a", "10.1/B"), ("", "10.1/c")], "citing string, cited string")
    edges, missing = citations.citation_edges(rows)
    assert [tuple(r) for r in edges.collect()] == [("10.1/a", "10.1/b", 2)] and missing.first()["n"] == 1


def test_upsert_is_idempotent(spark, tmp_path):
    sink = logs.upsert_sink(str(tmp_path / "t"))
    batch = lambda rows: spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, event_type string")
    import datetime as d

    first = batch([(1, d.datetime(2024, 1, 1), 1, "a"), (1, d.datetime(2024, 1, 2), 2, "b")])
    sink(first, 0)
    sink(first, 0)
    sink(batch([(1, d.datetime(2023, 1, 1), 3, "late"), (2, d.datetime(2024, 1, 1), 4, "c")]), 1)
    got = spark.read.parquet(str(tmp_path / "t" / "v000000001"))
    assert sorted((r["user_id"], r["event_type"]) for r in got.collect()) == [(1, "b"), (2, "c")]
