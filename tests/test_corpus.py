"""Corpus state, evaluation and Markdown material, against plain Python and values worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import corpus as C
from quillgraph.operators import evaluation as E
from quillgraph.plans import registry
from quillgraph.sources import markdown as M


def plain_duplicates(papers):
    """The definition: papers in the order of rank; each that no earlier one took takes all later duplicates."""
    order = sorted(papers, key=lambda p: (-(p[1] + (100_000 if p[2] else 0)), p[0]))
    kind = lambda ids: {i.split(":")[0] for i in ids}
    keeper = {}
    for a in order:
        if a[0] in keeper:
            continue
        keeper[a[0]] = a[0]
        for b in order:
            if b[0] in keeper:
                continue
            shared = set(a[5]) & set(b[5])
            conflict = (kind(a[5]) & kind(b[5])) - kind(shared)
            title = a[3] and a[3] == b[3] and (not a[4] or not b[4] or set(a[4]) & set(b[4]))
            if not conflict and (shared or title):
                keeper[b[0]] = a[0]
    return keeper


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_duplicate_papers(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(60):
        ids = [f"{k}:{r.randint(1, 6)}" for k in ("doi", "arxiv") if r.random() < 0.4]
        rows.append((i, r.randint(0, 3), r.random() < 0.3, r.choice(["", "one", "two", "three"]), r.sample(["a", "b", "c"], r.randint(0, 2)), ids))
    rows += [(100 + i, 2, False, "copy", ["z"], []) for i in range(12)] + [(200, None, None, None, None, None), (201, None, None, "", [], [])]
    df = spark.createDataFrame(rows, "id long, score long, markdown boolean, title string, authors array<string>, ids array<string>")
    got = {x["id"]: x["keeper"] for x in C.duplicate_papers(df).collect()}
    want = plain_duplicates([(i, s or 0, m, t or "", a or [], d or []) for i, s, m, t, a, d in rows])
    assert got == want
    assert C.duplicate_papers(df.limit(0)).count() == 0


def test_duplicate_papers_by_canonical_name_and_normal_authors(spark, tmp_path):
    """Names link papers whatever their titles, unless identifiers conflict; authors count by their normal names, and a heading is no title."""
    rows = [(1, 9, "one title", ["Ann  Lee"], [], "arxiv:1"), (2, 8, None, [], [], "arxiv:1"), (3, 7, "one title", ["ann lee"], [], None), (4, 6, "one title", ["Bo"], [], ""), (5, 9, "x", [], ["doi:1"], "n"), (6, 8, "y", [], ["doi:2"], "n"), (7, 7, "z", [], [], "n")]
    df = spark.createDataFrame([(i, s, False, *r) for i, s, *r in rows], "id long, score long, markdown boolean, title string, authors array<string>, ids array<string>, canonical string")
    assert {x["id"]: x["keeper"] for x in C.duplicate_papers(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 5}
    texts = [(1, "Introduction\na", 9), (2, "Introduction\nb", None), (3, "A real name\nc", 8), (4, "a real  name\nd", None), (5, "A real name\ne", None)]
    docs = spark.createDataFrame([(i, t, "en", f"src{i}" if i > 3 else "src0", n) for i, t, n in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["id"]: x["keeper"] for x in registry.queries()["duplicate_papers"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 3}


def test_documents_without_a_size_are_named_by_their_titles(spark, tmp_path):
    texts = [(1, "A real name\na", "src1"), (2, "a real  name\nb", "src2"), (3, "Table 3 of it", "src1"), (4, "Table 3 of it", "src1")]
    docs = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["id"]: x["keeper"] for x in registry.queries()["duplicate_papers"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_merged_identity(spark):
    rows = [(1, 1, "2101.00001v1", None, None, None, None), (1, 2, "arXiv:2101.00001v3", "10.1/A", None, None, "T"), (1, 3, None, "10.2/b", None, None, None), (2, 1, None, None, None, None, "Only A Title"), (3, 1, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "grp int, place int, arxiv string, doi string, pmid string, pmcid string, title string")
    got = {x["grp"]: x for x in C.merged_identity(df).collect()}
    assert (got[1]["canonical"], got[1]["arxiv"], got[1]["conflicts"]) == ("arxiv:2101.00001", "2101.00001v3", "doi")
    assert (got[2]["canonical"], got[2]["source"]) == ("title:only a title", "title")
    assert (got[3]["canonical"], got[3]["source"], got[3]["conflicts"]) == ("", "", "")


def test_reserved_batch(spark):
    schema = "id int, status string, stage string, updated int, files int, bytes long"
    rows = [(i, "pending", "queued" if i % 2 else None, i, 4, 10) for i in range(30)]
    df = spark.createDataFrame(rows, schema)
    place = lambda x: [(y["id"], y["place"]) for y in x.orderBy("place").collect()]
    assert len(place(C.reserved_batch(df, 99))) == 16
    assert place(C.reserved_batch(df, 10, 12)) == [(0, 1), (1, 2), (2, 3)]
    assert place(C.reserved_batch(df, 10, 1)) == [(0, 1)]  # the first always goes
    both = df.unionByName(spark.createDataFrame([(99, "running", None, 50, 1, 1), (98, "running", None, 40, 1, 1)], schema))
    assert place(C.reserved_batch(both, 10)) == [(98, 1)]
    assert place(C.reserved_batch(df.limit(0), 10)) == []


def test_jobs(spark):
    rows = [(1, "t", ["a"], "queued", "2024-01-01"), (2, "t", ["b", "a"], "queued", "2024-01-02"), (3, "t", ["a"], "completed", "2024-01-03"), (4, "t", ["c"], "queued", "2024-01-04")]
    df = spark.createDataFrame(rows, "place int, token string, sources array<string>, status string, at string")
    got = [(x["job"], x["sources"], x["requests"], x["status"]) for x in C.merged_jobs(df).orderBy("job").collect()]
    assert got == [(0, "a,b", 3, "completed"), (1, "c", 1, "queued")]


def test_contributions_as_one_or_in_two_parts(spark):
    r = random.Random(7)
    rows = [(r.choice(["Method", "Claim"]), r.choice(["One A", "one a", "two", ""]), i, r.random(), r.sample(["x", "y", "z"], r.randint(0, 2)), r.choice([None, "", f"d{i}"])) for i in range(80)]
    df = spark.createDataFrame(rows, "type string, name string, place int, confidence double, tags array<string>, description string")
    whole = {(x["type"], x["key"]): x for x in C.aggregated(df, ["tags"], ["description"]).collect()}
    parts = C.merged_aggregates(C.aggregated(df.where("place < 40"), ["tags"], ["description"]), C.aggregated(df.where("place >= 40"), ["tags"], ["description"]), ["tags"], ["description"])
    assert {(x["type"], x["key"]): x for x in parts.select(*C.aggregated(df, ["tags"], ["description"]).columns).collect()} == whole
    for (kind, key), x in whole.items():
        mine = [y for y in rows if y[0] == kind and y[1].lower() == key]
        assert (x["mentions"], x["tags"], x["confidence"]) == (len(mine), sorted({t for y in mine for t in y[4]}), max(y[3] for y in mine))
        assert x["description"] == next((y[5] for y in mine if y[5]), None)


def test_reachable(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)]
    pairs = [(1, 4), (1, 1), (4, 1), (5, 5), (2, 1), (9, 9)]
    got = {(x["source"], x["target"]): x["hops"] for x in C.reachable(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame(pairs, "source int, target int"), 2).collect()}
    steps = lambda s: {b for a, b in edges if a in s}
    want = {}
    for s, t in pairs:
        for n, level in enumerate((steps({s}), steps(steps({s}))), 1):
            if t in level and t != s:
                want.setdefault((s, t), n)
    assert {k: v for k, v in got.items() if k[0] != k[1]} == want


def test_answers_and_sets(spark):
    rows = [(1, "The Big Model wins.", ["big model", "wins"]), (2, "nothing", ["big model"]), (3, "", ["x"]), (4, "x", []), (5, None, None)]
    got = {x["query"]: (x["coverage"], x["exact"]) for x in E.answer_metrics(spark.createDataFrame(rows, "query int, answer string, references array<string>")).collect()}
    assert got == {1: (1.0, 1), 2: (0.0, 0), 3: (0.0, None), 4: (0.0, None), 5: (0.0, None)}
    said, gold = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c")], "q int, i string"), spark.createDataFrame([(1, "b"), (1, "c"), (3, "d")], "q int, i string")
    sets = {x["q"]: (x["precision"], x["recall"], x["f1"], x["success"]) for x in E.set_metrics(said, gold, "q", "i").collect()}
    assert sets == {1: (0.5, 0.5, 0.5, 0), 2: (0.0, 0.0, 0.0, 0), 3: (0.0, 0.0, 0.0, 0)}


def test_relation_matches(spark):
    words = ["alpha", "beta", "gamma", "delta"]
    r = random.Random(5)
    name = lambda: " ".join(r.sample(words, r.randint(1, 3)))
    predicted = [(q, i, name(), name(), r.choice(["USES", "EXTENDS"])) for q in range(4) for i in range(8)]
    gold = [(q, i, name(), name(), r.choice(["USES", "EXTENDS"])) for q in range(4) for i in range(6)]
    jac = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    want = set()
    for q in range(4):
        free = [g for g in gold if g[0] == q]
        for p in sorted(x for x in predicted if x[0] == q):
            for g in free:
                s = (jac(p[2], g[2]) + jac(p[3], g[3]) + (p[4] == g[4])) / 3
                if round(s, 6) >= E.RELATION_MATCH:
                    want.add((q, p[1], g[1], round(s, 6)))
                    free.remove(g)
                    break
    got = E.relation_matches(spark.createDataFrame(predicted, "query int, place int, source string, target string, type string"), spark.createDataFrame(gold, "query int, gold int, source string, target string, type string"))
    assert {(x["query"], x["place"], x["gold"], x["similarity"]) for x in got.collect()} == want and len(want) > 3


def test_agreement(spark):
    rows = [(1, "left"), (1, "left"), (1, "right"), (2, "tie"), (3, "right"), (3, "left"), (4, None), (4, "skip")]
    got = {x["pair"]: (x["labels"], x["choice"], x["share"]) for x in E.agreement(spark.createDataFrame(rows, "pair int, side string")).collect()}
    assert got == {1: (3, "left", 0.6667), 3: (2, "left", 0.5)}


def test_cleaned_markdown():
    text = "Intro 😀\n0.1 0.2 0.3\n0.1 0.2 0.4\n[A] [B] 1 2 3\n???\n| 0.1 0.2 0.3 |\n    0.1 0.2 0.3\n```\n0.1 0.2 0.3\n```\n$$\n0.1 0.2 0.3\n$$\n1 2 3"
    kept, gone = M.cleaned(text)
    assert [(n, why) for n, _, _, why in gone] == [(2, "chart_tick_or_legend"), (4, "chart_tick_or_legend"), (5, "punctuation_artifact")]
    assert gone[0][1:3] == (9, 20)  # the face counts two units
    assert kept == "Intro 😀\n0.1 0.2 0.4\n| 0.1 0.2 0.3 |\n    0.1 0.2 0.3\n```\n0.1 0.2 0.3\n```\n$$\n0.1 0.2 0.3\n$$\n1 2 3"
    assert M.cleaned("") == ("", []) and M.cleaned("\n \nx\n\t\n") == ("x", [])


def test_materials():
    text = "Table 1: x\n| a | b |\n|---|---|\n| 1 | 2 |\n\nFig. 3: A plot\nTable 2 - alone\n| no | table |\n"
    assert M.tables(text) == [("Table 1: x", 1, 2), ("Table 2 - alone", None, None)]
    assert M.figures(text) == ["Fig. 3: A plot"]
    assert M.tables("") == [] and M.figures("Figure of speech") == []


def test_title_check(spark):
    cases = {"# A fine title": ("A fine title", None), "\n\n- “Quoted”": ("Quoted", None), "INTRODUCTION": ("paper.v1", "section-heading"), "ab": ("paper.v1", "too-short"), "NLP": ("NLP", None), "!!!": ("paper.v1", "missing-alphanumeric"), "深度学习方法": ("深度学习方法", None), "Keywords": ("paper.v1", "metadata-heading"), "null": ("paper.v1", "placeholder-title"), "": ("paper.v1", "empty"), "w" * 221: ("paper.v1", "too-long"), "404 Not Found": ("paper.v1", "access-or-error-title")}
    df = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", M.title_check(F.col("raw"), F.lit("in/paper.v1.md")).alias("x"))
    assert {r["raw"]: (r["x"]["title"], r["x"]["reason"]) for r in df.collect()} == cases
    none = spark.range(1).select(M.title_check(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("x")).first()["x"]
    assert (none["title"], none["valid"], none["reason"]) == ("paper", False, "empty")


def test_relation_matches_normalises_each_text_once(spark):
    predicted = [(1, 1, "alpha model", "beta data set", "USES"), (1, 1, "alpha model", "beta data set", "USES"), (1, 2, "alpha model", "data beta", "USES"), (1, 3, "alpha", "gamma", "USES")]
    gold = [(1, 7, "alpha model", "beta data set", "uses"), (1, 8, "alpha model", "set of beta data", "USES"), (1, 9, "alpha", "other", "USES")]
    out = E.relation_matches(spark.createDataFrame(predicted, "query int, place int, source string, target string, type string"), spark.createDataFrame(gold, "query int, gold int, source string, target string, type string"))
    assert sorted((r.place, r.gold, r.similarity) for r in out.collect()) == [(1, 7, 1.0), (2, 8, round((1 + 2 / 4 + 1) / 3, 6))]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # pairs are made once, not once more to look their similarity up
