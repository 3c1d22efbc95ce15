"""Replayed cases, ablations and relevance files, against values worked out by hand."""

from quillgraph.operators import replay as R
from quillgraph.sources import citations


def test_replay(spark):
    f = spark.createDataFrame
    cases = f([(1, "candidate", 2000), (1, "baseline", 2000), (2, "candidate", None), (3, "baseline", None)], "case int, system string, last_year int")
    cited = f([(1, "candidate", 1, "a", 1999), (1, "candidate", 2, "b", None), (1, "candidate", 3, "c", 2000), (1, "baseline", 1, "x", 2001)], "case int, system string, place int, paper string, year int")
    gold = f([(1, "a"), (1, "c"), (1, "c")], "case int, paper string")
    claims = f([(1, "candidate", True), (1, "candidate", None), (2, "candidate", True)], "case int, system string, spanned boolean")
    beats = f([(1, "candidate", ["claim:1"]), (1, "candidate", []), (1, "candidate", None), (1, "baseline", ["x"])], "case int, system string, refs array<string>")
    said = f([(1, "candidate", "n", 1.5), (1, "candidate", "m", 0.2), (1, "baseline", "k", 0.4), (1, "baseline", "z", None)], "case int, system string, dimension string, score double")
    truth = f([(1, "n", 0.75)], "case int, dimension string, score double")
    metrics = R.replay_metrics(cases, cited, gold, claims, beats, said, truth, 2)
    got = {(x["case"], x["system"]): tuple(x[m] for m in (*R.METRICS, "score")) for x in metrics.collect()}
    assert got[1, "candidate"] == (0.5, 0.75, 0.5, 0.3333, 1.0, 0.6167)
    assert got[1, "baseline"] == (0.0, 0.4, None, 1.0, 0.0, 0.35)
    assert got[2, "candidate"] == (None, None, 1.0, None, None, 1.0) and got[3, "baseline"] == (None,) * 6
    lift = {x["metric"]: (x["candidate"], x["baseline"], x["lift"]) for x in R.replay_lift(metrics).collect()}
    assert lift["recall"] == (0.5, 0.0, 0.5) and lift["grounding"] == (0.75, None, None) and lift["score"] == (0.8084, 0.35, 0.2667)


def test_ablations(spark):
    rows = [("full", "a", 0.5), ("x", "a", 0.25), ("x", "b", 1.0), ("y", "a", None)]
    got = {(r["ablation"], r["metric"]): r["delta"] for r in R.ablation_deltas(spark.createDataFrame(rows, "ablation string, metric string, value double")).collect()}
    assert got == {("x", "a"): -0.25, ("x", "b"): None, ("y", "a"): None}


def test_relevance_files(spark, tmp_path):
    lines = ["query-id\tcorpus-id\tscore", "q1\td 1\t2", "q1 0 d2 1", "q2 d3 0", "q3 d4 1", "", "two words", "q1\td5\tx"]
    (tmp_path / "qrels").mkdir()
    (tmp_path / "qrels" / "test.tsv").write_text("\n".join(lines))
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d2", "title": "T", "text": "x"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "what"}\n{"_id": "q3", "text": " "}\n')
    corpus, queries, judged = citations.read_benchmark(spark, str(tmp_path))
    assert [r["id"] for r in corpus.collect()] == ["d2"] and [r["id"] for r in queries.collect()] == ["q1"]
    assert sorted(map(tuple, judged.collect())) == [("q1", "d 1", 2), ("q1", "d2", 1)]
    assert len(citations.read_qrels(spark, f"{tmp_path}/qrels/test.tsv").collect()) == 3
