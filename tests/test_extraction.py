"""Typed records: the prefilter against all rules on all sentences, and records worked out by hand."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.operators import extraction as X

SCANNER = X.Scanner()
PIECES = [
    "We study the alignment of graphs, ", "Results show that F1 drops. ", "existing methods fail to scale to maps; ", "The Big Graph benchmark ", "requires labels ", "high-quality label ", "İ ", "observed 3 gains. ", "we propose SparseNet, ", "our method uses the cache for ",
    "future work ", "ROC-AUC ", "a limitation of this is that it is slow. ", "\n", "does not handle ", "Performance  degrades! ", "aim to ", "MNIST corpus ", "inaccuracy ", "task of ranking; ", "benchmarks such as GLUE, SQuAD and ", "assume ", "12 ", "the key idea is caching. ", "roc auc ",
]


class All(X.Scanner):
    """Tries every rule on every sentence."""

    def sentences(self, text):
        for start, stop, _ in super().sentences(text):
            yield start, stop, -1


EVERY = All()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14), st.sampled_from(["abstract", "results", "discussion", "method", "introduction", "body"]), st.booleans())
def test_the_prefilter_loses_nothing(pieces, role, flag):
    args = (role, flag, flag, not flag, "On the Small Data dataset", "".join(pieces))
    assert list(SCANNER.scan(*args)) == list(EVERY.scan(*args))


def test_few_rules_are_tried():
    few, text = X.Scanner(), "Nothing of note stands in this plain sentence. " * 100 + "We find gains."
    every = All()
    list(few.scan("results", False, False, False, "", text)), list(every.scan("results", False, False, False, "", text))
    assert few.tried < every.tried / 15


def test_records_by_hand(spark):
    papers = [("a", "SparseNet: Robust Ranking for Short Queries"), ("b", None), ("c", "Plain")]
    text = "We address the problem of ranking short queries, by graphs. We propose SparseNet that ranks. Results are on the Tiny Web benchmark."
    sections = [
        ("a", 0, "abstract", "Abstract", text), ("a", 1, "results", "Results", "We find that accuracy is 91. Table rows.\nThe gain holds on the Tiny Web benchmark. Nothing else"),
        ("a", 1, "results", "Results", "We find that accuracy is 91. Table rows.\nThe gain holds on the Tiny Web benchmark. Nothing else"), ("a", 2, "discussion", "Limits", "It cannot rank long queries. Future work may extend it."), ("b", 0, None, None, None),
    ]
    got = X.records(spark.createDataFrame(papers, "doc string, title string"), spark.createDataFrame(sections, "doc string, ord long, role string, heading string, text string")).collect()
    assert {r.doc for r in got} == {"a"}
    of = lambda t: [(r.name, r.kind, r.ord, round(r.confidence, 2)) for r in sorted(got, key=lambda r: r.place) if r.type == t]
    assert of("problem") == [("Robust Ranking for Short Queries", None, -1, 0.95), ("Short Queries", None, -1, 0.95), ("ranking short queries", None, 0, 0.78)]
    assert [n for n, *_ in of("method")] == ["SparseNet: Robust Ranking", "SparseNet"]
    assert of("dataset") == [("Tiny Web benchmark", None, 0, 0.8)] and of("metric") == [("Accuracy", None, 1, 0.88)]
    assert of("limitation") == [("It cannot rank long queries.", "limitation", 2, 0.8)]
    assert of("future") == [("Future work may extend it.", None, 2, 0.82)]
    assert of("finding") == [("We find that accuracy is 91.", "finding", 1, 0.84)]
    assert [n for n, *_ in of("evidence")] == ["The gain holds on the Tiny Web benchmark.", "We find that accuracy is 91.", "Results are on the Tiny Web benchmark."]
    one = next(r for r in got if r.type == "limitation")
    assert sections[3][4][one.start : one.stop] == one.text


def test_all_records_and_none(spark):
    r = random.Random(1)
    sections = [(str(i), j, role, "", " ".join(r.choice(PIECES) for _ in range(30))) for i in range(3) for j, role in enumerate(("abstract", "results", "discussion"))]
    frame = spark.createDataFrame(sections, "doc string, ord long, role string, heading string, text string")
    papers = spark.createDataFrame([(str(i), "T") for i in range(3)], "doc string, title string")
    some, every = (X.records(papers, frame, m).collect() for m in (X.MOST, None))
    key = lambda rows: {(x.doc, x.type, x.name) for x in rows}
    assert key(some) < key(every) and all(x.place <= X.MOST.get(x.type, 15) for x in some)
    assert X.records(papers.limit(0), frame.limit(0)).count() == 0


def test_sections_are_scanned_once(spark):
    sections = spark.createDataFrame([("a", 0, "results", "", "Results show that accuracy is 3.")], "doc string, ord long, role string, heading string, text string")
    found = X.records(spark.createDataFrame([("a", "Nets for maps")], "doc string, title string"), sections)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.type for r in found.collect()} >= {"finding", "metric", "method", "problem"}
