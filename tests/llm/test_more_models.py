"""Language codes and the quality risk against plain definitions; every disguise is a candidate and is found."""

import hashlib

import numpy as np
import pytest

from quillgraph.llm import op1_langid as op1
from quillgraph.llm import op3_quality as op3
from quillgraph.llm import op7_pii as op7

VALUES = {
    "email": ["anna.lee@mail.example.org", "x_1@host.example"], "ip": ["10.20.30.40", "192.168.0.7"], "card": ["4111 1111 1111 1111", "5500000000000004"],
    "phone": ["+1 (523) 010-9999", "+49 123 4567890", "+4915112345678", "+44 20 7946 0958"],
}
CONTEXT = ["Please write to me, the mail is {} and thanks.", "call or phone {} today.", "paid by card {} last week", "the server at {} is down"]


def made_docs(n=600):
    out = []
    for i in range(n):
        kind = list(VALUES)[i % 4]
        value = VALUES[kind][i // 4 % len(VALUES[kind])]
        shift = lambda v: "".join(str((int(c) + i * 7 + j * 3) % 10) if c.isdigit() and kind in ("phone",) and j > 3 else c for j, c in enumerate(v))
        out.append((i, f"{'Some words of no import. ' * (i % 3)}{CONTEXT[{'email': 0, 'phone': 1, 'card': 2, 'ip': 3}[kind]].format(shift(value))} Order {i * 37 % 9000 + 1000} of 20{i % 90 + 10}."))
    return out


def test_every_disguise_is_a_candidate():
    for kind, values in VALUES.items():
        for value in values:
            for way in range(8):
                shown = op7.disguised(kind, value, way)
                text = f"say it: {shown} ok"
                at = text.index(shown)
                found = [s for a, b in op7.regions(text) for s in op7.candidates(text, a, b)[0]]
                assert (at, at + len(shown)) in found, (kind, shown)


def test_recall_by_kind_and_way():
    cases = [(hashlib.md5(repr((i, k)).encode()).digest(), w, s) for i, t in made_docs() for k, (w, s) in enumerate(op7.training_windows(t, i))]
    w = op7.fit([(t, s) for _, t, s in sorted(cases)[:1500]])
    for kind in VALUES:
        for way in range(8):
            hits = 0
            for i, text in made_docs(80):
                base = [s for s in op7.base_spans(text) if s[0] == kind]
                if not base:
                    continue
                _, a, b = base[0]
                shown = op7.disguised(kind, text[a:b], way)
                again = text[:a] + shown + text[b:]
                known = op7.base_spans(again)
                spans = known + op7.added_spans(again, w, known)
                hits += any(k == kind and s <= a + 1 and e >= a + len(shown) - 1 for k, s, e in spans)
            assert hits >= 18, (kind, way, hits)  # of 20


def test_long_places_are_seen_in_pieces():
    windows = op7.training_windows("x " + "12 34 " * 400 + "y", 1)
    assert len(windows) == 6 and all(len(t) <= op7.PIECE + 80 for t, _ in windows)


def test_more_languages_than_rows_and_ties(spark):
    rows = [(i, f"zq{i % 60}w" * 6 + f" kappa{i % 60}", f"l{i % 60}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op1.train(docs, sample_rows=20)
    assert sorted(model.languages) == sorted({x[2] for x in rows})
    full = op1.train(docs)
    got = {r.doc_id: r.lang_pred for r in op1.identify(docs, full).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.9
    again = {r.doc_id: r.lang_pred for r in op1.identify(docs.repartition(7), op1.train(docs.repartition(5))).collect()}
    assert got == again


def test_decoding_by_all_codewords():
    r = np.random.default_rng(3)
    texts = [f"{'abcdefgh'[k % 8] * 3}{'xyz'[k % 3]} " * 5 for k in range(120)]
    model = op1.fit(op1.features([t.encode() for t in texts]), [f"l{k % 8}" for k in range(120)])
    x = op1.features([bytes(r.integers(97, 123, 30, dtype=np.uint8)) for _ in range(40)])
    best, p, gap = model.decode(x)
    assert len(best) == 40 and (p >= 0).all() and (p <= 1 + 1e-9).all() and (gap >= -1e-9).all()


@pytest.mark.parametrize("copies", [1, 40])
def test_quality_is_the_same_on_every_run(spark, copies):
    rows = [(i, ("Good prose, with a fair number of words. " if i % 2 else "$$$ BUY!!! 111 222 ") * 4 + str(i)) for i in range(120) for _ in range(copies if i < 3 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    scores = lambda d: sorted((r.doc_id, round(r["__score"], 9)) for r in op3.score(d, op3.train(d, labels, 40, 60)).select("doc_id", "__score").collect())
    assert scores(docs) == scores(docs.repartition(9))
