"""Operators 11 to 13 against the library and against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import words
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import op11_sentencepiece as op11
from quillgraph.llm import op12_importance as op12
from quillgraph.llm import op13_lexical_search as op13

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PIECES = op11.Pieces(op11.model_path(), most=20)  # starts anew again and again


def key(rows):
    return sorted(map(tuple, rows), key=str)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab theqén.,01 \n\t\x00▁漢😀<>\r\x0b 　")), max_size=40), max_size=5))
def test_ids_and_texts_are_those_of_the_library(texts):
    assert PIECES.cuts
    ids, offsets = PIECES.encode([t.encode() for t in texts])
    want = [PIECES.whole.encode(t, add_eos=True) for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
    assert [t.decode() for t in PIECES.decode(ids, offsets)] == [PIECES.whole.decode(x) for x in want]


def test_any_ids_decode_as_in_the_library():
    r = random.Random(3)
    lists = [[r.choice([0, 1, 2, r.randrange(3, 259), r.randrange(259, 32_000), 259, 28_705]) for _ in range(r.randint(0, 8))] for _ in range(5000)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    got = PIECES.decode(np.array([i for x in lists for i in x], np.int32), offsets)
    assert [t.decode() for t in got] == [PIECES.whole.decode(x) for x in lists]


def test_a_chunk_is_segmented_once():
    pieces = op11.Pieces(op11.model_path())
    pieces.encode([b"the same words, the same words", b"the same words,"])
    pieces.encode([b"same the"])
    assert pieces.segmented == len(pieces.table) == 4  # with and without the comma


def test_other_models_get_whole_texts():
    pieces = op11.Pieces(op11.model_path())
    pieces.cuts = False
    ids, offsets = pieces.encode([b" a  b", b""])
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [pieces.whole.encode(t, add_eos=True) for t in (" a  b", "")]


@pytest.mark.parametrize("size", [1, 500, 8 << 20])
def test_sentencepiece(spark, docs, rows, empty, size):
    got = op11.decode(op11.encode(docs, slice_bytes=size, table=50)).collect()
    want = [(i, PIECES.whole.encode(t or "", add_eos=True)) for i, t, _ in rows]
    assert key((r.doc_id, r.ids, r.decoded) for r in got) == key((i, ids, PIECES.whole.decode(ids)) for i, ids in want)
    assert op11.decode(op11.encode(empty)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert key(op11.decode(nothing).select("doc_id", "decoded").collect()) == [(1, ""), (2, "")]


def test_sentencepiece_query(spark, tmp_path, docs, rows):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = [(i, PIECES.whole.encode(t or "", add_eos=True)) for i, t, _ in rows]
    got = op11.op11_sentencepiece(spark, str(tmp_path)).collect()
    assert key(got) == key((i, len(ids), sha(" ".join(map(str, ids))), sha(PIECES.whole.decode(ids))) for i, ids in want)


def terms(text):
    return WORD.findall((text or "").translate(LOW))


def features(text):
    w = terms(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def drawn_by_force(rows, target, least, percent, buckets):
    s, t = (Counter(zlib.crc32(f.encode()) % buckets for x in texts for f in features(x)) for texts in ([x for _, x, _ in rows], target))
    big_s, big_t = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for i, x, _ in rows:
        f = features(x)
        weight = sum(gain[zlib.crc32(y.encode()) % buckets] for y in f)
        h = int(sha(f"42:{'' if i is None else i}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, len(terms(x)) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return key(r[:5] for r in out)


@pytest.mark.parametrize("least,percent,buckets", [(20, 5, 10_000), (20, 100, 10_000), (0, 100, 7), (2, 50, 100)])
def test_importance_resampling(spark, docs, rows, empty, least, percent, buckets):
    target = [None, "", rows[6][1], "One two three one two", " ".join(words(50, 102))]
    bench = spark.createDataFrame([(i, t, 5) for i, t in enumerate(target)], "item_id long, text string, bucket int")
    got = op12.importance_resample(docs.union(docs).repartition(5), bench, least, percent, buckets)
    assert key(got.collect()) == drawn_by_force(rows + rows, target, least, percent, buckets)
    assert op12.importance_resample(empty, bench).count() == 0
    without = op12.importance_resample(docs, bench.limit(0), least, percent, buckets)
    assert key(without.collect()) == drawn_by_force(rows, [], least, percent, buckets)


def ranked_by_force(rows, items, k):
    held = [(i, Counter(terms(t))) for i, t, _ in rows if terms(t)]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    queries = {}
    for i, t in items:
        queries.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, query in queries.items():
        found = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // length
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in query.items() if t in c)
            if score > 0:
                found.append((-score, -1 if i is None else i, i))
        out += [(item, place, i, -s) for place, (s, _, i) in enumerate(sorted(found, key=lambda x: x[:2])[:k], 1)]
    return key(out)


@pytest.mark.parametrize("k,block,size,entries", [(20, 4 << 20, 8 << 20, 4 << 20), (3, 300, 700, 40), (1000, 4 << 20, 1, 1)])
def test_lexical_search(spark, docs, rows, empty, k, block, size, entries):
    items = [(1, "alpha1 beta2 gamma3 alpha1"), (2, None), (3, "!!"), (4, "ONE two"), (4, "One"), (5, rows[6][1]), (None, "no id here"), (7, " ".join(words(60, 105)) + " This VERY common line"), (8, "nowheretobefound")]
    bench = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, score int")
    got = op13.lexical_search(docs, bench, k, block, size, entries)
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint"]
    assert key(got.collect()) == ranked_by_force(rows, items, k)
    assert op13.lexical_search(empty, bench).count() == 0
    assert op13.lexical_search(docs, bench.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 40) - 1), max_size=200))
def test_radix_order_is_a_stable_sort(keys):
    keys = np.array([k % 50 << 30 | k % 3 for k in keys], np.int64)
    assert op13.radix_order(keys, 40).tolist() == np.argsort(keys, kind="stable").tolist()
