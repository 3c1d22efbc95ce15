"""Learned operators: held-out accuracy, probabilities, spans; packing against its definition."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import op1_langid as op1
from quillgraph.llm import op3_quality as op3
from quillgraph.llm import op4_ctw as op4
from quillgraph.llm import op7_pii as op7
from quillgraph.llm import op10_packing as op10

SF = "/root/testdata/sf0.001"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.mark.parametrize("k", [1, 2, 3, 4, 6, 9, 30])
def test_codewords_are_apart(k):
    code = op1.code_matrix(k)
    distances = [(code[a] != code[b]).sum() for a in range(k) for b in range(a)]
    assert code.shape[0] == k and (not distances or min(distances) >= max(1, code.shape[1] // 3))


def test_decoding_corrects_one_wrong_bit():
    code = op1.code_matrix(4).astype(float)
    model = op1.Model(list("abcd"), code, np.eye(code.shape[1]), np.zeros(code.shape[1]), np.ones_like(code))
    x = 3 * code.copy()
    x[:, 2] *= -1
    best, p, gap = model.decode(x)
    assert best.tolist() == [0, 1, 2, 3] and (p > 0.5).all() and (gap > 0).all()


def test_language_id_held_out(spark):
    docs = table(spark, "documents")
    out = op1.op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.95 and out["score"].between(0, 1).all()


def test_language_id_cases(spark, docs, rows, empty):
    model = op1.train(docs)
    out = op1.identify(docs, model).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["lang_pred"] in {"en", "fr", "es", "und"}
    assert {(r["lang_pred"], r["score"]) for r in out if r["doc_id"] in (1, 2, 3, 6)} == {("und", 0.0)}
    assert op1.train(empty) is None and op1.identify(empty, None).count() == 0
    assert {r["lang_pred"] for r in op1.identify(docs, None).collect()} == {"und"}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = op3.op3_quality(spark, sf).join(table(spark, "labels", sf), "doc_id").where("held_out").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.95
    assert ((out["score"] >= 0.3) == (out["predicted"] == 1)).all()


def test_quality_cases(spark, docs, rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    name = op3.score_name(docs)
    assert {r[name] for r in op3.score(docs, op3.train(docs, none)).collect()} == {0.5}
    some = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i, _, _ in rows if i is not None] + [(100, 0, 0), (101, None, 1)], "doc_id long, quality int, toxic int")
    scored = op3.score(docs, op3.train(docs, some))
    assert scored.columns[:-1] == docs.columns and all(0 <= r[name] <= 1 for r in scored.collect())
    assert op3.quality_filter(docs, some).columns == docs.columns
    assert op3.quality_filter(empty, some).count() == 0


def test_non_negative_risk_on_a_line():
    rng = np.random.default_rng(1)
    positive = rng.normal(2, 1, (600, 2))
    unlabelled = np.concatenate([rng.normal(2, 1, (600, 2)), rng.normal(-2, 1, (400, 2))])
    layers = op3.nn_pu(positive, unlabelled, 0.6, steps=400)
    g = op3._forward(layers, unlabelled)[-1][:, 0]
    assert ((g > 0) == np.r_[np.ones(600), np.zeros(400)].astype(bool)).mean() > 0.95


def test_lm_base_and_model(spark, docs, rows, empty):
    out = {(r["doc_id"], r["n_tokens"]): r for r in op4.score(docs).collect()}
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) + [None]) for i, t, _ in rows]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    count = Counter(w for i, ws in tokens if not held(i) for w in ws)
    total, kinds = sum(count.values()), len(count)
    for i, ws in tokens:
        r = out[i, len(ws)]
        assert r["held_out"] == held(i) and r["train_tokens"] == total and r["n_known"] == sum(count[w] > 0 for w in ws)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws), rel=1e-9)
        assert r["score"] < 0
    assert op4.score(empty).count() == 0


def ctw_by_force(texts, training):
    """log10 probability of each text by the definition: a dictionary of counts for every context, the recursion, the mixture over depths."""
    depth, counts, children = op4.DEPTH, {}, {}

    def steps(t):
        b = b"\xff" * depth + t + b"\xff"
        for i in range(depth, len(b)):
            for k in range(8):
                yield [(b[i - d : i], 1 << k | b[i] >> (8 - k)) for d in range(depth + 1)], b[i] >> (7 - k) & 1

    for t, use in zip(texts, training):
        for nodes, bit in steps(t) if use else ():
            for d, node in enumerate(nodes):
                counts.setdefault(node, [0, 0])[bit] += 1
                if d < depth:
                    children.setdefault(node, set()).add(nodes[d + 1])

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    log_w = {}
    for node in sorted(counts, key=lambda x: -len(x[0])):
        own = kt(*counts[node])
        log_w[node] = own if len(node[0]) == depth else math.log(0.5) + np.logaddexp(own, sum(log_w[c] for c in children[node]))
    out = []
    for t in texts:
        total = 0.0
        for nodes, bit in steps(t):
            p, left, last = 0.0, 1.0, 0.5
            for node in nodes:
                if node not in counts:
                    break
                last = (counts[node][bit] + 0.5) / (sum(counts[node]) + 1)
                own = 1.0
                if len(node[0]) < depth:
                    below = sum(log_w[c] for c in children[node])
                    own = 1 / (1 + math.exp(min(700, max(-700, below - kt(*counts[node])))))
                p += left * own * last
                left *= 1 - own
            total += math.log10(p + left * last)
        out.append(total)
    return out


@pytest.mark.parametrize("held", [100_000, 3])
def test_scores_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(op4, "HELD_GRAMS", held)
    r = random.Random(5)
    texts = [None, "", "Abracadabra", "ünïcode 中文 ünïcode"] + [" ".join(r.choice(["the", "then", "that", "cat", "café"]) for _ in range(r.randint(1, 9))) for _ in range(40)]
    out = {x["doc_id"]: x for x in op4.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert any(x["held_out"] for x in out.values())
    want = ctw_by_force([(t or "").encode().lower() for t in texts], [not out[i]["held_out"] for i in range(len(texts))])
    for i, (t, w) in enumerate(zip(texts, want)):
        assert out[i]["score"] == pytest.approx(w, rel=1e-5)
        assert out[i]["bits_per_byte"] == pytest.approx(-w * math.log2(10) / (len((t or "").encode()) + 1), rel=1e-5)


def test_ctw_is_a_probability():
    """Over all next bytes in known and unknown contexts the probabilities sum to one, and block weights obey the recursion."""
    texts = [b"abracadabra", b"abba", b"cab"] * 5
    codes, n = op4._distinct(op4.gram_codes(texts)[0])
    deep = op4.deep_levels(codes, n)
    top = op4.top_levels(*op4.up(deep[0], op4.TOP))
    for context in (b"abra", b"zzra", b"\xff\xff\xff\xff", b"zzzz"):
        ctx = int.from_bytes(context, "big") << 8
        grams = np.array([ctx | s for s in range(256)], np.uint64)
        p, left, last = op4.mixed(deep, op4.TOP + 1, grams)
        q = p + left * np.where(np.isnan(last), 0, last)
        q[np.isnan(last)] = np.nan
        assert (10 ** op4.finished(top, grams, np.ascontiguousarray(q.T))).sum() == pytest.approx(1, abs=1e-9)
    leaf = deep[-1]
    assert leaf.log_w == pytest.approx([math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for a, b in zip(leaf.zeros, leaf.ones)])
    _, _, _, below = op4.up(leaf, op4.DEPTH - 1)
    parent = deep[-2]
    assert parent.log_w == pytest.approx([math.log(0.5) + np.logaddexp(e, s) for e, s in zip(op4.kt_log(parent.zeros, parent.ones), below)])


def base_by_force(t):
    out = [("email", *m.span()) for m in op7.EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in op7.IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in op7.CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and op7.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in op7.PHONE.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1.@-+% é4(", max_size=60))
def test_base_spans(text):
    assert op7.base_spans(text) == base_by_force(text)


def test_luhn():
    assert op7.luhn("4111111111111111") and not op7.luhn("4111111111111112")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(1, 3)), min_size=1, max_size=7, unique=True), st.integers(0, 99))
def test_segment_marginals_by_enumeration(spans, seed):
    segments = sorted({(a, a + n) for a, n in spans})
    scores = np.random.default_rng(seed).normal(0, 1, (len(segments), len(op7.KINDS)))
    weights, total, best = np.zeros_like(scores), 0.0, (-np.inf, None)

    def walk(at, chosen, score):
        nonlocal total, best
        if at == len(segments):
            total += math.exp(score)
            best = max(best, (score, sorted(chosen)), key=lambda x: x[0])
            for k, y in chosen:
                weights[k, y] += math.exp(score)
            return
        walk(at + 1, chosen, score)
        if all(segments[at][0] >= segments[k][1] or segments[at][1] <= segments[k][0] for k, _ in chosen):
            for y in range(len(op7.KINDS)):
                walk(at + 1, [*chosen, (at, y)], score + scores[at, y])

    walk(0, [], 0.0)
    log_z, p = op7.marginals(segments, scores)
    assert log_z == pytest.approx(math.log(total)) and p == pytest.approx(weights / total)
    assert sorted(op7.forward(segments, scores, best=True)) == best[1]


def added_by_force(text, w, base):
    """Per region and gap between base spans: all segments, and the best of them by looking at every earlier end."""
    out = []
    for a, b in op7.regions(text):
        free = [all(not (s <= i < e) for _, s, e in base) for i in range(a, b)] + [False]
        start = None
        for i, ok in enumerate(free):
            if ok and start is None:
                start = a + i
            elif not ok and start is not None:
                segments, x = op7.candidates(text, start, a + i)
                best = {start: (0.0, [])}
                for end in sorted({e for _, e in segments}):
                    here = max(best.values(), key=lambda v: v[0])
                    for k, (s, e) in enumerate(segments):
                        if e == end:
                            before = max((v for p, v in best.items() if p <= s), key=lambda v: v[0])
                            for y in range(len(op7.KINDS)):
                                here = max(here, (before[0] + x[k] @ w[:, y], [*before[1], (y, k)]), key=lambda v: v[0])
                    best[end] = here
                out += [(op7.KINDS[y], *segments[k]) for y, k in max(best.values(), key=lambda v: v[0])[1] if x[k] @ w[:, y] > op7.MARGIN]
                start = None
    return out


@pytest.fixture(scope="module")
def pii_weights(spark):
    return op7.train(table(spark, "documents", "/root/testdata/sf0.01"))


def test_pii_query(spark, docs, rows, empty, pii_weights, frame):
    w = pii_weights
    more = [(600 + i, t, "en") for i, t in enumerate(["a.b@c.de 4111 1111 1111 1111 then +49 (0)30 1234567, host 10.0.0.300 and 1.2.3.4.5", "é john.smith [at] mail.example.com ü 4111/1111/1111/1111, 0049 30 1234567 x", "10[.]0[.]0[.]7 " * 5, "x" * 70 + "@" + "y" * 70])]
    out = {r["doc_id"]: r for r in op7.find(frame(spark, rows + more), w).collect()}
    for i, t, _ in rows + more:
        base = base_by_force(t or "")
        order = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (op7.KINDS.index(s[0]), s[1], s[2])))
        assert out[i]["base_sha256"] == hashlib.sha256(order(base).encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in op7.KINDS] == [sum(s[0] == k for s in base) for k in op7.KINDS]
        added = added_by_force(t or "", w, base)
        assert out[i]["spans"] == order(base + added) and out[i]["n_added"] == len(added)
    disguised = "Please write to john.smith [at] mail.example.com today"
    assert op7.added_spans(disguised, w, op7.base_spans(disguised)) == [("email", 16, 48)]
    assert op7.added_spans("The year 1984 had 12 months, 365 days.", w, []) == []
    assert op7.find(empty, w).count() == 0 and op7.train(empty) is None


@pytest.mark.parametrize("unit", ["jane.doe@example.com ", "10.0.0.1 ", "1", "+49 30 1234567 x", "a", "4111 1111 1111 1111, ", "@", "((", "1.1."])
def test_long_texts_take_time_in_proportion(pii_weights, unit):
    import time

    text = unit * (300_000 // len(unit))
    began = time.process_time()
    base = op7.base_spans(text)
    op7.added_spans(text, pii_weights, base)
    op7.training_windows(text[:50_000], 0)
    assert time.process_time() - began < 40


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abXYZ'st.,!?é Èßſ 1²½ \x85\x1c\n\tΣςİı中あé<|>ll", max_size=40))
def test_cached_tokens_equal_the_tokenizer(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = test_cached_tokens_equal_the_tokenizer.__dict__.setdefault("tokenizer", Tokenizer.from_file(path))
    assert np.frombuffer(op10.token_ids(text.encode(), path), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.sampled_from(["norm", "dot"]), st.integers(1, 8))
def test_best_fit_keeps_every_capacity(lengths, rule, most):
    cap = op10.Capacity(50, most, 900, rule=rule)
    lengths = np.array(lengths)
    bins, offsets = op10.best_fit(lengths, cap)
    for b in set(bins):
        rows = sorted(zip(offsets[bins == b], lengths[bins == b]))
        assert [o for o, _ in rows] == [sum(n for _, n in rows[:i]) for i in range(len(rows))]
        if len(rows) > 1:
            assert sum(n for _, n in rows) <= 50 and len(rows) <= most and sum(n * n for _, n in rows) <= 900


def test_other_tokenizers_get_whole_texts(tmp_path):
    """A tokenizer with other rules is called as it is; the results are its own."""
    import public_tokenizers
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Whitespace(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tokenizer.save(str(tmp_path / "other.json"))
    text = "Don't split 12 things like_this, it's fine"
    assert np.frombuffer(op10.token_ids(text.encode(), str(tmp_path / "other.json")), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_equals_its_definition(spark, docs, rows):
    """start, length and ids_crc32 of every piece from the tokenizer itself; every capacity binds in the second run."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tight = op10.Capacity(4096, 6, 400_000)
    for cap in (op10.Capacity(), tight):
        want = []
        for i, t, _ in rows:
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
            for k in range(0, len(ids), cap.tokens):
                part = ids[k : k + cap.tokens]
                want.append((-1 if i is None else i, k // cap.tokens, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
        out = op10.best_fit_packing(docs, cap=cap)
        got = out.toPandas()
        assert sorted(zip(got["doc_id"].fillna(-1).astype(int), got["piece"], got["start"], got["length"], got["ids_crc32"])) == sorted(want)
        for _, g in got.groupby("sequence_id"):
            assert len(g) == 1 or (g["length"].sum() <= cap.tokens and len(g) <= cap.documents and (g["length"] ** 2).sum() <= cap.attention)
    full = op10.fill(out, tight).first()
    assert full["sequences"] == got["sequence_id"].nunique() and 0 < full["documents"] <= 1
    many, cost = got.groupby("sequence_id").size(), (got["length"] ** 2).groupby(got["sequence_id"]).sum()
    assert (many == 6).any() and ((many > 1) & (cost > 0.9 * tight.attention)).any()  # each of the other capacities has closed a sequence


def test_rows_that_repeat_are_spread(spark):
    same = spark.createDataFrame([(None, None)] * 5000, "doc_id long, text string")
    assert op10.best_fit_packing(same).select("sequence_id").distinct().count() <= 3


def test_packing(spark, docs, rows, empty):
    out = op10.best_fit_packing(docs).toPandas()
    assert out.groupby("sequence_id")["length"].sum().max() <= 4096
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"].to_numpy() == np.r_[0, g["length"].cumsum()[:-1]]).all()
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 4096) + 2
    assert len(out[out["piece"] == 0]) == len(rows)
    long = out[out["doc_id"] == 30].sort_values("piece")
    assert (long["length"].iloc[:-1] == 4096).all() and (long["start"] == long["piece"] * 4096).all() and len(long) > 10
    assert out[out["doc_id"] == 1]["ids_crc32"].tolist() == [zlib.crc32(b"\1\0\0\0")]
    assert op10.best_fit_packing(empty).count() == 0
