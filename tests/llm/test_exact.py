"""Exact operators against brute force: dedup, line dedup, Jaccard join, decontamination, WARC."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import common
from quillgraph.llm import op2_warc as op2
from quillgraph.llm import op5_exact_dedup as op5
from quillgraph.llm import op6_jaccard_join as op6
from quillgraph.llm import op8_line_dedup as op8
from quillgraph.llm import op9_decontaminate as op9

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(t):
    return (t or "").translate(LOW)


def key(t):
    return sorted(t, key=str)


def test_exact_dedup(spark, docs, rows, empty):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[low(t)].append(i)
    want = []
    for i, t, _ in rows:
        ids = groups[low(t)]
        top = max((x for x in ids if x is not None), default=None)
        want.append((i, top, len(ids), i == top, hashlib.sha256(low(t).encode()).hexdigest()))
    assert key(tuple(r) for r in op5.exact_dedup(docs).collect()) == key(want)
    assert op5.exact_dedup(empty).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.binary(max_size=2)), max_size=300), st.sampled_from([0, 5]))
def test_extendible_hash_tells_texts_apart(entries, skip):
    index, seen = op5.ExtendibleHash(skip, capacity=2), {}
    for h, text in entries:  # few hashes: chains hold several texts
        k = h * 0x9E3779B97F4A7C15 % (1 << 64)
        index.add(k, text)[2] += 1
        seen[k, text] = seen.get((k, text), 0) + 1
    assert {(k, e[0]): e[2] for b in index.buckets() for k, c in b[2].items() for e in c} == seen
    assert len(index.directory) == 1 << index.depth


def lines_by_force(rows):
    holders = defaultdict(set)
    strip = " \t\n\x0b\x0c\r"
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            k = low(x.strip(strip))
            if len(k) >= 10:
                holders[k].add(-1 if i is None else i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(k := low(x.strip(strip))) < 10 or len(holders[k]) < 2 or min(holders[k]) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


def test_line_dedup(spark, docs, rows, empty):
    out = op8.line_dedup(docs)
    names = op8.added_names(docs)
    got = [(r["doc_id"], *(r[n] for n in names)) for r in out.collect()]
    assert key(got) == key(lines_by_force(rows))
    assert out.columns[: len(docs.columns)] == docs.columns and {r["__block"] for r in out.collect()} == {r["__block"] for r in docs.collect()}
    assert op8.line_dedup(empty).count() == 0


def repeats_by_force(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = low(x.strip(" \t\n\x0b\x0c\r"))
            if len(k) >= 10:
                holders[op8.digest(k.encode())].add(-(1 << 63) if i is None else i)
    return {(k, len(v), min(v)) for k, v in holders.items() if len(v) > 1}


def test_line_table_is_reversible(spark, docs, rows):
    """After any insertions and deletions the repeats are those of the documents that are in, and changes add up to them."""
    table, now, held = op8.LineTable(spark, 4), {i: t for i, t, _ in rows}, {}

    def step(changes):
        for r in changes.collect():
            key = bytes(r["key"])
            assert held.get(key, (None, None)) == (r["refs_before"], r["owner_before"])
            held[key] = (r["refs"], r["owner"])
        got = {(bytes(r["key"]), r["refs"], r["owner"]) for r in table.repeats().collect()}
        assert got == repeats_by_force(now.items()) == {(k, *v) for k, v in held.items() if v[0]}
        return got

    before = step(table.insert(docs))
    assert not table.insert(docs).count()  # the same again changes nothing
    extra = {500: "This very common line stands in many documents.\nown line of twenty", 7: "own line of twenty\nshort"}
    now |= extra
    assert step(table.insert(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))) != before
    cleaned = {r["doc_id"]: r["text"] for r in table.clean(spark.createDataFrame([(20, now[20])], "doc_id long, text string")).collect()}
    assert "own line" not in cleaned[20]
    for gone in ([(500,), (7,)], [(20,), (21,)], [(i,) for i in now]):
        for (i,) in gone:
            now.pop(i, None)
        left = step(table.delete(spark.createDataFrame(gone, "doc_id long")))
        if gone[0] == (500,):
            assert left == before
    assert not left


def test_untouched_shards_stay_in_their_files(spark):
    table = op8.LineTable(spark, 64)
    table.insert(spark.createDataFrame([(i, f"line number {i} of many\nanother line {i % 7} here") for i in range(200)], "doc_id long, text string"))
    first, _ = table.state.versions[0]
    table.insert(spark.createDataFrame([(900, "line number 3 of many")], "doc_id long, text string"))
    assert table.state.versions[0][0] is first and len(table.state.versions[1][1]) == 1
    for i in range(901, 912):
        table.insert(spark.createDataFrame([(i, f"line number {i % 5} of many")], "doc_id long, text string"))
    assert len(table.state.versions) <= op8.Sharded.MOST_VERSIONS
    texts = [(i, f"line number {i} of many\nanother line {i % 7} here") for i in range(200)] + [(900, "line number 3 of many")] + [(i, f"line number {i % 5} of many") for i in range(901, 912)]
    assert {(bytes(r["key"]), r["refs"], r["owner"]) for r in table.repeats().collect()} == repeats_by_force(texts)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 60)), max_size=400))
def test_shard_keeps_exact_counts(steps):
    shard, counts = op8.LineShard(1), defaultdict(int)
    for add, n in steps:
        k = op8.digest(str(n).encode())
        if add:
            shard.add(k, 1, n)
            counts[k] += 1
        elif counts[k]:
            shard.remove(k)
            counts[k] -= 1
        assert all(shard.filter.contains(x) for x, c in counts.items() if c)
    assert {k: e[0] for k, e in shard.table.items()} == {k: c for k, c in counts.items() if c}


def test_cuckoo_filter_grows_and_keeps_all():
    shard = op8.LineShard(4)
    keys = [op8.digest(str(i).encode()) for i in range(5000)]
    for k in keys:
        shard.add(k, 1, 0)
    assert all(map(shard.filter.contains, keys)) and shard.filter.n * 4 >= 5000
    assert sum(shard.filter.contains(op8.digest(b"x%d" % i)) for i in range(5000)) < 25


def shingle_set(w):
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def components_by_force(rows):
    sets = []
    for i, t, _ in rows:
        w = low(t).encode().split()
        sets.append((i, shingle_set(w)))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    best = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        best[find(a)].append(i)
    small = {r: None if None in ids else min(ids) for r, ids in best.items()}
    return [(i, len(s), small[find(a)]) for a, (i, s) in enumerate(sets)]


def test_jaccard_components(spark, docs, rows, empty):
    assert key(tuple(r) for r in op6.jaccard_components(docs).collect()) == key(components_by_force(rows))
    assert op6.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("buckets, seed", [(2, 2), (1024, 64)])
def test_jaccard_families(spark, monkeypatch, buckets, seed):
    """Chains of near copies around the threshold and a passage that unrelated texts share."""
    monkeypatch.setattr(op6, "BUCKETS", buckets)
    r = random.Random(seed)
    passage, out = [f"p{i}" for i in range(25)], []
    for f in range(6):
        base = [f"w{r.randint(0, 5000)}" for _ in range(60)]
        for _ in range(7):
            out.append((len(out), " ".join(passage + base if f % 2 else base), "en"))
            for _ in range(r.randint(1, 3)):
                base[r.randrange(60)] = f"v{r.randint(0, 5000)}"
    docs = spark.createDataFrame([(i, t) for i, t, _ in out], "doc_id long, text string")
    assert key(tuple(x) for x in op6.jaccard_components(docs).collect()) == key(components_by_force(out))


def family(n, share=0.03, length=200):
    """Copies of one text with a share of its words changed at random: most pairs are just under the threshold."""
    r = random.Random(n)
    return [(i, " ".join(f"w{k}" if r.random() > share else f"v{r.randint(0, 10**9)}" for k in range(length)), "en") for i in range(n)]


def test_pairs_of_a_family_around_the_threshold_are_not_listed(spark, monkeypatch):
    """A family's candidates do not grow with the square of its size, and its components are those of brute force."""
    sizes, whole = [], op6.candidates

    def counted(*args):
        out = whole(*args)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(op6, "candidates", counted)
    for n in (100, 400):
        rows = family(n)
        got = op6.jaccard_components(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
        assert key(tuple(x) for x in got.collect()) == key(components_by_force(rows))
    assert sum(sizes[2:]) <= 400


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([2, 32]), st.sampled_from([1, 3, 12]), st.booleans())
def test_lists_leave_every_linking_pair(seed, block, hot, far):
    """Bounds, bitmaps, split lists and blocks never settle a pair that links: all pairs of linking sets of different components come out."""
    import pyarrow as pa

    r = random.Random(seed)
    sets = []
    for _ in range(3):
        base = [r.getrandbits(63) for _ in range(r.choice([8, 60, 400]))]
        for _ in range(12):
            sets.append({x if r.random() > 0.12 else r.getrandbits(63) for x in base})
    counts = defaultdict(int)
    for s in sets:
        for x in s:
            counts[x] += 1
    rows = []
    for k, s in enumerate(sets):
        tokens = np.array(sorted(s), np.uint64)
        row = op6.described(k, tokens, np.array([counts[int(t)].bit_length() - 1 for t in tokens], np.uint8))
        hub = k // 12 * 12 if far else k
        if row[3] is not None:
            rows.append((k, k, row[1], row[2], hub, len(s ^ sets[hub]), row[6], row[3], row[4]))
    linking = {(a, b) for b in range(len(sets)) for a in range(b) if 7 * len(sets[a] & sets[b]) >= 3 * (len(sets[a]) + len(sets[b]))}
    names = ("node", "comp", "n", "alone", "hub", "far", "map", "prefix", "kinds")
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names) if rows else None
    old, op6.BLOCK, op6.HOT = (op6.BLOCK, op6.HOT), block, hot
    try:
        entries = pa.Table.from_batches(list(op6._entries(3)([batch]))) if rows else None
        found = set()
        for part in range(3 if rows else 0):
            table = entries.filter(pa.compute.equal(entries["part"], part))
            if table.num_rows:
                out = pa.Table.from_batches(list(op6._candidates(False)(iter(table.to_batches()))))
                found |= set(zip(out["a"].to_pylist(), out["b"].to_pylist()))
                assert out["bound"].to_pylist() == [3 * (len(sets[a]) + len(sets[b])) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist())]
    finally:
        op6.BLOCK, op6.HOT = old
    assert linking <= found


def test_jaccard_links(spark, docs, rows, empty, monkeypatch):
    """Documents with their numbers of links, and links between classes, against all pairs; also with tokens counted by more than a byte and pairs that go out early."""
    out = []
    for held, data in ((op6.HELD, None), (4, family(60, 0.02))):
        monkeypatch.setattr(op6, "HELD", held)
        given = rows if data is None else [(i, t, None) for i, t, *_ in data]
        found, links = op6.jaccard_links(docs if data is None else spark.createDataFrame([r[:2] for r in given], "doc_id long, text string"))
        sets = [(i, low(t).encode().split(), shingle_set(low(t).encode().split())) for i, t, _ in given]
        linked = lambda x, y: bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)
        want = [(i, op6.digest(w).hex() if w else None, len(s), sum(linked(s, y) for k, (_, _, y) in enumerate(sets) if k != j)) for j, (i, w, s) in enumerate(sets)]
        assert key(tuple(r) for r in found.collect()) == key(want)
        classes = {op6.digest(w).hex(): s for _, w, s in sets if w}
        pairs = {(a, b, len(classes[a] & classes[b]), len(classes[a] | classes[b])) for a in classes for b in classes if a < b and linked(classes[a], classes[b])}
        got = [tuple(r) for r in links.collect()]
        assert len(got) == len(set(got)) and set(got) == pairs
        out.append(len(got))
    assert out[0] and out[1] > 100
    assert [x.count() for x in op6.jaccard_links(empty)] == [0, 0]


def test_offers_count_past_a_byte():
    import pyarrow as pa

    texts = [f"one two three four five six own{i} words{i} of{i} this{i}" for i in range(700)]
    docs = pa.table([pa.array(range(700)), pa.array(texts), pa.array([3] * 700, pa.int32())], ["doc_id", "text", "block"])
    side = pa.table([pa.array(range(700)), pa.array([op6.digest(t.encode().split()) for t in texts]), pa.array(range(700))], ["rep", "digest", "node"])
    offer = op6._offer(4)(docs, side)
    found = []
    for bucket in set(offer["bucket"].to_pylist()):
        out = op6._classes(offer.filter(pa.compute.equal(offer["bucket"], bucket)))
        for tokens, kinds in zip(out["tokens"].to_pylist(), out["kinds"].to_pylist()):
            assert len(tokens) == 4 * len(kinds)
            found += list(kinds)
    assert found == [9, 9]  # two shingles are in all 700 texts, 2 ** 9 <= 700 < 2 ** 10; all others in one


def test_one_of_each_keeps_columns(spark, docs, rows):
    kept = op6.one_of_each(docs)
    assert kept.columns == docs.columns
    want = [i for i, _, c in components_by_force(rows) if i == c]
    assert key(r["doc_id"] for r in kept.collect()) == key(want)


BENCH = [(1, " ".join(f"q{i}" for i in range(14))), (2, "tiny item"), (3, None), (4, "..."), (2, "tiny item"), (5, " ".join(f"q{i}" for i in range(5, 20)))]


def hits_by_force(rows, bench, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = [(str(i), w[k : k + window]) for i, t in bench if (w := split(t)) for k in range(max(1, len(w) - window + 1))]
    out = []
    for i, t, _ in rows:
        w, hit, items = split(t), set(), set()
        for item, win in windows:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    items.add(item)
        out.append((i, len(w), len(hit), sorted(items)))
    return out


@pytest.mark.parametrize("block", [4 << 20, 600])
def test_decontamination(spark, rows, empty, block, frame):
    extra = [(200, "Q1 q2 " + " ".join(f"Q{i}" for i in range(14)) + "; then a TINY, item!", "en"), (201, " ".join(f"q{i}" for i in range(20)) + " x " + " ".join(f"q{i}" for i in range(3, 13)), "en"), (202, "tiny tiny item item tiny item", "en")]
    few = [r for r in rows if r[0] != 30] + extra
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = frame(spark, few)
    found = op9.find_benchmark(docs, bench, phrase_bytes=block)
    n_words, spans, items = op9.added_names(docs)
    got = [(r["doc_id"], r[n_words], sum(s["end"] - s["start"] for s in r[spans]), r[items]) for r in found.collect()]
    assert key(got) == key(hits_by_force(few, BENCH))
    assert {r["doc_id"] for r in op9.decontaminate(docs, bench, block).collect()} == {i for i, _, h, _ in hits_by_force(few, BENCH) if not h}
    cleaned = {r["doc_id"]: r["text"] for r in op9.remove_spans(docs, bench).collect()}
    assert cleaned[200] == "Q1 q2 ; then a !" and cleaned[10] == dict((i, t) for i, t, _ in few)[10]
    assert op9.find_benchmark(empty, bench).count() == 0
    assert op9.find_benchmark(docs, bench.limit(0)).where(f"size({spans}) > 0").count() == 0


def test_decontamination_window_of_many_items(spark):
    """A line that all items share is one window there; a pass writes texts with hits alone, and no text."""
    line = " ".join(f"shared{i}" for i in range(10))
    bench = spark.createDataFrame([(i, f"{line} own{i}") for i in range(500)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before {line} after {i % 2}" if i % 3 else f"clean {i}") for i in range(60)], "doc_id long, text string")
    windows = op9.Benchmark(bench, phrase_bytes=4096)
    assert windows.blocks > 1 and windows.windows.count() == 501 and windows.pairs.count() == 1000
    hits = windows.hits(docs)
    assert hits.columns == ["digest", "spans", "wins"] and hits.count() == 2
    rows = op9.find_benchmark(docs, bench, phrase_bytes=4096).collect()
    assert {r["doc_id"]: len(r["__items"]) for r in rows} == {i: 500 if i % 3 else 0 for i in range(60)}
    assert all(r["__items"] == sorted(map(str, range(500))) and [tuple(s) for s in r["__spans"]] == [(1, 11)] for r in rows if r["doc_id"] % 3)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_fm_index_finds_all(seq, phrase):
    seq = [0, *seq, 0]
    index = op9.FMIndex(np.array(seq), 4)
    lo, hi = index.search(np.array([phrase + [0] * (4 - len(phrase))]), np.array([len(phrase)]))
    got = sorted(index.locate(np.arange(lo[0], max(lo[0], hi[0]))).tolist())
    assert got == [i for i in range(len(seq)) if seq[i : i + len(phrase)] == phrase]


def test_warc_round_trip(spark, tmp_path):
    pages = [(i, f"http://x/{i}", "<p>same</p>" if i % 3 == 0 else f"<p>é {i}</p>" + "z" * (i % 2) * 300_000) for i in range(12)]
    pages += [(50, None, None), (51, "http://e", ""), (9, "http://again", "<p>same</p>"), (None, "http://n", "<p>same</p>"), (None, "http://m", "alone")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, refers_to string")
    bundles = op2.write_bundles(df)
    got = op2.read_bundles(bundles).collect()
    tops = defaultdict(list)
    for i, _, h in pages:
        tops[h or ""].append(i)
    want = []
    for i, _, h in pages:
        top = max((x for x in tops[h or ""] if x is not None), default=None)
        body = (h or "").encode()
        revisit = top is not None and i != top
        want.append((i, len(body), op2.base32_sha1(body), "revisit" if revisit else "response", top if revisit else None, None if revisit else body))
    assert key((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got) == key(want)
    assert op2.read_bundles(op2.write_bundles(df.limit(0))).count() == 0
    names = [r["bundle"] for r in op2.export_bundles(bundles, str(tmp_path)).collect()]
    import io

    import zstandard

    for name in names:  # the file is plain Zstandard too: frames in a row, the seek table is skippable
        raw = (tmp_path / f"{name}.warc.zst").read_bytes()
        data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        at = 0
        while at < len(data):
            *_, at = op2.read_record(data, at)


def test_record_ids_are_unique_and_revisits_refer_to_one(spark):
    """Rows that repeat a page_id, a payload or all of it, null ids included."""
    pages = [(i % 3 if i % 4 else None, f"http://x/{i % 2}", f"<p>{i % 5 % 3}</p>") for i in range(60)] + [(7, "u", "same")] * 12
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    heads = []
    for row in op2.write_bundles(df).collect():
        reader = op2.BundleReader(bytes(row["data"]))
        for x in row["index"]:
            head, _, _, _ = reader.record(x["frame"], x["offset"])
            assert head["WARC-Record-ID"] == f"<{x['record_id']}>"
            heads.append(head)
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(set(ids)) == len(pages)
    by_id = {h["WARC-Record-ID"]: h for h in heads}
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert revisits
    for h in revisits:
        top = by_id[h["WARC-Refers-To"]]
        assert top["WARC-Type"] == "response" and top["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and top["X-Page-ID"] == h["X-Refers-To-Page-ID"]


def test_frames_are_independent():
    bundle = op2.Bundle()
    for i in range(60):
        bundle.add(f"r{i}", i, op2.write_record(i, "u", bytes([65 + i % 26]) * 20_000, None, f"r{i}", "D"))
    data, index = bundle.close()
    reader = op2.BundleReader(data)
    assert len(reader.table) > 3
    for rid, page, frame, offset, length in reversed(index):
        head, _, body, end = reader.record(frame, offset)
        assert (head["WARC-Record-ID"], body, end - offset) == (f"<{rid}>", bytes([65 + page % 26]) * 20_000, length)
    with pytest.raises(ValueError):
        op2.BundleReader(data[:-9] + b"\0" * 9)


def test_held_in_is_crc32_of_the_id(spark):
    df = spark.range(50).select(common.held_in("id", 5).alias("m"), "id")
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in df.collect())
