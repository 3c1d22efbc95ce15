"""Benchmark decontamination by an FM-index on each training shard.

A shard is the texts that a task holds at a time. Its words are coded by the words of the test phrases; all other words are
separators (no phrase can cross them), so the indexed sequence is the runs of phrase words that are long enough for the shortest
phrase. On it: suffix array by prefix doubling, Burrows-Wheeler transform, wavelet matrix for ranks, suffix positions sampled
every eighth word and at the start of each run. All phrases are searched backward at once; occurrences are located by walking
back to a sampled position, and the spans of a document are merged.

Windows are cut from the items where these lie, made distinct and numbered; they come in blocks of about ``PHRASE_BYTES``, each of which is broadcast
without items, so a window of very many items is one row there. The documents are read once a block, and a pass writes only what it has found: the digest of
a text with hits, its spans and the numbers of its windows. Items are joined by number afterwards, once for each distinct set of windows.

Cases: null text has no words and no hits; an item with null or wordless text has no window; equal windows belong to all
their items; a repeated item id counts once; a null item id is listed as the empty text; an empty benchmark or an empty document table gives zeros or no rows; extra columns are carried
along. Repeated rows get their result each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW = 10
#: Bytes of windows (ten words each, so about ten times the benchmark's text) that one pass takes; the broadcast is a few times that.
PHRASE_BYTES = 32 << 20
SHARD_BYTES = 8 << 20
SAMPLE = 8
#: Word bytes map to themselves in lower case, all others to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Zeros are separators; each differs from all others, in order of position."""
    n = len(seq)
    zeros = seq == 0
    n_zeros = int(zeros.sum())
    rank = np.where(zeros, np.cumsum(zeros) - 1, seq.astype(np.int64) + n_zeros)
    sa = np.argsort(rank, kind="stable")
    step = 1
    while True:
        ordered = rank[sa]
        if step > 1:
            second = np.where(sa + step // 2 < n, rank[np.minimum(sa + step // 2, n - 1)], -1)
            new = np.r_[True, (ordered[1:] != ordered[:-1]) | (second[1:] != second[:-1])]
        else:
            new = np.r_[True, ordered[1:] != ordered[:-1]]
        fresh = np.empty(n, np.int64)
        fresh[sa] = np.cumsum(new) - 1
        rank = fresh
        if new.all():
            return sa
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        # only ranks that are still shared need sorting again
        shared = np.flatnonzero(~(new & np.r_[new[1:], True]))
        part = sa[shared]
        sa[shared] = part[np.argsort(key[part], kind="stable")]
        step *= 2


class WaveletMatrix:
    """Ranks and access on a sequence of small integers, a bit vector with running counts for each level."""

    def __init__(self, seq: np.ndarray, symbols: int) -> None:
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.levels)):
            bit = (seq >> level & 1).astype(bool)
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """Occurrences of the symbols before each of the ends."""
        at = [np.zeros_like(symbol), *ends]
        for k, level in enumerate(reversed(range(self.levels))):
            bit = (symbol >> level & 1).astype(bool)
            ones = [self.ones[k][i] for i in at]
            at = [np.where(bit, self.zeros[k] + o, i - o) for i, o in zip(at, ones)]
        return [i - at[0] for i in at[1:]]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the places, and how often each occurs before its place."""
        symbol, start = np.zeros_like(i), np.zeros_like(i)
        for k in range(self.levels):
            o, s = self.ones[k][i], self.ones[k][start]
            bit = self.ones[k][i + 1] > o
            symbol = symbol << 1 | bit
            i = np.where(bit, self.zeros[k] + o, i - o)
            start = np.where(bit, self.zeros[k] + s, start - s)
        return symbol, i - start


class FMIndex:
    """Index of a sequence whose zeros are separators; the sequence begins with one."""

    def __init__(self, seq: np.ndarray, symbols: int) -> None:
        sa = suffix_array(seq)
        bwt = seq[sa - 1]
        self.n, self.wavelet = len(seq), WaveletMatrix(bwt.astype(np.int64), symbols)
        self.before = np.r_[0, np.cumsum(np.bincount(seq, minlength=symbols))].astype(np.int64)
        sampled = (sa % SAMPLE == 0) | (bwt == 0)
        self.sampled = np.r_[0, np.cumsum(sampled)].astype(np.int64)
        self.positions = sa[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the phrases (rows, filled up at the right)."""
        lo, hi = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64)
        live = np.arange(len(lengths))
        for k in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > k) & (hi[live] > lo[live])]
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - 1 - k]
            a, b = self.wavelet.rank(symbol, lo[live], hi[live])
            lo[live], hi[live] = self.before[symbol] + a, self.before[symbol] + b
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix rows."""
        found, steps, at = np.full(len(rows), -1, np.int64), 0, rows.astype(np.int64)
        live = np.arange(len(rows))
        while len(live):
            there = self.sampled[at[live] + 1] > self.sampled[at[live]]
            done = live[there]
            found[done] = self.positions[self.sampled[at[done]]] + steps
            live = live[~there]
            symbol, before = self.wavelet.access(at[live])
            at[live] = self.before[symbol] + before
            steps += 1
        return found


def _windows(window: int):
    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of each item, words joined by a space, ten thousand at a time."""
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), C.texts_of(batch.column("text"))):
                words = words_of(text)
                last = max(1, len(words) - window + 1) if words else 0
                for k in range(0, last, 10_000):
                    rows = [b" ".join(words[i : i + window]) for i in range(k, min(k + 10_000, last))]
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array([item] * len(rows), pa.string())], ["win", "item"])

    return windows


class Phrases:
    """A block of distinct windows (number, words joined by a space), coded by their own vocabulary (codes from 1)."""

    def __init__(self, rows: Iterable[tuple[int, bytes]], window: int = WINDOW) -> None:
        rows = list(rows)
        windows = [bytes(w).split(b" ") for _, w in rows]
        self.numbers = np.array([n for n, _ in rows], np.int64)
        self.code: dict[bytes, int] = {}
        for w in windows:
            for x in w:
                self.code.setdefault(x, len(self.code) + 1)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.words = np.zeros((len(windows), window), np.int64)
        for i, w in enumerate(windows):
            self.words[i, : len(w)] = [self.code[x] for x in w]
        self.least = int(self.lengths.min()) if windows else 0


def _shard(texts: list[bytes], phrases: Phrases) -> list[tuple[list[tuple[int, int]], list[int]]]:
    """For each text: merged hit spans in words, numbers of the windows found."""
    counts, runs, origin = [], [np.zeros(1, np.int64)], [np.full(1, -1, np.int64)]
    get, base = phrases.code.get, 0
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        if words and phrases.least:
            codes = np.array([get(w, 0) for w in words], np.int64)
            edge = np.flatnonzero(np.diff(np.r_[0, codes > 0, 0]))
            for a, b in zip(edge[::2], edge[1::2]):
                if b - a >= phrases.least:
                    runs += [codes[a:b], np.zeros(1, np.int64)]
                    origin += [np.arange(base + a, base + b), np.full(1, -1, np.int64)]
        base += len(words)
    spans: list[list] = [[] for _ in texts]
    found: list[set] = [set() for _ in texts]
    seq = np.concatenate(runs)
    if len(seq) > 1:
        index = FMIndex(seq, len(phrases.code) + 1)
        lo, hi = index.search(phrases.words, phrases.lengths)
        n = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(n)), n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        where = np.concatenate(origin)[index.locate(rows)]
        starts = np.cumsum([0, *counts])
        doc = np.searchsorted(starts, where, side="right") - 1
        for k in np.argsort(where, kind="stable"):
            d, a = int(doc[k]), int(where[k] - starts[doc[k]])
            b = a + int(phrases.lengths[which[k]])
            if spans[d] and spans[d][-1][1] >= a:
                spans[d][-1] = (spans[d][-1][0], max(b, spans[d][-1][1]))
            else:
                spans[d].append((a, b))
            found[d].add(int(phrases.numbers[which[k]]))
    return [(s, sorted(w)) for s, w in zip(spans, found)]


def merge_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS, _SPANS_DDL = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "array<struct<start: bigint, end: bigint>>"
#: The words of words_of, in a text as it is.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def added_names(docs: DataFrame) -> list[str]:
    """The columns that find_benchmark adds: __n_words, __spans, __items, with more underscores where the table has these."""
    return [C.free_name(docs, x) for x in ("__n_words", "__spans", "__items")]


def _text_key() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def _as_spans(spans: Iterable[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS)


def _pass(broadcast):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """digest, spans and windows of the texts that have hits."""
        for table in C.gathered(batches, SHARD_BYTES):
            hits = [(d, *f) for d, f in zip(table["digest"].to_pylist(), _shard(C.texts_of(table["text"]), broadcast.value)) if f[0]]
            if hits:
                digests, spans, wins = zip(*hits)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), _as_spans(spans), pa.array(wins, pa.list_(pa.int64()))], ["digest", "spans", "wins"])

    return run


def _without(broadcast):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows whose texts have no hit."""
        for table in C.gathered(batches, SHARD_BYTES):
            yield from table.filter(pa.array([not spans for spans, _ in _shard(C.texts_of(table["text"]), broadcast.value)], pa.bool_())).combine_chunks().to_batches()

    return run


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [merge_spans((x["start"], x["end"]) for x in row) for row in batch.column("spans").to_pylist()]
        yield batch.set_column(batch.schema.get_field_index("spans"), "spans", _as_spans(spans))


class Benchmark:
    """The windows of a benchmark: item pairs, distinct windows with numbers, and their blocks."""

    def __init__(self, benchmark: DataFrame, window: int = WINDOW, phrase_bytes: int = PHRASE_BYTES) -> None:
        items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
        self.window = window
        self.pairs = C.materialize(items.mapInArrow(_windows(window), "win binary, item string").distinct(), "decontaminate-windows")
        self.windows = C.materialize(self.pairs.select("win").distinct().select(F.monotonically_increasing_id().alias("number"), "win"), "decontaminate-numbers")
        self.blocks = C.block_count(int(self.windows.agg(F.sum(F.octet_length("win"))).first()[0] or 0), phrase_bytes, 1)

    def broadcast(self, k: int):
        rows = self.windows.where(C.block_of(self.blocks, "win") == k).collect()  # about phrase_bytes, by hash of short rows, each window once
        return self.windows.sparkSession.sparkContext.broadcast(Phrases(rows, self.window))

    def hits(self, docs: DataFrame) -> DataFrame:
        """digest, spans, wins of each distinct text with hits, a row a block that has some. Written."""
        texts, out = docs.select(_text_key().alias("digest"), "text"), None
        for k in range(self.blocks):
            phrases = self.broadcast(k)
            found = C.materialize(texts.mapInArrow(_pass(phrases), f"digest binary, spans {_SPANS_DDL}, wins array<bigint>").dropDuplicates(["digest"]), "decontaminate-pass")
            phrases.destroy()
            out = found if out is None else out.union(found)
        return out

    def items(self, hits: DataFrame) -> DataFrame:
        """digest, spans, items: hits of all blocks, merged, and the sorted items of their windows."""
        hits = hits.withColumn("set", F.sha2(F.array_join("wins", ","), 256))
        numbers = hits.dropDuplicates(["set"]).select("set", F.explode("wins").alias("number"))
        named = self.pairs.join(self.windows, "win").select("number", "item")
        by_set = numbers.join(named, "number").groupBy("set").agg(F.collect_set("item").alias("items"))
        whole = hits.join(by_set, "set").groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        return whole.mapInArrow(_merged, f"digest binary, spans {_SPANS_DDL}, items array<string>")


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """The documents with the columns of added_names: words, spans (merged, in words) and items. What was found is joined by digests of texts."""
    (n_words, spans, items), key = added_names(docs), C.free_name(docs, "__text")
    bench = Benchmark(benchmark, window, phrase_bytes)
    found = bench.items(bench.hits(docs)).toDF(key, spans, items)
    words = F.coalesce(F.regexp_count("text", F.lit(_WORD)).cast("long"), F.lit(0).cast("long"))
    rows = docs.withColumns({key: _text_key(), n_words: words}).join(found, key, "left")
    return rows.select(*docs.columns, n_words, F.coalesce(spans, F.array().cast(_SPANS_DDL)).alias(spans), F.coalesce(items, F.array().cast("array<string>")).alias(items))


def decontaminate(docs: DataFrame, benchmark: DataFrame, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """The documents without any hit, columns as they were: by one narrow pass if one block holds all windows, else by the digests of all that have hits."""
    bench = Benchmark(benchmark, phrase_bytes=phrase_bytes)
    if bench.blocks == 1:
        return docs.mapInArrow(_without(bench.broadcast(0)), C.schema_of(docs))
    key = C.free_name(docs, "__text")
    return docs.withColumn(key, _text_key()).join(bench.hits(docs).select(F.col("digest").alias(key)), key, "left_anti").select(docs.columns)


def _clean(names: list[str], spans_name: str):
    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        for batch in batches:
            texts = []
            for text, spans in zip(C.texts_of(batch.column("text")), batch.column(spans_name).to_pylist()):
                if spans:
                    at = [m.span() for m in word.finditer(text.lower())]
                    for s in reversed(spans):
                        text = text[: at[s["start"]][0]] + text[at[s["end"] - 1][1] :]
                texts.append(text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(texts, pa.binary()).cast(pa.string())).select(names)

    return clean


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with the merged spans cut out of their texts."""
    return find_benchmark(docs, benchmark).mapInArrow(_clean(docs.columns, added_names(docs)[1]), C.schema_of(docs))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n_words, spans, items = added_names(docs)
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id", F.col(n_words).alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size(spans) > 0).alias("contaminated")
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), i AS (
  SELECT item_id, least(len(w), 10) AS n, unnest([array_to_string(w[k : k + least(len(w), 10) - 1], ' ') FOR k IN range(1, greatest(len(w) - 9, 1) + 1)]) AS win FROM b WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM i
), dw AS (
  SELECT doc_id, s.n, unnest(range(1, len(w) - s.n + 2)) AS pos, unnest([array_to_string(w[k : k + s.n - 1], ' ') FOR k IN range(1, len(w) - s.n + 2)]) AS win FROM d, sizes s WHERE len(w) >= s.n
), h AS (SELECT dw.doc_id, dw.pos, dw.n, i.item_id FROM dw JOIN i USING (win, n)
), p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS q FROM h) GROUP BY doc_id
), t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
