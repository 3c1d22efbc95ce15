"""Ranked lexical search of many items against all documents, by sort-based accumulation.

Items are few words each and are taken in blocks of bounded size: a block's distinct terms and the items of each term (a table in
compressed rows) are broadcast, and all documents are read against it twice: for document frequencies, added up in each task
before one row a term is shuffled, and for scores. To score, a task lays the texts of a slice end to end, finds words by array
operations, counts each document's terms, and lays out one entry for each item of each matched term: item, document and
impact, concatenated in pieces of at most ``ENTRIES``. Packed keys (item, document) are radix-sorted by digits of 16 bits, and
``reduceat`` adds the impacts of equal keys. Sums that may still be among an item's best go to the item's heap. A task gives at most
``k`` rows an item; those are written, dealt by ranges of (item, doc_id), so that an item is spread over as many tasks
as it has rows, cut to ``k`` by heaps again, and ranked. Postings are never shuffled, so no term is a hot key.

Cases: null texts and texts without terms match nothing and do not count; neither do items without terms, which have no rows. Rows of one
item_id are one query: their terms are added up; a null item_id is an id. Documents that are there more than once are rows of their
own; a null doc_id comes before all others among equal scores. Scores of 0 are left out: a term in all documents may weigh 0. No documents or
no items give no rows. A long text is a slice of its own. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from .op12_importance import words

#: Documents an item; bytes of text in a slice; entries laid out at once; bytes of terms in a block of items.
TOP, SLICE_BYTES, ENTRIES, BLOCK_BYTES = 20, 8 << 20, 4 << 20, 4 << 20
_NO_ID = -(1 << 63)
_LETTERS = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_LOW = bytes((c + 32 if 65 <= c <= 90 else c) if _LETTERS[c] else 32 for c in range(256))


def found_terms(texts: list[bytes], codes: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text; then, for all words that have a code: number of the text, code."""
    data = b" ".join(texts).translate(_LOW)
    letter = _LETTERS[np.frombuffer(data, np.uint8)]
    begins = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]])) if len(data) else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
    n = np.diff(np.searchsorted(begins, bounds))
    if not len(begins):
        return n, np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.append(begins, len(data)).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = pc.ascii_rtrim(array, characters=" ").dictionary_encode()
    known = np.array([codes.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
    code = known[coded.indices.to_numpy()]
    hit = np.flatnonzero(code >= 0)
    return n, np.repeat(np.arange(len(texts)), n)[hit], code[hit]


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The order that sorts non-negative keys of so many bits, equal ones as they stand: by digits of 16 bits, lowest first."""
    order = np.arange(len(keys))
    for shift in range(0, bits, 16):
        digit = (keys[order] >> shift & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]  # for 16 bits this is a radix sort
    return order


class Best:
    """The best ``k`` documents of each item: a heap each, and the score that one must reach to come in."""

    def __init__(self, items: int, k: int) -> None:
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(items)]
        self.least, self.k = np.ones(items, np.int64), k

    def offer(self, items: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        may = np.flatnonzero(scores >= self.least[items])
        items, ids, scores = items[may], ids[may], scores[may]
        order = np.lexsort((ids, -scores, items))
        items, ids, scores = items[order], ids[order], scores[order]
        place = np.arange(len(items)) - np.searchsorted(items, items)
        for i, d, s in zip(*(x[place < self.k].tolist() for x in (items, ids, scores))):
            heap, entry = self.heaps[i], (s, -d)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.least[i] = max(heap[0][0], 1)

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for i, heap in enumerate(self.heaps):
            for s, d in sorted(heap, reverse=True):
                yield i, -d, s


class Index:
    """A block of items: terms by code, and for each term the items that have it and how often."""

    def __init__(self, rows: list) -> None:
        self.items = list(dict.fromkeys(r["item_id"] for r in rows))
        self.codes = {t: i for i, t in enumerate(dict.fromkeys(r["term"] for r in rows))}
        number = {x: i for i, x in enumerate(self.items)}
        listed = sorted((self.codes[r["term"]], number[r["item_id"]], r["reps"]) for r in rows)
        self.item, self.reps = (np.array([x[c] for x in listed], np.int64) for c in (1, 2))
        self.first = np.searchsorted(np.array([x[0] for x in listed]), np.arange(len(self.codes) + 1))

    def weigh(self, df: dict[int, int], n: int, length: int) -> None:
        """Weights from document frequencies; terms that weigh nothing are looked up no more."""
        self.n, self.length = n, length
        self.weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(self.codes))], np.int64)
        self.codes = {t: i for t, i in self.codes.items() if self.weight[i] and i in df}

    def m(self, n: np.ndarray) -> np.ndarray:
        """Length factor of each text; the product may be beyond 64 bits."""
        sizes, at = np.unique(n, return_inverse=True)
        return np.array([75 + 25 * int(x) * self.n // self.length for x in sizes], np.int64)[at]

    def score(self, texts: list[bytes], ids: np.ndarray, best: Best, entries: int) -> None:
        n, doc, code = found_terms(texts, self.codes)
        if not len(doc):
            return
        keys, tf = np.unique(doc * len(self.weight) + code, return_counts=True)
        doc, code = np.divmod(keys, len(self.weight))
        impact = self.weight[code] * (1_000_000_000 * tf // (1000 * tf + 12 * self.m(n)[doc]))
        fan = self.first[code + 1] - self.first[code]
        laid = np.concatenate([[0], np.cumsum(fan)])
        ends = np.append(np.flatnonzero(np.diff(doc)) + 1, len(doc))  # a text's terms stay together
        at = 0
        while at < len(doc):
            fit = np.searchsorted(laid[ends], laid[at] + entries, "right") - 1
            to = max(ends[max(fit, 0)], ends[np.searchsorted(ends, at, "right")])
            self._add(doc[at:to], code[at:to], impact[at:to], fan[at:to], ids, best)
            at = to

    def _add(self, doc: np.ndarray, code: np.ndarray, impact: np.ndarray, fan: np.ndarray, ids: np.ndarray, best: Best) -> None:
        place = np.repeat(self.first[code] - (np.cumsum(fan) - fan), fan) + np.arange(fan.sum())
        bits = max(int(doc[-1] - doc[0]).bit_length(), 1)
        packed = self.item[place] << bits | np.repeat(doc - doc[0], fan)
        order = radix_order(packed, bits + max(len(self.items) - 1, 1).bit_length())
        packed, added = packed[order], (np.repeat(impact, fan) * self.reps[place])[order]
        begins = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
        sums, pair = np.add.reduceat(added, begins), packed[begins]
        best.offer(pair >> bits, ids[(pair & (1 << bits) - 1) + doc[0]], sums)


def _ids(array: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(array.cast(pa.int64()), _NO_ID).to_numpy()


def _frequencies(shared, slice_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        seen, n_docs, length = np.zeros(len(index.codes), np.int64), 0, 0
        for held in C.gathered(batches, slice_bytes):
            n, doc, code = found_terms(C.texts_of(held["text"]), index.codes)
            seen += np.bincount(np.unique(doc * len(seen) + code) % len(seen), minlength=len(seen))
            n_docs, length = n_docs + int((n > 0).sum()), length + int(n.sum())
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at], pa.int32()), pa.array([n_docs, length, *seen[at]], pa.int64())], ["code", "n"])

    return run


def _score(shared, slice_bytes: int, entries: int, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        best = Best(len(index.items), k)
        for held in C.gathered(batches, slice_bytes):
            index.score(C.texts_of(held["text"]), _ids(held["doc_id"]), best, entries)
        yield _batch([(index.items[i], d, s) for i, d, s in best.rows()])

    return run


def _batch(rows: list) -> pa.RecordBatch:
    items, ids, scores = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array([None if d == _NO_ID else d for d in ids], pa.int64()), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])


def _cut(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by item: one heap at a time."""
        item, best, held = None, None, False
        for batch in batches:
            names = batch.column("item").to_pylist()
            ids, scores = _ids(batch.column("doc_id")), batch.column("score").to_numpy()
            edges = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
            for a, b in zip(edges, [*edges[1:], len(names)]):
                if not held or names[a] != item:
                    if held:
                        yield _batch([(item, d, s) for _, d, s in best.rows()])
                    item, best, held = names[a], Best(1, k), True
                best.offer(np.zeros(b - a, np.int64), ids[a:b], scores[a:b])
        if held:
            yield _batch([(item, d, s) for _, d, s in best.rows()])

    return run


def lexical_search(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES, slice_bytes: int = SLICE_BYTES, entries: int = ENTRIES) -> DataFrame:
    """item_id, rank, doc_id, score: the best ``k`` documents of each item, integer scores above 0."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    kind = items.schema["item_id"].dataType
    terms = items.select(F.col("item_id").cast("string"), F.explode(words("text")).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("reps"))
    terms = C.materialize(terms, "search-terms")
    blocks = C.block_count(int(terms.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0), block_bytes, 1)
    found, totals = spark.createDataFrame([], "item string, doc_id long, score long"), None
    for b in range(blocks):
        index = Index(terms.where(C.block_of(blocks, "item_id") == b).collect())  # about block_bytes, whole items
        if not index.items:
            continue
        counts = docs.mapInArrow(_frequencies(spark.sparkContext.broadcast(index), slice_bytes), "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
        df = dict(counts.collect())  # one row a term of the block
        totals = totals or (df.get(-2, 0), df.get(-1, 0))
        if not totals[1]:
            break
        index.weigh(df, *totals)
        rows = docs.mapInArrow(_score(spark.sparkContext.broadcast(index), slice_bytes, entries, k), "item string, doc_id long, score long")
        found = found.unionByName(C.materialize(rows, "search-best"))
    ranged = found.repartitionByRange("item", "doc_id").sortWithinPartitions("item").mapInArrow(_cut(k), "item string, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    ranked = ranged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), reps AS (SELECT item_id, term, count(*) AS reps FROM q GROUP BY item_id, term
), total AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM w WHERE len(w) > 0
), p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM reps) GROUP BY doc_id, n, term
), t AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(total.n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, total GROUP BY term
), s AS (
  SELECT item_id, doc_id, CAST(sum(reps * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * p.n * total.n) // total.l)))) AS BIGINT) AS score
  FROM p JOIN t USING (term) JOIN reps USING (term), total GROUP BY item_id, doc_id
), r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
