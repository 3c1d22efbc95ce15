"""Language-model scoring by context-tree weighting of bytes, beside a unigram base score.

A byte is coded as eight binary decisions; each decision has its own tree of contexts (the last ``DEPTH`` bytes at most).
A node keeps the counts of zeros and ones, estimates by Krichevsky-Trofimov, and its weighted
probability is half its own estimate and half the product of its children's. After training, a decision's probability
is the mixture over all depths with the weights that this gives; contexts without training data take the
estimate of their longest known suffix. The byte 0xFF, which UTF-8 never has, fills the context at the start and
ends the text, so the probabilities of all texts sum to at most one.

Counts cover every training text. They are gathered by (depth+1)-gram and by word; subtrees below two bytes of context are
computed where their grams are, the two deepest levels some contexts at a time, and only the top of the tree (contexts of at most one byte: at most
257 * 255 nodes, whatever the corpus) is seen by the driver. Texts are dealt to blocks; a block asks once for each word and gram it
holds, so frequent ones cost a row a block, and no table that grows with the corpus is broadcast.

Cases: null text counts as empty, which has the end alone; repeated rows are counted and scored each; a null id
is hashed as the empty text; without training rows the base score is that of N = 0 and V = 0, and the model
is uniform (half a bit's probability for each decision); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

DEPTH, MIDDLE, TOP = 4, 2, 1
FOLDS = 10
CHUNK = 8 << 20
#: Grams in a partition of subtrees on average, and grams whose deepest levels are held together.
PART_GRAMS, HELD_GRAMS = 500_000, 100_000
END = b"\xff"
WORD, GRAM = b"w", b"g"


def gram_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams (context and symbol, newest byte lowest) of all texts and the number of each text's."""
    a = np.frombuffer(b"".join(END * DEPTH + t + END for t in texts), np.uint8)
    g = np.zeros(len(a), np.uint64)
    for k in range(DEPTH + 1):
        g[k:] |= a[: len(a) - k].astype(np.uint64) << np.uint64(8 * k)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(lengths + DEPTH) - lengths - DEPTH
    keep = np.ones(len(a), bool)
    keep[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
    return g[keep], lengths


def gram_key(code: int) -> bytes:
    return GRAM + int(code).to_bytes(DEPTH + 1, "big")


def _gram_keys(codes: np.ndarray) -> pa.Array:
    """Gram keys as a binary array, without a Python object for each."""
    width = DEPTH + 2
    raw = np.empty((len(codes), width), np.uint8)
    raw[:, 0] = GRAM[0]
    raw[:, 1:] = codes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width + 1 :]
    offsets = np.arange(len(codes) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])


def _codes(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are grams, and the grams of these; read from the array's buffers, without a Python object for each."""
    offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1]
    raw = np.frombuffer(keys.buffers()[2] or b"", np.uint8)
    start = offsets[:-1]
    gram = raw[start] == GRAM[0] if len(keys) else np.zeros(0, bool)
    out = np.zeros(int(gram.sum()), np.uint64)
    for k in range(1, DEPTH + 2):
        out = out << np.uint64(8) | raw[start[gram] + k]
    return gram, out


def _distinct(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = np.sort(g)
    at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    return g[at], np.diff(np.r_[at, len(g)])


def _tally(texts: list[bytes]) -> tuple[Counter, np.ndarray, np.ndarray]:
    words: Counter = Counter()
    for t in texts:
        words.update(t.split())
    words[b""] = len(texts)  # the end
    return words, *_distinct(gram_codes(texts)[0])


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of a chunk of texts with how often the training texts have them."""
    for table in C.gathered(batches, CHUNK):
        training = np.array(table["training"].to_pylist(), bool)
        texts = [t.lower() for t in C.texts_of(table["text"])]
        words, grams, n = _tally([t for t, x in zip(texts, training) if x]) if training.any() else (Counter(), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        if not training.all():
            other, more, _ = _tally([t for t, x in zip(texts, training) if not x])
            for w in other:
                words.setdefault(w, 0)
            more = np.setdiff1d(more, grams)
            grams, n = np.concatenate([grams, more]), np.concatenate([n, np.zeros(len(more), np.int64)])
        keys = pa.concat_arrays([pa.array([WORD + w for w in words], pa.binary()), _gram_keys(grams)])
        counts = pa.concat_arrays([pa.array(words.values(), pa.int64()), pa.array(n, pa.int64())])
        yield from pa.table([keys, counts], ["key", "n"]).to_batches()


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    lg = np.vectorize(math.lgamma, otypes=[float])
    both, at = np.unique(np.concatenate([zeros, ones]), return_inverse=True)
    half = lg(both + 0.5)[at]
    total, back = np.unique(zeros + ones, return_inverse=True)
    return half[: len(zeros)] + half[len(zeros) :] - lg(total + 1.0)[back] - math.log(math.pi)


@dataclass
class Level:
    """Nodes of one depth by key (context << 8 | bits of the symbol so far, with a leading one)."""

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    log_w: np.ndarray  # logarithm of the weighted probability
    own: np.ndarray  # the share that the node's own estimate has in predictions

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


def level_of(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> Level:
    """``below``: the sum of the children's log_w, none at the deepest level. Keys are sorted and distinct."""
    estimate = kt_log(zeros, ones)
    if below is None:
        return Level(keys, zeros, ones, estimate, np.ones(len(keys)))
    return Level(keys, zeros, ones, np.logaddexp(estimate, below) - math.log(2), 1 / (1 + np.exp(np.clip(below - estimate, -700, 700))))


def _bits(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Node keys at a depth and the bit taken there, a row for each of the eight decisions."""
    code = codes & np.uint64((1 << 8 * (depth + 1)) - 1)
    context, symbol = code >> np.uint64(8) << np.uint64(8), code & np.uint64(255)
    k = np.arange(8, dtype=np.uint64)[:, None]
    return context | (np.uint64(1) << k | symbol >> (np.uint64(8) - k)), (symbol >> (np.uint64(7) - k) & np.uint64(1)).astype(bool)


def grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    found, at = np.unique(keys, return_inverse=True)
    return found, *(np.bincount(at, v, minlength=len(found)).astype(float) for v in values)


def up(level: Level, depth: int) -> tuple[np.ndarray, ...]:
    """Keys, counts and sums of log_w at the depth above: the oldest byte of the context goes."""
    node = level.keys & np.uint64(255)
    context = level.keys >> np.uint64(8) & np.uint64((1 << 8 * depth) - 1)
    return grouped(context << np.uint64(8) | node, level.zeros, level.ones, level.log_w)


def deep_levels(codes: np.ndarray, n: np.ndarray, above: int = TOP) -> list[Level]:
    """Levels above + 1 to DEPTH of the trees whose grams these are."""
    seen = n > 0
    keys, bit = _bits(codes[seen], DEPTH)
    weight = np.broadcast_to(n[seen].astype(float), keys.shape)
    k, zeros, ones = grouped(keys.ravel(), np.where(bit, 0, weight).ravel(), np.where(bit, weight, 0).ravel())
    levels = [level_of(k, zeros, ones, None)]
    for depth in range(DEPTH - 1, above, -1):
        levels.insert(0, level_of(*up(levels[0], depth)))
    return levels


def mixed(levels: list[Level], first: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each decision (8 rows): the mixture over these levels so far, the weight left for deeper ones, the last known estimate."""
    p, left, last = np.zeros((8, len(codes))), np.ones((8, len(codes))), np.full((8, len(codes)), 0.5 if first == 0 else np.nan)
    for d, level in enumerate(levels, first):
        keys, bit = _bits(codes, d)
        at, there = level.look_up(keys.ravel())
        at, there = at.reshape(keys.shape), there.reshape(keys.shape)
        if len(level.keys):
            taken = np.where(bit, level.ones[at], level.zeros[at])
            estimate = (taken + 0.5) / (level.zeros[at] + level.ones[at] + 1)
            own = np.where(there, level.own[at], 0)
            p += left * own * np.where(there, estimate, 0)
            left = left * (1 - own)
            last = np.where(there, estimate, last)
    return p, left, last


def _whole(column: pa.ChunkedArray) -> pa.Array:
    """A binary column as one array."""
    joined = column.combine_chunks()
    joined = pa.concat_arrays(joined.chunks) if isinstance(joined, pa.ChunkedArray) else joined
    return joined.cast(pa.binary())


def below(levels: list[Level], first: int, codes: np.ndarray, q: np.ndarray | None = None) -> np.ndarray:
    """Mixtures from level ``first`` down (8 rows), NaN where no context is known; q: those below these levels."""
    p, left, last = mixed(levels, first, codes)
    deeper = last if q is None else np.where(np.isnan(q), last, q)  # what is left goes to the longest known context
    return np.where(np.isnan(deeper), np.nan, p + left * np.where(np.isnan(deeper), 0, deeper))


def _context_chunks(codes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """An order of grams by their last three bytes of context, newest first, and pieces of it of about HELD_GRAMS that cut no such context."""
    context = codes >> np.uint64(8)
    key = (context & np.uint64(0xFF)) << np.uint64(16) | context & np.uint64(0xFF00) | context >> np.uint64(16) & np.uint64(0xFF)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    cuts, pieces, start = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [], 0
    for wish in range(HELD_GRAMS, len(codes), HELD_GRAMS):
        k = np.searchsorted(cuts, max(wish, start + 1))
        if wish > start and k < len(cuts):
            pieces.append((start, int(cuts[k])))
            start = int(cuts[k])
    return order, [*pieces, (start, len(codes))]


def _deep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtrees of this partition's contexts: grams with their deep mixture, and what the top of the tree needs of them."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    _, codes = _codes(_whole(table["key"]))
    n = table["n"].to_numpy()
    order, pieces = _context_chunks(codes)
    codes, n = codes[order], n[order]
    q, sums = np.empty((8, len(codes)), np.float32), []
    for a, b in pieces:
        levels = deep_levels(codes[a:b], n[a:b], MIDDLE)
        q[:, a:b] = below(levels, MIDDLE + 1, codes[a:b])
        sums.append(up(levels[0], MIDDLE))
    middle = level_of(*grouped(*(np.concatenate(x) for x in zip(*sums))))
    for a in range(0, len(codes), HELD_GRAMS):
        part = codes[a : a + HELD_GRAMS]
        packed = np.ascontiguousarray(below([middle], MIDDLE, part, q[:, a : a + HELD_GRAMS]).T, np.float32)
        offsets = np.arange(len(part) + 1, dtype=np.int32) * 32
        packed = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(packed.tobytes())])
        none = pa.nulls(len(part), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), packed, none, none, none], ["code", "q", "zeros", "ones", "below"])
    keys, zeros, ones, sums = up(middle, TOP)
    yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.nulls(len(keys), pa.binary()), pa.array(zeros), pa.array(ones), pa.array(sums)], ["code", "q", "zeros", "ones", "below"])


def top_levels(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> list[Level]:
    levels = [level_of(keys, zeros, ones, below)]
    for depth in range(TOP - 1, -1, -1):
        levels.insert(0, level_of(*up(levels[0], depth)))
    return levels


def finished(levels: list[Level], codes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's symbol in its context; q: deep mixtures (grams by decisions)."""
    p, left, last = mixed(levels, 0, codes)
    return np.log10(p + left * np.where(np.isnan(q.T), last, q.T)).sum(0)


def model(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """A value for every word (log10 of its share, with the other sign if no training text has it) and gram (log10 of its symbol's probability, to seven digits) of the corpus; N and V."""
    spark = docs.sparkSession
    rows = docs.select("text", (C.held_in("doc_id", FOLDS) != 0).alias("training"))
    counts = C.materialize(rows.mapInArrow(_count, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n")), "lm-counts")
    is_word = F.substring("key", 1, 1) == F.lit(WORD)
    known = is_word & (F.col("n") > 0)
    total, kinds, n_grams = counts.agg(F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)), F.count(F.when(known, 1)), F.count(F.when(~is_word, 1))).first()
    grams = counts.where(~is_word)
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")), n_grams // PART_GRAMS)
    deep = C.materialize(grams.repartition(parts, F.substring("key", DEPTH - TOP + 1, TOP + 1)).mapInArrow(_deep, "code long, q binary, zeros double, ones double, below double"), "lm-deep")
    top = deep.where("q is null").groupBy("code").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).toArrow()  # at most 256 * 255 rows
    order = np.argsort(top["code"].to_numpy())
    columns = [top.column(i).to_numpy()[order] for i in range(4)]
    levels = spark.sparkContext.broadcast(top_levels(columns[0].astype(np.uint64), *columns[1:]))

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("code").to_numpy().astype(np.uint64)
            q = np.frombuffer(b"".join(batch.column("q").to_pylist()), np.float32).reshape(-1, 8).astype(float)
            yield pa.RecordBatch.from_arrays([_gram_keys(codes), pa.array(finished(levels.value, codes, q).astype(np.float32).astype(float))], ["key", "value"])

    of_grams = deep.where("q is not null").select("code", "q").mapInArrow(finish, "key binary, value double")
    share = F.log10((F.col("n") + 0.1) / F.lit(total + 0.1 * (kinds + 1)))
    of_words = counts.where(is_word).select("key", F.when(F.col("n") > 0, share).otherwise(F.greatest(-share, F.lit(1e-300))).alias("value"))
    values = C.materialize(of_words.unionByName(of_grams), "lm-values")
    for done in (counts, deep):  # a value a gram is left of a count and eight mixtures
        C.discard(done)
    return values, total, kinds


def _ask(table: pa.Table) -> pa.Table:
    """The words and grams of a block, once each."""
    block = table["block"][0].as_py()
    words: set = {b""}
    grams = np.zeros(0, np.uint64)
    for part in C.gathered(table.to_batches(), CHUNK):
        texts = [t.lower() for t in C.texts_of(part["text"])]
        for t in texts:
            words.update(t.split())
        grams = np.union1d(grams, _distinct(gram_codes(texts)[0])[0])
    keys = pa.concat_arrays([pa.array([WORD + w for w in words], pa.binary()), _gram_keys(grams)])
    return pa.table([pa.array(np.full(len(keys), block, np.int32)), keys], ["block", "key"])


class Values:
    """Values of distinct grams by a table of hashes; grams whose slot another has taken are found by bisection."""

    def __init__(self, codes: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(codes)
        self.codes, self.values = codes[order], values[order]
        self.shift = np.uint64(64 - max(8, (8 * len(codes)).bit_length()))
        self.slots = np.zeros(1 << 64 - int(self.shift), np.int32)
        self.slots[self._slot(self.codes)] = np.arange(len(codes), dtype=np.int32)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return codes * np.uint64(0x9E3779B97F4A7C15) >> self.shift

    def __getitem__(self, codes: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(codes)]
        other = np.flatnonzero(self.codes[at] != codes)
        at[other] = np.searchsorted(self.codes, codes[other])
        return self.values[at]


def _score(docs: pa.Table, answers: pa.Table) -> pa.Table:
    keys, values = _whole(answers["key"]), answers["value"].to_numpy()
    gram, codes = _codes(keys)
    log_p = Values(codes, values[gram])
    found = [k[1:] for k in keys.filter(pa.array(~gram)).to_pylist()]
    words = dict(zip(found, (-np.abs(values[~gram])).tolist()))
    unseen = {w for w, s in zip(found, values[~gram] > 0) if s}
    out = []
    for part in C.gathered(docs.to_batches(), CHUNK // 2):
        texts = [t.lower() for t in C.texts_of(part["text"])]
        g, lengths = gram_codes(texts)
        scores = np.add.reduceat(log_p[g], np.cumsum(lengths) - lengths)
        bits = -scores * math.log2(10) / lengths
        for doc_id, held_out, text, score, per_byte in zip(part["doc_id"].to_pylist(), part["held_out"].to_pylist(), texts, scores, bits):
            tokens = [*text.split(), b""]
            known = len(tokens) - (sum(map(unseen.__contains__, tokens)) if unseen else 0)
            out.append((doc_id, held_out, len(tokens), known, sum(map(words.__getitem__, tokens)), float(score), float(per_byte)))
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 7, kinds)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])


def score(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (the end counts as a byte)."""
    docs = docs.select("doc_id", "text")
    values, total, _ = model(docs)
    n = C.block_count(C.text_bytes(docs))
    held_out: Column = C.held_in("doc_id", FOLDS) == 0
    blocks = docs.select("doc_id", "text", held_out.alias("held_out"), C.block_of(n, "doc_id", "text").alias("block"))
    blocks = C.dealt(blocks, n)
    asked = blocks.select("text", "block").groupBy("block").applyInArrow(_ask, "block int, key binary")
    answers = asked.join(values, "key").select("block", "key", "value")
    scored = blocks.groupBy("block").cogroup(C.dealt(answers, n).groupBy("block")).applyInArrow(_score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
