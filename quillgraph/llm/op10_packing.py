"""Best-fit packing of token pieces into sequences under several capacities.

Texts become ids through a word-level cache: the tokenizer's patterns never cross ASCII white space,
so a text's ids are its chunks' ids joined, and a chunk is sent to the tokenizer's model once a worker. Documents
get an end id and are cut only beyond the sequence length. Pieces are dealt to groups by hash; a group is
packed by vector best fit: every bin has residual tokens, residual documents and residual attention cost (the sum of squared
lengths); among the bins with room in all three, the one with the least weighted residual norm afterwards (or the largest weighted
dot product of demand and residual) takes the piece. Bins that stay underfilled are dissolved and packed again across groups.

Cases: null and empty texts give one piece with the end id alone; a text longer than a sequence is
cut into full pieces and a rest; repeated rows and repeated or null ids are packed as rows of their own; no documents give
no rows; extra columns are ignored. A piece must fit the capacities by itself, else it gets a sequence alone.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Bytes of text whose pieces make a group, groups at least, and pieces in a group of leftovers.
GROUP_BYTES, MIN_GROUPS, LEFTOVER_ROWS = 16 << 20, 16, 20_000
#: Bins filled below this share are dissolved once.
DISSOLVE = 0.97
#: Chunks and words that a worker remembers in each of two generations.
CACHE = 500_000

#: The pre-tokenizer's pattern, for text of ASCII and Latin letters that is in lower case.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.A)
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼½¾]|[^\s\x85\xa0a-zªµºß-öø-ſ0-9²³¹¼½¾]+", re.A)


#: What the rules above stand for. A tokenizer with other parts is called on whole texts.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes a byte that is no printable Latin-1 character as the next letter from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkCache(dict):
    """Chunk without white space -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        #: Whether the rules above are this tokenizer's; else whole texts go to it.
        self.known = all(parts.get(k) == v for k, v in RULES.items())
        self.letters, self.old = _byte_letters(), {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def _word(self, piece: str) -> bytes:
        found = self.words.get(piece)
        if found is None:
            found = self.old_words.get(piece)
            if found is None:
                ids = [t.id for t in self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
                found = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.words) >= CACHE:
                self.old_words, self.words = self.words, {}
            self.words[piece] = found
        return found

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= CACHE:  # what is in use is found in the old generation and moves to the new one
            self.old = dict(self)
            self.clear()
        ids = self.old.get(chunk)
        if ids is not None:
            self[chunk] = ids
            return ids
        text = chunk.decode()
        if b"<|" not in chunk and chunk.isascii():
            ids = b"".join(map(self._word, _ASCII.findall(text.lower())))
        elif b"<|" not in chunk and (low := self.tokenizer.normalizer.normalize_str(text)) and max(low) < "ƀ":
            ids = b"".join(map(self._word, _LATIN.findall(low)))
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[chunk] = ids
        return ids


_caches: dict[str, ChunkCache] = {}


def token_ids(text: bytes, path: str) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    cache = _caches.get(path)
    if cache is None:
        cache = _caches[path] = ChunkCache(path)
    if not cache.known:
        return np.array(cache.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
    return b"".join(map(cache.__getitem__, text.split()))


def _cut(path: str | None, length: int, end_id: int):
    tail = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        at = path or public_tokenizers.path("word_bpe_49k.json")
        for batch in C.slices(batches, 4 << 20):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), C.texts_of(batch.column("text"))):
                ids = token_ids(text, at) + tail
                for k, i in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[i : i + 4 * length]
                    rows.append((doc_id, k, i // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32."""
    return docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, length, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass(frozen=True)
class Capacity:
    """Of a sequence: tokens, documents, attention cost (sum of squared lengths); the weights of the choice; its rule.

    By default tokens alone can bind, as op10_best_fit_packing asks for as few sequences as it can: lengths that sum to 4096 are at most
    4096 documents and cost at most 4096 squared. Smaller capacities bind together.
    """

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"


def best_fit(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces are taken by falling length, ties in the order given."""
    n = len(lengths)
    full = np.array([cap.tokens, cap.documents, cap.attention], float)
    weights = np.array(cap.weights)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left, used = np.empty((256, 3)), 0
    open_ = np.empty(0, np.int64)  # bins that may still take the smallest piece
    order = np.argsort(-lengths, kind="stable")
    least = lengths.min() if n else 0
    for count, i in enumerate(order):
        need = np.array([lengths[i], 1, float(lengths[i]) ** 2])
        if count % 512 == 0 and len(open_):
            open_ = open_[(left[open_] >= [least, 1, float(least) ** 2]).all(1)]
        room = open_[(left[open_] >= need).all(1)] if len(open_) else open_
        if len(room):
            after = (left[room] - need) / full
            value = (weights * after * after).sum(1) if cap.rule == "norm" else -(weights * (need / full) * (left[room] / full)).sum(1)
            b = room[value.argmin()]
        else:
            b, used = used, used + 1
            if used > len(left):
                left = np.concatenate([left, np.empty_like(left)])
            left[b] = full
            if (need < full).any():
                open_ = np.append(open_, b)
        bins[i], offsets[i] = b, cap.tokens - left[b, 0]
        left[b] -= need
    return bins, offsets


def _pack(cap: Capacity, base: int, dissolve: float):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = table["length"].to_numpy()
        bins, offsets = best_fit(lengths, cap)
        fill = np.max([np.bincount(bins, v) / most for v, most in ((lengths, cap.tokens), (np.ones(len(lengths)), cap.documents), (lengths.astype(float) ** 2, cap.attention))], axis=0) if len(bins) else np.zeros(0)
        number = base + (table["group"][0].as_py() << 32) + bins
        out = table.drop_columns(["group"]).append_column("sequence_id", pa.array(number, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
        return out.append_column("loose", pa.array(fill[bins] < dissolve, pa.bool_()))

    return pack


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, loose boolean"


def pack(parts: DataFrame, total_bytes: int, cap: Capacity = Capacity()) -> DataFrame:
    """Adds sequence_id and offset to the pieces. They are written first, so that a row's number, which spreads rows that repeat over the groups, stays as it is."""
    groups = C.block_count(total_bytes, GROUP_BYTES, MIN_GROUPS)
    deal = lambda df, n: df.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(n)).cast("int")).groupBy("group")
    parts = C.materialize(parts, "pieces")
    first = C.materialize(deal(parts, groups).applyInArrow(_pack(cap, 0, DISSOLVE), _PACKED), "packed")
    C.discard(parts)
    loose = first.where("loose")
    again = max(1, -(-loose.count() // LEFTOVER_ROWS))
    second = deal(loose.drop("sequence_id", "offset", "loose"), again).applyInArrow(_pack(cap, 1 << 62, 0.0), _PACKED)
    return first.where(~F.col("loose")).unionByName(second).drop("loose")


def fill(packed: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """How full the sequences are: one row with sequences, and the mean share used of tokens, documents and attention cost."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("t"), F.count("*").alias("d"), F.sum(F.col("length") * F.col("length")).alias("a"))
    return used.agg(F.count("*").alias("sequences"), *[F.avg(F.col(c) / F.lit(most)).alias(name) for c, most, name in (("t", cap.tokens, "tokens"), ("d", cap.documents, "documents"), ("a", cap.attention, "attention"))])


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, cap: Capacity = Capacity(), end_id: int = 1) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, tokenizer, cap.tokens, end_id), C.text_bytes(docs), cap)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
