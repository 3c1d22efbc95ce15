"""Exact dedup by an extendible-hash index on shared files.

Each map task first folds the equal texts it sees into one representative (bytes compared), so a text
that a third of all rows share costs one row a task. Representatives go to the owner of their
key range (the leading bits of a 64-bit hash). An owner inserts them into an extendible-hash
index: a directory of 2**g slots points to buckets, an overfull bucket splits and doubles the directory
if need be; keys with equal hashes chain within their bucket and are told apart by their bytes. Buckets are
written to the shared folder as the index; rows then look their answer up by (hash, digest, length).

Cases: null text counts as empty; empty texts are equal; repeated rows are members of the group like any
other; if the largest doc_id occurs twice, each such row is kept; a null doc_id is smaller than all others,
and a group with null ids alone has keep_id null and keeps its rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Distinct hashes in a bucket before it splits.
BUCKET = 64
#: Bytes of text that an owner's key range has at most, on average.
OWNER_BYTES = 16 << 20
_NO_ID = -(1 << 63)


class ExtendibleHash:
    """Directory-doubling hash index; ``add`` returns the entry of an equal text or of a new one."""

    def __init__(self, skip_bits: int = 0, capacity: int = BUCKET) -> None:
        self.skip, self.capacity, self.depth = skip_bits, capacity, 0
        self.directory: list[list] = [[0, 0, {}]]  # [local depth, prefix, {hash: chain of entries}]

    def _slot(self, key: int) -> int:
        return (key << self.skip & 0xFFFFFFFFFFFFFFFF) >> (64 - self.depth) if self.depth else 0

    def chain(self, key: int) -> list:
        return self.directory[self._slot(key)][2].get(key, [])

    def add(self, key: int, text: bytes) -> list:
        """Entry [text, largest id, rows] for this text; texts with an equal hash share a chain."""
        bucket = self.directory[self._slot(key)]
        chain = bucket[2].get(key)
        if chain is not None:
            for entry in chain:
                if entry[0] == text:
                    return entry
        else:
            while len(bucket[2]) >= self.capacity and bucket[0] < 64 - self.skip:
                self._split(bucket)
                bucket = self.directory[self._slot(key)]
            chain = bucket[2][key] = []
        chain.append([text, _NO_ID, 0])
        return chain[-1]

    def _split(self, bucket: list) -> None:
        if bucket[0] == self.depth:
            self.directory = [b for b in self.directory for _ in (0, 1)]
            self.depth += 1
        local, prefix, keys = bucket
        halves = [[local + 1, prefix << 1 | bit, {}] for bit in (0, 1)]
        shift = 63 - local
        for key, chain in keys.items():
            halves[(key << self.skip & 0xFFFFFFFFFFFFFFFF) >> shift & 1][2][key] = chain
        span = 1 << self.depth - local - 1
        first = prefix << self.depth - local
        for bit in (0, 1):
            self.directory[first + bit * span : first + (bit + 1) * span] = [halves[bit]] * span

    def buckets(self) -> Iterator[list]:
        last = None
        for bucket in self.directory:
            if bucket is not last:
                yield bucket
            last = bucket


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _representatives(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct normalised text of about 8 MB of rows: hash, text, largest id, rows."""
    for table in C.gathered(batches, 8 << 20):
        index = ExtendibleHash()
        for doc_id, text in zip(table["doc_id"].to_pylist(), C.texts_of(table["text"])):
            low = text.lower()
            entry = index.add(xxhash.xxh64_intdigest(low), low)
            entry[1] = max(entry[1], _NO_ID if doc_id is None else doc_id)
            entry[2] += 1
        rows = [(_signed(key), *entry) for bucket in index.buckets() for key, chain in bucket[2].items() for entry in chain]
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["h", "body", "top", "n"])


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's id with its text's hash and digest."""
    for batch in batches:
        low = [x.lower() for x in C.texts_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array([_signed(xxhash.xxh64_intdigest(x)) for x in low], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in low], pa.string())],
            ["doc_id", "h", "sha"],
        )


def _own(bits: int):
    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Builds the index of each owner in this task; rows come in order of owner."""
        index, owner = None, None

        def emit(owner: int, index: ExtendibleHash) -> pa.RecordBatch:
            rows = [(owner, b[0], b[1], _signed(key), at, hashlib.sha256(e[0]).hexdigest(), len(e[0]), None if e[1] == _NO_ID else e[1], e[2]) for b in index.buckets() for key, chain in b[2].items() for at, e in enumerate(chain)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["owner", "local_depth", "prefix", "h", "chain", "sha", "n_bytes", "keep_id", "group_size"])

        for batch in batches:
            for own_id, h, body, top, n in zip(*(batch.column(c).to_pylist() for c in ("owner", "h", "body", "top", "n"))):
                if own_id != owner:
                    if index:
                        yield emit(owner, index)
                    index, owner = ExtendibleHash(bits), own_id
                entry = index.add(h % (1 << 64), body)
                entry[1], entry[2] = max(entry[1], top), entry[2] + n
        if index:
            yield emit(owner, index)

    return own


_INDEX = "owner int, local_depth int, prefix long, h long, chain int, sha string, n_bytes long, keep_id long, group_size long"


def build_index(docs: DataFrame, total_bytes: int) -> DataFrame:
    """The index as a table of bucket entries in the shared folder: owner, bucket (prefix, local_depth), hash, place in the chain, answer."""
    bits = max(5, (total_bytes // OWNER_BYTES).bit_length())
    reps = docs.mapInArrow(_representatives, "h long, body binary, top long, n long").withColumn("owner", F.shiftrightunsigned("h", 64 - bits).cast("int"))
    owned = C.dealt(reps, 1 << bits, "owner").sortWithinPartitions("owner")
    return C.materialize(owned.mapInArrow(_own(bits), _INDEX), "hash-index")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256 (of the text with A-Z lower-cased)."""
    docs = docs.select("doc_id", "text")
    index = build_index(docs, C.text_bytes(docs))
    members = docs.mapInArrow(_members, "doc_id long, h long, sha string")
    found = members.join(index.select("h", "sha", "keep_id", "group_size"), ["h", "sha"])
    return found.select("doc_id", "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), g AS (SELECT low, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY low)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.low) AS text_sha256
FROM t JOIN g USING (low)
"""
