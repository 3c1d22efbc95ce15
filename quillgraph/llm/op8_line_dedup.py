"""Line dedup by sharded cuckoo filters over exact reference-count tables.

Documents are dealt to blocks by a hash of id and text. A block sends each of its line keys once, with the
number of its documents and the smallest id, to the shard of the key's digest, so a line that is
everywhere costs a row a block. A shard keeps a cuckoo filter in front of an exact table of
reference counts and owners: a key that the filter does not know is new and goes to the table without a look-up; one that it may know is
confirmed there. Keys with two or more documents go back to the blocks that asked, where the texts are rebuilt.
``LineTable`` keeps shards (filter, counts, owners) and references in the shared folder: later insertions and deletions of documents load
the shards they touch, and the result is always that of the documents which are in.

Cases: null or empty text is one empty line; keys under the least length always stay; a repeated line within
one document counts once but goes or stays as a whole; rows with equal ids are one document; a null id is
smaller than all others; no documents give no rows; extra columns are carried along.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Code points that a key has at least, documents that make it a repeat.
LEAST_CHARS, LEAST_DOCS = 10, 2
_BLANK = b" \t\n\x0b\x0c\r"
_NO_ID = -(1 << 63)


class CuckooFilter:
    """Partial-key cuckoo filter: 16-bit fingerprints, buckets of four; doubles when an insertion finds no room."""

    SLOTS, KICKS = 4, 200

    def __init__(self, expected: int = 64) -> None:
        self.n = 1 << max(4, (expected // 3).bit_length())
        self.cells = array("H", bytes(2 * self.SLOTS * self.n))
        self.kept: dict[int, int] | None = None

    @staticmethod
    def parts(key: bytes) -> tuple[int, int]:
        return int.from_bytes(key[4:10], "little"), int.from_bytes(key[10:12], "little") or 1

    def _other(self, i: int, fp: int) -> int:
        return (i ^ fp * 0x5BD1E995) & self.n - 1

    def contains(self, key: bytes) -> bool:
        h, fp = self.parts(key)
        i = h & self.n - 1
        j = self._other(i, fp)
        c = self.cells
        return fp in c[4 * i : 4 * i + 4] or fp in c[4 * j : 4 * j + 4]

    def insert(self, key: bytes) -> bool:
        """False if there is no room; the caller then rebuilds a larger filter from its exact table."""
        h, fp = self.parts(key)
        i = h & self.n - 1
        for b in (i, self._other(i, fp)):
            for s in range(4 * b, 4 * b + 4):
                if not self.cells[s]:
                    self.cells[s] = fp
                    return True
        trail = []
        for k in range(self.KICKS):
            s = 4 * i + (fp + k) % 4
            trail.append(s)
            fp, self.cells[s] = self.cells[s], fp
            i = self._other(i, fp)
            for s in range(4 * i, 4 * i + 4):
                if not self.cells[s]:
                    self.cells[s] = fp
                    return True
        for s in reversed(trail):  # put all back as it was
            fp, self.cells[s] = self.cells[s], fp
        return False

    def delete(self, key: bytes) -> None:
        h, fp = self.parts(key)
        i = h & self.n - 1
        for b in (i, self._other(i, fp)):
            for s in range(4 * b, 4 * b + 4):
                if self.cells[s] == fp:
                    self.cells[s] = 0
                    return


class LineShard:
    """Exact reference counts and owners behind a cuckoo filter."""

    def __init__(self, expected: int = 64) -> None:
        self.filter, self.table = CuckooFilter(expected), {}

    def add(self, key: bytes, references: int, owner: int) -> None:
        entry = self.table.get(key) if self.filter.contains(key) else None
        if entry is None:
            self.table[key] = [references, owner]
            if not self.filter.insert(key):
                self._rebuild()
        else:
            entry[0] += references
            entry[1] = min(entry[1], owner)

    def remove(self, key: bytes, references: int = 1) -> bool:
        """Take references away; True if the key is gone with them."""
        entry = self.table.get(key) if self.filter.contains(key) else None
        if entry is None:
            return False
        entry[0] -= references
        if entry[0] <= 0:
            del self.table[key]
            self.filter.delete(key)
            return True
        return False

    def _rebuild(self) -> None:
        n = 2 * self.filter.n
        while True:
            self.filter = CuckooFilter(3 * n - 1)
            if all(map(self.filter.insert, self.table)):
                return
            n *= 2


def line_key(line: bytes) -> bytes:
    return line.strip(_BLANK).lower()


def long_enough(key: bytes, least: int = LEAST_CHARS) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _id(x: int | None) -> int:
    return _NO_ID if x is None else x


def _keys(block: str, by_document: bool):
    """Digests of a block's line keys with the number of its documents and the smallest id, or a row a document."""

    def keys(table: pa.Table) -> pa.Table:
        found: dict[bytes, set] = {}
        for doc_id, text in zip(table["doc_id"].to_pylist(), C.texts_of(table["text"])):
            for key in {k for k in map(line_key, text.split(b"\n")) if long_enough(k)}:
                found.setdefault(digest(key), set()).add(_id(doc_id))
        if by_document:
            rows = [(key, 1, i) for key, ids in found.items() for i in ids]
        else:
            rows = [(key, len(ids), min(ids)) for key, ids in found.items()]
        number = table[block][0].as_py()
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.table([pa.array([number] * len(rows), pa.int32()), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["block", "key", "refs", "owner"])

    return keys


_KEYS = "block int, key binary, refs long, owner long"


def _shard(table: pa.Table) -> pa.Table:
    """The shard's repeats, for every block that has them."""
    blocks, keys, refs, owners = (table[c].to_pylist() for c in ("block", "key", "refs", "owner"))
    shard = LineShard(len(keys))
    for key, n, owner in zip(keys, refs, owners):
        shard.add(key, n, owner)
    rows = [(b, key, e[1]) for b, key in zip(blocks, keys) if (e := shard.table[key])[0] >= LEAST_DOCS]
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64())], ["block", "key", "owner"])


def _rebuild(names: list[str], added: list[str]):
    def rebuild(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        owners = dict(zip(repeats["key"].to_pylist(), repeats["owner"].to_pylist()))
        texts, lines_, dropped = [], [], []
        for doc_id, text in zip(docs["doc_id"].to_pylist(), C.texts_of(docs["text"])):
            lines = text.split(b"\n")
            me, kept = _id(doc_id), []
            for line in lines:
                key = line_key(line)
                if not owners or not long_enough(key) or owners.get(digest(key), me) == me:
                    kept.append(line)
            texts.append(b"\n".join(kept))
            lines_.append(len(lines))
            dropped.append(len(lines) - len(kept))
        out = docs.select(names)
        out = out.set_column(names.index("text"), "text", pa.array(texts, pa.binary()).cast(pa.string()))
        sha = pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())
        for name, values in zip(added, (pa.array(lines_, pa.int64()), pa.array(dropped, pa.int64()), sha)):
            out = out.append_column(name, values)
        return out

    return rebuild


def _shard_of(n: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"), F.lit(n)).cast("int")


def _blocks(docs: DataFrame) -> tuple[DataFrame, int, str]:
    """Documents dealt to blocks, how many, and the name of the column. Rows of one id and different texts may lie apart: a key
    that they alone hold may then count as a repeat, but its owner is that id, so nothing is dropped."""
    n, name = C.block_count(C.text_bytes(docs)), C.free_name(docs, "block")
    return C.dealt(docs.withColumn(name, C.block_of(n, "doc_id", "text")), n, name), n, name


def added_names(docs: DataFrame) -> list[str]:
    """The columns that line_dedup adds: __n_lines, __n_dropped, __kept_sha256, with more underscores where the table has these."""
    return [C.free_name(docs, x) for x in ("__n_lines", "__n_dropped", "__kept_sha256")]


def _rebuilt(docs: DataFrame, blocks: DataFrame, n: int, block: str, repeats: DataFrame) -> DataFrame:
    added = added_names(docs)
    schema = f"{C.schema_of(docs)}, `{added[0]}` long, `{added[1]}` long, `{added[2]}` string"
    return blocks.groupBy(block).cogroup(C.dealt(repeats, n).groupBy("block")).applyInArrow(_rebuild(docs.columns, added), schema)


def line_dedup(docs: DataFrame) -> DataFrame:
    """The documents with text rebuilt, all columns, and those of added_names."""
    blocks, n, block = _blocks(docs)
    keys = blocks.select("doc_id", "text", block).groupBy(block).applyInArrow(_keys(block, False), _KEYS)
    shards = C.dealt(keys.withColumn("shard", _shard_of(n)), n, "shard")
    repeats = shards.groupBy("shard").applyInArrow(_shard, "block int, key binary, owner long")
    return _rebuilt(docs, blocks, n, block, repeats)


# ---- later insertions and deletions --------------------------------------------------------------------


class Sharded:
    """Rows by shard in the shared folder. A change writes the shards that it touches; the others stay in the files they are in."""

    MOST_VERSIONS = 8

    def __init__(self, spark: SparkSession, schema: str, name: str) -> None:
        self.spark, self.schema, self.name = spark, schema, name
        self.versions: list[tuple[DataFrame, set[int]]] = []

    def table(self) -> DataFrame:
        out = self.spark.createDataFrame([], self.schema)
        for table, shards in self.versions:
            out = out.unionByName(table.where(F.col("shard").isin(sorted(shards))))
        return out

    def put(self, rows: DataFrame, replace: bool) -> None:
        """Rows of some shards, beside what these have or instead of it."""
        new = C.materialize(rows, self.name)
        touched = {r["shard"] for r in new.select("shard").distinct().collect()}  # as many as there are shards
        if replace:
            self.drop(touched)
        self.versions.append((new, touched))
        if len(self.versions) > self.MOST_VERSIONS:
            whole = C.materialize(self.table(), self.name)
            for table, _ in self.versions:
                C.discard(table)
            self.versions = [(whole, set().union(*(s for _, s in self.versions)))]

    def drop(self, shards: set[int]) -> None:
        """Forget all rows of these shards."""
        kept = [(table, s - shards) for table, s in self.versions]
        for table, s in kept:
            if not s:
                C.discard(table)
        self.versions = [x for x in kept if x[1]]


_STATE = "shard int, filter binary, keys binary, refs binary, owners binary"
_CHANGE = "key binary, refs long, owner long, refs_before long, owner_before long"
_NEXT = f"{_STATE}, {_CHANGE.replace('refs long', 'refs_now long').replace('owner long', 'owner_now long')}"


def _loaded(state: pa.Table) -> LineShard:
    shard = LineShard()
    for row in state.to_pylist():
        cells = array("H", row["filter"])
        shard.filter.cells, shard.filter.n = cells, len(cells) // CuckooFilter.SLOTS
        refs, owners = array("q", row["refs"]), array("q", row["owners"])
        shard.table = {row["keys"][16 * i : 16 * i + 16]: [r, o] for i, (r, o) in enumerate(zip(refs, owners))}
    return shard


def _update(deltas: pa.Table, state: pa.Table) -> pa.Table:
    """A shard after references came (refs > 0) or went (refs < 0, owner: the smallest that is left), as one row, and a row for each repeat that changed."""
    number = deltas["shard"][0].as_py()
    shard, changes = _loaded(state), []
    view = lambda e: (e[0], e[1]) if e and e[0] >= LEAST_DOCS else (None, None)
    for key, refs, owner in zip(deltas["key"].to_pylist(), deltas["refs"].to_pylist(), deltas["owner"].to_pylist()):
        before = view(shard.table.get(key) if shard.filter.contains(key) else None)
        if refs > 0:
            shard.add(key, refs, owner)
        elif not shard.remove(key, -refs):
            shard.table[key][1] = owner
        after = view(shard.table.get(key))
        if after != before:
            changes.append((None,) * 4 + (key, *after, *before))
    packed = [array("q", [e[k] for e in shard.table.values()]).tobytes() for k in (0, 1)]
    rows = [(shard.filter.cells.tobytes(), b"".join(shard.table), *packed, None, None, None, None, None), *changes]
    kinds = [*[pa.binary()] * 5, *[pa.int64()] * 4]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    return pa.table([pa.array([number] * len(rows), pa.int32()), *columns], [f.split()[0] for f in _NEXT.split(", ")])


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, refs, owners in zip(*(batch.column(c).to_pylist() for c in ("keys", "refs", "owners"))):
            refs, owners = array("q", refs), array("q", owners)
            some = [i for i, r in enumerate(refs) if r >= LEAST_DOCS]
            yield pa.RecordBatch.from_arrays([pa.array([keys[16 * i : 16 * i + 16] for i in some], pa.binary()), pa.array([refs[i] for i in some], pa.int64()), pa.array([owners[i] for i in some], pa.int64())], ["key", "refs", "owner"])


class LineTable:
    """Line keys under insertions and deletions of documents.

    A shard is a row: its cuckoo filter and its exact counts and owners. A change loads the shards that it
    touches, goes through their filters, writes them again and leaves the others. References (shard, key, owner)
    lie beside them, by which a deletion finds the lines of a document and the next owner. ``shards``: so many that
    the keys of one, some 60 bytes each, fit a task.
    """

    def __init__(self, spark: SparkSession, shards: int = C.MIN_BLOCKS) -> None:
        self.spark, self.shards = spark, shards
        self.state = Sharded(spark, _STATE, "line-state")
        self.references = Sharded(spark, "shard int, key binary, owner long", "line-references")

    def _change(self, deltas: DataFrame) -> DataFrame:
        touched = deltas.select("shard").distinct()
        state = self.state.table().join(touched, "shard", "left_semi")
        out = C.materialize(deltas.groupBy("shard").cogroup(state.groupBy("shard")).applyInArrow(_update, _NEXT), "line-change")
        self.state.put(out.where("filter is not null").select("shard", "filter", "keys", "refs", "owners"), True)
        return out.where("filter is null").select("key", F.col("refs_now").alias("refs"), F.col("owner_now").alias("owner"), "refs_before", "owner_before")

    def insert(self, docs: DataFrame) -> DataFrame:
        """Take documents in; returns the repeats that changed: key, refs, owner and both before, null where it is or was none. A line that a document has already is not counted again."""
        blocks, _, block = _blocks(docs.select("doc_id", "text"))
        rows = blocks.groupBy(block).applyInArrow(_keys(block, True), _KEYS).select(_shard_of(self.shards).alias("shard"), "key", "owner").distinct()
        new = C.materialize(rows.join(self.references.table(), ["shard", "key", "owner"], "left_anti"), "line-new")
        changes = self._change(new.groupBy("shard", "key").agg(F.count("*").alias("refs"), F.min("owner").alias("owner")))
        self.references.put(new, False)
        C.discard(new)
        return changes

    def delete(self, ids: DataFrame) -> DataFrame:
        """Take the documents of ``ids.doc_id`` out; returns what changed, like insert. Their lines may become unique again."""
        leaving = ids.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("owner")).distinct()
        now = self.references.table()
        gone = C.materialize(now.join(leaving, "owner", "left_semi"), "line-gone")
        touched = gone.select("shard").distinct()
        left = C.materialize(now.join(touched, "shard", "left_semi").join(leaving, "owner", "left_anti"), "line-left")
        lost = gone.groupBy("shard", "key").agg((-F.count("*")).alias("refs"))
        heirs = left.join(lost.select("shard", "key"), ["shard", "key"], "left_semi").groupBy("shard", "key").agg(F.min("owner").alias("owner"))
        changes = self._change(lost.join(heirs, ["shard", "key"], "left"))
        self.references.drop({r["shard"] for r in touched.collect()})  # as many as there are shards
        self.references.put(left.select("shard", "key", "owner"), False)
        for done in (gone, left):
            C.discard(done)
        return changes

    def repeats(self) -> DataFrame:
        """key, refs, owner of the lines that two or more of the present documents hold."""
        return self.state.table().mapInArrow(_unpacked, "key binary, refs long, owner long")

    def clean(self, docs: DataFrame) -> DataFrame:
        """Documents rebuilt by the present repeats, as line_dedup returns them."""
        blocks, n, block = _blocks(docs)
        asked = blocks.select("doc_id", "text", block).groupBy(block).applyInArrow(_keys(block, False), _KEYS)
        return _rebuilt(docs, blocks, n, block, asked.select("block", "key").join(self.repeats(), "key").select("block", "key", "owner"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = added_names(docs)
    return line_dedup(docs).select("doc_id", *[F.col(x).alias(x.strip("_")) for x in names])


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (r.key IS NOT NULL AND r.owner <> k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (r.key IS NULL OR r.owner = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN r ON k.key = r.key GROUP BY k.doc_id
"""
