"""Exact Jaccard join of shingle sets with set-relation skipping, and its components.

Sets are distinct hashes of five-word shingles, 64 bits each: "exact" holds up to collisions of those. Two sets link when
``100 * |x & y| >= 75 * |x | y|``, that is ``7 * |x & y| >= 3 * (|x| + |y|)``, or ``7 * d <= |x| + |y|`` with d the elements in one of them alone.

1. Texts with the same words are one node; the smallest doc_id represents it.
2. Shares: how many nodes have each token is counted over all of them. Documents are dealt to blocks; a block sends its distinct
   tokens, four bytes each, to the token's bucket and gets back the class (logarithm of the count) of those that others have as
   well. Sets are in the order of class and hash, so tokens of one node alone come first and need no list; a set with more than
   a quarter of such tokens links with nothing and leaves here. Overlaps are counted on the shared tokens, as no others can meet.
3. Stars: of the sets that share a minimum hash, the one with the fewest tokens of its own is the hub, and the others are compared with it.
   One that links is anchored there, and what sets it apart from the hub is kept.
4. Index: the listed tokens of all sets, by token. Sets of one component need no comparison. Lists lie in blocks by
   size and position; pairs of blocks that no qualifying pair can be in are skipped. A pair is settled unseen by its
   positions, by the tokens of its own, by distances to a common hub (``d(x, y) >= |d(x, hub) - d(y, hub)|``), or by parity bitmaps of the
   shared tokens (each differing bit is an element in one set alone). Tokens that very many sets have are split over cells that each pair meets in.
5. What is left is compared exactly, and a set's answer is derived from its hub's: ``|x & y| = |x & hub| - |x & (hub - y)| + |x & (y - hub)|``.
   First the best pair of every two components that meet in a part, so that components merge; then all pairs that are left
   between components. Pairs whose components have merged are never written.
6. Components of all links, by minimum labels with pointer jumping.

The answer of ``jaccard_components`` is each document's component: links within one are not counted, as in a group of near copies they are
quadratic. ``jaccard_links`` lists all of them, between texts with different words, and counts those of each document.

Cases: null, empty and wordless texts have the empty set, link with nothing and are their own component; fewer than five words
are one shingle; repeated rows get the same answer each; rows of one id and different texts are compared like any others; a null id is
smaller than all others (its component_id is null); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WORDS, BANDS = 5, 4
#: Entries in a block of a list, and pairs that are looked at together.
BLOCK, TOGETHER = 32, 1 << 18
#: Pairs of a part that are kept to tell repeated ones apart.
HELD = 4 * TOGETHER
#: Buckets of tokens at least and at most, and bytes of text for each between.
BUCKETS, MOST_BUCKETS, BUCKET_BYTES = 1024, 1 << 16, 32 << 20
#: Tokens of more than 2 ** HOT sets have their lists split.
HOT = 12
#: Parts of the lists at least (more than most sets have listed tokens, so that rows grow as the input does), bytes of lists in a part, and of sets in a block of comparisons.
PARTS, PART_BYTES, COMPARE_BYTES = 1024, 2 << 20, 8 << 20
#: Bits of the parity maps, and the largest set for each but the last.
MAP_BITS, MAP_SIZES = (512, 2048, 8192), (256, 1024)
_NO_ID = -(1 << 63)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_NONE = np.zeros(0, np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text's words."""
    if not words:
        return _NONE
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    h = w[:n] * _MIX[0]
    for k in range(1, WORDS):
        h += w[k : n + k] * _MIX[k]
    return np.unique(_scatter(h))


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def prefix_length(n: int) -> int:
    return n + (-3 * n // 4) + 1


def parity_map(tokens: np.ndarray, n: int) -> bytes:
    """One bit a bucket: whether it holds an odd number of the tokens. n: size of the whole set, which decides the width."""
    bits = MAP_BITS[sum(n > m for m in MAP_SIZES)]
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each document's words, null without any."""
    for batch in C.slices(batches, 8 << 20):
        split = (t.lower().split() for t in C.texts_of(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("block"), pa.array([digest(w) if w else None for w in split], pa.binary())], ["doc_id", "block", "digest"])


# ---- which tokens are shared ---------------------------------------------------------------------------


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Slices of an array as binary values."""
    offsets = np.r_[cuts, len(values)].astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _cut(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of sorted keys (the first bits of tokens, 32 and those of the bucket) and where each begins."""
    bucket = (keys >> np.uint64(32)).astype(np.int32)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    return bucket[cuts], cuts


def _nodes(docs: pa.Table, nodes: dict) -> Iterator[tuple[int, np.ndarray]]:
    """The sets of a block's nodes; ``nodes`` by (doc_id, digest), each taken once."""
    for part in C.gathered(docs.to_batches(), 4 << 20):
        for doc_id, text in zip(part["doc_id"].to_pylist(), C.texts_of(part["text"])):
            words = text.lower().split()
            node = nodes.pop((doc_id, digest(words)), None) if words else None
            if node is not None:
                yield node, shingles(words)


def _offer(bits: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        """A block's distinct tokens by bucket, and how many of its nodes have each: a byte, or 255 and four bytes in ``more``."""
        found = [_NONE]
        for _, s in _nodes(docs, dict(zip(zip(side["rep"].to_pylist(), side["digest"].to_pylist()), side["node"].to_pylist()))):
            found.append(s >> np.uint64(32 - bits))
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        bucket, cuts = _cut(keys)
        block = np.full(len(bucket), docs["block"][0].as_py() if docs.num_rows else 0, np.int32)
        many = n >= 255
        more = _packed(n[many].astype(np.uint32), np.r_[0, np.cumsum(many)][cuts])
        return pa.table([pa.array(block), pa.array(bucket), _packed(keys.astype(np.uint32), cuts), _packed(np.minimum(n, 255).astype(np.uint8), cuts), more], ["block", "bucket", "tokens", "n", "more"])

    return run


def _classes(table: pa.Table) -> pa.Table:
    """From a bucket's offers: for each block its tokens that two nodes or more have, with the logarithm of their number."""
    sizes = [len(x) // 4 for x in table["tokens"].to_pylist()]
    tokens = np.frombuffer(b"".join(table["tokens"].to_pylist()), np.uint32)
    counts = np.frombuffer(b"".join(table["n"].to_pylist()), np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(b"".join(table["more"].to_pylist()), np.uint32)
    _, at = np.unique(tokens, return_inverse=True)
    total = np.bincount(at, counts)[at]
    shared = total > 1
    kind = np.log2(np.maximum(total, 1)).astype(np.uint8)
    owner = np.repeat(np.arange(len(sizes)), sizes)[shared]
    rows, cuts = np.unique(owner, return_index=True)
    return pa.table([table["block"].combine_chunks().take(pa.array(rows)), table["bucket"].combine_chunks().take(pa.array(rows)), _packed(tokens[shared], cuts), _packed(kind[shared], cuts)], ["block", "bucket", "tokens", "kinds"])


SETS = "node long, n long, alone long, prefix binary, kinds binary, bands array<long>, map binary, shared binary"


def described(node: int, s: np.ndarray, kinds: np.ndarray) -> tuple:
    """A row of SETS: all but the sizes are null if the set links with nothing. The listed tokens begin at position ``alone`` in the set's order."""
    alone, n = int((kinds == 0).sum()), len(s)
    if alone >= prefix_length(n):
        return node, n, alone, None, None, None, None, None
    order = np.argsort(kinds, kind="stable")[alone : prefix_length(n)]
    shared = s[kinds > 0]
    mins = [int((shared * _MIX[k]).min().astype(np.int64)) for k in range(BANDS)]
    return node, n, alone, s[order].tobytes(), kinds[order].tobytes(), mins, parity_map(shared, n), shared.tobytes()


def _draw(bits: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        """The sets of a block's nodes, described by the classes that its tokens got."""
        known, kinds, nodes = [_NONE], [np.zeros(0, np.uint8)], {}
        for row in side.to_batches():
            for bucket, tokens, kind, rep, sig, node in zip(*(row.column(c).to_pylist() for c in ("bucket", "tokens", "kinds", "rep", "digest", "node"))):
                if tokens is None:
                    nodes[rep, sig] = node
                else:
                    known.append(np.frombuffer(tokens, np.uint32).astype(np.uint64) | np.uint64(bucket << 32))
                    kinds.append(np.frombuffer(kind, np.uint8))
        known, kinds = np.concatenate(known), np.concatenate(kinds)
        order = np.argsort(known)
        known, kinds, out = np.r_[known[order], ~np.uint64(0)], np.r_[kinds[order], np.uint8(0)], []
        for node, s in _nodes(docs, nodes):
            keys = s >> np.uint64(32 - bits)
            at = np.searchsorted(known, keys)
            out.append(described(node, s, np.where(known[at] == keys, kinds[at], 0).astype(np.uint8)))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 8, types)], ["node", "n", "alone", "prefix", "kinds", "bands", "map", "shared"])

    return run


def described_sets(docs: DataFrame, nodes: DataFrame, n: int, total: int) -> DataFrame:
    """SETS of all nodes (rep, block, digest, node); documents and nodes have the same n blocks."""
    bits = (min(MOST_BUCKETS, max(BUCKETS, total // BUCKET_BYTES)) - 1).bit_length()
    by_block = lambda df: C.dealt(df, n).groupBy("block")
    offers = by_block(docs).cogroup(by_block(nodes)).applyInArrow(_offer(bits), "block int, bucket int, tokens binary, n binary, more binary")
    shared = C.materialize(offers.groupBy("bucket").applyInArrow(_classes, "block int, bucket int, tokens binary, kinds binary"), "jaccard-shared")
    side = shared.unionByName(nodes, allowMissingColumns=True)
    out = C.materialize(by_block(docs).cogroup(by_block(side)).applyInArrow(_draw(bits), SETS), "jaccard-sets")
    C.discard(shared)
    return out


# ---- exact comparison --------------------------------------------------------------------------------


def common(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def _compare(apart: bool):
    def run(table: pa.Table) -> pa.Table:
        """Overlaps of a block's pairs. An anchored b is derived from its hub's answer; with ``apart``, a pair that links gets what sets a apart from b."""
        sets, deltas, pairs, answers, out = {}, {}, [], {}, []
        as_set = lambda x: np.frombuffer(x, np.uint64)
        for batch in table.to_batches():
            for a, b, bound, shared, rem, add in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "bound", "shared", "rem", "add"))):
                if shared is not None:
                    sets[a] = as_set(shared)
                elif rem is not None:
                    deltas[a] = b, as_set(rem), as_set(add)
                else:
                    pairs.append((a, b, bound))
        for a, b, bound in pairs:
            x = sets[a]
            if b in deltas:
                hub, rem, add = deltas[b]
                if (a, hub) not in answers:
                    answers[a, hub] = common(x, sets[hub])
                o = answers[a, hub] - common(x, rem) + common(x, add)
            else:
                o = common(x, sets[b])
            linked = 7 * o >= bound
            out.append((a, b, o, linked, *((np.setdiff1d(sets[b], x, True).tobytes(), np.setdiff1d(x, sets[b], True).tobytes()) if apart and linked else (None, None))))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, types)], ["a", "b", "o", "linked", "rem", "add"])

    return run


def compared(sets: DataFrame, pairs: DataFrame, blocks: int, keys: tuple[str, ...], anchors: DataFrame | None, name: str) -> DataFrame:
    """a, b, o, linked (and rem, add where no anchors are given) of pairs (a, b, bound), dealt to blocks by keys. A block asks once for each set and delta that it needs, so a hub costs a row a block."""
    dealt = C.materialize(pairs.select(C.block_of(blocks, *keys).alias("block"), "a", "b", "bound"), f"{name}-dealt")
    wants = dealt.select("block", "a").union(dealt.select("block", "b")).distinct()
    rows = dealt
    if anchors is not None:
        b = dealt.select("block", F.col("b").alias("a")).distinct().join(anchors, "a")
        rows = rows.unionByName(b.select("block", "a", F.col("hub").alias("b"), "rem", "add"), allowMissingColumns=True)
        plain = dealt.select("block", F.col("b").alias("a")).join(anchors.select("a"), "a", "left_anti").select("block", "a")
        wants = dealt.select("block", "a").union(plain).union(b.select("block", "hub")).distinct()
    else:
        rows = rows.select("*", F.lit(None).cast("binary").alias("rem"), F.lit(None).cast("binary").alias("add"))
    rows = rows.unionByName(wants.join(sets.select(F.col("node").alias("a"), "shared"), "a"), allowMissingColumns=True)
    out = C.materialize(C.dealt(rows, blocks).groupBy("block").applyInArrow(_compare(anchors is None), "a long, b long, o long, linked boolean, rem binary, add binary"), name)
    C.discard(dealt)
    return out


# ---- components ----------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest id of its component) for every id that has an edge (a, b)."""
    both = C.materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("c")).select("node", F.least("node", "c").alias("comp"))
    labels, before = C.materialize(labels, "cc-labels"), None
    while True:
        total = labels.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if total == before:
            C.discard(both)
            return labels
        before = total
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("comp", "m").alias("to"))
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        old, labels = labels, C.materialize(step.join(jump, "to").select("node", F.col("further").alias("comp")), "cc-labels")
        C.discard(old)


# ---- the index -----------------------------------------------------------------------------------------

_ENTRY = "part int, node long, comp long, n long, alone long, hub long, far long, map binary, keys binary, at binary"


def _entries(parts: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A set's listed tokens by part, with their positions. Tokens of very many sets go to the cells of the set's share of the list."""
        names = ("node", "comp", "n", "alone", "hub", "far", "map", "prefix", "kinds")
        for batch in C.slices(batches, 1 << 20, "prefix"):
            out = []
            for *head, prefix, kinds in zip(*(batch.column(c).to_pylist() for c in names)):
                keys, hot = np.frombuffer(prefix, np.uint64), np.frombuffer(kinds, np.uint8)
                at = (np.arange(len(keys)) + head[3]).astype(np.int32)
                keys, at = [keys[hot <= HOT]], [at[hot <= HOT]]
                for k, t, p in zip(hot[hot > HOT].tolist(), np.frombuffer(prefix, np.uint64)[hot > HOT], np.flatnonzero(hot > HOT)):
                    shares = 1 << (k - HOT)
                    own = int(_scatter(np.array([head[0]], np.int64).view(np.uint64))[0]) % shares
                    cells = np.array([min(own, j) * shares + max(own, j) for j in range(shares)], np.uint64)
                    keys.append(_scatter(t + (cells + np.uint64(1)) * _MIX[1]))
                    at.append(np.full(shares, p + head[3], np.int32))
                keys, at = np.concatenate(keys), np.concatenate(at)
                part = (keys % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                keys, at, part = keys[order], at[order], part[order]
                cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
                out += [(int(part[i]), *head, keys[i:j].tobytes(), at[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:])]
            kinds = (pa.int32(), *[pa.int64()] * 6, *[pa.binary()] * 3)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [f.split()[0] for f in _ENTRY.split(", ")])

    return run


class Lists:
    """The lists of a part."""

    def __init__(self, table: pa.Table) -> None:
        ints = {c: np.array(table[c].to_pylist(), np.int64) for c in ("node", "comp", "n", "alone", "hub", "far")}
        self.node, self.comp, self.n, self.alone, self.hub, self.far = ints.values()
        maps = table["map"].to_pylist()
        self.wide = np.array([MAP_BITS.index(8 * len(m)) for m in maps], np.int64)
        self.maps = []  # for each width, the maps folded to it and where each set's is
        for w, bits in enumerate(MAP_BITS):
            own = np.flatnonzero(self.wide >= w)
            folded = [np.bitwise_xor.reduce(np.frombuffer(maps[i], np.uint64).reshape(-1, bits // 64), axis=0) for i in own]
            place = np.zeros(len(maps), np.int64)
            place[own] = np.arange(len(own))
            self.maps.append((np.array(folded, np.uint64).reshape(-1, bits // 64), place))
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64)
        owner = np.repeat(np.arange(len(maps)), [len(k) // 8 for k in table["keys"].to_pylist()])
        at = np.frombuffer(b"".join(table["at"].to_pylist()), np.int32).astype(np.int64)
        order = np.lexsort((at, self.n[owner], keys))
        keys, self.owner, self.at = keys[order], owner[order], at[order]
        self.cuts = np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64), len(keys)]

    def bounds(self, start: int, end: int) -> tuple[np.ndarray, ...]:
        """For each block of a list: least and most size, most tokens before and after the position, fewest tokens of a set's own."""
        cuts, o, at = np.arange(0, end - start, BLOCK), self.owner[start:end], self.at[start:end]
        return (np.minimum.reduceat(self.n[o], cuts), np.maximum.reduceat(self.n[o], cuts), np.maximum.reduceat(at - self.alone[o], cuts),
                np.maximum.reduceat(self.n[o] - at - 1, cuts), np.minimum.reduceat(self.alone[o], cuts))

    def block_pairs(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of blocks of a list that a qualifying pair may be in."""
        low, high, before, after, alone = self.bounds(start, end)
        i, j = np.triu_indices(len(low))
        most = np.minimum(before[i], before[j]) + 1 + np.minimum(after[i], after[j])
        may = (4 * high[i] >= 3 * low[j]) & (4 * high[j] >= 3 * low[i]) & (7 * most >= 3 * (low[i] + low[j])) & (7 * (alone[i] + alone[j]) <= high[i] + high[j])
        return i[may], j[may]

    def places(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places in lists of two components or more: short lists of one size together, long ones block by block."""
        sizes = np.diff(self.cuts)
        comp = self.comp[self.owner]
        mixed = np.array([len(np.unique(comp[a:b])) > 1 for a, b in zip(self.cuts[:-1], self.cuts[1:])], bool) if len(sizes) else np.zeros(0, bool)
        starts, sizes = self.cuts[:-1][mixed], sizes[mixed]
        for size in np.unique(sizes[sizes <= BLOCK]):
            i, j = np.triu_indices(int(size), 1)
            few = max(1, TOGETHER // len(i))
            own = starts[sizes == size]
            for k in range(0, len(own), few):
                yield (own[k : k + few, None] + i).ravel(), (own[k : k + few, None] + j).ravel()
        square = np.arange(BLOCK)
        for start, size in zip(starts[sizes > BLOCK], sizes[sizes > BLOCK]):
            p, q = self.block_pairs(start, start + size)
            few = TOGETHER // BLOCK**2
            for k in range(0, len(p), few):
                x = (p[k : k + few, None, None] * BLOCK + square[:, None] + 0 * square).ravel()
                y = (q[k : k + few, None, None] * BLOCK + square + 0 * square[:, None]).ravel()
                inside = (x < y) & (y < size)
                yield start + x[inside], start + y[inside]

    def survivors(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of places: the sets that may link, of different components, and how near at best (least d, less is nearer)."""
        px, py, x, y = self.at[x], self.at[y], self.owner[x], self.owner[y]
        keep = (self.comp[x] != self.comp[y]) & (4 * self.n[x] >= 3 * self.n[y]) & (4 * self.n[y] >= 3 * self.n[x])
        px, py, x, y = px[keep], py[keep], x[keep], y[keep]
        both, alone = self.n[x] + self.n[y], self.alone[x] + self.alone[y]
        most = np.minimum(px - self.alone[x], py - self.alone[y]) + 1 + np.minimum(self.n[x] - px, self.n[y] - py) - 1
        derived = np.where(self.hub[x] == self.hub[y], np.abs(self.far[x] - self.far[y]), 0)
        keep = (7 * most >= 3 * both) & (7 * np.maximum(alone, derived) <= both)
        x, y, both, alone = x[keep], y[keep], both[keep], alone[keep]
        wide, least = np.minimum(self.wide[x], self.wide[y]), alone.copy()
        for w, (maps, place) in enumerate(self.maps):
            own = np.flatnonzero(wide == w)
            for k in range(0, len(own), TOGETHER // 8):
                some = own[k : k + TOGETHER // 8]
                least[some] += np.bitwise_count(maps[place[x[some]]] ^ maps[place[y[some]]]).sum(axis=1, dtype=np.int64)
        keep = 7 * least <= both
        return x[keep], y[keep], least[keep]


def _candidates(best: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """a, b, bound: pairs of a part that may link; with ``best`` the nearest of every two components. No more than HELD are kept: pairs
        beyond go out at once, and may come again."""
        lists = Lists(pa.Table.from_batches(list(batches)))
        held, size = [np.zeros((3, 0), np.int64)], 0

        def distinct() -> np.ndarray:
            x, y, least = np.concatenate(held, axis=1)
            c, d = (lists.comp[x], lists.comp[y]) if best else (x, y)
            low, high = np.minimum(c, d), np.maximum(c, d)
            order = np.lexsort((lists.node[x] + lists.node[y], least, high, low))
            first = np.r_[True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])][: len(order)]
            return np.stack([x, y, least])[:, order[first]]

        def given(pairs: np.ndarray) -> pa.RecordBatch:
            a, b = lists.node[pairs[0]], lists.node[pairs[1]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(3 * (lists.n[pairs[0]] + lists.n[pairs[1]]))], ["a", "b", "bound"])

        for places in lists.places():
            found = lists.survivors(*places)
            if len(found[0]):
                held.append(np.stack(found))
                size += len(found[0])
            if size > HELD:
                held = [distinct()]
                if held[0].shape[1] > HELD // 2:
                    yield given(held[0])
                    held = [np.zeros((3, 0), np.int64)]
                size = held[0].shape[1]
        yield given(distinct())

    return run


def candidates(listed: DataFrame, labels: DataFrame, best: bool, total: int) -> DataFrame:
    """Pairs of sets in different components that the index leaves open. labels: node, comp."""
    parts = max(PARTS, 2 * total // PART_BYTES)
    rows = listed.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    entries = rows.select("node", "comp", "n", "alone", "hub", "far", "map", "prefix", "kinds").mapInArrow(_entries(parts), _ENTRY)
    found = entries.groupBy("part").applyInArrow(_candidates(best), "a long, b long, bound long")
    return C.materialize(found.distinct(), "jaccard-candidates")


# ---- the join ------------------------------------------------------------------------------------------


class Prepared(NamedTuple):
    """Steps 1 to 3: what the index is built on. words: doc_id, digest; nodes: digest, rep, block, node; stars: compared pairs of sets and hubs."""

    words: DataFrame
    nodes: DataFrame
    sets: DataFrame
    may: DataFrame
    listed: DataFrame
    stars: DataFrame
    anchors: DataFrame
    listed_bytes: int
    blocks: int

    def left(self, labels: DataFrame, best: bool, done: DataFrame) -> DataFrame:
        """Answers on pairs between components that the index leaves open and that are not done."""
        pairs = candidates(self.listed, labels, best, self.listed_bytes).join(done, ["a", "b"], "left_anti")
        return compared(self.may, pairs, self.blocks, ("a", "b"), self.anchors, "jaccard-compared")

    def tried(self) -> DataFrame:
        """The pairs of stars, smaller node first."""
        return self.stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def prepared(docs: DataFrame) -> Prepared:
    total = C.text_bytes(docs)
    n = C.block_count(total)
    keyed = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "text").withColumn("block", C.block_of(n, "doc_id", "text"))
    words = C.materialize(keyed.mapInArrow(_digests, "doc_id long, block int, digest binary"), "jaccard-words")
    first = words.where("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "block")).alias("first"))
    nodes = C.materialize(first.select("digest", F.col("first.doc_id").alias("rep"), F.col("first.block").alias("block"), F.monotonically_increasing_id().alias("node")), "jaccard-nodes")
    sets = described_sets(keyed, nodes, n, total)
    may = sets.where("prefix is not null")
    listed_bytes, shared_bytes = may.agg(F.coalesce(F.sum(F.octet_length("prefix") + F.octet_length("map")), F.lit(0)), F.coalesce(F.sum(F.octet_length("shared")), F.lit(0))).first()
    blocks = C.block_count(shared_bytes, COMPARE_BYTES)

    # stars around the set with the fewest tokens of its own among those that share a minimum hash
    bands = may.select("node", "n", "alone", F.posexplode("bands").alias("band", "value"))
    hubs = bands.groupBy("band", "value").agg(F.min(F.struct((F.col("alone") / F.col("n")).alias("own"), "node", "n", "alone")).alias("hub"), F.count("*").alias("k")).where("k > 1").select("band", "value", "hub")
    tried = bands.join(hubs, ["band", "value"]).where("node <> hub.node and 4 * least(n, hub.n) >= 3 * greatest(n, hub.n) and 7 * (alone + hub.alone) <= n + hub.n")
    tried = tried.select(F.col("node").alias("a"), F.col("hub.node").alias("b"), (3 * (F.col("n") + F.col("hub.n"))).alias("bound")).distinct()
    stars = compared(may, tried, blocks, ("a",), None, "jaccard-stars")
    anchors = stars.where("linked").groupBy("a").agg(F.max_by(F.struct(F.col("b").alias("hub"), "rem", "add"), F.struct("o", "b")).alias("best")).select("a", "best.*")
    anchors = C.materialize(anchors, "jaccard-anchors")
    sizes = may.select("node", "n")
    nearest = stars.select("a", "b", "o").join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").select("a", "b", (F.col("na") + F.col("nb") - 2 * F.col("o")).alias("far"))
    is_hub = nearest.select(F.col("b").alias("a"), "b", F.lit(0).cast("long").alias("far"))
    nearest = nearest.union(is_hub).groupBy(F.col("a").alias("node")).agg(F.min(F.struct("far", F.col("b").alias("hub"))).alias("near")).select("node", "near.hub", "near.far")
    listed = may.drop("bands", "shared").join(nearest, "node", "left").withColumns({"hub": F.coalesce("hub", "node"), "far": F.coalesce("far", F.lit(0).cast("long"))})
    listed = C.materialize(listed, "jaccard-listed")
    return Prepared(words, nodes, sets, may, listed, stars, anchors, int(listed_bytes), blocks)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    p = prepared(docs)
    # the index: first what merges components, then all that is left between them
    links, done = p.stars.where("linked").select("a", "b"), p.tried()
    labels = components(links)
    for best in (True, False):
        found = p.left(labels, best, done)
        links, done = links.union(found.where("linked").select("a", "b")), done.union(found.select("a", "b"))
        labels = components(links)
    comp = p.nodes.join(labels, "node", "left").select("node", "digest", "rep", F.coalesce("comp", "node").alias("comp"))
    least = comp.groupBy("comp").agg(F.min("rep").alias("least"))
    by_digest = comp.join(p.sets.select("node", "n"), "node").join(least, "comp").select("digest", "n", "least")
    answers = p.words.select("doc_id", "digest").join(by_digest, "digest", "left")
    given = lambda c: F.when(c != _NO_ID, c)
    return answers.select(given(F.col("doc_id")).alias("doc_id"), F.coalesce("n", F.lit(0).cast("long")).alias("n_shingles"), given(F.coalesce("least", "doc_id")).alias("component_id"))


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links. A class is the documents with the same words in the same order.

    First the documents: doc_id, class (hexadecimal; null without words), n_shingles, n_links (how many other rows each is linked with, its
    copies included). Second the links between classes: class_a < class_b, n_common and n_union shingles. Copies are never paired; the links
    between different texts are all there, so their number is what it is: quadratic in a family of near copies.
    """
    p = prepared(docs)
    each = docs.sparkSession.createDataFrame([], "node long, comp long")  # every set is its own component
    stars = p.stars.where("linked").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "o").distinct()
    found = p.left(each, False, p.tried().distinct()).where("linked").select("a", "b", "o")
    about = p.nodes.select("node", F.lower(F.hex("digest")).alias("class")).join(p.sets.select("node", "n"), "node")
    side = lambda x: about.toDF(x, f"class_{x}", f"n_{x}")
    pairs = stars.union(found).join(side("a"), "a").join(side("b"), "b")
    low = F.col("class_a") < F.col("class_b")
    links = pairs.select(F.when(low, F.col("class_a")).otherwise(F.col("class_b")).alias("class_a"), F.when(low, F.col("class_b")).otherwise(F.col("class_a")).alias("class_b"), F.col("o").alias("n_common"), (F.col("n_a") + F.col("n_b") - F.col("o")).alias("n_union"))
    links = C.materialize(links, "jaccard-links")
    words = p.words.select("doc_id", F.lower(F.hex("digest")).alias("class"))
    sizes = words.where("class is not null").groupBy("class").agg(F.count("*").alias("size"))
    ends = links.select(F.col("class_a").alias("of"), F.col("class_b").alias("class")).union(links.select("class_b", "class_a"))
    others = ends.join(sizes, "class").groupBy(F.col("of").alias("class")).agg(F.sum("size").alias("others"))
    by_class = sizes.join(others, "class", "left").join(about.select("class", "n"), "class").select("class", "n", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    none = F.lit(0).cast("long")
    rows = words.join(by_class, "class", "left").select(F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), "class", F.coalesce("n", none).alias("n_shingles"), F.coalesce("n_links", none).alias("n_links"))
    return rows, links


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents whose id is the smallest of their component, columns as they were; rows that repeat that id all stay."""
    key = C.free_name(docs, "kept")
    found = jaccard_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found[key]), "left_semi")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
