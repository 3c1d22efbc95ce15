"""SentencePiece encoding through a table of distinct chunks, and decoding by surfaces.

White space becomes the marker U+2581, and a marker stands before the text. Where the vocabulary has no piece with a marker
behind another character, no merge crosses from a word to the marker of the next one; characters that are in no piece
(controls, line ends) are never merged at all. Texts are cut at those places, so a text's ids are its chunks' ids
one behind the other. A task lays the texts of a slice end to end, cuts them with array operations, numbers
the distinct chunks (``dictionary_encode``), has the library segment each of them that is not yet in the task's table once, and
joins ids back by position: counts and starts of the chunks' ids are gathered by chunk number, in order of place. No row
is shuffled, so no word is a hot key, and a lost executor costs the tasks it ran. The table of a task starts anew when it
holds ``TABLE`` chunks: memory is bounded, and ids are the same.

The cuts are made only where the model file says that they are safe (byte-pair merges, identity normaliser, no symbols
of its own); texts of another model go to the library whole.

Decoding lays the surfaces of all ids of a slice end to end and strips the marker in front. Id lists that begin with a
byte or the unknown piece, hold a control within, or whose bytes are no UTF-8, go to the library.

Cases: a null or empty text has the end id alone; blank texts, repeated rows, repeated or null ids are encoded as they are;
a long text is a slice of its own, and so is a long word a chunk; U+2581 in a text is a marker, as in the library, and comes
back as a space; an empty table gives no rows; other columns are ignored. Null ids decode to an empty text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Bytes of text in a slice, and distinct chunks that a task's table holds before it starts anew.
SLICE_BYTES, TABLE = 8 << 20, 1_000_000
MARK = "▁"


def model_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model file: whether and where texts may be cut, the table of chunks, the surfaces of ids."""

    def __init__(self, path: str, most: int = TABLE) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto.FromString(self.whole.serialized_model_proto())
        kinds = pb.ModelProto.SentencePiece
        normal = [p.piece for p in proto.pieces if p.type == kinds.NORMAL]
        rules, trainer = proto.normalizer_spec, proto.trainer_spec
        self.cuts = (
            trainer.model_type == pb.TrainerSpec.BPE and trainer.byte_fallback and not trainer.treat_whitespace_as_suffix
            and not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
            and not any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces) and not any(MARK in p.lstrip(MARK) for p in normal)
        )
        held = {c for p in normal for c in p}
        self.lone = np.array([i < 128 and chr(i) not in held and i != 32 for i in range(256)])
        self.end = self.whole.eos_id()
        self.most, self.table, self.segmented = most, {}, 0
        if self.cuts:
            rules.add_dummy_prefix = False  # chunks bring their own marker
            self.parts = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        surface = {kinds.CONTROL: lambda p: b"", kinds.UNKNOWN: lambda p: trainer.unk_surface.encode(), kinds.BYTE: lambda p: bytes([int(p[1:-1], 16)])}
        self.surfaces = pa.array([surface.get(p.type, lambda p: p.replace(MARK, " ").encode())(p.piece) for p in proto.pieces], pa.large_binary())
        self.control = np.array([p.type == kinds.CONTROL for p in proto.pieces])
        self.plain = np.array([p.type not in (kinds.BYTE, kinds.UNKNOWN) for p in proto.pieces])

    def chunks(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """All chunks in order, and the number of the first one of each text (and of the end)."""
        marked = [b" " + t.replace(MARK.encode(), b" ") if t else b"" for t in texts]
        data = b"".join(marked)
        at = np.frombuffer(data, np.uint8)
        first = np.concatenate([[0], np.cumsum([len(t) for t in marked], dtype=np.int64)])
        begins = self.lone[at]
        begins[1:] |= self.lone[at[:-1]] | ((at[1:] == 32) & (at[:-1] != 32))
        begins[first[first < len(at)]] = True
        places = np.append(np.flatnonzero(begins), len(at))
        array = pa.Array.from_buffers(pa.large_string(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data)])
        return array, np.searchsorted(places, first)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and the offsets of the texts in them."""
        if not self.cuts:
            lists = self.whole.encode([t.decode() for t in texts], num_threads=1, add_eos=True)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
            return np.fromiter(chain.from_iterable(lists), np.int32, offsets[-1]), offsets
        array, first = self.chunks(texts)
        coded = array.dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.table) + len(distinct) > self.most:
            self.table = {}
        new = [c for c in distinct if c not in self.table]
        self.segmented += len(new)
        self.table.update(zip(new, self.parts.encode(new, num_threads=1) if new else ()))
        lists = [self.table[c] for c in distinct]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.int32, sizes.sum())
        n = sizes[codes]
        place = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[codes] - place[:-1], n) + np.arange(place[-1])]
        offsets = place[first] + np.arange(len(first))
        out = np.full(len(ids) + len(texts), self.end, np.int32)
        own = np.ones(len(out), bool)
        own[offsets[1:] - 1] = False
        out[own] = ids
        return out, offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The text of each list of ids, as the library's decode gives it."""
        laid = self.surfaces.take(pa.array(ids))
        at = np.frombuffer(laid.buffers()[1], np.int64)[laid.offset : laid.offset + len(laid) + 1] if len(laid) else np.zeros(1, np.int64)
        data = laid.buffers()[2].to_pybytes() if len(laid) else b""
        shown = np.append(np.flatnonzero(~self.control[ids]), len(ids))
        heads = shown[np.searchsorted(shown, offsets[:-1])]  # the first id of each list that is no control
        inner = np.flatnonzero(self.control[ids[:-1]] & ~self.control[ids[1:]])  # a control inside a list may part the bytes of a character
        inner = inner[~np.isin(inner + 1, offsets)]
        parted = np.bincount(np.searchsorted(offsets, inner, "right") - 1, minlength=len(offsets) - 1)
        out = []
        for a, b, head, apart in zip(offsets[:-1].tolist(), offsets[1:].tolist(), heads.tolist(), parted.tolist()):
            text = data[at[a] : at[b]]
            if head < b and (apart or not (self.plain[ids[head]] and _valid(text))):
                text = self.whole.decode(ids[a:b].tolist()).encode()
            elif text[:1] == b" ":
                text = text[1:]
            out.append(text)
        return out


def _valid(text: bytes) -> bool:
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


def encode(docs: DataFrame, path: str | None = None, slice_bytes: int = SLICE_BYTES, table: int = TABLE) -> DataFrame:
    """Per document: doc_id and ids, the last of which is the end id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model_path(path), table)
        for held in C.gathered(batches, slice_bytes):
            ids, offsets = pieces.encode(C.texts_of(held["text"]))
            yield pa.RecordBatch.from_arrays([held["doc_id"].combine_chunks(), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, into: str = "decoded") -> DataFrame:
    """The rows with a column of text for their ``ids``; ``into`` must be a free name."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model_path(path))
        for batch in batches:
            lists = batch.column("ids")
            offsets = np.concatenate([[0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
            texts = pieces.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*batch.schema.names, into])

    return encoded.mapInArrow(run, f"{C.schema_of(encoded)}, `{into}` string")


def ids_digest(ids: str | Column = "ids") -> Column:
    return F.sha2(F.array_join(F.col(ids).cast("array<string>") if isinstance(ids, str) else ids.cast("array<string>"), " "), 256)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
