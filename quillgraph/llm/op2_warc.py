"""WARC records in seekable Zstandard bundles.

A bundle is a complete ``.warc.zst`` file: records are grouped into frames that decompress on their own, and a skippable frame at
the end holds the seek table (sizes of every frame). Beside it lies the map from record id to
frame and offset within the decompressed frame, so one record costs one frame. Bundles are rows of a Parquet table in the shared folder, since
executors reach that through Spark alone; ``export_bundles`` writes them as files where a folder is mounted.
Of equal payloads (SHA-1 and length) the record with the largest page_id is the response, the others revisit it.

Cases: null html is an empty payload; repeated rows with the largest page_id of their group are all responses, of which one has the identifier
that revisits refer to; identifiers are unique in the archive, also of rows that repeat; a null
page_id is smaller than all others and is a revisit if its group has another id, else a response; very long payloads get a frame of their own; an empty table
gives no bundles; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 4 << 20
#: Parts that the copies of a payload are spread over.
SALTS = 16
#: Payloads of at least so many bytes can be revisits.
LEAST_BYTES = 0
#: Fixed values of the seekable format and the WARC standard.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, row: int | None = None) -> str:
    """Of the record that stands for a payload, or with ``row``, the row's number in the table, of any other."""
    return f"urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}' + ('' if row is None else f'/{row}'))}"


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, rid: str, digest: str) -> bytes:
    """A response, or a revisit whose HTTP header alone is kept; both give digest and length of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(c for c in url or "" if c >= " ") or f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes, offset: int = 0) -> tuple[dict[str, str], bytes, bytes, int]:
    """Headers, HTTP header, body and the place after the record."""
    end = data.index(b"\r\n\r\n", offset)
    first, *lines = data[offset:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record at {offset}")
    head = {k: v for k, _, v in (x.partition(": ") for x in lines)}
    start, n = end + 4, int(head["Content-Length"])
    http, _, body = data[start : start + n].partition(b"\r\n\r\n")
    if data[start + n : start + n + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {offset} is cut off")
    return head, http, body, start + n + 4


class Bundle:
    """Collects records into frames; ``close`` returns the file's bytes and its index."""

    def __init__(self, level: int = 3) -> None:
        import zstandard

        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open_: list[bytes] = []
        self.held = self.total = 0
        self.index: list[tuple[str, int | None, int, int, int]] = []

    def add(self, rid: str, page_id: int | None, record: bytes) -> None:
        if self.held and self.held + len(record) > FRAME_BYTES:
            self._flush()
        self.index.append((rid, page_id, len(self.frames), self.held, len(record)))
        self.open_.append(record)
        self.held += len(record)

    def _flush(self) -> None:
        raw = b"".join(self.open_)
        self.frames.append(self.zstd.compress(raw))
        self.sizes.append((len(self.frames[-1]), len(raw)))
        self.total += len(self.frames[-1])
        self.open_, self.held = [], 0

    def close(self) -> tuple[bytes, list]:
        if self.held:
            self._flush()
        body = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(body)) + body, self.index


class BundleReader:
    """Random access by frame number, from the seek table at the end of the file."""

    def __init__(self, data: bytes) -> None:
        import zstandard

        self.data, self.zstd = data, zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", data[-9:])
        size = 8 + bool(flags & 0x80) * 4
        kind, length = struct.unpack("<II", data[-9 - n * size - 8 : -9 - n * size])
        if magic != SEEKABLE or kind != SKIPPABLE or length != n * size + 9:
            raise ValueError("no seek table")
        self.table, at = [], 0
        for k in range(n):
            packed, raw = struct.unpack_from("<II", data, len(data) - 9 - (n - k) * size)
            self.table.append((at, packed, raw))
            at += packed
        self.last = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            at, packed, raw = self.table[k]
            self.last = (k, self.zstd.decompress(self.data[at : at + packed], max_output_size=max(raw, 1)))
        return self.last[1]

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes, bytes, int]:
        return read_record(self.frame(frame), offset)


_INDEX = pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
BUNDLES = "bundle string, data binary, index array<struct<record_id: string, page_id: bigint, frame: int, offset: bigint, length: bigint>>"


def _write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def closed(bundle: Bundle) -> pa.RecordBatch:
        data, index = bundle.close()
        rows = [dict(zip(("record_id", "page_id", "frame", "offset", "length"), x)) for x in index]
        return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(data).hexdigest()]), pa.array([data], pa.binary()), pa.array([rows], _INDEX)], ["bundle", "data", "index"])

    bundle = Bundle()
    for batch in C.slices(batches, 4 << 20, "html"):
        for page_id, url, refers_to, row, payload in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "row")), C.texts_of(batch.column("html"))):
            digest = base32_sha1(payload)
            rid = record_id(page_id, digest, row)
            bundle.add(rid, page_id, write_record(page_id, url, payload, refers_to, rid, digest))
            if bundle.total > BUNDLE_BYTES:
                yield closed(bundle)
                bundle = Bundle()
    if bundle.index:
        yield closed(bundle)


def _salted(groups: DataFrame) -> DataFrame:
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def write_bundles(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The archive as a table of bundles in the shared folder.

    Roles are folded from narrow rows before any exchange; the rows with their html meet them by payload and salt, so that copies
    of one payload are spread. Only where a page_id repeats with its payload, the rows of that payload are written once more, with numbers that tell them apart.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("n"))
    once = rows.groupBy("sha", "n", "page_id").agg(F.count("*").alias("rows"))
    groups = once.groupBy("sha", "n").agg(F.max("page_id").alias("top"), F.sum("rows").alias("copies"), F.max("rows").alias("most")).where("copies > 1")
    groups = C.materialize(groups.select("sha", "n", F.when(F.col("n") >= least_bytes, F.col("top")).alias("top"), "most"), "warc-roles")
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    roles = rows.withColumn("salt", salt).join(_salted(groups), ["sha", "n", "salt"], "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("top")), F.col("top"))
    named = roles.where("coalesce(most, 1) = 1").select("page_id", "url", "html", refers.alias("refers_to"), F.lit(None).cast("long").alias("row"))
    again = None
    if (groups.agg(F.max("most")).first()[0] or 1) > 1:
        again = roles.where("most > 1").select("page_id", "url", "html", "sha", "n", "top", refers.alias("refers_to"), F.monotonically_increasing_id().alias("row"))
        again = C.materialize(again.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")), "warc-again")
        first = again.where("page_id = top").groupBy("sha", "n").agg(F.min("row").alias("first"))
        told = again.join(_salted(first), ["sha", "n", "salt"], "left")
        named = named.unionByName(told.select("page_id", "url", "html", "refers_to", F.when(~F.coalesce(F.col("row") == F.col("first"), F.lit(False)), F.col("row")).alias("row")))
    out = C.materialize(named.mapInArrow(_write, BUNDLES), "warc")
    for done in [groups] + [again] * (again is not None):
        C.discard(done)
    return out


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, index in zip(batch.column("data").to_pylist(), batch.column("index").to_pylist()):
            reader, rows = BundleReader(data), []
            for x in sorted(index, key=lambda x: (x["frame"], x["offset"])):
                head, http, body, _ = reader.record(x["frame"], x["offset"])
                if head["WARC-Record-ID"] != f"<{x['record_id']}>":
                    raise ValueError(f"the index points to another record: {x}")
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response" and base32_sha1(body) != digest:
                    raise ValueError(f"payload and digest differ: {x}")
                n = int(http.decode().rpartition("Content-Length: ")[2])
                to = head.get("X-Refers-To-Page-ID")
                rows.append((int(p) if (p := head["X-Page-ID"]) else None, n, digest, head["WARC-Type"], int(to) if to else None, body if head["WARC-Type"] == "response" else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read_bundles(bundles: DataFrame) -> DataFrame:
    """One row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""
    return bundles.select("data", "index").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def export_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as ``<folder>/<bundle>.warc.zst`` where all executors have the folder mounted; returns the names."""

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for batch in batches:
            for name, data in zip(batch.column("bundle").to_pylist(), batch.column("data").to_pylist()):
                with open(f"{folder}/.{name}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(data)
                os.replace(f.name, f"{folder}/{name}.warc.zst")
            yield pa.RecordBatch.from_arrays([batch.column("bundle")], ["bundle"])

    return bundles.select("bundle", "data").mapInArrow(put, "bundle string")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_bundles(write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"))).drop("payload")


SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), g AS (SELECT h, payload_bytes, max(page_id) AS top FROM p GROUP BY ALL
), d AS (SELECT h, array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(floor(CAST('0x' || substr(h, 1 + 5 * (k // 4), 5) AS INTEGER) / (32 ** (3 - k % 4))) AS INTEGER) % 32, 1) FOR k IN range(32)], '') AS payload_digest FROM (SELECT DISTINCT h FROM p))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM p JOIN g USING (h, payload_bytes) JOIN d USING (h)
"""
