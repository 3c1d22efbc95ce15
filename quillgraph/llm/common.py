"""Shared parts of the operators: shared folder, document blocks, ASCII folding, Arrow helpers.

Texts are handled as UTF-8 bytes on the Python side: ``bytes.lower`` folds A-Z alone and
``bytes.split`` splits at exactly ``[\\x20\\x09-\\x0D]``, which is what the operators ask for.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a block of documents that one task holds at a time.
BLOCK_BYTES = 16 << 20
#: Blocks at least, so that small inputs still use every executor.
MIN_BLOCKS = 32

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else a temporary one, if all run in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/quillgraph/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a work path through the file system that Spark uses for it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the session may have ended before; the folder then stays
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors. Shuffle files that led to it go at once."""
    spark = df.sparkSession
    path, key = work_path(spark, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a written table that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/quillgraph/" in folder:
            remove(df.sparkSession, folder)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def schema_of(df: DataFrame) -> str:
    """The columns as DDL."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column, from one narrow scan."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def block_count(total_bytes: int, block_bytes: int = BLOCK_BYTES, least: int = MIN_BLOCKS) -> int:
    return max(least, -(-total_bytes // block_bytes))


def block_of(n: int, *columns: str) -> Column:
    """A block number that depends on the row alone, so a task that runs again puts it in the same place."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(n)).cast("int")


def dealt(df: DataFrame, n: int, column: str = "block") -> DataFrame:
    """Each of n numbers its own partition: no hash puts several into one. Two tables dealt alike meet without another exchange."""
    return df.repartitionById(n, F.col(column))


def held_in(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def texts_of(array: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else pa.binary()
    return [x or b"" for x in array.cast(kind).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice has about ``most`` bytes of text, or one row."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def gathered(batches: Iterable[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.Table]:
    """Join batches until about ``most`` bytes of text are held; a text is never cut."""
    held, size = [], 0
    for batch in slices(batches, most, column):
        n = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and size + n > most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield pa.Table.from_batches(held)
