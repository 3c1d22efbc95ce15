"""File sources and sinks: recursive listing, change detection against a manifest, graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """source_key, fingerprint (rounded time : size) of the files under a root; hidden files are left out. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    if extensions:
        files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lstrip(".").lower() for e in extensions]))
    print_ = F.concat_ws(":", F.round(F.unix_millis("modificationTime")).cast("long"), F.col("length"))
    return files.where(~F.col("path").rlike(r"/\.[^/]+$")).select(F.col("path").alias("source_key"), print_.alias("fingerprint"))


def source_changes(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """source_key and state: added, changed, removed or unchanged. Both have source_key and fingerprint."""
    both = found.select("source_key", F.col("fingerprint").alias("now")).join(manifest.select("source_key", F.col("fingerprint").alias("before")), "source_key", "full_outer")
    state = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now").eqNullSafe(F.col("before")), "unchanged").otherwise("changed")
    return both.select("source_key", state.alias("state"))


def save_graph(nodes: DataFrame, edges: DataFrame, root: str) -> None:
    """Nodes and edges as Parquet, a folder for each type, so that reads of one type touch nothing else."""
    nodes.write.mode("overwrite").partitionBy("type").parquet(f"{root}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{root}/edges")


def load_graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{root}/nodes"), spark.read.parquet(f"{root}/edges")


def lite_view(nodes: DataFrame, most_chars: int = 240) -> DataFrame:
    """Column-pruned nodes with clipped names, for reads that need no text."""
    return nodes.select("id", "type", F.substring("name", 1, most_chars).alias("name"), "layer")


def top_level_entries(docs: DataFrame, column: str) -> DataFrame:
    """key and value (JSON text) of a huge top-level JSON object, one row each."""
    return docs.select(F.explode(F.from_json(column, "map<string, string>")).alias("key", "value"))
