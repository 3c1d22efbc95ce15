"""The corpus pipeline: each stage applies an operator of quillgraph.llm to what its predecessor kept.

Quality classifier, line dedup, near-duplicate removal and benchmark decontamination return the columns of
documents; best-fit packing returns the pieces and their places. A stage's result is written as Parquet to the shared
folder and read again as the next one's documents, so a lost executor costs the tasks of one stage.

A null text counts as empty in every stage. Rows that are there more than once are rows of their own. Further columns stay as they are, whatever their
names, up to the packing. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import common, op3_quality, op6_jaccard_join, op8_line_dedup, op9_decontaminate, op10_packing


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (3) rejects go; empty texts go or stay by their score, a null doc_id is scored like others."""
    return op3_quality.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines (8) go but for those of the smallest doc_id (a null one comes first); a document that loses all keeps an empty text. n_chars follows the text."""
    out = op8_line_dedup.line_dedup(docs).select(docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (6) the document with the smallest id stays; texts without words are in no group. All rows of that id in the group stay."""
    return op6_jaccard_join.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark (9) go, and no others; items and texts without words match nothing."""
    return op9_decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest is packed into sequences (10): an empty text is one piece of one token, longer ones than 4096 tokens are cut."""
    return op10_packing.best_fit_packing(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("best_fit_packing", packing_stage),
]
#: SQL expresses neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
