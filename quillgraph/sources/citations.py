"""Citation sources: citation dumps, body-text spans, TEI, qrels, and rankings made elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import identifiers as I


def citation_edges(rows: DataFrame, citing: str = "citing", cited: str = "cited") -> tuple[DataFrame, DataFrame]:
    """Distinct DOI to DOI edges of a citation dump with how often each occurs, and counts of rows that lack an end."""
    ends = rows.select(I.doi(F.col(citing)).alias("src"), I.doi(F.col(cited)).alias("dst"))
    valid = F.col("src").startswith("10.") & F.col("dst").startswith("10.")
    edges = ends.where(valid).groupBy("src", "dst").agg(F.count("*").alias("n"))
    missing = ends.where(~valid).groupBy((~F.col("src").startswith("10.")).alias("no_citing"), (~F.col("dst").startswith("10.")).alias("no_cited")).agg(F.count("*").alias("n"))
    return edges, missing


def read_citation_dump(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header; JSON lines by the file's ending."""
    return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.csv(path, header=True, sep=sep)


def body_text_contexts(papers: DataFrame, window: int = 240) -> DataFrame:
    """paper_id, ref_id, context, title: cite spans of body_text with the text around them, and the entry that they name.

    papers(paper_id, body_text: array<struct<text, cite_spans: array<struct<start, end, ref_id>>>>, bib_entries: map<string, struct<title>>).
    """
    spans = papers.select("paper_id", "bib_entries", F.explode("body_text").alias("b")).select("paper_id", "bib_entries", F.col("b.text").alias("text"), F.explode("b.cite_spans").alias("c"))
    context = F.expr(f"substring(text, greatest(c.start - {window}, 0) + 1, c.end + {window} - greatest(c.start - {window}, 0))")
    return spans.select("paper_id", F.col("c.ref_id").alias("ref_id"), context.alias("context"), F.try_element_at("bib_entries", F.col("c.ref_id"))["title"].alias("title"))


def read_tei_references(spark: SparkSession, path: str) -> DataFrame:
    """Bibliography entries of TEI files, by Spark's XML source."""
    return spark.read.format("xml").option("rowTag", "biblStruct").load(path)


def parsed_qrels(lines: DataFrame) -> DataFrame:
    """query_id, corpus_id, score of lines(value): three columns, or four of which the second is 0; tabs separate where there are any. Headers and judgements of zero or less go."""
    line = F.trim(F.coalesce("value", F.lit("")))
    parts = F.filter(F.transform(F.when(line.contains("\t"), F.split(line, r"\t+")).otherwise(F.split(line, r"\s+")), lambda x: F.trim(x)), lambda x: x != "")
    rows = lines.select(parts.alias("p")).where(F.size("p") >= 3)
    second = F.get("p", F.lit(1))
    four = (F.size("p") >= 4) & (second == "0")
    out = rows.select(F.get("p", F.lit(0)).alias("query_id"), F.when(four, F.get("p", F.lit(2))).otherwise(second).alias("corpus_id"), F.when(four, F.get("p", F.lit(3))).otherwise(F.get("p", F.lit(2))).try_cast("int").alias("score"))
    return out.where("score > 0")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, corpus_id, score of relevance files."""
    return parsed_qrels(spark.read.text(path))


def read_benchmark(spark: SparkSession, root: str, qrels: str = "qrels/test.tsv") -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus(id, title, text), queries(id, text) and judgements of a folder with corpus.jsonl, queries.jsonl and a relevance file; judgements of unknown queries go."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{root}/corpus.jsonl").withColumnRenamed("_id", "id")
    queries = spark.read.schema("_id string, text string").json(f"{root}/queries.jsonl").withColumnRenamed("_id", "id").where("id is not null and trim(text) <> ''")
    return corpus, queries, read_qrels(spark, f"{root}/{qrels}").join(queries.select(F.col("id").alias("query_id")), "query_id", "left_semi")


def resolve_rankings(rankings: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rankings made elsewhere with document keys resolved by alias, and those that name no document. rankings(query, key, score), aliases(key, doc)."""
    resolved = rankings.join(aliases, "key").select("query", "doc", "score")
    return resolved, rankings.join(aliases, "key", "left_anti")
