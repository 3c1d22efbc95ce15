"""Queries of the sources: papers in Markdown, citation dumps, body-text spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.plans.registry import query
from quillgraph.runtime import table
from quillgraph.sources import citations, markdown


@query("markdown_chunks")
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and chunks of every document."""
    return markdown.chunk_rows(table(spark, sf_dir, "documents"))


@query("citation_dump", """
WITH r AS (SELECT 'https://doi.org/10.1/' || l_orderkey % 500 AS citing, CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE 'doi:10.1/' || l_partkey % 300 END AS cited FROM lineitem)
SELECT '10.1/' || split_part(citing, '/', 5) AS src, replace(cited, 'doi:', '') AS dst, count(*) AS n FROM r WHERE cited <> '' GROUP BY ALL
""")  # fmt: skip
def citation_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation rows to distinct DOI edges."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(F.concat(F.lit("https://doi.org/10.1/"), F.col("l_orderkey") % 500).alias("citing"), F.when(F.col("l_linenumber") % 5 == 0, "").otherwise(F.concat(F.lit("doi:10.1/"), F.col("l_partkey") % 300)).alias("cited"))
    return citations.citation_edges(rows)[0]


@query("chunk_status", """
SELECT CASE WHEN n_chars > 3000 THEN 'large' WHEN n_chars > 500 THEN 'normal' ELSE 'small' END AS status, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest FROM documents GROUP BY 1
""")
def chunk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status with totals (O19, O132, O133)."""
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").groupBy(F.when(n > 3000, "large").when(n > 500, "normal").otherwise("small").alias("status")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


def _pages_of_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what papers hold beside sentences: axis ticks, a legend, a table with its caption, a figure's caption, fenced numbers."""
    extra = "\\n0.10 0.20 0.30 0.40\\n[Ours] [Base] 1 2 3\\n??]\\nTable 1: Results of runs\\n\\n| name | value |\\n|---|:---:|\\n| a | 1 |\\n| b | 2 |\\n\\nFigure 2. A plot\\n```\\n0.1 0.2 0.3\\n```\\nTable 3 - Without rows"
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("lang") == "en", F.lit(extra.replace("\\n", "\n"))).otherwise("")).alias("text"))


@query("markdown_cleaning", """
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents), n AS (SELECT doc_id, length(t) - length(replace(t, chr(10), '')) + 1 AS n, coalesce(lang = 'en', false) AS en FROM d)
SELECT doc_id, CAST(CASE WHEN en THEN n + 15 ELSE n END AS INTEGER) AS n_lines, CASE WHEN en THEN 3 ELSE 0 END AS n_removed, CASE WHEN en THEN concat_ws(',', n + 1, n + 2, n + 3) ELSE '' END AS lines FROM n
""")  # fmt: skip
def markdown_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of charts that are taken out of Markdown, with a report (O4). The tables' own texts have no such lines."""
    rows = markdown.cleaned_rows(_pages_of_charts(spark, sf_dir))
    return rows.select("doc_id", "n_lines", "n_removed", F.concat_ws(",", F.transform("removed", lambda x: x["line"].cast("string"))).alias("lines"))


@query("markdown_materials", """
SELECT doc_id, kind, place, caption, n_rows, n_columns FROM documents, (VALUES ('table', 1, 'Table 1: Results of runs', 2, 2), ('table', 2, 'Table 1: Results of runs', NULL, NULL), ('table', 3, 'Table 3 - Without rows', NULL, NULL), ('figure', 1, 'Figure 2. A plot', NULL, NULL)) v(kind, place, caption, n_rows, n_columns) WHERE lang = 'en'
""")  # fmt: skip
def markdown_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and captions of Markdown; eight of a kind are the feature (O222)."""
    return markdown.material_rows(_pages_of_charts(spark, sf_dir))


@query("chunk_collection", """
WITH c AS (SELECT l_suppkey AS pack, l_orderkey AS entry, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey) AS chunk, trim(repeat(p_name || ' ', 60)) AS text FROM lineitem JOIN part ON p_partkey = l_partkey),
n AS (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY entry, chunk) AS place FROM c) SELECT pack, CAST(place AS INTEGER) AS place, entry, CAST(chunk AS INTEGER) AS chunk, CASE WHEN length(text) > 900 THEN trim(substr(text, 1, 899)) || '...' ELSE text END AS text FROM n WHERE place <= 8
""")  # fmt: skip
def chunk_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight chunks of each pack's entries, with texts of 900 characters at most (O223)."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    place = F.row_number().over(Window.partitionBy("l_suppkey", "l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return markdown.first_chunks(rows.select(F.col("l_suppkey").alias("pack"), F.col("l_orderkey").alias("entry"), place.alias("chunk"), F.trim(F.repeat(F.concat("p_name", F.lit(" ")), 60)).alias("text")))


_TITLES = """
WITH t AS (SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN '# ' || p_name WHEN 1 THEN 'Abstract' WHEN 2 THEN chr(10) || '"' || p_name || '"' WHEN 3 THEN 'Ab' WHEN 4 THEN 'AB' WHEN 5 THEN '- Figure ' || p_size || ' shows' WHEN 6 THEN repeat(p_name, 40) WHEN 7 THEN '  ' ELSE 'untitled' END AS raw, p_size % 9 AS k, p_name FROM part)
"""


@query("title_validity", _TITLES + """
SELECT p_partkey, CASE WHEN k IN (0, 2) THEN p_name WHEN k = 4 THEN 'AB' ELSE 'file' || p_partkey END AS title, k IN (0, 2, 4) AS valid, CASE k WHEN 1 THEN 'section-heading' WHEN 3 THEN 'too-short' WHEN 5 THEN 'caption-like' WHEN 6 THEN 'too-long' WHEN 7 THEN 'empty' WHEN 8 THEN 'placeholder-title' END AS reason FROM t
""")  # fmt: skip
def title_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may stand as a paper's title, else the file's name and the reason."""
    k, name = F.col("p_size") % 9, F.col("p_name")
    raw = F.when(k == 0, F.concat(F.lit("# "), name)).when(k == 1, "Abstract").when(k == 2, F.concat(F.lit('\n"'), name, F.lit('"'))).when(k == 3, "Ab").when(k == 4, "AB").when(k == 5, F.concat(F.lit("- Figure "), "p_size", F.lit(" shows"))).when(k == 6, F.repeat(name, 40)).when(k == 7, "  ").otherwise("untitled")
    found = markdown.title_check(raw, F.concat(F.lit("papers/file"), "p_partkey", F.lit(".md")))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("x")).select("p_partkey", "x.*")


@query("tei_contexts", r"""
WITH l AS (SELECT doc_id, k AS section, trim(regexp_replace(x, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS t FROM (SELECT doc_id, unnest(range(1, len(x) + 1)) AS k, unnest(x) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)))
SELECT CAST(doc_id AS VARCHAR) AS paper, CAST(section AS INTEGER) AS section, CAST(CASE WHEN t = '' THEN 0 ELSE length(t) + 1 END AS INTEGER) AS start, '[' || section || ']' AS raw, CASE WHEN section % 3 = 0 THEN 'reference-missing' ELSE 'reference-resolved' END AS status,
  CASE WHEN section % 3 > 0 THEN 'Title ' || section % 3 || ' & more' END AS ref_title FROM l
""")  # fmt: skip
def tei_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as TEI, a division each line with a citation inside inline markup at its end; places, headings' sections and references."""
    from quillgraph.sources import structured

    half = F.floor(F.length("x") / 2).cast("int")
    clean = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "x")).withColumn("k", F.col("k") + 1)
    line = F.concat(F.lit("<div><head>Part "), F.col("k"), F.lit("</head><p>"), clean(F.substring("x", F.lit(1), half)), F.lit("<hi rend='a>b'>"), clean(F.substring("x", half + 1, F.length("x"))), F.lit(" <ref type=\"bibr\" target=\"#b"), F.col("k") % 3, F.lit("\">["), F.col("k"), F.lit("]</ref></hi> end.</p></div>"))
    books = "".join(f'<biblStruct xml:id="b{i}"><title level="a">Title {i} &amp; more</title><date when="200{i}"/></biblStruct>' for i in (1, 2))
    body = docs.groupBy("paper").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("x")))), lambda s: s["x"]), "\n").alias("body"))  # a document's lines
    xml = body.select("paper", F.concat(F.lit("<TEI><text><body>"), "body", F.lit(f"</body><back><listBibl>{books}</listBibl></back></text></TEI>")).alias("xml"))
    return structured.tei_contexts(xml).select("paper", "section", "start", "raw", "status", "ref_title")


@query("s2orc_contexts", r"""
WITH d AS (SELECT doc_id, text AS t, length(text) // 2 AS s FROM documents WHERE trim(coalesce(text, '')) <> ''),
w AS (SELECT doc_id, 'BIBREF0' AS ref_id, length(regexp_extract(substr(t, 1, s), '(?s)^.*[.!?\n]')) AS a, s + least(3, length(t) - s) AS e, t FROM d),
c AS (SELECT doc_id, ref_id, substr(t, a + 1, e + length(regexp_extract(substr(t, e + 1), '(?s)^[^.!?\n]*[.!?\n]?')) - a) AS c, 'reference-resolved' AS status FROM w UNION ALL SELECT doc_id, 'BIBREF9', t, 'reference-missing' FROM d)
SELECT CAST(doc_id AS VARCHAR) AS paper, ref_id, status, sha256(trim(regexp_replace(c, '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS context FROM c
""")  # fmt: skip
def s2orc_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON papers with cite spans in the middle and beyond the end of the text, written and read back; sentences by place and entries by id."""
    from quillgraph.runtime import scratch
    from quillgraph.sources import structured

    docs = table(spark, sf_dir, "documents").where("text is not null").withColumn("s", F.floor(F.length("text") / 2))
    span = lambda a, b, ref: F.struct(a.alias("start"), b.alias("end"), F.lit("[1]").alias("text"), F.lit(ref).alias("ref_id"))
    spans = F.array(span(F.col("s"), F.col("s") + 3, "BIBREF0"), span(F.length("text").cast("long"), F.length("text").cast("long") + 9, "BIBREF9"))
    entries = F.create_map(F.lit("BIBREF0"), F.struct(F.lit("One").alias("title"), F.lit(2001).alias("year")))
    paper = F.struct(F.col("doc_id").cast("string").alias("paper_id"), F.col("source").alias("title"), F.array(F.struct("text", F.lit("Body").alias("section"), spans.alias("cite_spans"))).alias("body_text"), entries.alias("bib_entries"))
    path = scratch(spark, "papers") + ".jsonl"
    docs.select(F.to_json(paper).alias("value")).write.text(path)
    return structured.read_body_contexts(spark, path).select("paper", "ref_id", "status", F.sha2("context", 256).alias("context"))
