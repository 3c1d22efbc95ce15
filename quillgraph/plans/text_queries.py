"""Queries of the text layer: normal forms, hashes, identifiers, gates, sentences, phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import identifiers as I
from quillgraph.functions import text as T
from quillgraph.plans import sqltext as S
from quillgraph.plans.registry import query
from quillgraph.runtime import table


@query("text_normalize", f"""
WITH n AS (SELECT doc_id, {S.normalized("coalesce(text, '')")} AS norm FROM documents)
SELECT doc_id, substr(sha1(norm), 1, 12) AS norm_hash, CAST(len({S.tokens("norm")}) AS INTEGER) AS n_tokens, CAST(len({S.content_tokens("norm")}) AS INTEGER) AS n_content FROM n
""")  # fmt: skip
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised text, its stable hash, tokens and content tokens of every document."""
    norm = table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.coalesce("text", F.lit(""))).alias("norm"))
    return norm.select("doc_id", T.stable_hash(F.col("norm")).alias("norm_hash"), F.size(T.tokens(F.col("norm"))).alias("n_tokens"), F.size(T.content_tokens(F.col("norm"))).alias("n_content"))


@query("slug_and_title", r"""
WITH a AS (SELECT p_partkey, p_name || ' & ' || p_type || ' -- No. ' || p_size || '!' AS raw FROM part)
SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(trim(regexp_replace(lower(raw), '[^a-z0-9_ \t\n\r\f\x0B-]', '', 'g')), '[- \t\n\r\f\x0B]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'item') AS slug,
  array_to_string([upper(substr(w, 1, 1)) || substr(w, 2) FOR w IN string_split(p_name, ' ') IF w <> ''], ' ') AS title,
  CASE WHEN length(raw) <= 24 THEN raw ELSE trim(substr(raw, 1, 23)) || '...' END AS short
FROM a JOIN part USING (p_partkey)
""")  # fmt: skip
def slug_and_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs, title case and truncation."""
    raw = F.concat("p_name", F.lit(" & "), "p_type", F.lit(" -- No. "), "p_size", F.lit("!"))
    return table(spark, sf_dir, "part").select("p_partkey", T.slugify(raw).alias("slug"), T.title_case(F.col("p_name")).alias("title"), T.truncate(raw, 24).alias("short"))


_QUERY = "steel ring for the red red engine"


@query("token_overlap", f"""
WITH q AS (SELECT {S.content_tokens(f"'{_QUERY}'")} AS q), p AS (SELECT p_partkey, {S.content_tokens("lower(p_name)")} AS t FROM part)
SELECT p_partkey, CASE WHEN len(t) = 0 THEN 0.0 ELSE round(len(list_filter(q, lambda x: list_contains(t, x))) / CAST(len(q) AS DOUBLE), 6) END AS overlap,
  round({S.jaccard("list_distinct(q)", "list_distinct(t)")}, 6) AS jaccard FROM p, q
""")  # fmt: skip
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of query tokens found (repeats count) and set Jaccard."""
    q, t = T.content_tokens(T.normalize(F.lit(_QUERY))), T.content_tokens(T.normalize(F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(T.token_overlap(q, t), 6).alias("overlap"), F.round(T.jaccard(q, t), 6).alias("jaccard"))


@query("list_and_number", """
SELECT event_id, CAST(len(list_filter([trim(x) FOR x IN string_split(event_type || ' , ,' || user_id || ',' || event_type, ',')], lambda x: x <> '')) AS INTEGER) AS n_items,
  CAST(len(list_distinct(list_filter([trim(x) FOR x IN string_split(event_type || ' , ,' || user_id || ',' || event_type, ',')], lambda x: x <> ''))) AS INTEGER) AS n_distinct,
  coalesce(try_cast(CASE WHEN user_id % 3 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS DOUBLE), -1.0) AS number FROM events
""")  # fmt: skip
def list_and_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma lists, stable distinct, numbers with a fallback."""
    items = T.csv_list(F.concat("event_type", F.lit(" , ,"), "user_id", F.lit(","), "event_type"))
    number = F.when(F.col("user_id") % 3 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.size(items).alias("n_items"), F.size(F.array_distinct(items)).alias("n_distinct"), T.to_number(number, -1.0).alias("number"))


#: A raw identifier for every part, of a type that its key gives.
_RAW_SQL = """CASE p_partkey % 7 WHEN 0 THEN ' https://doi.org/10.1' || p_partkey || '/AbC ' WHEN 1 THEN 'doi: 10.5/X' || p_partkey WHEN 2 THEN 'arXiv:2' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || '.' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || 'v2'
 WHEN 3 THEN 'PMID: ' || p_partkey WHEN 4 THEN 'PMC' || p_partkey WHEN 5 THEN '978' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') ELSE 'title ' || p_partkey END"""


def _raw() -> F.Column:
    key, text = F.col("p_partkey"), lambda x: F.lit(x)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    forms = [
        F.concat(text(" https://doi.org/10.1"), key, text("/AbC ")), F.concat(text("doi: 10.5/X"), key), F.concat(text("arXiv:2"), pad(key % 1000, 3), text("."), pad(key, 5), text("v2")),
        F.concat(text("PMID: "), key), F.concat(text("PMC"), key), F.concat(text("978"), pad(key, 10)),
    ]
    out = F.when(key % 7 == 0, forms[0])
    for k in range(1, 6):
        out = out.when(key % 7 == k, forms[k])
    return out.otherwise(F.concat(text("title "), key))


@query("identifier_normalize", rf"""
WITH a AS (SELECT p_partkey, {_RAW_SQL} AS raw FROM part), b AS (SELECT p_partkey, raw,
  regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '^https?://(dx\.)?doi\.org/', ''), '^doi:\s*', ''), '\s+', '', 'g') AS doi,
  regexp_replace(regexp_replace(lower(trim(raw)), '^arxiv:\s*', ''), '\s+', '', 'g') AS ax FROM a)
SELECT p_partkey, doi, CASE WHEN regexp_matches(ax, '^[0-9]{{2}}(0[1-9]|1[0-2])\.[0-9]{{4,5}}(v[0-9]+)?$') THEN ax ELSE '' END AS arxiv,
  CASE WHEN starts_with(doi, '10.') THEN 'doi' WHEN regexp_matches(ax, '^[0-9]{{2}}(0[1-9]|1[0-2])\.[0-9]{{4,5}}(v[0-9]+)?$') THEN 'arxivId' WHEN regexp_matches(trim(raw), '(?i)^pmid:') OR regexp_matches(trim(raw), '^[0-9]+$') THEN 'pmid'
    WHEN regexp_matches(trim(raw), '(?i)^pmc[0-9]+$') THEN 'pmcid' ELSE '' END AS kind, regexp_replace(raw, '[^0-9]+', '', 'g') AS digits FROM b
""")  # fmt: skip
def identifier_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms and types of identifiers."""
    raw = table(spark, sf_dir, "part").select("p_partkey", _raw().alias("raw"))
    c = F.col("raw")
    return raw.select("p_partkey", I.doi(c).alias("doi"), I.arxiv(c).alias("arxiv"), I.kind(c).alias("kind"), I.pmid(c).alias("digits"))


@query("content_hash", """
SELECT doc_id, CASE WHEN text IS NULL THEN '' ELSE 'sha256:' || sha256(text) END AS content_sha256, 'title:' || substr(sha1(split_part(coalesce(text, ''), chr(10), 1)), 1, 16) AS title_alias FROM documents
""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content digests and title aliases."""
    start = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)  # the title line
    return table(spark, sf_dir, "documents").select("doc_id", T.content_sha256(F.col("text")).alias("content_sha256"), F.concat(F.lit("title:"), T.stable_hash(start, 16)).alias("title_alias"))


@query("date_precision", """
WITH a AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m') WHEN 2 THEN strftime(o_orderdate, '%Y') ELSE 'in press' END AS raw FROM orders), b AS (
SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS precision FROM a)
SELECT o_orderkey, precision, CASE precision WHEN 3 THEN raw WHEN 2 THEN replace(raw, '/', '-') || '-01' WHEN 1 THEN raw || '-01-01' END AS first_day FROM b
""")  # fmt: skip
def date_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication dates of day, month and year precision."""
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy/MM")).when(k == 2, F.date_format(d, "yyyy")).otherwise("in press")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.select("o_orderkey", I.date_precision(F.col("raw")).alias("precision"), I.date_key(F.col("raw")).alias("first_day"))


@query("source_gate", r"""
WITH s AS (SELECT 'page' AS kind, page_id AS id, html AS body FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents)
SELECT kind, id, CASE WHEN regexp_matches(ltrim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '^(?i)(<!--[\s\S]*?-->\s*)*(<!doctype\s+html\b|<html\b|<head\b|<body\b)') THEN 'html-document-instead-of-paper-markdown' END AS reason FROM s
""")  # fmt: skip
def source_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML and error pages are no sources."""
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body"))
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return pages.unionByName(docs).select("kind", "id", T.source_problem(F.col("body")).alias("reason"))


@query("evidence_quality", r"""
WITH t AS (SELECT doc_id, trim(coalesce(text, '')) AS x FROM documents)
SELECT doc_id, CAST(CASE WHEN x = '' THEN 0 WHEN length(x) - length(replace(x, '|', '')) >= 4 OR regexp_matches(x, '(?i)\(cid:[0-9]+\)') OR regexp_matches(x, '[A-Za-z]{32,}') THEN 0.45
  WHEN length(regexp_replace(x, '[^A-Za-z]', '', 'g')) / CAST(length(x) AS DOUBLE) < 0.45 THEN 0.6 WHEN len(list_filter(regexp_split_to_array(x, '[ \t\n\r\f\x0B]+'), lambda w: w <> '')) < 4 THEN 0.65 ELSE 1 END AS DOUBLE) AS quality FROM t
""")  # fmt: skip
def evidence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of evidence texts."""
    return table(spark, sf_dir, "documents").select("doc_id", T.evidence_quality(F.col("text")).alias("quality"))


@query("sentence_split", r"""
WITH s AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda x: trim(x) <> '') AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, CAST(coalesce(list_max([length(x) FOR x IN s]), 0) AS INTEGER) AS longest, substr(sha1(array_to_string(s, '|')), 1, 12) AS digest FROM s
""")  # fmt: skip
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document."""
    s = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).alias("longest"), T.stable_hash(F.array_join("s", "|")).alias("digest"))


_CLAIM_SQL = "CASE p_partkey % 5 WHEN 0 THEN 'robust retrieval can improve ' WHEN 1 THEN 'sparse adapter may fail under noise ' WHEN 2 THEN 'graph planning is limited yet better ' WHEN 3 THEN 'synthetic label cost ' ELSE 'plain ' END || p_name"


def _claim() -> F.Column:
    k = F.col("p_partkey") % 5
    start = F.when(k == 0, "robust retrieval can improve ").when(k == 1, "sparse adapter may fail under noise ").when(k == 2, "graph planning is limited yet better ").when(k == 3, "synthetic label cost ").otherwise("plain ")
    return F.concat(start, F.col("p_name"))


def _themes_sql(definitions: dict[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(x, '{p}') THEN '{k}' END" for k, p in definitions.items())
    return f"array_to_string(list_filter([{cases}], lambda t: t IS NOT NULL), ',')"


@query("themes_and_polarity", f"""
WITH c AS (SELECT p_partkey, {_CLAIM_SQL} AS x FROM part)
SELECT p_partkey, {_themes_sql(T.LIMITATION_THEMES)} AS limitation_themes, {_themes_sql(T.METHOD_THEMES)} AS method_themes,
  CASE WHEN regexp_matches(x, '{T.POSITIVE}') AND NOT regexp_matches(x, '{T.NEGATIVE}') THEN 'positive' WHEN regexp_matches(x, '{T.NEGATIVE}') AND NOT regexp_matches(x, '{T.POSITIVE}') THEN 'negative' ELSE 'mixed' END AS polarity FROM c
""")  # fmt: skip
def themes_and_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes of limitations and methods, polarity of claims."""
    x = table(spark, sf_dir, "part").select("p_partkey", _claim().alias("x"))
    return x.select("p_partkey", F.array_join(T.themes(F.col("x"), T.LIMITATION_THEMES), ",").alias("limitation_themes"), F.array_join(T.themes(F.col("x"), T.METHOD_THEMES), ",").alias("method_themes"), T.polarity(F.col("x")).alias("polarity"))


@query("concept_ngrams", f"""
WITH t AS (SELECT conv_id, {S.content_tokens(S.normalized("text"))} AS t FROM conversations),
g AS (SELECT conv_id, unnest([t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]) AS phrase, 1.75 AS w FROM t UNION ALL SELECT conv_id, unnest([t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] FOR i IN range(1, len(t) - 1)]), 2.25 FROM t)
SELECT conv_id, phrase, CAST(sum(w) AS DOUBLE) AS score, count(*) AS n FROM g WHERE NOT regexp_matches(phrase, '(^| )[0-9]{{4}}( |$)') GROUP BY ALL HAVING sum(w) >= 2.25
""")  # fmt: skip
def concept_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams at 1.75 and trigrams at 2.25, summed by conversation, from 2.25 on."""
    t = table(spark, sf_dir, "conversations").select("conv_id", T.content_tokens(T.normalize(F.col("text"))).alias("t"))
    grams = lambda n, w: t.where(F.size("t") >= n).select("conv_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - (n - 1)), lambda i: F.array_join(F.slice("t", i, n), " "))).alias("phrase"), F.lit(w).alias("w"))
    both = grams(2, 1.75).unionByName(grams(3, 2.25)).where(~F.col("phrase").rlike("(^| )[0-9]{4}( |$)"))
    return both.groupBy("conv_id", "phrase").agg(F.sum("w").alias("score"), F.count("*").alias("n")).where("score >= 2.25")


@query("section_roles", """
WITH a AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '1 Introduction' WHEN 1 THEN 'Related Work' WHEN 2 THEN 'Our Method' WHEN 3 THEN 'Experimental Results' WHEN 4 THEN 'Limitations and Discussion' ELSE 'Notes' END AS heading FROM orders)
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'introduction' WHEN 1 THEN 'related-work' WHEN 2 THEN 'method' WHEN 3 THEN 'experiments' WHEN 4 THEN 'discussion' ELSE 'body' END AS role FROM a
""")  # fmt: skip
def section_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role of a section by the first pattern that its heading has."""
    from quillgraph.sources.markdown import section_role

    k = F.col("o_orderkey") % 6
    heading = F.when(k == 0, "1 Introduction").when(k == 1, "Related Work").when(k == 2, "Our Method").when(k == 3, "Experimental Results").when(k == 4, "Limitations and Discussion").otherwise("Notes")
    return table(spark, sf_dir, "orders").select("o_orderkey", section_role(heading).alias("role"))
