"""Citation contexts of structured papers: TEI documents and body texts with cite spans.

A TEI paragraph is mixed content: its text is read once from tag to tag, white space becomes single spaces as it is written, and a ``<ref>`` keeps the places where its
text begins and ends, whatever tags stand around or in it. So a citation belongs to the sentence that its place lies in, even if the same mark
stands in another sentence first, and inline markup moves nothing. Nested divisions count: a paragraph has the head of the innermost one. References are
joined by id.

Body texts (JSON lines or one JSON array) are typed by ``from_json``; a span's sentence is cut by Column expressions around its place.

Cases: self-closing and unclosed tags, comments, CDATA and entities; a ref with several targets is one row each, without target one row without reference; a target that no
entry has is ``reference-missing``; spans that lie outside the text or are turned round give the whole text; null and empty texts give no rows; blocks without spans give none. Places are code points.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.sources.benchmarks import read_records

_MARKUP = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<raw>.*?)\]\]>|<\?.*?\?>|<![^>]*>|<(?P<close>/?)(?P<name>[A-Za-z_][\w:.-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/?)>", re.S)
_ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_BREAK = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9(\[])")
#: Roles of sections by their heading, the first that fits.
ROLES = [("abstract", "abstract"), ("introduction", "intro"), ("method", "method|approach|model|architecture"), ("evaluation", "experiment|evaluation|result"), ("discussion", "discussion|analysis"), ("conclusion", "conclusion"), ("references", "reference|bibliography")]
CONTEXTS = "paper string, section int, heading string, role string, paragraph string, raw string, ref_id string, start int, stop int, context string"
REFERENCES = "paper string, ref_id string, title string, year int, lead_author string, authors array<string>, doi string, arxiv string, pmid string, pmcid string, raw string"


def section_role(heading: str, kind: str = "") -> str:
    raw = (kind or heading).lower()
    return next((role for role, words in ROLES if re.search(words, raw)), re.sub(r"[^a-z0-9]+", "-", raw).strip("-"))


class _Text:
    """Text with single spaces that knows where it is."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size, self.space = 0, True

    def add(self, text: str) -> None:
        for piece in re.split(r"(\s+)", text):
            if piece and not piece.isspace():
                self.parts.append(piece)
                self.size, self.space = self.size + len(piece), False
            elif piece and not self.space:
                self.parts.append(" ")
                self.size, self.space = self.size + 1, True

    def __str__(self) -> str:
        return "".join(self.parts)


def sentence_window(text: str, start: int) -> str:
    """The sentence that a place lies in, with its neighbours."""
    edges = [0, *(m.end() for m in _BREAK.finditer(text)), len(text)]
    at = max((i for i in range(len(edges) - 1) if edges[i] <= start), default=0)
    return text[edges[max(at - 1, 0)] : edges[min(at + 2, len(edges) - 1)]].strip()


def scan_tei(xml: str) -> tuple[list[tuple], list[tuple]]:
    """Contexts (section, heading, role, paragraph, raw, ref_id, start, stop, context) and references of one document, in one pass over its tags."""
    contexts, references = [], []
    divs: list[dict] = [{"n": 0, "head": "", "kind": "", "paragraphs": []}]
    all_divs, n, in_body = [divs[0]], 0, "<body" not in xml
    head = paragraph = bib = None
    refs: list[dict] = []
    field: list[tuple[str, dict, _Text]] = []
    at = 0

    def text(t: str) -> None:
        for target in (head, paragraph[1] if paragraph else None, bib["text"] if bib else None, *(f[2] for f in field), *(r["text"] for r in refs)):
            if target is not None:
                target.add(t)

    for m in _MARKUP.finditer(xml):
        text(html.unescape(xml[at : m.start()]))
        at = m.end()
        if m["raw"] is not None:
            text(m["raw"])
        if not m["name"]:
            continue
        name, closing, empty = m["name"].lower(), bool(m["close"]), bool(m["empty"])
        attrs = {} if closing else {k.lower(): html.unescape(a or b or "") for k, a, b in _ATTRIBUTE.findall(m["attrs"])}
        if bib is not None:
            if name in ("title", "surname", "idno", "date"):
                if not closing:
                    field.append((name, attrs, _Text()))
                if (closing or empty) and field:
                    bib["fields"].append(field.pop())
            elif name == "biblstruct" and closing:
                references.append(_reference(bib, len(references)))
                bib = None
            else:
                bib["text"].add(" ")
            continue
        if name == "biblstruct" and not closing and not empty:
            bib = {"id": attrs.get("xml:id") or attrs.get("id") or "", "fields": [], "text": _Text()}
        elif name == "body":
            in_body = not closing
        elif name == "div" and in_body and not empty:
            if closing:
                divs[1:] = divs[1:-1]
            else:
                n += 1
                divs.append({"n": n, "head": "", "kind": attrs.get("type") or attrs.get("subtype") or "", "paragraphs": []})
                all_divs.append(divs[-1])
        elif name == "head" and in_body and not empty:
            if closing and head is not None:
                divs[-1]["head"] = divs[-1]["head"] or str(head).strip()
                head = None
            elif not closing:
                head = _Text()
        elif name == "p" and in_body and not empty:
            if closing and paragraph:
                divs[-1]["paragraphs"].append((paragraph[0], str(paragraph[1]).rstrip(), paragraph[2]))
                paragraph, refs = None, []
            elif not closing:
                paragraph = (attrs.get("xml:id") or attrs.get("id"), _Text(), [])
        elif name == "ref" and paragraph:
            if not closing:
                refs.append({"attrs": attrs, "text": _Text(), "start": paragraph[1].size})
            if (closing or empty) and refs:
                r = refs.pop()
                raw = str(r["text"]).strip()
                if r["attrs"].get("type", "").lower() == "bibr":
                    for target in r["attrs"].get("target", "").split() or [""]:
                        paragraph[2].append((raw, target.lstrip("#"), r["start"], paragraph[1].size))
        elif paragraph and name in ("lb", "cb", "pb"):
            paragraph[1].add(" ")
    for d in all_divs:
        role = section_role(d["head"], d["kind"])
        if role != "references":
            contexts += [(d["n"], d["head"], role, pid, raw, ref or None, start, stop, sentence_window(body, start)) for pid, body, marks in d["paragraphs"] if body for raw, ref, start, stop in marks]
    return contexts, references


def _reference(bib: dict, n: int) -> tuple:
    """A biblStruct: its article or main title, else its first; year, authors, identifiers."""
    of = lambda kind: [(a, re.sub(r"\s+", " ", str(t)).strip()) for k, a, t in bib["fields"] if k == kind]
    titles, raw = of("title"), re.sub(r"\s+", " ", str(bib["text"])).strip()
    title = next((t for a, t in titles if a.get("level") == "a" or a.get("type") == "main"), titles[0][1] if titles else "")
    year = next((y for y in [re.search(r"\b(?:19|20)\d{2}\b", x) for x in [*(a.get("when", "") for a, _ in of("date")), raw]] if y), None)
    authors = list(dict.fromkeys(t for _, t in of("surname") if t))
    ids = {a.get("type", "").lower(): t for a, t in of("idno") if t}
    doi, arxiv = re.sub(r"(?i)^https?://doi\.org/", "", ids.get("doi", "")), re.sub(r"(?i)^arxiv:", "", ids.get("arxiv", ""))
    return (bib["id"].lstrip("#") or f"b{n}", title or None, int(year[0]) if year else None, authors[0] if authors else None, authors, doi or None, arxiv or None, ids.get("pmid"), ids.get("pmcid"), raw)


def read_tei(spark: SparkSession, path: str) -> DataFrame:
    """paper (its file), xml of TEI files, one row each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("paper"), F.col("value").alias("xml"))


def _scanned(papers: DataFrame, schema: str, which: int) -> DataFrame:
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    types = [kinds[x.strip().split(" ")[1]] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *r) for p, x in zip(batch.column("paper").to_pylist(), batch.column("xml").to_pylist()) if x for r in scan_tei(x)[which]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names)

    return papers.select(F.col("paper").cast("string").alias("paper"), "xml").mapInArrow(run, schema)


def tei_references(papers: DataFrame) -> DataFrame:
    """The bibliography of papers(paper, xml); of entries with one id the last counts."""
    rows = _scanned(papers, REFERENCES, 1).withColumn("_n", F.monotonically_increasing_id())
    names = [c for c in rows.columns if c not in ("paper", "ref_id", "_n")]
    return rows.groupBy("paper", "ref_id").agg(F.max_by(F.struct(*names), "_n").alias("r")).select("paper", "ref_id", "r.*")


def tei_contexts(papers: DataFrame) -> DataFrame:
    """Citation contexts of papers(paper, xml) with what their reference says and ``status``."""
    found = _scanned(papers, CONTEXTS, 0).where("context <> ''")
    refs = tei_references(papers).select("paper", "ref_id", F.col("title").alias("ref_title"), F.col("year").alias("ref_year"), "lead_author", "doi", "arxiv", F.lit(True).alias("_known"))
    joined = found.join(refs, ["paper", "ref_id"], "left")
    return joined.withColumn("status", _status("ref_id", F.col("_known"))).drop("_known")


def _status(ref: str, known: Column) -> Column:
    return F.when(known.isNotNull(), "reference-resolved").when(F.col(ref).isNotNull(), "reference-missing").otherwise("reference-unresolved")


_SPAN = "struct<start: double, end: double, text: string, ref_id: string, refId: string>"
_BLOCK = f"struct<text: string, section: string, cite_spans: array<{_SPAN}>, citeSpans: array<{_SPAN}>, citation_spans: array<{_SPAN}>>"
_ENTRY = "struct<ref_id: string, refId: string, title: string, year: string, authors: array<struct<last: string>>, raw_text: string, other_ids: map<string, array<string>>>"
_PAPER = f"paper_id string, paperId string, corpusid string, corpus_id string, title string, abstract array<{_BLOCK}>, body_text array<{_BLOCK}>, bodyText array<{_BLOCK}>, bib_entries map<string, {_ENTRY}>, bibEntries map<string, {_ENTRY}>"


def span_window(text: Column, start: Column, stop: Column) -> Column:
    """The text around a span from the sentence break before it to the next one behind it; the whole text for spans that are not in it."""
    first = F.length(F.regexp_extract(F.substring(text, F.lit(1), start), r"(?s)^.*[.!?\n]", 0))
    last = F.least(stop, F.length(text))
    behind = F.length(F.regexp_extract(F.substring(text, last + 1, F.length(text)), r"(?s)^[^.!?\n]*[.!?\n]?", 0))
    inside = start.isNotNull() & stop.isNotNull() & (start >= 0) & (stop >= start) & (start < F.length(text))
    cut = F.when(inside, F.substring(text, first + 1, last + behind - first)).otherwise(text)
    return F.trim(F.regexp_replace(cut, r"\s+", " "))


def body_contexts(records: DataFrame) -> DataFrame:
    """paper, title, block, kind, heading, raw, ref_id, start, stop, context, ref_title, ref_year, lead_author, status of records(n, value): papers as JSON; records that are no JSON object go."""
    p = records.select("n", "value", F.from_json("value", _PAPER).alias("p"), F.get_json_object("value", "$.abstract").alias("_abstract"))
    name = F.coalesce("p.paper_id", "p.paperId", "p.corpusid", "p.corpus_id", F.concat(F.lit("s2orc:"), F.substring(F.sha1(F.concat_ws("|", "p.title", F.col("n").cast("string"))), 1, 16)))
    blank = F.from_json(F.lit("[]"), f"array<{_BLOCK}>")
    plain = F.when(F.col("_abstract").isNotNull() & ~F.col("_abstract").startswith("["), F.from_json(F.to_json(F.array(F.struct(F.col("_abstract").alias("text"), F.lit("Abstract").alias("section")))), f"array<{_BLOCK}>"))
    kinds = {"abstract": F.coalesce("p.abstract", plain, blank), "body_text": F.coalesce("p.body_text", "p.bodyText", blank)}
    numbered = lambda k: lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("block"), x.alias("b"))
    blocks = F.concat(*[F.transform(b, numbered(k)) for k, b in kinds.items()])
    rows = p.where("p is not null").select(name.alias("paper"), F.col("p.title").alias("title"), F.coalesce("p.bib_entries", "p.bibEntries").alias("bib"), F.explode(blocks).alias("x")).select("paper", "title", "bib", "x.kind", "x.block", "x.b.*").where("trim(text) <> ''")
    none = F.array().cast(f"array<{_SPAN}>")
    spans = F.concat(*[F.coalesce(c, none) for c in ("cite_spans", "citeSpans", "citation_spans")])
    each = rows.withColumn("s", F.explode(spans)).withColumn("ref", F.nullif(F.trim(F.coalesce("s.ref_id", "s.refId")), F.lit(""))).where("ref is not null or s.text is not null or s.start is not null")
    entry = F.try_element_at("bib", "ref")
    each = each.withColumns({"entry": entry, "start": F.col("s.start").cast("int"), "stop": F.col("s.end").cast("int")})
    year = F.nullif(F.regexp_extract("entry.year", r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")
    out = each.select("paper", "title", "block", "kind", F.coalesce("section", F.lit("")).alias("heading"), F.col("s.text").alias("raw"), F.col("ref").alias("ref_id"), "start", "stop", span_window(F.col("text"), F.col("start"), F.col("stop")).alias("context"), F.col("entry.title").alias("ref_title"), year.alias("ref_year"), F.get("entry.authors", F.lit(0))["last"].alias("lead_author"), _status("ref", F.col("entry")).alias("status"))
    return out.dropDuplicates(["paper", "kind", "block", "ref_id", "raw", "start", "stop", "context"])


def read_body_contexts(spark: SparkSession, path: str) -> DataFrame:
    """Contexts of a file of papers: JSON lines, or one JSON array read in byte ranges."""
    return body_contexts(read_records(spark, path))
