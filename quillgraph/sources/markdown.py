"""Markdown papers: sections with roles, chunks of paragraphs, references, tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.text import normalize, title_problem

#: What a heading must contain for a role; the first that fits counts.
SECTION_ROLES = [
    ("abstract", "abstract"), ("introduction", "introduction"), ("background", "background"), ("related work", "related-work"), ("preliminaries", "preliminaries"), ("method", "method"),
    ("approach", "method"), ("implementation", "method"), ("experiment", "experiments"), ("evaluation", "experiments"), ("result", "results"), ("analysis", "analysis"),
    ("discussion", "discussion"), ("conclusion", "conclusion"), ("references", "references"), ("bibliography", "references"), ("appendix", "appendix"),
]
CHUNK_CHARS = 1200
#: Titles that are none, with the reason; the first that fits counts.
NO_TITLES = [
    ("^abstract$", "section-heading"), ("^introduction$", "section-heading"), ("^background$", "section-heading"), ("^related work$", "section-heading"), ("^preliminaries$", "section-heading"),
    ("^(method|methods|approach|implementation)$", "section-heading"), ("^(experiment|experiments|evaluation|results|analysis|discussion)$", "section-heading"), ("^(conclusion|conclusions)$", "section-heading"),
    ("^(references|bibliography)$", "section-heading"), ("^(appendix|appendices)$", "section-heading"), ("^(acknowledg?ments?)$", "section-heading"), ("^(keywords?|index terms?)$", "metadata-heading"),
    ("^(authors?|affiliations?)$", "metadata-heading"), (r"^(figure|table)\s+\w+", "caption-like"), ("^(overview|summary|contents?)$", "section-heading"),
]
TITLE_CHARS = (4, 220)
CHUNKS, CHUNK_TEXT, MATERIALS = 8, 900, 8
_TICKS = re.compile(r"[+-]?\d+\.\d+(?:\s+[+-]?\d+\.\d+){2,}")
_LEGEND = re.compile(r"(?:\[[A-Za-z][\w-]*\]\s*){2,}[+ ]*\d+(?:\.\d+)?(?:\s+\d+(?:\.\d+)?){2,}")
_MARKS = re.compile(r"[\[\]?'\"]+")
_CAPTION = re.compile(r"(Table|Figure|Fig\.?)\s*[\w.-]*\s*[:.-]\s+.+", re.I)
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_FENCE = re.compile(r"^\s*(```|~~~|\$\$)")


def section_role(heading: Column) -> Column:
    low = normalize(heading)
    out = F.when(low.contains(SECTION_ROLES[0][0]), SECTION_ROLES[0][1])
    for pattern, role in SECTION_ROLES[1:]:
        out = out.when(low.contains(pattern), role)
    return out.otherwise("body")


def split_sections(text: str) -> list[tuple[int, str, str]]:
    """Level, heading and body of each section; what stands before the first heading has level 0. Fenced lines are never headings."""
    out, heading, level, body, fence = [], "", 0, [], ""
    for line in text.split("\n"):
        mark = _FENCE.match(line)
        if mark and (not fence or mark[1] == fence):
            fence = "" if fence else mark[1]
        found = None if fence or mark else _HEADING.match(line)
        if found:
            out.append((level, heading, "\n".join(body).strip()))
            level, heading, body = len(found[1]), found[2], []
        else:
            body.append(line)
    out.append((level, heading, "\n".join(body).strip()))
    return [s for s in out if s[1] or s[2]]


def blocks(text: str) -> list[str]:
    """Paragraphs; fenced code and display math stay whole."""
    out, held, fence = [], [], ""
    for line in text.split("\n"):
        mark = _FENCE.match(line)
        if mark and (not fence or mark[1] == fence):
            fence = "" if fence else mark[1]
        if line.strip() or fence:
            held.append(line)
        elif held:
            out.append("\n".join(held))
            held = []
    if held:
        out.append("\n".join(held))
    return [b for b in out if b.strip()]


def chunks(text: str, most: int = CHUNK_CHARS) -> list[str]:
    """Paragraphs gathered up to ``most`` characters; a longer paragraph is a chunk of its own."""
    out: list[list[str]] = []
    size = 0
    for block in blocks(text):
        if out and size + len(block) + 2 <= most:
            out[-1].append(block)
            size += len(block) + 2
        else:
            out.append([block])
            size = len(block)
    return ["\n\n".join(c) for c in out]


def reference(raw: str) -> tuple[str, int | None, str]:
    """Last name of the first author, year and title, as far as an entry shows them."""
    entry = " ".join(raw.split())
    year = re.search(r"\b((?:19|20)\d{2})[a-z]?\b", entry)
    if not year:
        return "", None, ""
    people = re.split(r"\s*(?:,| and |&)\s*", re.sub(r"[().,\s]+$", "", entry[: year.start()]).strip())
    after = re.sub(r"^[).\s:-]+", "", entry[year.end() :])
    return (people[0].split() or [""])[-1], int(year[1]), after.split(". ")[0].strip()


CHUNK_SCHEMA = "doc_id long, section int, heading string, level int, chunk int, chunk_id string, n_chars int, n_citations int"


def chunk_rows(docs: DataFrame) -> DataFrame:
    """A row for each chunk of each document's sections (a UDTF on whole texts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                for s, (level, heading, body) in enumerate(split_sections(text or "")):
                    for k, c in enumerate(chunks(body), 1):
                        rows.append((doc_id, s, heading, level, k, "chunk:" + hashlib.sha1(f"{k - 1}:{c}".encode()).hexdigest()[:12], len(c), len(re.findall(r"\[\d+(?:\s*[,-]\s*\d+)*\]", c))))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CHUNK_SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInPandas(run, CHUNK_SCHEMA)


def _noise(line: str) -> str:
    """Why a line is left of a chart, or nothing: decimals in equal steps, a legend with numbers, or nothing but question marks and brackets."""
    line = line.strip()
    if _TICKS.fullmatch(line):
        at = [float(x) for x in line.split()]
        step = at[1] - at[0]
        if step and all(abs(b - a - step) < 1e-8 for a, b in zip(at, at[1:])):
            return "chart_tick_or_legend"
    if _LEGEND.fullmatch(line):
        return "punctuation_artifact" if "?" in line else "chart_tick_or_legend"
    return "punctuation_artifact" if "?" in line and _MARKS.fullmatch(line) else ""


def cleaned(text: str) -> tuple[str, list[tuple[int, int, int, str]]]:
    """The text without chart noise, and line, start, end (in UTF-16 units of the original) and reason of what went.

    Fenced code, display math, tables and indented lines are never touched.
    """
    kept, gone, at, fence, math = [], [], 0, "", False
    for n, raw in enumerate(text.split("\n"), 1):
        line, size = raw.removesuffix("\r"), len(raw.encode("utf-16-le")) // 2
        bare, inside = line.strip(), bool(fence) or math
        mark = re.match(r"`{3,}|~{3,}", bare)
        if mark and not fence:
            fence = mark[0]
        elif mark and mark[0][0] == fence[0] and len(mark[0]) >= len(fence):
            fence = ""
        if not fence and bare in ("$$", r"\[", r"\]"):
            math = not math
        spared = inside or mark or math or "|" in bare or bare.startswith(("$$", r"\[", r"\]")) or line.startswith(("    ", "\t"))
        reason = "" if spared else _noise(line)
        if reason:
            gone.append((n, at, at + size, reason))
        else:
            kept.append(line)
        at += size + 1
    return re.sub(r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+\Z", "", "\n".join(kept)), gone


CLEAN_SCHEMA = "doc_id long, text string, n_lines int, n_removed int, removed array<struct<line:int,start:int,end:int,reason:string>>"


def cleaned_rows(docs: DataFrame) -> DataFrame:
    """Clean text and report of docs(doc_id, text); a null text is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, *cleaned(t or ""), (t or "").count("\n") + 1) for d, t in zip(pdf["doc_id"], pdf["text"])]
            yield pd.DataFrame([(d, t, n, len(g), [dict(zip(("line", "start", "end", "reason"), x)) for x in g]) for d, t, g, n in rows], columns=["doc_id", "text", "n_lines", "n_removed", "removed"])

    return docs.select("doc_id", "text").mapInPandas(run, CLEAN_SCHEMA)


def title_check(raw: Column, path: Column) -> Column:
    """title, valid and reason of what may be a paper's title: its first line that is not blank, without marks; the file's name stands for one that is no title."""
    file = F.regexp_replace(F.substring_index(F.coalesce(path, F.lit("")), "/", -1), r"(?<=.)\.[^.]*$", "")
    line = F.regexp_extract(F.regexp_replace(F.coalesce(raw, F.lit("")), "\r\n", "\n"), r"(?m)^.*\S.*$", 0)
    for pattern in (r"^\s+|\s+$", r"^#{1,6}\s+", r"^[-*]\s+", "^[`\"'“”‘’]+|[`\"'“”‘’]+$", r"^\s+|\s+$"):
        line = F.regexp_replace(line, pattern, "")
    few, most = TITLE_CHARS
    key = normalize(line)
    reason = F.when(line == "", "empty").when(~line.rlike(r"[A-Za-z0-9\x{4e00}-\x{9fff}]"), "missing-alphanumeric").when(F.length(line) > most, "too-long").when((F.length(line) < few) & ~line.rlike("^[A-Z]{2,}$"), "too-short")
    for pattern, why in NO_TITLES:
        reason = reason.when(line.rlike(f"(?i){pattern}") | key.rlike(f"(?i){pattern}"), why)
    reason = F.coalesce(reason, title_problem(line))
    return F.struct(F.when(reason.isNull(), line).when(file != "", file).otherwise("paper").alias("title"), reason.isNull().alias("valid"), reason.alias("reason"))


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().removeprefix("|").removesuffix("|").split("|")]


def _caption(line: str) -> str:
    found = _CAPTION.fullmatch(" ".join(line.split()))
    return "" if not found else "table" if found[1].lower() == "table" else "figure"


def tables(text: str, most: int = MATERIALS) -> list[tuple[str, int | None, int | None]]:
    """Caption, rows and columns of pipe tables, then captions whose table is not there. A table's caption is the nearest line of text among the three before it."""
    lines, out, used = re.split(r"\r?\n", text), [], set()
    row = lambda x: "|" in x and len(_cells(x)) >= 2 and any(_cells(x))
    i = 0
    while i < len(lines) - 1 and len(out) < most:
        marks = _cells(lines[i + 1])
        if not row(lines[i]) or len(marks) < 2 or not all(re.fullmatch(":?-{3,}:?", m) for m in marks):
            i += 1
            continue
        end = i + 2
        while end < len(lines) and row(lines[end]):
            end += 1
        near = next((x for x in reversed(lines[max(0, i - 3) : i]) if x.strip()), "")
        caption = " ".join(near.split()) if _caption(near) == "table" else ""
        if caption:
            used.add(i - 1)
        out.append((caption, end - i - 2, len([c for c in _cells(lines[i]) if c])))
        i = end
    rest = [(" ".join(x.split()), None, None) for n, x in enumerate(lines) if n not in used and _caption(x) == "table"]
    return (out + rest)[:most]


def figures(text: str, most: int = MATERIALS) -> list[str]:
    """Captions of figures."""
    return [" ".join(x.split()) for x in re.split(r"\r?\n", text) if _caption(x) == "figure"][:most]


MATERIAL_SCHEMA = "doc_id long, kind string, place int, caption string, n_rows int, n_columns int"


def material_rows(docs: DataFrame) -> DataFrame:
    """The first tables and figures of docs(doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["doc_id"], pdf["text"]):
                rows += [(d, "table", k, *x) for k, x in enumerate(tables(t or ""), 1)] + [(d, "figure", k, x, None, None) for k, x in enumerate(figures(t or ""), 1)]
            out = pd.DataFrame(rows, columns=["doc_id", "kind", "place", "caption", "n_rows", "n_columns"])
            yield out.astype({"place": "Int32", "n_rows": "Int32", "n_columns": "Int32"})

    return docs.select("doc_id", "text").mapInPandas(run, MATERIAL_SCHEMA)


def first_chunks(chunks: DataFrame, most: int = CHUNKS, chars: int = CHUNK_TEXT) -> DataFrame:
    """pack, place, chunk, text of the first chunks(pack, entry, chunk, text) of each pack, in the order of entries and chunks, with clipped texts."""
    text = F.trim(F.coalesce("text", F.lit("")))
    clipped = F.when(F.length(text) > chars, F.concat(F.trim(F.substring(text, 1, chars - 1)), F.lit("..."))).otherwise(text)
    order = Window.partitionBy("pack").orderBy("entry", "chunk")
    return chunks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("pack", "place", "entry", "chunk", clipped.alias("text"))
