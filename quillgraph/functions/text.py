"""Text semantics that every operator depends on, as Column expressions (JVM side).

Normalisation is lower case, compatibility decomposition, then everything but letters, numbers, white space and hyphens becomes
a space; so an accent becomes a space of its own (``été`` -> ``e te``). The decomposition is built from the Unicode tables: characters
that become one letter are translated, with a space behind those that lose a mark; the few that become several, and Hangul syllables, are
mapped one by one, in rows that have them.

Null texts stay null; empty ones stay empty.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content.
STOPWORDS = """a about above across after again against all almost also am among an and any are around as at be because been
before being below between both but by can could did do does done during each either else for from further had has have having
here how however if in into is it its itself just may might more most much must nearly no nor not of off on once one only onto
or other our out over per same should since so some such than that the their them then there these they this those through to
toward under until up upon use used using very was we well were what when where which while who why will with within without
would yet you your""".split()

_BLANK = r"[ \t\n\r\f\x0B]"


def latin_decompositions() -> dict[str, str]:
    """Lower-case Latin letters by what they decompose into once marks have become spaces."""
    groups: dict[str, str] = {}
    for code in range(0xC0, 0x250):
        low = chr(code).lower()
        parts = unicodedata.normalize("NFKD", low)
        if parts != low and len(low) == 1:
            to = "".join(" " if unicodedata.category(c).startswith("M") else c for c in parts)
            groups[to] = groups.get(to, "") + (low if low not in groups.get(to, "") else "")
    return groups


class Decomposition(NamedTuple):
    """Of lower-case characters: those that become one letter, the letters, those of them that lose a mark, and what others become."""

    letters: str
    bases: str
    marked: str
    others: dict[str, str]


@cache
def decomposition(first: int, last: int, gap: str) -> Decomposition:
    """For a range of code points, Hangul syllables left out. ``gap`` is what marks and signs become."""
    letters, bases, marked, others = [], [], [], {}
    for c in map(chr, range(first, last)):
        if 0xD800 <= ord(c) <= 0xDFFF or 0xAC00 <= ord(c) <= 0xD7A3 or c.lower() != c:
            continue
        parts = unicodedata.normalize("NFKD", c)
        to = re.sub(" +", " ", "".join(x if unicodedata.category(x)[0] in "LN" or x in "-_ " else gap for x in parts))
        if parts == c or gap and to.strip("_ ") == "" and unicodedata.category(c)[0] not in "LN":
            continue
        if len(to.rstrip() or to) == 1 and (not gap or to[0] != " "):
            letters.append(c)
            bases.append(to[0])
            if to[1:]:
                marked.append(c)
        else:
            others[c] = to
    return Decomposition("".join(letters), "".join(bases), "".join(marked), others)


def _ranges(chars: str) -> str:
    """A character class of sorted characters, by ranges."""
    out, codes = [], sorted(map(ord, chars))
    for i, code in enumerate(codes):
        if i and code == codes[i - 1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out)


def _hangul(c: Column) -> Column:
    """The two or three letters of a Hangul syllable, by the rule of its code."""
    s = F.ascii(c) - 0xAC00
    of = lambda start, n, i: F.get(F.array(*[F.lit(chr(start + k)) for k in range(n)]), i.cast("int"))
    last = F.when(s % 28 > 0, of(0x11A8, 27, s % 28 - 1)).otherwise("")
    return F.concat(of(0x1100, 19, F.floor(s / 588)), of(0x1161, 21, F.floor(s % 588 / 28)), last)


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c) with c evaluated once: what uses it several times stays a small expression, however deep."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def _decomposed(low: Column, first: int, last: int, gap: str = " ") -> Column:
    """One range of code points; ``gap`` is what a mark becomes. The classes begin with the range, so that other characters are passed over at the first test."""
    d, inside = decomposition(first, last, gap), rf"\x{{{first:x}}}-\x{{{last - 1:x}}}"
    syllables = r"\x{ac00}-\x{d7a3}" if first <= 0xAC00 < last else ""
    many = rf"[{inside}&&[{_ranges(''.join(d.others))}{syllables}]]"
    table = F.str_to_map(F.lit("\x01".join(f"{c}\x02{to}" for c, to in d.others.items())), F.lit("\x01"), F.lit("\x02"))
    is_syllable = lambda c: c.between(F.lit("\uac00"), F.lit("\ud7a3"))
    spelt = F.array_join(F.transform(F.split(low, ""), lambda c: F.when(is_syllable(c), _hangul(c)).otherwise(F.coalesce(F.try_element_at(table, c), c))), "")
    spaced = lambda x: F.regexp_replace(x, rf"([{inside}&&[{_ranges(d.marked)}]])", f"$1{gap}") if gap else x
    plain = lambda x: F.when(x.rlike(f"[{inside}]"), F.translate(spaced(x), d.letters, d.bases)).otherwise(x)
    return let(F.when(low.rlike(many), spelt).otherwise(low), plain)


def _plain_letters(c: Column, gap: str) -> Column:
    """Lower case, decomposed. Rows without letters beyond Latin skip the larger table, and rows of ASCII both."""
    latin = lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), _decomposed(x, 0xA0, 0x250, gap)).otherwise(x)
    wider = lambda x: F.when(x.rlike(r"[^\x00-\x{24f}]"), _decomposed(x, 0x250, 0x110000, gap)).otherwise(x)
    return let(let(F.lower(c), latin), wider)


def folded(c: Column) -> Column:
    """Lower case, decomposed, marks removed."""
    return _plain_letters(c, "")


def normalize(c: Column) -> Column:
    """Normalised text, in any script."""
    low = _plain_letters(c, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N} \t\n\r\f\x0B-]", " "), f"{_BLANK}+", " "))


def tokens(c: Column) -> Column:
    """Tokens of normalised text."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def content_tokens(c: Column) -> Column:
    """Tokens of normalised text longer than two characters that are no stop words."""
    return F.filter(F.split(c, " "), lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS))


def token_overlap(query: Column, text: Column) -> Column:
    """Share of the query's tokens (repeated ones count each time) that the text has."""
    found = F.size(F.filter(query, lambda t: F.array_contains(text, t)))
    return F.when((F.size(query) == 0) | (F.size(text) == 0), 0.0).otherwise(found / F.size(query))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def stable_hash(c: Column, length: int = 12) -> Column:
    return F.substring(F.sha1(c.cast("binary")), 1, length)


def content_sha256(c: Column) -> Column:
    return F.when(c.isNull(), "").otherwise(F.concat(F.lit("sha256:"), F.sha2(c, 256)))


def slugify(c: Column) -> Column:
    """ASCII word characters of the decomposed lower-case text, joined by hyphens; ``item`` if none is left."""
    plain = F.regexp_replace(_plain_letters(c, ""), r"[^A-Za-z0-9_ \t\n\r\f\x0B-]", "")
    joined = F.regexp_replace(F.trim(plain), rf"[- \t\n\r\f\x0B]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(joined, "^-+|-+$", ""), F.lit("")), F.lit("item"))


def truncate(c: Column, most: int = 180) -> Column:
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.trim(F.substring(text, 1, most - 1)), F.lit("...")))


def title_case(c: Column) -> Column:
    """The first letter of every word in upper case, the rest as it is."""
    words = F.filter(F.split(c, f"{_BLANK}+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def csv_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def to_number(c: Column, fallback: float) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(fallback))


#: Polarity of a claim and themes of limitations and methods, as patterns on the text in lower case.
POSITIVE = r"\b(improve|improved|outperform|better|gain|achieve|support|enable|transparent|easier)\b"
NEGATIVE = r"\b(degrade|degraded|worse|fail|fails|drop|limited|sensitive|cannot|unable)\b"
LIMITATION_THEMES = {
    "label-efficiency": r"\b(label|labels|annotation|annotated|supervised|manual)\b",
    "efficiency": r"\b(cost|costly|expensive|latency|slow|memory|compute|throughput)\b",
    "robustness": r"\b(noise|noisy|robust|sensitive|corruption|shift)\b",
    "generalization": r"\b(domain|cross-domain|generaliz|transfer|out-of-domain)\b",
    "evidence": r"\b(audit|evidence|trace|provenance|interpret)\b",
    "structure": r"\b(structure|graph|context|long context|section|hierarchy)\b",
}
METHOD_THEMES = {
    "label-efficiency": r"\b(few-shot|low-resource|semi-supervised|self-supervised|weak supervision|synthetic|active learning)\b",
    "efficiency": r"\b(efficient|adapter|lora|distill|sparse|compression|cache)\b",
    "robustness": r"\b(robust|augmentation|regularization|contrastive|noise)\b",
    "generalization": r"\b(transfer|domain adaptation|multi-domain|cross-domain|meta-learning)\b",
    "evidence": r"\b(retrieval|evidence|citation|audit|trace)\b",
    "structure": r"\b(graph|hierarchy|planning|structure|long context)\b",
}


def polarity(c: Column) -> Column:
    """positive or negative if the text has words of that kind alone, else mixed."""
    good, bad = F.lower(c).rlike(POSITIVE), F.lower(c).rlike(NEGATIVE)
    return F.when(good & ~bad, "positive").when(bad & ~good, "negative").otherwise("mixed")


def themes(c: Column, definitions: dict[str, str]) -> Column:
    low = F.lower(c)
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(k)) for k, p in definitions.items()]))


def evidence_quality(c: Column) -> Column:
    """0 for no text; .45 for extraction noise; .6 for few letters; .65 for under four tokens; else 1."""
    text = F.trim(F.coalesce(c, F.lit("")))
    noise = text.rlike(r"(?i)\(cid:[0-9]+\)") | (F.regexp_count(text, F.lit(r"\|")) >= 4) | text.rlike("[A-Za-z]{32,}")
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    few = F.size(F.filter(F.split(text, f"{_BLANK}+"), lambda t: t != "")) < 4
    return F.when(text == "", 0.0).when(noise, 0.45).when(letters / F.length(text) < 0.45, 0.6).when(few, 0.65).otherwise(1.0)


def sentences(c: Column) -> Column:
    """Sentences with their end marks, in order."""
    return F.filter(F.regexp_extract_all(c, F.lit(r"([^.!?\n]+[.!?]*)"), 1), lambda s: F.trim(s) != "")


#: Openings of error pages, and placeholder titles.
HTML_START = r"(?i)^(?:<!--[\s\S]*?-->\s*)*(?:<!doctype\s+html\b|<html\b|<head\b|<body\b)"
ERROR_START = r"(?i)^(?:#{1,6}\s*)?(?:403 forbidden|404 not found|access denied|just a moment\.\.\.|sign in to continue|checking your browser)(?:\s|$)"
PLACEHOLDER_TITLE = r"(?i)^(undefined|null|nan|none|unknown|untitled|n/a)$"
ERROR_TITLE = r"(?i)^(403 forbidden|404 not found|access denied|just a moment\.*|sign in to continue)$"
HTML_TITLE = r"(?i)<(?:!doctype|html|head|body|script|title)\b"


def source_problem(c: Column) -> Column:
    """Why a text is no paper's source, or null."""
    start = F.substring(F.regexp_replace(c, r"^[\s﻿]+", ""), 1, 8192)
    return F.when(start.rlike(HTML_START), "html-document-instead-of-paper-markdown").when(start.rlike(ERROR_START), "access-or-error-page")


def title_problem(c: Column) -> Column:
    title = F.regexp_replace(F.trim(c), r"^#{1,6}\s+", "")
    return F.when(title.rlike(HTML_TITLE), "html-title").when(title.rlike(PLACEHOLDER_TITLE), "placeholder-title").when(title.rlike(ERROR_TITLE), "access-or-error-title")


#: Headings and captions that stand where a title should.
NO_TITLE = (
    r"(?i)^(abstract|introduction|background|related work|preliminaries|methods?|approach|implementation|experiments?|evaluation|results|analysis|discussion|conclusions?|references|bibliography|appendix|appendices"
    r"|acknowledg?ments?|keywords?|index terms?|authors?|affiliations?|overview|summary|contents?)$|^(figure|table)\s+\w+"
)


def valid_title(c: Column) -> Column:
    """The text if it can be a paper's title, else null: 4 to 220 characters (2 if capitals), a letter or digit, no heading, caption, placeholder or error."""
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), r"^#{1,6}\s+", ""), r"^[-*]\s+", ""), "^[`\"'“”‘’]+|[`\"'“”‘’]+$", ""))
    long_enough = (F.length(title) >= 4) | title.rlike("^[A-Z]{2,}$")
    fits = title_problem(title).isNull() & long_enough & (F.length(title) <= 220) & title.rlike(r"[A-Za-z0-9\x{4e00}-\x{9fff}]") & ~title.rlike(NO_TITLE) & ~normalize(title).rlike(NO_TITLE)
    return F.when(fits, c)
