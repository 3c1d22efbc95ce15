"""Paper identifiers: normal forms, types, canonical choice, publication dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order in which identifiers name a paper.
PRIORITY = ("arxiv", "doi", "pmid", "pmcid")


def doi(c: Column) -> Column:
    low = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"^https?://(?:dx\.)?doi\.org/", "")
    return F.regexp_replace(F.regexp_replace(low, r"^doi:\s*", ""), r"\s+", "")


def arxiv(c: Column) -> Column:
    """An arXiv id with its version, or the empty text if it is none (months are checked)."""
    low = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"^https?://arxiv\.org/(?:abs|pdf)/", "")
    low = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"\.pdf$", ""), r"^arxiv:\s*", ""), r"\s+", "")
    valid = low.rlike(r"^[0-9]{2}(0[1-9]|1[0-2])\.[0-9]{4,5}(v[0-9]+)?$") | low.rlike(r"^[a-z.-]+/[0-9]{2}(0[1-9]|1[0-2])[0-9]{3}(v[0-9]+)?$")
    return F.when(valid, low).otherwise("")


def arxiv_base(c: Column) -> Column:
    return F.regexp_replace(arxiv(c), r"v[0-9]+$", "")


def pmid(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]+", "")


def pmcid(c: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    return F.when(digits == "", "").otherwise(F.concat(F.lit("PMC"), digits))


def isbn(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^0-9X]", "")


issn = isbn


def kind(c: Column) -> Column:
    """Type of a free identifier, or the empty text."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    return (
        F.when(raw == "", "")
        .when(doi(raw).startswith("10."), "doi")
        .when(arxiv(raw) != "", "arxivId")
        .when(raw.rlike(r"(?i)^pmid:\s*.*[0-9]") | raw.rlike("^[0-9]+$"), "pmid")
        .when(raw.rlike(r"(?i)^pmcid:\s*.*[0-9]") | raw.rlike(r"(?i)^PMC[0-9]+$"), "pmcid")
        .when(raw.rlike(r"^(?:isbn:\s*)?[0-9xX-]+$") & F.length(isbn(raw)).isin(10, 13), "isbn")
        .when(raw.rlike(r"^(?:issn:\s*)?[0-9xX-]+$") & (F.length(issn(raw)) == 8), "issn")
        .otherwise("")
    )


def date_precision(c: Column) -> Column:
    """3 for a day, 2 for a month, 1 for a year, 0 for no date (years 1000 to 3000)."""
    text = F.trim(F.coalesce(c, F.lit("")))
    year = F.regexp_extract(text, "^([0-9]{4})", 1).try_cast("int")
    fits = year.between(1000, 3000)
    return F.when(fits & text.rlike(r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}(T.*)?$"), 3).when(fits & text.rlike(r"^[0-9]{4}[-/][0-9]{1,2}$"), 2).when(fits & text.rlike("^[0-9]{4}$"), 1).otherwise(0)


def date_key(c: Column) -> Column:
    """yyyy-mm-dd of the first day that a date may mean, or null."""
    parts = F.split(F.split(F.trim(c), "T")[0], "[-/]")
    part = lambda k: F.lpad(F.coalesce(F.get(parts, F.lit(k)), F.lit("1")), 2, "0")
    return F.when(date_precision(c) > 0, F.concat_ws("-", F.get(parts, F.lit(0)), part(1), part(2)))
