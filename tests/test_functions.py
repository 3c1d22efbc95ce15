import random
import re
import unicodedata

from pyspark.sql import functions as F

from quillgraph.functions import identifiers as I
from quillgraph.functions import text as T


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def normalized(text):
    x = unicodedata.normalize("NFKD", text.lower())
    x = "".join(c if unicodedata.category(c)[0] in "LN" or c in " \t\n\r\f\x0b-" else " " for c in x)
    return re.sub("[ \t\n\r\f\x0b]+", " ", x).strip(" ")


def slug(text):
    x = re.sub(r"[^A-Za-z0-9_\s-]", "", unicodedata.normalize("NFKD", text.lower())).strip()
    return re.sub("^-+|-+$", "", re.sub(r"[-\s]+", "-", x)) or "item"


def test_normalize_and_slugs_in_any_script(spark):
    """Latin, Greek, Cyrillic, kana, Hangul, CJK, ligatures, circled and full-width characters, as Unicode decomposes them."""
    r = random.Random(1)
    alphabet = [chr(c) for c in [*range(32, 127)] * 3 + [*range(0xA0, 0x250)] * 2 + [*range(0x370, 0x530), *range(0x3041, 0x30FF), *range(0xAC00, 0xD7A3, 97), *range(0x1E00, 0x1FFF), *range(0xFB00, 0xFB06), *range(0xFF01, 0xFF5E)] + [0x2460, 0x2167, 0x33A5, 0x4E2D, 0x1D400, 0x1D51E, 0x2474, 0xBD]]
    texts = ["", "Café Été", "각 값 漢字", "ＡＢｃ ﬁne ①", *("".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i int, t string")
    for row in df.select("i", T.normalize(F.col("t")).alias("n"), T.slugify(F.col("t")).alias("s")).collect():
        if row["i"] < 0:
            assert row["n"] is None
        else:
            assert (row["n"], row["s"]) == (normalized(texts[row["i"]]), slug(texts[row["i"]]))
    assert slug("Café Été") == "cafe-ete"


def test_overlap_counts_repeats_and_jaccard_does_not(spark):
    q = F.split(F.lit("red red blue"), " ")
    assert values(spark, ["red car"], T.token_overlap(q, F.split("x", " ")).alias("o"), T.jaccard(q, F.split("x", " ")).alias("j")) == [(2 / 3, 1 / 3)]
    assert values(spark, ["a"], T.token_overlap(F.array().cast("array<string>"), F.split("x", " ")).alias("o")) == [(0.0,)]


def test_slug_title_truncate(spark):
    assert values(spark, ["Hello, World -- 2!", "!!!"], T.slugify(F.col("x")).alias("s")) == [("hello-world-2",), ("item",)]
    assert values(spark, ["two mcWords"], T.title_case(F.col("x")).alias("s")) == [("Two McWords",)]
    assert values(spark, ["abcdef", None], T.truncate(F.col("x"), 4).alias("s")) == [("abc...",), ("",)]


def test_stable_hash_and_digest(spark):
    assert values(spark, ["abc"], T.stable_hash(F.col("x")).alias("h")) == [("a9993e364706",)]
    assert values(spark, [None], T.content_sha256(F.col("x")).alias("h")) == [("",)]


def test_quality_polarity_themes(spark):
    texts = ["a (cid:12) b c d", "1 2 3 4 5 6 7", "one two", "one two three four", None]
    assert [r[0] for r in values(spark, texts, T.evidence_quality(F.col("x")).alias("q"))] == [0.45, 0.6, 0.65, 1.0, 0.0]
    assert [r[0] for r in values(spark, ["We improve it", "it may fail", "improve but fail", "x"], T.polarity(F.col("x")).alias("p"))] == ["positive", "negative", "mixed", "mixed"]
    assert values(spark, ["slow and noisy"], T.themes(F.col("x"), T.LIMITATION_THEMES).alias("t")) == [(["efficiency", "robustness"],)]


def test_source_and_title_gates(spark):
    texts = ["  <!DOCTYPE html><p>", "# 404 Not Found\n", "# A paper", "<!-- x --><html>"]
    assert [r[0] for r in values(spark, texts, T.source_problem(F.col("x")).alias("p"))] == ["html-document-instead-of-paper-markdown", "access-or-error-page", None, "html-document-instead-of-paper-markdown"]
    assert [r[0] for r in values(spark, ["# Untitled", "Real", "<html>x"], T.title_problem(F.col("x")).alias("p"))] == ["placeholder-title", None, "html-title"]


def test_identifiers(spark):
    texts = ["https://doi.org/10.1/AB", "arXiv:2101.00001v2", "arXiv:2113.00001", "PMID: 12", "pmc77", "978-3-16-148410-0", "0378-5955", "a title", None]
    assert [r[0] for r in values(spark, texts, I.kind(F.col("x")).alias("k"))] == ["doi", "arxivId", "", "pmid", "pmcid", "isbn", "issn", "", ""]
    assert values(spark, ["https://doi.org/10.1/AB"], I.doi(F.col("x")).alias("d")) == [("10.1/ab",)]
    assert values(spark, ["arXiv:2101.00001v2"], I.arxiv_base(F.col("x")).alias("d")) == [("2101.00001",)]


def test_dates(spark):
    texts = ["2020-5-7", "2020/05", "2020", "0999", "soon", "2020-05-07T10:00"]
    assert [tuple(r) for r in values(spark, texts, I.date_precision(F.col("x")).alias("p"), I.date_key(F.col("x")).alias("k"))] == [(3, "2020-05-07"), (2, "2020-05-01"), (1, "2020-01-01"), (0, None), (0, None), (3, "2020-05-07")]
