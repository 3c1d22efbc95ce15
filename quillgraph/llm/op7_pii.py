"""Personal data by fixed patterns and a semi-Markov conditional random field.

Four kinds have exact base patterns (email, ip, card, phone); their spans always stay. Around them a
semi-Markov CRF looks for written-out or disguised forms: candidate segments of at most ``MOST_TOKENS`` tokens in regions with digits or with an at sign in
any spelling are scored as wholes (digit groups, check sums, separators, what stands at both ends, words before), and
dynamic programming over the segment ends chooses boundaries and kinds jointly. A chosen segment is added if it overlaps no base span
and its log odds against plain text exceed ``MARGIN``.

The weights are learned by maximum likelihood on a bounded sample of windows, drawn by hash from whole texts, around base spans, as found and
disguised in known ways, and around digits that are no personal data; every whole text is searched, in time proportional to its length.

Cases: null text counts as empty and has no spans; offsets are code points; repeated rows get the same spans each; without any window to
learn from nothing is added; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: The same matches as IP: within a run of digits no later start can match where the first does not, so each run is read once.
_IP_RUNS = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")

MOST_TOKENS, MOST_DIGITS, MARGIN = 24, 20, 2.0
#: The fit: texts that windows are drawn from, and windows; places without a span are looked at in pieces of so many characters.
SAMPLE_DOCS, WINDOWS, PIECE = 20_000, 1500, 400

Span = tuple[str, int, int]


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of every kind that pass their test, by kind and start."""
    out: list[Span] = []
    at = text.find("@")
    done = 0
    while at >= 0:  # an address ends left of the at sign where its characters end, so only their surroundings are searched
        start = at
        while start > done and (c := text[start - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m and text.index("@", start) == at:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP_RUNS.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(digits_of(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---- the semi-Markov model -------------------------------------------------------------------------

_AT = r"(?:@|\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\sat\s)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s)"
_MAIL_REGION = re.compile(rf"(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+){{0,3}}{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
#: Wherever the pattern finds an address, its at sign is one of these.
_MAIL_SIGN = re.compile(r"@|[\[({<]\s?at\s?[\])}>]|\sat\s", re.I)
_DIGIT_REGION = re.compile(r"(?:[+(]{1,2}\s?)?[0-9](?:[ ().\[\]/_+-]{0,3}[0-9])+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
_HINTS = (re.compile(r"mail|contact|write", re.I), re.compile(r"\bip\b|host|server|address", re.I), re.compile(r"card|visa|pay", re.I), re.compile(r"phone|tel|call|fax|mobile", re.I))
#: An address goes on behind its end, or before its start.
_MORE_AFTER, _MORE_BEFORE = re.compile(_DOT + "[A-Za-z0-9]", re.I), re.compile(rf"(?:[A-Za-z0-9]{_DOT}|[._%+-])\Z", re.I)
_MAIL_WHOLE = re.compile(_MAIL_REGION.pattern + r"\Z", re.I)
FEATURES = 24


def regions(text: str) -> list[tuple[int, int]]:
    """Where segments are looked for; merged and in order."""
    low = text.lower()
    found = [m.span() for m in _DIGIT_REGION.finditer(text) if len(digits_of(m[0])) >= 4] if any(c in low for c in "0123456789") else []
    if _MAIL_SIGN.search(text):
        found += [m.span() for m in _MAIL_REGION.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def candidates(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Segments of a region, of bounded length, with the features of each as a whole."""
    tokens = [(start + m.start(), start + m.end()) for m in _TOKEN.finditer(text[start:end])]
    segments, rows = [], []
    for i, (a, _) in enumerate(tokens):
        if not (text[a].isalnum() or text[a] in "+("):
            continue
        digits, letters = 0, False
        for c, b in tokens[i : i + MOST_TOKENS]:
            digits, letters = digits + (b - c) * ("0" <= text[c] <= "9"), letters or text[c].isalpha()
            if digits > MOST_DIGITS and not letters:
                break  # no kind has so many
            if text[b - 1].isalnum() and b - a >= 7:
                segments.append((a, b))
                rows.append(_features(text, a, b))
    return segments, np.array(rows).reshape(len(segments), FEATURES)


def _features(text: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    digits = digits_of(s)
    n = len(digits)
    groups = re.findall("[0-9]+", s)
    letters = any(c.isalpha() for c in s)
    four = len(groups) == 4 and not letters and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    dotted = four and s.count(".") == 3 and " " not in s.replace(" . ", "")
    plus = s.startswith("+") or (s.startswith("00") and not letters)
    mail = bool(_MAIL_WHOLE.match(s))
    before, after = text[max(0, a - 2) : a], text[b : b + 2]
    wider_left = bool(before) and (before[-1:].isalnum() or before[-1:] in "+" or (len(before) == 2 and before[0].isdigit() and before[1] in " .-()_/"))
    wider_right = bool(after) and (after[0].isalnum() or (len(after) == 2 and after[1].isdigit() and after[0] in " .-()_/"))
    context = text[max(0, a - 24) : a]
    if mail:
        wider_left = wider_left or bool(_MORE_BEFORE.search(context[-9:]))
        wider_right = wider_right or bool(_MORE_AFTER.match(text, b))
    return [float(x) for x in (
        1, 16 <= n <= 19, 16 <= n <= 19 and luhn(digits) and not letters, 16 <= n <= 19 and not luhn(digits), n >= 20, 8 <= n <= 15, n < 8,
        four, dotted, four and not dotted, plus and not letters, plus and not letters and 8 <= n <= 15, letters, mail, mail and "@" not in s,
        wider_left, wider_right, len(groups) == 1, "." in s and not letters, "(" in s or "[" in s,
        *(bool(h.search(context)) for h in _HINTS),
    )]


def forward(segments: list[tuple[int, int]], scores: np.ndarray, best: bool = False):
    """Over segment ends: log partition with log weights before each end, or the best segmentation."""
    ends = sorted({p for s in segments for p in s})
    at = {p: i for i, p in enumerate(ends)}
    into: list[list[int]] = [[] for _ in ends]
    for k, (_, b) in enumerate(segments):
        into[at[b]].append(k)
    alpha, back = np.zeros(len(ends)), [None] * len(ends)
    for i in range(1, len(ends)):
        values, via = [alpha[i - 1]], [None]
        for k in into[i]:
            for y in range(len(KINDS)):
                values.append(alpha[at[segments[k][0]]] + scores[k, y])
                via.append((k, y))
        if best:
            j = int(np.argmax(values))
            alpha[i], back[i] = values[j], via[j]
        else:
            top = max(values)
            alpha[i] = top + np.log(np.exp(np.array(values) - top).sum())
    if not best:
        return ends, at, into, alpha
    chosen, i = [], len(ends) - 1
    while i > 0:
        if back[i] is None:
            i -= 1
        else:
            chosen.append(back[i])
            i = at[segments[back[i][0]][0]]
    return chosen[::-1]


def marginals(segments: list[tuple[int, int]], scores: np.ndarray) -> tuple[float, np.ndarray]:
    """Log partition and the probability of every labelled segment."""
    ends, at, _, alpha = forward(segments, scores)
    out: list[list[int]] = [[] for _ in ends]
    for k, (a, _) in enumerate(segments):
        out[at[a]].append(k)
    beta = np.zeros(len(ends))
    for i in range(len(ends) - 2, -1, -1):
        values = [beta[i + 1]] + [beta[at[segments[k][1]]] + scores[k, y] for k in out[i] for y in range(len(KINDS))]
        top = max(values)
        beta[i] = top + np.log(np.exp(np.array(values) - top).sum())
    p = np.array([[alpha[at[a]] + scores[k, y] + beta[at[b]] - alpha[-1] for y in range(len(KINDS))] for k, (a, b) in enumerate(segments)])
    return float(alpha[-1]), np.exp(np.minimum(p, 0))


def fit(windows: list[tuple[str, list[Span]]], steps: int = 120, rate: float = 0.3, decay: float = 0.02) -> np.ndarray | None:
    """Maximum likelihood with an L2 penalty; a window is a text with its spans."""
    cases = []
    for text, spans in windows:
        gold = {(a, b): KINDS.index(k) for k, a, b in spans}
        for a, b in regions(text):
            segments, x = candidates(text, a, b)
            if segments:
                y = np.zeros((len(segments), len(KINDS)))
                for k, s in enumerate(segments):
                    if s in gold:
                        y[k, gold[s]] = 1
                cases.append((segments, x, y))
    if not cases:
        return None
    w = np.zeros((FEATURES, len(KINDS)))
    w[0] = -2
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = -decay * w
        for segments, x, y in cases[t % 4 :: 4]:
            _, p = marginals(segments, x @ w)
            g += 4 * x.T @ (y - p) / len(cases) * 10
        m, v = 0.8 * m + 0.2 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * m / (1 - 0.8**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return w


def overlapping(spans: list[Span], places: list[tuple[int, int]]) -> Iterator[tuple[tuple[int, int], list[Span]]]:
    """Each place, in order and apart from the others, with the spans that overlap it; one sweep over both."""
    waiting, live = sorted(spans, key=lambda s: s[1], reverse=True), []
    for a, b in places:
        while waiting and waiting[-1][1] < b:
            live.append(waiting.pop())
        live = [s for s in live if s[2] > a]
        yield (a, b), [s for s in live if s[1] < b]


def gaps(a: int, b: int, inside: list[Span]) -> Iterator[tuple[int, int]]:
    """What spans leave of a place."""
    for _, s, e in sorted(inside, key=lambda s: s[1]):
        if s > a:
            yield a, s
        a = max(a, e)
    if a < b:
        yield a, b


def added_spans(text: str, w: np.ndarray, base: list[Span]) -> list[Span]:
    """Segments that the model chooses in what the base spans leave of the regions."""
    out: list[Span] = []
    for (a, b), inside in overlapping(base, regions(text)):
        for start, end in gaps(a, b, inside):
            if end - start >= 7:
                segments, x = candidates(text, start, end)
                if segments:
                    scores = x @ w
                    out += [(KINDS[y], *segments[k]) for k, y in forward(segments, scores, best=True) if scores[k, y] > MARGIN]
    return out


def disguised(kind: str, value: str, way: int) -> str:
    """A known way to write a value so that the base pattern misses it."""
    if kind == "email":
        at, dot = ((" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."), (" [ at ] ", "."), (" <at> ", "."), (" ( at ) ", " [dot] "), (" at ", "."))[way % 8]
        user, _, host = value.partition("@")
        return f"{user}{at}{host.replace('.', dot)}"
    if kind == "ip":
        return value.replace(".", ("[.]", "(.)", " . ")[way % 3])
    if kind == "card":
        d = digits_of(value)
        return (".", "/", "_", " - ")[way % 4].join(d[i : i + 4] for i in range(0, len(d), 4))
    d = digits_of(value)
    groups = " ".join([d[:2], d[2:5], d[5:]])
    return ("00" + value[1:], "+ " + value[1:], "(00) " + value[1:], "00" + d, "00" + groups, "+ " + groups, "00 " + value[1:].replace(" ", ""), "+ " + d)[way % 8].strip()


def training_windows(text: str, ordinal: int) -> list[tuple[str, list[Span]]]:
    """Windows around all of a text's base spans that stand alone, as they are and disguised, and around its other digits."""
    base, out = sorted(base_spans(text), key=lambda s: s[1]), []
    ends = -40
    for i, (kind, a, b) in enumerate(base):
        alone = ends <= a - 40 and (i + 1 == len(base) or base[i + 1][1] >= b + 40)
        ends = max(ends, b)
        if alone:
            left, right = text[max(0, a - 40) : a], text[b : b + 40]
            for value in (text[a:b], disguised(kind, text[a:b], ordinal + i)):
                out.append((left + value + right, [(kind, len(left), len(left) + len(value))]))
    for (a, b), near in overlapping([(k, s - 40, e + 40) for k, s, e in base], regions(text)):
        if not near:
            out += [(text[max(0, s - 40) : min(b, s + PIECE) + 40], []) for s in range(a, b, PIECE)]
    return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, most: int = WINDOWS) -> np.ndarray | None:
    rows = docs.where(F.col("text").rlike("[0-9@]")).select("doc_id", "text")
    n = rows.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("pii")), F.lit(1 << 30))
    sample = rows.where(draw < F.lit(int(min(1.0, sample_docs / max(1, n)) * (1 << 30))))

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(hashlib.md5(repr((doc_id, k)).encode()).digest(), w, "".join(f"{kind}:{a}:{b}," for kind, a, b in spans)) for doc_id, text in zip(batch.column("doc_id").to_pylist(), C.texts_of(batch.column("text"))) for k, (w, spans) in enumerate(training_windows(text.decode(), doc_id or 0))]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["key", "text", "spans"])

    table = sample.mapInArrow(windows, "key binary, text string, spans string").orderBy("key", "text").limit(most).toArrow()
    cases = []
    for text, spans in zip(table["text"].to_pylist(), table["spans"].to_pylist()):
        parts = [x.split(":") for x in spans.split(",") if x]
        cases.append((text, [(k, int(a), int(b)) for k, a, b in parts]))
    return fit(cases)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, w: np.ndarray | None) -> DataFrame:
    """Per document: doc_id, counts and digest of the base spans, all spans, and how many of them the model added."""
    shared = docs.sparkSession.sparkContext.broadcast(w)  # FEATURES weights a kind

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in C.slices(batches, 4 << 20):
            rows = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), C.texts_of(batch.column("text"))):
                text = raw.decode()
                base = base_spans(text)
                more = added_spans(text, w, base) if w is not None else []
                kinds = [k for k, _, _ in base]
                rows.append((doc_id, *(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more)))
            types = (*[pa.int64()] * 5, pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(docs, train(docs))
