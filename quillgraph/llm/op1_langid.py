"""Language identification by error-correcting output codes.

Every language has a codeword; a binary classifier on hashed byte n-grams (one to three bytes) predicts each bit. Up to six
languages take the exhaustive code, more take the random code with the largest least distance among seeded draws. Decoding is
loss-weighted: a language's loss is the sum over bits of its weight (how well that bit is predicted for that
language in training) times the logistic loss of the bit's margin; the nearest codeword wins. A document
whose two nearest codewords are close is flagged as ambiguous.

The classifiers are fitted on a bounded sample of labelled rows (``SAMPLE_ROWS`` in all, shared evenly by the languages, chosen
by a hash of the row); every whole text is predicted. The languages are those of the learnable rows, all of them; if they are more than the sample has rows, each has one row. Rows without an id are not learned from.

Cases: null texts and texts without a letter give ``und`` with score 0; with no learnable row all texts do; with one
language that language is predicted; empty tables give no rows; repeated rows get the same prediction each; ties go
to the first language in order; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

BUCKETS, GRAMS = 4096, 3
#: The fit: labelled rows in all, or one a language if there are more languages than that; rows that a language has at least where the total allows it.
SAMPLE_ROWS, FEW = 4000, 8
FOLDS, HELD_OUT = 4, 2
#: Probability of the nearest codeword minus that of the second, below which a text is ambiguous.
AMBIGUOUS = 0.2
UNKNOWN = "und"


def features(texts: list[bytes]) -> np.ndarray:
    """Square roots of n-gram shares with unit norm, one row for each text; A-Z are lower-cased."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or (size + len(texts[end]) < 1 << 20 and end - start < 256)):
            size += len(texts[end]) + 2
            end += 1
        part = [b" " + t.lower() + b" " for t in texts[start:end]]
        lengths = np.array([len(t) for t in part])
        a = np.frombuffer(b"".join(part), np.uint8).astype(np.uint32)
        row = np.repeat(np.arange(len(part), dtype=np.int64) * BUCKETS, lengths)
        code, counts = np.zeros(len(a), np.uint32), np.zeros(len(part) * BUCKETS)
        for n in range(1, GRAMS + 1):
            last = len(a) - n + 1
            code = code[:last] * np.uint32(257) + a[n - 1 :]
            whole = row[:last] == row[n - 1 :]
            bucket = (code + np.uint32(n * 0x9E37)) * np.uint32(0x9E3779B1) >> np.uint32(20)
            counts += np.bincount((row[:last] + bucket)[whole], minlength=len(counts))
        x = np.sqrt(counts.reshape(len(part), BUCKETS))
        out[start:end] = x / np.linalg.norm(x, axis=1, keepdims=True)
        start = end
    return out


def code_matrix(k: int, seed: int = 7) -> np.ndarray:
    """Codewords of +1 and -1, a row for each of k languages."""
    if k <= 6:
        bits = max(1, 2 ** (k - 1) - 1)
        return np.array([[1 if r == 0 or (b + 1) >> (r - 1) & 1 == 0 else -1 for b in range(bits)] for r in range(k)], np.int8)
    rng, bits, best, most = np.random.default_rng(seed), math.ceil(10 * math.log2(k)), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (k, bits))
        agree = code.astype(int) @ code.T
        np.fill_diagonal(agree, -bits)
        if (least := (bits - agree.max()) // 2) > most and (abs(code.sum(0)) < k).all():
            best, most = code, least
    return best if best is not None else code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its probability, and that minus the second's."""
        margin = x @ self.weights + self.bias
        loss = np.stack([(self.trust[r] * np.logaddexp(0, -self.code[r] * margin)).sum(1) for r in range(len(self.languages))], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss) if len(loss) else loss
        p /= p.sum(1, keepdims=True)
        ordered = np.sort(p, 1)
        return p.argmax(1), ordered[:, -1], ordered[:, -1] - (ordered[:, -2] if p.shape[1] > 1 else 0)


def fit(x: np.ndarray, labels: list[str], steps: int = 200, rate: float = 0.5, decay: float = 1e-5) -> Model | None:
    """Logistic regression of all bits at once; languages weigh the same."""
    languages = sorted(set(labels))
    if not languages:
        return None
    code = code_matrix(len(languages))
    y = np.array([languages.index(v) for v in labels])
    target = code[y].astype(np.float32)
    share = (1 / np.bincount(y)[y] / len(languages)).astype(np.float32)[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, steps + 1):
        pull = -target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) * share
        for i, (p, g) in enumerate(((w, x.T @ pull + decay * w), (b, pull.sum(0)))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p -= rate * m[i] / (1 - 0.9**t) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    right = (np.sign(x @ w + b) == target).astype(np.float32)
    trust = np.stack([right[y == r].mean(0) for r in range(len(languages))]) + 1e-3
    return Model(languages, code.astype(np.float32), w, b, trust / trust.sum(1, keepdims=True) * code.shape[1])


def learnable() -> Column:
    return (C.held_in("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches, 4 << 20):
        x = features(C.texts_of(batch.column("text"))).astype(np.float16)
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    rows = docs.where(learnable()).select("doc_id", "lang", "text")
    languages = rows.select("lang").distinct().count()
    if not languages:
        return None
    each, most = max(FEW, sample_rows // languages), max(sample_rows, languages)
    # drawn by ids alone, every language's first one before any second; texts are read for those that were drawn
    keys = rows.where(F.col("doc_id").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id", F.lit("langid")).alias("draw")).distinct()
    placed = keys.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))).where(F.col("place") <= each)
    chosen = placed.orderBy("place", "draw", "lang", "doc_id").limit(most)
    sample = rows.join(chosen, ["doc_id", "lang"]).orderBy("place", "draw", "lang", "text").limit(most)
    table = sample.select("lang", "text").mapInArrow(_features, "lang string, x binary").toArrow()
    if not table.num_rows:
        return None
    x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float16).reshape(table.num_rows, BUCKETS).astype(np.float32)
    order = np.lexsort((x[:, 0], x[:, 1], np.array(table["lang"].to_pylist())))  # the order that tasks end in plays no part
    return fit(x[order], [table["lang"][int(i)].as_py() for i in order])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights a bit

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in C.slices(batches, 4 << 20):
            letters = np.array(batch.column("letters").to_pylist(), bool)
            n = batch.num_rows
            names, score, unsure = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
            if model is not None and letters.any():
                texts = C.texts_of(batch.column("text"))
                some = np.flatnonzero(letters)
                best, p, gap = model.decode(features([texts[i] for i in some]))
                score[some], unsure[some] = np.clip(p, 0, 1), gap < AMBIGUOUS
                for i, k in zip(some, best):
                    names[i] = model.languages[k]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(names), pa.array(score), pa.array(unsure)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select("doc_id", (C.held_in("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
