"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows whose label is 1, unlabelled web text is a sample of all learnable documents (their labels unread). A small
network on features of form (shares of character classes, repetition of words and lines, lengths) minimises
the non-negative unbiased risk: ``prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])`` with logistic loss; where the second term turns
negative on a batch, its gradient is reversed. The class prior is estimated as the share of label 1 among learnable labels where
both kinds occur, else from the scores of positives against unlabelled text (mean score over U by mean score over P).

The fit uses a bounded sample (``POSITIVES`` and ``UNLABELLED`` rows, chosen by a hash); every whole text is scored.

Cases: null and empty texts are scored like any text without words; without positives every score is the
prior, or 0.5 without any label; repeated labels of a document count as the smallest; empty tables give no rows;
repeated rows get the same score each; extra columns are carried along or ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

POSITIVES, UNLABELLED = 4000, 8000
#: Rows of the sample for each chosen id, on average: ids may repeat.
ROWS_PER_ID = 4
FOLDS, THRESHOLD = 5, 0.3
_PUNCTUATION = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)


def features(text: bytes) -> list[float]:
    """Form of a whole text, in numbers of about the same size."""
    n = len(text)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    w, k = len(words), len(lines)
    tally = Counter(words)
    commonest = max(tally.values(), default=0)
    chars = max(1, n)
    marks = hist[_PUNCTUATION] / chars
    letters = hist[_UPPER].sum() + hist[_LOWER].sum() + hist[128:].sum()
    ends = sum(x.endswith((b".", b"!", b"?")) for x in lines)
    out = [
        np.log1p(n), np.log1p(w), np.log1p(k),
        hist[_UPPER].sum() / max(1, letters), hist[_DIGIT].sum() / chars, hist[128:].sum() / chars, hist[_LOWER].sum() / chars,
        hist[32] / chars, hist[10] / chars, marks.sum(),
        len(tally) / max(1, w), len(tally) / max(1.0, w**0.7), commonest / max(1, w), np.log1p(commonest),
        sum(map(eq, words, words[1:])) / max(1, w),
        len(set(lines)) / max(1, k), ends / max(1, k), n / max(1, w), w / max(1, k),
        max(map(len, words), default=0) / 20, len(zlib.compress(text, 1)) / max(20, n),
    ]
    return [float(x) for x in out] + [float(x) ** 0.5 for x in marks]


WIDTH = 21 + len(_PUNCTUATION)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(_forward(self.layers, self.prepared(x))[-1][:, 0], -40, 40)))

    def prepared(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)


def _forward(layers: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    w1, b1, w2, b2 = layers
    h = np.tanh(x @ w1 + b1)
    return [x, h, h @ w2 + b2]


def _gradient(layers: list[np.ndarray], x: np.ndarray, pull: np.ndarray) -> list[np.ndarray]:
    x, h, _ = _forward(layers, x)
    back = pull[:, None] @ layers[2].T * (1 - h * h)
    return [x.T @ back, back.sum(0), h.T @ pull[:, None], pull.sum(keepdims=True)]


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, steps: int = 1500, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> list[np.ndarray]:
    """Adam on the non-negative risk estimator."""
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, positive.shape[1] ** -0.5, (positive.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, 1)), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        p = positive[rng.integers(0, len(positive), 512)]
        u = unlabelled[rng.integers(0, len(unlabelled), 1024)]
        gp, gu = _forward(layers, p)[-1][:, 0], _forward(layers, u)[-1][:, 0]
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        from_u, from_p = sigmoid(gu) / len(gu), -prior * sigmoid(gp) / len(gp)
        if negative >= 0:
            from_p = from_p - prior * sigmoid(-gp) / len(gp)
        else:
            from_u, from_p = -from_u, -from_p
        grads = [a + b for a, b in zip(_gradient(layers, p, from_p), _gradient(layers, u, from_u))]
        step = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for i, g in enumerate(grads):
            g = g + decay * layers[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            layers[i] = layers[i] - step * m[i] / (1 - 0.9**t) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return layers


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> Model:
    both = np.concatenate([positive, unlabelled]) if len(positive) else unlabelled
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), [], 0.5 if prior is None else prior)
    model = Model(both.mean(0), both.std(0) + 1e-3, [], 0.5)
    p, u = model.prepared(positive), model.prepared(unlabelled)
    if prior is None:  # how likely unlabelled text is to be chosen as a positive, by how likely a positive is
        model.layers = nn_pu(p, u, 0.5)
        prior = float(np.clip(model.score(unlabelled).mean() / max(model.score(positive).mean(), 1e-6), 0.05, 0.95))
    model.prior = float(np.clip(prior, 0.02, 0.98))
    model.layers = nn_pu(p, u, model.prior)
    return model


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [np.array(features(t), "<f8").tobytes() for t in C.texts_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), pa.array(x, pa.binary())], ["doc_id", "positive", "x"])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    ids = docs.select(F.col("doc_id").alias("id")).where(C.held_in("id", FOLDS) != 0)
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("q"))
    rows = ids.join(known, "id", "left")
    n, ones, marked = rows.agg(F.count("*"), F.count(F.when(F.col("q") == 1, 1)), F.count("q")).first()
    if not ones:
        return fit(np.zeros((0, WIDTH)), np.zeros((0, WIDTH)), 0.0 if marked else None)
    draw = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30))
    below = lambda most, total: F.lit(int(min(1.0, 0.9 * most / total if total > most else 1.0) * (1 << 30)))
    chosen = rows.where((F.col("q") == 1) & (draw("p") < below(positives, ones))).select("id", F.lit(True).alias("positive"))
    chosen = chosen.unionByName(rows.where(draw("u") < below(unlabelled, n)).select("id", F.lit(False).alias("positive"))).distinct()
    chosen = chosen.orderBy(draw("order"), "id", "positive").limit(positives + unlabelled)  # so many ids at most, which bounds the broadcast; the same on every run
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "text", "positive")
    table = sample.mapInArrow(_features, "doc_id long, positive boolean, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", "positive", "x").limit(ROWS_PER_ID * (positives + unlabelled)).toArrow()
    x = np.frombuffer(b"".join(table["x"].to_pylist()), "<f8").reshape(table.num_rows, WIDTH)
    flag = np.array(table["positive"].to_pylist(), bool)
    order = np.lexsort((x[:, 20], x[:, 0], np.array(table["doc_id"].to_pylist(), float)))
    x, flag = x[order], flag[order]
    return fit(x[flag], x[~flag], ones / marked if ones < marked else None)


def score_name(docs: DataFrame) -> str:
    """The column that score adds: __score, with more underscores where the table has it."""
    return C.free_name(docs, "__score")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with their score added."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), score_name(docs)  # some thousands of weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in C.texts_of(batch.column("text"))], float).reshape(batch.num_rows, WIDTH)
            yield batch.append_column(name, pa.array(np.clip(shared.value.score(x), 0, 1), pa.float64()))

    return docs.mapInArrow(run, f"{C.schema_of(docs)}, `{name}` double")


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, columns as they were."""
    return score(docs, train(docs, labels)).where(F.col(score_name(docs)) >= THRESHOLD).select(docs.columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (C.held_in("doc_id", FOLDS) == 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
