"""Quality classifier learnt from trusted positives and unlabelled text (non-negative PU learning).

Trusted positives are rows labelled 1; the unlabelled rows are a sample of the corpus. The class prior is estimated from a
first classifier of positives against unlabelled rows: where positives are pure, its odds equal 1 / prior (Elkan and
Noto 2008). A small network then minimises the non-negative unbiased risk of Kiryo et al. 2017:
``prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])``. Labels of the other class are never used.

Only the fit reads a sample, of at most about ``FIT_POSITIVES`` and ``FIT_UNLABELLED`` rows; every row is scored on its
whole text. Null and empty texts have all features 0 and get a score like any other. Without positives every score is
0.5. Repeated rows get equal scores; repeated or conflicting labels count once for each label row that says 1. Label rows
with a null id or label are ignored. Columns other than ``doc_id`` and ``text`` are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.op8_cascade import Measures
from tidemark.llm.text import bounded_batches, bytes_of, held_out, slices

FIT_POSITIVES = 6000
FIT_UNLABELLED = 12000
HIDDEN = 24
STEPS = 300
_DIGITS, _MARKS = b"0123456789", b"!?"


def features(texts: list[bytes]) -> np.ndarray:
    """One row per text: rates of symbols, repeats, copied lines, capitals, digits, marks, and lengths."""
    m, rows = Measures(texts), np.arange(len(texts))
    n = m.get("n_words", rows)
    safe, size = np.maximum(n, 1), np.maximum([len(t) for t in texts], 1)
    count = lambda marks: np.array([len(t) - len(t.translate(None, marks)) for t in texts], float)
    upper, lower = m.get("n_upper", rows), m.get("n_lower", rows)
    columns = [
        np.log1p(n) / 10,
        np.minimum(m.get("n_symbols", rows) / safe, 3),
        np.minimum(count(b"|") / safe, 3),
        m.get("n_repeat_words", rows) / safe,
        m.get("n_dup_lines", rows) / np.maximum(m.get("n_lines", rows), 1),
        upper / np.maximum(upper + lower, 1),
        np.minimum(count(_MARKS) / safe, 3),
        count(_DIGITS) / size,
        np.minimum(m.get("word_chars", rows) / safe, 40) / 10,
        np.array([len(set(m.words(i))) for i in range(len(texts))], float) / safe,
    ]
    return np.stack([np.asarray(c, float) for c in columns], axis=1) if texts else np.zeros((0, 10))


@dataclass(frozen=True)
class Network:
    """One hidden layer; ``mean`` and ``scale`` standardise the features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _train(pos: np.ndarray, unl: np.ndarray, prior: float | None, steps: int, seed: int = 11) -> Network:
    """Adam on the nnPU risk; without a prior, on the balanced logistic loss of positives against unlabelled rows."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    xp, xu = (np.clip((x - mean) / scale, -8, 8) for x in (pos, unl))
    w = [rng.normal(0, 0.4, (both.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        bp, bu = xp[rng.integers(0, len(xp), 512)], xu[rng.integers(0, len(xu), 1024)]
        hp, hu = np.tanh(bp @ w[0] + w[1]), np.tanh(bu @ w[0] + w[1])
        zp, zu = hp @ w[2] + w[3], hu @ w[2] + w[3]
        sp, su = sigmoid(zp), sigmoid(zu)
        if prior is None:
            gp, gu = (sp - 1) / len(bp), su / len(bu)
        else:
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if negative >= 0:
                gp, gu = prior * (sp - 1) / len(bp) - prior * sp / len(bp), su / len(bu)
            else:  # the risk of the negative class went below 0: step back from it
                gp, gu = prior * sp / len(bp), -su / len(bu)
        grad = [np.zeros_like(x) for x in w]
        for x, h, g in ((bp, hp, gp), (bu, hu, gu)):
            back = np.outer(g, w[2]) * (1 - h * h)
            grad[0] += x.T @ back
            grad[1] += back.sum(axis=0)
            grad[2] += h.T @ g
            grad[3] += g.sum()
        for k in range(4):
            g = grad[k] + 1e-4 * w[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, w[0], w[1], w[2], float(w[3][0]))


def class_prior(pos: np.ndarray, unl: np.ndarray, steps: int = STEPS) -> float:
    """Share of positives among the unlabelled rows: 1 / odds of a positive-against-unlabelled classifier on positives.

    Half of the positives fit the classifier, the other half is read off.
    """
    half = max(1, len(pos) // 2)
    odds = np.median(_train(pos[:half], unl, None, steps).score(pos[half:] if len(pos) > half else pos))
    return float(np.clip((1 - odds) / max(odds, 1e-6), 0.05, 0.98))


def _feature_rows(docs: DataFrame, mark: Column) -> np.ndarray:
    """Features of a bounded number of rows, brought to the driver for the fit; first column: the mark."""
    bounded_batches(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_of(batch, "text")
            for lo, hi in slices(texts):
                x = features(texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], ["mark", "x"])

    table = docs.select(mark.cast("long").alias("mark"), F.col("text").cast("string").alias("text")).mapInArrow(
        compute, "mark long, x array<double>").toArrow()
    x = np.array(table["x"].to_pylist(), float).reshape(-1, features([b""]).shape[1])
    return np.column_stack([table["mark"].to_numpy().astype(float), x])


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, positives: int = FIT_POSITIVES,
        unlabelled: int = FIT_UNLABELLED) -> tuple[Network | None, float]:
    """The network and the class prior, learnt from the rows where ``learn`` holds (all, if not given).

    ``labels`` has doc_id and quality. Both samples are drawn by a hash of the id, so they do not depend on the order or
    the partitions of the rows.
    """
    learn = F.lit(True) if learn is None else learn
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id")).where(learn)
    known, total = trusted.count(), docs.count()
    if not known or not total:
        return None, 0.5
    drawn = lambda salt, share: F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id").cast("long")), F.lit(1 << 30)) < int(
        min(1.0, share) * (1 << 30))
    few = trusted.where(drawn("positive", positives / known))  # about 8 bytes for each of ``positives`` rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(learn)
    sample = texts.where(drawn("unlabelled", unlabelled / total)).withColumn("mark", F.lit(0)).unionByName(
        texts.join(F.broadcast(few), "doc_id").withColumn("mark", F.lit(1)))
    rows = _feature_rows(sample, F.col("mark"))
    rows = rows[np.lexsort(rows.T)]
    pos, unl = rows[rows[:, 0] == 1, 1:], rows[rows[:, 0] == 0, 1:]
    if not len(pos) or not len(unl):
        return None, 0.5
    rng = np.random.default_rng(3)
    rng.shuffle(pos)
    prior = class_prior(pos, unl)
    return _train(pos, unl, prior, STEPS), prior


def _scores(model: Network | None, texts: list[bytes]) -> np.ndarray:
    return np.full(len(texts), 0.5) if model is None else model.score(features(texts))


def score_rows(docs: DataFrame, model: Network | None) -> DataFrame:
    """doc_id and score of every row."""
    bounded_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_of(batch, "text")
            for lo, hi in slices(texts):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(_scores(model, texts[lo:hi]))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        score, "doc_id long, score double")


def quality_filter(docs: DataFrame, labels: DataFrame, learn: Column | None = None, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``least``. Scoring shuffles nothing."""
    model, _ = fit(docs, labels, held_out(5) == F.lit(False) if learn is None else learn)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_of(batch, "text")
            for lo, hi in slices(texts):
                yield batch.slice(lo, hi - lo).filter(pa.array(_scores(model, texts[lo:hi]) >= least))

    return docs.mapInArrow(keep, docs.schema)
