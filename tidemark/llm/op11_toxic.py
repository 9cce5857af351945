"""Toxicity by non-negative positive-unlabelled learning over the words of a text.

Confirmed toxic texts are the positives; unlabelled text is a sample of the corpus, toxic texts included. Words that occur
in clearly more positives than unlabelled texts become features (a signed likelihood-ratio test). A first linear classifier,
fitted to one half of both samples, gives the class prior: the least ratio of unlabelled to positive texts above a score,
read on the other halves, allowing for chance (best-bin estimate, Garg et al. 2021). The second minimises the non-negative
unbiased risk of Kiryo et al. 2017, ``prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])``, with the logistic loss.
Its margin is shifted to the cut with the least such risk of the zero-one loss, where the score is 0.5. Labels 0 are never
used. Both classifiers are trained in numpy.

A word is a run of letters in lower case; ideographs and kana count one by one. Marks around or inside letters do not
hide a word's neighbours, and repeats count once. Only the fit reads samples, of about ``FIT_POSITIVES`` and
``FIT_UNLABELLED`` rows; every row is scored on its whole text.

Null and empty texts have no word and get the score of a text without features. Without positives or features every score
is 0. Repeated rows get equal scores; an id counts as positive if any of its label rows says 1, and once however many do. Label
rows with a null id or label are ignored, rows with a null id are never learnt from. Columns other than ``doc_id`` and ``text``
are neither read nor changed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import bounded_batches, bytes_of, held_out, pieces, slices
from tidemark.session import cut_lineage

FIT_POSITIVES, FIT_UNLABELLED, FEATURES = 6000, 18000, 2048
#: Least likelihood-ratio statistic and least ratio of shares of a feature.
EVIDENCE, LIFT = 16.0, 2.0
STEPS, RATE, SHRINK = 400, 0.05, 2e-4
_WORD = re.compile(r"[^\W\d_⺀-￿]+|[⺀-鿿가-퟿豈-﫿]")


def words_of(text: bytes) -> set[str]:
    """The distinct words of a text."""
    found: set[str] = set()
    for piece in pieces(text):
        found.update(_WORD.findall(piece.decode("utf-8", "replace").lower()))
    return found


@dataclass(frozen=True)
class Examples:
    """Texts as the features they have: ``row`` and ``feature`` of every occurrence, and the number of texts."""

    row: np.ndarray
    feature: np.ndarray
    count: int

    def margins(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.row, weights[self.feature], self.count)

    def pull(self, slope: np.ndarray, features: int) -> np.ndarray:
        """The gradient of the weights, given that of the margins."""
        return np.bincount(self.feature, slope[self.row], features)

    def part(self, chosen: np.ndarray) -> Examples:
        """The texts where ``chosen`` is true."""
        number, held = np.cumsum(chosen) - 1, chosen[self.row]
        return Examples(number[self.row[held]], self.feature[held], int(chosen.sum()))


@dataclass(frozen=True)
class Linear:
    """Weight of each feature word, and the margin of a text without any; ``None`` stands for nothing learnt."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float | None = None

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.bias is None:
            return np.zeros(len(texts))
        known = self.weights.keys()
        margins = [self.bias + sum(map(self.weights.__getitem__, sorted(words_of(t) & known))) for t in texts]
        return 1 / (1 + np.exp(-np.clip(margins, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk_slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of margins of positive and unlabelled texts, and the direction of descent's gradient.

    Where the negative class's risk estimate is below 0 the estimate is pushed back up instead of being lowered further.
    """
    sp, su = _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    if negative >= 0:
        return positive + negative, prior * (sp - 1 / len(zp)) - prior * sp, su
    return positive, prior * sp, -su


def _train(pos: Examples, unl: Examples, features: int, prior: float | None) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk; without a prior on the balanced logistic loss of positive against unlabelled."""
    w, m, v = np.zeros(features + 1), np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, STEPS + 1):
        zp, zu = pos.margins(w[:-1], w[-1]), unl.margins(w[:-1], w[-1])
        if prior is None:
            gp, gu = (_sigmoid(zp) - 1) / len(zp), _sigmoid(zu) / len(zu)
        else:
            _, gp, gu = risk_slopes(zp, zu, prior)
        g = np.append(pos.pull(gp, features) + unl.pull(gu, features) + SHRINK * w[:-1], gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)  # features are words that speak for the positive class
    return w[:-1], float(w[-1])


def least_risk_cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The margin that parts the classes with the least non-negative risk of the zero-one loss.

    Of cuts with equal risk the one in the middle of the widest gap between margins.
    """
    margins = np.unique(np.concatenate([positive, unlabelled]))
    ends = np.concatenate([[margins[0] - 2], margins, [margins[-1] + 2]])
    cuts = (ends[1:] + ends[:-1]) / 2
    below_p, below_u = (np.searchsorted(np.sort(z), cuts) / len(z) for z in (positive, unlabelled))
    risk = prior * below_p + np.maximum(0, (1 - below_u) - prior * (1 - below_p))
    least = np.flatnonzero(risk <= risk.min() + 1e-12)
    return float(cuts[least[np.argmax(np.diff(ends)[least])]])


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """Share of positives among unlabelled scores: the ratio of texts at or above the score where it is surely least."""
    cuts = np.unique(positive)
    above = lambda scores: 1 - np.searchsorted(np.sort(scores), cuts) / len(scores)
    qp, qu = above(positive), above(unlabelled)
    slack = np.sqrt(np.log(4 / doubt) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin((qu + slack) / qp)
    return float(np.clip(qu[best] / qp[best], 0.001, 0.9))


def class_prior(pos: Examples, unl: Examples, features: int) -> float:
    """The prior from scores of texts the scoring classifier was not fitted to."""
    half = lambda texts: np.arange(texts.count) % 2 == 0
    hp, hu = half(pos), half(unl)
    weights, bias = _train(pos.part(hp), unl.part(hu), features, None)
    rest_p, rest_u = (pos.part(~hp), unl.part(~hu)) if pos.count > 1 and unl.count > 1 else (pos, unl)
    return best_bin_prior(rest_p.margins(weights, bias), rest_u.margins(weights, bias))


def _sample(docs: DataFrame, labels: DataFrame, learn: Column, positives: int, unlabelled: int) -> DataFrame:
    """Mark (1 positive, 0 unlabelled) and words of the sampled rows; drawn by a hash of the id."""
    trusted = labels.where((F.col("toxic") == 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id")).where(learn).distinct()
    known, total = trusted.count(), docs.count()
    drawn = lambda salt, most, of: F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id")), F.lit(1 << 30)) < int(
        min(1.0, most / max(of, 1)) * (1 << 30))
    few = trusted.where(drawn("toxic", positives, known)).withColumn("toxic", F.lit(True))  # about 9 bytes a positive
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.where(F.col("doc_id").isNotNull() & learn).join(F.broadcast(few), "doc_id", "left")
    marks = F.array_compact(F.array(F.when(F.col("toxic"), 1), F.when(drawn("any text", unlabelled, total), 0)))
    sample = rows.select("doc_id", F.explode(marks.cast("array<long>")).alias("mark"), "text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_of(batch, "text")
            for lo, hi in slices(texts):
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, hi - lo) for c in batch.columns[:2]),
                     pa.array([sorted(words_of(t)) for t in texts[lo:hi]], pa.list_(pa.string()))], ["doc_id", "mark", "words"])

    return cut_lineage(sample.mapInArrow(compute, "doc_id long, mark long, words array<string>"))


def _feature_words(sample: DataFrame, positives: int, unlabelled: int, most: int) -> list[str]:
    """Words with clearly more positives than their share of unlabelled texts makes likely, at most ``most``."""
    per_word = sample.select("mark", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("mark").cast("double").alias("p"), F.sum(1 - F.col("mark")).cast("double").alias("u"))
    expected = F.greatest(F.col("u"), F.lit(0.5)) * (positives / unlabelled)
    evidence = 2 * (F.col("p") * F.ln(F.col("p") / expected) - (F.col("p") - expected))
    chosen = per_word.where((F.col("p") >= LIFT * expected) & (F.col("p") > 0)).withColumn("evidence", evidence)
    return [r.word for r in chosen.where(F.col("evidence") >= EVIDENCE).orderBy(F.desc("evidence"), "word").limit(most).collect()]


def _examples(sample: DataFrame, words: list[str]) -> tuple[Examples, Examples]:
    """Positive and unlabelled texts by the features they have, in the order of their ids."""
    number = {word: i for i, word in enumerate(words)}

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(number[w] for w in row if w in number) for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int32()))], ["doc_id", "mark", "x"])

    table = sample.mapInArrow(compute, "doc_id long, mark long, x array<int>").toArrow()
    rows = sorted(zip(table["mark"].to_pylist(), table["doc_id"].to_pylist(), table["x"].to_pylist()))
    out = []
    for mark in (1, 0):
        texts = [x for m, _, x in rows if m == mark]
        out.append(Examples(np.repeat(np.arange(len(texts)), [len(x) for x in texts]),
                            np.array([f for x in texts for f in x], np.int64), len(texts)))
    return out[0], out[1]


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, positives: int = FIT_POSITIVES,
        unlabelled: int = FIT_UNLABELLED, features: int = FEATURES) -> tuple[Linear, float | None]:
    """The classifier and the class prior, learnt from the rows where ``learn`` holds (all, if not given).

    ``labels`` has doc_id and toxic.
    """
    bounded_batches(docs.sparkSession)
    sample = _sample(docs, labels, F.lit(True) if learn is None else learn, positives, unlabelled)
    counts = {r.mark: r.n for r in sample.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        return Linear(), None
    words = _feature_words(sample, counts[1], counts[0], features)
    if not words:
        return Linear(), None
    pos, unl = _examples(sample, words)
    prior = class_prior(pos, unl, len(words))
    weights, bias = _train(pos, unl, len(words), prior)
    bias -= least_risk_cut(pos.margins(weights, bias), unl.margins(weights, bias), prior)
    return Linear(dict(zip(words, weights.tolist())), bias), prior


def score_rows(docs: DataFrame, model: Linear) -> DataFrame:
    """doc_id and score of every row. Shuffles nothing."""
    bounded_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_of(batch, "text")
            for lo, hi in slices(texts):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(model.score(texts[lo:hi]))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        score, "doc_id long, score double")


def toxic_filter(docs: DataFrame, labels: DataFrame, learn: Column | None = None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``least``."""
    model, _ = fit(docs, labels, ~held_out(5) if learn is None else learn)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_of(batch, "text")
            for lo, hi in slices(texts):
                yield batch.slice(lo, hi - lo).filter(pa.array(model.score(texts[lo:hi]) < least))

    return docs.mapInArrow(keep, docs.schema)
