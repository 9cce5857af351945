"""Whitening of embeddings by their leading principal components.

An entry c counts as the integer ``floor(SCALE * c) + SHIFT``, so sums are exact. Three passes fit the model: sums and the
number of vectors; the covariance of the centred vectors, added up by row of the matrix; and the covariance of the
whitened vectors, which shows how far it is from the identity. The eigenproblem is solved once, on the driver, in memory
for a few matrices of dimension x dimension doubles; the projection (dimension x components doubles) is broadcast.

Rows whose vector is null or holds a null or non-finite entry are dropped. All vectors must have one length: it is the
most frequent one (of ties the greatest), and rows of any other length, empty ones included, are dropped as well, as their
missing or surplus entries have no counterpart. Entries are clamped to +-2^43, beyond which 1024 c is no exact long.
Repeated rows count as often as they occur; a null id stays null. Components whose eigenvalue is not above ``RANK`` times
the greatest have no scale and are left out, so equal vectors, a single vector and an empty table give no rows. Other
columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.eigen import leading_pairs

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
REACH = 2.0**43
RANK = 1e-11
_LOW_BITS = 26
_DIGITS = 10**38


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with exact ``sums``; eigenvalues and, as columns, unit eigenvectors of their covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        """The whole part of the mean."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """n times the fraction of the mean: 0 to n - 1."""
        return np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre).astype(float) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum of (n x - sum)^2 over the dimensions, of each row, exactly."""
        y, rest, n = x - self.centre, self.rest, self.n
        most, d = int(np.abs(y).max(initial=0)), max(1, x.shape[1])
        if most * max(most, n) * d >= 1 << 62:  # beyond 64-bit sums
            y, rest = y.astype(object), rest.astype(object)
        squares, mixed = (y * y).sum(axis=1).tolist(), (y @ rest).tolist()
        fixed = sum(r * r for r in rest.tolist())
        return [n * n * s - 2 * n * m + fixed for s, m in zip(squares, mixed)]


def _rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and whole-number vectors, for each length among the finite vectors of a batch."""
    entries = column.values.cast(pa.float64())
    ends = column.offsets.to_numpy()
    finite = np.isfinite(entries.to_numpy(zero_copy_only=False))  # a null entry reads as not a number
    bad = np.concatenate([[0], np.cumsum(~finite)])
    length = np.diff(ends)
    good = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends[1:]] == bad[ends[:-1]]) & (length > 0)
    entries = entries.to_numpy(zero_copy_only=False)
    for size in np.unique(length[good]):
        at = np.flatnonzero(good & (length == size))
        c = entries[ends[:-1][at][:, None] + np.arange(size)]
        yield at, np.floor(SCALE * np.clip(c, -REACH, REACH)).astype(np.int64) + SHIFT


def _vectors(df: DataFrame, vector: str, *others) -> DataFrame:
    return df.select(*others, F.col(vector).cast("array<double>").alias("v"))


def _sums(df: DataFrame, vector: str) -> tuple[int, tuple[int, ...]]:
    """Number of vectors of the most frequent length, and their exact sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for at, x in _rows(batch.column(0)):
                old = held.setdefault(x.shape[1], [0, 0, 0])
                old[0] += len(at)
                old[1] += (x >> _LOW_BITS).sum(axis=0)
                old[2] += (x & ((1 << _LOW_BITS) - 1)).sum(axis=0)
        for size, (n, high, low) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, size, np.int64)), pa.array(np.arange(size)), pa.array(np.full(size, n, np.int64)),
                 pa.array(high), pa.array(low)], ["size", "place", "n", "high", "low"])

    parts = _vectors(df, vector).mapInArrow(add, "size long, place long, n long, high long, low long")
    places = parts.groupBy("size", "place").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")])
    whole = places.groupBy("size").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "high", "low"))).alias("sums"))
    best = whole.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not best:
        return 0, ()
    return best[0].n, tuple((s.high << _LOW_BITS) + s.low for s in best[0].sums)


def _covariance(df: DataFrame, vector: str, model: Whitening) -> np.ndarray:
    """Covariance, divisor n, of the centred vectors; each task sums its rows, then each row of the matrix is summed."""
    d = len(model.sums)

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for _, x in _rows(batch.column(0)):
                if x.shape[1] == d:
                    y = model.centred(x)
                    total += y.T @ y
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d)), pa.array([row.tobytes() for row in total], pa.binary())], ["place", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[place] = held.get(place, 0) + np.frombuffer(row)
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held)), pa.array([row.tobytes() for row in held.values()], pa.binary())], ["place", "row"])

    schema = "place long, row binary"
    out = np.zeros((d, d))
    for row in _vectors(df, vector).mapInArrow(square, schema).repartition("place").mapInArrow(add, schema).collect():
        out[row.place] = np.frombuffer(row.row)
    return (out + out.T) / 2 / model.n


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Mean, covariance and leading components of the vectors; none where there is nothing to whiten."""
    n, sums = _sums(df, vector)
    d = len(sums)
    if not n:
        return Whitening(0, (), np.zeros(0), np.zeros((0, 0)), 0.0)
    mean = Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    covariance = _covariance(df, vector, mean)
    values, vectors = leading_pairs(covariance, components)
    some = (values > 0) & (values > RANK * values.max(initial=0))
    return Whitening(n, sums, values[some], vectors[:, some], float(np.trace(covariance)))


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The greatest entry, by size, of the whitened vectors' covariance minus the identity, measured over all vectors."""
    d, k = len(model.sums), len(model.values)
    if not k:
        return 0.0

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))  # products, then sums
        for batch in batches:
            for _, x in _rows(batch.column(0)):
                if x.shape[1] == d:
                    w = model.whitened(x)
                    total += np.column_stack([w.T @ w, w.sum(axis=0)])
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])

    cells = _vectors(df, vector).mapInArrow(square, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((k, k + 1))
    for cell in cells.collect():
        total[cell.i, cell.j] = cell.v
    mean = total[:, -1] / model.n
    return float(np.abs(total[:, :-1] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def project(df: DataFrame, model: Whitening, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each vector and component: id, component (from 1), deviation and the whitened value."""
    carried = df.sparkSession.sparkContext.broadcast(model)  # dimension x components doubles

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = carried.value
        d, k = len(model.sums), len(model.values)
        for batch in batches:
            for at, x in _rows(batch.column(1)):
                if x.shape[1] == d and k:
                    sizes = [Decimal(v) if v < _DIGITS else None for v in model.deviations(x)]
                    each = np.repeat(np.arange(len(at)), k)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at)).take(pa.array(each)),
                         pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                         pa.array(sizes, pa.decimal128(38, 0)).take(pa.array(each)),
                         pa.array(model.whitened(x).ravel())], ["id", "component", "deviation", "whitened"])

    rows = _vectors(df, vector, F.col(id_column).cast("long").alias("id"))
    return rows.mapInArrow(compute, "id long, component int, deviation decimal(38,0), whitened double").withColumnRenamed(
        "id", id_column)


def whiten_report(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding",
                  components: int = COMPONENTS) -> DataFrame:
    """Whitened values with the model's share of variance and its error.

    ``deviation`` is a long, null where it has more digits; ``deviation_exact`` holds up to 38 digits.
    """
    model = fit(df, vector, components)
    shares = [float(v / model.trace) for v in model.values]
    explained = F.array(*[F.lit(s) for s in shares]) if shares else F.array(F.lit(0.0))
    return project(df, model, id_column, vector).select(
        id_column, "component", F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened",
        F.element_at(explained, F.col("component")).alias("explained"),
        F.lit(identity_error(df, model, vector)).alias("identity_error"), F.col("deviation").alias("deviation_exact"))
