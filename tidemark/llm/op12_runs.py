"""Periodic runs of words: online catching of squares by completed power-of-two blocks.

A run is a stretch of words with smallest period q that no neighbouring word extends and that is at least
``max(least, exponent * q)`` words long. Words arrive in order. Every completed block of 2^k words gets a catcher, which
watches the words appended at the distances its level is answerable for; when the block occurs again at distance q, the
catcher compares backwards from the block and forwards with the appended words. The squares it finds at one distance
merge into one stretch, which grows while the appended words go on equal to those q places before. A run of period q has so
many words equal to those q places later that one whole aligned block of its level lies in them, so none is missed.

Blocks are compared by prefix hashes and every reported run word by word; where a hash was wrong, all stretches of that
distance are taken from the words. Texts of a slice arrive as one stream with a separator of its own after each, so no run
crosses texts. A task holds one slice of texts, a longer text alone, as one number for each word.

Null and empty texts have no words and no runs. Repeated rows and equal ids get equal results row by row; a null id stays
null, and its text is not edited. An empty table gives an empty result. Columns other than ``doc_id`` and ``text`` are
neither read nor changed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import bounded_batches, bytes_of, mix, pieces, slices

LEAST, EXPONENT = 24, 3
PIECE_WORDS = 1 << 18
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)
SCHEMA = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def _numbered(texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
    """A number for each word of each text, and the words by number."""
    number = defaultdict(count().__next__)
    arrays = [np.concatenate([np.zeros(0, np.int64), *(
        np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in map(bytes.split, pieces(text)))]) for text in texts]
    return arrays, list(number)


class Catcher:
    """The stretches of a stream of words that repeat at some distance, kept up to date with every append.

    ``longest`` bounds the length of a run (a number of words without a separator); it spares levels nothing can reach.
    """

    def __init__(self, least: int = LEAST, exponent: int = EXPONENT, longest: int | None = None):
        if exponent < 2 or least < 1:
            raise ValueError("a run holds two periods at least and one word at least")
        self.least, self.exponent = least, exponent
        self.ids = np.zeros(0, np.int64)
        self._hash, self._up, self._down = np.zeros(1, np.uint64), np.ones(1, np.uint64), np.ones(1, np.uint64)
        self._done: dict[int, int] = {}
        self._blocks: dict[int, np.ndarray] = {}
        # columns: distance, first place that equals the one a distance later, end of such places
        self.stretches = np.zeros((0, 3), np.int64)
        self.longest = longest

    def levels(self, words: int) -> list[tuple[int, int, int]]:
        """Exponent of the block size, least and greatest distance, of each level that ``words`` words can reach."""
        most = max(1, words // self.exponent)
        surely = min(max(self.least - q, (self.exponent - 1) * q) for q in range(1, self.least + 1))
        k, low, out = ((surely + 1) // 2).bit_length() - 1, 1, []
        while low <= most:
            above = -(-((4 << k) - 1) // (self.exponent - 1))
            if above > low:
                out.append((k, low, above - 1))
                low = above
            k += 1
        return out

    def _same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Whether the words from ``a`` and from ``b``, a later place, hash alike over ``length``."""
        h = self._hash
        return (h[a + length] - h[a]) * self._up[b - a] == h[b + length] - h[b]

    def _forward(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The first place from ``at`` on that differs from the one ``q`` places later (or has none)."""
        at, limit = at.copy(), len(self.ids) - q
        for k in range(int(limit.max(initial=1)).bit_length(), -1, -1):
            ok = np.flatnonzero(at + (1 << k) <= limit)
            ok = ok[self._same(at[ok], at[ok] + q[ok], 1 << k)]
            at[ok] += 1 << k
        return at

    def _backward(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The first place of the equal ones that end before ``at``."""
        at = at.copy()
        for k in range(int(at.max(initial=1)).bit_length(), -1, -1):
            ok = np.flatnonzero(at >= 1 << k)
            start = at[ok] - (1 << k)
            good = self._same(start, start + q[ok], 1 << k)
            at[ok[good]] = start[good]
        return at

    def append(self, ids: np.ndarray) -> None:
        """Take the next words (one number for each distinct word)."""
        if not len(ids):
            return
        before, n = len(self.ids), len(self.ids) + len(ids)
        self.ids = np.concatenate([self.ids, np.asarray(ids, np.int64)])
        grow = lambda powers, base: np.concatenate([powers, powers[-1] * np.multiply.accumulate(
            np.full(len(ids), base, np.uint64))])
        self._up, self._down = grow(self._up, _BASE), grow(self._down, _BACK)
        weighed = mix(self.ids[before:].astype(np.uint64) + np.uint64(1)) * self._up[before:n]
        self._hash = np.concatenate([self._hash, self._hash[-1] + np.cumsum(weighed, dtype=np.uint64)])
        open_ = self.stretches[:, 2] + self.stretches[:, 0] == before
        going = self.stretches[open_]
        going[:, 2] = self._forward(going[:, 2], going[:, 0])
        found = [self.stretches[~open_], going]
        for k, low, high in self.levels(min(n, self.longest or n)):
            found.append(self._caught(k, low, high, n))
        self.stretches = self._merged(np.concatenate(found), n)

    def _caught(self, k: int, low: int, high: int, n: int) -> np.ndarray:
        """Stretches around the blocks of one level that occur again at places completed by this append."""
        size, first = 1 << k, self._done.get(k, 0)
        last = n - size + 1
        if last <= first:
            return np.zeros((0, 3), np.int64)
        value = (self._hash[first + size:last + size] - self._hash[first:last]) * self._down[first:last]
        self._done[k] = last
        blocks = self._blocks[k] = np.concatenate([self._blocks.get(k, value[:0]), value[-first % size::size]])
        hits = []
        for near in range(low, high + 1, size):  # each place meets one block start in every stretch of ``size`` distances
            place = max(first, near)
            if place >= last:
                break
            behind = place - near
            block = np.repeat(blocks[behind >> k:((last - 1 - near) >> k) + 1], size)[behind % size:][:last - place]
            hit = np.flatnonzero(value[place - first:] == block) + place
            start = (hit - near) >> k << k
            hits.append(np.stack([hit - start, start], axis=1)[hit - start <= high])
        hits = np.concatenate(hits) if hits else np.zeros((0, 2), np.int64)
        if not len(hits):
            return np.zeros((0, 3), np.int64)
        hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
        follows = np.zeros(len(hits), bool)  # the block before occurs at the same distance: the same stretch
        follows[1:] = (hits[1:, 0] == hits[:-1, 0]) & (hits[1:, 1] == hits[:-1, 1] + size)
        q, start = hits[~follows].T
        return np.stack([q, self._backward(start, q), self._forward(start + size, q)], axis=1)

    def _merged(self, found: np.ndarray, n: int) -> np.ndarray:
        """One row for each stretch, without closed ones that are too short for a run."""
        found = found[(found[:, 2] + found[:, 0] == n) | self._long(found)]
        found = found[np.lexsort((-found[:, 2], found[:, 1], found[:, 0]))]
        again = np.zeros(len(found), bool)
        again[1:] = (found[1:, :2] == found[:-1, :2]).all(axis=1)
        return found[~again]

    def _long(self, stretches: np.ndarray) -> np.ndarray:
        q, start, end = stretches.T
        return end + q - start >= np.maximum(self.least, self.exponent * q)

    def _exact(self, q: int) -> np.ndarray:
        """All stretches of one distance, from the words themselves."""
        equal = np.concatenate([[False], self.ids[:-q] == self.ids[q:], [False]]).astype(np.int8)
        edge = np.flatnonzero(np.diff(equal))
        return np.stack([np.full(len(edge) // 2, q, np.int64), edge[::2], edge[1::2]], axis=1)

    def runs(self) -> np.ndarray:
        """Rows of start, length, period by start, then period, of the words appended so far."""
        while True:
            rows = self.stretches[self._long(self.stretches)]
            ends = rows[:, 2] + rows[:, 0]
            rows = rows[np.lexsort((rows[:, 0], ends, rows[:, 1]))]
            ends = rows[:, 2] + rows[:, 0]
            multiple = np.zeros(len(rows), bool)  # the same words with a multiple of their period
            multiple[1:] = (rows[1:, 1] == rows[:-1, 1]) & (ends[1:] == ends[:-1])
            rows = rows[~multiple]
            wrong = [q for q, start, end in rows.tolist()
                     if not np.array_equal(self.ids[start:end], self.ids[start + q:end + q])]
            if not wrong:
                out = np.stack([rows[:, 1], rows[:, 2] + rows[:, 0] - rows[:, 1], rows[:, 0]], axis=1)
                return out[np.lexsort((out[:, 2], out[:, 0]))]
            for q in set(wrong):
                self.stretches = np.concatenate([self.stretches[self.stretches[:, 0] != q], self._exact(q)])


def runs_of(numbers: list[np.ndarray], least: int = LEAST, exponent: int = EXPONENT) -> list[np.ndarray]:
    """The runs of each text, given as one array of word numbers (0 or more) for each."""
    out = [np.zeros((0, 3), np.int64)] * len(numbers)
    classes = defaultdict(list)
    for i, ids in enumerate(numbers):
        if len(ids) >= least:
            classes[len(ids).bit_length()].append(i)
    for members in classes.values():  # texts of like length share a stream, so that short ones meet few levels
        catcher = Catcher(least, exponent, max(len(numbers[i]) for i in members))
        catcher.append(np.concatenate([part for i in members for part in (numbers[i], [-2 - i])]))
        found = catcher.runs()
        begin = np.cumsum([0, *(len(numbers[i]) + 1 for i in members)])
        cuts = np.searchsorted(found[:, 0], begin)
        for m, i in enumerate(members):
            own = found[cuts[m]:cuts[m + 1]]
            out[i] = own - [begin[m], 0, 0]
    return out


def best_run(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties go to the smallest start, then period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """True for words that no run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(step[:-1]) == 0


def looped_tail(doc_id: int | None, ids: np.ndarray) -> np.ndarray:
    """The words of one text in ten with a tail that repeats: word i >= a becomes word a + (i - a) % p."""
    if doc_id is None or not len(ids):
        return ids
    h, n = zlib.crc32(str(doc_id).encode()), len(ids)
    if h % 10:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([ids[:a], ids[a + np.arange(n - a) % p]])


def _report(doc_ids: list[int | None], texts: list[bytes], edit: Callable | None, least: int, exponent: int) -> list[tuple]:
    numbers, words = _numbered(texts)
    if edit:
        numbers = [edit(doc, ids) for doc, ids in zip(doc_ids, numbers)]
    rows = []
    for doc, ids, runs in zip(doc_ids, numbers, runs_of(numbers, least, exponent)):
        best = best_run(runs)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
        kept = ids[kept_words(len(ids), runs)] if len(runs) else ids
        digest = hashlib.sha256()
        for at in range(0, len(kept), PIECE_WORDS):
            digest.update(b" " * (at > 0) + b" ".join(map(words.__getitem__, kept[at:at + PIECE_WORDS].tolist())))
        place = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        rows.append((doc, len(ids), len(runs), *place, hashlib.sha256(listed.encode()).hexdigest(), digest.hexdigest()))
    return rows


def run_report(docs: DataFrame, edit: Callable[[int | None, np.ndarray], np.ndarray] | None = None, least: int = LEAST,
               exponent: int = EXPONENT) -> DataFrame:
    """Runs of every text and the digest of what is left without their repeats. Shuffles nothing.

    ``edit`` may rearrange the word numbers of a text before it is searched; it gets the id and the numbers.
    """
    bounded_batches(docs.sparkSession)
    fields = [f.split() for f in SCHEMA.split(", ")]
    schema = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in fields])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, doc_ids = bytes_of(batch, "text"), batch.column(0).to_pylist()
            for lo, hi in slices(texts):
                rows = _report(doc_ids[lo:hi], texts[lo:hi], edit, least, exponent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        compute, SCHEMA)


def find_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """One row for each run of each text: doc_id, start, length, period."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "period")])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, doc_ids = bytes_of(batch, "text"), batch.column(0).to_pylist()
            for lo, hi in slices(texts):
                found = runs_of(_numbered(texts[lo:hi])[0], least, exponent)
                own = pa.array([doc for doc, runs in zip(doc_ids[lo:hi], found) for _ in range(len(runs))], pa.int64())
                yield pa.RecordBatch.from_arrays([own, *(pa.array(c) for c in np.concatenate(found).T.copy())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        compute, "doc_id long, start long, length long, period long")


def collapse_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` with each text that has a run reduced to the words outside repeats, joined by one blank."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_of(batch, "text")
            for lo, hi in slices(texts):
                numbers, words = _numbered(texts[lo:hi])
                part = batch.slice(lo, hi - lo)
                values = part.column(at).to_pylist()
                for i, runs in enumerate(runs_of(numbers, least, exponent)):
                    if len(runs):
                        kept = numbers[i][kept_words(len(numbers[i]), runs)]
                        values[i] = b" ".join(map(words.__getitem__, kept.tolist())).decode()
                yield part.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))

    return docs.mapInArrow(cut, docs.schema)
