"""Best-fit packing after a Martello-Toth dominance reduction, on the histogram of lengths.

Documents become pieces of at most ``size`` tokens (a document's first piece may be shorter than the others). Which
documents have a length does not matter to a packing, so the plan is made for counts of lengths: the driver holds ``size``
counts, however large the corpus. The plan is a list of runs, "the pieces of length L with ranks from .. on go to the
sequences from .. on, at this offset"; pieces get their rank within their length on the cluster and look up their run.

Reduction (Martello and Toth 1990): a set of pieces that dominates every other set with the same longest piece is fixed
for good: a full piece or one that nothing fits beside; two lengths that fill a sequence exactly; a piece with the longest
one that fits beside it, where no two others fit or where their best sum is not longer. Fixing repeats on what is left
until nothing changes. The remainder is packed best-fit, longest first.

Null and empty texts have one piece, their end id. Repeated rows are packed as often as they occur. An empty table gives an
empty result. Columns other than ``doc_id`` and ``text`` are neither read nor changed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.text import bounded_batches, bytes_of, id_key
from tidemark.llm.tokens import codec
from tidemark.session import cut_lineage

SIZE = 2048
PART_PIECES = 20_000
MOST_BASES = 1_000_000
END = b"\x00\x00\x00\x00"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_bounds(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    head = n % size
    starts = ([(0, head)] if head else []) + [(s, size) for s in range(head, n, size)]
    return starts


def token_pieces(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), bytes_of(batch, "text")):
                ids = bpe.encode_text(text.decode("utf-8", "replace")) + END
                out.extend((doc, k, s, n, zlib.crc32(ids[4 * s:4 * (s + n)]))
                           for k, (s, n) in enumerate(piece_bounds(len(ids) // 4, size)))
            if out:
                doc, k, s, n, crc = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (s, n, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


class Plan:
    """Runs of a packing: length, first rank, count, first sequence, offset."""

    def __init__(self, size: int):
        self.size, self.runs, self.sequences, self._next = size, [], 0, np.zeros(size + 1, np.int64)

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, int(self._next[length]), int(count), int(sequence), int(offset)))
        self._next[length] += count

    def open(self, count: int) -> int:
        first = self.sequences
        self.sequences += int(count)
        return first

    def fix(self, lengths: tuple[int, ...], count: int) -> None:
        first, at = self.open(count), 0
        for length in lengths:
            self.put(length, count, first, at)
            at += length


def _best_pair(left: np.ndarray, counts: np.ndarray, room: int) -> int:
    """Largest sum of two pieces that fit in ``room``."""
    lo, hi, best = 0, len(left) - 1, 0
    while lo <= hi:
        if lo == hi and counts[left[lo]] < 2:
            break
        total = int(left[lo] + left[hi])
        if total <= room:
            best = max(best, total)
            lo += 1
        else:
            hi -= 1
    return best


def reduce_dominated(counts: np.ndarray, plan: Plan) -> None:
    """Fix dominating sets and take them out of ``counts``."""
    size = plan.size
    changed = True
    while changed:
        changed = False
        for length in range(size, 0, -1):
            while counts[length]:
                room = twin = size - length
                others = counts[:room + 1].copy()
                if length <= room:
                    others[length] -= 1
                fits = np.flatnonzero(others)
                if not fits.size:
                    plan.fix((length,), counts[length])
                    counts[length] = 0
                    changed = True
                    continue
                if others[twin]:
                    many = counts[length] // 2 if twin == length else min(counts[length], counts[twin])
                    plan.fix((length, twin), many)
                    counts[length] -= many
                    counts[twin] -= many
                    changed = True
                    continue
                mate = int(fits[-1])
                small, second, third = [*np.repeat(fits[:3], np.minimum(others[fits[:3]], 3)), size, size][:3]
                lone = small + second > room
                if not lone and (small + second + third <= room or _best_pair(fits, others, room) > mate):
                    break
                many = 1 if mate == length or not lone else min(counts[length], counts[mate])
                plan.fix((length, mate), many)
                counts[length] -= many
                counts[mate] -= many
                changed = True


def best_fit(counts: np.ndarray, plan: Plan) -> None:
    """Pack ``counts`` longest first, each piece into the open sequence it leaves the least room in."""
    size, groups = plan.size, {}
    room_of = np.zeros(size + 1, bool)

    def give(room: int, first: int, count: int) -> None:
        if room and count:
            groups.setdefault(room, []).append((first, count))
            room_of[room] = True

    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            fitting = np.flatnonzero(room_of[length:])
            if fitting.size:
                room = length + int(fitting[0])
                first, count = groups[room].pop()
                if not groups[room]:
                    room_of[room] = False
                take = min(left, count)
                plan.put(length, take, first, size - room)
                give(room - length, first, take)
                give(room, first + take, count - take)
                left -= take
                continue
            each = size // length
            full, rest = divmod(left, each)
            for many, bins in ((each, full), (rest, 1 if rest else 0)):
                if bins:
                    first = plan.open(bins)
                    for k in range(many):
                        plan.put(length, bins, first, k * length)
                    give(size - many * length, first, bins)
            left = 0
        counts[length] = 0


def make_plan(counts: np.ndarray, size: int = SIZE) -> Plan:
    """``counts[L]``: pieces of length L, for L up to ``size``."""
    plan, left = Plan(size), counts.astype(np.int64).copy()
    reduce_dominated(left, plan)
    best_fit(left, plan)
    return plan


def _ranked(pieces: DataFrame, counts: np.ndarray) -> DataFrame:
    """Pieces with ``rank`` from 0 within their length; a length is ranked in parts of about ``PART_PIECES`` pieces.

    ``counts``: pieces of each length.
    """
    parts = F.split(F.lit(",".join(str(c // PART_PIECES + 1) for c in counts.tolist())), ",").cast("array<int>")
    keyed = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(parts, F.col("length").cast("int"))))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = keyed.groupBy("length", "part").count().select(
        "length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "part").orderBy(id_key(), "piece", "ids_crc32")
    # base has at most one row for each length and each PART_PIECES pieces
    placed = keyed.withColumn("place", F.row_number().over(inside) - 1)
    small = counts.sum() // PART_PIECES + len(counts) <= MOST_BASES
    return placed.join(F.broadcast(base) if small else base, ["length", "part"]).withColumn(
        "rank", F.col("place") + F.col("base")).drop("part", "place", "base")


def pack_pieces(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Every piece with sequence_id and offset. ``pieces`` is read three times."""
    counts = np.zeros(size + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``size`` rows
        counts[row["length"]] = row["count"]
    plan = make_plan(counts, size)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    starts = (runs[:, 0] << 48) + runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            run = runs[np.searchsorted(starts, (length << 48) + rank, "right") - 1]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return _ranked(pieces, counts).mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The pieces (a few numbers for each) are written once to the shared folder, so that no text is encoded twice.
    """
    return pack_pieces(cut_lineage(token_pieces(docs, size, vocabulary)), size)
