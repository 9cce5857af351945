"""Best-fit-decreasing packing of token ids into id matrices.

Each task packs the documents it reads, in pools of about ``pool`` tokens, so nothing is shuffled and a task holds one pool
at a time. Within a pool pieces go longest first into the open sequence with the least sufficient room, which a segment
tree over the possible rooms finds. Longer documents are cut without loss. A pool leaves at most one poorly filled sequence.

One row per sequence: ``ids`` (little-endian, ``size`` ids, padded with the end id), ``positions`` (little-endian, 16 bits up to a
``size`` of 65,536 and 32 beyond, starting from 0 at each segment, also at the padding), ``cu_seqlens`` (0 and the ends of the segments), and for each segment
its document, the place of its first id in the document, and its length. Null and empty texts are one end id. Repeated rows are packed as
often as they occur. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import bounded_batches, bytes_of
from tidemark.llm.tokens import codec

SIZE = 2048
POOL_TOKENS = 4_000_000
SEQUENCES = ("sequence_id long, n_tokens long, ids binary, positions binary, cu_seqlens array<int>, "
             "doc_ids array<long>, starts array<long>, lengths array<int>")


class RoomTree:
    """Open sequences by room, 0 to ``size``: a segment tree of counts, searched for the least room that suffices."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def push(self, room: int, sequence: int) -> None:
        self.open.setdefault(room, []).append(sequence)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, sequence) with the least room of at least ``least``, removed from the tree."""
        node, count = least + self.leaves, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, int]:
    """Sequence number of each piece, and the number of sequences."""
    tree, where, n = RoomTree(size), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = tree.take(length)
        if found is None:
            found, n = (size, n), n + 1
        where[i] = found[1]
        tree.push(found[0] - length, found[1])
    return where, n


def cut_bounds(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length): full pieces first, the rest last."""
    return [(s, min(size, n - s)) for s in range(0, n, size)]


def _pool_rows(docs: list, ids: list[np.ndarray], size: int, first: int) -> tuple[pa.RecordBatch, int]:
    pieces = [(d, x, s, n) for d, x in zip(docs, ids) for s, n in cut_bounds(len(x), size)]
    where, count = best_fit_decreasing(np.array([p[3] for p in pieces], np.int64), size)
    rows: list[list] = [[] for _ in range(count)]
    for piece, sequence in zip(pieces, where.tolist()):
        rows[sequence].append(piece)
    kind = ids[0].dtype if ids else np.dtype("<u2")
    ramp = np.arange(size, dtype="<u2" if size <= 1 << 16 else "<u4")
    matrix, places = np.zeros((count, size), kind), np.zeros((count, size), ramp.dtype)
    ends = []
    for r, row in enumerate(rows):
        at, marks = 0, [0]
        for _, x, s, n in row:
            matrix[r, at:at + n] = x[s:s + n]
            places[r, at:at + n] = ramp[:n]
            at += n
            marks.append(at)
        places[r, at:] = ramp[:size - at]
        ends.append(marks)
    batch = pa.RecordBatch.from_arrays([
        pa.array(np.arange(first, first + count)), pa.array([m[-1] for m in ends], pa.int64()),
        pa.array([r.tobytes() for r in matrix], pa.binary()), pa.array([r.tobytes() for r in places], pa.binary()),
        pa.array(ends, pa.list_(pa.int32())), pa.array([[p[0] for p in r] for r in rows], pa.list_(pa.int64())),
        pa.array([[p[2] for p in r] for r in rows], pa.list_(pa.int64())),
        pa.array([[p[3] for p in r] for r in rows], pa.list_(pa.int32()))],
        ["sequence_id", "n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "starts", "lengths"])
    return batch, count


def pack_matrices(docs: DataFrame, size: int = SIZE, pool: int = POOL_TOKENS, vocabulary: str | None = None,
                  wide: bool = False) -> DataFrame:
    """Packed sequences of all documents; ids have 16 bits, or 32 where the vocabulary has greater ids or ``wide`` asks so."""
    bounded_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, number = codec(vocabulary), TaskContext.get().partitionId() << 33
        held, ids, tokens = [], [], 0
        kind = np.dtype("<u4" if wide or bpe.most_id >= 1 << 16 else "<u2")
        end = np.zeros(1, kind)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), bytes_of(batch, "text")):
                x = np.concatenate([np.frombuffer(bpe.encode_text(text.decode("utf-8", "replace")), "<u4").astype(kind), end])
                held.append(doc)
                ids.append(x)
                tokens += len(x)
                if tokens >= pool:
                    rows, count = _pool_rows(held, ids, size, number)
                    number += count
                    for lo in range(0, rows.num_rows, 500):
                        yield rows.slice(lo, 500)
                    held, ids, tokens = [], [], 0
        if held:
            yield _pool_rows(held, ids, size, number)[0]

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, SEQUENCES)
