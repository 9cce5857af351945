"""SentencePiece encoding and decoding by streaming Viterbi search.

Blanks become the marker U+2581, one more is put in front (as the vocabulary's own normaliser does), and the best-scoring
sequence of pieces is searched left to right. Only a window as long as the longest piece is held: at each place the best
way to get there is known, and as soon as the backpointer paths of all places in the window run through one boundary, the
ids up to it are final and leave the window. A marker that follows another character is such a boundary by itself, because
no piece of the vocabulary has a marker inside; spans between these boundaries are searched once and remembered.

Characters without a piece become byte pieces. Markers and the vocabulary's control strings that stand in a text are
encoded as bytes, so decoding restores every text exactly. Scores are those of the vocabulary file, those of byte pieces
``BYTE_PENALTY`` below its least; ties go to the longer last piece.

Null and empty texts have no ids and decode to the empty text. Repeated rows get equal ids. An empty table gives an empty
result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import bounded_batches, bytes_of

MARK = "▁"
MEMO_SPANS = 400_000  # in each of two generations
BYTE_PENALTY = 10.0
LEAST_SCORE = -1e8
_SPAN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary: pieces by text, their scores, byte pieces."""

    def __init__(self, path: str | None = None):
        model = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
        self.text = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_ids = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.score: dict[str, tuple[float, int]] = {}
        for i, piece in enumerate(self.text):
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.byte_of[i] = i, value
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                # pieces the file rules out by an enormous penalty (runs of markers) count as the least of the others
                self.score[piece] = (model.get_score(i), i)
        usual = [s for s, _ in self.score.values() if s > LEAST_SCORE]
        floor = min(usual, default=0.0)
        self.score = {p: (max(s, floor), i) for p, (s, i) in self.score.items()}
        self.byte_score = floor - BYTE_PENALTY
        self.longest = max(map(len, self.score), default=1)
        self.spans_stand_alone = not any(MARK in p.lstrip(MARK) for p in self.score)
        # every beginning of a piece, with the score and id of those that are pieces themselves
        self.steps = {p[:k]: self.score.get(p[:k]) for p in self.score for k in range(1, len(p) + 1)}
        self.feed_stands_alone = not any("\n" in p for p in self.score)


def stream_ids(chars: Iterable[str], pieces: Pieces) -> Iterator[int]:
    """Ids of the best segmentation of a stream of characters, each as soon as no later character can change it.

    A character may be a one-character string or an escaped one of two, NUL and the character, which only bytes express.
    """
    best: list[float] = [0.0]           # score of the best way to each place of the window
    back: list[tuple[int, tuple]] = [(0, ())]  # how many places back it came from, and the ids of that step
    held: list[str] = []                # characters of the window
    longest, score, byte_score = pieces.longest, pieces.score, pieces.byte_score
    for char in chars:
        held.append(char)
        n = len(held)
        raw = char[-1].encode("utf-8", "surrogatepass")
        top, way = best[n - 1] + byte_score * len(raw), (1, tuple(pieces.byte_ids[b] for b in raw))
        if len(char) == 1:
            tail = ""
            for length in range(1, min(longest, n) + 1):
                one = held[n - length]
                if len(one) > 1:
                    break
                tail = one + tail
                found = score.get(tail)
                if found is not None and best[n - length] + found[0] >= top:
                    top, way = best[n - length] + found[0], (length, (found[1],))
        best.append(top)
        back.append(way)
        # the oldest place that a later step can still start from
        reach = max(0, n + 1 - longest)
        if n >= 2 * longest:
            meet = _meeting(back, reach, n)
            if meet:
                yield from _trace(back, meet)
                base = best[meet]
                best = [b - base for b in best[meet:]]
                back = [(0, ()), *back[meet + 1:]]
                held = held[meet:]
    yield from _trace(back, len(held))


def _meeting(back: list, reach: int, n: int) -> int:
    """The last boundary on the paths of all places from ``reach`` to ``n``; 0 if they only share the start."""
    places = set(range(reach, n + 1))
    while len(places) > 1:
        last = max(places)
        places.remove(last)
        places.add(last - back[last][0])
    return places.pop()


def _trace(back: list, place: int) -> list[int]:
    parts = []
    while place:
        step, ids = back[place]
        parts.append(ids)
        place -= step
    return [i for ids in reversed(parts) for i in ids]


def _search(span: str, pieces: Pieces) -> list[int]:
    """Ids of a span between two sure boundaries: the same search as ``stream_ids`` on a span shorter than its window."""
    n = len(span)
    best, back = [0.0] + [-1e300] * n, [None] * (n + 1)
    step = pieces.steps.get
    for start in range(n):
        base, stop = best[start], start + 1
        found = step(span[start], False)
        if found:
            value = base + found[0]
            if value > best[stop]:
                best[stop], back[stop] = value, (start, found[1])
        else:
            # bytes score less than any piece, so they only serve characters without one
            value = base + pieces.byte_score * len(span[start].encode("utf-8", "surrogatepass"))
            if value > best[stop]:
                best[stop], back[stop] = value, (start, None)
            if found is False:
                continue
        for end in range(start + 2, n + 1):
            found = step(span[start:end], False)
            if found:
                value = base + found[0]
                if value > best[end]:
                    best[end], back[end] = value, (start, found[1])
            elif found is False:
                break
    parts, place = [], n
    while place:
        start, ident = back[place]
        parts.append((ident,) if ident is not None else tuple(
            pieces.byte_ids[b] for b in span[start].encode("utf-8", "surrogatepass")))
        place = start
    return [i for ids in reversed(parts) for i in ids]


class Codec:
    """Encodes and decodes texts with one vocabulary and a bounded memory of spans."""

    def __init__(self, path: str | None = None):
        self.pieces = Pieces(path)
        self._kind = "H" if len(self.pieces.text) <= 1 << 16 else "I"
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._piece_bytes = [t.replace(MARK, " ").encode("utf-8", "surrogatepass") for t in self.pieces.text]
        for ident, value in self.pieces.byte_of.items():
            self._piece_bytes[ident] = bytes([value])
        self._feed = self._packed([self.pieces.byte_ids[10]])

    def _packed(self, ids: list[int]) -> bytes:
        out = array(self._kind, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _span(self, span: str) -> bytes:
        if "\n" in span and self.pieces.feed_stands_alone:
            return self._feed.join([self._memo.get(p) or self._span(p) for p in span.split("\n")])
        found = self._older.get(span)
        if found is None:
            found = self._packed(_search(span, self.pieces) if len(span) <= 2 * self.pieces.longest
                                 else list(stream_ids(span, self.pieces)))
        if len(span) <= 64:
            if len(self._memo) >= MEMO_SPANS:  # spans not met again in the last round are forgotten
                self._memo, self._older = {}, self._memo
            self._memo[span] = found
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian ids, 16-bit for vocabularies of up to 65,536 pieces."""
        if not text:
            return b""
        if MARK in text or not self.pieces.spans_stand_alone:
            chars = (MARK if c == " " else "\0" + c if c == MARK else c for c in " " + text)
            return self._packed(list(stream_ids(chars, self.pieces)))
        get, span = self._memo.get, self._span  # a memory laid aside during this text still gives right ids
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return b"".join([get(w) or span(w) for w in (MARK + x for x in text.split(" "))])
        return b"".join([get(w) or span(w) for w in _SPAN.findall((" " + text).replace(" ", MARK))])

    def decode(self, ids: bytes) -> str:
        if not ids:
            return ""
        table = self._piece_bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u2" if self._kind == "H" else "<u4").tolist()]).decode(
            "utf-8", "surrogatepass")[1:]


_CODECS: dict[str, Codec] = {}


def codec(path: str | None = None) -> Codec:
    """One codec for each vocabulary and Python worker."""
    if (path or "") not in _CODECS:
        _CODECS[path or ""] = Codec(path)
    return _CODECS[path or ""]


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian binary) and n_ids of every row. Nothing is shuffled."""
    bounded_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(vocabulary)
        width = 2 if len(pieces.pieces.text) <= 1 << 16 else 4
        for batch in batches:
            ids = [pieces.encode(t.decode("utf-8", "replace")) for t in bytes_of(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(i) // width for i in ids], pa.int64())],
                ["doc_id", "ids", "n_ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        encode, "doc_id long, ids binary, n_ids long")


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of every row of ``encoded`` (doc_id, ids)."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(vocabulary)
        for batch in batches:
            texts = [pieces.decode(i or b"") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids, n_ids, and whether the ids decode to the text, for every row."""
    bounded_batches(docs.sparkSession)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(vocabulary)
        width = 2 if len(pieces.pieces.text) <= 1 << 16 else 4
        for batch in batches:
            texts = [t.decode("utf-8", "replace") for t in bytes_of(batch, "text")]
            ids = [pieces.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(i) // width for i in ids], pa.int64()),
                 pa.array([pieces.decode(i) == t for i, t in zip(ids, texts)])], ["doc_id", "ids", "n_ids", "restored"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        both, "doc_id long, ids binary, n_ids long, restored boolean")
