"""Removal of repeated byte strings with suffix arrays over shards of the corpus.

A byte is removed if a string of ``length`` bytes (40 to 286) that covers it also starts earlier: in a document with a smaller id, or in
the same document further left. Matches never cross documents, and strings are judged on the input.

1. *Shards.* The smallest hash among the ``GRAM``-byte strings of a window anchors it (winnowing). Equal windows have equal
   anchors, so windows are dealt out by anchor and no match is lost. Neighbouring windows with one anchor form a segment.
   Anchors that occur once cannot hide a repeat and stay where they are; only their hashes travel.
2. *Hot anchors* (common lines: more than ``HOT`` segments) are dealt out by blocks of windows and the bytes that all windows
   of a block share, which splits what follows or precedes the common line.
3. *Arrays.* Equal segments collapse to their first occurrence; an anchor left with one segment is settled by that. Each
   shard of distinct segments gets a suffix array by
   induced sorting and its permuted common prefixes; neighbouring suffixes that share ``length`` bytes form a class, and the
   first member of each class is the one that stays.
4. Documents cut out every byte of their shared windows that are not first.

Ids order the documents; a null id sorts first, and rows with equal ids by a hash of their text. Rows equal in id and text
are one document and get the same result. Null and empty texts have nothing to remove, nor have texts shorter than
``length``. An empty table gives an empty result. Other columns, whatever their names, are kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.suffixes import permuted_common_prefixes, suffix_array
from tidemark.llm.text import bounded_batches, bytes_of, id_key, mix, slices

LENGTH = 100
GRAM = 32
HOT = 2000
BLOCK = 8
SHARD_BYTES = 1_000_000
CHUNK = 1 << 22
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 24) - 1)


def anchor_runs(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text number, first window, anchor's place after it, windows, anchor."""
    data = np.frombuffer(b"".join(texts) + bytes(GRAM + 8), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    windows = np.maximum(sizes - length + 1, 0)
    total = int(windows.sum())
    if not total:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    n = len(data) - GRAM
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).copy()
    grams = np.zeros(n, np.uint64)
    for k, factor in enumerate(_FACTORS):
        grams += words[8 * k:8 * k + n] * np.uint64(factor)
    grams = mix(grams)
    least = (grams & ~_PLACE) | np.arange(n, dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:width - span], least[span - width:])
    row = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(total) + np.repeat(begins - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    place = (least[at] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    count = np.diff(np.concatenate([first, [total]]))
    start = at[first]
    return row[first], start - begins[row[first]], place[first] - start, count, grams[place[first]].view(np.int64)


def _pack(start: np.ndarray, ahead: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (start << 16) | (ahead << 8) | count


def _find_runs(length: int):
    if not GRAM + BLOCK <= length < GRAM + 255:  # windows are anchored by GRAM bytes and counted in 8 bits
        raise ValueError(f"length must be {GRAM + BLOCK} to {GRAM + 254} bytes, not {length}")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = bytes_of(batch, "text"), batch.column(0).to_numpy()
            for lo, hi in slices(texts):
                for shift in range(0, max(1, max(len(t) for t in texts[lo:hi])), CHUNK):
                    parts = [t[shift:shift + CHUNK + length - 1] for t in texts[lo:hi]]
                    row, start, ahead, count, anchor = anchor_runs(parts, length)
                    if len(row):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(anchor), pa.array(keys[lo + row]), pa.array(_pack(start + shift, ahead, count))],
                            ["anchor", "key", "at"])
    return find


def _block_rows(text: bytes, start: int, ahead: int, count: int, anchor: int, length: int):
    """(shard, first window, text) of the blocks of a hot anchor's segment."""
    place = start + ahead
    for block in range((ahead - count + 1) // BLOCK, ahead // BLOCK + 1):
        lo = max(start, place - BLOCK * block - BLOCK + 1)
        hi = min(start + count, place - BLOCK * block + 1)
        common = text[place - BLOCK * block:place - BLOCK * block + length - BLOCK + 1]
        shard = xxhash.xxh3_64_intdigest(common, (anchor + block * 0x9E3779B97F4A7C15) & (2**64 - 1))
        yield shard - (1 << 63), lo, text[lo:hi + length - 1]


def _emit_segments(length: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_of(batch, "text")
            ids, keys, anchors, marks = (batch.column(batch.schema.get_field_index(c)) for c in ("__id", "__key", "__anchors", "__marks"))
            found: dict[tuple[int, bytes], tuple[int, int, int]] = {}
            for text, doc, key, own, places in zip(texts, *(c.to_pylist() for c in (ids, keys, anchors, marks))):
                for anchor, at in zip(own or (), places or ()):
                    start, ahead, count, hot = at >> 17, (at >> 9) & 255, (at >> 1) & 255, at & 1
                    rows = (_block_rows(text, start, ahead, count, anchor, length) if hot
                            else ((anchor, start, text[start:start + count + length - 1]),))
                    for shard, lo, segment in rows:
                        place = (doc, key, lo)
                        known = found.get((shard, segment))
                        if known is None or place < known:
                            found[shard, segment] = place
                if len(found) > 100_000:
                    yield _segment_batch(found)
                    found = {}
            if found:
                yield _segment_batch(found)
    return emit


def _segment_batch(found: dict) -> pa.RecordBatch:
    shards, segments = zip(*found)
    ids, keys, starts = zip(*found.values())
    return pa.RecordBatch.from_arrays(
        [pa.array(shards, pa.int64()), pa.array(segments, pa.binary()),
         *(pa.array(x, pa.int64()) for x in (ids, keys, starts))], ["shard", "segment", "id", "key", "start"])


def first_windows(segments: list[bytes], places: list[tuple], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, which of its windows of ``length`` bytes occur in no segment with a smaller place."""
    if not segments:
        return []
    rank = np.empty(len(places), np.int64)
    rank[sorted(range(len(places)), key=places.__getitem__)] = np.arange(len(places))
    text = np.frombuffer(b"\0".join(segments), np.uint8).astype(np.int64)
    sizes = np.array([len(s) for s in segments], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    separators = np.cumsum(sizes + 1)[:-1] - 1
    text += 1
    text[separators] = 0
    order = suffix_array(text)
    shared = permuted_common_prefixes(text, order)
    windows = np.maximum(sizes - length + 1, 0)
    owner = np.full(len(text), -1, np.int64)
    valid = np.arange(int(windows.sum())) + np.repeat(begins - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    owner[valid] = np.repeat(np.arange(len(segments)), windows)
    # a class: neighbours in the order that share a window
    classes = np.cumsum(shared[order] < length)
    member = owner[order] >= 0
    at, classes = order[member], classes[member]
    ranks = rank[owner[at]]
    least = np.full(int(classes[-1]) + 1 if len(classes) else 0, len(places), np.int64)
    np.minimum.at(least, classes, ranks)
    first = np.zeros(len(text), bool)
    first[at] = ranks == least[classes]
    return [first[b:b + w] for b, w in zip(begins, windows)]


def _runs_of(flags: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges.reshape(-1, 2)


def _sort_shards(length: int):
    def resolve(groups: list[tuple[bytes, tuple]], lone: list[tuple[bytes, tuple]]) -> pa.RecordBatch:
        rows = [(key, start, len(segment) - length + 1) for segment, (_, key, start) in lone]
        segments, places = [g[0] for g in groups], [g[1] for g in groups]
        for (_, key, start), first in zip(places, first_windows(segments, places, length)):
            rows.extend((key, start + int(a), int(b - a)) for a, b in _runs_of(first))
        keys, starts, counts = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, starts, counts)],
                                          ["key", "start", "count"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lone, size, group, shard = [], [], 0, {}, None
        for batch in batches:
            for number, segment, doc, key, start in zip(*(c.to_pylist() for c in batch.columns)):
                if number != shard:
                    (held if len(group) > 1 else lone).extend(group.items())
                    size += sum(map(len, group)) if len(group) > 1 else 0
                    group, shard = {}, number
                    if size > SHARD_BYTES or len(lone) > 50_000:
                        yield resolve(held, lone)
                        held, lone, size = [], [], 0
                place, known = (doc, key, start), group.get(segment)
                if known is None or place < known:
                    group[segment] = place
        (held if len(group) > 1 else lone).extend(group.items())
        if held or lone:
            yield resolve(held, lone)
    return sort


def _shared_windows(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` with, for each document, its shared runs of windows and the runs that are first of their kind."""
    bounded_batches(docs.sparkSession)
    base = docs.withColumn("__id", id_key()).withColumn(
        "__key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    runs = base.select("__key", F.col("text").cast("string").alias("text")).mapInArrow(_find_runs(length), "anchor long, key long, at long").where(
        "anchor is not null and key is not null and at is not null").repartition("anchor")
    # the count names all columns, so that both readers of ``runs`` share one exchange
    often = runs.groupBy("anchor").agg(F.count(F.col("key").bitwiseXOR(F.col("at"))).alias("count")).where("count > 1")
    marks = (runs.join(often, "anchor").groupBy(F.col("key").alias("__key"))
             .agg(F.collect_list("anchor").alias("__anchors"), F.collect_list(
                 F.shiftleft("at", 1) + (F.col("count") > HOT).cast("long")).alias("__marks")))
    marked = base.join(marks, "__key", "left")
    firsts = (marked.mapInArrow(_emit_segments(length), "shard long, segment binary, id long, key long, start long")
              .repartition("shard").sortWithinPartitions("shard")
              .mapInArrow(_sort_shards(length), "key long, start long, count long")
              .groupBy(F.col("key").alias("__key")).agg(F.collect_list(
                  F.shiftleft("start", 8) + F.col("count")).alias("__firsts")))
    return marked.join(firsts, "__key", "left")


def removed_spans(n: int, marks, firsts, length: int = LENGTH) -> np.ndarray:
    """(start, end) of the bytes to remove from a text of ``n`` bytes."""
    if marks is None or n < length:
        return np.zeros((0, 2), np.int64)
    step = np.zeros(n - length + 2, np.int32)
    start = marks >> 17
    np.add.at(step, start, 1)
    np.add.at(step, start + ((marks >> 1) & 255), -1)
    later = np.cumsum(step[:-1]) > 0
    if firsts is not None:
        step[:] = 0
        start = firsts >> 8
        np.add.at(step, start, 1)
        np.add.at(step, start + (firsts & 255), -1)
        later &= np.cumsum(step[:-1]) == 0
    spans = _runs_of(later)
    if not len(spans):
        return spans
    spans[:, 1] += length - 1
    new = np.concatenate([[True], spans[1:, 0] > np.maximum.accumulate(spans[:-1, 1])])
    return np.stack([spans[new, 0], np.maximum.reduceat(spans[:, 1], np.flatnonzero(new))], axis=1)


def keep_rest(text: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _cut(batch: pa.RecordBatch, length: int) -> Iterator[tuple[bytes, np.ndarray]]:
    marks, firsts = (batch.column(batch.schema.get_field_index(c)) for c in ("__marks", "__firsts"))
    for text, mark, first in zip(bytes_of(batch, "text"), marks, firsts):
        yield text, removed_spans(len(text), mark.values.to_numpy() if mark.is_valid else None,
                                  first.values.to_numpy() if first.is_valid else None, length)


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts and ends of the removed spans, for every row."""
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in _cut(batch, length):
                kept = keep_rest(text, spans)
                rows.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
                             spans[:, 0].tolist(), spans[:, 1].tolist()))
            if rows:
                n, removed, count, digest, starts, ends = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("doc_id")), *(pa.array(x, pa.int64()) for x in (n, removed, count)),
                     pa.array(digest), *(pa.array(x, pa.list_(pa.int64())) for x in (starts, ends))],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"])

    schema = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
              "starts array<long>, ends array<long>")
    return _shared_windows(docs.select(F.col("doc_id").cast("long"), "text"), length).mapInArrow(report, schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``; bytes of a character that a cut splits go too."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [keep_rest(t, s).decode("utf-8", "ignore") if len(s) else t.decode("utf-8", "replace")
                     for t, s in _cut(batch, length)]
            columns = [pa.array(texts, pa.string()) if name == "text" else batch.column(batch.schema.get_field_index(name))
                       for name in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = docs.columns
    return _shared_windows(docs, length).mapInArrow(cut, docs.schema)
