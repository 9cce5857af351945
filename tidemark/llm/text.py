"""Helpers shared by the text operators: bounded batches, words, shingles, row keys.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return, which is what
``bytes.split()`` cuts. Texts travel as UTF-8 bytes; a null text counts as empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000
SLICE_BYTES = 2_000_000
PIECE_BYTES = 1 << 20
NO_ID = -(2**63)
_BLANK = re.compile(rb"[ \t-\r]")


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches, because a row holds a whole text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_bytes(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b""))


def id_key(column: str = "doc_id") -> Column:
    """The id as a sort key; a null id sorts before all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def held_out(modulus: int, column: str = "doc_id") -> Column:
    """Rows kept out of learning: crc32 of the id as text leaves no remainder (a null id is held out)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus)) == 0


def bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    values = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_binary(values.type):
        values = values.cast(pa.string()).cast(pa.binary())
    return [v or b"" for v in values.to_pylist()]


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    lo, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield lo, i
            lo, size = i, 0
        size += len(text)
    if lo < len(texts):
        yield lo, len(texts)


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``PIECE_BYTES``, cut at blanks, so that a long text's words need not all be held."""
    at = 0
    while at < len(text):
        end = _BLANK.search(text, at + PIECE_BYTES) if at + PIECE_BYTES < len(text) else None
        stop = end.start() if end else len(text)
        yield text[at:stop]
        at = stop


def word_ids(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word (equal for equal words) and the row each word stands in."""
    flat = list(chain.from_iterable(words))
    number = dict(zip(flat, range(len(flat))))
    ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    return ids, np.repeat(np.arange(len(words)), [len(w) for w in words])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``rows`` rows (the last one fewer), for rows that are small."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
