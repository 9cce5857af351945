"""Spot signatures: chains of content words that follow common words.

An anchor and the next ``CHAIN`` content words that stand ``DISTANCE`` words apart form a spot. Anchors are the start of the
text, the common words listed, and, for languages without such a list, the content word with the least hash of every
``CHAIN`` + 1 content words that no common word parts (winnowing, Schleimer, Wilkerson and Aiken 2003). Every content word is
thus in a spot (at a distance of 1), and which spots a stretch bears depends on the stretch alone. A text's fingerprint is the
multiset of its spots. Two fingerprints are compared by Jaccard similarity of multisets, pruned: their lengths bound it from above, and so does what is left while spots are merged
in order, so a comparison ends when a required likeness is out of reach. ``near_matches`` searches a table for the fingerprints
like those of stated rows: fingerprints are partitioned by length, so that only those in the same or a neighbouring partition can
be similar, and within a partition a candidate must share one of the rarest spots of the row searched for (Theobald, Siddharth
and Paepcke 2008). It loses nothing: what it finds equals a comparison with all rows.

Words are compared in lower case without leading and trailing ASCII punctuation; words that are all punctuation do not
count. In scripts written without blanks, and in runs of more than ``LONG`` characters without a blank, each character is a
word. A chain cut short by the end of the text is kept if it has a word. Null and empty texts, and texts without words,
have the empty fingerprint; two empty fingerprints have likeness 1, an empty one and another have 0. Repeated rows get equal
fingerprints. Rows with a null id are searched, but a condition on their id does not select them. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.text import bounded_batches, bytes_of, id_key, mix
from tidemark.session import cut_lineage

CHAIN = 2
DISTANCE = 1
LONG = 40
BATCH_BYTES = 4 << 20
MEMO_WORDS = 300_000
SALTS = 16
TOKEN_ROWS = 200_000
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Common words of English, French, German and Spanish.
COMMON = frozenset("""
a an and are as at be by for from in is it of on or that the this to was were with
au aux dans de des du elle en est et il la le les ne par pas pour que qui sur un une
als auf aus bei das dem den der des die ein eine im ist mit nicht sich und von zu
al con del el en es la las lo los no para por que se su una y
""".encode().split())

# Thai, Lao, Tibetan, Myanmar, Khmer, Tai and related scripts, kana, Chinese characters
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff"
                       "\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]")
_UNSPACED_OR_RUN = re.compile(f"{_UNSPACED.pattern}|[^{_UNSPACED.pattern[1:-1]}]+")

_memo: dict[bytes, int] = {}


def cut_words(text: bytes) -> list[bytes]:
    """Words of a text; what is written without blanks is cut into characters."""
    words = text.split()
    if (text.isascii() or not _UNSPACED.search(text.decode("utf-8", "replace"))) and max(map(len, words), default=0) <= LONG:
        return words
    out = []
    for word in words:
        if len(word) <= LONG and word.isascii():
            out.append(word)
            continue
        chars = word.decode("utf-8", "replace")
        out.extend(c.encode() for c in (chars if len(chars) > LONG else _UNSPACED_OR_RUN.findall(chars)))
    return out


def _word(word: bytes) -> int:
    """0: no word, 1: common word, otherwise a hash of at least 2."""
    core = word.decode("utf-8", "replace").lower().encode().strip(_EDGE)
    if not core:
        return 0
    return 1 if core in COMMON else max(2, xxhash.xxh3_64_intdigest(core))


def _numbers(words: list[bytes]) -> np.ndarray:
    get, out = _memo.get, []
    for word in words:
        value = get(word)
        if value is None:
            if len(_memo) >= MEMO_WORDS:
                _memo.clear()
            value = _memo[word] = _word(word)
        out.append(value)
    return np.array(out, np.uint64)


def _anchor_hashes(words: list[bytes], common: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(words[i].lower().strip(_EDGE)) for i in common.tolist()], np.uint64)


def spots(text: bytes, chain: int = CHAIN, distance: int = DISTANCE) -> np.ndarray:
    """Sorted 32-bit hashes of the spots of a text, with repeats."""
    words = cut_words(text)
    numbers = _numbers(words)
    real = numbers > 0
    numbers = numbers[real]
    if not len(numbers):
        return np.zeros(0, np.uint32)
    content = np.flatnonzero(numbers > 1)
    common = np.flatnonzero(numbers == 1)
    values = numbers[content]
    least = _least_of_windows(content, values, chain + 1)
    # the first content word after each anchor; the start of the text is an anchor, too
    after = np.concatenate([[0], np.searchsorted(content, common), least + 1])
    kept = [w for w, r in zip(words, real.tolist()) if r] if not real.all() else words
    state = np.concatenate([[np.uint64(1)], _anchor_hashes(kept, common), mix(values[least])]).astype(np.uint64)
    has = after < len(values)
    if not has.any():
        return np.sort((mix(state) >> np.uint64(32)).astype(np.uint32))
    has[1 + len(common):] = True  # a content word is a spot by itself
    state, after = state[has], after[has]
    for k in range(chain):
        at = after + k * distance
        inside = at < len(values)
        state[inside] = mix(state[inside] + values[at[inside]] * np.uint64(2 * k + 3))
    return np.sort((state >> np.uint64(32)).astype(np.uint32))


def _least_of_windows(content: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """Positions in ``values`` of the first least one of each ``width`` content words that stand side by side."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    whole = np.flatnonzero(content[width - 1:] - content[:len(content) - width + 1] == width - 1)
    return np.unique(whole + np.lib.stride_tricks.sliding_window_view(values, width)[whole].argmin(axis=1))


def encode(fingerprint: np.ndarray) -> str:
    """Hexadecimal digits of the sorted spots, eight for each."""
    return fingerprint.astype(">u4").tobytes().hex()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted multisets; 0 as soon as ``least`` cannot be reached."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    total, step = len(a) + len(b), 256
    common = i = j = 0
    while i < len(a) and j < len(b):
        top = min(a[min(i + step, len(a)) - 1], b[min(j + step, len(b)) - 1])
        x, y = np.searchsorted(a[i:], top, "right") + i, np.searchsorted(b[j:], top, "right") + j
        va, ca = np.unique(a[i:x], return_counts=True)
        vb, cb = np.unique(b[j:y], return_counts=True)
        _, pa_, pb_ = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
        common += int(np.minimum(ca[pa_], cb[pb_]).sum())
        i, j = int(x), int(y)
        best = common + min(len(a) - i, len(b) - j)
        if best < least * (total - best):
            return 0.0
    return common / (total - common)


def length_partition(length: int, least: float) -> int:
    """Partition of a fingerprint: lengths in partitions further than one apart cannot reach ``least``."""
    return 0 if length <= 0 else 1 + int(np.floor(np.log(length) / -np.log(least) + 1e-9))


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of few bytes, too: a fingerprint takes about as much room as its text, and Spark's limit is 64 MB."""
    bounded_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and n_spots of every row."""
    _small_batches(docs.sparkSession)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spots(t) for t in bytes_of(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([encode(s) for s in found], pa.string()),
                 pa.array([len(s) for s in found], pa.int64())], ["doc_id", "fingerprint", "n_spots"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        take, "doc_id long, fingerprint string, n_spots long")


def print_id() -> Column:
    """The name of a fingerprint."""
    return F.md5("fingerprint")


def _occurrences(rows: DataFrame) -> DataFrame:
    """One row per spot; the k-th occurrence of a spot in a text is a token of its own, so multisets become sets."""
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, size, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = decode(text)
                place = np.arange(len(found))
                first = np.maximum.accumulate(np.where(np.concatenate([[True], found[1:] != found[:-1]]), place, 0)) if size else place
                token = (found.astype(np.uint64) << np.uint64(32) | (place - first).astype(np.uint64)).view(np.int64)
                for lo in range(0, len(token), TOKEN_ROWS):
                    part = token[lo:lo + TOKEN_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), key)), pa.array(np.full(len(part), size)),
                                                      pa.array(part)], ["key", "n", "token"])

    return rows.select("key", "n", "fingerprint").mapInArrow(take, "key long, n long, token long")


def _partition(n: Column, least: float) -> Column:
    return (1 + F.floor(F.log(n) / -float(np.log(least)) + 1e-9)).cast("long")


def near_matches(docs: DataFrame, wanted: Column, least: float = 0.8) -> DataFrame:
    """Fingerprints like those of the rows where ``wanted`` (a condition on ``doc_id``) holds: print, other, likeness.

    Both are names of fingerprints (``print_id``); equal fingerprints share one name, so copies are not compared, and
    ``fingerprints(docs)`` tells which rows bear it. Of the ``n`` spots of a row searched for, any match of likeness
    ``least`` has at least ``least * n``, so it has one of the ``n - ceil(least * n) + 1`` rarest. Only these are looked up:
    by spot, length partition and a salt that cuts a spot of very many texts into ``SALTS`` parts. Each candidate is
    then compared exactly. The name is an MD5; lookups use 64 bits, and texts that share these are compared apart.
    """
    if not 0 < least < 1:
        raise ValueError("least must lie between 0 and 1")
    _small_batches(docs.sparkSession)
    kinds = fingerprints(docs).withColumn("asked", F.coalesce(wanted, F.lit(False))).where("n_spots > 0").groupBy(
        print_id().alias("print")).agg(F.first("fingerprint").alias("fingerprint"), F.first("n_spots").alias("n"),
                                       F.max("asked").alias("asked"))
    kinds = cut_lineage(kinds.withColumn("key", F.xxhash64("print")))
    tokens = _occurrences(kinds)
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    # the spots of one text are ranked in one group, which its length bounds
    rank = F.row_number().over(Window.partitionBy("key").orderBy("often", "token"))
    rarest = _occurrences(kinds.where("asked")).join(often, "token").withColumn("rank", rank).where(
        F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    near = F.explode(F.array(*[_partition(F.col("n"), least) + i for i in (-1, 0, 1)]))
    sought = rarest.select(F.col("key").alias("a"), F.col("n").alias("n_a"), "token", near.alias("part")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = tokens.select(F.col("key").alias("b"), F.col("n").alias("n_b"), "token", _partition(F.col("n"), least).alias("part"),
                         F.pmod("key", F.lit(SALTS)).cast("int").alias("salt"))
    fits = (F.col("n_b") >= F.col("n_a") * least - 1e-9) & (F.col("n_a") >= F.col("n_b") * least - 1e-9)
    pairs = held.join(sought, ["token", "part", "salt"]).where(fits).select("a", "b").distinct()
    side = lambda key, name: kinds.select(F.col("key").alias(key), F.col("print").alias(name),
                                          F.col("fingerprint").alias(f"of_{name}"))
    both = pairs.join(side("b", "other"), "b").join(side("a", "print"), "a").where("print <> other")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(a, b, likeness(decode(x), decode(y), least)) for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns))]
            rows = [r for r in rows if r[2] >= least]
            if rows:
                a, b, value = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(value, pa.float64())],
                                                 ["print", "other", "likeness"])

    return both.select("print", "other", "of_print", "of_other").mapInArrow(compare, "print string, other string, likeness double")


_EDITS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, n_spots long, edited_n_spots long")


def _compared(doc: int, text: bytes, own: np.ndarray, following: bytes, other: np.ndarray) -> tuple:
    chars, more = text.decode("utf-8", "replace"), following.decode("utf-8", "replace")
    half = len(chars) // 2
    edited = (chars[:len(chars) - half] + more[:half]).encode()
    changed = spots(edited)
    return (doc, len(chars), hashlib.sha256(edited).hexdigest(), encode(own), encode(changed), likeness(own, changed),
            likeness(own, other), len(own), len(changed))


def _edit_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      [c.split()[0] for c in _EDITS.split(", ")])


def _rim_pairs(ends: Iterator[tuple]) -> Iterator[tuple]:
    """The last document of each range with the first of the next one; after the last range comes the first.

    ``ends`` has kind (0: first, 1: last), doc_id and text, in order of ranges; only three of them are held at a time.
    """
    first = tail = None
    for kind, *end in ends:
        if kind == 1:
            tail = end
        elif first is None:
            first = end
        else:
            yield (*tail, *end)
    if first is not None:
        yield (*tail, *first)


def edit_report(docs: DataFrame) -> DataFrame:
    """Every document against its own second half replaced, and against the next document.

    Texts are dealt out once, by ranges of ids. Within a range a task walks them in order; only the first and the last
    document of each range meet those of other ranges, which takes two rows for each partition.
    """
    spark = docs.sparkSession
    _small_batches(spark)
    ranged = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
              .withColumn("__id", id_key())
              .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "__id", F.xxhash64("text")))
    ordered = ranged.sortWithinPartitions("__id", F.xxhash64("text"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), bytes_of(batch, "text")):
                own = spots(text)
                if last is not None:
                    rows.append(_compared(*last, text, own))
                last = (doc, text, own)
                if len(rows) >= 500:
                    yield _edit_batch(rows)
                    rows = []
            if rows:
                yield _edit_batch(rows)

    # one row of the first and one of the last document of each range
    order = F.struct("__id", F.xxhash64("text").alias("h"), "doc_id", "text")
    ends = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(order).alias("head"), F.max(order).alias("tail"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = (end for batch in batches
                for end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bytes_of(batch, "text")))
        for doc, text, _, following in _rim_pairs(ends):
            yield _edit_batch([_compared(doc, text, spots(text), following, spots(following))])

    rim = (ends.select(F.explode(F.array(F.struct(F.lit(0).alias("kind"), "head.*"), F.struct(F.lit(1).alias("kind"), "tail.*")))
                       .alias("e")).select("e.kind", "e.doc_id", "e.text", "e.__id", "e.h")
           .coalesce(1).sortWithinPartitions("__id", "h", "kind").drop("__id", "h"))
    return ordered.select("doc_id", "text").mapInArrow(walk, _EDITS).unionByName(rim.mapInArrow(close, _EDITS))
