"""Similarity join of word n-gram sets along chosen paths.

Texts are sets of ``SHINGLE`` consecutive words (a text of fewer words is one shingle); pairs with a Jaccard similarity of
``SIMILARITY`` or more are linked.

1. *Copies.* Equal sets collapse to a representative (the least id) before anything else is shuffled.
2. *Paths.* In each run a set picks each of its tokens with probability 1 / (``REACH`` * size), by a hash that all sets
   share, so similar sets pick common tokens. Sets that picked a token form a bucket. Buckets over ``BUCKET`` sets are split
   again by the tokens picked along the path so far; what is still too large at the last level is dealt out in blocks, and
   every two blocks meet. Small buckets are searched by brute force on sketches (64 one-byte minhashes) with a threshold
   far enough below the similarity to lose none. Runs repeat until the chance of missing a pair at the threshold is below
   1 - ``RECALL``; the number follows from ``REACH``.
3. *Check.* Sets that candidate edges connect are compared exactly, all against all, in blocks that each hold a bounded
   number of sets. Only sums of links and a spanning forest leave a task, never all pairs.

A class is a connected component of exact links. Null and empty texts and texts without a word have no shingle and no link.
Rows equal in id and text are one document and get the same class; ``first_of_class`` keeps one of them. A null id sorts
first, so its copies have a null ``copy_of`` and its class a null ``class_id``. Tables without rows give no rows. Other columns, whatever their names, are kept by ``first_of_class``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.text import NO_ID, bounded_batches, bytes_of, id_key, mix, slices, text_bytes
from tidemark.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
REACH = 0.55
RECALL = 0.9999
BUCKET = 4096
SALTS = 64
BLOCK_SETS = 1024
BLOCK_WORDS = 2_000_000
SKETCH = 64
_FACTORS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_SEEDS = tuple(0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 * k & (1 << 64) - 1 for k in range(SHINGLE + 64))


def runs_needed(similarity: float = SIMILARITY, reach: float = REACH, recall: float = RECALL) -> int:
    """Runs until a pair at the threshold is met with probability ``recall`` on both levels of a path.

    Two sets share similarity / reach picks on average; a path that ends at the second level needs another shared pick.
    """
    shared = similarity / reach
    once = 1 - math.exp(-shared)
    twice = 1 - math.exp(-shared * once)
    return math.ceil(math.log(1 - recall) / math.log(1 - twice))


def word_hashes(words: list[bytes], memo: dict[bytes, int]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    get = memo.get
    out = []
    for word in words:
        value = get(word)
        if value is None:
            if len(memo) > 300_000:
                memo.clear()
            value = memo[word] = digest(word)
        out.append(value)
    return np.array(out, np.uint64)


def shingle_sets(texts: list[bytes], size: int = SHINGLE, memo: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and where each text's begin (one more at the end)."""
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = word_hashes([x for w in words for x in w], {} if memo is None else memo)
    n = len(flat)
    row = np.repeat(np.arange(len(texts)), counts)
    short = (counts < size) & (counts > 0)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    full = np.flatnonzero(row[:max(n - size + 1, 0)] == row[size - 1:]) if n >= size else np.zeros(0, np.int64)
    tokens = np.zeros(len(full), np.uint64)
    for k in range(size):
        tokens = mix(tokens + flat[full + k] * np.uint64(2 * k + 1) + np.uint64(_SEEDS[k]))
    owners = row[full]
    if short.any():
        extra = []
        for i in np.flatnonzero(short):
            value = np.uint64(counts[i])
            for x in flat[starts[i]:starts[i] + counts[i]]:
                value = mix(np.array([value ^ x], np.uint64))[0]
            extra.append(value)
        tokens = np.concatenate([tokens, np.array(extra, np.uint64)])
        owners = np.concatenate([owners, np.flatnonzero(short)])
    order = np.lexsort((tokens, owners))
    tokens, owners = tokens[order], owners[order]
    if len(tokens):
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])])
        tokens, owners = tokens[new], owners[new]
    return tokens, np.searchsorted(owners, np.arange(len(texts) + 1))


def _sketches(tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """One byte of each of ``SKETCH`` minhashes for every nonempty set."""
    out = np.empty((len(begins), SKETCH), np.uint8)
    for k in range(SKETCH):
        least = np.minimum.reduceat(tokens * _FACTORS[k], begins)
        out[:, k] = mix(least) & np.uint64(255)
    return out


def _describe(runs: int):
    """Set rows: id, key, fingerprint, size, sketch, and for every picked token its path and the next paths."""
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            texts = bytes_of(batch, "__text")
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in slices(texts):
                tokens, bounds = shingle_sets(texts[lo:hi], memo=memo)
                sizes = np.diff(bounds)
                some = np.flatnonzero(sizes)
                if not some.size:
                    continue
                begins, sizes = bounds[some], sizes[some]
                tops = [np.add.reduceat(mix(tokens ^ np.uint64(_SEEDS[s])), begins).view(np.int64) for s in (1, 2)]
                limit = (np.minimum(1.0, 1 / (REACH * sizes)) * float(2**63)).astype(np.uint64)
                owner = np.repeat(np.arange(len(some)), sizes)
                paths = [[] for _ in some]
                for run in range(runs):
                    draw = mix(tokens ^ np.uint64(_SEEDS[SHINGLE + run]))
                    picked = np.flatnonzero((draw >> np.uint64(1)) < limit[owner])
                    for j in picked.tolist():
                        i, path = int(owner[j]), draw[j]
                        mine = tokens[begins[i]:begins[i] + sizes[i]]
                        again = mix((mine ^ path) + np.uint64(_SEEDS[1]))
                        follow = again[(again >> np.uint64(1)) < limit[i]]
                        paths[i].append({"path": int(path.view(np.int64)), "next": follow.view(np.int64).tolist()})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo + some]), pa.array(keys[lo + some]), pa.array(tops[0]), pa.array(tops[1]),
                     pa.array(sizes.astype(np.int64)), pa.array([s.tobytes() for s in _sketches(tokens, begins)], pa.binary()),
                     pa.array(paths, pa.list_(pa.struct([("path", pa.int64()), ("next", pa.list_(pa.int64()))])))],
                    ["id", "key", "print1", "print2", "size", "sketch", "paths"])
    return describe


_SETS = ("id long, key long, print1 long, print2 long, size long, sketch binary, "
         "paths array<struct<path: long, next: array<long>>>")


def _bucket_edges(similarity: float):
    """Spanning edges of the sets of each bucket whose sketches agree; rows come sorted by bucket."""
    least = similarity - 4.5 * math.sqrt(similarity * (1 - similarity) / SKETCH)
    agree = math.floor(SKETCH * (least + (1 - least) / 256))

    def search(keys: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, out: set) -> None:
        left = np.arange(len(keys))
        queue: list[int] = []
        while len(left):
            if not queue:
                queue, left = [int(left[0])], left[1:]
            pivot = queue.pop()
            near = (sketches[left] == sketches[pivot]).sum(axis=1) >= agree
            near &= np.minimum(sizes[left], sizes[pivot]) >= similarity * np.maximum(sizes[left], sizes[pivot])
            for other in left[near].tolist():
                out.add((min(keys[pivot], keys[other]), max(keys[pivot], keys[other])))
                queue.append(other)
            left = left[~near]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set = set()
        held, bucket = [], None

        def close() -> None:
            if len(held) > 1:
                keys, sizes, sketches = zip(*{h[0]: h for h in held}.values())
                if len(keys) > 1:
                    search(np.array(keys), np.array(sizes),
                           np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SKETCH), found)

        for batch in batches:
            for path, a, b, key, size, sketch in zip(*(c.to_pylist() for c in batch.columns)):
                if (path, a, b) != bucket:
                    close()
                    held, bucket = [], (path, a, b)
                    if len(found) > 50_000:
                        yield _pairs(found)
                        found.clear()
                held.append((key, size, sketch))
        close()
        if found:
            yield _pairs(found)
    return edges


def _pairs(found: set) -> pa.RecordBatch:
    a, b = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _counted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``many``, the sets of their bucket; buckets of one are left out.

    A path that very many sets share is counted and joined in ``SALTS`` parts, of which the sum is taken by path.
    """
    rows = rows.where("path is not null and key is not null").withColumn(
        "part", F.pmod("key", F.lit(SALTS)).cast("int")).repartition("path", "part")
    parts = rows.groupBy("path", "part").agg(F.count("key").alias("some"))
    many = parts.withColumn("many", F.sum("some").over(Window.partitionBy("path"))).where("many > 1")  # of at most SALTS rows
    return rows.join(many.drop("some"), ["path", "part"]).drop("part")


def _blocks(many: Column, key: Column, block: int) -> tuple[Column, Column]:
    """Number of blocks for ``many`` members, and the block of a member."""
    count = F.ceil(many / F.lit(block)).cast("long")
    return count, F.pmod(F.xxhash64(key), count)


def _meetings(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Every row once for each pair of blocks that its own block belongs to."""
    count, own = _blocks(F.col("many"), F.col(key), block)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__count") - 1))
    return (rows.withColumn("__count", count).withColumn("__own", own).withColumn("__other", other)
            .withColumn("block_a", F.least("__own", "__other")).withColumn("block_b", F.greatest("__own", "__other"))
            .drop("__count", "__other"))


def candidate_edges(sets: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect sets met in a bucket with agreeing sketches."""
    picked = sets.select("key", "size", "sketch", F.explode("paths").alias("p"))
    light = picked.select(F.col("p.path").alias("path"), "key", F.col("p.next").alias("next"))
    first = cut_lineage(_counted(light))
    small = first.where(F.col("many") <= bucket).select("path", "many", "key")
    deeper = first.where(F.col("many") > bucket).select(F.explode("next").alias("path"), "key")
    members = small.unionByName(_counted(deeper).select("path", "many", "key"))
    met = _meetings(members, "key", bucket).select("path", "block_a", "block_b", "key")
    return (met.join(sets.select("key", "size", "sketch"), "key")
            .select("path", "block_a", "block_b", "key", "size", "sketch")
            .repartition("path", "block_a", "block_b").sortWithinPartitions("path", "block_a", "block_b")
            .mapInArrow(_bucket_edges(similarity), "a long, b long"))


def linked(texts: list[bytes], similarity: float = SIMILARITY) -> np.ndarray:
    """Which sets of shingles are similar: a symmetric matrix without its diagonal."""
    m = len(texts)
    tokens, bounds = shingle_sets(texts)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    times = np.bincount(column) if len(column) else np.zeros(0, np.int64)
    common = times[column] > 1 if len(column) else np.zeros(0, bool)
    owner, column = owner[common], column[common]
    number = np.concatenate([[0], np.cumsum(np.diff(column) != 0)]) if len(column) else column
    both = np.zeros((m, m), np.float32)
    width = 4096
    cuts = np.searchsorted(number, np.arange(0, (number[-1] + 1 if len(number) else 0) + width, width))
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        present = np.zeros((m, width), np.float32)
        present[owner[lo:hi], number[lo:hi] - k * width] = 1
        both += present @ present.T
    whole, total = np.rint(both).astype(np.int64), sizes[:, None] + sizes[None, :]
    out = (whole * 10_000 >= round(similarity * 10_000) * (total - whole)) & (total > 0)
    np.fill_diagonal(out, False)
    return out


def _verify(similarity: float):
    """Links of the sets of each meeting and a spanning forest; rows come sorted by component and blocks."""
    def close(held: list) -> Iterator[tuple[int, int, int]]:
        texts, keys, weights, blocks = ([h[k] for h in held] for k in range(4))
        near = linked(texts, similarity)
        if len(set(blocks)) > 1:  # within a block the block's own meeting counts
            blocks = np.array(blocks)
            near &= blocks[:, None] != blocks[None, :]
        elif held[0][4] != held[0][5]:
            return
        sums = near @ np.array(weights, np.float64)
        for key, total in zip(keys, sums.tolist()):
            if total:
                yield key, key, int(total)
        left = np.arange(len(keys))
        queue: list[int] = []
        while len(left):
            if not queue:
                queue, left = [int(left[0])], left[1:]
            pivot = queue.pop()
            hit = near[pivot, left]
            for other in left[hit].tolist():
                yield min(keys[pivot], keys[other]), max(keys[pivot], keys[other]), 0
                queue.append(other)
            left = left[~hit]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, out = [], None, []
        for batch in batches:
            for component, a, b, own, key, weight, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (component, a, b) != group:
                    if held:
                        out.extend(close(held))
                    held, group = [], (component, a, b)
                    if len(out) > 20_000:
                        yield _links(out)
                        out = []
                held.append((text, key, weight, own, a, b))
        if held:
            out.extend(close(held))
        if out:
            yield _links(out)
    return verify


def _links(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b", "links"])


def _based(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__text", text_bytes()).withColumn("__id", id_key()).withColumn(
        "__key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """For every document with a shingle: __key, copy_of, class_id (ids of documents) and n_links.

    ``n_links`` counts the other documents that are similar, copies included.
    """
    bounded_batches(docs.sparkSession)
    base = _based(docs)
    found = base.select("__id", "__key", "__text").mapInArrow(_describe(runs_needed(similarity)), _SETS)
    found = cut_lineage(found)
    members = found.select("id", "key", "print1", "print2").distinct()
    copies = members.groupBy("print1", "print2").agg(
        F.min(F.struct("id", "key")).alias("first"), F.count("*").alias("weight")).select(
        "print1", "print2", F.col("first.id").alias("id"), F.col("first.key").alias("key"), "weight")
    copies = cut_lineage(copies)
    sets = found.join(copies.select("key"), "key", "left_semi").dropDuplicates(["key"])
    parts = components(candidate_edges(sets, similarity))
    # blocks are bounded in sets and in words
    many = parts.join(copies.withColumnRenamed("key", "node"), "node").join(
        found.select(F.col("key").alias("node"), "size").dropDuplicates(["node"]), "node")
    groups = many.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("words")).select(
        "component", F.greatest("n", F.ceil(F.col("words") * BLOCK_SETS / BLOCK_WORDS)).alias("many"))
    meetings = _meetings(many.join(groups, "component"), "node", BLOCK_SETS)
    texts = base.select(F.col("__key").alias("node"), "__text")
    chosen = texts.join(many.select("node"), "node", "left_semi").dropDuplicates(["node"])
    checked = (meetings.join(chosen, "node")
               .select("component", "block_a", "block_b", "__own", F.col("node").alias("key"), "weight", "__text")
               .repartition("component", "block_a", "block_b").sortWithinPartitions("component", "block_a", "block_b")
               .mapInArrow(_verify(similarity), "a long, b long, links long"))
    checked = cut_lineage(checked)
    sums = checked.where("links > 0").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    exact = components(checked.where("links = 0").select("a", "b")).withColumnRenamed("node", "key")
    firsts = copies.join(exact, "key", "left").join(sums, "key", "left").withColumn(
        "component", F.coalesce("component", "key"))
    least = firsts.groupBy("component").agg(F.min("id").alias("class_id"))
    named = firsts.join(least, "component").select(
        "print1", "print2", F.col("id").alias("copy_of"), "class_id",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    return members.join(named, ["print1", "print2"]).select(
        F.col("key").alias("__key"), F.col("id").alias("__id"), "copy_of", "class_id", "n_links")


def class_report(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, copy_of, class_id, n_links of every row; a text without shingles is a class of its own."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(
        F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("__key"))
    classes = near_classes(docs, similarity).drop("__id")
    # a class whose first document has no id is named by none
    named = lambda c: F.when(F.col(c).isNull(), F.col("doc_id")).otherwise(F.nullif(F.col(c), F.lit(NO_ID)))
    return rows.join(classes, "__key", "left").select(
        "doc_id", named("copy_of").alias("copy_of"), named("class_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def first_of_class(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs``, all columns, for each class: the one with the least id. Texts without shingles all stay."""
    classes = near_classes(docs, similarity)
    ranked = classes.groupBy("class_id").agg(F.min(F.struct("__id", "__key")).alias("first")).select(
        F.col("first.__key").alias("__key"))
    others = classes.select("__key").join(ranked, "__key", "left_anti")
    kept = docs.withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return kept.join(others, "__key", "left_anti").dropDuplicates(["__key"]).select(*docs.columns)
