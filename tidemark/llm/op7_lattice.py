"""Language-model scores of texts: marginal likelihood over all segmentations of a subword lattice.

The model is a unigram model of pieces. Its vocabulary and scores exist before a text is scored: the pieces of a public
vocabulary with scores from the training corpus (counts of expected uses, ``ROUNDS`` rounds of expectation maximisation
over a corpus count of words), and every training word as a whole with its own count. A word's probability is the sum over
all segmentations, by a forward recursion in log space:

    P(word) = discounted(c_k) / N_k + rest_k * (discounted(c) / N + rest * sum over segmentations of prod q_k(piece))

for each kind k of text (a language, say), with c_k the word's count in training texts of the kind, c its count in all, N_k
and N all their tokens; discounted(c) is max(c - DISCOUNT, 0), and the rests are what the discounts leave (absolute
discounting, Ney, Essen and Kneser 1994). A piece has a score q of its own for each kind, as the first of a word and as its
last. The end of a text is a token of its own with its own counts. A text's probability is the mean over the kinds of the
product over its tokens, weighted by the kinds' shares of the training texts: a text's own kind is not read, only those of
training texts. The ``KINDS`` most frequent values are kinds, all others one more; without a kind column there is one kind.
The base score is the add-0.1 unigram score.

The lattice holds the pieces of the vocabulary whatever their length. Counts, N, V and the pieces' scores come from all
training rows. Words are counted within a row first; the ``FREQUENT`` most frequent words travel as a table of bounded size,
all others meet their rows in a shuffle of words, in which each row sends a word once. Only sums over a fixed number of
pieces reach the driver.

Null and empty texts have one token, the end. Repeated rows count as often as they occur, and get equal scores. Without
training rows N is 0 and both scores are computed from the smoothing alone. An empty table gives an empty result. Only
``doc_id``, ``text`` and the kind column are read; a null kind is a value like any other.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.op9_viterbi import MARK, Pieces
from tidemark.llm.text import bounded_batches, bytes_of, gathered, held_out
from tidemark.session import cut_lineage

FREQUENT = 50_000
ROUNDS = 3
KINDS = 8
DISCOUNT = 0.75
SHORT = 24  # bytes of a word whose probability stays within the range of a double
_LATTICES: dict = {}


def _longer(value: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Hashes of strings that are one byte longer than those with the hashes ``value``."""
    value = (value + byte + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return value ^ (value >> np.uint64(29))


class Lattice:
    """Pieces that can occur in a word, as bytes without markers; every single byte is one."""

    def __init__(self, path: str | None = None):
        texts = {bytes([b]) for b in range(256)}
        texts |= {p.replace(MARK, "").lower().encode() for p in Pieces(path).score}
        self.texts = sorted((t for t in texts if t), key=lambda t: (len(t) > 1, t))
        self.longest = max(map(len, self.texts))
        number = {t: i for i, t in enumerate(self.texts)}
        starts = sorted({t[:k] for t in self.texts for k in range(1, len(t) + 1)})
        keys = np.empty(len(starts), np.uint64)
        for part, letters in by_length(starts):
            value = np.zeros(len(part), np.uint64)
            for column in letters.T:
                value = _longer(value, column)
            keys[part] = value
        order = np.argsort(keys)
        self._keys = keys[order]
        self._piece = np.array([number.get(t, -1) for t in starts])[order]
        if (self._keys[1:] == self._keys[:-1]).any():
            raise ValueError("two beginnings of pieces share a hash")
        # most strings begin no piece; a small table of leading bits tells so without a search
        self._led = np.zeros(1 << 20, bool)
        self._led[self._keys >> np.uint64(44)] = True

    def arcs(self, letters: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words, scores) of the arcs of words of one length, which are the rows of ``letters``.

        A piece has four scores: as the first of a word or a later one, and ending the word or not.
        """
        out, length = [], letters.shape[1]
        columns = np.ascontiguousarray(letters.T)
        for start in range(length):
            word, value = np.arange(len(letters)), np.zeros(len(letters), np.uint64)
            for end in range(start + 1, min(start + self.longest, length) + 1):
                value = _longer(value, columns[end - 1][word])
                some = np.flatnonzero(self._led[value >> np.uint64(44)])
                at = np.minimum(np.searchsorted(self._keys, value[some]), len(self._keys) - 1)
                begun = self._keys[at] == value[some]  # only words in which a piece goes on here are followed
                some, at = some[begun], at[begun]
                if not some.size:
                    break
                word, value, piece = word[some], value[some], self._piece[at]
                has = np.flatnonzero(piece >= 0)
                if has.size:
                    kind = (start > 0) + 2 * (end == length)
                    out.append((start, end, word[has], piece[has] + kind * len(self.texts)))
        return out

    def normalised(self, uses: np.ndarray) -> np.ndarray:
        """Log probabilities from uses: the first piece of a word and the later ones each sum to 1 over piece and end."""
        table = uses.reshape(2, 2, len(self.texts))
        return np.log(table / table.sum(axis=(0, 2), keepdims=True)).ravel()


def lattice(path: str | None = None) -> Lattice:
    """One lattice for each vocabulary and Python worker."""
    if (path or "") not in _LATTICES:
        _LATTICES[path or ""] = Lattice(path)
    return _LATTICES[path or ""]


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the words of each length, and their bytes as a matrix; at most 20,000 words at a time."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for same in np.split(order, cuts) if len(order) else ():
        for lo in range(0, len(same), 20_000):
            part = same[lo:lo + 20_000]
            data = np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), -1)
            yield part, data.astype(np.uint64)


def forward(arcs: list, scores: np.ndarray, count: int, length: int, logs: bool) -> np.ndarray:
    """The summed probability of all ways to each place: place x word x kind. Arcs come by start.

    ``scores`` has a row for each piece, a column for each kind. With ``logs`` scores and sums are logs, else plain.
    """
    alpha = np.full((length + 1, count, scores.shape[1]), -np.inf if logs else 0.0)
    alpha[0] = 0.0 if logs else 1.0
    for start, end, word, piece in arcs:
        if logs:
            alpha[end, word] = np.logaddexp(alpha[end, word], alpha[start, word] + scores[piece])
        else:
            alpha[end, word] += alpha[start, word] * scores[piece]
    return alpha


def add_expected_uses(arcs: list, scores: np.ndarray, weights: np.ndarray, length: int, uses: np.ndarray, logs: bool) -> None:
    """Add to ``uses`` the expected number of uses of each piece, by forward and backward sums; ``scores`` of one kind."""
    alpha = forward(arcs, scores[:, None], len(weights), length, logs)[:, :, 0]
    beta = np.full_like(alpha, -np.inf if logs else 0.0)
    beta[length] = 0.0 if logs else 1.0
    share = weights if logs else weights / alpha[length]
    pieces, amounts = [], []
    for start, end, word, piece in reversed(arcs):
        pieces.append(piece)
        if logs:
            step = scores[piece] + beta[end, word]
            amounts.append(share[word] * np.exp(alpha[start, word] + step - alpha[length, word]))
            beta[start, word] = np.logaddexp(beta[start, word], step)
        else:
            step = scores[piece] * beta[end, word]
            amounts.append(share[word] * alpha[start, word] * step)
            beta[start, word] += step
    uses += np.bincount(np.concatenate(pieces), np.concatenate(amounts), minlength=len(uses))


def spellings(words: list[bytes], scores: np.ndarray, path: str | None = None) -> np.ndarray:
    """log10 of each word's probability as a sum over all its segmentations, its end included.

    ``scores`` holds the pieces' scores, or a row of them for each kind; then each word gets a row with a value for each.
    """
    found, columns = lattice(path), np.ascontiguousarray(np.atleast_2d(scores).T)
    plain = np.exp(columns)
    out = np.empty((len(words), columns.shape[1]))
    for part, letters in by_length(words):
        length = letters.shape[1]
        if length <= SHORT:
            out[part] = np.log(forward(found.arcs(letters), plain, len(part), length, False)[-1])
        else:
            out[part] = forward(found.arcs(letters), columns, len(part), length, True)[-1]
    return (out if scores.ndim > 1 else out[:, 0]) / math.log(10)


def kind_number(docs: DataFrame, kind: str | None) -> tuple[Column, list[int]]:
    """The number of a row's kind, and the rows of each kind: the ``KINDS`` most frequent values, then all others."""
    total = docs.count()
    if kind is None or not total:
        return F.lit(0), [total]
    top = docs.groupBy(F.col(kind).alias("value")).count().orderBy(F.desc("count"), "value").limit(KINDS).collect()
    sizes = [r["count"] for r in top]
    number = F.lit(len(top))
    for i, row in enumerate(top):
        number = F.when(F.col(kind).eqNullSafe(F.lit(row["value"])), i).otherwise(number)
    return number, sizes + ([total - sum(sizes)] if total > sum(sizes) else [])


def word_counts(docs: DataFrame, number: Column | None = None, kinds: int = 1) -> DataFrame:
    """word, c, and c0, c1 .. by kind over all rows of ``docs``; equal words of a task are added up before they are shuffled."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [Counter() for _ in range(kinds)]
        for batch in batches:
            for text, k in zip(bytes_of(batch, "text"), batch.column(1).to_pylist()):
                totals[k].update(text.lower().split())
                if len(totals[k]) > 300_000 // kinds:
                    yield _count_batch(totals[k], k)
                    totals[k].clear()
        for k, total in enumerate(totals):
            if total:
                yield _count_batch(total, k)

    return docs.select(F.col("text").cast("string").alias("text"), (F.lit(0) if number is None else number).cast("int").alias("kind")).mapInArrow(
        count, "word binary, c long, kind int").groupBy("word").agg(
        F.sum("c").alias("c"), *(F.sum(F.when(F.col("kind") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(kinds)))


def _count_batch(total: Counter, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64()),
         pa.array(np.full(len(total), kind, np.int32))], ["word", "c", "kind"])


def piece_scores(counts: DataFrame, vocabulary: str | None = None, rounds: int = ROUNDS, kinds: int = 1) -> np.ndarray:
    """Scores of the pieces (see ``Lattice.arcs``) from a count of training words, a row for each kind.

    Expected uses are summed on the cluster; the driver gets one number for each piece and kind that is used.
    """
    size = 4 * len(lattice(vocabulary).texts)
    prior = np.full(size, 0.001)
    prior.reshape(4, -1)[:, :256] += 0.1
    scores = np.stack([lattice(vocabulary).normalised(np.ones(size))] * kinds)
    for _ in range(rounds):
        def expect(batches: Iterator[pa.RecordBatch], scores=scores) -> Iterator[pa.RecordBatch]:
            found, uses, plain = lattice(vocabulary), np.zeros((kinds, size)), np.exp(scores)
            for batch in gathered(batches):
                words = batch.column(0).to_pylist()
                for k in range(kinds):
                    c = batch.column(1 + k).to_numpy()
                    has = np.flatnonzero(c)
                    # types count by the logarithm of their tokens: unseen words resemble rare ones
                    weights = 1 + np.log(c[has])
                    for part, letters in by_length([words[i] for i in has]):
                        logs = letters.shape[1] > SHORT
                        add_expected_uses(found.arcs(letters), (scores if logs else plain)[k], weights[part],
                                          letters.shape[1], uses[k], logs)
            kind, used = np.nonzero(uses)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind), pa.array(used), pa.array(uses[kind, used])], ["kind", "piece", "uses"])

        uses = np.stack([prior] * kinds)
        sums = counts.select("word", *(f"c{k}" for k in range(kinds))).mapInArrow(
            expect, "kind long, piece long, uses double").groupBy("kind", "piece").agg(F.sum("uses").alias("uses")).toArrow()
        uses[sums["kind"].to_numpy(), sums["piece"].to_numpy()] += sums["uses"].to_numpy()
        scores = np.stack([lattice(vocabulary).normalised(u) for u in uses])
    return scores


class Mixture:
    """Counts, piece scores and shares of the kinds: all that a word's probabilities need besides its own counts."""

    def __init__(self, tokens: np.ndarray, types: np.ndarray, texts: list[int], scores: np.ndarray, vocabulary: str | None):
        """``tokens`` and ``types``: over all training texts, then of each kind, ends included."""
        self.kinds, self.scores, self.vocabulary = len(texts), scores, vocabulary
        self.tokens = np.maximum(tokens, 1)
        self.rest = np.where(tokens > 0, DISCOUNT * types / self.tokens, 1.0)
        self.total = tokens[0] + 0.1 * (types[0] + 1)
        ends = np.maximum(np.array([sum(texts), *texts]) - DISCOUNT, 0) / self.tokens
        self.end = np.log10(ends[1:] + self.rest[1:] * ends[0]) if sum(texts) else np.zeros(self.kinds)
        self.shares = ((np.array(texts) + 1) / (sum(texts) + self.kinds)).tolist()

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / self.total)

    def words(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """log10 of each word's probability in each kind; ``counts``: its count in all texts, then in those of each kind."""
        held = np.maximum(counts - DISCOUNT, 0) / self.tokens
        spelled = spellings(words, self.scores, self.vocabulary)
        with np.errstate(divide="ignore"):
            seen = np.log10(held[:, 1:] + self.rest[1:] * held[:, :1])
        return np.logaddexp2(seen / math.log10(2), (spelled + np.log10(self.rest[0] * self.rest[1:])) / math.log10(2)) * math.log10(2)


def _lists(values: np.ndarray) -> pa.ListArray:
    width = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width), pa.int32()), pa.array(values.ravel(), pa.float64()))


def _priced(counts: DataFrame, model: Mixture) -> DataFrame:
    """``counts`` (word, c, c0 ..) as word, c, and the log10 probabilities of the word by kind."""
    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            c = np.stack([batch.column(i).to_numpy() for i in range(1, batch.num_columns)], axis=1).astype(float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _lists(model.words(batch.column(0).to_pylist(), c))], ["word", "c", "model"])

    return counts.mapInArrow(price, "word binary, c long, model array<double>")


def score_texts(docs: DataFrame, learn: Column | None = None, vocabulary: str | None = None, kind: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``learn`` marks training rows; ``kind`` names a column whose values tell kinds of training texts apart.
    """
    spark = docs.sparkSession
    training = docs.where(F.lit(True) if learn is None else learn)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    number, texts = kind_number(training, kind)
    kinds = len(texts)
    seen = cut_lineage(word_counts(training, number, kinds))
    columns = ["c", *(f"c{k}" for k in range(kinds))]
    found = seen.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for c in columns),
                     *(F.count(F.when(F.col(c) > 0, 1)).alias(f"v_{c}") for c in columns)).first()
    ends = np.array([sum(texts), *texts])
    tokens = np.array([found[f"n_{c}"] for c in columns]) + ends
    types = np.array([found[f"v_{c}"] for c in columns]) + (ends > 0)
    model = Mixture(tokens, types, texts, piece_scores(seen, vocabulary, kinds=kinds), vocabulary)
    n, width = int(tokens[0]), kinds

    # at most FREQUENT words of some 10 bytes each
    top = _priced(seen.orderBy(F.desc("c"), "word").limit(FREQUENT), model).toArrow().combine_chunks()
    values = np.array(top["model"].to_pylist(), float).reshape(-1, width)
    frequent = {w: i for i, w in enumerate(top["word"].to_pylist())}
    table = np.column_stack([model.base(top["c"].to_numpy().astype(float)), values])
    shared = spark.sparkContext.broadcast((frequent, table))
    end_known, end = int(sum(texts) > 0), np.concatenate([[model.base(np.float64(sum(texts)))], model.end])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, prices = shared.value
        place = places.get
        for batch in batches:
            new_row, new_word, new_times, own, sums = [], [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), bytes_of(batch, "text")):
                words = Counter(text.lower().split())
                times = np.fromiter(words.values(), np.int64, len(words))
                at = np.fromiter([place(w, -1) for w in words], np.int64, len(words))
                met = at >= 0
                if not met.all():
                    names = list(words)
                    unmet = np.flatnonzero(~met).tolist()
                    new_row.extend([row] * len(unmet))
                    new_word.extend([names[i] for i in unmet])
                    new_times.extend(times[unmet].tolist())
                own.append((int(times.sum()) + 1, int(times[met].sum()) + end_known))
                sums.append(times[met] @ prices[at[met]] + end)
            count = batch.num_rows
            if not count:
                continue
            # a row's own sums travel under a key that no text can hold
            own, sums = np.array(own, np.int64), np.array(sums)
            keys = [b"\xff" + row.to_bytes(8, "big", signed=True) for row in batch.column(0).to_pylist()]
            yield _parts(batch.column(0), pa.array(keys, pa.binary()), np.zeros(count, np.int64), batch.column(1),
                         own[:, 0], own[:, 1], sums[:, 0], _lists(sums[:, 1:]))
            for lo in range(0, len(new_row), 100_000):
                part = slice(lo, lo + 100_000)
                times = np.array(new_times[part], np.int64)
                zero = np.zeros(len(times), np.int64)
                yield _parts(pa.array(new_row[part], pa.int64()), pa.array(new_word[part], pa.binary()), times,
                             pa.nulls(len(times), pa.int64()), zero, zero, zero.astype(float),
                             pa.nulls(len(times), pa.list_(pa.float64())))

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            times = batch.column(2).to_numpy()
            c = batch.column(8).fill_null(0).to_numpy().astype(float)
            chance = np.zeros((batch.num_rows, width))
            for column in (7, 9):  # a row's own sums, words met in training
                has = np.flatnonzero(batch.column(column).is_valid().to_numpy(zero_copy_only=False))
                chance[has] = batch.column(column).flatten().to_numpy().reshape(-1, width)
            new = np.flatnonzero((times > 0) & (c == 0))
            if new.size:
                places: dict[bytes, int] = {}
                at = [places.setdefault(w, len(places)) for w in batch.column(1).take(pa.array(new)).to_pylist()]
                chance[new] = model.words(list(places), np.zeros((len(places), width + 1)))[at]
            words = times > 0
            own = ~words
            chance *= np.where(words, times, 1)[:, None]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(own.astype(np.int64)),
                 pa.array(np.where(words, times * 0, batch.column(4).to_numpy())),
                 pa.array(batch.column(5).to_numpy() + times * (c > 0)),
                 pa.array(np.where(words, times * model.base(c), batch.column(6).to_numpy())),
                 *(pa.array(chance[:, k]) for k in range(width))],
                ["row", "doc_id", "ends", "n_tokens", "n_known", "base", *kind_columns])

    kind_columns = [f"m{k}" for k in range(width)]
    bounded_batches(spark)
    parts = rows.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text").mapInArrow(split, _PARTS)
    priced = parts.join(_priced(seen, model).withColumnRenamed("model", "chance"), "word", "left").select(
        "row", "word", "times", "doc_id", "n_tokens", "n_known", "base", "model", "c", "chance").mapInArrow(
        price, "row long, doc_id long, ends long, n_tokens long, n_known long, base double, "
        + ", ".join(f"{m} double" for m in kind_columns))
    sums = priced.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("ends").alias("ends"), *(
        F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", *kind_columns)))
    # equal rows were added up: share the sums among them
    each = [F.col(m) / F.col("ends") for m in kind_columns]
    best = F.greatest(*each) if width > 1 else each[0]
    mixed = best + F.log10(sum((F.lit(share) * F.pow(F.lit(10.0), m - best) for share, m in zip(model.shares, each)), F.lit(0.0)))
    return sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("ends")))).select(
        "doc_id", F.expr("n_tokens div ends").alias("n_tokens"), F.expr("n_known div ends").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") / F.col("ends")).alias("base_score"), mixed.alias("score"))


_PARTS = ("row long, word binary, times long, doc_id long, n_tokens long, n_known long, base double, model array<double>")
_NAMES = [f.split()[0] for f in _PARTS.split(", ")]


def _parts(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], _NAMES)


def training_rows(modulus: int = 10) -> Column:
    return ~held_out(modulus)
