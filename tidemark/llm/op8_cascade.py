"""Quality rules as a short-circuit cascade.

Each rule reads a few measures of a text and rejects it or lets it pass. A sample gives each rule's cost and rejections;
rules run in the order of rejections per second, and a text that one rule rejects is not measured for the later ones. The
order decides how much work is done, never which texts are kept.

Null and empty texts have no words, so the rule on short texts rejects them. Repeated rows get equal verdicts. An empty
table gives an empty result. Columns other than ``doc_id`` and ``text`` are neither read nor changed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import bounded_batches, bytes_of, mix, slices, word_ids

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WINDOW = 8
SAMPLE_ROWS = 2000
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_NOT_CHARS = bytes(range(0x80, 0xC0)) + BLANKS


def repeated_words(words: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """For each text, its words that stand in a window of ``window`` words found twice or more in the text."""
    ids, row = word_ids(words)
    out = np.zeros(len(words), np.int64)
    starts = len(ids) - window + 1
    if starts < 1:
        return out
    first = np.flatnonzero(row[:starts] == row[window - 1:])
    if not first.size:
        return out
    key = mix(row[first].astype(np.uint64) + np.uint64(1))
    for k in range(window):
        key = mix(key + ids[first + k].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    a, b = first[order[same]], first[order[same + 1]]
    truly = row[a] == row[b]
    for k in range(window):
        truly &= ids[a + k] == ids[b + k]
    if not truly.all():  # two windows share a key: compare the words themselves
        columns = np.stack([row[first], *(ids[first + k] for k in range(window))])
        order = np.lexsort(columns[::-1])
        equal = (columns[:, order[1:]] == columns[:, order[:-1]]).all(axis=0)
        same = np.flatnonzero(equal)
        a, b = first[order[same]], first[order[same + 1]]
    step = np.zeros(len(ids) + 1, np.int64)
    begin = np.unique(np.concatenate([a, b]))
    step[begin] += 1
    step[begin + window] -= 1
    return np.bincount(row[np.cumsum(step[:-1]) > 0], minlength=len(words)).astype(np.int64)


class Measures:
    """Measures of the texts of a slice, each computed when it is first asked for, for the rows asked for."""

    def __init__(self, texts: list[bytes]):
        self.texts, self._values, self._words = texts, {}, [None] * len(texts)

    def words(self, i: int) -> list[bytes]:
        if self._words[i] is None:
            self._words[i] = self.texts[i].split()
        return self._words[i]

    def get(self, name: str, rows: np.ndarray) -> np.ndarray:
        values, known = self._values.setdefault(
            name, (np.zeros(len(self.texts), np.int64), np.zeros(len(self.texts), bool)))
        todo = rows[~known[rows]]
        if todo.size:
            values[todo] = getattr(self, f"_{name}")(todo.tolist())
            known[todo] = True
        return values[rows]

    def _n_words(self, rows):
        return [len(self.words(i)) for i in rows]

    def _word_chars(self, rows):
        return [len(self.texts[i].translate(None, _NOT_CHARS)) for i in rows]

    def _n_symbols(self, rows):
        return [len(t) - len(t.translate(None, SYMBOLS)) for t in (self.texts[i] for i in rows)]

    def _n_lines(self, rows):
        return [sum(1 for x in self.texts[i].split(b"\n") if x.strip()) for i in rows]

    def _n_dup_lines(self, rows):
        lines = ([x for x in self.texts[i].split(b"\n") if x.strip()] for i in rows)
        return [len(x) - len(set(x)) for x in lines]

    def _n_repeat_words(self, rows):
        return repeated_words([self.words(i) for i in rows])

    def _n_upper(self, rows):
        return [len(t) - len(t.translate(None, _UPPER)) for t in (self.texts[i] for i in rows)]

    def _n_lower(self, rows):
        return [len(t) - len(t.translate(None, _LOWER)) for t in (self.texts[i] for i in rows)]


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the measures named in ``needs``, one array each."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., np.ndarray]


#: The first two are the base rules; the others follow published web-text heuristics with wide bounds.
RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 20),
    Rule("repeats", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 30 * n),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 20 * n)),
    Rule("line_copies", ("n_dup_lines", "n_lines"), lambda d, n: 2 * d > n),
    Rule("capitals", ("n_upper", "n_lower"), lambda u, w: 10 * u > 6 * (u + w)),
)


def run_rules(measures: Measures, rules: tuple[Rule, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Position of the rule that rejects each text (-1: kept) and the number of rules run on it."""
    n = len(measures.texts)
    failed, ran, alive = np.full(n, -1), np.zeros(n, np.int64), np.arange(n)
    for k, rule in enumerate(rules):
        if not alive.size:
            break
        ran[alive] += 1
        bad = rule.rejects(*(measures.get(name, alive) for name in rule.needs))
        failed[alive[bad]] = k
        alive = alive[~bad]
    return failed, ran


def plan_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """Rules by rejections per second on a sample of about ``sample_rows`` rows, measured where the rows are."""
    bounded_batches(docs.sparkSession)
    total = docs.count()
    if not total:
        return rules
    share = min(1.0, sample_rows / total)
    sample = docs.select("text").where(F.rand(7) < share)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_of(batch, "text")
            for lo, hi in slices(texts):
                rows = np.arange(hi - lo)
                out = []
                for rule in rules:
                    start, fresh = time.perf_counter(), Measures(texts[lo:hi])
                    bad = rule.rejects(*(fresh.get(name, rows) for name in rule.needs))
                    out.append((rule.name, float(bad.sum()), time.perf_counter() - start))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["rule", "rejected", "seconds"])

    seen = (sample.mapInArrow(measure, "rule string, rejected double, seconds double")
            .groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds")).collect())
    gain = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in seen}
    return tuple(sorted(rules, key=lambda r: -gain.get(r.name, 0.0)))


def cascade_report(docs: DataFrame, rules: tuple[Rule, ...] | None = None,
                   measures: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept, failed_rule (null if kept), rules_run, and the ``measures`` named, for every row."""
    rules = rules or plan_order(docs)
    bounded_batches(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([r.name for r in rules] + [None], dtype=object)
        for batch in batches:
            texts, at = bytes_of(batch, "text"), 0
            for lo, hi in slices(texts):
                part, rows = Measures(texts[lo:hi]), np.arange(hi - lo)
                failed, ran = run_rules(part, rules)
                columns = [batch.column(0).slice(at, hi - lo), pa.array(failed < 0), pa.array(names[failed], pa.string()),
                           pa.array(ran, pa.int64()), *(pa.array(part.get(m, rows), pa.int64()) for m in measures)]
                at += hi - lo
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "kept", "failed_rule", "rules_run", *measures])

    schema = "doc_id long, kept boolean, failed_rule string, rules_run long" + "".join(f", {m} long" for m in measures)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(judge, schema)


def cascade_filter(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects. Nothing is shuffled."""
    rules = rules or plan_order(docs)
    bounded_batches(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_of(batch, "text")
            for lo, hi in slices(texts):
                failed, _ = run_rules(Measures(texts[lo:hi]), rules)
                yield batch.slice(lo, hi - lo).filter(pa.array(failed < 0))

    return docs.mapInArrow(keep, docs.schema)
