"""Toxicity, periodic runs and whitening against brute force, numpy and held-out rows."""

import hashlib
import math
import random
import zlib
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import eigen, op11_toxic, op12_runs, op13_whitening
from tidemark.llm.queries import QUERIES
from tidemark.llm.text import held_out

SCHEMA = "doc_id long, text string, score double, start long, words array<string>"


def frame(spark, rows):
    """The rows with columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, 0.5, 7, ["x"]) for r in rows], SCHEMA).repartition(4)


# ---- periodic runs

def brute_runs(words, least=24, exponent=3):
    """All stretches equal to themselves q places on, for every q; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((start, end - start, q) for (start, end), q in found.items())


def loops(rng, size):
    kinds, words = rng.choice([1, 2, 3, 5]), []
    while len(words) < size:
        words += [rng.randrange(kinds) for _ in range(rng.randint(1, 20))] * rng.randint(1, 6)
    return words


@pytest.mark.parametrize("least, exponent", [(24, 3), (1, 2), (6, 2), (4, 3), (2, 4), (40, 2)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(least + exponent)
    for _ in range(60):
        texts = [loops(rng, rng.choice([0, 5, 30, 150])) for _ in range(3)]
        got = op12_runs.runs_of([np.array(t, np.int64) for t in texts], least, exponent)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [brute_runs(t, least, exponent) for t in texts]


def test_words_may_arrive_one_by_one():
    rng = random.Random(5)
    for _ in range(40):
        words, catcher, at = np.array(loops(rng, 120)), op12_runs.Catcher(6, 2), 0
        while at < len(words):
            step = rng.choice([1, 1, 2, 17])
            catcher.append(words[at:at + step])
            at += step
            if rng.random() < 0.1:
                assert [tuple(r) for r in catcher.runs().tolist()] == brute_runs(words[:at].tolist(), 6, 2)
        assert [tuple(r) for r in catcher.runs().tolist()] == brute_runs(words.tolist(), 6, 2)


def test_wrong_hashes_are_caught(monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(op12_runs, "mix", lambda x: x & np.uint64(1))  # many words hash alike
    for _ in range(40):
        words = loops(rng, 100)
        assert [tuple(r) for r in op12_runs.runs_of([np.array(words)], 6, 2)[0].tolist()] == brute_runs(words, 6, 2)


def test_long_texts():
    assert op12_runs.runs_of([np.zeros(300_000, np.int64)])[0].tolist() == [[0, 300_000, 1]]
    loop = np.concatenate([np.arange(7), np.arange(100_000) % 33_333 + 9])
    assert op12_runs.runs_of([loop])[0].tolist() == [[7, 100_000, 33_333]]
    many = b" ".join([b"a b c"] * 500_000)  # over two pieces
    assert op12_runs._report([1], [many], None, 24, 3)[0][1:7] == (1_500_000, 1, 0, 1_500_000, 3, 500_000_000)


def brute_report(doc, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    listed = "".join("%d,%d,%d\n" % r for r in runs).encode()
    return (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())


def run_texts():
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{v}" for v in loops(rng, rng.choice([3, 40, 200])))) for i in range(60)]
    return rows + [(None, "a " * 60), (None, None), (200, None), (201, ""), (202, " \n\t "), (203, "é  è\n" * 30), (203, "é  è\n" * 30),
                   (204, "x"), (205, "a b " * 12 + "\n" + "a b " * 12)]


def test_run_report_equals_brute_force(spark, small):
    rows = run_texts()
    rows += [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect() if len(r.text) < 4000]
    report = op12_runs.run_report(frame(spark, rows), op12_runs.looped_tail).drop("n_words")
    key = lambda r: str(r)
    assert sorted((tuple(r) for r in report.collect()), key=key) == sorted((brute_report(*r) for r in rows), key=key)
    assert sum(r[1] > 0 for r in map(lambda r: brute_report(*r), rows)) > 20


def test_runs_as_rows_and_collapsed_texts(spark):
    rows = run_texts()
    got = sorted(tuple(r) for r in op12_runs.find_runs(frame(spark, [r for r in rows if r[0] is not None])).collect())
    assert got == sorted((d, *r) for d, t in rows if d is not None for r in brute_runs((t or "").split()))
    docs = frame(spark, rows)
    cut = op12_runs.collapse_runs(docs)
    assert cut.columns == docs.columns
    texts = {r.doc_id: r.text for r in cut.collect() if r.doc_id is not None}
    for doc, text in rows:
        words = (text or "").split()
        runs = brute_runs(words)
        dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
        if doc is not None:
            assert texts[doc] == (" ".join(w for i, w in enumerate(words) if i not in dropped) if runs else text)
    none = frame(spark, [])
    assert op12_runs.run_report(none).count() == op12_runs.find_runs(none).count() == op12_runs.collapse_runs(none).count() == 0


# ---- whitening

def test_leading_pairs_of_all_kinds_of_matrices():
    rng = np.random.default_rng(0)
    for case in range(150):
        n = int(rng.integers(1, 60))
        x = rng.normal(size=(n, n))
        a = x @ x.T
        if case % 5 == 1:  # equal eigenvalues, some below 0
            q, _ = np.linalg.qr(x)
            a = q @ np.diag(np.round(rng.normal(size=n))) @ q.T
            a = (a + a.T) / 2
        if case % 5 == 2:
            a = np.diag(rng.integers(0, 3, n).astype(float))
        if case % 5 == 3:  # low rank
            x = x[:, :max(1, n // 4)]
            a = x @ x.T * 1e6
        if case % 5 == 4:
            a = np.full((n, n), case % 2, float)
        values, vectors = eigen.leading_pairs(a, 8)
        expected = np.linalg.eigvalsh(a)[::-1][:8]
        size = max(np.abs(expected).max(), 1e-300) * n
        assert np.abs(values - expected).max() <= 1e-13 * size
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
        assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * size


def test_sturm_counts_are_numbers_of_smaller_eigenvalues():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        diagonal, below = rng.normal(size=n), rng.normal(size=n - 1) * (rng.random(n - 1) < 0.8)
        values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(below, 1) + np.diag(below, -1))
        at = rng.normal(size=40) * 2
        assert eigen.sturm_counts(diagonal, below, at).tolist() == (values[None, :] < at[:, None]).sum(axis=1).tolist()


def reference(vectors, components=8):
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(row[j] for row in x) for j in range(d)]
    y = np.array([[float(row[j] * n - sums[j]) / n for j in range(d)] for row in x])
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    deviations = [sum((n * row[j] - sums[j])**2 for j in range(d)) for row in x]
    return deviations, np.abs(y @ axes / np.sqrt(np.maximum(values, 1e-300))), values / np.trace(y.T @ y / n)


def whitened(spark, rows):
    table = spark.createDataFrame([(*r, 3.0, 1) for r in rows], "vec_id long, embedding array<float>, whitened double, n int")
    return op13_whitening.whiten_report(table.repartition(3))


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(2)
    good = [(i, (rng.normal(size=12) * np.arange(1, 13)).astype(np.float32).tolist()) for i in range(90)]
    good += [(5, good[5][1]), (None, good[6][1])]
    bad = [(900, None), (901, []), (902, [1.0] * 11), (903, [1.0] * 13), (904, [None] + [1.0] * 11),
           (905, [float("nan")] + [1.0] * 11), (906, [float("-inf")] + [1.0] * 11)]
    rows = whitened(spark, good + bad).collect()
    deviations, values, shares = reference([v for _, v in good])
    assert len(rows) == 8 * len(good) and {r.n for r in rows} == {len(good)}
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    for k, (doc, _) in enumerate(good):
        for component, found in by_id[doc].items():
            assert {r.deviation for r in found} == {deviations[k]} == {int(r.deviation_exact) for r in found}
            assert all(abs(r.whitened) == pytest.approx(values[k][component - 1], abs=1e-9) for r in found)
            assert all(r.explained == pytest.approx(shares[component - 1], rel=1e-9) for r in found)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9
    signs = {c: {np.sign(r.whitened) for r in rows if r.component == c} for c in range(1, 9)}
    assert all(s == {-1.0, 1.0} for s in signs.values())


def test_whitening_of_degenerate_tables(spark):
    assert whitened(spark, []).count() == 0
    assert whitened(spark, [(1, [1.0, 2.0])]).count() == 0
    assert whitened(spark, [(i, [1.0, 2.0]) for i in range(9)]).count() == 0
    line = whitened(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]).collect()
    assert len(line) == 9 and line[0].explained == pytest.approx(1) and line[0].identity_error < 1e-9
    pair = whitened(spark, [(1, [0.5, 0.5]), (2, [0.25, 0.75])]).collect()
    assert sorted(r.whitened for r in pair) == pytest.approx([-1, 1])


def test_large_entries_stay_exact(spark):
    table = spark.createDataFrame([(1, [2.0**30, 1.0]), (2, [-2.0**30, 0.5]), (3, [1e300, 0.0])], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r for r in op13_whitening.whiten_report(table, components=1).collect()}
    x = [[2**40 + 100_000, 101_024], [-2**40 + 100_000, 100_512], [2**53 + 100_000, 100_000]]
    for i, row in enumerate(x):
        exact = sum((3 * v - sum(other[j] for other in x))**2 for j, v in enumerate(row))
        assert rows[i + 1].deviation is None and rows[i + 1].deviation_exact == Decimal(exact)


# ---- toxicity

def test_risk_and_its_slopes():
    rng = np.random.default_rng(3)
    sides = set()
    for prior in (0.05, 0.3, 0.9):
        for shift in (-2, 3):
            zp, zu = rng.normal(shift, 1, 7), rng.normal(-shift, 1, 11)
            risk, gp, gu = op11_toxic.risk_slopes(zp, zu, prior)
            loss = lambda z: np.mean(np.log1p(np.exp(z)))
            negative = loss(zu) - prior * loss(zp)
            assert risk == pytest.approx(prior * loss(-zp) + max(0, negative))
            target = (lambda p, u: prior * loss(-p) + loss(u) - prior * loss(p)) if negative >= 0 else (
                lambda p, u: prior * loss(p) - loss(u))  # push the estimate back up
            sides.add(negative >= 0)
            for z, g, at in ((zp, gp, lambda v: target(v, zu)), (zu, gu, lambda v: target(zp, v))):
                for i in range(len(z)):
                    up, down = z.copy(), z.copy()
                    up[i] += 1e-6
                    down[i] -= 1e-6
                    assert g[i] == pytest.approx((at(up) - at(down)) / 2e-6, abs=1e-7)
    assert sides == {True, False}


def test_prior_of_known_mixtures():
    rng = np.random.default_rng(4)
    for share in (0.05, 0.2, 0.6):
        positive = rng.normal(3, 1, 4000)
        mixed = np.where(rng.random(20_000) < share, rng.normal(3, 1, 20_000), rng.normal(-3, 1, 20_000))
        assert op11_toxic.best_bin_prior(positive, mixed) == pytest.approx(share, rel=0.15)


def test_cut_of_least_risk():
    positive, unlabelled = np.array([2.0, 2.0, 2.0, -1.0]), np.array([-1.0] * 90 + [2.0] * 10)
    assert -1 < op11_toxic.least_risk_cut(positive, unlabelled, 0.13) < 2


def test_words_of_a_text():
    assert op11_toxic.words_of("IDIOT!! Idiot### naïve_x 日本 a1b".encode()) == {"idiot", "naïve", "x", "日", "本", "a", "b"}
    long = b"some words " * 300_000 + b"Last"
    assert op11_toxic.words_of(long) == {"some", "words", "last"}
    assert op11_toxic.words_of(b"") == set()


def toxic_table(seed=0, count=1500):
    """Texts of random words, one in six with one to three of four bad words; two thirds of them confirmed."""
    rng = random.Random(seed)
    rows, toxic = [], set()
    for i in range(count):
        words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randint(5, 60))]
        if rng.random() < 1 / 6:
            toxic.add(i)
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["Vile", "foul!!", "base###", "rank"]))
        rows.append((i, " ".join(words)))
    labels = [(i, int(i in toxic)) for i in range(count) if rng.random() < 2 / 3]
    return rows, toxic, labels


def test_toxic_texts_are_found(spark):
    rows, toxic, labels = toxic_table()
    labels += labels[:50] + [(None, 1), (3, None)]
    extra = [(None, "vile foul"), (9001, None), (9002, ""), (9003, "vile " * 300_000), (9004, rows[0][1]), (0, rows[0][1])]
    docs = frame(spark, rows + extra)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    model, prior = op11_toxic.fit(docs, marks, ~held_out(5))
    assert set(model.weights) == {"vile", "foul", "base", "rank"} and prior == pytest.approx(1 / 6, rel=0.3)
    got = {r.doc_id: r.score for r in op11_toxic.score_rows(docs, model).collect()}
    assert len(got) == len(rows) + 5 and all(0 <= s <= 1 for s in got.values())
    assert [i for i, _ in rows if (got[i] >= 0.5) != (i in toxic)] == []
    assert got[9001] == got[9002] < 0.5 and got[None] >= 0.5 and got[9003] >= 0.5 and got[9004] == got[0]
    kept = op11_toxic.toxic_filter(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i] < 0.5}


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    for labels in ([], [(1, 0)], [(None, 1)], [(1, 1)], [(77, 1)]):
        model, prior = op11_toxic.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert prior is None and [r.score for r in op11_toxic.score_rows(docs, model).collect()] == [0, 0]
    none = frame(spark, [])
    model, _ = op11_toxic.fit(none, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert op11_toxic.score_rows(none, model).count() == 0


def test_held_out_rows_are_told_apart(spark, small):
    folder = small.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = QUERIES["op11_toxic_scores"](spark, folder).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
