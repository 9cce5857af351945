"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import (op1_spots, op2_paths, op3_suffix, op4_bins, op5_lists, op6_pu, op7_lattice, op8_cascade,
                          op9_viterbi, op10_packing)
from tidemark.llm.components import components
from tidemark.llm.suffixes import permuted_common_prefixes, suffix_array
from tidemark.llm.text import held_out
from tidemark.llm.tokens import codec

SCHEMA = "doc_id long, text string, lang string, score double, kept string"
WORDS = [f"w{i}" for i in range(120)] + ["the", "of", "la", "é"]


def passages(seed=3, count=60):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    shared = [text(30) for _ in range(3)]
    rows = []
    for i in range(count):
        body = text(rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            body += " " + rng.choice(shared) + text(rng.randint(0, 9))
        rows.append((3 * i, body))
    for i in range(0, count, 4):
        words = rows[i][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((3 * i + 1, " ".join(words)))
    rows += [(900 + i, rows[i][1]) for i in range(0, count, 5)]
    return rows + [(None, "x y the a b c d"), (1000, None), (1001, ""), (1002, "He " * 300), (1003, "a" * 600),
                   (1004, "\n\n a\tb  c "), (1005, "a b"), (1006, " a  b"), (1007, "### " * 40), (1008, "日本語 テキスト ▁ x")]


@pytest.fixture(scope="module")
def rows():
    return passages()


def frame(spark, rows):
    """The rows with columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, "xx", 0.5, "k") for r in rows], SCHEMA).repartition(4)


def test_every_operator_takes_an_empty_table(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert op1_spots.edit_report(none).count() == 0
    assert op2_paths.class_report(none).count() == 0 and op2_paths.first_of_class(none).count() == 0
    assert op3_suffix.repeat_report(none).count() == 0 and op3_suffix.remove_repeats(none).columns == none.columns
    assert op4_bins.pack_matrices(none).count() == 0
    assert op6_pu.score_rows(none, op6_pu.fit(none, labels)[0]).count() == 0
    assert op6_pu.quality_filter(none, labels).columns == none.columns
    assert op7_lattice.score_texts(none).count() == 0
    assert op8_cascade.cascade_report(none).count() == 0 and op8_cascade.cascade_filter(none).columns == none.columns
    assert op9_viterbi.encode_documents(none).count() == 0
    assert op10_packing.pack_documents(none).count() == 0


def test_spots_of_edited_and_next_texts(spark, rows):
    got = {r.doc_id: r for r in op1_spots.edit_report(frame(spark, rows)).collect()}
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    for (doc, text), (following, more) in zip(ordered, ordered[1:] + ordered[:1]):
        half, row = len(text) // 2, got[doc]
        edited = text[:len(text) - half] + more[:half]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (collections.Counter(op1_spots.decode(f).tolist()) for f in (
            row.fingerprint, row.edited_fingerprint, got[following].fingerprint))
        assert row.near_edited == pytest.approx((a & b).total() / (a | b).total() if a or b else 1)
        assert row.near_next == pytest.approx((a & c).total() / (a | c).total() if a or c else 1)
    by_text = collections.defaultdict(set)
    for doc, text in ordered:
        by_text[text].add(got[doc].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert op1_spots.edit_report(frame(spark, [(5, "one two the three")])).first().near_next == 1


def test_long_texts_travel_in_batches_of_few_bytes(spark):
    texts = [f"w{i} the " * 12_000 + f"end{i}" for i in range(96)]
    docs = frame(spark, list(enumerate(texts)))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    for found in (op1_spots.edit_report(docs), op1_spots.fingerprints(docs)):
        got = found.select("fingerprint").coalesce(1).mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r.n for r in got) == len(texts) and sum(r.bytes for r in got) > 9_000_000
        assert max(r.bytes for r in got) < 5_000_000


def test_ends_of_ranges_meet_one_at_a_time():
    pairs = op1_spots._rim_pairs
    assert list(pairs(iter([]))) == []
    assert list(pairs(iter([(0, 5, b"x"), (1, 5, b"x")]))) == [(5, b"x", 5, b"x")]
    taken = []

    def ends():
        for i in range(50):
            for kind in (0, 1):
                taken.append(i)
                yield kind, 2 * i + kind * (i % 2), b"t%d%d" % (i, kind)

    expected = [(2 * i + i % 2, b"t%d1" % i, 2 * ((i + 1) % 50), b"t%d0" % ((i + 1) % 50)) for i in range(50)]
    for k, pair in enumerate(pairs(ends())):
        assert pair == expected[k] and len(taken) == min(2 * k + 3, 100)
    assert k == 49


def test_spots_of_texts_without_listed_common_words():
    spots = lambda t: op1_spots.spots(t.encode())
    words = [f"слово{chr(0x430 + i % 32)}{chr(0x430 + i // 32)}" for i in range(200)]
    chinese = "".join(chr(0x4E00 + 37 * i % 5000) for i in range(200))
    georgian = "".join(chr(0x10D0 + i * i % 33) for i in range(400))  # a run without blanks in a script that has them
    for whole, join, lo, hi in ((words, " ".join, 0.25, 0.45), (chinese, "".join, 0.25, 0.45), (georgian, "".join, 0.1, 0.9)):
        text, half = join(whole), len(whole) // 2
        assert 0.9 < op1_spots.likeness(spots(text), spots(join(["x1" + " " * (join == " ".join), *whole[1:]]))) < 1
        assert lo < op1_spots.likeness(spots(text), spots(join([*whole[:half], *[f"z{i} " for i in range(half)]]))) < hi
        assert len(spots(text)) > len(whole) // 4
    assert op1_spots.likeness(spots(" ".join(words[:9])), spots(" ".join(words[:2] + words[50:57]))) < 0.5
    for count in range(1, 30):  # no word is outside all spots
        for i in range(count):
            other = words[:count]
            other[i] = "другое"
            assert op1_spots.likeness(spots(" ".join(words[:count])), spots(" ".join(other))) < 1


def test_pruned_likeness_and_length_partitions():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (np.sort(rng.integers(0, 400, rng.integers(0, 900)).astype(np.uint32)) for _ in range(2))
        exact = op1_spots.likeness(a, b)
        for least in (0.2, 0.5, 0.9):
            assert op1_spots.likeness(a, b, least) == (exact if exact >= least else 0) or exact < least
    for least in (0.5, 0.8):
        for n in range(1, 300):
            for m in range(n, int(n / least) + 1):
                assert op1_spots.length_partition(m, least) - op1_spots.length_partition(n, least) <= 1


def plain_spots(text):
    """The spots of a text of short words in blanks, one anchor at a time."""
    whole, big = 2**64 - 1, xxhash.xxh3_64_intdigest

    def mixed(x):
        x = (x ^ x >> 31) * 0x9E3779B97F4A7C15 & whole
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & whole
        return x ^ x >> 32

    words = [w for w in (w.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in text.split()) if w]
    content = [i for i, w in enumerate(words) if w.encode() not in op1_spots.COMMON]
    chain = [max(2, big(words[i])) for i in content]
    anchors = [(1, 0, False)] if words else []
    anchors += [(big(w), sum(c < i for c in content), False) for i, w in enumerate(words) if i not in content]
    for at in sorted({min(range(j, j + 3), key=lambda k: (chain[k], k)) for j in range(len(content) - 2)
                      if content[j + 2] - content[j] == 2}):
        anchors.append((mixed(chain[at]), at + 1, True))
    kept = [a for a in anchors if a[1] < len(chain) or a[2]]
    if not any(a[1] < len(chain) for a in anchors):
        return sorted(mixed(state) >> 32 for state, _, _ in anchors)
    out = []
    for state, after, _ in kept:
        for k, value in enumerate(chain[after:after + 2]):
            state = mixed((state + value * (2 * k + 3)) & whole)
        out.append(state >> 32)
    return sorted(out)


def test_spots_one_anchor_at_a_time():
    rng = random.Random(6)
    pool = ["the", "of", "und", "la", "River", "stone,", "(light)", "42", "--", "éclair", "ab", "cd", "ef", "gh", "--x"]
    for size in [*range(12), *[60] * 40]:
        text = " ".join(rng.choice(pool) for _ in range(size))
        assert op1_spots.spots(text.encode()).tolist() == plain_spots(text)


def test_matches_of_stated_rows_equal_a_comparison_with_all(spark):
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 20
    rows = []
    for group in range(12):
        base = [rng.choice(pool) for _ in range(rng.choice([3, 8, 40, 200]))]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = rng.choice(pool)
            rows.append((len(rows), " ".join(words * rng.choice([1, 1, 1, 2]))))
    rows += [(500, None), (501, ""), (502, "the of"), (None, rows[0][1]), (0, rows[0][1]), (503, "same words " * 400),
             (504, "same words " * 390)]
    docs = frame(spark, rows).withColumn("print", F.lit(1)).withColumn("n", F.lit(2)).withColumn("token", F.lit(3))
    names = {r.doc_id: (r.print, r.fingerprint) for r in op1_spots.fingerprints(docs).select(
        "doc_id", "fingerprint", op1_spots.print_id().alias("print")).collect()}
    bags = {name: collections.Counter(op1_spots.decode(print_).tolist()) for name, print_ in names.values()}
    for condition, test, least in ((F.col("doc_id") % 7 == 0, lambda d: d is not None and d % 7 == 0, 0.8),
                                   (F.lit(True), lambda d: True, 0.8), (F.lit(True), lambda d: True, 0.45)):
        expected = {}
        for a in {names[d][0] for d in names if test(d)}:
            for b in bags:
                if a != b and bags[a] and bags[b]:
                    value = (bags[a] & bags[b]).total() / (bags[a] | bags[b]).total()
                    if value >= least:
                        expected[a, b] = value
        got = op1_spots.near_matches(docs, condition, least).collect()
        assert {(r.print, r.other): pytest.approx(r.likeness) for r in got} == expected
        assert len(got) == len(expected) > 10
    with pytest.raises(ValueError):
        op1_spots.near_matches(docs, F.lit(True), 1.0)
    assert op1_spots.near_matches(frame(spark, []), F.lit(True)).count() == 0


def brute_classes(rows, similarity=(4, 5)):
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        sets[doc] = (frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5
                     else frozenset([tuple(words)] if words else []))
    parent, links = {d: d for d in sets}, collections.Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(sets, key=lambda d: (d is not None, d or 0))
    for i, a in enumerate(order):
        for b in order[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and similarity[1] * both >= similarity[0] * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                if x != y:
                    parent[y if order.index(x) < order.index(y) else x] = x if order.index(x) < order.index(y) else y
    return {d: (find(d), links[d]) for d in sets}


@pytest.mark.parametrize("bucket, block", [(4096, 1024), (4, 3)])
def test_chosen_paths_find_every_link(spark, rows, monkeypatch, bucket, block):
    monkeypatch.setattr(op2_paths, "BLOCK_SETS", block)
    monkeypatch.setattr(op2_paths.candidate_edges, "__defaults__", (0.8, bucket))
    rows = [r for r in rows if r[0] is not None]
    got = {r.doc_id: (r.class_id, r.n_links) for r in op2_paths.class_report(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_classes_named_by_a_row_without_an_id(spark):
    text = " ".join(WORDS[:40])
    rows = [(None, text), (3, text), (4, text + " more"), (5, None), (None, None), (6, "other words " * 9)]
    got = {(r.doc_id, r.copy_of, r.class_id, r.n_links) for r in op2_paths.class_report(frame(spark, rows)).collect()}
    assert got == {(None, None, None, 2), (3, None, None, 2), (4, 4, None, 2), (5, 5, 5, 0), (None, None, None, 0), (6, 6, 6, 0)}


def test_hot_paths_are_counted_in_parts(spark):
    rows = spark.range(5000).select((F.col("id") % 5000).alias("key"), F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("path"))
    rows = rows.unionByName(spark.createDataFrame([(9000, 4500), (None, 7), (1, None)], "key long, path long"))
    got = {(r.path, r.many): r["count"] for r in op2_paths._counted(rows).groupBy("path", "many").count().collect()}
    assert got == {(7, 4000): 4000, (4500, 2): 2}


def test_one_row_of_each_class_stays(spark, rows):
    rows = [r for r in rows if r[0] is not None]
    kept = op2_paths.first_of_class(frame(spark, rows + rows[:7]))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    expected = brute_classes(rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (c, _) in expected.items() if c == d)


def test_a_common_length_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(op10_packing, "PART_PIECES", 50)
    pieces = spark.range(1000).select(
        F.when(F.col("id") > 0, F.col("id")).alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
        F.when(F.col("id") < 700, 64).otherwise(F.col("id") % 5 + 1).cast("long").alias("length"), F.col("id").alias("ids_crc32"))
    counts = np.bincount([64] * 700 + [i % 5 + 1 for i in range(700, 1000)], minlength=65)
    for most in (1_000_000, 0):
        monkeypatch.setattr(op10_packing, "MOST_BASES", most)
        ranked = op10_packing._ranked(pieces, counts).collect()
        for length in (1, 2, 3, 4, 5, 64):
            assert sorted(r["rank"] for r in ranked if r.length == length) == list(range(counts[length]))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_suffix_arrays_against_sorting():
    rng = np.random.default_rng(1)
    for trial in range(400):
        text = rng.integers(0, int(rng.choice([1, 2, 5, 250, 1000])), int(rng.integers(0, 60)))
        if trial % 4 == 0 and len(text):
            text = np.tile(text[:max(1, len(text) // 4)], 5)
        order = suffix_array(text)
        letters = text.tolist()
        assert order.tolist() == sorted(range(len(letters)), key=lambda i: letters[i:])
        if len(text):
            shared = permuted_common_prefixes(text, order)
            for a, b in zip(order[:-1], order[1:]):
                n = 0
                while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                    n += 1
                assert shared[b] == n


@pytest.mark.parametrize("hot", [2000, 3])
def test_repeats_are_cut_as_byte_by_byte(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(op3_suffix, "HOT", hot)
    expected, seen = {}, set()
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i:i + 100] in seen:
                gone[i:i + 100] = b"\1" * 100
            seen.add(data[i:i + 100])
        kept = bytes(x for x, f in zip(data, gone) if not f)
        expected[doc] = (len(data), len(data) - len(kept), sum(1 for s in bytes(gone).split(b"\0") if s),
                         hashlib.sha256(kept).hexdigest())
    docs = frame(spark, rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op3_suffix.repeat_report(docs).collect()}
    assert got == expected and sum(e[1] for e in expected.values()) > 1000
    cut = op3_suffix.remove_repeats(docs)
    assert cut.schema == docs.schema
    for r in cut.collect():
        if r.text.isascii():
            assert hashlib.sha256(r.text.encode()).hexdigest() == expected[r.doc_id][3]


def test_packed_matrices_give_the_texts_back(spark, rows):
    rng = random.Random(5)
    long = [(2000, " ".join(rng.choice(WORDS) for _ in range(9000)))]
    pieces = collections.defaultdict(dict)
    for r in op4_bins.pack_matrices(frame(spark, rows + long), pool=3000).collect():
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(places) == 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for k, (doc, start, length) in enumerate(zip(r.doc_ids, r.starts, r.lengths)):
            lo, hi = r.cu_seqlens[k], r.cu_seqlens[k + 1]
            assert hi - lo == length and places[lo:hi].tolist() == list(range(length))
            pieces[doc][start] = ids[lo:hi]
    for doc, text in rows + long:
        ids = np.concatenate([pieces[doc][s] for s in sorted(pieces[doc])])
        assert ids[-1] == 0 and codec().decode(ids[:-1].astype("<u4").tobytes()) == (text or "")


def test_room_tree_picks_the_least_room():
    rng = random.Random(2)
    for _ in range(200):
        tree, open_rooms = op4_bins.RoomTree(40), []
        for k in range(60):
            if rng.random() < 0.6:
                room = rng.randint(0, 40)
                tree.push(room, k)
                open_rooms.append(room)
            else:
                least = rng.randint(0, 40)
                fitting = sorted(r for r in open_rooms if r >= least)
                found = tree.take(least)
                assert (found[0] if found else None) == (fitting[0] if fitting else None)
                if found:
                    open_rooms.remove(found[0])


def test_dated_lists(spark):
    changes = [("a.com", 10, "add"), ("a.com", 20, "remove"), ("a.com", 20, "add"), ("b.org/x", 5, "add"), ("b.org/x", 5, "add"),
               ("c.net", 1, "remove"), ("c.net", 90, "add"), (None, 1, "add"), ("d.io", None, "add"), ("d.io", 1, None)]
    pages = [(1, "http://www.sub.a.com/p", 9), (2, "http://sub.a.com/p", 10), (3, "https://a.com", 19), (4, "https://a.com", 20),
             (5, "http://u@b.org:80/x/y?q#f", 100), (6, "http://b.org/xy", 100), (7, "HTTP://C.NET/", 89), (8, "http://c.net", 90),
             (9, None, 10), (10, "", 10), (11, "mailto:x@a.com", 12), (12, "http://d.io/", 5), (13, "http://a.com/", None)]
    got = {r.page_id: (r.blocked, r.first_key) for r in op5_lists.judge(
        spark.createDataFrame(pages, "page_id long, url string, day int"),
        spark.createDataFrame(changes, "key string, day int, action string")).collect()}
    assert {k for k, v in got.items() if v[0]} == {2, 3, 5, 8} and len(got) == len(pages)
    assert got[2][1] == "a.com" and got[5][1] == "b.org/x"
    nothing = op5_lists.judge(spark.createDataFrame(pages, "page_id long, url string, day int"),
                              spark.createDataFrame([], "key string, day int, action string"))
    assert nothing.where("blocked").count() == 0


def test_lists_cover_hosts_and_paths_of_any_depth(spark):
    deep, path = "a.b.c.d.e.f.g.example.com", "/1/2/3/4/5/6"
    changes = [(key, 1, "add") for key in ("example.com", deep, "x.org" + path, "y.org/1/2/3/4/5", "localhost", "com")]
    pages = [(1, f"http://{deep}/p"), (2, "http://x.org" + path), (3, "http://x.org/1/2/3/4/5/7"), (4, f"http://y.org{path}?q"),
             (5, "http://localhost:8080"), (6, "http://localhost/p"), (7, "http://other.com")]
    got = {r.page_id: (r.n_active, r.first_key) for r in op5_lists.judge(
        spark.createDataFrame([(*p, 5) for p in pages], "page_id long, url string, day int"),
        spark.createDataFrame(changes, "key string, day int, action string")).collect()}
    assert got == {1: (2, deep), 2: (1, "x.org" + path), 3: (0, None), 4: (1, "y.org/1/2/3/4/5"), 5: (1, "localhost"),
                   6: (1, "localhost"), 7: (0, None)}


def test_quality_scores_on_held_out_labels(spark, small):
    docs, labels = (spark.read.parquet(f"{small.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model, prior = op6_pu.fit(docs, labels, ~held_out(5))
    assert 0.5 < prior < 0.98
    scored = op6_pu.score_rows(docs, model).join(labels, "doc_id").where(held_out(5)).collect()
    right = sum((r.score >= 0.3) == (r.quality == 1) for r in scored)
    assert right >= 0.95 * len(scored)
    assert all(0 <= r.score <= 1 for r in op6_pu.score_rows(frame(spark, passages()), model).collect())


def test_lattice_sums_over_all_segmentations():
    found = op7_lattice.lattice()
    rng = np.random.default_rng(0)
    scores = found.normalised(rng.random(4 * len(found.texts)) + 0.1)
    number = {t: i for i, t in enumerate(found.texts)}

    def total(word, start=0):
        if start == len(word):
            return 1.0
        out = 0.0
        for end in range(start + 1, len(word) + 1):
            piece = number.get(word[start:end])
            if piece is not None:
                kind = (start > 0) + 2 * (end == len(word))
                out += math.exp(scores[piece + kind * len(found.texts)]) * total(word, end)
        return out

    words = [b"a", b"the", b"nation", b"xqzw", "été,".encode(), b"\xff\xfe"]
    assert op7_lattice.spellings(words, scores) == pytest.approx([math.log10(total(w)) for w in words])


def test_lattice_holds_every_piece():
    found = op7_lattice.lattice()
    pieces = {p.replace(op7_lattice.MARK, "").lower().encode() for p in op7_lattice.Pieces(None).score} - {b""}
    assert pieces <= set(found.texts)
    longest = max(pieces, key=len)
    letters = np.frombuffer(longest, np.uint8)[None].astype(np.uint64)
    assert len(longest) > 16 and (0, len(longest)) in {a[:2] for a in found.arcs(letters)}


def test_base_scores_and_counts(spark, rows):
    rows = rows + rows[:3]
    got = collections.defaultdict(list)
    for r in op7_lattice.score_texts(frame(spark, rows), ~held_out(10)).collect():
        got[r.doc_id].append(r)
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    counts = collections.Counter(w for d, t in rows if not out(d) for w in tokens(t))
    n, v = counts.total(), len(counts)
    assert sum(map(len, got.values())) == len(rows)
    for doc, text in rows:
        words = tokens(text)
        for r in got[doc]:
            assert (r.n_tokens, r.train_tokens, r.n_known) == (len(words), n, sum(counts[w] > 0 for w in words))
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
            assert r.score < 0


def test_mixture_of_kinds(spark):
    rows = [(1, "the cat the", "en", 1), (2, "the dog.", "en", 1), (3, "der hund der", "de", 1), (4, None, None, 1), (5, "", "de", 1),
            (6, "the der zug", "en", 0), (7, "der zug", None, 0), (8, "x" * 40 + " cat", "de", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, model int")
    got = {r.doc_id: r.score for r in op7_lattice.score_texts(docs, F.col("model") == 1, kind="lang").collect()}
    tokens = lambda t: (t or "").encode().split() + [None]
    kinds = [collections.Counter(w for _, t, k, m in rows if m and k == kind for w in tokens(t)) for kind in ("de", "en", None)]
    every = sum(kinds, collections.Counter())
    texts = [2, 2, 1]  # by size, then value: de and en tie
    number, sizes = op7_lattice.kind_number(docs.where("model = 1"), "lang")
    assert sizes == texts
    counts = op7_lattice.word_counts(docs.where("model = 1"), number, 3)
    scores = op7_lattice.piece_scores(counts, kinds=3)

    def share(count, word, total):
        return max(count[word] - 0.75, 0) / total

    for doc, text, _, _ in rows:
        sums = []
        for k, count in enumerate(kinds):
            rest, base = 0.75 * len(count) / count.total(), 0.75 * len(every) / every.total()
            spelled = lambda w: 0 if w is None else base * 10 ** op7_lattice.spellings([w], scores[k])[0]  # noqa: E731, B023
            sums.append((texts[k] + 1) / 8 * math.prod(
                share(count, w, count.total()) + rest * (share(every, w, every.total()) + spelled(w)) for w in tokens(text)))
        assert got[doc] == pytest.approx(math.log10(sum(sums)))


def brute_measures(text):
    words = text.encode().split()
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(inside))


def test_rules_and_measures(spark, rows):
    docs = frame(spark, rows)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    report = {r.doc_id: r for r in op8_cascade.cascade_report(docs, measures=names).collect()}
    for doc, text in rows:
        assert tuple(report[doc][n] for n in names) == brute_measures(text or "")
    orders = [op8_cascade.RULES, op8_cascade.RULES[::-1]]
    kept = [{r.doc_id for r in op8_cascade.cascade_filter(docs, o).collect()} for o in orders]
    assert kept[0] == kept[1] == {d for d, r in report.items() if r.kept}
    assert 1007 not in kept[0] and 1002 not in kept[0] and all(report[d].failed_rule is None for d in kept[0])


def test_rules_stop_at_the_first_rejection():
    failed, ran = op8_cascade.run_rules(op8_cascade.Measures([b"a", b"x " * 99, b" ".join(b"w%d" % i for i in range(40))]),
                                        op8_cascade.RULES)
    assert failed.tolist() == [0, 1, -1] and ran.tolist() == [1, 2, len(op8_cascade.RULES)]


def test_streaming_viterbi(spark, rows):
    pieces = op9_viterbi.codec().pieces
    rng = random.Random(1)
    texts = [t or "" for _, t in rows] + ["".join(rng.choice("ab thé日▁\n") for _ in range(rng.randint(0, 150))) for _ in range(60)]

    def best(chars):
        score = [0.0] + [-math.inf] * len(chars)
        for end in range(1, len(chars) + 1):
            score[end] = score[end - 1] + pieces.byte_score * len(chars[end - 1][-1].encode())
            for start in range(max(0, end - pieces.longest), end):
                if all(len(c) == 1 for c in chars[start:end]) and "".join(chars[start:end]) in pieces.score:
                    score[end] = max(score[end], score[start] + pieces.score["".join(chars[start:end])][0])
        return score[-1]

    price = lambda ids: sum(pieces.byte_score if i in pieces.byte_of else pieces.score[pieces.text[i]][0] for i in ids)
    for text in texts:
        coded = op9_viterbi.codec().encode(text)
        chars = ["▁" if c == " " else "\0" + c if c == "▁" else c for c in " " + text] if text else []
        assert op9_viterbi.codec().decode(coded) == text
        assert price(np.frombuffer(coded, "<u2").tolist()) == pytest.approx(best(chars))
        assert price(op9_viterbi.stream_ids(iter(chars), pieces)) == pytest.approx(best(chars))
    docs = frame(spark, rows)
    back = op9_viterbi.decode_documents(op9_viterbi.encode_documents(docs))
    assert {(r.doc_id, r.text) for r in back.collect()} == {(d, t or "") for d, t in rows}


def test_streaming_viterbi_holds_a_window():
    pieces = op9_viterbi.codec().pieces
    given = 0

    def chars():
        nonlocal given
        for c in "thenationofwater" * 200:
            given += 1
            yield c

    lag, emitted = 0, 0
    for ident in op9_viterbi.stream_ids(chars(), pieces):
        lag = max(lag, given - emitted)
        emitted += 1 if ident in pieces.byte_of else len(pieces.text[ident])
    assert emitted == 3200 and lag <= 8 * pieces.longest


def test_packing_is_whole_and_dense(spark, rows):
    rng = random.Random(5)
    long = [(2000, " ".join(rng.choice(WORDS) for _ in range(9000)))]
    rows = rows + long + rows[:3]
    got = op10_packing.pack_documents(frame(spark, rows)).collect()
    times = collections.Counter(d for d, _ in rows)
    for doc, text in set(rows):
        ids = np.append(np.frombuffer(codec().encode(text or ""), "<u4"), 0).astype("<u4")
        mine = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == doc})
        assert sum(r.doc_id == doc for r in got) == times[doc] * len(mine)
        assert [m[0] for m in mine] == list(range(len(mine))) and sum(m[2] for m in mine) == len(ids)
        assert all(m[2] == 2048 for m in mine[1:])
        for _, start, length, crc in mine:
            assert zlib.crc32(ids[start:start + length].tobytes()) == crc
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in got) // 2048) + 1


def best_count(lengths, size):
    """Fewest sequences, by trying all placements."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= lengths[i] and room not in rooms[:k]:
                place(i + 1, [*rooms[:k], room - lengths[i], *rooms[k + 1:]])
        place(i + 1, [*rooms, size - lengths[i]])

    place(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(0)
    for _ in range(150):
        size = int(rng.integers(5, 30))
        lengths = rng.integers(1, size + 1, int(rng.integers(0, 11)))
        counts = np.bincount(lengths, minlength=size + 1)
        plan, left = op10_packing.Plan(size), counts.copy()
        op10_packing.reduce_dominated(left, plan)
        rest = np.repeat(np.arange(size + 1), left).tolist()
        assert plan.sequences + best_count(rest, size) == best_count(lengths.tolist(), size)
        assert op10_packing.make_plan(counts, size).sequences >= best_count(lengths.tolist(), size)


def test_ids_of_plain_text_equal_the_tokenizers_ids(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True  # ``encode`` takes text without added tokens; the test below has them
    texts = [t or "" for _, t in rows] + ["a\n\nb", "x  y", " lead", "trail ", "tab\tx\r\ny", "don't I'll", " x y", "<|endoftext|> z"]
    for text in texts:
        ids = codec().encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
        assert codec().decode(ids) == text


def test_ids_equal_those_of_tokenizers_as_it_is(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> z", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\n y", "<|endoftext| >", "end  <|endoftext|>é", "plain", ""]
    expected = {i: whole.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert len(expected[0]) == 4 and 50256 in expected[0]
    for i, text in enumerate(texts):
        ids = codec().encode_text(text)
        assert np.frombuffer(ids, "<u4").tolist() == expected[i] and codec().decode(ids) == text
    docs = frame(spark, list(enumerate(texts)))
    for r in op10_packing.pack_documents(docs).collect():
        ids = np.array([*expected[r.doc_id], 0], "<u4")
        assert (r.start, r.length, r.ids_crc32) == (0, len(ids), zlib.crc32(ids.tobytes()))
    for r in op4_bins.pack_matrices(docs).collect():
        ids = np.frombuffer(r.ids, "<u2")
        for k, doc in enumerate(r.doc_ids):
            assert ids[r.cu_seqlens[k]:r.cu_seqlens[k + 1]].tolist() == [*expected[doc], 0]


def test_ids_beyond_16_bits_are_kept(spark, monkeypatch, tmp_path):
    """A vocabulary of the 256 bytes and one pair, whose rank does not fit 16 bits."""
    import base64

    path = tmp_path / "large.tiktoken"
    ranks = [(bytes([b]), b) for b in range(256)] + [(b"qz", 70_000)]
    path.write_bytes(b"".join(base64.b64encode(w) + b" %d\n" % r for w, r in ranks))
    docs = frame(spark, [(1, "qz a"), (2, None)])
    (row,) = op4_bins.pack_matrices(docs.coalesce(1), size=16, vocabulary=str(path)).collect()
    ids, places = np.frombuffer(row.ids, "<u4"), np.frombuffer(row.positions, "<u2")
    assert len(ids) == len(places) == 16 and 70_000 in ids.tolist() and 4464 not in ids.tolist()
    (row,) = op4_bins.pack_matrices(docs.coalesce(1), size=70_000).collect()
    assert np.frombuffer(row.positions, "<u4").max() > 1 << 16 and len(np.frombuffer(row.ids, "<u2")) == 70_000


def test_lengths_that_windows_cannot_hold_are_refused(spark, rows):
    docs = frame(spark, rows[:3])
    for length in (20, 39, 287, 300):
        with pytest.raises(ValueError, match="length must be"):
            op3_suffix.remove_repeats(docs, length)


@pytest.mark.parametrize("length", [40, 64, 286])
def test_other_lengths_equal_brute_force(spark, length):
    rng = random.Random(length)
    shared = [bytes(rng.choices(b"abc ", k=length + 30)).decode() for _ in range(2)]
    table = [(i, "".join(rng.choice([*shared, "xy" * rng.randint(0, 9)]) for _ in range(rng.randint(0, 4)))) for i in range(25)]
    table.append((99, "z" * (2 * length + 7)))
    seen, expected = set(), {}
    for doc, text in table:
        marks = bytearray(len(text))
        for at in range(len(text) - length + 1):
            part = text[at:at + length]
            if part in seen:
                marks[at:at + length] = b"\x01" * length
            seen.add(part)
        expected[doc] = "".join(c for c, m in zip(text, marks) if not m)
    got = {r.doc_id: r.text for r in op3_suffix.remove_repeats(frame(spark, table), length).collect()}
    assert got == expected
