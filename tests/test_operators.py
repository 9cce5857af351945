import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, indicators, joins, models, quality, reshape, rows, selection


def test_null_safe_joins(spark):
    left = spark.createDataFrame([(1, None, 10), (1, "x", 11), (2, "y", 12)], "k int, b string, v int")
    right = spark.createDataFrame([(1, None, 100), (3, None, 300)], "k int, b string, w int")
    keys = ["k", "b"]
    assert [r.v for r in joins.join_keys(left, right, keys).collect()] == [10]
    assert {r.v for r in joins.join_keys(left, right, keys, "left_anti").collect()} == {11, 12}
    full = {(r.k, r.b): (r.v, r.w) for r in joins.join_keys(left, right, keys, "full").collect()}
    assert full == {(1, None): (10, 100), (1, "x"): (11, None), (2, "y"): (12, None), (3, None): (None, 300)}
    with pytest.raises(ValueError):
        joins.join_keys(left, left, keys)


def test_anti_identical_keeps_copies_against_reference(spark):
    random.seed(3)
    cells = [None, 1, 2]
    data = [(random.choice(cells), random.choice(cells)) for _ in range(60)]
    gone = [(None, 1), (2, None), (2, None)]
    df, removed = (spark.createDataFrame(d, "a int, b int") for d in (data, gone))
    got = Counter((r.a, r.b) for r in joins.anti_identical(df, removed).collect())
    assert got == Counter(d for d in data if d not in gone)


def test_rule_wildcards(spark):
    df = spark.createDataFrame([("a", "p", 1), ("a", "q", 1), ("b", "p", 2), ("b", None, 2)], "k string, p string, d int")
    rules = spark.createDataFrame([("a", "p", None), ("b", None, 2)], "k string, p string, d int")
    assert [(r.k, r.p) for r in joins.anti_rules(df, rules, ["k"], ["p", "d"]).collect()] == [("a", "q")]


@pytest.mark.parametrize("size, span", [(7, 5), (1000, 40), (12001, 10**9), (20000, 3)])
def test_exact_median_with_a_hot_group(spark, size, span):
    random.seed(size)
    data = [(random.choice(["hot", "hot", "a", None]), float(random.randrange(span))) for _ in range(size)]
    data.append(("lonely", None))
    groups = defaultdict(list)
    for k, v in data:
        if v is not None:
            groups[k].append(v)
    out = aggregates.exact_median(spark.createDataFrame(data, "k string, v double"), ["k"], "v", "m", count="n")
    assert {r.k: (r.m, r.n) for r in out.collect()} == {k: (statistics.median(v), len(v)) for k, v in groups.items()}


def test_percent_rounds_half_to_even(spark):
    df = spark.createDataFrame([("a",)] * 1 + [("b",)] * 39, "k string")
    assert {r.k: r.percent for r in aggregates.percent_share(df, ["k"]).collect()} == {"a": 2.0, "b": 98.0}


def test_endpoints(spark):
    df = spark.createDataFrame([("a", 60, 1.0), ("a", 300, 9.0), ("b", 70, 2.0), ("b", 340, 4.0), ("c", 66, 5.0)],
                               "k string, d int, v double")
    assert aggregates.endpoint_median(df, ["k"], "d").first().median == 66
    assert aggregates.endpoint_median(df, ["k"], "d", last=True).first().median == 300
    assert aggregates.endpoint_max(df, ["k"], "d", "v").first().bound == 9.0
    assert aggregates.endpoint_max(df, ["k"], "d", "v", last=False).first().bound == 5.0


def days(spark, data):
    return spark.createDataFrame(data, "g string, date string, v int").withColumn("date", F.col("date").cast("date"))


def test_bounds_ties_and_ranks(spark):
    df = days(spark, [("a", "2010-01-01", 1), ("a", "2010-01-01", 2), ("a", "2010-02-01", 3), ("a", "2010-03-01", 4),
                      (None, "2010-05-01", 5)])
    vs = lambda out: sorted(r.v for r in out.collect())
    assert vs(selection.rows_at_bound(df, ["g"], "date")) == [1, 2, 5]
    assert vs(selection.rows_at_bound(df, ["g"], "date", last=True)) == [4, 5]
    assert vs(selection.rows_at_nth_latest(df, ["g"], "date", 2)) == [3]
    assert vs(selection.first_day_only_where(df, ["g"], "date", F.col("g") == "a")) == [1, 2, 5]


def test_measures_are_gated_each_by_its_own_rows(spark):
    df = spark.createDataFrame(
        [("a", f"2000-0{m}-01", float(m), float(m) if m > 2 else None) for m in (1, 2, 3)] + [("b", "2000-01-01", None, 1.0)],
        "g string, date string, x double, y double").withColumn("date", F.col("date").cast("date"))
    present = {c: F.col(c).isNotNull() for c in ("x", "y")}
    out = selection.gate_measures(df, ["g"], present, 2, 3)
    assert sorted((r.g, r.date.month, r.x, r.y) for r in out.collect()) == [
        ("a", 1, 1.0, None), ("a", 2, 2.0, None), ("a", 3, 3.0, None)]
    single = selection.gate_measures(df, ["g"], {"y": present["y"]}, 1)
    assert sorted((r.g, r.y) for r in single.collect()) == [("a", 3.0), ("b", 1.0)]


def test_gates(spark):
    rows_ = [("n3", f"2010-{m:02}-01", m) for m in (3, 6, 11)] + [("sept", f"2010-{m:02}-01", m) for m in (3, 4, 6, 9)] \
        + [("ok", f"2010-{m:02}-01", m) for m in (3, 4, 6, 10)]
    df = days(spark, rows_)
    for gate in (selection.gate_rows, selection.gate_days):
        assert {r.g for r in gate(df, ["g"], 4, 10).collect()} == {"ok"}
        assert {r.g for r in gate(df, ["g"], 4).collect()} == {"sept", "ok"}
        assert {r.g for r in gate(df, ["g"], 0, 10).collect()} == {"n3", "ok"}


def test_best_rows_keep_ties_and_skip_unknown(spark):
    df = spark.createDataFrame([("a", "L", 1.0), ("a", "G", 1.0), ("b", "L", None), ("b", "G", 5.0), ("c", "L", None)],
                               "g string, m string, aic double")
    assert sorted((r.g, r.m) for r in selection.best_rows(df, ["g"], "aic").collect()) == [("a", "G"), ("a", "L"), ("b", "G")]


def test_pivot_and_back(spark):
    data = [("a", "p", 1.0), ("a", "q", 2.0), ("b", "q", 3.0), ("b", "q", 4.0)]
    df = spark.createDataFrame(data, "g string, p string, v double")
    counts = {r.g: (r.p, r.q) for r in reshape.pivot_counts(df, ["g"], "p", ["p", "q"]).collect()}
    assert counts == {"a": (1, 1), "b": (None, 2)}
    assert [(r.g, r.p, r.n) for r in reshape.crowded_cells(df, ["g"], "p").collect()] == [("b", "q", 2)]
    unique = df.filter("v < 4")
    wide = reshape.pivot_values(unique, ["g"], "p", "v", ["p", "q"])
    back = reshape.unpivot_measures(wide, ["g"], ["p", "q"], "p", "v").filter("v IS NOT NULL")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, unique.collect()))
    nested = reshape.nest_days(df, ["g"], "p", ["v"])
    assert sorted(map(tuple, reshape.unnest_days(nested, ["g"]).collect())) == sorted(data)


def test_other_parameters_are_counted(spark):
    df = spark.createDataFrame([("a", "p"), ("a", "new"), ("a", None), ("b", "q"), ("b", "q")], "g string, p string")
    assert reshape.frequent_values(df, "p", 2) == ["new", "q"]
    got = {r.g: (r.q, r.other) for r in reshape.pivot_counts(df, ["g"], "p", ["q"], "other").collect()}
    assert got == {"a": (None, 3), "b": (2, None)}


def test_nested_series_are_bounded_and_lossless(spark):
    hot = [("hot", 5, float(i % 7), "x") for i in range(500)] + [("hot", d, 1.0, None) for d in range(40)]
    few = [(None, None, 2.0, "y")] * 3 + [("g", d, 0.5, "z") for d in (3, 1, 1, 2)]
    df = spark.createDataFrame(hot + few, "g string, day int, v double, t string").repartition(6)
    for most in (40, 7, 1, 10_000):
        nested = reshape.nest_days(df, ["g"], "day", ["v", "t"], most).cache()
        sizes = nested.select(F.size("series")).collect()
        assert max(r[0] for r in sizes) <= max(most, 1)
        assert Counter(map(tuple, reshape.unnest_days(nested, ["g"]).collect())) == Counter(hot + few)
        days = [[p.day for p in r.series] for r in nested.filter("g = 'g'").orderBy("chunk").collect()]
        assert [d for part in days for d in part] == [1, 1, 2, 3]
    assert reshape.nest_days(df, ["g"], "day", ["v"], 10_000).filter("g = 'hot'").count() == 1
    assert reshape.nest_days(df.limit(0), ["g"], "day", ["v"]).count() == 0


def test_crowded_cells_come_with_the_pivot(spark):
    df = spark.createDataFrame([("a", "p", 1.0), ("a", "p", 5.0), ("a", "q", 2.0), ("b", "q", None), ("b", "q", 3.0), ("c", "x", 1.0)],
                               "g string, p string, v double")
    wide = reshape.pivot_cells(df, ["g"], "p", "v", ["p", "q"])
    assert {(r.g, r.p, r.q) for r in wide.collect()} == {("a", 5.0, 2.0), ("b", None, 3.0), ("c", None, None)}
    assert sorted(map(tuple, reshape.set_aside(wide, ["g"]).collect())) == [("a", "p", 2, 1.0, 5.0), ("b", "q", 2, 3.0, 3.0)]


def test_row_generation(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, b string")
    copied = rows.copy_edit(df, [(F.col("n") == 1, {"b": F.lit("z")}), (F.col("b") == "a", {"n": F.lit(9)})])
    assert Counter(map(tuple, copied.collect())) == Counter([(1, "a"), (1, "z"), (9, "a"), (2, None)])
    swapped = rows.replace_rows(df, F.col("b") == "a", [{"n": F.lit(7)}, {"n": F.lit(8)}])
    assert sorted(map(str, map(tuple, swapped.collect()))) == ["(2, None)", "(7, 'a')", "(8, 'a')"]
    assert sorted(r.b for r in rows.repeat_as(df, "b", ["x", "y"]).collect()) == ["x", "x", "y", "y"]


@pytest.mark.parametrize("times", [0, 1, 99_999, 100_000, 100_001, 250_000])
def test_repeat_rows(spark, times):
    df = spark.createDataFrame([(1, times)], "v int, n long")
    assert rows.repeat_rows(df, "n").count() == times


def cumulative(spark, visits):
    df = spark.createDataFrame(visits, "bag string, date string, dead double, alive double").withColumn(
        "date", F.col("date").cast("date"))
    out = indicators.cumulative_rate(df, ["bag"], "date", "dead", "alive")
    return {(r.bag, str(r.date)): (r.mi, r.mc) for r in out.collect()}


def test_cumulative_rate_by_hand(spark):
    got = cumulative(spark, [
        ("a", "2010-01-01", 0.0, 10.0), ("a", "2010-02-01", 5.0, 5.0), ("a", "2010-03-01", 0.0, 5.0),
        ("a", "2010-04-01", 5.0, 0.0), ("a", "2010-05-01", 0.0, 3.0), ("b", "2010-01-01", 1.0, 9.0),
        ("b", "2010-02-01", 0.0, 0.0), ("b", "2010-03-01", 2.0, 8.0)])
    assert [got["a", f"2010-0{m}-01"][1] for m in range(1, 6)] == [0, .5, .5, 1, 1]
    assert got["b", "2010-02-01"] == (None, None)
    assert got["b", "2010-03-01"][1] == pytest.approx(0.28)


def test_cumulative_rate_against_recursion(spark):
    random.seed(5)
    visits, expected = [], {}
    for b in range(12):
        mc = 0.0
        for d in range(40):
            dead, alive = float(random.choice([0, 0, 1, 3])), float(random.randrange(1, 20))
            day = f"20{10 + d // 12:02}-{d % 12 + 1:02}-15"
            visits.append((str(b), day, dead, alive))
            mc = 1 - (1 - mc) * (1 - dead / (dead + alive))
            expected[str(b), day] = mc
    random.shuffle(visits)
    got = cumulative(spark, visits)
    assert {k: v[1] for k, v in got.items()} == pytest.approx(expected, abs=1e-12)
    for b in range(12):
        series = [got[k][1] for k in sorted(got) if k[0] == str(b)]
        assert all(0 <= x <= 1 for x in series) and series == sorted(series)


def observations(spark, data):
    return spark.createDataFrame(data, "g string, bag string, date string, p string, v double").withColumn(
        "date", F.col("date").cast("date"))


def test_masses(spark):
    df = observations(spark, [
        ("a", "1", "2010-03-01", "total", 100.0), ("a", "1", "2010-03-01", "alive", 10.0),
        ("a", "2", "2010-03-01", "total", 60.0), ("a", "2", "2010-03-01", "alive", 3.0),
        ("a", "3", "2010-03-01", "total", 0.0), ("a", "3", "2010-03-01", "alive", 0.0),
        ("a", "1", "2010-04-01", "total", 9.0)])
    mass = indicators.bag_mass(df, ["g", "bag"], ["g", "date"], "p", "v", "total", "alive")
    assert [(str(r.date), r.bag_mass) for r in mass.collect()] == [("2010-03-01", 15.0)]
    strict = indicators.bag_mass(df, ["g", "bag"], ["g", "date"], "p", "v", "total", "alive", strict=True)
    assert [r.bag_mass for r in strict.collect()] == [None]
    single = spark.createDataFrame([("a", "2010-03-01", 12.0), ("b", "2010-03-01", 7.0)], "g string, date string, i double"
                                   ).withColumn("date", F.col("date").cast("date"))
    spliced = indicators.splice(single, mass, ["g", "date"], "i", "bag_mass", "m")
    assert {r.g: r.m for r in spliced.collect()} == {"a": 12.0, "b": 7.0}


@pytest.mark.parametrize("gap, change, flagged", [(39, 126, True), (39, 125, False), (39, 74, True), (39, 75, False),
                                                  (40, 126, False)])
def test_late_jumps(spark, gap, change, flagged):
    import datetime as dt
    last = dt.date(2010, 11, 20)
    before = last - dt.timedelta(days=gap)
    data = []
    for day, mass in ((before, 100.0), (last, float(change)), (dt.date(2010, 5, 1), 900.0)):
        data += [("a", "1", str(day), "total", mass), ("a", "1", str(day), "alive", 1.0)]
    out = quality.late_jumps(observations(spark, data), ["g", "bag"], "date", "p", "v", "alive", "total")
    assert (out.count() == 1) is flagged


def test_audit(spark):
    df = observations(spark, [("a", b, "2010-03-01", p, 1.0) for b, p in
                              [("1", "dead"), ("1", "alive"), ("2", "alive")]] + [("b", "1", "2010-03-01", "dead", 0.0)])
    got = {r.g: r.status for r in quality.audit_counts(df, ["g", "date"], "p", "dead", "alive").collect()}
    assert got == {"a": "fewer", "b": "missing"}


def test_histogram_holds_every_value(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(121)] + [("b", 4.0), ("b", None)], "k string, v double")
    out = models.histogram(df, ["k"], "v", 60).collect()
    assert sum(r.n for r in out if r.k == "a") == 121
    assert {r.bin for r in out if r.k == "a"} == set(range(1, 61))
    assert [(r.bin, r.n) for r in out if r.k == "b"] == [(1, 1)]


def test_density_peaks_at_one(spark):
    random.seed(1)
    df = spark.createDataFrame([("a", random.gauss(0, 1)) for _ in range(500)], "k string, v double")
    out = models.scaled_density(df, ["k"], "v", points=64).collect()
    top = max(out, key=lambda r: r.scaled)
    assert len(out) == 64 and top.scaled == 1.0 and abs(top.x) < 0.5


def test_model_share_and_medians(spark):
    fits = spark.createDataFrame([("s1", "L", 1.0), ("s1", "G", 2.0), ("s2", "L", 3.0), ("s2", "G", None),
                                  ("s3", "L", 9.0), ("s3", "G", 4.0)], "site string, model string, aic double")
    assert {r.model: (r.n, r.percent) for r in models.model_share(fits, ["site"]).collect()} == {"L": (2, 67.0), "G": (1, 33.0)}
    assert {r.model: (r.median_aic, r.n) for r in models.median_scores(fits, ["model"]).collect()} == {
        "L": (3.0, 3), "G": (3.0, 2)}
