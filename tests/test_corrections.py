import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger, seeding
from tidemark.operators.ledger import Rule, SeedFill, ZeroFill, apply_ledger
from tidemark.operators.seeding import Layout, Seed
from tidemark.plans.corrections import count_corrections, empty_visits, mass_corrections

AT = Layout()
VIV, MOR, TOT = AT.alive, AT.dead, AT.total
DDL = "batch string, site string, class_age string, campaign int, date string, id_ind string, code_param string, value double"


def table(spark, rows):
    return spark.createDataFrame(rows, DDL).withColumn("date", F.col("date").cast("date"))


def obs(batch, site, date, bag, param, value):
    return batch, site, batch[5:7], int(batch[:4]), date, bag, param, float(value)


def plain(df):
    return Counter((r.batch, r.site, str(r.date), r.id_ind, r.code_param, r.value) for r in df.collect())


def short(rows):
    return Counter((b, s, d, i, p, v) for b, s, _, _, d, i, p, v in rows)


B = "2011_N0_WILD_2n_AR"


def test_zero_fill(spark):
    rows = [
        obs(B, "S", "2011-03-01", "1", VIV, 300), obs(B, "S", "2011-03-01", "1", MOR, 0),
        obs(B, "S", "2011-04-01", "2", MOR, 5), obs(B, "S", "2011-04-01", "2", MOR, 6), obs(B, "S", "2011-05-01", "2", MOR, 7),
        obs(B, "S", "2011-04-01", None, MOR, 4), obs(B, "T", "2011-06-01", "1", MOR, 1), obs(B, "S", "2011-06-01", "3", VIV, 9),
    ]
    added = seeding.zero_fill_rows(table(spark, rows), AT)
    assert plain(added) == Counter({(B, "S", "2011-03-01", "2", MOR, 0.0): 2, (B, "S", "2011-03-01", None, MOR, 0.0): 1})
    assert seeding.zero_fill(table(spark, rows), AT).count() == len(rows) + 3


def test_seed_fill(spark):
    day = "2011-03-17"
    rows = [
        obs(B, "S", "2011-04-15", "1", VIV, 290), obs(B, "S", "2011-04-15", "1", MOR, 10), obs(B, "S", "2011-05-15", "1", VIV, 280),
        obs(B, "S", day, "2", VIV, 300), obs(B, "S", "2011-04-15", "2", MOR, 3),
        obs(B, "S", "2011-04-15", None, VIV, 5), obs(B, "S", "2011-04-15", "1", TOT, 999),
        obs(B, "X", "2011-04-15", "1", VIV, 7), obs("2012_N0_WILD_2n_AR", "S", "2012-04-15", "1", VIV, 7),
    ]
    seed = Seed(F.col("campaign") == 2011, F.lit(day).cast("date"), fill_scope=F.col("site") != "X")
    got = plain(seeding.seed_fill_rows(table(spark, rows), [seed], AT))
    assert got == Counter([
        (B, "S", day, "1", VIV, 300.0), (B, "S", day, None, VIV, 5.0),
        (B, "S", day, "1", MOR, 0.0), (B, "S", day, "2", MOR, 0.0)])
    later = Seed(F.col("campaign") == 2011, F.lit("2011-04-15").cast("date"), later_only=True, with_dead=False)
    got = plain(seeding.seed_fill_rows(table(spark, rows), [later], AT))
    assert got == Counter()  # bag 1 starts on the seed day, bag 2 has no later alive or dead visit
    earlier = Seed(F.col("campaign") == 2011, F.lit("2011-03-20").cast("date"), later_only=True, with_dead=False)
    got = plain(seeding.seed_fill_rows(table(spark, rows), [earlier], AT))
    assert got[B, "S", "2011-03-20", "2", VIV, 3.0] == 1  # only the visits after the seed day are summed


def test_each_action(spark):
    rows = [obs(B, "S", "2011-03-01", b, VIV, 300) for b in ("1", "2", None)] + [obs(B, "T", "2011-03-01", "1", MOR, 4)]
    df = table(spark, rows)

    def run(*steps):
        return plain(apply_ledger(df, list(steps)))

    keep = short(rows)
    two = Rule("delete", batch=(B,), site=("S",), bag=(ledger.NAMED_NOT_IN, ("1",)))
    assert run(two) == keep - Counter([(B, "S", "2011-03-01", "2", VIV, 300.0)])
    unnamed_too = Rule("delete", batch=(B,), site=("S",), bag=(ledger.NOT_IN_OR_UNNAMED, ("1",)))
    assert sum(run(unnamed_too).values()) == 2
    copied = run(Rule("copy", site=("T",), sets=({"value": 0.0, "date": "2011-01-01"}, {"id_ind": "9"})))
    assert copied - keep == Counter([(B, "T", "2011-01-01", "1", MOR, 0.0), (B, "T", "2011-03-01", "9", MOR, 4.0)])
    six = run(Rule("replace", site=("T",), sets=tuple({"id_ind": str(i)} for i in range(1, 7))))
    assert sum(six.values()) == 9 and six[B, "T", "2011-03-01", "6", MOR, 4.0] == 1
    named = run(Rule("update", bag=(ledger.UNNAMED, ()), sets=({"id_ind": "unidentified"},)))
    assert named[B, "S", "2011-03-01", "unidentified", VIV, 300.0] == 1 and sum(named.values()) == 4


def test_order_matters_and_one_delete_repeats_safely(spark):
    rows = [obs(B, "S", "2011-03-09", "1", VIV, 300)]
    copy = Rule("copy", site=("S",), on=("2011-03-09",), sets=({"date": "2011-02-21", "value": 50.0},))
    delete = Rule("delete", batch=(B,), site=("S",), on=("2011-02-21",))
    df = table(spark, rows)
    assert apply_ledger(df, [delete, copy]).count() == 2
    assert apply_ledger(df, [copy, delete]).count() == 1
    assert apply_ledger(df, [copy, delete, delete]).count() == 1


def test_replace_on_the_first_day_of_the_touched_rows(spark):
    batch = "2008_J1_WILD_2n_AR"
    rows = [obs(batch, "BREST", "2008-02-01", None, MOR, 1), obs(batch, "BREST", "2008-02-01", None, VIV, 300),
            obs(batch, "BREST", "2008-05-01", None, VIV, 200), obs(batch, "BREST", "2008-05-01", "1", VIV, 90),
            obs(batch, "GEFOS", "2008-01-01", None, VIV, 5)]
    rule = Rule("replace", batch=(batch,), site=("BREST",), param=VIV, bag=(ledger.UNNAMED, ()), first_day=True,
                sets=({"id_ind": "1"}, {"id_ind": "2"}))
    assert plain(apply_ledger(table(spark, rows), [rule])) == Counter([
        (batch, "BREST", "2008-02-01", "1", VIV, 300.0), (batch, "BREST", "2008-02-01", "2", VIV, 300.0),
        (batch, "BREST", "2008-05-01", "1", VIV, 90.0), (batch, "GEFOS", "2008-01-01", None, VIV, 5.0)])


def test_hashed_deletes_equal_filters(spark):
    random.seed(7)
    days = [f"2011-0{m}-01" for m in range(1, 7)]
    rows = [obs(random.choice([B, "2012_N0_WILD_2n_AR"]), random.choice("ST"), random.choice(days),
                random.choice(["1", "2", "3", None]), random.choice([VIV, MOR, TOT]), random.randrange(9)) for _ in range(400)]
    rules = [
        Rule("delete", batch=(B,), site=("S",), bag=(ledger.NAMED_NOT_IN, ("1",)), param=MOR),
        Rule("delete", batch=(B,), site=("T",), bag=(ledger.UNNAMED, ())),
        Rule("delete", batch=("2012_N0_WILD_2n_AR",), site=("S", "T"), on=(days[0], days[3])),
        Rule("delete", batch=("2012_N0_WILD_2n_AR",), site=("S",), bag=(ledger.NOT_IN_OR_UNNAMED, ("2",)), after=days[4]),
        Rule("delete", batch=(B,), site=("S",), bag=(ledger.IN, ("2", "3")), param=TOT, after=days[2]),
        Rule("delete", batch=(B,), site=("T",), bag=(ledger.IN_OR_UNNAMED, ("3",)), on=(days[5],)),
    ]
    assert all(r.keyed for r in rules)
    df = table(spark, rows)
    expected = df
    for r in rules:
        expected = expected.filter(~F.coalesce(r.matches(AT), F.lit(False)))
    got = ledger.delete_keyed(df, rules, AT)
    assert plain(got) == plain(expected) and got.count() < df.count()


def test_rules_from_a_table(spark):
    import datetime as dt
    none = [None] * 3
    rows = [
        (2, "delete", [B], ["S"], None, None, None, None, MOR, None, "not in", ["1"], None, dt.date(2011, 3, 5), *none, None, None),
        (1, "copy", None, ["S"], None, "N0", 2011, None, VIV, None, None, None, [dt.date(2011, 3, 1)], None, *none, None,
         [{"value": "7", "code_param": MOR, "date": "2011-03-09"}]),
    ]
    rules = ledger.rules_from_table(spark.createDataFrame(rows, ledger.RULE_TABLE))
    assert [r.action for r in rules] == ["copy", "delete"] and rules[1].keyed
    df = table(spark, [obs(B, "S", "2011-03-01", b, VIV, 3) for b in ("1", "2", None)])
    got = plain(apply_ledger(df, rules)) - plain(df)
    assert got == Counter([(B, "S", "2011-03-09", "1", MOR, 7.0), (B, "S", "2011-03-09", None, MOR, 7.0)])
    many = spark.range(20_000).selectExpr("int(id) AS seq", "'delete' AS action", "array('b') AS batch", "array('s') AS site")
    full = spark.createDataFrame([], ledger.RULE_TABLE).unionByName(many, allowMissingColumns=True)
    assert len(ledger.rules_from_table(full)) == 20_000


def test_overlapping_rules_of_a_stage_fail(spark):
    df = table(spark, [obs(B, "S", "2011-03-01", b, VIV, 3) for b in ("1", "2", None)])
    one = Rule("delete", batch=(B,), site=("S",), bag=(ledger.IN, ("1",)), stage=1)
    other = Rule("delete", bag=(ledger.IN, ("2",)), stage=1)
    assert one.keyed and [r.id_ind for r in apply_ledger(df, [one, other]).collect()] == [None]
    overlap = Rule("delete", bag=(ledger.IN, ("1", "2")), stage=1)
    with pytest.raises(Exception, match="stage 1: rules overlap on .* 1 2011-03-01"):
        apply_ledger(df, [one, overlap]).collect()
    later = Rule("delete", bag=(ledger.IN, ("1", "2")), stage=2)
    assert apply_ledger(df, [one, later]).count() == 1


def test_fills_from_a_table(spark):
    layout = spark.createDataFrame([], ledger.STEP_TABLE)
    given = spark.sql("""
        SELECT 1 AS seq, 'zero fill' AS action, null AS stage, null AS scope, null AS day, null AS with_dead
        UNION ALL SELECT 2, 'seed fill', 5, 'campaign = 2011', "DATE '2011-01-05'", null
        UNION ALL SELECT 3, 'seed fill', 5, 'campaign = 2012', "DATE '2012-01-05'", false
        UNION ALL SELECT 4, 'seed fill', 6, 'campaign = 2013', "DATE '2013-01-05'", null""")
    steps = ledger.rules_from_table(layout.unionByName(given, allowMissingColumns=True))
    assert [type(s) for s in steps] == [ZeroFill, SeedFill, SeedFill] and len(steps[1].seeds) == 2
    day = lambda text: F.lit(text).cast("date")
    same = [ZeroFill(), SeedFill((Seed(F.col("campaign") == 2011, day("2011-01-05")),
                                  Seed(F.col("campaign") == 2012, day("2012-01-05"), with_dead=False))),
            SeedFill((Seed(F.col("campaign") == 2013, day("2013-01-05")),))]
    rows = [obs(f"{y}_N0_WILD_2n_AR", "S", f"{y}-0{m}-01", b, p, m) for y in (2011, 2012, 2013) for b in ("1", "2")
            for m, p in ((3, VIV), (4, VIV), (4, MOR))]
    df = table(spark, rows)
    got = plain(apply_ledger(df, steps))
    assert got == plain(apply_ledger(df, same)) and sum(got.values()) > len(rows)


def test_hits_and_conflicts(spark):
    df = table(spark, [obs(B, "S", "2011-03-01", "1", VIV, 1), obs(B, "S", "2011-03-01", None, MOR, 2)])
    rules = [Rule("delete", site=("S",)), Rule("delete", param=MOR), Rule("delete", bag=(ledger.IN, ("9",)))]
    assert {r.rule: r.n for r in ledger.rule_hits(df, rules).collect()} == {0: 2, 1: 1, 2: 0}
    assert [r.rules for r in ledger.rule_conflicts(df, rules).collect()] == [[0, 1]]


def test_cutting_the_lineage_changes_nothing(spark):
    rows = [obs(B, "S", "2011-04-15", "1", VIV, 290), obs(B, "S", "2011-05-15", "1", MOR, 10), obs(B, "S", "2011-04-20", None, MOR, 1)]
    steps = [ZeroFill(), SeedFill((Seed(F.lit(True), F.lit("2011-03-17").cast("date")),)),
             Rule("update", bag=(ledger.UNNAMED, ()), sets=({"id_ind": "u"},))]
    df = table(spark, rows)
    assert plain(apply_ledger(df, steps, cut=True)) == plain(apply_ledger(df, steps))


def test_hot_bag_in_fills(spark):
    """A bag with most rows of the table gets one added row per first row, like any other."""
    hot = [obs(B, "S", f"2011-{3 + i % 9:02}-{1 + i % 27:02}", "1", MOR, i % 5) for i in range(3000)]
    rows = hot + [obs(B, "S", "2011-01-01", "2", VIV, 10)]
    first = min(r[4] for r in hot)
    n = sum(r[4] == first for r in hot)
    assert plain(seeding.zero_fill_rows(table(spark, rows), AT)) == Counter({(B, "S", "2011-01-01", "1", MOR, 0.0): n})


def test_the_shipped_ledger(spark):
    steps = count_corrections() + mass_corrections() + empty_visits()
    rules = [s for s in steps if isinstance(s, Rule)]
    assert Counter(r.action for r in rules)["delete"] > 40
    assert sum(isinstance(s, SeedFill) for s in steps) == 2
    n0, j1 = "{}_N0_WILD_2n_AR".format, "{}_J1_WILD_2n_AR".format
    rows = [
        obs(n0(1995), "GEFOS", "1995-03-01", "1", VIV, 1),                      # deleted
        obs(n0(1996), "GEFOS", "1996-03-01", None, VIV, 2),                     # named
        obs(n0(2012), "MARSE", "2012-02-21", "1", VIV, 300),                    # six bags of 50
        obs(j1(2010), "GEFOS", "2010-07-12", "2", TOT, 1050),                   # 10500
        obs(j1(2005), "LARMO", "2005-06-23", None, VIV, 200),                   # copied to the seed day as 220
        obs(n0(2008), "COUPE", "2008-04-01", "1", VIV, 80), obs(n0(2008), "COUPE", "2008-04-01", "1", MOR, 3),
        obs(n0(2014), "BLAIN", "2014-03-18", "2", MOR, 0),                      # alive 300 added
        obs(n0(2007), "BLAIN", "2007-03-18", "1", TOT, 9),                      # bag totals before 2009 go
    ]
    got = plain(apply_ledger(table(spark, rows), count_corrections() + mass_corrections()))
    expected = Counter([
        (n0(1996), "GEFOS", "1996-03-01", "unidentified", VIV, 2.0),
        *[(n0(2012), "MARSE", "2012-02-21", str(i), VIV, 50.0) for i in range(1, 7)],
        (j1(2010), "GEFOS", "2010-07-12", "2", TOT, 10500.0),
        (j1(2005), "LARMO", "2005-06-23", "unidentified", VIV, 200.0), (j1(2005), "LARMO", "2005-04-01", "unidentified", VIV, 220.0),
        (n0(2008), "COUPE", "2008-04-01", "unidentified", VIV, 80.0),
        (n0(2014), "BLAIN", "2014-03-18", "2", MOR, 0.0), (n0(2014), "BLAIN", "2014-03-18", "2", VIV, 300.0),
    ])
    assert got == expected


def test_the_shipped_seed_days(spark):
    n0, j1 = "{}_N0_WILD_2n_AR".format, "{}_J1_WILD_2n_AR".format
    rows = []
    for batch, site, day in ((n0(2009), "BREST", "2009-05-01"), (n0(2009), "QUIBE", "2009-05-01"), (n0(2010), "BREST", "2010-05-01"),
                             (j1(2010), "BREST", "2010-05-01"), (j1(2011), "BLAIN", "2011-05-01"), (n0(2011), "PENRF", "2011-05-01"),
                             (j1(2012), "BREST", "2012-05-01"), (j1(2012), "MARSE", "2012-05-01")):
        rows += [obs(batch, site, day, "1", VIV, 90), obs(batch, site, day, "1", MOR, 10)]
    got = plain(apply_ledger(table(spark, rows), count_corrections())) - short(rows)
    assert got == Counter([
        (n0(2009), "BREST", "2009-03-09", "1", VIV, 100.0), (n0(2009), "BREST", "2009-03-09", "1", MOR, 0.0),
        (n0(2010), "BREST", "2010-03-29", "1", VIV, 100.0), (n0(2010), "BREST", "2010-03-29", "1", MOR, 0.0),
        (j1(2010), "BREST", "2010-03-14", "1", VIV, 100.0), (j1(2010), "BREST", "2010-03-14", "1", MOR, 0.0),
        (j1(2011), "BLAIN", "2011-03-17", "1", VIV, 100.0),
        (j1(2012), "BREST", "2012-02-21", "1", VIV, 100.0),
    ])


def test_unknown_action(spark):
    with pytest.raises(ValueError):
        apply_ledger(table(spark, [obs(B, "S", "2011-03-01", "1", VIV, 1)]), [Rule("move")])
