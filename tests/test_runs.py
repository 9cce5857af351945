"""Whole runs on a small raw feed written by the test."""

import csv
import math

import pytest
from pyspark.sql import functions as F

from tidemark.plans import cleaning, modelling
from tidemark.session import cut_lineage
from tidemark.sources import sinks
from tidemark.sources.observations import RAW_POSITIONS, RAW_WIDTH, in_box, in_scope, read_raw, read_sites, typed, with_keys

NAMES = {"Agnas (Banc)": "AGNAS", "Brest": "BREST"}
SITES = ["num,site,name,zone_fr,zone_en,lat,long", "1,AGNAS,Banc d'Agnas,Marennes,Marennes,45.87,-1.17",
         "2,BREST,Brest,Brest,Brest,48.33,-4.32"]


def raw_row(**cells):
    row = [""] * RAW_WIDTH
    for name, value in cells.items():
        row[RAW_POSITIONS[name] - 1] = str(value)
    return row


def visit(year, site, day, bag, alive=None, dead=None, total=None, cls="N0", origin="CN", place="AR", **more):
    code = f"RE{year % 100:02}_{'GJ' if cls == 'N0' else 'GA'}_{origin}{(year - 1) % 100:02}_{place}"
    shared = dict(program="P", site=site, class_age=cls, ploidy="diploïdes", date=day, id_ind=bag, pop_init_batch=code,
                  mnemonic_sampling="R", fraction="Sans objet", method="comptage") | more
    return [raw_row(code_param=p, value=v, **shared)
            for p, v in (("INDVVIVNB", alive), ("INDVMORNB", dead), ("TOTVIVPOI", total)) if v is not None]


def feed():
    rows = []
    for bag, dead in (("1", (0, 10, 0, 45)), ("2", (0, 20, 8, 0))):
        alive = 100
        for (d, m), n in zip(((15, 3), (15, 5), (15, 8), (20, 11)), dead):
            alive -= n
            rows += visit(2016, "Brest", f"{d:02}/{m:02}/2016", bag, alive, n, total=alive * (m + int(bag)), origin="NS", place="")
    rows += [list(r) for r in rows[:2]]                                                      # copies
    for d, m in ((15, 3), (15, 5), (15, 8)):
        rows += visit(2016, "Agnas (Banc)", f"{d:02}/{m:02}/2016", "1", 50, 0, total=500, origin="NS", place="")   # 3 visits
    for d, m in ((15, 2), (15, 3), (15, 5), (15, 8)):
        rows += visit(2017, "Brest", f"{d:02}/{m:02}/2017", "1", 50, 0, total=500, origin="NS", place="")          # ends in August
    for d, m in ((1, 3), (1, 6), (1, 9), (1, 12)):                                           # single individuals before 2009
        for mass in (m, m + 2):
            rows.append(raw_row(site="Brest", class_age="J1", ploidy="diploïdes", date=f"{d:02}/{m:02}/2000", code_param="INDVPOID",
                                value=mass, fraction="Sans objet", method="Pesée simple sans préparation", id_ind=f"i{mass}",
                                pop_init_batch="RE00_GA_CN98_AR", mnemonic_sampling="R"))
    rows += visit(2016, "Brest", "15/03/2016", "9", 1, 1, mnemonic_sampling="ISO 3", origin="NS", place="")
    rows += visit(2016, "Brest", "15/03/2016", "9", 1, 1, cls="A2")
    rows += visit(2010, "Brest", "15/03/2010", "9", 1, 1, origin="ET", place="GO")           # foreign batch of 2009-2014
    rows += visit(2016, "Brest", "01/02/2017", "9", 1, 1)                                    # after the campaign
    rows += visit(2016, "Elsewhere", "15/03/2016", "9", 1, 1)
    rows += visit(2016, "Brest", "31/02/2016", "9", 1, 1)
    rows.append(raw_row(site="Brest", class_age="N0", date="15/03/2016", code_param="INDVVIVNB", value="NA"))  # no code
    return rows


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("feed")
    with open(folder / "raw.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow([f"c{i}" for i in range(RAW_WIDTH)])
        out.writerows(feed())
    (folder / "sites.csv").write_text("\n".join(SITES))
    codes = spark.createDataFrame(list(NAMES.items()), "site string, site_code string")
    return read_raw(spark, str(folder / "raw.csv")), codes, read_sites(spark, str(folder / "sites.csv"))


def test_reading_and_scope(spark, inputs):
    raw, codes, _ = inputs
    assert raw.columns == list(RAW_POSITIONS)
    assert raw.filter("value IS NULL").count() == 1 and raw.filter("id_ind = ''").count() == 0
    rows = typed(raw)
    assert raw.count() - rows.count() == 2
    keyed = with_keys(rows, codes)
    assert keyed.filter("site NOT IN ('AGNAS', 'BREST')").count() == 0
    scoped = in_scope(keyed)
    batches = {r.batch for r in scoped.select("batch").distinct().collect()}
    assert batches == {"2016_N0_HATCH_2n_E4", "2017_N0_HATCH_2n_E4", "2000_J1_WILD_2n_AR"}
    assert scoped.filter("id_ind = '9'").count() == 0


def test_birthplaces(spark, inputs):
    cases = {"RE00_GJ_CN99_AR": "AR", "RE00_GJ_CN99_BO": "BO", "RE00_GJ_CN99_MO": "MO", "RE00_GJ_NS99_AR": "E4", "RE00_GJ_ET99_GO": "E1",
             "RE00_GJ_ET99_FT": "E3", "RE00_GJ_ET99_VN": "E2", "RE00_GJ_CN99_Me": "ME", "RE00_GJ_ET99_XX": None}
    rows = spark.createDataFrame([("Brest", "N0", "triploïdes", c) for c in cases],
                                 "site string, class_age string, ploidy string, pop_init_batch string")
    got = {r.pop_init_batch: (r.site_spat, r.batch) for r in with_keys(rows, inputs[1]).collect()}
    assert {c: v[0] for c, v in got.items()} == cases
    assert got["RE00_GJ_ET99_XX"][1] == "2000_N0_HATCH_3n_NA"


def test_clean_table(spark, inputs):
    raw, codes, sites = inputs
    table = cleaning.clean_table(raw, codes, sites, cut=True)
    assert table.columns == cleaning.CLEAN_COLUMNS
    got = {(r.batch, str(r.date)): r for r in table.collect()}
    young = "2016_N0_HATCH_2n_E4"
    assert {k[0] for k in got} == {young, "2000_J1_WILD_2n_AR"}
    assert {r.site for r in got.values()} == {"BREST"}
    mc1, mc2 = [0, .1, .1, .55], [0, .2, 1 - .8 * .9, 1 - .8 * .9]
    for day, a, b, m in zip(("2016-03-15", "2016-05-15", "2016-08-15", "2016-11-20"), mc1, mc2, (3, 5, 8, 11)):
        r = got[young, day]
        assert r.mean_CM == pytest.approx((a + b) / 2, abs=5e-4)
        assert r.mean_mass == pytest.approx(m + 1.5)
        assert (r.campaign, r.class_age, r.num) == (2016, "N0", 2)
    assert got[young, "2016-03-15"].DOY == 74
    old = [got["2000_J1_WILD_2n_AR", f"2000-{m:02}-01"] for m in (3, 6, 9, 12)]
    assert [r.mean_mass for r in old] == [4, 7, 10, 13] and all(r.mean_CM is None for r in old)


def test_crowded_cells_are_set_aside_by_the_run(spark, inputs, tmp_path):
    raw, codes, sites = inputs
    twice = raw.filter("code_param = 'INDVMORNB' AND date = '15/05/2016' AND site = 'Brest' AND id_ind = '1'")
    assert twice.count() == 1 or twice.distinct().count() == 1
    crowded = raw.unionByName(twice.limit(1).withColumn("value", F.lit("4").cast(raw.schema["value"].dataType)))
    path = str(tmp_path / "quarantine")
    table = cleaning.clean_table(crowded, codes, sites, quarantine_path=path)
    assert table.exceptAll(cleaning.clean_table(raw, codes, sites)).count() == 0  # the larger value counts
    (cell,) = spark.read.parquet(path).collect()
    assert (cell.batch, cell.id_ind, str(cell.date), cell.param, cell.n, cell.least, cell.most) == (
        "2016_N0_HATCH_2n_E4", "1", "2016-05-15", "INDVMORNB", 2, 4.0, 10.0)
    cleaning.clean_table(raw, codes, sites, quarantine_path=path)
    assert spark.read.parquet(path).count() == 0


def test_published_order(spark, tmp_path):
    df = spark.range(3000).selectExpr("id * 7919 % 3001 AS k", "if(id % 5 = 0, null, id) AS v").repartition(7)
    sinks.write_csv(df, str(tmp_path / "sorted"), order=["k"])
    back = sinks.in_published_order(df, str(tmp_path / "sorted"), ["k"])
    assert back.columns == ["k", "v", "in_order"] and back.filter("in_order").count() == 3000
    assert back.drop("in_order").exceptAll(df).count() == 0
    sinks.write_csv(df, str(tmp_path / "unsorted"))
    assert sinks.in_published_order(df, str(tmp_path / "unsorted"), ["k"]).filter("NOT in_order").count() > 100
    sinks.write_csv(df.limit(0), str(tmp_path / "empty"), order=["k"])
    assert sinks.in_published_order(df, str(tmp_path / "empty"), ["k"]).count() == 0


def test_tables_are_sorted_within_their_files(spark, tmp_path):
    import pyarrow.parquet as pq
    df = spark.range(500).selectExpr("int(id % 3) AS campaign", "id * 7919 % 503 AS k")
    sinks.write_table(df, str(tmp_path / "t"), ["campaign"], ["k"])
    files = list((tmp_path / "t").glob("campaign=*/*.parquet"))
    assert files and spark.read.parquet(str(tmp_path / "t")).count() == 500
    for file in files:
        keys = pq.ParquetFile(file).read(["k"])["k"].to_pylist()
        assert keys == sorted(keys)


def test_csv_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', None), (2, None, 2.5)], "n int, t string, v double")
    sinks.write_csv(df, str(tmp_path / "out"), ["v", "n", "t"])
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*.csv"))
    assert '"v","n","t"' in text and "NA" in text
    back = sinks.read_back(df.select("v", "n", "t"), str(tmp_path / "out"))
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(["(None, 1, 'a \"b\", c')", "(2.5, 2, None)"])


def test_parquet_folders_are_skipped(spark, tmp_path):
    df = spark.createDataFrame([(2010, 1.0), (2011, 2.0)], "campaign int, v double")
    sinks.write_table(df, str(tmp_path / "t"), ["campaign"])
    one = spark.read.parquet(str(tmp_path / "t")).filter("campaign = 2011")
    assert [r.v for r in one.collect()] == [2.0]
    assert "PartitionFilters: [isnotnull(campaign" in one._jdf.queryExecution().executedPlan().toString()


def test_points_in_the_box(spark, inputs):
    assert in_box(inputs[2], "long", "lat").count() == 2
    assert in_box(inputs[2], "long", "lat", (-2, 7.5)).count() == 1


def test_models_and_predictions(spark, inputs):
    rows = []
    for cls, top, base in (("N0", 30.0, 0.0), ("J1", 40.0, 20.0)):
        for year in (2010, 2011):
            for doy in range(60, 340, 20):
                mass = base + top / (1 + math.exp(-0.04 * (doy - 190)))
                dead = 0.4 * math.exp(-math.exp(-0.03 * (doy - 160)))
                rows.append((2, "BREST", "Brest", "Brest", 48.33, -4.32, year, cls, f"{year}_{cls}", "2010-01-01", doy,
                             round(dead, 3) if doy > 70 else None, round(mass, 2)))
    clean = spark.createDataFrame(rows, "num int, site string, name string, zone_en string, lat double, long double, campaign int, "
                                  "class_age string, batch string, date string, DOY int, mean_CM double, mean_mass double")
    assert modelling.measured(clean).filter("class_age = 'N0' AND measure = 'mortality'").count() == 2 * 13
    fits = cut_lineage(modelling.fit_all(clean, rounds=4))
    assert fits.count() == 2 * 2 * 2 * 2
    picked = {(r.class_age, r.measure): (r.model, r.n, r.percent) for r in modelling.selection_table(fits).collect()}
    assert picked == {(c, m): (w, 2, 100.0) for c in ("N0", "J1") for m, w in modelling.WINNERS.items()}
    table = modelling.predicted_table(fits, inputs[2], modelling.WINNERS)
    assert table.exceptAll(modelling.predicted_table(fits, inputs[2])).count() == 0
    assert table.columns == modelling.PREDICTED_COLUMNS and table.count() == 2 * 2 * 273
    r = table.filter("class_age = 'J1' AND campaign = 2010 AND DOY = 337").first()
    assert r.mass_pred == pytest.approx(20 + 40 / (1 + math.exp(-0.04 * 147)), abs=0.1)
    assert r.CM_pred == pytest.approx(0.4 * math.exp(-math.exp(-0.03 * 177)), abs=0.005)


def test_strict_means_spread_to_the_visit(spark):
    df = spark.createDataFrame([("b", "s", "2010-01-01", 0.5), ("b", "s", "2010-01-01", None)],
                               "batch string, site string, date string, mc double")
    from tidemark.operators.indicators import mean_per_visit
    assert mean_per_visit(df, ["batch", "site", "date"], "mc", "m").first().m == 0.5
    assert mean_per_visit(df, ["batch", "site", "date"], "mc", "m", strict=True).select(F.col("m").isNull().alias("n")).first().n
