"""Every registered query against its SQL, and what its plan may contain."""

import glob
import os
import re
import subprocess
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import compare  # noqa: E402

from tidemark.operators.ledger import Rule, apply_ledger  # noqa: E402
from tidemark.operators.selection import best_rows  # noqa: E402
from tidemark.plans.corrections import count_corrections  # noqa: E402
from tidemark.plans.queries import QUERIES, SQL  # noqa: E402
from tidemark.sources import tables  # noqa: E402

FITTED = {"fit_logistic3", "fit_gompertz3", "fit_logistic4", "fit_gompertz4", "fit_quality", "predict_grid", "residuals",
          "season_snapshot", "growth_ratio", "indicator_pairs", "combined_predictions", "fit_lattice3", "fit_lattice4",
          "fit_gaps", "model_share", "aic_histogram", "param_density", "invalid_fit_points", "unsettled_predictions",
          "odd_predict_grid", "odd_best_models", "odd_invalid_points", "odd_unsettled_predictions"}


# on the smallest tables most groups have fewer points than a curve has parameters, so their parameters are not determined
CURVES = {name for name in QUERIES if QUERIES[name].__module__.endswith(".curves") and name != "curve_samples"}


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, small, name):
    folder = small.replace("0.001", "0.01") if name in CURVES else small
    df = QUERIES[name](spark, folder)
    assert compare(df.toPandas(), connect(folder).execute(SQL[name]).df()) == "ok"
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert not re.search("Window .*, \\[\\]", plan)
    assert bool(re.search("MapInPandas", plan)) == (name in FITTED)
    assert not re.search("BatchEvalPython|ArrowEvalPython|FlatMapGroups", plan)


def test_entry(spark, small):
    assert entry.entry(spark).columns == ["batch", "site", "date", "mean_cm"]


def test_entry_without_a_library_of_the_corpus_operators():
    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert list(map(int, out[-2:])) == [len(QUERIES), len(SQL)]


def plan_of(spark, small, name):
    return QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = plan_of(spark, small, "filter_members")
    assert re.search(r"PushedFilters: \[.*In\(p_type", plan)
    assert "p_name" not in re.search(r"ReadSchema: (\S+)", plan).group(1)
    scans = re.findall(r"ReadSchema: (\S+)", plan_of(spark, small, "cumulative_rate"))
    assert scans and all("l_tax" not in s and "l_orderkey" not in s for s in scans)


def test_indicators_read_the_lines_once_each(spark, small):
    for name in ("individual_mass", "protocol_splice", "final_assembly", "measure_compare"):
        plan = plan_of(spark, small, name)
        assert len(re.findall(r"FileScan[^\n]*lineitem", plan)) == 1
        assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 4 + 2 * (name == "final_assembly")  # and the sites' joins


def test_two_measures_are_fitted_in_one_pass(spark, small):
    for name in ("combined_predictions", "indicator_pairs"):
        plan = plan_of(spark, small, name)
        assert plan.count("MapInPandas") == 1 and len(re.findall(r"FileScan[^\n]*o_orderdate", plan)) == 1


def test_readers_of_fits_share_one_search(spark, small):
    for name in ("model_share", "aic_histogram", "param_density", "invalid_fit_points", "unsettled_predictions"):
        df = QUERIES[name](spark, small)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("MapInPandas") <= 1


def test_keyed_rules_and_lookups_shuffle_nothing(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet").selectExpr(
        "cast(l_suppkey AS string) AS batch", "l_linestatus AS site", "l_linestatus AS class_age", "1 AS campaign",
        "cast(l_shipdate AS date) AS date", "l_returnflag AS id_ind", "l_linestatus AS code_param", "l_quantity AS value")
    rules = [s for s in count_corrections() if isinstance(s, Rule) and s.keyed]
    steps = apply_ledger(lines, rules)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in steps and "hashpartitioning" not in steps
    assert "hashpartitioning" not in plan_of(spark, small, "recode_lookup")


def test_the_gate_bites(spark, small):
    gated, every = (QUERIES[n](spark, small) for n in ("gated_cumulative_rate", "mean_cumulative_rate"))
    same = gated.join(every, ["batch", "site", "date", "mean_cm"]).count()
    assert 0 < same < 0.95 * every.count()


def test_odd_series_bite(spark, small):
    for folder in (small, small.replace("0.001", "0.01")):
        count = lambda name, condition="true": QUERIES[name](spark, folder).filter(condition).count()  # noqa: E731, B023
        every = count("odd_predict_grid")
        assert 0.05 * every < count("odd_predict_grid", "aic_compiled = 'no'") < 0.95 * every
        assert 0.05 * every < count("odd_unsettled_predictions") < 0.95 * every
        points = tables.order_curves(spark, folder).count()
        assert 0.05 * points < count("odd_invalid_points") < 0.95 * points
        groups = tables.order_curves(spark, folder).select("class_age", "site", "campaign").distinct().count()
        assert 0.05 * groups < count("odd_best_models") < 0.95 * groups


def test_one_shuffle_pivot(spark, small):
    assert plan_of(spark, small, "pivot_counts").count("Exchange hashpartitioning") == 1


def test_row_steps_shuffle_nothing(spark, small):
    for name in ("copy_edit_insert", "batch_scope"):
        steps = plan_of(spark, small, name)
        assert steps.count("Exchange hashpartitioning") <= 1 and "Join" not in steps


def test_best_fit_is_limited_before_the_shuffle(spark, small):
    fits = spark.createDataFrame([("s", "L", 1.0)], "site string, model string, aic double")
    plan = best_rows(fits.repartition(3), ["site"], "aic")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit [site#") < plan.rindex("WindowGroupLimit [site#")


def test_sort_order_is_not_relied_on(spark, small):
    assert "GlobalLimit" not in plan_of(spark, small, "late_jump_flag")


def test_snapshots_evaluate_only_their_days(spark, small):
    for name in ("season_snapshot", "growth_ratio"):
        assert "sequence(65, 337" not in plan_of(spark, small, name)


def test_almost_all_fits_settle(spark, small):
    rows = QUERIES["fit_quality"](spark, small.replace("0.001", "0.01")).collect()
    assert sum(r.unsettled for r in rows) < 0.01 * sum(r.n for r in rows)
