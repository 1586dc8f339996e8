"""Edge cases and invariants of the panel jobs."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from weekloom.functions import pvalues
from weekloom.operators import causal, district, evaluate, features, networks, panel, statistics, summaries
from weekloom.sources import tables

SMALL = "/root/testdata/sf0.001"


def frame(spark, rows, value="sales_card double"):
    return spark.createDataFrame(rows, f"public_id string, week_idx int, {value}")


def test_interpolation_is_by_position_then_filled(spark):
    rows = [("a", i, v) for i, v in enumerate([None, 1.0, None, 3.0, None])] + [("b", 0, None), ("b", 1, None)]
    got = panel.interp_linear(frame(spark, rows)).orderBy("public_id", "week_idx").collect()
    assert [r.sales_card for r in got] == [1.0, 1.0, 2.0, 3.0, 3.0, None, None]


def test_duplicate_weeks_keep_one_row(spark):
    rows = spark.createDataFrame([("a", "2020-01-06", 2.0), ("a", "2020-01-06", 1.0), ("a", "2020-01-13", 3.0)], "public_id string, date_id string, sales_card double")
    assert sorted(r.sales_card for r in panel.dedup_entity_week(rows).collect()) == [1.0, 3.0]


@pytest.mark.parametrize("values, expected", [([1.0], 0.0), ([1.0, 2.0], 0.0), ([5.0, 5.0, 5.0], 0.0), ([0.0, 1.0, 2.0, 3.0], 1.0), ([None, None, None], 0.0), ([0.0, None, 2.0, 3.0], 1.0)])
def test_slope_of_short_constant_and_gappy_series(spark, values, expected):
    got = features.feat_slopes(frame(spark, [("a", i, v) for i, v in enumerate(values)]), value="sales_card").first()
    assert got.slope_all_mm == pytest.approx(expected)


def test_change_point_is_the_largest_gap(spark):
    series = [0.0] * 7 + [1.0] * 9
    got = features.change_point_gap(frame(spark, [("a", i, v) for i, v in enumerate(series)]), value="sales_card").first()
    assert (got.split, got.magnitude, got.is_up) == (7, 1.0, 1)


def test_empty_inputs_give_empty_results(spark):
    empty = frame(spark, [])
    assert features.feat_slopes(empty, value="sales_card").count() == 0
    assert features.change_point_gap(empty, value="sales_card").count() == 0
    assert panel.interp_linear(empty).count() == 0


def test_zero_customers_give_no_ratio(spark):
    rows = spark.createDataFrame([(0, 0), (4, 1)], "customer long, customer_new long")
    assert [r.nc_ratio for r in panel.new_customer_ratio(rows).collect()] == [None, 0.25]


def test_operating_points_add_up(spark):
    rows = spark.range(200).select(((F.col("id") * 37) % 100 / 100.0).alias("s"), (F.col("id") % 3 == 0).alias("t"))
    for r in evaluate.operating_points(rows, "s", F.col("t")).collect():
        assert r.tp + r.fp + r.fn + r.tn == 200
    assert evaluate.calibration_deciles(rows, "s", F.col("t")).agg(F.sum("capture")).first()[0] == pytest.approx(1)


def test_average_ranks_share_ties(spark):
    rows = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (2.0,), (None,)], "v double")
    assert {r.v: r["rank"] for r in statistics.average_ranks(rows, "v").collect()} == {1.0: 1.0, 2.0: 2.0, 3.0: 3.5}


def test_auc_with_all_scores_tied_is_a_half(spark):
    rows = spark.range(10).select(F.lit(0.5).alias("s"), (F.col("id") < 4).alias("t"))
    assert evaluate.auc(rows, "s", F.col("t")).first().auc == pytest.approx(0.5)


def test_nearest_match_equals_brute_force(spark):
    import random

    draw = random.Random(4)
    a = [(i, round(draw.random(), 3)) for i in range(40)]
    b = [(100 + i, round(draw.random(), 3)) for i in range(60)]
    got = causal.nearest_match(spark.createDataFrame(a, "k long, s double"), spark.createDataFrame(b, "k long, s double"), key="k", score="s", buckets=8)
    for r in got.collect():
        s = dict(a)[r.treated]
        assert r.distance == pytest.approx(min(abs(s - x) for _, x in b))
    assert got.count() == 40


def test_survival_falls_and_ends_at_zero_if_all_go(spark):
    rows = spark.createDataFrame([("x", t, 1) for t in (1, 2, 2, 3, 5, 8)], "g string, t long, e int")
    got = [r.survival for r in causal.kaplan_meier(rows, group="g", time="t", event="e", min_n=1, min_events=1).orderBy("t").collect()]
    assert got == sorted(got, reverse=True) and got[-1] == 0.0 and got[0] == pytest.approx(5 / 6)


def test_ring_edges_are_linear_in_a_large_cell(spark):
    rows = spark.range(500).select(F.col("id"), F.lit("cell").alias("k"))
    edges = networks.cell_edges(rows, ["k"], entity="id", degree=30)
    assert edges.count() == 500 * 30 and edges.distinct().count() == 500 * 30
    assert networks.cell_edges(rows.limit(1), ["k"], entity="id").count() == 0


def test_active_interval_equals_brute_force(spark):
    from datetime import date

    spells = [("p", date(2020, 1, 1), date(2020, 3, 5)), ("p", date(2020, 1, 15), None), ("p", date(2020, 2, 3), date(2020, 2, 20))]
    got = {r.month: (r.active, r.closures) for r in district.active_interval(spark.createDataFrame(spells, "place string, a date, b date"), place="place", start="a", end="b").collect()}
    assert got[date(2020, 1, 1)] == (1, 0) and got[date(2020, 2, 1)] == (2, 1) and got[date(2020, 3, 1)] == (1, 1)


def test_right_closed_bins_drop_equal_edges(spark):
    rows = spark.createDataFrame([(1.0,)] * 8 + [(2.0,), (None,)], "v double")
    got = {(r.v, r.bin) for r in summaries.bin_right_closed(rows, "v", 4).collect()}
    assert got == {(1.0, 1), (2.0, 2), (None, None)}


def test_tail_probabilities():
    assert pvalues.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert pvalues.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert pvalues.f_upper(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert pvalues.chi2_upper(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert pvalues.chi2_upper(2.0, 2) == pytest.approx(math.exp(-1), abs=1e-10)


def test_sources_and_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", "2020-03", 5.0), ("2", "bad", 6.0)], "public_id string, open_month string, area double")
    tables.write_table(rows, str(tmp_path / "dim"), kind="csv")
    back = {r.public_id: str(r.open_date) for r in tables.read_dimension(spark, str(tmp_path / "dim"), rows.schema).collect()}
    assert back == {"1": "2020-03-01", "2": "None"}
    (tmp_path / "k.csv").write_bytes("이름,수\n서울,3\n".encode("cp949"))
    got = tables.read_encoded_csv(spark, [str(tmp_path / "k.csv")], "`이름` string, `수` int", ["이름"], encoding="cp949").collect()
    assert [r[0] for r in got] == ["서울"]
    weekly = spark.createDataFrame([(7, "2020-01-06", 1.0)], "public_id int, date_id string, sales_card double")
    tables.write_table(weekly, str(tmp_path / "facts"))
    one = tables.read_panel(spark, str(tmp_path / "facts"), columns=["sales_card"]).first()
    assert (one.public_id, str(one.date_id), one.sales_card) == ("7", "2020-01-06", 1.0)


def test_panel_plan_has_one_large_exchange(spark):
    weeks = spark.range(2000).select((F.col("id") % 10).cast("string").alias("public_id"), F.date_add(F.lit("2020-01-06").cast("date"), (F.col("id") / 10).cast("int") * 7).alias("date_id"), F.rand(1).alias("sales_card"))
    meta = spark.createDataFrame([("1", "x")], "public_id string, category string")
    plan = features.feat_slopes(panel.build_panel(weeks, meta))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(public_id") <= 2 and "Python" not in plan
