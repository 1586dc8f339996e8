"""Numbers of the other fitted jobs against loops, closed forms and planted structure."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.operators import causal, models, ordering
from weekloom.plans import registry
from weekloom.sources import tables

DRAW = np.random.default_rng(31)


def test_local_lines_equal_a_loop(spark):
    """LOWESS: at each place a line through the nearest three tenths, weighted by tricube."""
    y = np.sin(np.arange(40) / 6) + DRAW.normal(0, 0.2, 40)
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(y)] + [("b", 1, 2.0), ("b", 2, None)], "e string, t int, v double")
    got = {(r.e, r.t): r for r in models.local_trend(df, entity="e", order="t", value="v").collect()}
    for k in range(40):
        away = np.sort(np.abs(np.arange(40) - k))[11] * 1.000001
        w = np.clip(1 - (np.abs(np.arange(40) - k) / away) ** 3, 0, None) ** 3
        m = np.c_[np.ones(40), np.arange(40) - k]
        line = np.linalg.solve(m.T @ (m * w[:, None]), m.T @ (w * y))
        assert got["a", k].trend == pytest.approx(line[0]) and got["a", k].resid == pytest.approx(y[k] - line[0])
    assert got["b", 1].trend == 2.0 and ("b", 2) not in got


def test_piecewise_lines_equal_all_breaks(spark):
    y = np.r_[np.linspace(0, 10, 20), np.linspace(10, -5, 22)] + DRAW.normal(0, 0.3, 42)
    got = models.piecewise_bic(spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(y)], "e string, t int, v double"), entity="e", order="t", value="v").first()
    cuts = [int(q) for q in np.linspace(0, 42, 12)[1:-1] if 3 <= int(q) <= 39]
    best = (math.inf,)
    for k in range(3):
        for chosen in itertools.combinations(cuts, k):
            edges = [0, *chosen, 42]
            if min(np.diff(edges)) < 3:
                continue
            rss, slope = 0.0, 0.0
            for a, b in itertools.pairwise(edges):
                line = np.polyfit(np.arange(a, b), y[a:b], 1)
                rss += ((y[a:b] - np.polyval(line, np.arange(a, b))) ** 2).sum()
                slope = line[0]
            best = min(best, (42 * math.log(rss / 42) + (3 * k + 2) * math.log(42), k, slope))
    assert got.n_breaks == best[1] and got.bic == pytest.approx(best[0]) and got.last_slope == pytest.approx(best[2])


def test_internal_indices_equal_loops(spark):
    x = np.r_[DRAW.normal(0, 1, (20, 2)), DRAW.normal(5, 1, (25, 2)), DRAW.normal((0, 9), 1, (15, 2))]
    clustered = models.kmeans(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id int, a array<double>"), "a", 3, key="id").cache()
    rows = clustered.toPandas().sort_values("id")
    v, of = np.stack([r.toArray() for r in rows["v"]]), rows["cluster"].to_numpy()
    groups = [v[of == k] for k in range(3)]
    within = sum(((g - g.mean(0)) ** 2).sum() for g in groups)
    between = sum(len(g) * ((g.mean(0) - v.mean(0)) ** 2).sum() for g in groups)
    spread = [math.sqrt(((g - g.mean(0)) ** 2).sum() / len(g)) for g in groups]
    worst = [max((spread[i] + spread[j]) / np.linalg.norm(groups[i].mean(0) - groups[j].mean(0)) for j in range(3) if j != i) for i in range(3)]
    d2 = ((v[:, None] - v[None]) ** 2).sum(-1)
    sil = []
    for i in range(len(v)):
        a = d2[i][of == of[i]].sum() / ((of == of[i]).sum() - 1)
        b = min(d2[i][of == k].mean() for k in range(3) if k != of[i])
        sil.append((b - a) / max(a, b))
    got = models.internal_indices(clustered).first()
    assert (got.k, got.calinski_harabasz, got.davies_bouldin) == (3, pytest.approx(between / 2 / (within / 57)), pytest.approx(np.mean(worst)))
    assert got.silhouette == pytest.approx(np.mean(sil), abs=1e-6)


def test_mixture_finds_two_planted_groups(spark):
    x = np.r_[DRAW.normal(0, 1, (60, 2)), DRAW.normal(8, 1, (40, 2))]
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "id int, a double, b double")
    out, bic, aic = models.gaussian_mixture(df, ["a", "b"], 2, key="id")
    of = {r.id: r.cluster for r in out.collect()}
    right = sum(of[k] == of[0] for k in range(60)) + sum(of[k] != of[0] for k in range(60, 100))
    assert max(right, 100 - right) >= 90
    assert bic - aic == pytest.approx(11 * (math.log(100) - 2))


def test_propensity_equals_newton(spark):
    x = DRAW.normal(size=(300, 2)) * [2, 0.5] + 3
    t = (DRAW.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 3)))).astype(int)
    got = models.propensity(spark.createDataFrame([(k, int(t[k]), float(x[k, 0]), float(x[k, 1])) for k in range(300)], "id int, t int, a double, b double"), ["a", "b"], "t", key="id").toPandas().sort_values("id")
    m, beta = np.c_[np.ones(300), x], np.zeros(3)
    for _ in range(20):
        p = 1 / (1 + np.exp(-m @ beta))
        beta += np.linalg.solve(m.T @ (m * (p * (1 - p))[:, None]), m.T @ (t - p))
    assert np.abs(got["score"].to_numpy() - 1 / (1 + np.exp(-m @ beta))).max() < 1e-3


def test_regressions_out_of_fold(spark):
    """A planted line is found from the other folds; a fold's own values don't help it."""
    x = DRAW.normal(size=200)
    rows = spark.createDataFrame([(k, k % 2, float(x[k]), float(3 * x[k] + 1 + DRAW.normal(0, 0.1))) for k in range(200)] + [(900, 0, 1.0, None)], "id int, fold int, x double, y double")
    pred = models.regress_folds(rows, ["x"], "y", key="id").toPandas()
    assert len(pred) == 200 and np.corrcoef(pred["truth"], pred["pred"])[0, 1] > 0.99
    split = models.regress_folds(rows.withColumn("y", F.when(c_fold() == 0, 5.0).otherwise(-5.0)), ["x"], "y", key="id", kind="forest")
    assert {(round(r.truth), round(r.pred)) for r in split.collect()} == {(5, -5), (-5, 5)}
    table = {(r.truth, r.pred): r.n for r in models.bucket_predictions(models.regress_folds(rows, ["x"], "y", key="id")).collect()}
    truth, guess = pred["truth"].to_numpy(), pred["pred"].to_numpy()
    name = lambda v: "Growth" if v > 0.5 * truth.std() else "Decline" if v < -0.5 * truth.std() else "Stable"
    pairs = [(name(a), name(b)) for a, b in zip(truth, guess, strict=True)]
    assert table == {p: pairs.count(p) for p in set(pairs)}


def c_fold():
    return F.col("fold")


def test_ablation_prefers_the_planted_features(spark):
    rows = spark.createDataFrame([(k, k % 2, "up" if k % 4 < 2 else "down", float(k % 4 < 2) + 0.01 * (k % 7), float(k % 5)) for k in range(120)], "id int, fold int, y string, a double, b double")
    got = {r.features: r for r in models.ablation(rows, {"noise": ["b"], "both": ["a", "b"]}, "y", key="id").collect()}
    assert got["both"].accuracy == 1 and got["both"].macro_f1 == 1 and got["noise"].accuracy < 0.7


def test_trough_lead_by_hand(spark):
    """Sales turn up three weeks after the turn, customers one week after: a lead of two."""
    weeks = range(24)
    sales, customers = [10 - k if k < 15 else 4 * (k - 14) for k in weeks], [30 - k if k < 13 else 30 + k for k in weeks]
    panel = spark.createDataFrame([("a", k, float(s), float(n)) for k, s, n in zip(weeks, sales, customers, strict=True)], "public_id string, week_idx int, sales_card double, customer double")
    turns = spark.createDataFrame([("a", 12, -1.0, 2.0), ("b", 3, 1.0, 2.0)], "public_id string, split int, pre_slope double, post_slope double")
    z = {name: (np.array(v) - np.mean(v)) / np.std(v, ddof=1) for name, v in (("sales", sales), ("customers", customers))}
    first = {name: next(t for t in range(12) if v[12 + t] >= 0) for name, v in z.items()}
    rows = causal.trough_lead(panel, turns).collect()
    assert {r.customer_lead_weeks for r in rows} == {first["sales"] - first["customers"]} and len(rows) == 24
    got = {r.event_time: r for r in rows}
    for t in range(-12, 12):
        assert np.sign(got[t].sales) == np.sign(z["sales"][12 + t]) and got[t].n == 1


@pytest.mark.parametrize("buckets", [2, 9, None])
def test_quantiles_of_groups_equal_numpy(spark, buckets):
    rows = [(None if k % 7 == 0 else "ab"[k % 2], k % 3, None if k % 11 == 0 else float(np.round(DRAW.normal(), 1))) for k in range(300)] + [("none", 0, None)]
    df = spark.createDataFrame(rows, "g string, h int, v double")
    points = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.h): r._q for r in ordering.group_quantiles(df, ["g", "h"], "v", points, buckets=buckets).collect()}
    assert set(got) == {r[:2] for r in rows if r[2] is not None}
    for key, q in got.items():
        assert q == pytest.approx(np.quantile([r[2] for r in rows if r[:2] == key and r[2] is not None], points))


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_equal_a_loop(spark, descending):
    values = sorted({round(float(v), 2) for v in DRAW.normal(0, 3, 200)})
    rows = [(v, k % 5, float(k)) for k, v in enumerate(values)]
    got = {r.v: r for r in ordering.running_sums(spark.createDataFrame(rows, "v double, n int, x double").repartition(3), "v", ["n", "x"], descending=descending, buckets=6).collect()}
    for v in values:
        mine = [r for r in rows if (r[0] >= v if descending else r[0] <= v)]
        assert (got[v].n, got[v].x) == (sum(r[1] for r in mine), sum(r[2] for r in mine))


def test_no_percentile_of_a_whole_group(spark):
    """Medians by group and ranks by class come from buckets: no plan gathers a group's values for ``percentile`` or sorts a class."""
    for name in ("clu_profile", "traj_matrix_filter", "gc_detect", "label_6class", "label_udx_terciles", "label_alt_rules", "ews_segment"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan, name
    specs = registry.queries()["range_window_specs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in specs


def test_scores_of_raw_weeks_follow_the_features(spark, tmp_path):
    """Scoring raw weeks gives what scoring the same entities' features gives."""
    from weekloom.operators import features
    from weekloom.operators.panel import build_panel

    d = "/root/testdata/sf0.001"
    weeks, meta = tables.weekly(spark, d), tables.meta(spark, d)
    ready = features.feat_early30(build_panel(weeks, meta))
    models.save_model(ready.withColumn("y", F.when(F.col("sales_mean") > ready.agg(F.avg("sales_mean")).first()[0], "high").otherwise("low")), ["slope_all", "sales_mean"], "y", str(tmp_path / "m"))
    want = {r.public_id: r.prediction for r in models.score_new(str(tmp_path / "m"), ready).collect()}
    got = {r.public_id: r for r in models.score_weeks(str(tmp_path / "m"), weeks, meta).collect()}
    assert {k: r.prediction for k, r in got.items()} == want and want
    assert all(sum(r.probability) == pytest.approx(1) for r in got.values())
