"""Fitted models and tests against loops and closed forms on small frames."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.operators import causal, models, survival
from weekloom.operators import statistics as st
from weekloom.sources.tables import read_encoded_csv, write_encoded_csv

DRAW = np.random.default_rng(7)


def spells(n=60):
    x, g = DRAW.normal(size=(n, 2)), DRAW.integers(0, 3, n)
    t = np.ceil(DRAW.exponential(8, n) * np.exp(-0.5 * x[:, 0])).astype(int)
    return [(int(a), int(b), f"g{k}", float(u), float(v)) for a, b, k, (u, v) in zip(t, DRAW.random(n) < 0.7, g, x, strict=True)]


def test_cox_equals_loops(spark):
    rows = spells()
    got = {r.predictor: r for r in survival.cox(spark.createDataFrame(rows, "t int, e int, g string, a double, b double"), ["a", "b"], time="t", event="e", ridge=0.01, ties="breslow").collect()}
    x, t, e = np.array([r[3:] for r in rows]), np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    beta = np.zeros(2)
    for _ in range(30):
        u, h = -0.01 * len(rows) * beta, 0.01 * len(rows) * np.eye(2)
        for k in np.flatnonzero(e):
            at = t >= t[k]
            w = np.exp(x[at] @ beta)
            m = w @ x[at] / w.sum()
            u = u + x[k] - m
            h = h + (x[at] * w[:, None]).T @ x[at] / w.sum() - np.outer(m, m)
        beta = beta + np.linalg.solve(h, u)
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    for k, name in enumerate("ab"):
        r = got[name]
        assert r.coefficient == pytest.approx(beta[k], abs=1e-6) and r.se == pytest.approx(se[k], abs=1e-6)
        assert (r.low, r.high) == (pytest.approx(math.exp(beta[k] - 1.959964 * se[k]), rel=1e-5), pytest.approx(math.exp(beta[k] + 1.959964 * se[k]), rel=1e-5))


def test_log_rank_equals_loops(spark):
    rows = spells()
    got = causal.log_rank(spark.createDataFrame(rows, "t int, e int, g string, a double, b double"), group="g", time="t", event="e").first()
    groups = sorted({r[2] for r in rows})
    u, v = np.zeros(3), np.zeros((3, 3))
    for time in sorted({r[0] for r in rows if r[1]}):
        n = np.array([sum(r[0] >= time and r[2] == g for r in rows) for g in groups], float)
        d = np.array([sum(r[0] == time and r[1] and r[2] == g for r in rows) for g in groups], float)
        u += d - d.sum() * n / n.sum()
        if n.sum() > 1:
            v += d.sum() * (n.sum() - d.sum()) / (n.sum() - 1) * (np.diag(n / n.sum()) - np.outer(n, n) / n.sum() ** 2)
    assert got.chi2 == pytest.approx(u[:2] @ np.linalg.inv(v[:2, :2]) @ u[:2], abs=1e-8) and got.p == pytest.approx(math.exp(-got.chi2 / 2), abs=1e-8)


def test_granger_equals_least_squares(spark):
    x = np.cumsum(DRAW.normal(size=60)) + 50
    y = np.r_[50, 0.8 * x[:-1] + DRAW.normal(size=59) * 0.1 + 10]
    panel = spark.createDataFrame([("a", k, float(p), float(q)) for k, (p, q) in enumerate(zip(x, y, strict=True))], "public_id string, week_idx int, customer double, sales_card double")
    tests = causal.granger_entities(panel)
    got = {r.direction: r for r in tests.collect()}
    dx, dy = np.diff(x), np.diff(y)
    for name, cause, effect in (("a_to_b", dx, dy), ("b_to_a", dy, dx)):
        own = np.array([[1.0, *effect[k - 4 : k]] for k in range(4, 59)])
        full = np.hstack([own, np.array([cause[k - 4 : k] for k in range(4, 59)])])
        rss = [((effect[4:] - m @ np.linalg.pinv(m) @ effect[4:]) ** 2).sum() for m in (own, full)]
        assert got[name].f == pytest.approx((rss[0] - rss[1]) / 4 / (rss[1] / (55 - 9)), rel=1e-6)
    s = causal.granger_shares(tests).first()
    assert s.n == 1 and s.a_to_b == 1 and s.both == s.b_to_a


def test_warping_distance_equals_the_plain_table():
    for n, m in product((1, 4, 9), (1, 5, 9)):
        a, b = DRAW.normal(size=n), DRAW.normal(size=m)
        d = np.full((n + 1, m + 1), np.inf)
        d[0, 0] = 0
        for i, j in product(range(n), range(m)):
            d[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(d[i, j], d[i, j + 1], d[i + 1, j])
        assert models.warping_distance(a[None], b[None])[0, 0] == pytest.approx(math.sqrt(d[-1, -1]))


def test_kmeans_assigns_to_the_nearest_mean(spark):
    points = np.vstack([DRAW.normal(k * 10, 1, (20, 2)) for k in range(3)])
    df = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "id int, v array<double>")
    got = {r.id: r.cluster for r in models.kmeans(df, "v", 3, key="id").select("id", "cluster").collect()}
    assert all(len({got[k] for k in range(20 * g, 20 * g + 20)}) == 1 for g in range(3)) and len(set(got.values())) == 3
    s = models.stability(df, "v", 3, key="id").first()
    assert (s.nmi, s.ari, s.sample_ari) == (pytest.approx(1), pytest.approx(1), pytest.approx(1))


def test_adjusted_information_equals_the_whole_sum(spark):
    rows = [(int(a), int(b)) for a, b in zip(DRAW.integers(0, 3, 50), DRAW.integers(0, 4, 50), strict=True)]
    got = st.adjusted_mutual_information(spark.createDataFrame(rows, "a int, b int"), "a", "b")
    cells = np.zeros((3, 4))
    for a, b in rows:
        cells[a, b] += 1
    p, q, n = cells.sum(1), cells.sum(0), 50
    entropy = lambda m: -sum(x / n * math.log(x / n) for x in m if x)
    mi = entropy(p) + entropy(q) - entropy(cells.ravel())
    expected = sum(
        k / n * math.log(n * k / (x * y)) * math.comb(int(y), k) * math.comb(n - int(y), int(x) - k) / math.comb(n, int(x))
        for x in p for y in q for k in range(max(1, int(x + y) - n), int(min(x, y)) + 1)
    )
    assert got == pytest.approx((mi - expected) / ((entropy(p) + entropy(q)) / 2 - expected), abs=1e-9)
    big = spark.range(40).select((F.col("id") % 2).alias("a"), (F.col("id") % 4).alias("b"))
    assert st.adjusted_mutual_information(big, "a", "b") == pytest.approx(2 / 3, abs=0.05)


def test_bootstrap_covers_the_mean(spark):
    values = DRAW.normal(5, 2, 2000)
    rows = spark.createDataFrame([(k, float(x)) for k, x in enumerate(values)] + [(9000, None)], "id int, x double")
    r = st.bootstrap_interval(rows, "x", key="id", replicates=60).first()
    se = values.std() / math.sqrt(len(values))
    assert r.low < values.mean() < r.high and 2 * se < r.high - r.low < 6 * se


def test_cp949_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "서울, \"강남\""), (2, None), (3, "plain")], "k int, name string")
    write_encoded_csv(rows, str(tmp_path / "x"), encoding="cp949")
    assert any("서울".encode("cp949") in f.read_bytes() for f in (tmp_path / "x").glob("part-*"))
    assert read_encoded_csv(spark, [str(tmp_path / "x")], "k int, name string", ["k", "name"], encoding="cp949").exceptAll(rows).count() == 0


@pytest.mark.parametrize("kind", ["logistic", "boosted"])
def test_out_of_fold_probabilities(spark, kind):
    rows = spark.createDataFrame([(k, k % 3, ["a", "b", "c"][k % 3 if k % 7 else 0], float(k % 3) + 0.01 * k) for k in range(60)], "id int, fold int, y string, x double").withColumn("fold", F.pmod(F.hash("id"), F.lit(2)))
    for r in models.cross_validated(rows, ["x"], "y", key="id", kind=kind).collect():
        assert sum(r.probability.values()) == pytest.approx(1) and r.probability[r.pred] == pytest.approx(max(r.probability.values()))


def test_a_saved_model_scores_new_rows(spark, tmp_path):
    rows = spark.createDataFrame([(float(k), "a" if k < 20 else "b") for k in range(40)], "x double, y string")
    models.save_model(rows, ["x"], "y", str(tmp_path / "m"))
    got = [r.prediction for r in models.score_new(str(tmp_path / "m"), rows.select("x")).orderBy("x").collect()]
    assert got == [0.0] * 20 + [1.0] * 20
