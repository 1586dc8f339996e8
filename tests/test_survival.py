"""Concordance, fits by group with tied times, and tests of proportional hazards against loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.operators import survival

KIND = "t double, e int, g string, a double, b double"


def spells(n=150, seed=3, round_to=0):
    draw = np.random.default_rng(seed)
    x, g = draw.normal(size=(n, 2)), draw.integers(0, 3, n)
    x[:, 1] += 0.6 * x[:, 0]
    t = np.maximum(np.round(draw.exponential(8, n) * np.exp(-0.5 * x[:, 0]), round_to), 0.5)
    e = (draw.random(n) < 0.7).astype(int)
    return [(float(t[k]), int(e[k]), f"g{g[k]}", float(x[k, 0]), float(np.round(x[k, 1], 1))) for k in range(n)]


def pairs_of(rows, score):
    pairs = concordant = tied = 0
    for i in rows:
        for j in rows:
            if i[1] and (j[0] > i[0] or (j[0] == i[0] and not j[1])):
                pairs += 1
                concordant += i[score] > j[score]
                tied += i[score] == j[score]
    return pairs, concordant, tied


@pytest.mark.parametrize("round_to", [0, 3])
@pytest.mark.parametrize("buckets", [2, 5, 64])
def test_concordance_equals_all_pairs(spark, round_to, buckets):
    """Tied and untied times, a score that holds a third of all rows, nulls, and a group of one row."""
    rows = spells(240, round_to=round_to)
    rows = [(*r[:3], 0.25 if k % 3 == 0 else r[3], r[4]) for k, r in enumerate(rows)] + [(3.0, 1, "alone", 1.0, 1.0)]
    df = spark.createDataFrame([*rows, (None, 1, "g0", 1.0, 1.0), (4.0, None, "g0", 1.0, 1.0), (4.0, 1, "g0", None, None)], KIND)
    for score in ("a", "b"):
        got = survival.concordance(df, time="t", event="e", score=score, buckets=buckets).first()
        want = pairs_of(rows, 3 if score == "a" else 4)
        assert (got.pairs, got.concordant, got.tied) == want
        assert got.concordance == pytest.approx((want[1] + want[2] / 2) / want[0])
    by = {r.g: r for r in survival.concordance(df, time="t", event="e", score="b", by="g", buckets=buckets).collect()}
    for g in ("g0", "g1", "g2"):
        assert (by[g].pairs, by[g].concordant, by[g].tied) == pairs_of([r for r in rows if r[2] == g], 4)
    assert by["alone"].pairs == 0 and by["alone"].concordance is None


def test_no_task_counts_more_than_a_bucket(spark, monkeypatch):
    """One time and one score of a third of all rows are never gathered; other buckets hold their share."""
    draw = np.random.default_rng(1)
    rows = [(7.0 if k % 3 == 0 else float(draw.exponential(9)), k % 2, "g", 0.5 if k % 3 == 1 else float(draw.normal()), 0.0) for k in range(3000)]
    sizes = spark.sparkContext.accumulator(0)

    class Watched:
        def __init__(self, grouped):
            self.grouped = grouped

        def applyInPandas(self, run, schema):
            def watched(g):
                if len(g) > 3000 / 16 * 2:
                    sizes.add(1)
                return run(g)

            return self.grouped.applyInPandas(watched, schema)

        def __getattr__(self, name):
            return getattr(self.grouped, name)

    kind = type(spark.range(1))
    grouped = kind.groupBy
    monkeypatch.setattr(kind, "groupBy", lambda self, *keys: Watched(grouped(self, *keys)))
    got = survival.concordance(spark.createDataFrame(rows, KIND), time="t", event="e", score="a", buckets=16).first()
    monkeypatch.undo()
    assert sizes.value == 0
    t, e, s = (np.array([r[k] for r in rows]) for k in (0, 1, 3))
    fits = (e[:, None] == 1) & ((t[None] > t[:, None]) | ((t[None] == t[:, None]) & (e[None] == 0)))
    assert (got.pairs, got.concordant, got.tied) == (fits.sum(), (fits & (s[:, None] > s[None])).sum(), (fits & (s[:, None] == s[None])).sum())


def newton(rows, xs, ridge, ties):
    x, t, e = np.array([[r[k] for k in xs] for r in rows]), np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    beta, k = np.zeros(len(xs)), len(xs)
    for _ in range(40):
        u, h = -ridge * len(rows) * beta, ridge * len(rows) * np.eye(k)
        for time in sorted(set(t[e == 1])):
            dead, at = (t == time) & (e == 1), t >= time
            w = np.exp(x @ beta)
            for place in range(dead.sum()):
                share = place / dead.sum() if ties == "efron" else 0.0
                v = w * at - share * w * dead
                m = v @ x / v.sum()
                u = u - m
                h = h + (x * v[:, None]).T @ x / v.sum() - np.outer(m, m)
            u = u + x[dead].sum(axis=0)
        move = np.linalg.solve(h, u)
        beta = beta + move
    return beta, np.sqrt(np.diag(np.linalg.inv(h)))


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_cox_by_group_equals_loops(spark, ties):
    rows = spells()
    got = {(r.g, r.predictor): r for r in survival.cox(spark.createDataFrame(rows, KIND), ["a", "b"], time="t", event="e", by="g", ties=ties).collect()}
    for g in ("g0", "g1", "g2"):
        part = [r for r in rows if r[2] == g]
        beta, se = newton(part, (3, 4), 0.01, ties)
        pairs, concordant, tied = pairs_of([(*r[:3], r[3] * beta[0] + r[4] * beta[1]) for r in part], 3)
        for k, x in enumerate("ab"):
            r = got[g, x]
            assert (r.coefficient, r.se) == (pytest.approx(beta[k], abs=1e-6), pytest.approx(se[k], abs=1e-6))
            assert (r.n, r.events) == (len(part), sum(p[1] for p in part))
            assert r.concordance == pytest.approx((concordant + tied / 2) / pairs, abs=2e-3)
    whole = survival.cox(spark.createDataFrame(rows, KIND), ["a", "b"], time="t", event="e", ties=ties).collect()
    beta, _ = newton(rows, (3, 4), 0.01, ties)
    assert [r.coefficient for r in whole] == [pytest.approx(b, abs=1e-6) for b in beta]


def test_cox_without_events_or_rows(spark):
    rows = [(float(k), 0, "g", float(k % 3), 1.0) for k in range(1, 9)]
    got = survival.cox(spark.createDataFrame(rows, KIND), ["a"], time="t", event="e").first()
    assert got.coefficient == 0 and got.events == 0 and got.concordance is None
    assert survival.cox(spark.createDataFrame([], KIND), ["a"], time="t", event="e").count() == 0
    assert survival.ph_check(spark.createDataFrame([], KIND), ["a"], time="t", event="e").count() == 0
    assert survival.ph_check(spark.createDataFrame(rows, KIND), ["a"], time="t", event="e").count() == 0


def test_ph_check_equals_loops(spark):
    """Two correlated predictors: scaled by the fit's covariance, by each time's own, and the score test."""
    rows = spells(round_to=1)
    got = {r.predictor: r for r in survival.ph_check(spark.createDataFrame(rows, KIND), ["a", "b"], time="t", event="e").collect()}
    beta, _ = newton(rows, (3, 4), 0.0, "breslow")
    x, t, e = np.array([r[3:] for r in rows]), np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    times = np.sort(t[e == 1])
    rank = {v: np.mean(np.flatnonzero(times == v)) + 1 for v in times}
    resid, ranks, own = [], [], []
    for k in np.flatnonzero(e):
        w = np.exp(x @ beta) * (t >= t[k])
        m = w @ x / w.sum()
        resid.append(x[k] - m)
        ranks.append(rank[t[k]])
        own.append((x * w[:, None]).T @ x / w.sum() - np.outer(m, m))
    resid, g, own = np.array(resid), np.array(ranks) - np.mean(ranks), np.array(own)
    n, ss = len(g), (g**2).sum()
    cov = np.linalg.inv(own.sum(axis=0))
    scaled = n * resid @ cov
    u = g @ resid
    info = (g[:, None, None] ** 2 * own).sum(axis=0) - (g[:, None, None] * own).sum(axis=0) @ cov @ (g[:, None, None] * own).sum(axis=0)
    single = np.array([np.linalg.pinv(v, rcond=1e-10) @ r for v, r in zip(own, resid, strict=True)])
    for k, name in enumerate("ab"):
        assert got[name].chi2 == pytest.approx((g @ scaled[:, k]) ** 2 / (n * cov[k, k] * ss), rel=1e-6)
        assert got[name].score_chi2 == pytest.approx(u[k] ** 2 / info[k, k], rel=1e-6)
        assert got[name].correlation == pytest.approx(np.corrcoef(g, single[:, k])[0, 1], abs=1e-6)
    assert got["GLOBAL"].chi2 == pytest.approx(n * u @ cov @ u / ss, rel=1e-6)
    assert got["GLOBAL"].score_chi2 == pytest.approx(u @ np.linalg.solve(info, u), rel=1e-6)
    assert got["GLOBAL"].n_events == n and 0 < got["GLOBAL"].score_p < 1


def test_risk_sets_use_buckets_of_times(spark):
    """Sums over all later times come from windows inside buckets of times."""
    rows = spells(400, round_to=4)
    placed = survival._weighted(survival._spells(spark.createDataFrame(rows, KIND), ["a"], "t", "e", None), {0: np.array([0.3])})
    risk = survival._risk_sets(placed, 1)
    assert placed.select("_b").distinct().count() > 30
    assert "hashpartitioning(_b" in risk._jdf.queryExecution().executedPlan().toString()
    for r in risk.orderBy(F.rand(1)).limit(20).collect():
        assert r.r == pytest.approx(sum(np.exp(0.3 * x[3]) for x in rows if x[0] >= r.t))
