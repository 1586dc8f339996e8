"""Regressions from sums against independent fits on small tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.functions.pvalues import normal_two_sided
from weekloom.operators import causal, regression

DRAW = np.random.default_rng(11)


def outcomes(n=400):
    x = DRAW.normal(size=(n, 3))
    x[:, 2] += 0.5 * x[:, 0]
    eta = np.c_[np.zeros(n), 0.3 + x @ [0.8, 0.0, -0.4], -0.5 + x @ [-0.2, 0.6, 0.0]]
    p = np.exp(eta) / np.exp(eta).sum(axis=1, keepdims=True)
    y = (p.cumsum(axis=1) < DRAW.random(n)[:, None]).sum(axis=1)
    return x, y, DRAW.integers(0, 2, n)


def loglik(beta, x, y):
    """Log-likelihood, gradient and information, class by class."""
    m = np.c_[np.ones(len(x)), x]
    b = np.concatenate([np.zeros((1, m.shape[1])), beta])
    p = np.exp(m @ b.T)
    p /= p.sum(axis=1, keepdims=True)
    ll = sum(np.log(p[i, y[i]]) for i in range(len(y)))
    grad = np.concatenate([sum(((y[i] == k) - p[i, k]) * m[i] for i in range(len(y))) for k in range(1, len(b))])
    size = m.shape[1]
    info = np.zeros((grad.size, grad.size))
    for i in range(len(y)):
        q = p[i, 1:]
        info += np.kron(np.diag(q) - np.outer(q, q), np.outer(m[i], m[i]))
    assert info.shape[0] == size * (len(b) - 1)
    return ll, grad, info


def newton(x, y, classes=3):
    beta = np.zeros((classes - 1, x.shape[1] + 1))
    for _ in range(12):
        ll, grad, info = loglik(beta, x, y)
        beta = beta + np.linalg.solve(info, grad).reshape(beta.shape)
    ll, _, info = loglik(beta, x, y)
    return beta, np.sqrt(np.diag(np.linalg.inv(info))).reshape(beta.shape), ll


def test_multinomial_blocks_equal_newton(spark):
    x, y, g = outcomes()
    labels = ["Stable", "Growth", "Decline"]
    rows = [(labels[y[i]], *map(float, x[i]), f"s{g[i]}") for i in range(len(y))] + [("Other", 1.0, 1.0, 1.0, "s0"), ("Stable", None, 1.0, 1.0, "s0"), (None, 1.0, 1.0, 1.0, "s1")]
    df = spark.createDataFrame(rows, "label string, a double, b double, c double, side string").repartition(3)
    blocks = {"first": ["a"], "second": ["b", "c"]}
    for by, parts in ((None, {None: np.ones(len(y), bool)}), ("side", {"s0": g == 0, "s1": g == 1})):
        out, fits = regression.multinomial_blocks(df, blocks, "label", classes=labels, by=by)
        out, fits = out.collect(), {(r.asDict().get("side"), r.model): r for r in fits.collect()}
        for name, part in parts.items():
            px, py = x[part], y[part]
            null = sum(np.log((py == k).mean()) * (py == k).sum() for k in range(3))
            before = null
            for model, columns in (("first", [0]), ("second", [0, 1, 2])):
                beta, se, ll = newton(px[:, columns], py)
                got = {(r["class"], r.predictor): r for r in out if r.asDict().get("side") == name and r.model == model}
                for i, label in enumerate(labels[1:]):
                    for j, predictor in enumerate(["intercept", *("abc"[k] for k in columns)]):
                        r = got[label, predictor]
                        assert (r.coefficient, r.se) == (pytest.approx(beta[i, j], abs=1e-6), pytest.approx(se[i, j], abs=1e-6))
                        assert r.p == pytest.approx(normal_two_sided(beta[i, j] / se[i, j]), abs=1e-6)
                fit = fits[name, model]
                free = 2 * (len(columns) + 1)
                assert (fit.n, fit.lr_df) == (part.sum(), 2 * len(set(columns) - ({0} if model == "second" else set())))
                assert fit.log_likelihood == pytest.approx(ll, abs=1e-6) and fit.aic == pytest.approx(2 * free - 2 * ll, abs=1e-6)
                assert fit.pseudo_r2 == pytest.approx(1 - ll / null, abs=1e-8) and fit.lr_chi2 == pytest.approx(2 * (ll - before), abs=1e-6)
                before = ll


def test_logit_groups_equal_newton(spark):
    x, y, g = outcomes()
    df = spark.createDataFrame([(f"s{g[i]}", int(y[i] > 0), float(x[i, 0]), float(x[i, 1])) for i in range(len(y))] + [(None, 1, 0.0, 0.0), ("one", 1, 0.5, 0.5)], "side string, y int, a double, b double")
    got = {(r.side, r.predictor): r for r in regression.logit_groups(df, "side", "y", ["a", "b"]).collect()}
    for k in (0, 1):
        beta, se, _ = newton(x[g == k][:, :2], (y[g == k] > 0).astype(int), 2)
        for j, name in enumerate(["intercept", "a", "b"]):
            assert (got[f"s{k}", name].coefficient, got[f"s{k}", name].se) == (pytest.approx(beta[0, j], abs=1e-6), pytest.approx(se[0, j], abs=1e-6))
            assert got[f"s{k}", name].n == (g == k).sum()


def gappy(entities=30, periods=14):
    """A panel in which four in ten rows are missing, an entity with one row, and effects of both kinds."""
    rows = []
    for i in range(entities):
        for t in range(periods):
            if (i == 0 and t == 3) or (i > 0 and DRAW.random() < 0.6):
                x, z = DRAW.normal() + 0.2 * i + 0.1 * t, DRAW.normal() - 0.3 * t
                rows.append((i, t, 1.5 * x - 0.7 * z + 0.4 * i + np.sin(t) + 0.3 * DRAW.normal(), x, z))
    return rows


def test_twoway_effects_of_gappy_panels(spark):
    rows = gappy()
    df = spark.createDataFrame([*((str(i), t, float(y), float(x), float(z)) for i, t, y, x, z in rows), ("3", 5, None, 1.0, 1.0)], "e string, t int, y double, x double, z double")
    data = np.array(rows)
    dummies = np.c_[data[:, :1] == np.arange(30), data[:, 1:2] == np.arange(14)].astype(float)
    resid = data[:, 2:] - dummies @ np.linalg.lstsq(dummies, data[:, 2:], rcond=None)[0]
    got = {(int(r.e), r.t): (r.y, r.x, r.z) for r in regression.demeaned_twoway(df, ["y", "x", "z"], entity="e", period="t").collect()}
    assert len(got) == len(rows)
    for r, want in zip(rows, resid, strict=True):
        assert got[r[0], r[1]] == pytest.approx(tuple(want), abs=1e-8)
    beta = np.linalg.lstsq(np.c_[dummies, data[:, 3:]], data[:, 2], rcond=None)[0][-2:]
    exact = causal.fe_twoway(df, "y", ["x", "z"], entity="e", period="t", exact=True).first()
    assert (exact.x, exact.z) == (pytest.approx(beta[0], abs=1e-8), pytest.approx(beta[1], abs=1e-8)) and exact.n == len(rows)
    once = causal.fe_twoway(df, "y", ["x", "z"], entity="e", period="t").first()
    assert abs(once.x - beta[0]) > 1e-4
    # Clustered errors by hand.
    x, e = resid[:, 1:], resid[:, 0] - resid[:, 1:] @ beta
    scores = np.array([x[data[:, 0] == i].T @ e[data[:, 0] == i] for i in range(30) if (data[:, 0] == i).any()])
    bread, n, g = np.linalg.inv(x.T @ x), len(rows), len(scores)
    se = np.sqrt(np.diag(bread @ scores.T @ scores @ bread * g / (g - 1) * (n - 1) / (n - 2)))
    got = {r.predictor: r for r in causal.fe_cluster_se(df, "y", ["x", "z"], entity="e", period="t").collect()}
    for k, name in enumerate("xz"):
        assert (got[name].coefficient, got[name].se) == (pytest.approx(beta[k], abs=1e-8), pytest.approx(se[k], rel=1e-6))


def test_twoway_effects_of_whole_panels_and_none(spark):
    rows = [(f"e{i}", t, float(DRAW.normal()), float(DRAW.normal())) for i in range(6) for t in range(5)]
    df = spark.createDataFrame(rows, "e string, t int, y double, x double")
    once = {(r.e, round(r.y, 9)) for r in causal._demeaned(df, ["y", "x"], entity="e", period="t").collect()}
    exact = {(r.e, round(r.y, 9)) for r in regression.demeaned_twoway(df, ["y", "x"], entity="e", period="t").collect()}
    assert once == exact
    assert regression.demeaned_twoway(df.limit(0), ["y"], entity="e", period="t").count() == 0


def events(n=900):
    rows = []
    for _ in range(n):
        t, g, place, kind = int(DRAW.integers(-3, 3)), int(DRAW.integers(0, 2)), "ABC"[DRAW.integers(0, 3)], [None, "u", "v"][DRAW.integers(0, 3)]
        rows.append((t, g, place, kind, 0.3 * t + g * (t >= 0) + "ABC".index(place) + DRAW.normal()))
    return rows


def test_controlled_profile_equals_dummies(spark):
    rows = events()
    df = spark.createDataFrame([*rows, (0, 1, "A", "u", None)], "event_time int, grp int, place string, kind string, y double").withColumn("fitted_before", F.lit(1))
    out, profile = regression.controlled_profile(df, "y", group="grp", controls=["place", "kind"], width=3)
    got = {(r.term, r.level): r for r in out.collect()}
    times = [-2, -1, 0, 1, 2]
    design, names = [np.ones(len(rows))], [("intercept", "")]
    for t in times:
        design.append(np.array([r[0] == t for r in rows], float))
        names.append(("event_time", str(t)))
    design.append(np.array([r[1] for r in rows], float))
    names.append(("grp", "1"))
    for t in times:
        design.append(np.array([r[0] == t and r[1] for r in rows], float))
        names.append(("event_time:grp", f"{t}:1"))
    for k, column, levels in ((2, "place", ["B", "C"]), (3, "kind", ["u", "v"])):
        for level in levels:
            design.append(np.array([r[k] == level for r in rows], float))
            names.append((column, level))
    x, y = np.array(design).T, np.array([r[4] for r in rows])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    s2 = ((y - x @ beta) ** 2).sum() / (len(y) - x.shape[1])
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * s2)
    assert set(got) == set(names)
    for name, b, s in zip(names, beta, se, strict=True):
        assert (got[name].coefficient, got[name].se) == (pytest.approx(b, abs=1e-8), pytest.approx(s, rel=1e-6))
    fitted = x @ beta
    for r in profile.collect():
        part = np.array([fitted[k] for k, row in enumerate(rows) if (row[0], row[1]) == (r.event_time, r.grp)])
        assert (r.n, r.mean, r.std) == (len(part), pytest.approx(part.mean(), abs=1e-8), pytest.approx(part.std(ddof=1), abs=1e-8))
        assert r.sem == pytest.approx(part.std(ddof=1) / np.sqrt(len(part)), abs=1e-8)


def test_factors_that_others_determine(spark):
    """Two factors that are one: fitted values still are the cell means, and nothing is told of either level."""
    rows = [("a", "x", 1.0), ("a", "x", 3.0), ("b", "y", 5.0), ("b", "y", 9.0)]
    df = spark.createDataFrame(rows, "p string, q string, v double")
    fit = regression.factor_regression(df, "v", [("p",), ("q",)])
    assert {(r.p, round(r.fitted, 9)) for r in fit.fitted(df).collect()} == {("a", 2.0), ("b", 7.0)}
    assert {r.term: r.se is None for r in fit.coefficients.collect()} == {"intercept": False, "p": True, "q": True}
