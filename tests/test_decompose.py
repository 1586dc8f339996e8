"""STL of many series at once against a plain loop over one."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from weekloom.operators import stl


def line_at(y, at, left, size, span, weights):
    """The local line at one place, summed value by value; None without weight."""
    n = len(y)
    reach = max(at - left, left + size - 1 - at)
    if span > n:
        reach += (span - n) // 2
    w = []
    for j in range(left, left + size):
        away = abs(j - at)
        if away > 0.999 * reach:
            w.append(0.0)
            continue
        one = 1.0 if away <= 0.001 * reach else (1 - (away / reach) ** 3) ** 3
        w.append(one * (1.0 if weights is None else weights[j]))
    total = sum(w)
    if total <= 0:
        return None
    w = [v / total for v in w]
    mean = sum(v * j for v, j in zip(w, range(left, left + size)))
    spread = sum(v * (j - mean) ** 2 for v, j in zip(w, range(left, left + size)))
    if reach > 0 and spread**0.5 > 0.001 * (n - 1):
        w = [v * ((at - mean) / spread * (j - mean) + 1) for v, j in zip(w, range(left, left + size))]
    return sum(v * y[j] for v, j in zip(w, range(left, left + size)))


def smooth(y, span, weights=None):
    n, out = len(y), []
    size = min(span, n)
    left = 0
    for i in range(n):
        if i >= (span + 1) // 2 and left + size < n:
            left += 1
        value = line_at(y, i, left, size, span, weights)
        out.append(y[i] if value is None else value)
    return out


def plain(y, period, robust, seasonal=7):
    n = len(y)
    trend_span = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    trend_span += trend_span % 2 == 0
    low_span = period + 1 + (period % 2 == 1)
    trend, season, weights = [0.0] * n, [0.0] * n, None
    for k in range(16 if robust else 1):
        for _ in range(2 if robust else 5):
            cycle = [0.0] * (n + 2 * period)
            for p in range(period):
                part = [y[i] - trend[i] for i in range(p, n, period)]
                own = None if weights is None else [weights[i] for i in range(p, n, period)]
                inside = smooth(part, seasonal, own)
                size = min(seasonal, len(part))
                first = line_at(part, -1, 0, size, seasonal, own)
                last = line_at(part, len(part), len(part) - size, size, seasonal, own)
                whole = [inside[0] if first is None else first, *inside, inside[-1] if last is None else last]
                for i, v in enumerate(whole):
                    cycle[p + i * period] = v
            low = cycle
            for width in (period, period, 3):
                low = [sum(low[i : i + width]) / width for i in range(len(low) - width + 1)]
            low = smooth(low, low_span)
            season = [cycle[period + i] - low[i] for i in range(n)]
            trend = smooth([y[i] - season[i] for i in range(n)], trend_span, weights)
        if robust and k < 15:
            rest = [abs(y[i] - trend[i] - season[i]) for i in range(n)]
            scale = 6 * float(np.median(rest))
            weights = [1.0 if r <= 0.001 * scale else (1 - (r / scale) ** 2) ** 2 if r <= 0.999 * scale else 0.0 for r in rest]
    return trend, season


def series(n, seed):
    draw = np.random.default_rng(seed)
    y = 10 + 0.05 * np.arange(n) + 3 * np.sin(2 * np.pi * np.arange(n) / 13) + draw.normal(0, 0.5, n)
    y[draw.integers(0, n, max(1, n // 20))] += 25
    return y


# Robust weights of series of just two periods hang on rounding: their rest is nothing.
@pytest.mark.parametrize(("n", "robust"), [(26, False), (31, True), (31, False), (60, True), (105, True), (105, False)])
def test_many_series_equal_a_loop(n, robust):
    y = np.stack([series(n, k) for k in range(3)] + [np.full(n, 4.0)])
    trend, season, _ = stl.decompose(y, 13, robust=robust)
    for k in range(len(y)):
        want_trend, want_season = plain(list(y[k]), 13, robust)
        assert np.abs(trend[k] - want_trend).max() < 1e-9 and np.abs(season[k] - want_season).max() < 1e-9


def test_outliers_leave_the_robust_trend():
    y = 10 + 3 * np.sin(2 * np.pi * np.arange(104) / 13)
    spoiled = y.copy()
    spoiled[[20, 51, 77]] += 60
    trend, season, weights = stl.decompose(spoiled[None], 13)
    assert np.abs(trend[0] - 10).max() < 0.1 and np.abs(season[0] - (y - 10)).max() < 0.1 and (weights[0, [20, 51, 77]] == 0).all()


def test_stl_of_a_panel(spark):
    """Series of several lengths, a short one, nulls, one value, and a row that repeats."""
    rows = [(f"e{k}", t, float(v)) for k, n in enumerate((30, 30, 41, 33, 9, 1)) for t, v in enumerate(series(n, k))]
    df = spark.createDataFrame([*rows, ("e0", 99, None), ("gone", 1, None)], "e string, t int, v double").repartition(3)
    got = {}
    for r in stl.stl_trend(df, entity="e", order="t", value="v", batch=2).collect():
        got.setdefault(r.e, []).append((r.t, r.trend, r.seasonal, r.rest))
    assert sorted(got) == [f"e{k}" for k in range(6)]
    for k, n in enumerate((30, 30, 41, 33, 9, 1)):
        t, trend, season, rest = map(list, zip(*sorted(got[f"e{k}"]), strict=True))
        y = series(n, k)
        assert t == list(range(n))
        if n >= 26:
            want = plain(list(y), 13, True)
            assert np.allclose(trend, want[0], atol=1e-9) and np.allclose(season, want[1], atol=1e-9)
        else:
            assert np.allclose(trend, pd.Series(y).rolling(13, min_periods=1, center=True).mean()) and not any(season)
        assert np.allclose(np.add(np.add(trend, season), rest), y)
    assert stl.stl_trend(df.limit(0), entity="e", order="t", value="v").count() == 0
