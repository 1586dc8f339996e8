"""Bucketed quantiles, ranks and matches against numpy and brute force, with ties, nulls and empty tables."""

from __future__ import annotations

import random

import numpy as np
import pytest

from weekloom.operators import causal, ordering, panel, statistics


@pytest.mark.parametrize("buckets", [2, 7, 64, None])
def test_quantiles_equal_numpy(spark, buckets):
    draw = random.Random(9)
    rows = [(None if draw.random() < 0.2 else round(draw.gauss(0, 2), 1), draw.choice([1, 1, 1, 5, 9]), None) for _ in range(501)]
    df = spark.createDataFrame(rows, "a double, b int, c double")
    points = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = ordering.quantiles(df, ["a", "b", "c"], points, buckets=buckets).first()[0]
    assert got[0] == pytest.approx(np.quantile([r[0] for r in rows if r[0] is not None], points))
    assert got[1] == pytest.approx(np.quantile([r[1] for r in rows], points))
    assert got[2] is None
    assert ordering.quantiles(df.limit(0), ["a"], points).first()[0] == [None]


def test_ranks_of_groups_equal_brute_force(spark):
    draw = random.Random(3)
    rows = [(draw.choice("xy"), draw.randint(0, 30)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {(r.g, r.v): r["rank"] for r in statistics.average_ranks(df, "v", by=["g"], buckets=5).collect()}
    for g, v in set(rows):
        mine = [x for h, x in rows if h == g]
        assert got[g, v] == sum(x < v for x in mine) + (mine.count(v) + 1) / 2
    assert len(got) == len(set(rows))


def test_matches_with_tied_scores_equal_brute_force(spark):
    draw = random.Random(5)
    a = [(i, draw.choice([0.5, 0.5, 0.5, round(draw.random(), 1)]), draw.choice("xy")) for i in range(60)] + [(900, None, "x"), (901, 0.5, "nobody"), (0, 0.0, "x")]
    b = [(100 + i, round(draw.random(), 1), draw.choice("xy")) for i in range(40)]
    schema = "k long, s double, st string"
    got = causal.nearest_match(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), key="k", score="s", stratum="st", buckets=4)
    want = []
    for k, s, st in a:
        found = [(abs(x - s), x, i) for i, x, h in b if h == st] if s is not None else []
        if found:
            want.append((k, min((round(d, 9), x, i) for d, x, i in found)[2]))
    assert sorted((r.treated, r.control) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("stratum", [None, "st"])
def test_decimal_scores_at_equal_distances_match_the_smaller(spark, stratum):
    """Both controls lie at 0.08, 0.77 and 1.53; in floats the larger is nearer by the last bits."""
    near = [(1210.68, 1210.6, 1210.76), (5966.92, 5966.15, 5967.69), (5336.64, 5335.11, 5338.17)]
    assert all(high - s < s - low for s, low, high in near)
    a = spark.createDataFrame([(k, s, "x") for k, (s, _, _) in enumerate(near)], "k long, s double, st string")
    b = spark.createDataFrame([(10 * side + k, row[side], "x") for k, row in enumerate(near) for side in (1, 2)], "k long, s double, st string")
    got = causal.nearest_match(a, b, key="k", score="s", stratum=stratum, buckets=4)
    assert sorted((r.treated, r.control) for r in got.collect()) == [(0, 10), (1, 11), (2, 12)]


def test_standardize_treats_columns_alone(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (None, 7.0), (4.0, 7.0), (50.0, None)], "a double, b double")
    both = [(r.a, r.b) for r in panel.standardize_cols(df, ["a", "b"]).collect()]
    x = np.array([1, 2, 3, 4, 50.0])
    x = np.clip(x, *np.quantile(x, [0.01, 0.99]))
    assert sorted(a for a, _ in both) == pytest.approx(sorted((x - x.mean()) / x.std(ddof=1)))
    assert {b for _, b in both} == {0.0}
