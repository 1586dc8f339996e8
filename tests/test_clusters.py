"""Silhouette, warping distance, medoids and importances against plain loops on small tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.operators import clusters, models

DRAW = np.random.default_rng(21)


def warp(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1, j + 1] = (x - y) ** 2 + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


def test_silhouette_equals_all_pairs(spark):
    """Three clusters, one of a single point, and repeated points."""
    x = np.r_[DRAW.normal(0, 1, (40, 3)), DRAW.normal(4, 1, (30, 3)), [[9.0, 9.0, 9.0]], np.full((5, 3), 0.25)] + 1000
    of = ["a"] * 40 + ["b"] * 30 + ["alone"] + ["a"] * 5
    df = spark.createDataFrame([(k, of[k], x[k].tolist()) for k in range(len(x))] + [(999, None, [0.0] * 3), (998, "a", None)], "k long, cluster string, v array<double>").repartition(3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(len(x)):
        own = [j for j in range(len(x)) if of[j] == of[i] and j != i]
        if not own:
            want.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, [j for j in range(len(x)) if of[j] == g]].mean() for g in set(of) - {of[i]})
        want.append((b - a) / max(a, b))
    got = clusters.euclidean_silhouette(df, key="k").first()
    assert (got.n, got.sampled, got.standard_error) == (len(x), len(x), 0.0) and got.silhouette == pytest.approx(np.mean(want), abs=1e-9)
    part = clusters.euclidean_silhouette(df, key="k", sample=30).first()
    assert 10 < part.sampled < 60 and abs(part.silhouette - np.mean(want)) < 4 * part.standard_error
    assert clusters.euclidean_silhouette(df.where("cluster = 'a'"), key="k").first().silhouette is None
    assert clusters.euclidean_silhouette(df.limit(0), key="k").first().n == 0


@pytest.mark.parametrize(("n", "m"), [(1, 1), (1, 7), (7, 1), (9, 9), (30, 17)])
def test_warping_by_anti_diagonals_equals_the_table(n, m):
    x, y = DRAW.normal(size=(12, n)).cumsum(axis=1), DRAW.normal(size=m).cumsum()
    got, least = clusters.warping_costs(x, y), clusters.warping_bounds(x, y)
    for k in range(len(x)):
        assert got[k] == pytest.approx(warp(x[k], y)) and least[k] <= got[k] + 1e-9


def test_nearest_warped_skips_and_is_exact(spark):
    """Several lengths, ties between equal centres, a null and an empty series; most centres are skipped."""
    shifts = [0.0, 6.0, 12.0, 18.0, 24.0]
    centres = [DRAW.normal(s, 1, 20) for s in shifts]
    centres.append(centres[1].copy())
    rows = [(k, (DRAW.normal(shifts[k % 5], 1, 15 + k % 3)).tolist()) for k in range(90)] + [(100, None), (101, [])]
    got = {r.k: r for r in clusters.nearest_warped(spark.createDataFrame(rows, "k int, v array<double>"), "v", clusters._ragged(centres), key="k").collect()}
    for k, v in rows:
        if not v:
            assert got[k].cluster is None and got[k].distance is None
            continue
        costs = [warp(v, y) for y in centres]
        assert got[k].cluster == int(np.argmin(costs)) and got[k].distance == pytest.approx(math.sqrt(min(costs)))
    assert sum(got[k].skipped for k in range(90)) > 0.5 * 90 * len(centres)


def test_medoids_come_from_all_rows(spark):
    """Three groups and one far row: a medoid is the best of its group's candidates."""
    rows = [(k, DRAW.normal([0, 8, 16][k % 3], 0.5, 12).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, v array<double>").repartition(4)
    centres = clusters.warped_medoids(df, "v", 3, key="k", rounds=2, candidates=60)
    assert sorted(round(float(np.mean(y)) / 8) for y in centres) == [0, 1, 2]
    for y in centres:
        group = [np.array(v) for _, v in rows if round(np.mean(v) / 8) == round(float(np.mean(y)) / 8)]
        sums = [sum(math.sqrt(warp(a, b)) for a in group) for b in group]
        assert sum(math.sqrt(warp(a, y)) for a in group) == pytest.approx(min(sums))
    assert len(clusters.warped_medoids(df, "v", 2, key="k", rounds=0)) == 2
    assert len(clusters.warped_medoids(df.limit(0), "v", 2, key="k")) == 0
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "k int, v array<double>")
    assert len(clusters.warped_medoids(same, "v", 3, key="k")) == 1


def test_shape_clusters_mean_all_rows(spark):
    """Sums made in tasks give the same centres as a loop over all rows."""
    rows = [(k, (np.sin(np.arange(16) / (2 if k % 2 else 5)) + DRAW.normal(0, 0.05, 16)).tolist()) for k in range(40)]
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(3)
    got, centres = models.shape_clusters(df, "v", 2, key="k", rounds=1)
    seeds = np.array([r[0] for r in df.select("v").orderBy(F.xxhash64("k"), "k").limit(2).collect()])
    x = np.array([v for _, v in rows])
    near = models.shape_distance(x, seeds).argmin(1)
    for j in np.unique(near):
        assert centres[j] == pytest.approx(x[near == j].mean(0))
    assert got.count() == 40


@pytest.fixture(scope="module")
def planted(spark):
    """One feature tells the label in cluster 0, another in cluster 1, and cluster 2 has one label only."""
    rows = []
    for k in range(360):
        a, b, z = (float(v) for v in DRAW.normal(size=3))
        g = k % 3
        rows.append((k, g, k % 2, "up" if g == 2 or (a, b)[g] > 0 else "down", a, b, z))
    return spark.createDataFrame(rows, "k long, cluster int, fold int, label string, a double, b double, z double")


def test_importances_find_the_planted_feature(planted):
    got = planted.sparkSession.createDataFrame(clusters.cluster_importances(planted, ["a", "b", "z"], "label").collect())
    rows = {(r.cluster, r.feature): r for r in got.collect()}
    assert rows[0, "a"]["rank"] == 1 and rows[1, "b"]["rank"] == 1 and rows[0, "a"].importance > 0.7
    assert all(rows[2, x].importance == 0 for x in "abz")
    up = planted.where("cluster = 0 and label = 'up'").agg(F.avg("a")).first()[0]
    assert rows[0, "a"].mean_up == pytest.approx(up) and rows[2, "a"].mean_down is None
    assert clusters.cluster_importances(planted, ["a", "b", "z"], "label", top=1).count() == 3


def test_permutation_importance(planted):
    got = {r.feature: r for r in clusters.permutation_importance(planted.where("cluster = 0"), ["a", "b", "z"], "label", key="k", bucket=40).collect()}
    assert got["a"].importance > 0.3 and abs(got["z"].importance) < 0.1 and got["a"].folds == 2
