"""Checks of clusters: Euclidean silhouette, warping distance with exact skips, medoids, and what tells outcomes apart inside clusters."""

from __future__ import annotations

from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.operators.models import assembled, classifier
from weekloom.sources.tables import discard, written

c = F.col


def _arrays(df: DataFrame, array: str):
    return c(array).cast("array<double>") if dict(df.dtypes)[array].startswith("array") else vector_to_array(c(array))


def euclidean_silhouette(clustered: DataFrame, *, key: str, array: str = "v", cluster: str = "cluster", sample: int = 2000) -> DataFrame:
    """Rows, sampled rows, mean silhouette by Euclidean distance, and its standard error.

    About ``sample`` points, chosen by hash of their key (all, if there are no
    more), are compared with every point: tasks sum the distances of the sample
    to a batch by cluster, as matrix products, so work grows with the rows and
    not with their square. With all points in the sample the mean is exact and
    the error 0. A point alone in its cluster counts 0.
    """
    rows = clustered.select(key, c(cluster).alias("_c"), _arrays(clustered, array).alias("_a")).where("_a is not null and _c is not null")
    sizes = {r["_c"]: r["n"] for r in rows.groupBy("_c").agg(F.count("*").alias("n")).orderBy("_c").collect()}  # a row for each cluster
    total, names = sum(sizes.values()), list(sizes)
    schema = "n long, sampled long, silhouette double, standard_error double"
    if len(names) < 2:
        return clustered.sparkSession.createDataFrame([(total, 0, None, None)], schema)
    rate = min(1.0, sample / total)
    drawn = rows.where(F.pmod(F.xxhash64(F.struct(key)), F.lit(1_000_003)) < rate * 1_000_003).select("_c", "_a").toPandas()
    points = np.stack(drawn["_a"].to_list()).astype(float) if len(drawn) else np.zeros((0, 0))
    place = {x: k for k, x in enumerate(names)}
    squares = (points**2).sum(axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(points), len(names)))
        for b in batches:
            for first in range(0, len(b), 512):
                part = b.iloc[first : first + 512]
                x = np.stack(part["_a"].to_list()).astype(float)
                apart = squares[:, None] - 2 * points @ x.T + (x**2).sum(axis=1)
                # Nearly equal points are compared digit by digit.
                scale = squares[:, None] + (x**2).sum(axis=1)
                i, j = np.nonzero(apart < 1e-6 * scale)
                apart[i, j] = ((points[i] - x[j]) ** 2).sum(axis=1)
                of = part["_c"].map(place).to_numpy()
                sums += np.sqrt(np.maximum(apart, 0)) @ (of[:, None] == np.arange(len(names)))
        i, k = np.indices(sums.shape)
        yield pd.DataFrame({"i": i.ravel(), "k": k.ravel(), "s": sums.ravel()})

    cells = rows.mapInPandas(run, "i long, k long, s double").groupBy("i", "k").agg(F.sum("s").alias("s")).toPandas()  # sample x clusters
    sums = np.zeros((len(points), len(names)))
    sums[cells["i"], cells["k"]] = cells["s"]
    n = np.array([sizes[x] for x in names], float)
    own = drawn["_c"].map(place).to_numpy()
    at = np.arange(len(points))
    a = sums[at, own] / np.maximum(n[own] - 1, 1)
    means = sums / n
    means[at, own] = np.inf
    b = means.min(axis=1)
    value = np.where(n[own] > 1, (b - a) / np.where(np.maximum(a, b) > 0, np.maximum(a, b), 1), 0)
    left = 1 - len(value) / total
    error = float(value.std(ddof=1) * np.sqrt(left / len(value))) if len(value) > 1 else None
    return clustered.sparkSession.createDataFrame([(total, len(value), float(value.mean()) if len(value) else None, error)], schema)


def warping_costs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared warping cost of each row of ``x`` with ``y``: all rows advance together, one anti-diagonal of cells a step."""
    n, m = x.shape[1], len(y)
    before, last = (np.full((len(x), n + 1), np.inf) for _ in range(2))
    for d in range(n + m - 1):
        low, high = max(0, d - m + 1), min(n - 1, d) + 1
        cost = (x[:, low:high] - y[d - np.arange(low, high)]) ** 2
        best = np.minimum(np.minimum(last[:, low + 1 : high + 1], last[:, low:high]), before[:, low:high]) if d else 0.0
        before, last = last, np.full_like(last, np.inf)
        last[:, low + 1 : high + 1] = cost + best
    return last[:, n]


def warping_bounds(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A lower bound of the squared warping cost: what either series has outside of the other's range, and the cost of both ends."""
    outside = lambda v, low, high: (np.maximum(v - high, 0) ** 2 + np.maximum(low - v, 0) ** 2).sum(axis=-1)
    ends = (x[:, 0] - y[0]) ** 2 + ((x[:, -1] - y[-1]) ** 2 if max(x.shape[1], len(y)) > 1 else 0)
    return np.maximum(np.maximum(outside(x, y.min(), y.max()), outside(y[None], x.min(axis=1)[:, None], x.max(axis=1)[:, None])), ends)


def nearest_warped(df: DataFrame, array: str, centres: np.ndarray, *, key: str) -> DataFrame:
    """key, cluster (the centre at the least warping distance, the first of equals), distance, and how many centres were skipped.

    A centre is skipped for the series whose lower bound is above their best
    cost so far, which leaves the result as it is. The centres are a handful of
    arrays in the closure. Series of one batch may differ in length; null and
    empty ones have no cluster.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for n, part in frame.groupby(frame["a"].map(lambda v: 0 if v is None else len(v)), sort=False):
                if not n:
                    yield pd.DataFrame({key: part[key], "cluster": pd.array([None] * len(part), "Int32"), "distance": pd.array([None] * len(part), "Float64"), "skipped": 0})
                    continue
                x = np.stack(part["a"].to_list()).astype(float)
                bounds = np.stack([warping_bounds(x, y) for y in centres], axis=1)
                best, which, skipped = np.full(len(x), np.inf), np.full(len(x), -1), np.zeros(len(x), int)
                for j in np.argsort(bounds.mean(axis=0), kind="stable"):
                    need = np.flatnonzero(bounds[:, j] <= best)
                    skipped += 1
                    skipped[need] -= 1
                    if len(need):
                        cost = warping_costs(x[need], centres[j])
                        nearer = (cost < best[need]) | ((cost == best[need]) & (j < which[need]))
                        best[need[nearer]], which[need[nearer]] = cost[nearer], j
                yield pd.DataFrame({key: part[key], "cluster": pd.array(which, "Int32"), "distance": pd.array(np.sqrt(best), "Float64"), "skipped": skipped})

    return df.select(key, c(array).cast("array<double>").alias("a")).mapInPandas(run, f"`{key}` {kind}, cluster int, distance double, skipped int")


def warped_medoids(df: DataFrame, array: str, k: int, *, key: str, rounds: int = 1, candidates: int = 8) -> np.ndarray:
    """``k`` centres for warping distance, fitted over all rows: far apart at first, then medoids.

    The first centre is the row with the least hash of its key; each next one is
    the row farthest from those so far. A round then takes of each cluster the
    ``candidates`` rows that hash lowest, and the centre so far, and keeps the
    one with the least sum of distances to all rows of the cluster. Centres come
    in the order of the smallest key among the rows nearest to them.
    """
    rows = df.select(key, c(array).cast("array<double>").alias("_a")).where("size(_a) > 0")
    first = rows.agg(F.min_by("_a", F.struct(F.xxhash64(F.struct(key)), key)).alias("a")).first()["a"]
    if first is None:
        return np.zeros((0, 0))
    centres = [first]
    while len(centres) < k:
        far = nearest_warped(rows, "_a", _ragged(centres), key=key).agg(F.max("distance").alias("d"), F.max_by(key, F.struct("distance", F.struct(key))).alias("key")).first()
        if not far["d"]:
            break
        centres.append(rows.where(c(key) == F.lit(far["key"])).first()["_a"])
    for _ in range(rounds):
        found = written(nearest_warped(rows, "_a", _ragged(centres), key=key).join(rows, key), "warped")
        lowest = F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64(F.struct(key)), key))
        tried = found.select("cluster", "_a", lowest.alias("r")).where(c("r") <= candidates).collect()  # k x candidates rows
        options = [[a, *(r["_a"] for r in tried if r["cluster"] == j)] for j, a in enumerate(centres)]
        arrays = [_ragged(x) for x in options]

        def run(batches: Iterator[pd.DataFrame], arrays=arrays) -> Iterator[pd.DataFrame]:
            sums = [np.zeros(len(x)) for x in arrays]
            for frame in batches:
                for (j, _), part in frame.groupby([frame["cluster"], frame["_a"].map(len)], sort=False):
                    x = np.stack(part["_a"].to_list()).astype(float)
                    sums[j] += [np.sqrt(warping_costs(x, y)).sum() for y in arrays[j]]
            yield pd.DataFrame([(j, i, s) for j, x in enumerate(sums) for i, s in enumerate(x)], columns=["j", "i", "s"])

        cost = found.select("cluster", "_a").mapInPandas(run, "j long, i long, s double").groupBy("j", "i").agg(F.sum("s").alias("s")).toPandas()
        discard(found)
        for j, part in cost.groupby("j"):
            centres[j] = options[j][int(part.sort_values(["s", "i"])["i"].iloc[0])]
    least = {r["cluster"]: r["least"] for r in nearest_warped(rows, "_a", _ragged(centres), key=key).groupBy("cluster").agg(F.min(key).alias("least")).collect()}
    return _ragged([centres[j] for j in sorted(least, key=least.get)] + [x for j, x in enumerate(centres) if j not in least])


def _ragged(arrays: list) -> np.ndarray:
    """Arrays of any lengths as an array of arrays."""
    out = np.empty(len(arrays), object)
    for k, x in enumerate(arrays):
        out[k] = np.asarray(x, float)
    return out


def cluster_importances(df: DataFrame, columns: list[str], label: str, *, cluster: str = "cluster", top: int | None = None, threads: int = 4) -> DataFrame:
    """cluster, feature, importance in the cluster's forest for ``label``, its rank, and the feature's mean for each label.

    A forest is fitted for each cluster, a few at a time. A cluster with one
    label has no forest and importances of 0. With ``top``, only so many
    features of each cluster are returned.
    """
    rows = written(df.select(cluster, label, *(c(x).cast("double").alias(x) for x in columns)).where(c(label).isNotNull() & c(cluster).isNotNull()).withColumn("_w", F.lit(1.0)), "rows")
    kinds = {r[0]: r[1] for r in rows.groupBy(cluster).agg(F.count_distinct(label)).orderBy(cluster).collect()}  # a row for each cluster

    def fitted(k):
        if kinds[k] < 2:
            return [0.0] * len(columns)
        model = Pipeline(stages=[*assembled(columns, label), classifier("forest")]).fit(rows.where(c(cluster) == k))
        return [float(x) for x in model.stages[-1].featureImportances.toArray()]

    with ThreadPool(threads) as pool:
        found = dict(zip(kinds, pool.map(fitted, kinds), strict=True))
    kind = dict(rows.dtypes)[cluster]
    table = df.sparkSession.createDataFrame([(k, x, v) for k, values in found.items() for x, v in zip(columns, values, strict=True)], f"_k {kind}, feature string, importance double")
    ranked = table.withColumn("rank", F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("importance"), "feature")))
    names = [r[0] for r in rows.select(label).distinct().orderBy(label).collect()]
    long = rows.unpivot([cluster, label], columns, "feature", "_v")
    means = long.groupBy(c(cluster).alias("_c"), c("feature").alias("_f")).agg(*(F.avg(F.when(c(label) == x, c("_v"))).alias(f"mean_{x}") for x in names))
    out = written(ranked.join(means, (c("_k") == c("_c")) & (c("feature") == c("_f"))).select(c("_k").alias(cluster), "feature", "importance", "rank", *(f"mean_{x}" for x in names)), "importances")
    discard(rows)
    return out if top is None else out.where(c("rank") <= top)


def permutation_importance(df: DataFrame, columns: list[str], label: str, *, key: str, fold: str = "fold", kind: str = "forest", bucket: int = 10_000) -> DataFrame:
    """feature, mean and deviation over folds of the accuracy lost when the feature's values move to other rows of the fold.

    A model is fitted on the other folds. Rows of a fold are put into buckets of
    about ``bucket`` by hash of their key; inside a bucket every value moves on
    by one row in the order of the hash, for one feature at a time.
    """
    rows = written(df.select(key, fold, label, *(c(x).cast("double").alias(x) for x in columns)).where(c(label).isNotNull()).withColumn("_w", F.lit(1.0)), "rows")
    sizes = {r[0]: r[1] for r in rows.groupBy(fold).agg(F.count("*")).orderBy(fold).collect()}
    parts = []
    for k, n in sizes.items():
        model = Pipeline(stages=[*assembled(columns, label), classifier(kind)]).fit(rows.where(c(fold) != k))
        hashed = F.xxhash64(F.struct(key))
        test = rows.where(c(fold) == k).withColumn("_b", F.pmod(hashed, F.lit(max(1, n // bucket)))).withColumn("_h", hashed)
        w = Window.partitionBy("_b").orderBy("_h", key)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        test = test.withColumns({f"_m{i}": F.when(F.row_number().over(w) == F.count("*").over(whole), F.first(x).over(whole)).otherwise(F.lead(x).over(w)) for i, x in enumerate(columns)})
        moved = test.withColumn("_moved", F.explode(F.sequence(F.lit(-1), F.lit(len(columns) - 1)))).withColumns({x: F.when(c("_moved") == i, c(f"_m{i}")).otherwise(c(x)) for i, x in enumerate(columns)})
        scored = model.transform(moved).groupBy("_moved").agg(F.avg((c("prediction") == c("_label")).cast("double")).alias("accuracy"))
        parts += [(k, r["_moved"], r["accuracy"]) for r in scored.collect()]  # a row for each fold and feature
    discard(rows)
    base = {k: a for k, i, a in parts if i < 0}
    out = []
    for i, x in enumerate(columns):
        lost = np.array([base[k] - a for k, j, a in parts if j == i])
        out.append((x, float(lost.mean()) if len(lost) else None, float(lost.std(ddof=1)) if len(lost) > 1 else None, len(lost)))
    return df.sparkSession.createDataFrame(out, "feature string, importance double, deviation double, folds int")
