"""Clusters and predictive models on entity features, with Spark ML; vectorised helpers only for shape and warping distances."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.operators.ordering import group_quantiles

c = F.col


def kmeans(df: DataFrame, array: str, k: int, *, key: str, seed: int = 1, train: DataFrame | None = None) -> DataFrame:
    """key and cluster of every row: K-Means on standardised arrays, fitted on ``train`` (else on all)."""
    as_vector = lambda x: x.select(key, array_to_vector(c(array).cast("array<double>")).alias("raw"))
    stages = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="v", withMean=True), KMeans(featuresCol="v", predictionCol="cluster", k=k, seed=seed)])
    return stages.fit(as_vector(df if train is None else train)).transform(as_vector(df)).select(key, "cluster", "v")


def gaussian_mixture(df: DataFrame, columns: list[str], k: int, *, key: str, seed: int = 1) -> tuple[DataFrame, float, float]:
    """key and cluster of every row, and the BIC and AIC of a full-covariance mixture."""
    rows = VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="skip").transform(df)
    rows = StandardScaler(inputCol="raw", outputCol="v", withMean=True).fit(rows).transform(rows)
    model = GaussianMixture(featuresCol="v", predictionCol="cluster", k=k, seed=seed).fit(rows)
    d, n = len(columns), rows.count()
    free = k - 1 + k * d + k * d * (d + 1) / 2
    fit = -2 * model.summary.logLikelihood
    return model.transform(rows).select(key, "cluster"), free * float(np.log(max(n, 1))) + fit, 2 * free + fit


def stability(df: DataFrame, array: str, k: int, *, key: str, seeds: tuple[int, ...] = (1, 2, 3), samples: int = 2) -> DataFrame:
    """Mean NMI and ARI over all pairs of seeds, and mean ARI of the first seed's clusters with fits on hashed 80 % samples."""
    from itertools import combinations

    from weekloom.operators.statistics import agreement

    def named(x: DataFrame, name: str) -> DataFrame:
        return x.select(key, c("cluster").alias(name))

    fits = [named(kmeans(df, array, k, key=key, seed=s), f"c{i}") for i, s in enumerate(seeds)]
    pairs = reduce(DataFrame.union, (agreement(fits[i].join(fits[j], key), f"c{i}", f"c{j}") for i, j in combinations(range(len(seeds)), 2)))
    part = lambda b: df.where(F.pmod(F.xxhash64(key, F.lit(b)), F.lit(10)) < 8)
    drawn = reduce(DataFrame.union, (agreement(fits[0].join(named(kmeans(df, array, k, key=key, seed=seeds[0], train=part(b)), "b"), key), "c0", "b") for b in range(samples)))
    return pairs.agg(F.avg("nmi").alias("nmi"), F.avg("ari").alias("ari")).crossJoin(drawn.agg(F.avg("ari").alias("sample_ari")))


def internal_indices(clustered: DataFrame) -> DataFrame:
    """Silhouette (squared Euclid), Calinski-Harabasz and Davies-Bouldin of rows with cluster and vector v; sums by cluster and position."""
    silhouette = ClusteringEvaluator(featuresCol="v", predictionCol="cluster").evaluate(clustered)
    long = clustered.select("cluster", F.posexplode(vector_to_array("v")).alias("i", "x"))
    cells = long.groupBy("cluster", "i").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.sum(c("x") * c("x")).alias("ss"))
    rows = cells.toPandas()  # clusters x positions
    centre = rows.pivot(index="cluster", columns="i", values="m").to_numpy()
    n = rows.groupby("cluster")["n"].first().to_numpy(float)
    within = (rows["ss"] - rows["n"] * rows["m"] ** 2).groupby(rows["cluster"]).sum().to_numpy()
    k, total = len(n), n.sum()
    mean = (centre * n[:, None]).sum(0) / total
    between = (n[:, None] * (centre - mean) ** 2).sum()
    ch = between / max(k - 1, 1) / (within.sum() / max(total - k, 1))
    spread = np.sqrt(within / n)
    gap = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(-1))
    with np.errstate(divide="ignore", invalid="ignore"):
        worst = np.where(gap > 0, (spread[:, None] + spread[None]) / gap, 0).max(1)
    return clustered.sparkSession.createDataFrame([(k, float(silhouette), float(ch), float(worst.mean()))], "k int, silhouette double, calinski_harabasz double, davies_bouldin double")


def _normalise(x: np.ndarray) -> np.ndarray:
    x = x - x.mean(1, keepdims=True)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def shape_distance(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """1 - largest normalised cross-correlation of each series with each centre, over all shifts."""
    n = 1 << (2 * x.shape[1] - 1).bit_length()
    a, b = np.fft.rfft(_normalise(x), n), np.fft.rfft(_normalise(centres), n)
    return 1 - np.fft.irfft(a[:, None] * b.conj()[None], n).max(-1)


def warping_distance(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Dynamic time warping of all series with each centre."""
    from weekloom.operators.clusters import warping_costs

    return np.sqrt(np.stack([warping_costs(x, y) for y in centres], axis=1))


def assign(df: DataFrame, array: str, centres: np.ndarray, distance, *, key: str) -> DataFrame:
    """key, cluster and distance to the nearest centre; the centres are a handful of arrays in the closure."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = distance(np.stack(b["a"].to_numpy()).astype(float), centres)
                yield pd.DataFrame({key: b[key], "cluster": d.argmin(1).astype("int32"), "distance": d.min(1)})

    return df.select(key, c(array).cast("array<double>").alias("a")).mapInPandas(run, f"{key} {kind}, cluster int, distance double")


def shape_clusters(df: DataFrame, array: str, k: int, *, key: str, rounds: int = 5) -> tuple[DataFrame, np.ndarray]:
    """Shape-distance k-means with mean centroids: rounds of assignment in tasks and means by position in Spark. Starts from k rows spread by hash."""
    seeds = df.select(array).orderBy(F.xxhash64(key), key).limit(k).collect()
    centres = np.array([r[0] for r in seeds], float)

    def sums(batches: Iterator[pd.DataFrame], centres: np.ndarray) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["a"].to_numpy()).astype(float)
                near = shape_distance(x, centres).argmin(1)
                for j in np.unique(near):
                    yield pd.DataFrame({"cluster": int(j), "i": np.arange(x.shape[1]), "s": x[near == j].sum(0), "n": int((near == j).sum())})

    series = df.select(c(array).cast("array<double>").alias("a"))
    for _ in range(rounds):
        # A task sums its batches' series by cluster, so that no array moves.
        parts = series.mapInPandas(lambda batches, at=centres: sums(batches, at), "cluster int, i int, s double, n long")
        means = parts.groupBy("cluster", "i").agg((F.sum("s") / F.sum("n")).alias("m")).collect()  # k x length
        new = centres.copy()
        for r in means:
            new[r["cluster"], r["i"]] = r["m"]
        if np.allclose(new, centres, atol=1e-9):
            break
        centres = new
    return assign(df, array, centres, shape_distance, key=key), centres


def assembled(columns: list[str], label: str | None = None) -> list:
    stages = [Imputer(inputCols=columns, outputCols=[f"_{x}" for x in columns], strategy="median"), VectorAssembler(inputCols=[f"_{x}" for x in columns], outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]
    return [*stages, StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc")] if label else stages


def classifier(kind: str, *, seed: int = 1):
    """logistic, forest or boosted (one against the rest)."""
    common = {"featuresCol": "features", "labelCol": "_label"}
    if kind == "logistic":
        return LogisticRegression(**common, weightCol="_w", regParam=0.01, maxIter=30)
    if kind == "forest":
        return RandomForestClassifier(**common, weightCol="_w", numTrees=20, maxDepth=5, seed=seed)
    return OneVsRest(classifier=GBTClassifier(**common, maxIter=5, maxDepth=3, seed=seed), **common, weightCol="_w")


def _probabilities(names: list[str], kind: str):
    """Map from class to probability; the one-against-the-rest scores of boosted trees go through the logistic function and are scaled to one."""
    if kind in ("logistic", "forest"):
        p = vector_to_array("probability")
    else:
        odds = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-2 * x)))
        p = F.transform(odds, lambda x: x / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b))
    return F.map_from_arrays(F.array(*map(F.lit, names)), p)


def cross_validated(df: DataFrame, columns: list[str], label: str, *, key: str, kind: str = "logistic", fold: str = "fold", boost: dict[str, float] | None = None) -> DataFrame:
    """Out-of-fold class predictions (key, fold, truth, pred, probability by class), with class-balanced weights and optional extra weight of classes.

    A pipeline is fitted for each fold, on the other folds.
    """
    sizes = {r[0]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    total, names = sum(sizes.values()), sorted(sizes)
    weight = F.coalesce(*(F.when(c(label) == x, total / (len(sizes) * n) * (boost or {}).get(x, 1.0)) for x, n in sizes.items()))
    rows = df.select(key, fold, label, *(c(x).cast("double").alias(x) for x in columns)).withColumn("_w", weight).cache()
    out = None
    for (k,) in rows.select(fold).distinct().orderBy(fold).collect():
        model = Pipeline(stages=[*assembled(columns, label), classifier(kind)]).fit(rows.where(c(fold) != k))
        part = model.transform(rows.where(c(fold) == k)).select(key, fold, c(label).alias("truth"), F.element_at(F.array(*map(F.lit, names)), (c("prediction") + 1).cast("int")).alias("pred"), _probabilities(names, kind).alias("probability"))
        out = part if out is None else out.unionByName(part)
    return out


def ablation(df: DataFrame, groups: dict[str, list[str]], label: str, *, key: str) -> DataFrame:
    """Accuracy and macro F1 of each feature set."""
    from weekloom.operators.evaluate import overall_metrics

    out = None
    for name, columns in groups.items():
        m = overall_metrics(cross_validated(df, columns, label, key=key), "truth", "pred").select(F.lit(name).alias("features"), "accuracy", "macro_f1")
        out = m if out is None else out.union(m)
    return out


def regressor(kind: str, target: str):
    common = {"featuresCol": "features", "labelCol": target, "predictionCol": "pred"}
    if kind == "ridge":
        return LinearRegression(**common, regParam=0.1)
    return RandomForestRegressor(**common, numTrees=20, maxDepth=5, seed=1) if kind == "forest" else GBTRegressor(**common, maxIter=5, maxDepth=3, seed=1)


def regress_folds(df: DataFrame, columns: list[str], target: str, *, key: str, kind: str = "ridge", fold: str = "fold") -> DataFrame:
    """Out-of-fold predictions (key, truth, pred) of a number."""
    rows = df.select(key, fold, c(target).cast("double").alias(target), *(c(x).cast("double").alias(x) for x in columns)).where(c(target).isNotNull()).cache()
    out = None
    for (k,) in rows.select(fold).distinct().orderBy(fold).collect():
        model = Pipeline(stages=[*assembled(columns), regressor(kind, target)]).fit(rows.where(c(fold) != k))
        part = model.transform(rows.where(c(fold) == k)).select(key, c(target).alias("truth"), "pred")
        out = part if out is None else out.unionByName(part)
    return out


def save_model(df: DataFrame, columns: list[str], label: str, path: str, *, kind: str = "logistic") -> None:
    """Fit a classifier on all rows and save its pipeline, which takes new rows without a label."""
    rows = df.select(label, *(c(x).cast("double").alias(x) for x in columns)).withColumn("_w", F.lit(1.0))
    Pipeline(stages=[*assembled(columns, label), classifier(kind)]).fit(rows).write().overwrite().save(path)


def score_new(model_path: str, df: DataFrame) -> DataFrame:
    """Score unseen features with a saved pipeline."""
    return PipelineModel.load(model_path).transform(df)


def score_weeks(model_path: str, weeks: DataFrame, meta: DataFrame, *, first: int = 30, key: str = "public_id") -> DataFrame:
    """key, prediction and probabilities of unseen entities from their raw weekly rows and dimension.

    Weeks go through the panel's cleaning and the early features of the
    ``first`` weeks, as those did that the pipeline was fitted on; an entity
    with too few weeks has no score.
    """
    from weekloom.operators.features import feat_early30
    from weekloom.operators.panel import build_panel

    scored = score_new(model_path, feat_early30(build_panel(weeks, meta), weeks=first))
    return scored.select(key, "prediction", vector_to_array("probability").alias("probability"))


def propensity(df: DataFrame, columns: list[str], treated: str, *, key: str) -> DataFrame:
    """key, treated and the logistic propensity score on standardised covariates."""
    rows = df.select(key, c(treated).cast("double").alias(treated), *(c(x).cast("double").alias(x) for x in columns))
    model = Pipeline(stages=[*assembled(columns), LogisticRegression(featuresCol="features", labelCol=treated, probabilityCol="_p", maxIter=30)]).fit(rows)
    return model.transform(rows).select(key, treated, vector_to_array("_p")[1].alias("score"))


def cluster_profile(clustered: DataFrame, panel: DataFrame, *, key: str, order: str, value: str) -> DataFrame:
    """Mean, median and count by cluster and position: the empirical centroid in long form."""
    rows = panel.join(clustered.select(key, "cluster"), key)
    medians = group_quantiles(rows, ["cluster", order], value, [0.5]).select(c("cluster").alias("_c"), c(order).alias("_o"), c("_q")[0].alias("median"))
    means = rows.groupBy("cluster", order).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return means.join(medians, c("cluster").eqNullSafe(c("_c")) & c(order).eqNullSafe(c("_o")), "left").drop("_c", "_o")


def cluster_outcomes(df: DataFrame, cluster: str, outcome: str) -> DataFrame:
    from weekloom.operators.summaries import shares_in_group

    return shares_in_group(df, [cluster], outcome)


def local_trend(panel: DataFrame, *, entity: str, order: str, value: str, span: float = 0.3, degree: int = 1) -> DataFrame:
    """LOWESS trend (tricube weights, local lines) of each entity's series, and the rest."""
    schema = f"{entity} string, {order} long, trend double, resid double"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        y = g["v"].to_numpy(float)
        n = len(y)
        x, k = np.arange(n, dtype=float), min(n, max(degree + 2, int(np.ceil(span * n))))
        d = np.abs(x[:, None] - x[None])
        reach = np.maximum(np.sort(d, axis=1)[:, k - 1], 1e-9)
        w = np.clip(1 - (d / (reach[:, None] * 1.000001)) ** 3, 0, None) ** 3
        s, sx, sy, sxx, sxy = w.sum(1), w @ x, w @ y, w @ (x * x), w @ (x * y)
        den = s * sxx - sx * sx
        b = np.where(den > 1e-12, (s * sxy - sx * sy) / np.where(den > 1e-12, den, 1), 0)
        trend = (sy - b * sx) / s + b * x
        return pd.DataFrame({entity: g[entity].astype(str), order: g[order].astype("int64"), "trend": trend, "resid": y - trend})

    rows = panel.where(c(value).isNotNull()).select(c(entity).cast("string").alias(entity), c(order).cast("long").alias(order), c(value).cast("double").alias("v"))
    return rows.groupBy(entity).applyInPandas(run, schema)


def piecewise_bic(panel: DataFrame, *, entity: str, order: str, value: str, most: int = 2, grid: int = 10) -> DataFrame:
    """Number of breaks (0 to ``most``, on a grid) of the piecewise line with the lowest BIC, and its last slope."""
    schema = f"{entity} string, n_breaks int, last_slope double, bic double"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        from itertools import combinations

        g = g.sort_values(order)
        y = g["v"].to_numpy(float)
        n = len(y)
        if n < 6:
            return pd.DataFrame([(str(g[entity].iloc[0]), 0, 0.0, 0.0)], columns=[entity, "n_breaks", "last_slope", "bic"])
        x = np.arange(n, dtype=float)
        p = [np.r_[0, np.cumsum(v)] for v in (np.ones(n), x, y, x * x, x * y, y * y)]

        def fit(a: int, b: int) -> tuple[float, float]:
            m, sx, sy, sxx, sxy, syy = (v[b] - v[a] for v in p)
            vx, vxy = sxx - sx * sx / m, sxy - sx * sy / m
            slope = vxy / vx if vx > 1e-12 else 0.0
            return max(syy - sy * sy / m - slope * vxy, 0.0), slope

        cuts = sorted({int(q) for q in np.linspace(0, n, grid + 2)[1:-1] if 3 <= q <= n - 3})
        best = (np.inf, 0, 0.0)
        for k in range(most + 1):
            for chosen in combinations(cuts, k):
                edges = [0, *chosen, n]
                if min(np.diff(edges)) < 3:
                    continue
                parts = [fit(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                bic = n * np.log(max(sum(r for r, _ in parts) / n, 1e-12)) + (3 * k + 2) * np.log(n)
                if bic < best[0] - 1e-9:
                    best = (bic, k, parts[-1][1])
        return pd.DataFrame([(str(g[entity].iloc[0]), best[1], best[2], best[0])], columns=[entity, "n_breaks", "last_slope", "bic"])

    rows = panel.where(c(value).isNotNull()).select(c(entity).cast("string").alias(entity), order, c(value).cast("double").alias("v"))
    return rows.groupBy(entity).applyInPandas(run, schema)


def bucket_predictions(pred: DataFrame, *, k: float = 0.5) -> DataFrame:
    """Classes of true and predicted slopes by k sigma of the true ones, and their agreement."""
    s = pred.agg(F.stddev_pop("truth").alias("_s"))
    band = lambda x: F.when(c(x) > k * c("_s"), "Growth").when(c(x) < -k * c("_s"), "Decline").otherwise("Stable")
    rows = pred.crossJoin(F.broadcast(s)).select(band("truth").alias("truth"), band("pred").alias("pred"))
    return rows.groupBy("truth", "pred").agg(F.count("*").alias("n"))
