"""Proportional hazards: fits by group with tied times, concordance, and tests of the assumption.

Risk sets are running sums over distinct times, taken inside buckets of times
with each bucket's base from the bucket totals, so no task holds all times.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.functions.columns import ratio
from weekloom.functions.pvalues import chi2_upper, normal_two_sided
from weekloom.operators.ordering import bucket_count, bucket_edges, bucket_of
from weekloom.operators.statistics import average_ranks, safe_corr
from weekloom.sources.tables import discard, written

c = F.col


def concordance(df: DataFrame, *, time: str, event: str, score: str, by: str | None = None, buckets: int | None = None) -> DataFrame:
    """Pairs, concordant and tied pairs and their index, of risk scores against times; one row, or one for each group of ``by``.

    A pair counts if one row has an event and the other lasts longer, or as
    long and is censored. It is concordant if the row with the event has the
    higher score; equal scores count half. Rows with a null don't count.

    Equal rows are one point with a count. Times and scores are put into buckets
    of about equal points, where a value with more points than that has a bucket of its own. Pairs in different buckets
    of both come from the table of bucket counts, a value's own bucket needs no
    more, and each other bucket is counted by itself, by halving its times.
    """
    buckets = buckets or bucket_count(df)
    group = c(by) if by else F.lit(0)
    rows = df.select(group.alias("_g"), c(time).cast("double").alias("t"), (1 - c(event)).cast("int").alias("late"), c(score).cast("double").alias("s")).dropna()
    points = written(rows.groupBy("_g", "t", "late", "s").agg(F.count("*").alias("n")), "points")
    edges = points.groupBy("_g").agg(bucket_edges("t", buckets).alias("_t"), bucket_edges("s", buckets).alias("_s"))
    whole, points = points, points.join(F.broadcast(edges), "_g")
    own_t, own_s = (F.coalesce(F.get(edge, bucket_of(c(x), edge, buckets)) == c(x), F.lit(False)).cast("int") for x, edge in (("t", c("_t")), ("s", c("_s"))))
    points = points.withColumns({"own_t": own_t, "own_s": own_s, "a": 2 * bucket_of(c("t"), c("_t"), buckets) + own_t, "b": 2 * bucket_of(c("s"), c("_s"), buckets) + own_s})
    # A time of its own has two places: events, then those censored.
    points = written(points.select("_g", "t", "late", "s", "n", (c("n") * (1 - c("late"))).alias("e"), (2 * c("a") + c("own_t") * c("late")).alias("a"), "b", "own_t", "own_s"), "placed")

    # All cells of the table of buckets, empty ones too: 8 * buckets ** 2 for a group at most, however many rows.
    cells = points.groupBy("_g", "a", "b").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    axes = cells.groupBy("_g").agg(F.collect_set("a").alias("as"), F.collect_set("b").alias("bs"))
    cells = axes.select("_g", F.explode("as").alias("a"), "bs").select("_g", "a", F.explode("bs").alias("b")).join(cells, ["_g", "a", "b"], "left").fillna(0, ["n", "e"])
    before = (Window.unboundedPreceding, -1)
    cells = cells.withColumn("later", F.coalesce(F.sum("n").over(Window.partitionBy("_g", "b").orderBy(F.desc("a")).rowsBetween(*before)), F.lit(0)))
    row = Window.partitionBy("_g", "a")
    cells = cells.withColumns({"below": F.coalesce(F.sum("later").over(row.orderBy("b").rowsBetween(*before)), F.lit(0)), "all": F.sum("later").over(row)})
    e = c("e").cast("double")
    parts = cells.groupBy("_g").agg(F.sum(e * c("all")).alias("pairs"), F.sum(e * c("below")).alias("concordant"), F.sum(F.when(c("b") % 2 == 1, e * c("later")).otherwise(0.0)).alias("tied"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[g["_g"].iloc[0], *_ordered_pairs(g["at"].to_numpy(), g["s"].to_numpy(), g["n"].to_numpy(), g["e"].to_numpy())]], columns=["_g", "pairs", "concordant", "tied"])

    def _ordered_pairs(at, s, n, e):
        _, at = np.unique(at, return_inverse=True)
        pairs = concordant = tied = 0.0
        for bit in range(int(at.max()).bit_length()):
            block = at >> (bit + 1)
            order = np.lexsort((s, block))
            late = (at[order] >> bit & 1).astype(bool)
            later, events = np.r_[0, np.cumsum(np.where(late, n[order], 0))], np.where(late, 0, e[order]).astype(float)
            new = np.r_[True, block[order][1:] != block[order][:-1]]
            low = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            first = np.flatnonzero(new | np.r_[True, s[order][1:] != s[order][:-1]])
            start = np.repeat(first, np.diff(np.r_[first, len(at)]))
            end = np.repeat(np.r_[first[1:], len(at)], np.diff(np.r_[first, len(at)]))
            last = np.flatnonzero(new)
            high = np.repeat(np.r_[last[1:], len(at)], np.diff(np.r_[last, len(at)]))
            pairs += float((events * (later[high] - later[low])).sum())
            concordant += float((events * (later[start] - later[low])).sum())
            tied += float((events * (later[end] - later[start])).sum())
        return pairs, concordant, tied

    kind = f"_g {dict(points.dtypes)['_g']}, pairs double, concordant double, tied double"
    columns = points.where("own_s = 0").groupBy("_g", "b", c("a").alias("at"), "s").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    columns = columns.groupBy("_g", "b").applyInPandas(run, kind).withColumn("pairs", F.lit(0.0))
    # Places of one bucket by time, events before the censored.
    inside = points.where("own_t = 0").select("_g", "a", F.struct("t", "late").alias("k"), "s", "n", "e")
    inside = inside.withColumn("at", F.dense_rank().over(Window.partitionBy("_g", "a").orderBy("k"))).drop("k")
    inside = inside.groupBy("_g", "a").applyInPandas(run, kind)
    out = parts.union(columns.select(*parts.columns)).union(inside.select(*parts.columns)).groupBy("_g").agg(*(F.sum(x).alias(x) for x in parts.columns[1:]))
    out = written(out, "pairs")
    discard(whole, points)
    return out.select(*([c("_g").alias(by)] if by else []), "pairs", "concordant", "tied", ratio(c("concordant") + c("tied") / 2, c("pairs")).alias("concordance"))


def _spells(df: DataFrame, xs: list[str], time: str, event: str, by: str | None) -> DataFrame:
    """Rows with a positive time as (_g, t, e, x0, x1, ..., _b), where _b is the bucket of the time."""
    buckets = bucket_count(df)
    rows = df.where(c(time) > 0).select((c(by) if by else F.lit(0)).alias("_g"), c(time).cast("double").alias("t"), c(event).cast("int").alias("e"), *(c(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs))).dropna()
    edges = rows.groupBy("_g").agg(bucket_edges("t", buckets).alias("_e"))
    return rows.join(F.broadcast(edges), "_g").withColumn("_b", bucket_of(c("t"), c("_e"), buckets)).drop("_e")


def _weighted(rows: DataFrame, beta: dict) -> DataFrame:
    """``rows`` with their group's linear predictor."""
    kind = T.StructType([rows.schema["_g"], T.StructField("_beta", T.ArrayType(T.DoubleType()))])
    table = rows.sparkSession.createDataFrame([(g, [float(x) for x in b]) for g, b in beta.items()], kind)
    k = len(next(iter(beta.values())))
    return rows.join(F.broadcast(table), "_g").withColumn("eta", sum((c(f"x{i}") * F.get("_beta", F.lit(i)) for i in range(k)), F.lit(0.0))).drop("_beta")


def _sum_names(k: int) -> tuple[list[str], list[tuple[int, int]]]:
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    return ["", *(f"_{i}" for i in range(k)), *(f"_{i}_{j}" for i, j in pairs)], pairs


def _risk_sets(rows: DataFrame, k: int) -> DataFrame:
    """For each group and time with events: d, sums r over those at risk, q over those with an event (weights, by predictor, by pair), and g, the events' predictors."""
    names, pairs = _sum_names(k)
    w = F.exp("eta")
    parts = [w, *(w * c(f"x{i}") for i in range(k)), *(w * c(f"x{i}") * c(f"x{j}") for i, j in pairs)]
    at = rows.groupBy("_g", "_b", "t").agg(
        F.sum("e").alias("d"), *(F.sum(x).alias(f"r{n}") for n, x in zip(names, parts, strict=True)),
        *(F.sum(c("e") * x).alias(f"q{n}") for n, x in zip(names, parts, strict=True)), *(F.sum(c("e") * c(f"x{i}")).alias(f"g_{i}") for i in range(k)),
    )
    totals = at.groupBy("_g", "_b").agg(*(F.sum(f"r{n}").alias(f"r{n}") for n in names))
    after = Window.partitionBy("_g").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_g", "_b", *(F.coalesce(F.sum(f"r{n}").over(after), F.lit(0.0)).alias(f"base{n}") for n in names))  # a row for each bucket
    down = Window.partitionBy("_g", "_b").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumns({f"r{n}": F.sum(f"r{n}").over(down) for n in names}).join(F.broadcast(base), ["_g", "_b"])
    return at.withColumns({f"r{n}": c(f"r{n}") + c(f"base{n}") for n in names}).drop(*(f"base{n}" for n in names)).where("d > 0")


def _tie_sums(risk: DataFrame, ties: str) -> DataFrame:
    """Adds z: for the tied events l = 0 .. d - 1 and u = l / d, the sums of 1, u over r - u * q and of 1, u, u * u over its square (Efron); Breslow's have u = 0."""
    if ties == "breslow":
        one, two = c("d") / c("r"), c("d") / (c("r") * c("r"))
        return risk.withColumn("z", F.array(one, F.lit(0.0), two, F.lit(0.0), F.lit(0.0)))

    @F.pandas_udf("array<double>")
    def run(d: pd.Series, r: pd.Series, q: pd.Series) -> pd.Series:
        out = []
        for n, at, own in zip(d, r, q, strict=True):
            sums = np.zeros(5)
            for first in range(0, int(n), 1_000_000):
                u = np.arange(first, min(int(n), first + 1_000_000)) / n
                left = at - u * own
                sums += [(1 / left).sum(), (u / left).sum(), (1 / left**2).sum(), (u / left**2).sum(), (u * u / left**2).sum()]
            out.append(list(sums))
        return pd.Series(out)

    return risk.withColumn("z", run("d", "r", "q"))


def _newton(rows: DataFrame, k: int, ridge: float, steps: int, ties: str) -> tuple[dict, dict, dict]:
    """Rows and events, coefficients, and information with the ridge, by group."""
    names, pairs = _sum_names(k)
    sizes = {r["_g"]: (r["n"], r["d"]) for r in rows.groupBy("_g").agg(F.count("*").alias("n"), F.sum("e").alias("d")).collect()}
    beta = {g: np.zeros(k) for g in sizes}
    info = {g: np.eye(k) * max(ridge * n, 1e-9) for g, (n, _) in sizes.items()}
    live = {g for g, (_, d) in sizes.items() if d}
    z = [F.get("z", F.lit(i)) for i in range(5)]
    u_cells = [F.sum(c(f"g_{i}") - c(f"r_{i}") * z[0] + c(f"q_{i}") * z[1]).alias(f"u{i}") for i in range(k)]
    h_cells = [
        F.sum(c(f"r_{i}_{j}") * z[0] - c(f"q_{i}_{j}") * z[1] - c(f"r_{i}") * c(f"r_{j}") * z[2] + (c(f"r_{i}") * c(f"q_{j}") + c(f"q_{i}") * c(f"r_{j}")) * z[3] - c(f"q_{i}") * c(f"q_{j}") * z[4]).alias(f"h{i}_{j}") for i, j in pairs
    ]
    for _ in range(steps):
        if not live:
            break
        totals = _tie_sums(_risk_sets(_weighted(rows, {g: beta[g] for g in live}), k), ties).groupBy("_g").agg(*u_cells, *h_cells).collect()
        for r in totals:
            g, n = r["_g"], sizes[r["_g"]][0]
            u = np.array([r[f"u{i}"] for i in range(k)]) - ridge * n * beta[g]
            info[g] = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + ridge * n * np.eye(k)
            move = np.linalg.solve(info[g], u)
            beta[g] = beta[g] + move
            if np.abs(move).max() < 1e-9:
                live.discard(g)
    return sizes, beta, info


def cox(df: DataFrame, xs: list[str], *, time: str, event: str, by: str | None = None, ridge: float = 0.01, steps: int = 25, ties: str = "efron") -> DataFrame:
    """Proportional hazards with a ridge: coefficient, hazard ratio and its 95 % interval, standard error, z, p, n, events and concordance by predictor.

    With ``by``, each group has its own fit; all groups take their Newton steps
    in the same aggregates. A step's risk-set sums go by time in Spark, and one
    row of totals for each group reaches the driver, so groups should be a few
    thousands at most. ``ties`` is "efron" or "breslow". Predictors should be
    scaled. Rows with a null, or without a positive time, don't count; a group
    without events has zero coefficients with the ridge's standard errors.
    """
    rows = written(_spells(df, xs, time, event, by), "spells")
    sizes, beta, info = _newton(rows, len(xs), ridge, steps, ties)
    index = {}
    if sizes:
        index = {r["_g"]: r["concordance"] for r in concordance(_weighted(rows, beta), time="t", event="e", score="eta", by="_g").collect()}
    kind = rows.schema["_g"].dataType
    discard(rows)
    out = []
    for g, (n, d) in sizes.items():
        se = np.sqrt(np.diag(np.linalg.inv(info[g])))
        for x, b, s in zip(xs, beta[g].tolist(), se.tolist(), strict=True):
            out.append((g, x, b, *(float(np.exp(np.minimum(x, 700.0))) for x in (b, b - 1.959964 * s, b + 1.959964 * s)), s, b / s, normal_two_sided(b / s), n, d, index.get(g)))
    numbers = [T.StructField(x, T.DoubleType()) for x in ("coefficient", "hazard_ratio", "low", "high", "se", "z", "p")]
    schema = T.StructType([T.StructField(by or "_g", kind), T.StructField("predictor", T.StringType()), *numbers, T.StructField("n", T.LongType()), T.StructField("events", T.LongType()), T.StructField("concordance", T.DoubleType())])
    table = df.sparkSession.createDataFrame(out, schema)
    return table if by else table.drop("_g")


def ph_check(df: DataFrame, xs: list[str], *, time: str, event: str, ridge: float = 0.0, ties: str = "breslow") -> DataFrame:
    """Tests of proportional hazards against the rank of event time: a row for each predictor, and one named GLOBAL.

    ``chi2`` scales the events' residuals (predictor less its risk-set mean) by
    the fit's covariance matrix times the events. ``score_chi2`` is the score
    test, with each event time's own risk-set covariance matrix. ``correlation``
    is that of the ranks with the residuals scaled by the inverse of their own
    time's matrix. p values are those of chi-square with one degree of freedom,
    or as many as there are predictors.
    """
    k = len(xs)
    _, pairs = _sum_names(k)
    rows = written(_spells(df, xs, time, event, None), "spells")
    sizes, beta, _ = _newton(rows, k, ridge, 25, ties)
    if not any(d for _, d in sizes.values()):
        discard(rows)
        return df.sparkSession.createDataFrame([], _PH)
    risk = _risk_sets(_weighted(rows, beta), k)
    ranks = average_ranks(rows.where("e = 1"), "t").select(c("t").alias("_t"), c("rank").alias("rank"))
    v = {(i, j): c(f"r_{i}_{j}") / c("r") - c(f"r_{i}") * c(f"r_{j}") / (c("r") * c("r")) for i, j in pairs}
    at = written(risk.join(ranks, c("t") == c("_t")).select("t", "d", "rank", *((c(f"r_{i}") / c("r")).alias(f"m{i}") for i in range(k)), *((c(f"g_{i}") - c("d") * c(f"r_{i}") / c("r")).alias(f"e{i}") for i in range(k)), *(x.alias(f"v{i}_{j}") for (i, j), x in v.items())), "risk_sets")

    @F.pandas_udf("array<double>")
    def inverses(cells: pd.Series) -> pd.Series:
        out = []
        for x in cells:
            m = np.zeros((k, k))
            for (i, j), value in zip(pairs, x, strict=True):
                m[i, j] = m[j, i] = value
            out.append(np.linalg.pinv(m, rcond=1e-10, hermitian=True).ravel().tolist())
        return pd.Series(out)

    means = at.select("t", "rank", *(f"m{i}" for i in range(k)), inverses(F.array(*(f"v{i}_{j}" for i, j in pairs))).alias("inv"))
    events = rows.where("e = 1").select("t", *(f"x{i}" for i in range(k))).join(means, "t")
    scaled = [sum((F.get("inv", F.lit(i * k + j)) * (c(f"x{j}") - c(f"m{j}")) for j in range(k)), F.lit(0.0)).alias(f"s{i}") for i in range(k)]
    related = events.select("rank", *scaled).agg(*(safe_corr(f"s{i}", "rank").alias(f"c{i}") for i in range(k))).first()
    mean = at.agg(F.sum("d").alias("n"), (F.sum(c("d") * c("rank")) / F.sum("d")).alias("mean")).first()
    away = c("rank") - F.lit(mean["mean"])
    one = at.agg(
        F.sum(c("d") * away * away).alias("ss"), *(F.sum(away * c(f"e{i}")).alias(f"u{i}") for i in range(k)),
        *(F.sum(c("d") * power * c(f"v{i}_{j}")).alias(f"w{p}_{i}_{j}") for p, power in enumerate((F.lit(1.0), away, away * away)) for i, j in pairs),
    ).first()
    discard(rows, at)
    n = mean["n"]
    u = np.array([one[f"u{i}"] for i in range(k)])
    w = [np.array([[one[f"w{p}_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) for p in range(3)]
    cov = np.linalg.pinv(w[0])
    info = w[2] - w[1] @ cov @ w[1]
    move = cov @ u
    chi = [n * move[i] ** 2 / (cov[i, i] * one["ss"]) if cov[i, i] * one["ss"] > 0 else None for i in range(k)] + [float(n * u @ cov @ u / one["ss"]) if one["ss"] else None]
    score = [u[i] ** 2 / info[i, i] if info[i, i] > 1e-12 else None for i in range(k)] + [float(u @ np.linalg.pinv(info) @ u)]
    tail = lambda x, df: None if x is None else chi2_upper(float(x), df)
    out = [(x, related[f"c{i}"] if i < k else None, None if chi[i] is None else float(chi[i]), tail(chi[i], 1 if i < k else k), None if score[i] is None else float(score[i]), tail(score[i], 1 if i < k else k), n) for i, x in enumerate([*xs, "GLOBAL"])]
    return df.sparkSession.createDataFrame(out, _PH)


_PH = "predictor string, correlation double, chi2 double, p double, score_chi2 double, score_p double, n_events long"
