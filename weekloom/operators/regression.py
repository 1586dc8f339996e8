"""Regressions from sums: multinomial logit with tests of blocks, logits by group, two-way effects of gappy panels, factor models.

Rows never leave Spark: a step's gradient and matrix are summed in tasks as
(group, cell, value) rows, and only these sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.functions.pvalues import chi2_upper, normal_two_sided, t_two_sided
from weekloom.sources.tables import discard, written

c = F.col
#: Groups, periods and parameters that the driver solves for, at most.
MOST_GROUPS, MOST_PERIODS, MOST_PARAMETERS = 10_000, 100_000, 5_000


def _cell_sums(rows: DataFrame, function: Callable[[np.ndarray, dict], np.ndarray], state: dict) -> dict[int, np.ndarray]:
    """Sums of ``function(matrix of the group's rows, state of the group)`` by group; ``rows`` are _g and doubles."""
    names = rows.columns[1:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, part in batch.groupby("_g", sort=False):
                if g in state:
                    value = function(part[names].to_numpy(float), state[g])
                    sums[g] = sums[g] + value if g in sums else value
        for g, value in sums.items():
            yield pd.DataFrame({"_g": g, "cell": np.arange(len(value)), "value": value})

    found = rows.mapInPandas(run, "_g long, cell long, value double").groupBy("_g", "cell").agg(F.sum("value").alias("value")).toPandas()
    return {int(g): part.sort_values("cell")["value"].to_numpy() for g, part in found.groupby("_g")}


def _coded(df: DataFrame, by: str | None) -> tuple[DataFrame, list]:
    """``df`` with its group's place among all groups as _g, and the groups; null groups go."""
    if by is None:
        return df.withColumn("_g", F.lit(0).cast("long")), [None]
    names = [r[0] for r in df.select(by).where(c(by).isNotNull()).distinct().orderBy(by).limit(MOST_GROUPS + 1).collect()]
    if len(names) > MOST_GROUPS:
        raise ValueError(f"{by} has more than {MOST_GROUPS} groups")
    table = df.sparkSession.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("_g", T.LongType()), T.StructField("_name", df.schema[by].dataType)]))
    return df.join(F.broadcast(table), c(by) == c("_name")).drop("_name"), names


def _multinomial_step(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Log-likelihood, gradient and information of rows (class, 1, predictors) at coefficients (class by predictor, without the first class)."""
    y, x = x[:, 0].astype(int), x[:, 1:]
    eta = np.c_[np.zeros(len(x)), x @ beta.T]
    eta -= eta.max(axis=1, keepdims=True)
    p = np.exp(eta)
    p /= p.sum(axis=1, keepdims=True)
    k, m = beta.shape
    miss = (y[:, None] == np.arange(1, k + 1)) - p[:, 1:]
    info = np.empty((k, m, k, m))
    for a in range(k):
        for b in range(k):
            w = p[:, a + 1] * ((a == b) - p[:, b + 1])
            info[a, :, b, :] = x.T @ (x * w[:, None])
    return np.r_[np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum(), (miss.T @ x).ravel(), info.ravel()]


def multinomial_blocks(df: DataFrame, blocks: dict[str, list[str]], label: str, *, classes: list[str] | None = None, by: str | None = None, steps: int = 50) -> tuple[DataFrame, DataFrame]:
    """Multinomial logits of nested models: each block adds its predictors to those before it. Gives (coefficients, fits).

    Coefficients, against the first of ``classes`` (default: all labels in
    order), have Wald's standard error, z and p. A fit has rows, log-likelihood,
    McFadden's pseudo R2, AIC, and the likelihood-ratio test of its block. With
    ``by`` each group is fitted by itself, in the same passes. Rows with a null,
    or with another label, count in no model, so that all models have the same rows.
    """
    names = list(classes) if classes is not None else [r[0] for r in df.select(label).where(c(label).isNotNull()).distinct().orderBy(label).limit(MOST_GROUPS + 1).collect()]
    xs = [x for block in blocks.values() for x in block]
    if (len(names) - 1) * (len(xs) + 1) > MOST_PARAMETERS:
        raise ValueError(f"more than {MOST_PARAMETERS} parameters")
    rows, groups = _coded(df, by)
    code = F.array_position(F.array(*(F.lit(x) for x in names)), c(label)) - 1
    rows = rows.select("_g", code.cast("double").alias("_y"), F.lit(1.0).alias("_one"), *(c(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs))).where("_y >= 0").dropna()
    rows = written(rows, "rows")
    counts = {(r["_g"], int(r["_y"])): r["n"] for r in rows.groupBy("_g", "_y").agg(F.count("*").alias("n")).collect()}
    sizes = {g: np.array([counts.get((g, k), 0) for k in range(len(names))], float) for g in {g for g, _ in counts}}
    # Without predictors the shares are the fit.
    before = {g: (float((n[n > 0] * np.log(n[n > 0] / n.sum())).sum()), int((n > 0).sum()) - 1) for g, n in sizes.items()}
    null = {g: v[0] for g, v in before.items()}
    coefficients, fits = [], []
    used: list[str] = []
    for block, added in blocks.items():
        used += added
        m = len(used) + 1
        part = rows.select("_g", "_y", "_one", *(f"x{i}" for i in range(len(used))))
        beta = {g: np.zeros((len(names) - 1, m)) for g in sizes}
        live, last = set(sizes), {}
        for _ in range(steps):
            found = _cell_sums(part, _multinomial_step, {g: beta[g] for g in live})
            for g, sums in found.items():
                k = beta[g].size
                last[g] = (sums[0], np.linalg.pinv(sums[1 + k :].reshape(k, k), rcond=1e-12, hermitian=True))
                move = last[g][1] @ sums[1 : 1 + k]
                if np.abs(move).max() < 1e-9:
                    live.discard(g)
                else:
                    beta[g] = beta[g] + move.reshape(beta[g].shape)
            if not live:
                break
        for g in sorted(sizes):
            ll, cov = last[g]
            se = np.sqrt(np.maximum(np.diag(cov), 0)).reshape(beta[g].shape)
            free = int(np.linalg.matrix_rank(cov))
            for i, name in enumerate(names[1:]):
                for j, x in enumerate(["intercept", *used]):
                    b, s = float(beta[g][i, j]), float(se[i, j])
                    coefficients.append((groups[g], block, str(name), x, b, s, b / s if s else None, normal_two_sided(b / s) if s else None))
            ratio, df2 = 2 * (ll - before[g][0]), free - before[g][1]
            fits.append((groups[g], block, int(sizes[g].sum()), float(ll), float(1 - ll / null[g]) if null[g] else None, float(2 * free - 2 * ll), float(ratio), df2, chi2_upper(float(ratio), df2) if df2 > 0 else None))
            before[g] = (ll, free)
    discard(rows)
    kind = df.schema[by].dataType if by else T.StringType()
    schema = lambda text: T.StructType([T.StructField(by or "_g", kind), *T._parse_datatype_string(text).fields])
    out = df.sparkSession.createDataFrame(coefficients, schema("model string, class string, predictor string, coefficient double, se double, z double, p double"))
    tests = df.sparkSession.createDataFrame(fits, schema("model string, n long, log_likelihood double, pseudo_r2 double, aic double, lr_chi2 double, lr_df int, lr_p double"))
    return (out, tests) if by else (out.drop("_g"), tests.drop("_g"))


def logit_groups(df: DataFrame, by: str, y: str, xs: list[str], *, steps: int = 50) -> DataFrame:
    """Binary logit (``y`` 0 or 1) of each group: coefficient, standard error, z and p by predictor, rows, pseudo R2. All groups take a step in one pass."""
    rows = df.withColumn("_label", F.when(c(y).isNotNull(), (c(y) != 0).cast("string")))
    out, fits = multinomial_blocks(rows, {"all": xs}, "_label", classes=["false", "true"], by=by, steps=steps)
    return out.drop("model", "class").join(fits.select(by, "n", "pseudo_r2"), by)


def _period_sums(rows: DataFrame, values: list[Column], period: str) -> dict:
    """Sums by period of the values less their entity's mean."""
    w = Window.partitionBy("_e")
    away = rows.select(period, *((v - F.avg(v).over(w)).alias(f"v{i}") for i, v in enumerate(values)))
    return {r[0]: np.array(r[1:], float) for r in away.groupBy(period).agg(*(F.sum(f"v{i}") for i in range(len(values)))).collect()}


def demeaned_twoway(df: DataFrame, columns: list[str], *, entity: str, period: str, tolerance: float = 1e-12, rounds: int = 500) -> DataFrame:
    """entity, period and columns less their entity and period effects, exact for panels with gaps too.

    Period effects of all columns are found by conjugate gradients: a step
    takes entity means out of the current direction and sums the rest by
    period, in one pass over rows kept by entity, so that a step has no shuffle
    but that of a few sums. Only a number for each period and column reaches
    the driver (``MOST_PERIODS`` at most). Rows with a null go; rows that repeat
    an entity and period count each.
    """
    rows = written(df.select(c(entity).alias("_e"), c(period).alias("_p"), *(c(x).cast("double").alias(f"x{i}") for i, x in enumerate(columns))).dropna(), "rows").repartition("_e").cache()
    k = len(columns)
    kind = rows.schema["_p"].dataType
    sizes = {r[0]: r[1] for r in rows.groupBy("_p").agg(F.count("*")).orderBy("_p").limit(MOST_PERIODS + 1).collect()}
    if len(sizes) > MOST_PERIODS:
        raise ValueError(f"{period} has more than {MOST_PERIODS} values")
    periods = list(sizes)
    table_type = T.StructType([T.StructField("_p", kind), T.StructField("_v", T.ArrayType(T.DoubleType()))])

    def joined(values: np.ndarray) -> DataFrame:
        table = df.sparkSession.createDataFrame([(p, v.tolist()) for p, v in zip(periods, values, strict=True)], table_type)
        return rows.join(F.broadcast(table), "_p")

    def sums(frame: DataFrame, values: list[Column]) -> np.ndarray:
        found = _period_sums(frame, values, "_p")
        return np.array([found[p] for p in periods]).reshape(len(periods), k)

    direction_of = [F.get("_v", F.lit(i)) for i in range(k)]
    effect = np.zeros((len(periods), k))
    if periods:
        scale = np.array(list(sizes.values()), float)[:, None]
        left = sums(rows, [c(f"x{i}") for i in range(k)])
        goal = np.maximum(np.abs(left).max(axis=0), 1e-300)
        ready = left / scale
        direction, energy = ready, (left * ready).sum(axis=0)
        for _ in range(rounds):
            if (np.abs(left).max(axis=0) <= tolerance * goal).all() or not energy.any():
                break
            moved = sums(joined(direction), direction_of)
            bend = (direction * moved).sum(axis=0)
            step = np.where(bend > 0, energy / np.where(bend > 0, bend, 1), 0)
            effect = effect + step * direction
            left = left - step * moved
            ready = left / scale
            fresh = (left * ready).sum(axis=0)
            direction = ready + np.where(energy > 0, fresh / np.where(energy > 0, energy, 1), 0) * direction
            energy = fresh
    w = Window.partitionBy("_e")
    out = joined(effect).withColumns({f"x{i}": c(f"x{i}") - F.get("_v", F.lit(i)) for i in range(k)})
    return out.select(c("_e").alias(entity), c("_p").alias(period), *((c(f"x{i}") - F.avg(f"x{i}").over(w)).alias(x) for i, x in enumerate(columns)))


class FactorFit:
    """A factor model: ``coefficients`` as a table, and ``fitted``, a column of a row's prediction."""

    def __init__(self, coefficients: DataFrame, fitted: Callable[[DataFrame], DataFrame]):
        self.coefficients, self.fitted = coefficients, fitted


def factor_regression(df: DataFrame, y: str, terms: list[tuple[str, ...]], *, reference: dict[str, object] | None = None) -> FactorFit:
    """Least squares of ``y`` on factors and products of factors, with an intercept.

    A term is a tuple of columns: one for a factor, more for their product. A
    factor's ``reference`` level (by default its first) has no column of its
    own. Equal combinations of levels are summed first; the normal equations
    are then (i, j, sum) rows made from the columns that a combination has, and
    are solved on the driver (``MOST_PARAMETERS`` levels at most). Columns that
    others determine get the least-norm solution and a null standard error if
    nothing speaks for them. Nulls of a factor are the level "Unknown"; rows
    with a null ``y`` don't count.

    coefficients: term, level, coefficient, se, t, p, n. fitted(rows) adds ``fitted``.
    """
    factors = list(dict.fromkeys(x for term in terms for x in term))
    text = lambda x: F.coalesce(c(x).cast("string"), F.lit("Unknown"))
    cells = df.where(c(y).isNotNull()).groupBy(*(text(x).alias(x) for x in factors)).agg(F.count("*").alias("_n"), F.sum(c(y).cast("double")).alias("_s"), F.sum(c(y).cast("double") * c(y)).alias("_ss")).cache()
    first = cells.agg(*(F.min(x).alias(x) for x in factors)).first()
    base = {x: str(reference[x]) if reference and x in reference else first[x] for x in factors}

    def active(frame: DataFrame) -> Column:
        """The columns of the design that are 1 for a row, as names."""
        names = [F.lit("intercept")]
        for term in terms:
            own = F.concat(F.lit(":".join(term) + "="), F.concat_ws(":", *(text(x) for x in term)))
            names.append(F.when(sum(((text(x) == base[x]).cast("int") for x in term), F.lit(0)) == 0, own))
        return F.array_compact(F.array(*names))

    pairs = cells.select("_n", "_s", active(cells).alias("a")).select("_n", "_s", "a", F.explode("a").alias("i"))
    pairs = pairs.select("_n", "_s", "i", F.explode(F.array_append("a", F.lit(None).cast("string"))).alias("j"))
    sums = pairs.groupBy("i", "j").agg(F.sum(F.when(c("j").isNull(), c("_s")).otherwise(c("_n"))).alias("v")).limit(MOST_PARAMETERS**2 + 1).toPandas()
    names = sorted(sums["i"].unique(), key=lambda x: (x != "intercept", x))
    if len(names) > MOST_PARAMETERS:
        raise ValueError(f"more than {MOST_PARAMETERS} levels")
    at = {x: k for k, x in enumerate(names)}
    xx, xy = np.zeros((len(names), len(names))), np.zeros(len(names))
    for i, j, v in sums.itertuples(index=False):
        if j is None or j != j:
            xy[at[i]] = v
        else:
            xx[at[i], at[j]] = v
    total = cells.agg(F.sum("_n").alias("n"), F.sum("_ss").alias("ss")).first()
    cells.unpersist()
    inverse = np.linalg.pinv(xx, rcond=1e-12, hermitian=True)
    beta = inverse @ xy
    n, rank = total["n"] or 0, int(np.linalg.matrix_rank(xx, hermitian=True)) if len(names) else 0
    free = n - rank
    rest = max(float((total["ss"] or 0) - beta @ xy), 0.0)
    se = np.sqrt(np.maximum(np.diag(inverse), 0) * rest / free) if free > 0 else np.full(len(names), np.nan)
    # A combination of columns that the data don't tell apart isn't estimated.
    told = np.abs(np.diag(inverse @ xx) - 1) < 1e-6
    out = []
    for x, b, s, ok in zip(names, beta, se, told, strict=True):
        term, _, level = x.partition("=")
        good = ok and s == s and s > 0
        out.append((term, level, float(b), float(s) if good else None, float(b / s) if good else None, t_two_sided(float(b / s), free) if good else None, n))
    table = df.sparkSession.createDataFrame(out, "term string, level string, coefficient double, se double, t double, p double, n long")
    weights = df.sparkSession.createDataFrame([({x: float(b) for x, b in zip(names, beta, strict=True)},)], "_w map<string,double>")

    def fitted(rows: DataFrame) -> DataFrame:
        value = F.aggregate(active(rows), F.lit(0.0), lambda s, x: s + F.coalesce(F.element_at("_w", x), F.lit(0.0)))
        return rows.crossJoin(F.broadcast(weights)).withColumn("fitted", value).drop("_w")  # one row

    return FactorFit(table, fitted)


def controlled_profile(window: DataFrame, y: str, *, group: str, controls: list[str], width: int = 8, time: str = "event_time") -> tuple[DataFrame, DataFrame]:
    """Event-study regression: every event time, the group, their products, and the controls' levels. Gives (coefficients, profile).

    The first event time, ``-width``, is the reference, so there are 2 * width - 1
    products. The profile is mean, deviation, rows and standard error of the
    fitted values by event time and group.
    """
    fit = factor_regression(window, y, [(time,), (group,), (time, group), *((x,) for x in controls)], reference={time: -width, group: 0})
    rows = fit.fitted(window.where(c(y).isNotNull()))
    mean = rows.groupBy(time, group).agg(F.avg("fitted").alias("mean"), F.stddev_samp("fitted").alias("std"), F.count("*").alias("n"))
    return fit.coefficients, mean.withColumn("sem", c("std") / F.sqrt("n"))
