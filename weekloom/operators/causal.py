"""Events, matching, difference-in-differences, panel regressions and survival curves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.columns import ratio, slope
from weekloom.functions.pvalues import chi2_upper, f_upper, normal_two_sided
from weekloom.operators.ordering import bucket_count, bucket_edges, bucket_of, quantiles, running_sums
from weekloom.operators.regression import demeaned_twoway

c = F.col


def detect_rise(panel: DataFrame, *, entity: str = "public_id", order: str = "week_idx", base: int = 8, width: int = 4, start: int = 10, least: int = 25, share: float = 0.3) -> DataFrame:
    """Each entity's strongest rise of the new-customer ratio: relative rise of the rolling mean's first maximum over the mean of the first weeks; the top ``share`` is flagged."""
    w = Window.partitionBy(entity)
    rows = panel.withColumn("_nc", F.coalesce(ratio(c("customer_new"), c("customer")), F.lit(0.0))).withColumn("_n", F.count(F.lit(1)).over(w)).where(c("_n") >= least)
    back = w.orderBy(order).rowsBetween(-(width - 1), 0)
    rows = rows.withColumn("_pos", F.row_number().over(w.orderBy(order)) - 1).withColumn("_roll", F.when(F.count("_nc").over(back) >= 2, F.avg("_nc").over(back)))
    out = rows.groupBy(entity).agg((F.avg(F.when(c("_pos") < base, c("_nc"))) + 1e-6).alias("pre_nc_avg"), F.max_by(F.when(c("_pos") >= start, F.struct(F.round("_roll", 12).alias("v"), c(order).alias("w"))), F.when(c("_pos") >= start, F.struct(F.round("_roll", 12), -c("_pos")))).alias("b"))
    out = out.select(entity, "pre_nc_avg", c("b.v").alias("peak_nc_avg"), c("b.w").alias("gc_week"), ((c("b.v") - c("pre_nc_avg")) / c("pre_nc_avg")).alias("gc_delta"))
    cut = quantiles(out, ["gc_delta"], [1 - share]).select(c("_q")[0][0].alias("_q"))
    return out.crossJoin(F.broadcast(cut)).withColumn("has_gc", c("gc_delta") >= c("_q")).drop("_q")


def event_window(panel: DataFrame, events: DataFrame, *, entity: str = "public_id", order: str = "week_idx", week: str = "gc_week", width: int = 8) -> DataFrame:
    """Panel rows with -width <= event_time < width for each of an entity's events."""
    rows = panel.join(events, entity).withColumn("event_time", c(order) - c(week))
    return rows.where((c("event_time") >= -width) & (c("event_time") < width))


def pre_features(window: DataFrame, *, entity: str = "public_id", value: str = "sales_card", least: int = 3) -> DataFrame:
    """Mean, deviation and slope of log sales before the event."""
    s = F.log1p(value)
    return window.where("event_time < 0").groupBy(entity).agg(F.count(s).alias("n"), F.avg(s).alias("pre_mean"), F.stddev_pop(s).alias("pre_std"), slope(s, c("event_time")).alias("pre_slope")).where(c("n") >= least)


def nearest_match(treated: DataFrame, control: DataFrame, *, key: str, score: str, stratum: str | None = None, caliper: float | None = None, digits: int = 6, buckets: int | None = None) -> DataFrame:
    """For each treated row the control with the nearest score, with replacement; ties go to the smaller score, then id.

    The distances to either side tie if they are equal at ``digits`` decimals,
    since differences of decimal scores aren't exact in floats. Equal scores of a stratum are one point, with its smallest control; points
    are ordered inside buckets of scores. A bucket hands its last and first
    control on to the buckets around it through a table of a row for each
    bucket, so no task sorts all scores. Rows without an id or score, or with a
    null stratum, have no match.
    """
    buckets = buckets or bucket_count(treated)
    place = c(stratum) if stratum else F.lit(0)
    a, b = (x.select(c(key).alias("id"), c(score).cast("double").alias("s"), place.alias("_st")).where("id IS NOT NULL AND s IS NOT NULL") for x in (treated, control))
    points = a.select("_st", "s", F.lit(None).alias("id"), F.lit(True).alias("t")).union(b.select("_st", "s", "id", F.lit(False)))
    points = points.groupBy("_st", "s").agg(F.min("id").alias("id"), F.bool_or("t").alias("t"))
    edges = points.agg(bucket_edges("s", buckets).alias("_e"))
    points = points.crossJoin(F.broadcast(edges)).select("_st", "s", "t", bucket_of(c("s"), c("_e"), buckets).alias("_b"), F.when(c("id").isNotNull(), F.struct("s", "id")).alias("here"))
    ends = points.groupBy("_st", "_b").agg(F.min("here").alias("first"), F.max("here").alias("last"))
    across = Window.partitionBy("_st").orderBy("_b")
    grid = ends.select("_st", "_b", F.last("last", True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("from_left"), F.first("first", True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("from_right"))
    w = Window.partitionBy("_st", "_b").orderBy("s")
    met = points.withColumns({"l": F.max("here").over(w.rowsBetween(Window.unboundedPreceding, 0)), "r": F.min("here").over(w.rowsBetween(0, Window.unboundedFollowing))}).where("t").join(grid, ["_st", "_b"])
    met = met.select("_st", "s", F.coalesce("l", "from_left").alias("l"), F.coalesce("r", "from_right").alias("r"))
    dl, dr = c("s") - c("l.s"), c("r.s") - c("s")
    use_left = dl.isNotNull() & (dr.isNull() | (F.round(dl, digits) <= F.round(dr, digits)))
    met = met.select("_st", "s", F.when(use_left, c("l.id")).otherwise(c("r.id")).alias("control"), F.when(use_left, dl).otherwise(dr).alias("distance")).where("control IS NOT NULL")
    out = a.join(met, ["_st", "s"]).select(c("id").alias("treated"), "control", "distance")
    return out if caliper is None else out.where(c("distance") < caliper)


def did_deltas(panel: DataFrame, units: DataFrame, *, entity: str = "public_id", order: str = "week_idx", value: str = "sales_card_mm", width: int = 8, least: int = 3) -> DataFrame:
    """Post less pre mean around each unit's week; ``units`` has entity, week, treated and any further keys."""
    keys = [x for x in units.columns if x not in ("week",)]
    t = c(order) - c("week")
    rows = panel.select(entity, order, value).join(units, entity).where((t >= -width) & (t < width))
    out = rows.groupBy(*keys, "week").agg(F.count(F.when(t < 0, c(value))).alias("n0"), F.count(F.when(t >= 0, c(value))).alias("n1"), (F.avg(F.when(t >= 0, c(value))) - F.avg(F.when(t < 0, c(value)))).alias("delta"))
    return out.where((c("n0") >= least) & (c("n1") >= least))


def did_att(deltas: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ATT, Welch t and counts from the units' deltas."""
    a, b = F.when(c("treated") == 1, c("delta")), F.when(c("treated") == 0, c("delta"))
    return deltas.groupBy(*(by or [])).agg(F.count(a).alias("n_treated"), F.count(b).alias("n_control"), (F.avg(a) - F.avg(b)).alias("att"), ratio(F.avg(a) - F.avg(b), F.sqrt(F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b))).alias("t"))


def did_placebo(panel: DataFrame, units: DataFrame, *, rounds: int = 20, first: int = 12, last: int = 39, entity: str = "public_id", **kw) -> DataFrame:
    """ATT by round with weeks drawn by integer hash of unit and round: rounds are exploded on the small unit table, then one join."""
    spun = units.drop("week").withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    week = first + ((c(entity).cast("long") + 1) * 2654435761 + c("round") * 40503) % (last - first + 1)
    return did_att(did_deltas(panel, spun.withColumn("week", week), entity=entity, **kw), ["round"])


def placebo_summary(placebo: DataFrame, real: DataFrame) -> DataFrame:
    """Mean and deviation of the placebo rounds' ATT, and how many deviations the real one lies from their mean."""
    p = placebo.agg(F.count("att").alias("rounds"), F.avg("att").alias("placebo_mean"), F.stddev_samp("att").alias("placebo_std"))
    return p.crossJoin(real.select("att")).select("rounds", "placebo_mean", "placebo_std", "att", ratio(c("att") - c("placebo_mean"), c("placebo_std")).alias("z"))


def event_profile(window: DataFrame, *, group: str, value: str = "sales_card_mm") -> DataFrame:
    """Mean, standard error and count by event time and group."""
    return window.groupBy("event_time", group).agg(F.avg(value).alias("mean"), ratio(F.stddev_samp(value), F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n"), F.avg(ratio(c("customer_new"), c("customer"))).alias("nc"))


def profile_difference(profile: DataFrame, *, group: str) -> DataFrame:
    """DiD of the mean differences after and before, and the one-sample t of the differences before."""
    d = profile.groupBy("event_time").agg((F.max(F.when(c(group) == 1, c("mean"))) - F.max(F.when(c(group) == 0, c("mean")))).alias("d"))
    pre = F.when(c("event_time") < 0, c("d"))
    return d.agg((F.avg(F.when(c("event_time") >= 0, c("d"))) - F.avg(pre)).alias("did"), ratio(F.avg(pre), F.stddev_samp(pre) / F.sqrt(F.count(pre))).alias("pre_t"))


def _demeaned(df: DataFrame, columns: list[str], *, entity: str, period: str) -> DataFrame:
    rows = df.select(entity, period, *columns).dropna()
    times = rows.groupBy(period).agg(*(F.avg(x).alias(f"_t_{x}") for x in columns))
    grand = rows.agg(*(F.avg(x).alias(f"_g_{x}") for x in columns))
    w = Window.partitionBy(entity)
    out = rows.withColumns({f"_e_{x}": F.avg(x).over(w) for x in columns}).join(F.broadcast(times), period).crossJoin(F.broadcast(grand))
    return out.select(entity, *((c(x) - c(f"_e_{x}") - c(f"_t_{x}") + c(f"_g_{x}")).alias(x) for x in columns))


def fe_twoway(df: DataFrame, y: str, xs: list[str], *, entity: str = "public_id", period: str = "week_idx", exact: bool = False) -> DataFrame:
    """Least squares after two-way demeaning: n and a coefficient for each predictor. One row of sums reaches the driver.

    One pass of demeaning is exact only where every entity has every period;
    ``exact`` takes both effects out of panels with gaps too.
    """
    rows = (demeaned_twoway if exact else _demeaned)(df, [y, *xs], entity=entity, period=period)
    beta, n, _ = _normal_equations(rows, y, xs)
    return df.sparkSession.createDataFrame([(n, *map(float, beta))], "n long, " + ", ".join(f"`{x}` double" for x in xs))


def _normal_equations(rows: DataFrame, y: str, xs: list[str]) -> tuple[np.ndarray, int, np.ndarray]:
    cells = [F.sum(c(a) * c(b)).alias(f"{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs) if i <= j] + [F.sum(c(a) * c(y)).alias(f"y_{i}") for i, a in enumerate(xs)]
    r = rows.agg(F.count("*").alias("n"), *cells).first()
    k = len(xs)
    xx = np.array([[r[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    xy = np.array([r[f"y_{i}"] or 0.0 for i in range(k)])
    inverse = np.linalg.pinv(xx)
    return inverse @ xy, r["n"], inverse


def fe_cluster_se(df: DataFrame, y: str, xs: list[str], *, entity: str = "public_id", period: str = "week_idx", exact: bool = True) -> DataFrame:
    """Coefficients of ``fe_twoway`` with standard errors clustered by entity, z and p."""
    rows = (demeaned_twoway if exact else _demeaned)(df, [y, *xs], entity=entity, period=period).cache()
    beta, n, inverse = _normal_equations(rows, y, xs)
    resid = c(y) - sum((c(x) * float(b) for x, b in zip(xs, beta, strict=True)), F.lit(0.0))
    scores = rows.withColumn("_r", resid).groupBy(entity).agg(*(F.sum(c(x) * c("_r")).alias(f"s{i}") for i, x in enumerate(xs)))
    k = len(xs)
    m = scores.agg(F.count("*").alias("g"), *(F.sum(c(f"s{i}") * c(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(k))).first()
    rows.unpersist()
    g = m["g"]
    meat = np.array([[m[f"m{i}_{j}"] for j in range(k)] for i in range(k)])
    cov = inverse @ meat @ inverse * g / max(g - 1, 1) * (n - 1) / max(n - k, 1)
    se = np.sqrt(np.diag(cov))
    out = [(x, float(b), float(s), float(b / s) if s else None, normal_two_sided(b / s) if s else None) for x, b, s in zip(xs, beta, se, strict=True)]
    return df.sparkSession.createDataFrame(out, "predictor string, coefficient double, se double, z double, p double")


def granger_entities(panel: DataFrame, *, entity: str = "public_id", order: str = "week_idx", a: str = "customer", b: str = "sales_card", lag: int = 4, least: int = 40) -> DataFrame:
    """F and p of Granger tests both ways on first differences of each entity's two series; entities with ``least`` weeks."""
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        x, y = np.diff(g["a"].to_numpy(float)), np.diff(g["b"].to_numpy(float))
        out = []
        for cause, effect, name in ((x, y, "a_to_b"), (y, x, "b_to_a")):
            n = len(effect) - lag
            if len(g) < least or n < 9 or np.std(cause) < 1e-6 or np.std(effect) < 1e-6:
                continue
            lags = lambda v: np.column_stack([v[lag - k - 1 : len(v) - k - 1] for k in range(lag)])
            own = np.column_stack([np.ones(n), lags(effect)])
            full = np.column_stack([own, lags(cause)])
            rss = [float(((effect[lag:] - m @ np.linalg.lstsq(m, effect[lag:], rcond=None)[0]) ** 2).sum()) for m in (own, full)]
            df2 = n - full.shape[1]
            if df2 > 0 and rss[1] > 0:
                f = (rss[0] - rss[1]) / lag / (rss[1] / df2)
                out.append((str(g[entity].iloc[0]), name, f, f_upper(f, lag, df2)))
        return pd.DataFrame(out, columns=[entity, "direction", "f", "p"])

    rows = panel.where(c(a) > 0).select(c(entity).cast("string").alias(entity), order, c(a).cast("double").alias("a"), c(b).cast("double").alias("b"))
    return rows.groupBy(entity).applyInPandas(run, f"{entity} string, direction string, f double, p double")


def granger_shares(tests: DataFrame, *, entity: str = "public_id", level: float = 0.05) -> DataFrame:
    """Entities tested, and the shares significant in either direction and in both."""
    sides = tests.groupBy(entity).agg(*(F.coalesce(F.max(F.when(c("direction") == d, (c("p") < level).cast("int"))), F.lit(0)).alias(d) for d in ("a_to_b", "b_to_a")))
    return sides.agg(F.count("*").alias("n"), F.avg("a_to_b").alias("a_to_b"), F.avg("b_to_a").alias("b_to_a"), F.avg(c("a_to_b") * c("b_to_a")).alias("both"))


def kaplan_meier(df: DataFrame, *, group: str, time: str, event: str, min_n: int = 20, min_events: int = 5) -> DataFrame:
    """At risk, events and survival by group and time; groups with enough rows and events. A step in which all go has survival 0."""
    steps = df.where(c(time) > 0).groupBy(group, time).agg(F.count("*").alias("m"), F.sum(event).alias("d"))
    w = Window.partitionBy(group)
    steps = steps.withColumn("at_risk", F.sum("m").over(w.orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("m").over(w)).withColumn("_d", F.sum("d").over(w)).where((c("_n") >= min_n) & (c("_d") >= min_events))
    up = w.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    gone = F.max((c("d") == c("at_risk")).cast("int")).over(up)
    logs = F.sum(F.when(c("d") < c("at_risk"), F.ln(1 - c("d") / c("at_risk"))).otherwise(0.0)).over(up)
    return steps.select(group, time, "at_risk", c("d").alias("events"), F.when(gone == 1, 0.0).otherwise(F.exp(logs)).alias("survival"))


def log_rank(df: DataFrame, *, group: str, time: str, event: str) -> DataFrame:
    """Multivariate log-rank chi-square and p: observed, expected and covariance sums by time in Spark, a small solve on the driver."""
    names = [r[0] for r in df.where(c(time) > 0).select(group).distinct().orderBy(group).collect()]
    steps = df.where(c(time) > 0).groupBy(time).agg(F.sum(event).alias("d"), F.count("*").alias("m"), *(F.sum((c(group) == g).cast("int")).alias(f"m{i}") for i, g in enumerate(names)), *(F.sum(F.when(c(group) == g, c(event)).otherwise(0)).alias(f"d{i}") for i, g in enumerate(names)))
    at_risk = {"m": "n"} | {f"m{i}": f"n{i}" for i in range(len(names))}
    steps = running_sums(steps, time, list(at_risk), descending=True).withColumnsRenamed(at_risk).where("d > 0")
    k = len(names)
    v = c("d") * (c("n") - c("d")) / F.nullif(c("n") - 1, F.lit(0))
    cells = [F.coalesce(F.sum(v * (c(f"n{i}") / c("n")) * ((1.0 if i == j else 0.0) - c(f"n{j}") / c("n"))), F.lit(0.0)).alias(f"v{i}_{j}") for i in range(k) for j in range(k)]
    r = steps.agg(*(F.sum(c(f"d{i}") - c("d") * c(f"n{i}") / c("n")).alias(f"u{i}") for i in range(k)), *cells).first()
    u = np.array([r[f"u{i}"] or 0.0 for i in range(k - 1)])
    cov = np.array([[r[f"v{i}_{j}"] for j in range(k - 1)] for i in range(k - 1)])
    x = float(u @ np.linalg.pinv(cov) @ u) if k > 1 else 0.0
    return df.sparkSession.createDataFrame([(k, x, chi2_upper(x, k - 1) if k > 1 else None)], "groups int, chi2 double, p double")


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Coefficients with an intercept, R2 and n, from cross-product sums."""
    rows = df.select(y, *xs).dropna().withColumn("_one", F.lit(1.0))
    names = ["_one", *xs]
    beta, n, _ = _normal_equations(rows, y, names)
    fitted = sum((c(x) * float(b) for x, b in zip(names, beta, strict=True)), F.lit(0.0))
    r2 = rows.agg((1 - F.sum((c(y) - fitted) * (c(y) - fitted)) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0))).alias("r2")).first()["r2"]
    return df.sparkSession.createDataFrame([(name.replace("_one", "intercept"), float(b), r2, n) for name, b in zip(names, beta, strict=True)], "term string, coefficient double, r2 double, n long")


def coefficient_signs(df: DataFrame, *, predictor: str, coefficient: str, p: str) -> DataFrame:
    """Share of specs that agree with the most frequent sign, and share significant, by predictor."""
    s = F.sign(coefficient)
    return df.groupBy(predictor).agg(F.count("*").alias("n"), ratio(F.greatest(F.count_if(s > 0), F.count_if(s < 0)), F.count("*")).alias("sign_agreement"), F.avg((c(p) < 0.05).cast("int")).alias("significant"))


def trough_lead(panel: DataFrame, turns: DataFrame, *, entity: str = "public_id", order: str = "week_idx", width: int = 12) -> DataFrame:
    """Mean z paths of sales and customers around each entity's turn from fall to rise, and the weeks by which customers recover first."""
    from weekloom.operators.panel import zscore_entity

    events = turns.where((c("pre_slope") < 0) & (c("post_slope") > 0)).select(entity, c("split").alias("week"))
    z = zscore_entity(panel, entity=entity).withColumnRenamed("z", "z_sales")
    z = zscore_entity(z, entity=entity, value="customer").withColumnRenamed("z", "z_customers")
    path = event_window(z, events, entity=entity, order=order, week="week", width=width).groupBy("event_time").agg(F.avg("z_sales").alias("sales"), F.avg("z_customers").alias("customers"), F.count("*").alias("n"))
    after = lambda name: F.min(F.when((c("event_time") >= 0) & (c(name) >= 0), c("event_time")))
    lead = path.agg((after("sales") - after("customers")).alias("customer_lead_weeks"))
    return path.crossJoin(F.broadcast(lead))
