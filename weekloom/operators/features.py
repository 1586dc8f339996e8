"""Trajectory features of each entity: windows for neighbours, then one aggregate by entity on the same partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.columns import cv, r2, ratio, slope, slope_where
from weekloom.operators.ordering import group_quantiles, quantiles

c = F.col


def feat_slopes(panel: DataFrame, *, entity: str = "public_id", order: str = "week_idx", value: str = "sales_card_mm") -> DataFrame:
    """Slope and r2 of all weeks, the early half (3 at least), the late half and the tail (a fifth, 8 at least)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(entity))
    rows = panel.select(entity, c(order).alias("x"), c(value).alias("y")).withColumn("n", n)
    half, tail = F.greatest(F.floor(c("n") / 2), F.lit(3)), F.greatest(F.floor(c("n") / 5), F.lit(8))
    early, y, x = c("x") < half, c("y"), c("x")
    return rows.groupBy(entity).agg(
        F.count(y).alias("n_observed_weeks_used"), slope_where(y, x, early).alias("slope_early_mm"), slope_where(y, x, ~early).alias("slope_late_mm"), slope(y, x).alias("slope_all_mm"),
        slope_where(y, x, x >= c("n") - tail).alias("slope_tail_mm"), r2(y, x).alias("r2"), r2(F.when(early, y), F.when(early, x)).alias("r2_early"),
    )


def feat_cv_mdd(panel: DataFrame, *, entity: str = "public_id", order: str = "week_idx", raw: str = "sales_card", value: str = "sales_card_mm", cap: float = 5.0) -> DataFrame:
    """Capped variation and largest relative drop from an earlier peak."""
    peak = F.max(value).over(Window.partitionBy(entity).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = panel.withColumn("_drop", (peak - c(value)) / (peak + 1e-9))
    return rows.groupBy(entity).agg(cv(c(raw), cap=cap).alias("cv"), F.max("_drop").alias("mdd"))


def feat_behaviour(panel: DataFrame, *, entity: str = "public_id", period: str = "date_id", mode: str = "mean") -> DataFrame:
    """New-customer rate, delivery share (log), mean morning and weekend shares, category, opening, first and last week.

    ``mode`` of the rate: ``mean`` of new/all; ``plus_one`` mean of new/(all+1) with 0 customers as null; ``sums``; ``plain_plus_one``.
    """
    new, all_ = c("customer_new"), c("customer")
    rate = {"mean": F.avg(ratio(new, all_)), "plus_one": F.avg(F.when(all_ != 0, new / (all_ + 1))), "sums": ratio(F.sum(new), F.sum(all_)), "plain_plus_one": F.avg(new / (all_ + 1))}[mode]
    delivery = F.sum(F.coalesce("sales_delivery", F.lit(0.0)))
    return panel.groupBy(entity).agg(
        rate.alias("nc_rate"), F.coalesce(F.log1p(ratio(delivery, F.sum("sales_card"))), F.lit(0.0)).alias("del_ratio_log"), F.avg("before_noon_sales").alias("before_noon"), F.avg("weekend_sales").alias("weekend"),
        F.min_by("category", period).alias("category"), F.min_by("open_date", period).alias("open_date"), F.min(period).alias("first_date"), F.max(period).alias("last_date"),
    )


def feat_seasonal_noise(panel: DataFrame, *, entity: str = "public_id", value: str = "sales_card", resid: str = "resid") -> DataFrame:
    """max(0, 1 - var(resid) / var) and var(resid) / var; 0 variance gives 0."""
    part = F.when(F.var_pop(value) > 1e-12, F.var_pop(resid) / F.var_pop(value))
    return panel.groupBy(entity).agg(F.coalesce(F.greatest(1 - part, F.lit(0.0)), F.lit(0.0)).alias("seasonal_strength"), F.coalesce(part, F.lit(0.0)).alias("noise_ratio"))


def with_neighbours(rows: DataFrame, keys: list[str], *, moving: tuple[int, ...] = (5, 10, 15), rolling: tuple[int, ...] = (4, 8)) -> DataFrame:
    """Adds differences, sign changes, moving means and rolling deviations of s by x. Windows need half their width."""
    w = Window.partitionBy(*keys).orderBy("x")
    rows = rows.withColumn("diff", c("s") - F.lag("s").over(w))
    step = F.sign(F.coalesce("diff", F.lit(0.0)))
    rows = rows.withColumn("_pos", F.row_number().over(w)).withColumn("_sign", step)
    rows = rows.withColumn("turn", F.when((c("_pos") > 2) & (c("_sign") != F.lag("_sign").over(w)), 1).otherwise(0))
    for k in moving:
        back = w.rowsBetween(-(k - 1), 0)
        rows = rows.withColumn(f"ma{k}", F.when(F.count("s").over(back) >= max(1, k // 2), F.avg("s").over(back)))
    for k in rolling:
        back = w.rowsBetween(-(k - 1), 0)
        rows = rows.withColumn(f"sd{k}", F.when(F.count("s").over(back) >= max(2, k // 2), F.stddev_samp("s").over(back)))
    return rows


def _core(x: Column, s: Column) -> dict[str, Column]:
    q = F.percentile(s, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return {
        "sales_mean": F.avg(s), "sales_std": F.stddev_pop(s), "sales_median": q[1], "sales_cv": F.stddev_pop(s) / (F.avg(s) + 1e-9), "sales_min": F.min(s), "sales_max": F.max(s), "sales_range": F.max(s) - F.min(s),
        "slope_all": slope(s, x), "nc_mean": F.avg("nc"), "nc_std": F.stddev_pop("nc"), "nc_slope": slope(c("nc"), x), "cust_slope": slope(c("cust"), x), "cust_mean": F.avg("cust"), "cust_cv": F.stddev_pop("cust") / (F.avg("cust") + 1e-9),
        "del_mean": F.avg("del"), "del_slope": slope(c("del"), x), "bn_mean": F.avg("bn"), "wk_mean": F.avg("wk"), "q25": q[0], "q50": q[1], "q75": q[2], "iqr": q[2] - q[0],
        "diff_mean": F.avg("diff"), "diff_std": F.stddev_pop("diff"), "diff_max_abs": F.max(F.abs("diff")), "zero_cross": F.sum("turn"),
    }


def _channels(panel: DataFrame, keys: list[str], x: str, *, as_ratio: bool = False) -> DataFrame:
    sales, share = c("sales_card"), (lambda k: F.when(c("sales_card") > 0, c(k) / c("sales_card")).otherwise(0.0)) if as_ratio else c
    return panel.select(*keys, c(x).alias("x"), F.log1p(sales).alias("s"), F.when(c("customer") > 0, c("customer_new") / c("customer")).alias("nc"), F.log1p("customer").alias("cust"), F.when(sales > 0, F.coalesce("sales_delivery", F.lit(0.0)) / sales).otherwise(0.0).alias("del"), share("before_noon_sales").alias("bn"), share("weekend_sales").alias("wk"))


def feat_early30(panel: DataFrame, *, entity: str = "public_id", order: str = "week_idx", weeks: int = 30, min_weeks: int = 15) -> DataFrame:
    """The early matrix: 43 features of log1p sales and the other channels over the first ``weeks`` weeks."""
    rows = with_neighbours(_channels(panel.where(c(order) < weeks), [entity], order), [entity])
    x, s, third = c("x"), c("s"), max(3, weeks // 3)
    parts = {"slope_1_10": x < third, "slope_11_20": (x >= third) & (x < 2 * third), "slope_21_30": x >= 2 * third}
    features = _core(x, s) | {k: slope_where(s, x, v) for k, v in parts.items()}
    features |= {f"vol_w{k}": F.avg(f"sd{k}") / (F.avg(s) + 1e-9) for k in (4, 8)} | {"nc_last4": F.avg(F.when(x >= weeks - 4, c("nc"))), "nc_first4": F.avg(F.when(x < 4, c("nc")))}
    features |= {f"ma{k}_slope": slope(c(f"ma{k}"), x) for k in (5, 10, 15)} | {f"ma{k}_std": F.stddev_pop(f"ma{k}") for k in (5, 10, 15)}
    varied = F.var_pop(s) > 1e-12
    features |= {"sales_skew": F.when(varied, F.skewness(s)).otherwise(0.0), "sales_kurt": F.when(varied, F.kurtosis(s)).otherwise(0.0), "_n": F.count(s)}
    out = rows.groupBy(entity).agg(*(v.alias(k) for k, v in features.items())).where(c("_n") >= min_weeks).drop("_n")
    return out.withColumn("slope_accel", c("slope_21_30") - c("slope_1_10")).withColumn("nc_delta", c("nc_last4") - c("nc_first4"))


def feat_windows_sweep(panel: DataFrame, windows: list[int], *, entity: str = "public_id", order: str = "week_idx") -> DataFrame:
    """Slope, mean, deviation and new-customer mean of the first W weeks for every W, in one pass."""
    rows = panel.withColumn("w", F.explode(F.array(*map(F.lit, windows)))).where(c(order) < c("w"))
    s, x = F.log1p("sales_card"), c(order)
    return rows.groupBy("w", entity).agg(F.count(s).alias("n"), slope(s, x).alias("slope"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.avg(ratio(c("customer_new"), c("customer"))).alias("nc_rate"))


def feat_segments(panel: DataFrame, *, entity: str = "public_id", order: str = "week_idx", weeks: int = 30, edge: int = 10) -> DataFrame:
    """First and last ``edge`` of ``weeks`` weeks: slope over re-numbered non-null weeks, mean, deviation, variation, customers."""
    rows = panel.where((c(order) < weeks) & c("sales_card").isNotNull()).withColumn("part", F.when(c(order) < edge, "early").when(c(order) >= weeks - edge, "late")).where("part IS NOT NULL")
    rows = rows.withColumn("x", F.row_number().over(Window.partitionBy(entity, "part").orderBy(order)) - 1).withColumn("s", F.log1p("sales_card"))
    each = []
    for part in ("early", "late"):
        on = c("part") == part
        s = F.when(on, c("s"))
        each += [slope_where(c("s"), c("x"), on).alias(f"{part}_slope"), F.avg(s).alias(f"{part}_mean"), F.stddev_pop(s).alias(f"{part}_std"), (F.stddev_pop(s) / (F.abs(F.avg(s)) + 1e-9)).alias(f"{part}_vol"), F.avg(F.when(on, ratio(c("customer_new"), c("customer")))).alias(f"{part}_nc"), F.avg(F.when(on, c("customer"))).alias(f"{part}_customers")]
    return rows.groupBy(entity).agg(*each)


def feat_early_simple(panel: DataFrame, *, entity: str = "public_id", order: str = "week_idx", weeks: int = 20) -> DataFrame:
    """Slope, early slope, variation, drop, r2, mean and new-customer rate of the first weeks; entities with max(10, weeks / 3) of them."""
    early = panel.where(c(order) < weeks)
    y, x = c("sales_card"), c(order)
    a = early.groupBy(entity).agg(F.count(y).alias("n"), slope(y, x).alias("slope"), slope_where(y, x, x < weeks // 2).alias("early_slope"), cv(y).alias("cv"), r2(y, x).alias("r2"), F.avg(y).alias("mean"), F.avg(ratio(c("customer_new"), c("customer"))).alias("nc_rate")).where(c("n") >= max(10, weeks // 3))
    return a.join(feat_cv_mdd(early, entity=entity, order=order, value="sales_card").select(entity, "mdd"), entity)


def feat_recent_early_growth(panel: DataFrame, spans: list[int], *, entity: str = "public_id", order: str = "week_idx", value: str = "sales_card") -> DataFrame:
    """Growth of the last k weeks against the first k, and the share of rising steps."""
    w = Window.partitionBy(entity)
    up = Window.partitionBy(entity).orderBy(order)
    rows = panel.select(entity, order, value).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("rise", F.when(F.lag(value).over(up).isNotNull(), (c(value) > F.lag(value).over(up)).cast("int")))
    out = [ratio(F.avg(F.when(c(order) >= c("n") - k, c(value))) - F.avg(F.when(c(order) < k, c(value))), F.avg(F.when(c(order) < k, c(value)))).alias(f"growth_{k}") for k in spans]
    return rows.groupBy(entity).agg(*out, cv(c(value)).alias("cv"), F.avg("rise").alias("rising_share"))


def feat_store_summary(panel: DataFrame, *, entity: str = "public_id", order: str = "week_idx", min_weeks: int = 8) -> DataFrame:
    """Edge growth over min(12, max(4, n / 4)) weeks, log slope, channel shares, max/min ratio, growth type at 5 %."""
    n = F.count(F.lit(1)).over(Window.partitionBy(entity))
    rows = panel.withColumn("n", n).where(c("n") >= min_weeks).withColumn("edge", F.least(F.greatest(F.floor(c("n") / 4), F.lit(4)), F.lit(12)))
    y, x = c("sales_card"), c(order)
    out = rows.groupBy(entity).agg(
        F.first("n").alias("weeks"), F.avg(F.when(x < c("edge"), y)).alias("first_mean"), F.avg(F.when(x >= c("n") - c("edge"), y)).alias("last_mean"), slope(F.log1p(y), x).alias("log_slope"),
        ratio(F.sum("sales_delivery"), F.sum(y)).alias("delivery_share"), ratio(F.sum("sales_invoice"), F.sum(y)).alias("invoice_share"), ratio(F.max(y), F.min(y)).alias("max_min"),
    )
    growth = ratio(c("last_mean") - c("first_mean"), F.abs("first_mean"))
    return out.withColumn("edge_growth", growth).withColumn("growth_type", F.when(growth >= 0.05, "growth").when(growth <= -0.05, "decline").otherwise("flat"))


def feat_first_n_next(panel: DataFrame, *, entity: str = "public_id", order: str = "week_idx", weeks: int = 30, target: int = 12, min_target: int = 6) -> DataFrame:
    """Mean, slope and deviation of the first weeks; slope, sign, total, mean and growth of the ``target`` weeks after, with ``min_target`` of them."""
    y, x = c("sales_card"), c(order)
    early, later = x < weeks, (x >= weeks) & (x < weeks + target)
    out = panel.groupBy(entity).agg(F.avg(F.when(early, y)).alias("early_mean"), slope_where(y, x, early).alias("early_slope"), F.stddev_pop(F.when(early, y)).alias("early_std"), slope_where(y, x, later).alias("next_slope"), F.sum(F.when(later, y)).alias("next_total"), F.avg(F.when(later, y)).alias("next_mean"), F.count(F.when(later, y)).alias("next_weeks")).where(c("next_weeks") >= min_target)
    return out.withColumn("next_sign", F.sign("next_slope")).withColumn("next_growth", ratio(c("next_mean") - c("early_mean"), c("early_mean")))


def feat_meta(meta: DataFrame, *, entity: str = "public_id", at: str = "2001-12-31", upper: float = 0.99) -> DataFrame:
    """Tenure in months and its log, age flags, delivery flag, log of the area clipped above."""
    top = quantiles(meta, ["area"], [upper]).select(c("_q")[0][0].alias("_top"))
    months = F.datediff(F.lit(at).cast("date"), "open_date") / 30.4375
    number = F.expr("try_cast(regexp_extract(age, '^([0-9]+)', 1) AS INT)")
    return meta.crossJoin(F.broadcast(top)).select(entity, months.alias("tenure_months"), F.log1p(F.greatest(months, F.lit(0.0))).alias("log_tenure"), (number <= 30).cast("int").alias("young"), (number >= 50).cast("int").alias("senior"), (c("delivery_link") > 0).cast("int").alias("delivers"), F.log1p(F.greatest(F.least("area", "_top"), F.lit(0.0))).alias("log_area"))


def feat_phase_cv(panel: DataFrame, *, entity: str = "public_id", order: str = "week_idx", edges: tuple[int, int] = (15, 30), min_weeks: int = 30) -> DataFrame:
    """Variation of log sales in three phases."""
    s, x = F.log1p("sales_card"), c(order)
    parts = {"cv_1": x < edges[0], "cv_2": (x >= edges[0]) & (x < edges[1]), "cv_3": x >= edges[1]}
    return panel.groupBy(entity).agg(F.count(s).alias("n"), *((F.stddev_pop(F.when(v, s)) / (F.abs(F.avg(F.when(v, s))) + 1e-9)).alias(k) for k, v in parts.items())).where(c("n") >= min_weeks)


def detrend(panel: DataFrame, *, entity: str = "public_id", order: str = "week_idx", value: str = "sales_card", log_time: bool = False) -> DataFrame:
    """Residual variation and r2 after a linear fit in time or log time: sd(resid) / mean |fitted|, capped at 5."""
    t = F.log1p(order) if log_time else c(order).cast("double")
    rows = panel.select(entity, t.alias("t"), c(value).alias("y"))
    fit = rows.groupBy(entity).agg(F.regr_slope("y", "t").alias("b"), F.regr_intercept("y", "t").alias("a"), r2(c("y"), c("t")).alias("r2"))
    rows = rows.join(fit, entity).withColumn("fitted", c("a") + c("b") * c("t"))
    return rows.groupBy(entity).agg(F.first("r2").alias("r2"), F.least(F.stddev_pop(c("y") - c("fitted")) / (F.avg(F.abs("fitted")) + 1e-9), F.lit(5.0)).alias("cv"))


def detrend_rolling(panel: DataFrame, width: int, *, entity: str = "public_id", order: str = "week_idx", value: str = "sales_card") -> DataFrame:
    """Residual scale against a centred moving mean: sd(resid) / max(mean |trend|, mean |y|, 1)."""
    w = Window.partitionBy(entity).orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2)
    rows = panel.withColumn("_t", F.avg(value).over(w))
    return rows.groupBy(entity).agg((F.stddev_pop(c(value) - c("_t")) / F.greatest(F.avg(F.abs("_t")), F.avg(F.abs(value)), F.lit(1.0))).alias("scale"))


def detrend_pick_best(methods: DataFrame, order: list[str], *, low: float = 0.1, near: float = 0.05) -> DataFrame:
    """The variation to report: raw if no method's r2 reaches ``low``, else that of the first method in ``order`` within ``near`` of the best r2.

    ``methods`` has raw_cv and, for each method m, r2_m and cv_m.
    """
    best = F.greatest(*(c(f"r2_{m}") for m in order))
    out, name = F.lit(None).cast("double"), F.lit(None).cast("string")
    for m in reversed(order):
        near_best = c(f"r2_{m}") >= best - near
        out, name = F.when(near_best, c(f"cv_{m}")).otherwise(out), F.when(near_best, m).otherwise(name)
    raw = best < low
    return methods.withColumn("best_cv", F.when(raw, c("raw_cv")).otherwise(out)).withColumn("method", F.when(raw, "raw").otherwise(name))


def rolling_features(panel: DataFrame, *, entity: str = "public_id", order: str = "week_idx", value: str = "sales_card") -> DataFrame:
    """Moving means 4, 8, 12, the ratio of the first two, rolling deviation 4, lags 1 and 4."""
    w = Window.partitionBy(entity).orderBy(order)
    out = panel.withColumns({f"ma{k}": F.avg(value).over(w.rowsBetween(-(k - 1), 0)) for k in (4, 8, 12)} | {"sd4": F.stddev_samp(value).over(w.rowsBetween(-3, 0)), "lag1": F.lag(value, 1).over(w), "lag4": F.lag(value, 4).over(w)})
    return out.withColumn("ma_gap", ratio(c("ma4"), c("ma8")) - 1)


def seq_windows(panel: DataFrame, history: int, horizon: int, *, entity: str = "public_id", order: str = "week_idx", value: str = "sales_card") -> DataFrame:
    """Every full (history, horizon) training window of an entity as two arrays."""
    w = Window.partitionBy(entity).orderBy(order)
    rows = panel.withColumn("history", F.collect_list(value).over(w.rowsBetween(-history + 1, 0))).withColumn("horizon", F.collect_list(value).over(w.rowsBetween(1, horizon)))
    return rows.where((F.size("history") == history) & (F.size("horizon") == horizon)).select(entity, order, "history", "horizon")


def seq_fixed(panel: DataFrame, *, entity: str = "public_id", order: str = "week_idx", value: str = "sales_card", weeks: int = 30) -> DataFrame:
    """The first weeks as an array of fixed length, 0 where a week is missing."""
    got = panel.where(c(order) < weeks).groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct(c(order).cast("int"), c(value)))).alias("m"))
    return got.select(entity, F.transform(F.sequence(F.lit(0), F.lit(weeks - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("seq"))


def traj_matrix_filter(panel: DataFrame, *, entity: str = "public_id", order: str = "week_idx", value: str = "sales_card_mm", weeks: int = 60, week_share: float = 0.6, entity_share: float = 0.85) -> DataFrame:
    """Weeks present for enough entities, entities with enough of those weeks, gaps filled by the week's median."""
    rows = panel.where(c(order) < weeks).select(entity, order, value)
    n = rows.agg(F.count_distinct(entity).alias("_n"))
    medians = group_quantiles(rows, [order], value, [0.5]).select(c(order).alias("_o"), c("_q")[0].alias("med"))
    counts = rows.groupBy(order).agg(F.count(value).alias("k")).crossJoin(F.broadcast(n)).where(c("k") >= week_share * c("_n"))
    cols = counts.join(medians, c(order).eqNullSafe(c("_o")), "left").select(order, "med")
    kept = rows.join(F.broadcast(cols), order)
    enough = kept.groupBy(entity).agg(F.count(value).alias("k")).crossJoin(F.broadcast(cols.agg(F.count("*").alias("_w")))).where(c("k") >= entity_share * c("_w")).select(entity)
    return enough.crossJoin(F.broadcast(cols)).join(rows, [entity, order], "left").select(entity, order, F.coalesce(value, "med").alias(value))


def prefix_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Running and total n, x, y, xx, xy, yy of (x, y) by x: any split's fits from two lookups."""
    w = Window.partitionBy(*keys)
    up = w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    parts = {"n": F.when(c("y").isNotNull(), 1.0).otherwise(0.0), "x": F.when(c("y").isNotNull(), c("x")), "y": c("y"), "xx": F.when(c("y").isNotNull(), c("x") * c("x")), "xy": c("x") * c("y"), "yy": c("y") * c("y")}
    return rows.withColumns({f"p_{k}": F.coalesce(F.sum(v).over(up), F.lit(0.0)) for k, v in parts.items()} | {f"t_{k}": F.coalesce(F.sum(v).over(w), F.lit(0.0)) for k, v in parts.items()})


def _fit(n: Column, x: Column, y: Column, xx: Column, xy: Column, yy: Column) -> tuple[Column, Column]:
    sxx, sxy, syy = xx - x * x / F.nullif(n, F.lit(0.0)), xy - x * y / F.nullif(n, F.lit(0.0)), yy - y * y / F.nullif(n, F.lit(0.0))
    b = F.when(sxx > 1e-12, sxy / F.nullif(sxx, F.lit(0.0))).otherwise(0.0)
    return b, F.greatest(syy - b * sxy, F.lit(0.0))


def _splits(panel: DataFrame, entity: str, order: str, value: str) -> DataFrame:
    rows = prefix_sums(panel.select(entity, c(order).cast("double").alias("x"), c(value).alias("y")), [entity])
    before = [c(f"p_{k}") for k in ("n", "x", "y", "xx", "xy", "yy")]
    after = [c(f"t_{k}") - c(f"p_{k}") for k in ("n", "x", "y", "xx", "xy", "yy")]
    (b0, r0), (b1, r1) = _fit(*before), _fit(*after)
    total = _fit(*(c(f"t_{k}") for k in ("n", "x", "y", "xx", "xy", "yy")))
    return rows.select(entity, (c("x") + 1).cast("int").alias("split"), c("p_n").alias("n0"), (c("t_n") - c("p_n")).alias("n1"), b0.alias("slope0"), b1.alias("slope1"), (r0 + r1).alias("rss"), total[1].alias("rss_all"), ratio(c("p_y"), c("p_n")).alias("mean0"), ratio(c("t_y") - c("p_y"), c("t_n") - c("p_n")).alias("mean1"))


def change_point_gap(panel: DataFrame, *, entity: str = "public_id", order: str = "week_idx", value: str = "sales_card_mm", least: int = 4) -> DataFrame:
    """The split with the largest gap of means, first of equals: split, slopes before and after, gap, direction."""
    rows = _splits(panel, entity, order, value).where((c("n0") >= least) & (c("n1") >= least)).withColumn("gap", F.round(F.abs(c("mean1") - c("mean0")), 9))
    best = rows.groupBy(entity).agg(F.max_by(F.struct("split", "slope0", "slope1", "mean0", "mean1", "gap"), F.struct("gap", -c("split"))).alias("b"))
    return best.select(entity, c("b.split").alias("split"), c("b.slope0").alias("pre_slope"), c("b.slope1").alias("post_slope"), c("b.gap").alias("magnitude"), (c("b.mean1") > c("b.mean0")).cast("int").alias("is_up"))


def change_point_slope(panel: DataFrame, *, entity: str = "public_id", order: str = "week_idx", value: str = "sales_card_mm", least: int = 5) -> DataFrame:
    """The split with the largest difference of slopes, first of equals."""
    rows = _splits(panel, entity, order, value).where((c("n0") >= least) & (c("n1") >= least)).withColumn("gap", F.round(F.abs(c("slope1") - c("slope0")), 9))
    best = rows.groupBy(entity).agg(F.max_by(F.struct("split", "slope0", "slope1", "gap"), F.struct("gap", -c("split"))).alias("b"))
    return best.select(entity, c("b.split").alias("split"), c("b.slope0").alias("pre_slope"), c("b.slope1").alias("post_slope"), c("b.gap").alias("slope_gap"))


def inflection_rss(panel: DataFrame, *, entity: str = "public_id", order: str = "week_idx", value: str = "sales_card_mm", least: int = 4, gain: float = 0.05) -> DataFrame:
    """Best two-line split by residual sum; the midpoint if it improves on one line by less than ``gain``."""
    rows = _splits(panel, entity, order, value).withColumn("rss", F.round("rss", 9))
    best = rows.where((c("n0") >= least) & (c("n1") >= least)).groupBy(entity).agg(F.min_by(F.struct("split", "rss", "rss_all"), F.struct("rss", "split")).alias("b"))
    mid = rows.groupBy(entity).agg(F.max(c("n0") + c("n1")).alias("n"))
    out = mid.join(best, entity, "left")
    better = 1 - ratio(c("b.rss"), c("b.rss_all"))
    gated = F.coalesce(better >= gain, F.lit(False))
    split = F.when(gated, c("b.split")).otherwise(F.floor(c("n") / 2).cast("int"))
    out = out.select(entity, split.alias("split"), F.when(c("b").isNotNull(), better).alias("improvement"))
    sides = rows.select(entity, "split", "slope0", "slope1")
    return out.join(sides, [entity, "split"], "left").select(entity, "split", "improvement", c("slope0").alias("pre_slope"), c("slope1").alias("post_slope"))


def recovery_slope(panel: DataFrame, *, entity: str = "public_id", order: str = "week_idx", value: str = "sales_card_mm") -> DataFrame:
    """Slope from the first minimum to the end."""
    low = panel.groupBy(entity).agg(F.min_by(order, F.struct(value, order)).alias("_low"))
    return panel.join(low, entity).where(c(order) >= c("_low")).groupBy(entity).agg(F.first("_low").alias("low_week"), slope(c(value), c(order)).alias("recovery_slope"))


def gaf_matrix(seq: DataFrame, *, entity: str = "public_id", array: str = "seq", difference: bool = False) -> DataFrame:
    """Gramian angular field of each array: scaled to [-1, 1] (a constant one to -1), cos(a + b) or sin(a - b)."""
    low, high = F.array_min(array), F.array_max(array)
    scaled = F.transform(array, lambda v: F.when(high > low, 2 * (v - low) / F.nullif(high - low, F.lit(0.0)) - 1).otherwise(-1.0))
    rows = seq.select(entity, scaled.alias("a")).withColumn("b", F.transform("a", lambda v: F.sqrt(F.greatest(1 - v * v, F.lit(0.0)))))

    def cell(i, j):
        ai, aj, bi, bj = F.get("a", i), F.get("a", j), F.get("b", i), F.get("b", j)
        return bi * aj - ai * bj if difference else ai * aj - bi * bj

    index = F.sequence(F.lit(0), F.size("a") - 1)
    return rows.select(entity, F.transform(index, lambda i: F.transform(index, lambda j: cell(i, j))).alias("gaf"))


def pct_change_lag(panel: DataFrame, *, entity: str = "public_id", order: str = "week_idx", value: str = "sales_card", lag: int = 4) -> DataFrame:
    before = F.lag(value, lag).over(Window.partitionBy(entity).orderBy(order))
    return panel.withColumn("pct_change", ratio(c(value) - before, before))


def feat_window_var(rows: DataFrame, *, entity: str = "public_id", period: str = "date_id") -> DataFrame:
    """The early matrix for windows of any length, keyed by spec and entity; entities with half of the window's weeks (2 at least).

    ``rows`` are feature rows with spec_id, feat_start and feat_end. Thirds and quarters follow each spec's own number of weeks.
    """
    f = rows.withColumn("_x", F.floor(F.datediff(period, "feat_start") / 7)).withColumn("_weeks", F.floor(F.datediff("feat_end", "feat_start") / 7) + 1)
    keys = ["spec_id", entity]
    base = with_neighbours(_channels(f, [*keys, "_weeks"], "_x", as_ratio=True), keys, moving=(4, 8))
    x, s, n = c("x"), c("s"), c("_weeks")
    third, half, quarter = F.greatest(F.floor(n / 3), F.lit(2)), F.greatest(F.floor(n / 2), F.lit(1)), F.greatest(F.floor(n / 4), F.lit(1))
    features = _core(x, s) | {"slope_1_3": slope_where(s, x, x < third), "slope_2_3": slope_where(s, x, (x >= third) & (x < 2 * third)), "slope_3_3": slope_where(s, x, x >= 2 * third), "slope_first_half": slope_where(s, x, x < half), "slope_second_half": slope_where(s, x, x >= half), "nc_first_q": F.avg(F.when(x < quarter, c("nc"))), "nc_last_q": F.avg(F.when(x >= n - quarter, c("nc")))}
    features |= {f"ma{k}_slope": slope(c(f"ma{k}"), x) for k in (4, 8)} | {f"ma{k}_std": F.stddev_pop(f"ma{k}") for k in (4, 8)} | {f"vol_w{k}": F.avg(f"sd{k}") / (F.avg(s) + 1e-9) for k in (4, 8)} | {"n_feat_weeks": F.count(s), "_w": F.first("_weeks")}
    out = base.groupBy(*keys).agg(*(v.alias(k) for k, v in features.items())).where(c("n_feat_weeks") >= F.greatest(F.ceil(0.5 * c("_w")), F.lit(2))).drop("_w")
    return out.withColumns({"slope_accel": c("slope_3_3") - c("slope_1_3"), "slope_half_diff": c("slope_second_half") - c("slope_first_half"), "nc_delta": c("nc_last_q") - c("nc_first_q")}).fillna(0.0)
