"""Queries of trajectory features."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.operators import features as op
from weekloom.plans.binding import panel, query, r2_sql, slope_sql
from weekloom.sources.tables import meta

c = F.col
_N = "n AS (SELECT *, count(*) OVER (PARTITION BY public_id) AS n FROM panel)"
_NC = "customer_new / nullif(customer, 0)::DOUBLE"


def _sel(**columns: str) -> str:
    return ", ".join(f"round({v}, 6) AS {k}" for k, v in columns.items())


_early = "week_idx < greatest(n // 2, 3)"


@query("feat_slopes", f"WITH {_N} SELECT public_id, count(sales_card_mm) AS n_observed_weeks_used, " + _sel(slope_early_mm=slope_sql("sales_card_mm", "week_idx", _early), slope_late_mm=slope_sql("sales_card_mm", "week_idx", f"NOT ({_early})"), slope_all_mm=slope_sql("sales_card_mm", "week_idx"), slope_tail_mm=slope_sql("sales_card_mm", "week_idx", "week_idx >= n - greatest(n // 5, 8)"), r2=r2_sql("sales_card_mm", "week_idx"), r2_early=r2_sql("sales_card_mm", "week_idx", _early)) + " FROM n GROUP BY 1", tables="p")
def _(s, d):
    return op.feat_slopes(panel(s, d))


@query("feat_cv_mdd", "WITH q AS (SELECT *, max(sales_card_mm) OVER (PARTITION BY public_id ORDER BY week_idx) AS pk FROM panel) SELECT public_id, round(least(stddev_pop(sales_card) / (avg(sales_card) + 1e-9), 5), 6) AS cv, round(max((pk - sales_card_mm) / (pk + 1e-9)), 6) AS mdd FROM q GROUP BY 1", tables="p")
def _(s, d):
    return op.feat_cv_mdd(panel(s, d))


@query("feat_behaviour", f"SELECT public_id, round(avg({_NC}), 6) AS nc_rate, round(coalesce(ln(1 + sum(coalesce(sales_delivery, 0)) / nullif(sum(sales_card), 0)), 0), 6) AS del_ratio_log, round(avg(before_noon_sales), 6) AS before_noon, round(avg(weekend_sales), 6) AS weekend, min(category) AS category, min(open_date) AS open_date, min(date_id) AS first_date, max(date_id) AS last_date FROM panel GROUP BY 1", tables="p")
def _(s, d):
    return op.feat_behaviour(panel(s, d))


@query("feat_behaviour_sums", "SELECT public_id, round(sum(customer_new) / nullif(sum(customer), 0)::DOUBLE, 6) AS nc_rate FROM panel GROUP BY 1", tables="p")
def _(s, d):
    return op.feat_behaviour(panel(s, d), mode="sums").select("public_id", "nc_rate")


@query("feat_seasonal_noise", "SELECT public_id, round(greatest(0, 1 - var_pop(resid) / var_pop(sales_card)), 6) AS seasonal_strength, round(var_pop(resid) / var_pop(sales_card), 6) AS noise_ratio FROM panel GROUP BY 1", tables="p")
def _(s, d):
    return op.feat_seasonal_noise(panel(s, d))


_CH = """ch AS (SELECT public_id, {x} AS x, ln(1 + sales_card) AS s, CASE WHEN customer > 0 THEN customer_new / customer::DOUBLE END AS nc, ln(1 + customer) AS cust,
 CASE WHEN sales_card > 0 THEN coalesce(sales_delivery, 0) / sales_card ELSE 0 END AS del, before_noon_sales AS bn, weekend_sales AS wk FROM panel WHERE {where}),
df AS (SELECT *, s - lag(s) OVER o AS diff, row_number() OVER o AS pos FROM ch WINDOW o AS (PARTITION BY public_id ORDER BY x)),
nb AS (SELECT *, CASE WHEN pos > 2 AND sign(coalesce(diff, 0)) <> lag(sign(coalesce(diff, 0))) OVER o THEN 1 ELSE 0 END AS turn,
 {roll} FROM df WINDOW o AS (PARTITION BY public_id ORDER BY x))"""


def _roll(moving=(5, 10, 15), rolling=(4, 8)):
    out = [f"CASE WHEN count(s) OVER (PARTITION BY public_id ORDER BY x ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) >= {k // 2} THEN avg(s) OVER (PARTITION BY public_id ORDER BY x ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) END AS ma{k}" for k in moving]
    out += [f"CASE WHEN count(s) OVER (PARTITION BY public_id ORDER BY x ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) >= {k // 2} THEN stddev_samp(s) OVER (PARTITION BY public_id ORDER BY x ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) END AS sd{k}" for k in rolling]
    return ", ".join(out)


_CORE = dict(
    sales_mean="avg(s)", sales_std="stddev_pop(s)", sales_median="quantile_cont(s, 0.5)", sales_cv="stddev_pop(s) / (avg(s) + 1e-9)", sales_min="min(s)", sales_max="max(s)", sales_range="max(s) - min(s)", slope_all=slope_sql("s", "x"),
    nc_mean="avg(nc)", nc_std="stddev_pop(nc)", nc_slope=slope_sql("nc", "x"), cust_slope=slope_sql("cust", "x"), cust_mean="avg(cust)", cust_cv="stddev_pop(cust) / (avg(cust) + 1e-9)", del_mean="avg(del)", del_slope=slope_sql("del", "x"), bn_mean="avg(bn)", wk_mean="avg(wk)",
    q25="quantile_cont(s, 0.25)", q50="quantile_cont(s, 0.5)", q75="quantile_cont(s, 0.75)", iqr="quantile_cont(s, 0.75) - quantile_cont(s, 0.25)", diff_mean="avg(diff)", diff_std="stddev_pop(diff)", diff_max_abs="max(abs(diff))",
)
_A, _C = slope_sql("s", "x", "x < 10"), slope_sql("s", "x", "x >= 20")
_EARLY = _CORE | dict(
    slope_1_10=_A, slope_11_20=slope_sql("s", "x", "x >= 10 AND x < 20"), slope_21_30=_C, vol_w4="avg(sd4) / (avg(s) + 1e-9)", vol_w8="avg(sd8) / (avg(s) + 1e-9)", nc_last4="avg(nc) FILTER (WHERE x >= 26)", nc_first4="avg(nc) FILTER (WHERE x < 4)",
    **{f"ma{k}_slope": slope_sql(f"ma{k}", "x") for k in (5, 10, 15)}, **{f"ma{k}_std": f"stddev_pop(ma{k})" for k in (5, 10, 15)},
    sales_skew="CASE WHEN var_pop(s) > 1e-12 THEN (avg(s * s * s) - 3 * avg(s) * avg(s * s) + 2 * avg(s) ** 3) / stddev_pop(s) ** 3 ELSE 0 END", sales_kurt="CASE WHEN var_pop(s) > 1e-12 THEN kurtosis_pop(s) ELSE 0 END",
    slope_accel=f"({_C}) - ({_A})", nc_delta="avg(nc) FILTER (WHERE x >= 26) - avg(nc) FILTER (WHERE x < 4)",
)


@query("feat_early30", f"WITH {_CH.format(x='week_idx', where='week_idx < 30', roll=_roll())} SELECT public_id, CAST(sum(turn) AS BIGINT) AS zero_cross, {_sel(**_EARLY)} FROM nb GROUP BY 1 HAVING count(s) >= 15", tables="p")
def _(s, d):
    return op.feat_early30(panel(s, d))


@query("feat_windows_sweep", f"SELECT w, public_id, count(sales_card) AS n, {_sel(slope=slope_sql('ln(1 + sales_card)', 'week_idx'), mean='avg(ln(1 + sales_card))', std='stddev_pop(ln(1 + sales_card))', nc_rate=f'avg({_NC})')} FROM panel, (SELECT unnest([10, 20, 30, 40, 50]) AS w) WHERE week_idx < w GROUP BY 1, 2", tables="p")
def _(s, d):
    return op.feat_windows_sweep(panel(s, d), [10, 20, 30, 40, 50])


def _segment(part: str) -> dict[str, str]:
    on = f"part = '{part}'"
    return {f"{part}_slope": slope_sql("s", "x", on), f"{part}_mean": f"avg(s) FILTER (WHERE {on})", f"{part}_std": f"stddev_pop(s) FILTER (WHERE {on})", f"{part}_vol": f"stddev_pop(s) FILTER (WHERE {on}) / (abs(avg(s) FILTER (WHERE {on})) + 1e-9)", f"{part}_nc": f"avg({_NC}) FILTER (WHERE {on})", f"{part}_customers": f"avg(customer) FILTER (WHERE {on})"}


@query("feat_segments", f"WITH g AS (SELECT *, CASE WHEN week_idx < 10 THEN 'early' WHEN week_idx >= 20 THEN 'late' END AS part, ln(1 + sales_card) AS s FROM panel WHERE week_idx < 30 AND sales_card IS NOT NULL), h AS (SELECT *, row_number() OVER (PARTITION BY public_id, part ORDER BY week_idx) - 1 AS x FROM g WHERE part IS NOT NULL) SELECT public_id, {_sel(**_segment('early'), **_segment('late'))} FROM h GROUP BY 1", tables="p")
def _(s, d):
    return op.feat_segments(panel(s, d))


@query("feat_early_simple", f"WITH e AS (SELECT *, max(sales_card) OVER (PARTITION BY public_id ORDER BY week_idx) AS pk FROM panel WHERE week_idx < 20) SELECT public_id, count(sales_card) AS n, {_sel(slope=slope_sql('sales_card', 'week_idx'), early_slope=slope_sql('sales_card', 'week_idx', 'week_idx < 10'), cv='least(stddev_pop(sales_card) / (avg(sales_card) + 1e-9), 5)', r2=r2_sql('sales_card', 'week_idx'), mean='avg(sales_card)', nc_rate=f'avg({_NC})', mdd='max((pk - sales_card) / (pk + 1e-9))')} FROM e GROUP BY 1 HAVING count(sales_card) >= 10", tables="p")
def _(s, d):
    return op.feat_early_simple(panel(s, d))


def _growth(k: int) -> str:
    last, first = f"avg(sales_card) FILTER (WHERE week_idx >= n - {k})", f"avg(sales_card) FILTER (WHERE week_idx < {k})"
    return f"({last} - {first}) / nullif({first}, 0)"


@query("feat_recent_early_growth", f"WITH {_N}, q AS (SELECT *, lag(sales_card) OVER (PARTITION BY public_id ORDER BY week_idx) AS b FROM n) SELECT public_id, {_sel(growth_4=_growth(4), growth_8=_growth(8), growth_12=_growth(12), cv='least(stddev_pop(sales_card) / (avg(sales_card) + 1e-9), 5)', rising_share='avg(CASE WHEN b IS NOT NULL THEN CAST(sales_card > b AS INTEGER) END)')} FROM q GROUP BY 1", tables="p")
def _(s, d):
    return op.feat_recent_early_growth(panel(s, d), [4, 8, 12])


@query("feat_store_summary", f"""WITH {_N}, e AS (SELECT *, least(greatest(n // 4, 4), 12) AS edge FROM n),
q AS (SELECT public_id, any_value(n) AS weeks, avg(sales_card) FILTER (WHERE week_idx < edge) AS a, avg(sales_card) FILTER (WHERE week_idx >= n - edge) AS b, {slope_sql('ln(1 + sales_card)', 'week_idx')} AS log_slope, sum(sales_delivery) / nullif(sum(sales_card), 0) AS ds, sum(sales_invoice) / nullif(sum(sales_card), 0) AS i, max(sales_card) / nullif(min(sales_card), 0) AS mm FROM e GROUP BY 1)
SELECT public_id, weeks, round(a, 6) AS first_mean, round(b, 6) AS last_mean, round(log_slope, 6) AS log_slope, round(ds, 6) AS delivery_share, round(i, 6) AS invoice_share, round(mm, 6) AS max_min, round((b - a) / nullif(abs(a), 0), 6) AS edge_growth, CASE WHEN (b - a) / abs(a) >= 0.05 THEN 'growth' WHEN (b - a) / abs(a) <= -0.05 THEN 'decline' ELSE 'flat' END AS growth_type FROM q""", tables="p")
def _(s, d):
    return op.feat_store_summary(panel(s, d))


_later = "week_idx >= 30 AND week_idx < 42"


@query("feat_first_n_next", f"""WITH q AS (SELECT public_id, avg(sales_card) FILTER (WHERE week_idx < 30) AS early_mean, {slope_sql('sales_card', 'week_idx', 'week_idx < 30')} AS early_slope, stddev_pop(sales_card) FILTER (WHERE week_idx < 30) AS early_std, {slope_sql('sales_card', 'week_idx', _later)} AS next_slope, sum(sales_card) FILTER (WHERE {_later}) AS next_total, avg(sales_card) FILTER (WHERE {_later}) AS next_mean, count(sales_card) FILTER (WHERE {_later}) AS next_weeks FROM panel GROUP BY 1)
SELECT public_id, round(early_mean, 6) AS early_mean, round(early_slope, 6) AS early_slope, round(early_std, 6) AS early_std, round(next_slope, 6) AS next_slope, round(next_total, 6) AS next_total, round(next_mean, 6) AS next_mean, next_weeks, CAST(sign(next_slope) AS DOUBLE) AS next_sign, round((next_mean - early_mean) / early_mean, 6) AS next_growth FROM q WHERE next_weeks >= 6""", tables="p")
def _(s, d):
    return op.feat_first_n_next(panel(s, d))


@query("feat_future_target", f"SELECT public_id, round(avg(sales_card) FILTER (WHERE {_later}), 6) AS next_mean, round(sum(sales_card) FILTER (WHERE {_later}), 6) AS next_total FROM panel GROUP BY 1", tables="p")
def _(s, d):
    return op.feat_first_n_next(panel(s, d)).select("public_id", "next_mean", "next_total")


@query("feat_meta", """SELECT public_id, round((DATE '2001-12-31' - open_date) / 30.4375, 6) AS tenure_months, round(ln(1 + greatest((DATE '2001-12-31' - open_date) / 30.4375, 0)), 6) AS log_tenure, CAST(CAST(replace(age, 's', '') AS INTEGER) <= 30 AS INTEGER) AS young, CAST(CAST(replace(age, 's', '') AS INTEGER) >= 50 AS INTEGER) AS senior, CAST(delivery_link > 0 AS INTEGER) AS delivers,
 round(ln(1 + greatest(least(area, (SELECT quantile_cont(area, 0.99) FROM meta)), 0)), 6) AS log_area FROM meta""", tables="m")
def _(s, d):
    return op.feat_meta(meta(s, d))


_ph = {"cv_1": "week_idx < 15", "cv_2": "week_idx >= 15 AND week_idx < 30", "cv_3": "week_idx >= 30"}


@query("feat_phase_cv", "SELECT public_id, count(sales_card) AS n, " + _sel(**{k: f"stddev_pop(ln(1 + sales_card)) FILTER (WHERE {v}) / (abs(avg(ln(1 + sales_card)) FILTER (WHERE {v})) + 1e-9)" for k, v in _ph.items()}) + " FROM panel GROUP BY 1 HAVING count(sales_card) >= 30", tables="p")
def _(s, d):
    return op.feat_phase_cv(panel(s, d))


def _detrend(t: str) -> str:
    return f"WITH f AS (SELECT public_id, regr_slope(sales_card, {t}) AS b, regr_intercept(sales_card, {t}) AS a, {r2_sql('sales_card', t)} AS r2 FROM panel GROUP BY 1) SELECT public_id, round(any_value(r2), 6) AS r2, round(least(stddev_pop(sales_card - a - b * {t}) / (avg(abs(a + b * {t})) + 1e-9), 5), 6) AS cv FROM panel JOIN f USING (public_id) GROUP BY 1"


@query("detrend_poly", _detrend("week_idx"), tables="p")
def _(s, d):
    return op.detrend(panel(s, d))


@query("detrend_log", _detrend("ln(1 + week_idx)"), tables="p")
def _(s, d):
    return op.detrend(panel(s, d), log_time=True)


@query("detrend_rolling", "WITH q AS (SELECT *, avg(sales_card) OVER (PARTITION BY public_id ORDER BY week_idx ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) AS t FROM panel) SELECT public_id, round(stddev_pop(sales_card - t) / greatest(avg(abs(t)), avg(abs(sales_card)), 1), 6) AS scale FROM q GROUP BY 1", tables="p")
def _(s, d):
    return op.detrend_rolling(panel(s, d).drop("trend"), 12)


@query("detrend_pick_best", f"""WITH a AS ({_detrend('week_idx')}), b AS ({_detrend('ln(1 + week_idx)')}), r AS (SELECT public_id, stddev_pop(sales_card) / (avg(sales_card) + 1e-9) AS raw_cv FROM panel GROUP BY 1)
SELECT public_id, round(CASE WHEN greatest(a.r2, b.r2) < 0.1 THEN raw_cv WHEN a.r2 >= greatest(a.r2, b.r2) - 0.05 THEN a.cv ELSE b.cv END, 5) AS best_cv, CASE WHEN greatest(a.r2, b.r2) < 0.1 THEN 'raw' WHEN a.r2 >= greatest(a.r2, b.r2) - 0.05 THEN 'linear' ELSE 'log' END AS method FROM a JOIN b USING (public_id) JOIN r USING (public_id)""", tables="p", digits=5)
def _(s, d):
    p = panel(s, d)
    a, b = (op.detrend(p, log_time=log).select("public_id", c("r2").alias(f"r2_{m}"), c("cv").alias(f"cv_{m}")) for log, m in ((False, "linear"), (True, "log")))
    raw = p.groupBy("public_id").agg((F.stddev_pop("sales_card") / (F.avg("sales_card") + 1e-9)).alias("raw_cv"))
    return op.detrend_pick_best(a.join(b, "public_id").join(raw, "public_id"), ["linear", "log"]).select("public_id", "best_cv", "method")


@query("rolling_features", """SELECT public_id, week_idx, round(avg(sales_card) OVER (o ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS ma4, round(avg(sales_card) OVER (o ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) / nullif(avg(sales_card) OVER (o ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 0) - 1, 6) AS ma_gap,
 round(stddev_samp(sales_card) OVER (o ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS sd4, round(lag(sales_card, 4) OVER o, 6) AS lag4 FROM panel WINDOW o AS (PARTITION BY public_id ORDER BY week_idx)""", tables="p")
def _(s, d):
    return op.rolling_features(panel(s, d)).select("public_id", c("week_idx").cast("long").alias("week_idx"), "ma4", "ma_gap", F.round("sd4", 4).alias("sd4"), "lag4")


@query("seq_windows", "WITH q AS (SELECT public_id, week_idx, list(sales_card) OVER (PARTITION BY public_id ORDER BY week_idx ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS h, list(sales_card) OVER (PARTITION BY public_id ORDER BY week_idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS z FROM panel) SELECT public_id, week_idx, h[1] AS first_value, h[8] AS last_value, z[4] AS horizon_end FROM q WHERE len(h) = 8 AND len(z) = 4", tables="p")
def _(s, d):
    w = op.seq_windows(panel(s, d), 8, 4)
    return w.select("public_id", c("week_idx").cast("long").alias("week_idx"), c("history")[0].alias("first_value"), c("history")[7].alias("last_value"), c("horizon")[3].alias("horizon_end"))


@query("seq_fixed", "SELECT public_id, list(coalesce(v, 0) ORDER BY i) AS seq FROM (SELECT e.public_id, i, sales_card AS v FROM (SELECT DISTINCT public_id FROM panel) e CROSS JOIN (SELECT unnest(range(30)) AS i) LEFT JOIN panel p ON p.public_id = e.public_id AND p.week_idx = i) GROUP BY 1", tables="p")
def _(s, d):
    return op.seq_fixed(panel(s, d))


@query("traj_matrix_filter", """WITH q AS (SELECT public_id, week_idx, CASE WHEN customer % 3 > 0 THEN sales_card_mm END AS v FROM panel WHERE week_idx < 60), k AS (SELECT week_idx, median(v) AS med FROM q GROUP BY 1 HAVING count(v) >= 0.6 * (SELECT count(DISTINCT public_id) FROM q)),
e AS (SELECT public_id FROM q JOIN k USING (week_idx) GROUP BY 1 HAVING count(v) >= 0.65 * (SELECT count(*) FROM k)) SELECT e.public_id, k.week_idx, round(coalesce(v, med), 6) AS sales_card_mm FROM e CROSS JOIN k LEFT JOIN q ON q.public_id = e.public_id AND q.week_idx = k.week_idx""", tables="p")
def _(s, d):
    p = panel(s, d).withColumn("sales_card_mm", F.when(c("customer") % 3 > 0, c("sales_card_mm"))).withColumn("week_idx", c("week_idx").cast("long"))
    return op.traj_matrix_filter(p, entity_share=0.65)


_SPLIT = """q AS (SELECT a.public_id, s.split, a.week_idx AS x, a.sales_card_mm AS y FROM panel a JOIN (SELECT public_id, week_idx + 1 AS split FROM panel) s USING (public_id))"""


def _side(f, before: bool) -> str:
    return f(f"x {'<' if before else '>='} split")


@query("change_point_gap", f"""WITH {_SPLIT}, g AS (SELECT public_id, split, avg(y) FILTER (WHERE x < split) AS a, avg(y) FILTER (WHERE x >= split) AS b, {slope_sql('y', 'x', 'x < split')} AS p, {slope_sql('y', 'x', 'x >= split')} AS t FROM q GROUP BY 1, 2 HAVING count(*) FILTER (WHERE x < split) >= 4 AND count(*) FILTER (WHERE x >= split) >= 4)
SELECT public_id, CAST(split AS INTEGER) AS split, round(p, 6) AS pre_slope, round(t, 6) AS post_slope, round(abs(b - a), 6) AS magnitude, CAST(b > a AS INTEGER) AS is_up FROM (SELECT *, row_number() OVER (PARTITION BY public_id ORDER BY round(abs(b - a), 9) DESC, split) AS rn FROM g) WHERE rn = 1""", tables="p")
def _(s, d):
    return op.change_point_gap(panel(s, d))


@query("change_point_slope", f"""WITH {_SPLIT}, g AS (SELECT public_id, split, {slope_sql('y', 'x', 'x < split')} AS p, {slope_sql('y', 'x', 'x >= split')} AS t FROM q GROUP BY 1, 2 HAVING count(*) FILTER (WHERE x < split) >= 5 AND count(*) FILTER (WHERE x >= split) >= 5)
SELECT public_id, CAST(split AS INTEGER) AS split, round(p, 6) AS pre_slope, round(t, 6) AS post_slope, round(abs(t - p), 6) AS slope_gap FROM (SELECT *, row_number() OVER (PARTITION BY public_id ORDER BY round(abs(t - p), 9) DESC, split) AS rn FROM g) WHERE rn = 1""", tables="p")
def _(s, d):
    return op.change_point_slope(panel(s, d))


@query("inflection_rss", f"""WITH {_SPLIT}, g AS (SELECT public_id, split, regr_syy(CASE WHEN x < split THEN y END, x) - coalesce(regr_sxy(CASE WHEN x < split THEN y END, x) ** 2 / nullif(regr_sxx(CASE WHEN x < split THEN y END, x), 0), 0) + regr_syy(CASE WHEN x >= split THEN y END, x) - coalesce(regr_sxy(CASE WHEN x >= split THEN y END, x) ** 2 / nullif(regr_sxx(CASE WHEN x >= split THEN y END, x), 0), 0) AS rss
 FROM q GROUP BY 1, 2 HAVING count(*) FILTER (WHERE x < split) >= 4 AND count(*) FILTER (WHERE x >= split) >= 4),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY public_id ORDER BY round(rss, 9), split) AS rn FROM g) WHERE rn = 1), t AS (SELECT public_id, count(*) AS n, regr_syy(sales_card_mm, week_idx) - regr_sxy(sales_card_mm, week_idx) ** 2 / regr_sxx(sales_card_mm, week_idx) AS total FROM panel GROUP BY 1),
z AS (SELECT public_id, CASE WHEN 1 - rss / total >= 0.05 THEN split ELSE n // 2 END AS split, 1 - rss / total AS improvement FROM t LEFT JOIN b USING (public_id))
SELECT z.public_id, CAST(z.split AS INTEGER) AS split, round(any_value(improvement), 6) AS improvement, round({slope_sql('sales_card_mm', 'week_idx', 'week_idx < z.split')}, 6) AS pre_slope, round({slope_sql('sales_card_mm', 'week_idx', 'week_idx >= z.split')}, 6) AS post_slope FROM z JOIN panel USING (public_id) GROUP BY 1, z.split""", tables="p")
def _(s, d):
    return op.inflection_rss(panel(s, d))


@query("recovery_slope", f"WITH l AS (SELECT public_id, arg_min(week_idx, sales_card_mm) AS low FROM panel GROUP BY 1) SELECT public_id, CAST(any_value(low) AS BIGINT) AS low_week, round({slope_sql('sales_card_mm', 'week_idx')}, 6) AS recovery_slope FROM panel JOIN l USING (public_id) WHERE week_idx >= low GROUP BY 1", tables="p")
def _(s, d):
    return op.recovery_slope(panel(s, d)).withColumn("low_week", c("low_week").cast("long"))


@query("gaf_matrix", """WITH q AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), z AS (SELECT vec_id, list_transform(e, lambda v: 2 * (v - list_min(e)) / (list_max(e) - list_min(e)) - 1) AS a FROM q),
y AS (SELECT vec_id, a, list_transform(a, lambda v: sqrt(greatest(1 - v * v, 0))) AS b FROM z), i AS (SELECT vec_id, a, b, unnest(range(1, len(a) + 1)) AS i FROM y), j AS (SELECT vec_id, a, b, i, unnest(range(1, len(a) + 1)) AS j FROM i), g AS (SELECT vec_id, i, j, a[i] * a[j] - b[i] * b[j] AS g FROM j)
SELECT vec_id, count(*) AS cells, round(sum(g), 6) AS total, round(sum(g * g), 6) AS squares, round(sum(g * i * (j + 1)), 6) AS weighted, round(sum(g) FILTER (WHERE i = 1 AND j = 2), 6) AS g01 FROM g GROUP BY 1""")
def _(s, d):
    from weekloom.sources.tables import read_table

    v = read_table(s, d, "embeddings").select("vec_id", c("embedding").cast("array<double>").alias("seq"))
    flat = F.flatten("gaf")
    n = F.size("gaf")
    # position k of the flat matrix is row k / n and column k % n
    weighted = F.transform(flat, lambda g, k: g * (F.floor(k / n) + 1) * (k % n + 2))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    out = op.gaf_matrix(v, entity="vec_id")
    return out.select("vec_id", F.size(flat).cast("long").alias("cells"), total(flat).alias("total"), total(F.transform(flat, lambda g: g * g)).alias("squares"), total(weighted).alias("weighted"), c("gaf")[0][1].alias("g01"))


@query("pct_change_lag4", "SELECT public_id, week_idx, round((sales_card - lag(sales_card, 4) OVER o) / nullif(lag(sales_card, 4) OVER o, 0), 6) AS pct_change FROM panel WINDOW o AS (PARTITION BY public_id ORDER BY week_idx)", tables="p")
def _(s, d):
    return op.pct_change_lag(panel(s, d)).select("public_id", c("week_idx").cast("long").alias("week_idx"), "pct_change")
