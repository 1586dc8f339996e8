"""Queries of labels, summaries and cross tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.operators import features as ft
from weekloom.operators import labels as op
from weekloom.operators import summaries as sm
from weekloom.plans.binding import panel, query, slope_sql
from weekloom.plans.feature_queries import _N, _early
from weekloom.sources.tables import meta, read_table

c = F.col
SL = f"""n AS (SELECT *, count(*) OVER (PARTITION BY public_id) AS n FROM panel), f AS (SELECT public_id, any_value(category) AS category, any_value(dong) AS dong, any_value(sigungu) AS sigungu, any_value(open_date) AS open_date, max(date_id) AS last_date, any_value(n) AS weeks,
 {slope_sql('sales_card_mm', 'week_idx', _early)} AS e, {slope_sql('sales_card_mm', 'week_idx', f'NOT ({_early})')} AS l, {slope_sql('sales_card_mm', 'week_idx')} AS a FROM n GROUP BY 1),
lab AS (SELECT *, CASE WHEN a > 0.5 * stddev_samp(a) OVER () THEN 'Growth' WHEN a < -0.5 * stddev_samp(a) OVER () THEN 'Decline' ELSE 'Stable' END AS outcome_3 FROM f)"""


def labelled(s, d):
    p = panel(s, d)
    more = p.groupBy("public_id").agg(F.first("category").alias("category"), F.first("dong").alias("dong"), F.first("sigungu").alias("sigungu"), F.first("open_date").alias("open_date"), F.max("date_id").alias("last_date"), F.count("*").alias("weeks"))
    return op.label_outcome3(ft.feat_slopes(p).join(more, "public_id"))


@query("flagship_outcomes", f"WITH {SL} SELECT category, outcome_3, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY category)::DOUBLE, 6) AS share FROM lab GROUP BY 1, 2", tables="p")
def _(s, d):
    return sm.shares_in_group(labelled(s, d), ["category"], "outcome_3")


@query("label_outcome3", f"WITH {SL} SELECT public_id, outcome_3 FROM lab", tables="p")
def _(s, d):
    return labelled(s, d).select("public_id", "outcome_3")


@query("label_12class", f"WITH {SL} SELECT public_id, CASE WHEN e > 0 THEN 'U' ELSE 'D' END || CASE WHEN l > 0 THEN 'U' ELSE 'D' END || '_' || CASE outcome_3 WHEN 'Growth' THEN 'X' WHEN 'Stable' THEN 'Y' ELSE 'Z' END AS label FROM lab", tables="p")
def _(s, d):
    return op.label_12class(labelled(s, d)).select("public_id", "label")


_MDD = "q AS (SELECT *, max(sales_card_mm) OVER (PARTITION BY public_id ORDER BY week_idx) AS pk FROM panel), dd AS (SELECT public_id, max((pk - sales_card_mm) / (pk + 1e-9)) AS mdd FROM q GROUP BY 1)"


@query("label_6class", f"WITH {SL}, {_MDD} SELECT public_id, CASE WHEN e > 0 THEN 'U' ELSE 'D' END || CASE WHEN l > 0 THEN 'U' ELSE 'D' END || '_' || CASE WHEN mdd > (SELECT median(mdd) FROM dd) THEN 'high' ELSE 'low' END AS label6 FROM f JOIN dd USING (public_id)", tables="p")
def _(s, d):
    p = panel(s, d)
    return op.label_6class(ft.feat_slopes(p).join(ft.feat_cv_mdd(p), "public_id")).select("public_id", "label6")


@query("label_udx_terciles", f"WITH {SL} SELECT public_id, CASE WHEN l >= quantile_cont(l, 0.67) OVER () THEN 'X' WHEN l <= quantile_cont(l, 0.33) OVER () THEN 'D' ELSE 'U' END AS udx FROM f", tables="p")
def _(s, d):
    return op.label_terciles(ft.feat_slopes(panel(s, d))).select("public_id", "udx")


_ED = f"""{_N}, e AS (SELECT *, least(greatest(n // 4, 4), 12) AS edge FROM n), g AS (SELECT public_id, any_value(n) AS weeks, avg(sales_card) FILTER (WHERE week_idx < edge) AS x, avg(sales_card) FILTER (WHERE week_idx >= n - edge) AS y, {slope_sql('ln(1 + sales_card)', 'week_idx')} AS b FROM e GROUP BY 1)"""


@query("label_edge_change", f"WITH {_ED} SELECT public_id, round((y - x) / abs(x), 6) AS edge_change, CASE WHEN b >= 0 THEN 'U' ELSE 'D' END || CASE WHEN (y - x) / abs(x) >= 0.08 THEN 'X' WHEN (y - x) / abs(x) <= -0.08 THEN 'Z' ELSE 'Y' END AS edge_label FROM g", tables="p")
def _(s, d):
    return op.label_edge_change(ft.feat_store_summary(panel(s, d))).select("public_id", "edge_change", "edge_label")


@query("label_final_code", f"WITH {SL}, z AS (SELECT public_id, CASE WHEN e > 0 THEN 'U' ELSE 'D' END || CASE WHEN l > 0 THEN 'U' ELSE 'D' END || CASE CAST(public_id AS BIGINT) % 4 WHEN 0 THEN 'X' WHEN 1 THEN 'Z' ELSE 'Y' END AS final_code FROM f) SELECT public_id, final_code, substr(final_code, 3, 1) AS pattern, CASE substr(final_code, 1, 2) WHEN 'UU' THEN 'growth' WHEN 'UD' THEN 'maturity' WHEN 'DU' THEN 'recovery' ELSE 'decline' END AS life_stage FROM z", tables="p")
def _(s, d):
    f = ft.feat_slopes(panel(s, d))
    sides = f.select("public_id", c("slope_early_mm").alias("pre_slope"), c("slope_late_mm").alias("post_slope"))
    return op.label_final_code(sides, f.select("public_id", (c("public_id").cast("long") % 4).alias("cluster")), {0: "X", 1: "Z"}).select("public_id", "final_code", "pattern", "life_stage")


@query("label_outcome4", f"WITH {SL} SELECT CASE WHEN e > 0 AND l > 0 THEN 'sustained' WHEN l > 0 THEN 'rebound' WHEN e > 0 THEN 'reversal' ELSE 'falling' END AS outcome4, count(*) AS n FROM f GROUP BY 1", tables="p")
def _(s, d):
    return op.label_outcome4(op.label_12class(labelled(s, d)), code="label").groupBy("outcome4").agg(F.count("*").alias("n"))


@query("label_growth_binary", f"WITH {_ED} SELECT public_id, CAST(y / nullif(x, 0) >= 1 AS INTEGER) AS grew FROM g", tables="p")
def _(s, d):
    return op.label_growth_binary(ft.feat_store_summary(panel(s, d)).withColumn("growth_rate", F.try_divide("last_mean", "first_mean"))).select("public_id", "grew")


@query("label_alt_rules", f"""WITH {_ED}, h AS (SELECT *, (y - x) / abs(x) AS r FROM g), t AS (SELECT quantile_cont(r, 0.3) AS q1, quantile_cont(r, 0.7) AS q2, quantile_cont(r, 0.2) AS q3, quantile_cont(r, 0.8) AS q4, median(weeks) AS m FROM h)
SELECT public_id, CASE WHEN r >= q2 THEN 'Growth' WHEN r <= q1 THEN 'Decline' ELSE 'Stable' END AS rule_30, CASE WHEN r >= q4 THEN 'Growth' WHEN r <= q3 THEN 'Decline' ELSE 'Stable' END AS rule_20, CASE WHEN weeks < m THEN 'Stable' WHEN r > 0 THEN 'Growth' WHEN r < 0 THEN 'Decline' ELSE 'Stable' END AS rule_gated FROM h, t""", tables="p")
def _(s, d):
    return op.label_alt_rules(ft.feat_store_summary(panel(s, d))).select("public_id", "rule_30", "rule_20", "rule_gated")


_LT = f"t AS (SELECT public_id, week_idx, sales_card / nullif(avg(sales_card) OVER (PARTITION BY public_id), 0) AS v FROM panel WHERE week_idx < 20 OR week_idx BETWEEN 52 AND 71), g AS (SELECT public_id, count(v) FILTER (WHERE week_idx >= 52) AS n, {slope_sql('v', 'week_idx', 'week_idx >= 52')} AS slope FROM t GROUP BY 1), h AS (SELECT *, stddev_pop(slope) OVER () AS sg FROM g)"


@query("label_target_window", f"WITH {_LT} SELECT public_id, round(slope, 6) AS slope, CASE WHEN slope > 0.5 * sg THEN 'Growth' WHEN slope < -0.5 * sg THEN 'Decline' ELSE 'Stable' END AS outcome_3 FROM h WHERE n >= 3", tables="p")
def _(s, d):
    from weekloom.functions.columns import slope_where
    from weekloom.operators.panel import mean_norm_entity

    x = c("week_idx")
    rows = mean_norm_entity(panel(s, d).where((x < 20) | x.between(52, 71)))
    t = rows.groupBy("public_id").agg(F.count(F.when(x >= 52, c("norm"))).alias("n"), slope_where(c("norm"), x, x >= 52).alias("slope"))
    return op.label_outcome3(t, slope="slope", ddof=0).where("n >= 3").select("public_id", "slope", "outcome_3")


@query("label_threshold_sweep", f"WITH {SL} SELECT CAST(k AS DOUBLE) AS k, CASE WHEN a > k * sg THEN 'Growth' WHEN a < -k * sg THEN 'Decline' ELSE 'Stable' END AS outcome_3, count(*) AS n, round(count(*) / any_value(t)::DOUBLE, 6) AS share FROM (SELECT a, stddev_pop(a) OVER () AS sg, count(*) OVER () AS t FROM f), (SELECT unnest([0.25, 0.5, 0.75, 1.0]) AS k) GROUP BY 1, 2", tables="p")
def _(s, d):
    return op.label_threshold_sweep(ft.feat_slopes(panel(s, d)), [0.25, 0.5, 0.75, 1.0])


_CU = "u AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS open_date, CAST(max(o_orderdate) AS DATE) AS last_date FROM orders GROUP BY 1), k AS (SELECT *, greatest(((SELECT max(last_date) FROM u) - last_date) // 7, 0) AS weeks_to_end, greatest((last_date - open_date) // 7, 0) AS survival_weeks FROM u)"


def customers(s, d):
    return read_table(s, d, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("open_date"), F.to_date(F.max("o_orderdate")).alias("last_date"))


@query("label_closure", f"WITH {_CU} SELECT o_custkey, CAST(cutoff AS INTEGER) AS cutoff, CAST(weeks_to_end >= cutoff AS INTEGER) AS is_closed, CAST(survival_weeks AS BIGINT) AS survival_weeks FROM k, (SELECT unnest([2, 4, 6, 8]) AS cutoff)")
def _(s, d):
    return op.label_closure(customers(s, d), cutoffs=(2, 4, 6, 8)).select("o_custkey", "cutoff", "is_closed", c("survival_weeks").cast("long").alias("survival_weeks"))


@query("agg_closure_summary", f"WITH {_CU} SELECT CAST(weeks_to_end >= 26 AS INTEGER) AS is_closed, count(*) AS n, round(median(survival_weeks), 6) AS median_survival FROM k GROUP BY 1")
def _(s, d):
    return op.label_closure(customers(s, d), cutoffs=(26,)).groupBy("is_closed").agg(F.count("*").alias("n"), F.percentile("survival_weeks", F.lit(0.5)).alias("median_survival"))


@query("agg_survivorship_bias", f"WITH {_CU} SELECT n >= 10 AS in_panel, count(*) AS entities, round(avg(CAST(weeks_to_end >= 26 AS INTEGER)), 6) AS closure_rate, round(median(survival_weeks), 6) AS median_survival FROM k JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) USING (o_custkey) GROUP BY 1")
def _(s, d):
    n = read_table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return op.label_closure(customers(s, d), cutoffs=(26,)).join(n, "o_custkey").groupBy((c("n") >= 10).alias("in_panel")).agg(F.count("*").alias("entities"), F.avg("is_closed").alias("closure_rate"), F.percentile("survival_weeks", F.lit(0.5)).alias("median_survival"))


@query("agg_summary_by_label", " UNION ALL ".join(f"SELECT lang, '{m}' AS metric, count({v}) AS n, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS sd, round(quantile_cont({v}, 0.25), 6) AS q25, round(median({v}), 6) AS median, round(quantile_cont({v}, 0.75), 6) AS q75, CAST(min({v}) AS DOUBLE) AS low, CAST(max({v}) AS DOUBLE) AS high FROM documents JOIN labels USING (doc_id) GROUP BY 1" for m, v in (("n_chars", "n_chars"), ("quality", "quality"))))
def _(s, d):
    rows = read_table(s, d, "documents").select("doc_id", "lang", c("n_chars").cast("double").alias("n_chars")).join(read_table(s, d, "labels").select("doc_id", c("quality").cast("double").alias("quality")), "doc_id")
    return sm.summary_by_label(rows, "lang", ["n_chars", "quality"])


@query("xtab_counts_shares", """WITH x AS (SELECT coalesce(o_orderstatus, 'All') AS o_orderstatus, coalesce(o_orderpriority, 'All') AS o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)) SELECT x.o_orderstatus, x.o_orderpriority, x.n, round(x.n / t.n::DOUBLE, 6) AS share FROM x JOIN x t ON t.o_orderstatus = x.o_orderstatus AND t.o_orderpriority = 'All'""")
def _(s, d):
    return sm.crosstab(read_table(s, d, "orders").select("o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderpriority")


def _bins(table: str, v: str, n: int) -> str:
    edges = ", ".join(f"quantile_cont({v}, {i / n})" for i in range(1, n))
    return f"b AS (SELECT *, 1 + len(list_filter((SELECT list_distinct([{edges}]) FROM {table}), lambda e: {v} > e)) AS bin FROM {table})"


@query("xtab_quartile_outcome", f"""WITH {SL}, s0 AS (SELECT public_id, sum(sales_card) AS v FROM panel WHERE week_idx < 30 GROUP BY 1), s1 AS (SELECT v, outcome_3 FROM s0 JOIN lab USING (public_id)), {_bins('s1', 'v', 4)}, r AS (SELECT bin, outcome_3, count(*) / sum(count(*)) OVER (PARTITION BY bin)::DOUBLE AS share FROM b GROUP BY 1, 2)
SELECT CAST(bin AS INTEGER) AS bin, outcome_3, round(share, 6) AS share, round(100 * (share - (SELECT count(*) FROM b z WHERE z.outcome_3 = r.outcome_3) / (SELECT count(*) FROM b)::DOUBLE), 6) AS diff_pp FROM r""", tables="p")
def _(s, d):
    early = panel(s, d).where("week_idx < 30").groupBy("public_id").agg(F.sum("sales_card").alias("v"))
    rows = sm.bin_right_closed(early.join(labelled(s, d).select("public_id", "outcome_3"), "public_id"), "v", 4)
    base = rows.groupBy("outcome_3").agg(F.count("*").alias("k")).crossJoin(rows.agg(F.count("*").alias("t"))).select("outcome_3", F.try_divide(c("k").cast("double"), "t").alias("base"))
    return sm.shares_in_group(rows, ["bin"], "outcome_3").join(F.broadcast(base), "outcome_3").select("bin", "outcome_3", "share", (100 * (c("share") - c("base"))).alias("diff_pp"))


@query("qcut_deciles", f"WITH l AS (SELECT n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)), {_bins('l', 'n_chars', 10)} SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(CAST(quality = 1 AS INTEGER)), 6) AS good, round(avg(CAST(toxic = 1 AS INTEGER)), 6) AS toxic_rate FROM b GROUP BY 1")
def _(s, d):
    rows = read_table(s, d, "documents").select("doc_id", "n_chars").join(read_table(s, d, "labels"), "doc_id")
    return sm.bin_rates(sm.bin_right_closed(rows, "n_chars", 10), "bin", {"good": c("quality") == 1, "toxic_rate": c("toxic") == 1})


@query("bucket_age", f"WITH {_CU}, m AS (SELECT o_custkey, year(open_date) AS open_year, (year(last_date) - year(open_date)) * 12 + month(last_date) - month(open_date) AS months FROM u), b AS (SELECT open_year, CASE WHEN months <= 12 THEN '0-12' WHEN months <= 36 THEN '13-36' WHEN months <= 60 THEN '37-60' ELSE '61+' END AS bucket FROM m) SELECT open_year, bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY open_year)::DOUBLE, 6) AS share FROM b GROUP BY 1, 2")
def _(s, d):
    months = (F.year("last_date") - F.year("open_date")) * 12 + F.month("last_date") - F.month("open_date")
    rows = customers(s, d).select(F.year("open_date").cast("long").alias("open_year"), F.when(months <= 12, "0-12").when(months <= 36, "13-36").when(months <= 60, "37-60").otherwise("61+").alias("bucket"))
    return sm.shares_in_group(rows, ["open_year"], "bucket")


@query("bucket_first_obs_gap", "WITH f AS (SELECT c_custkey, min(o_orderdate) AS f FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1), g AS (SELECT CASE WHEN f IS NULL THEN 'none' WHEN (CAST(f AS DATE) - (SELECT CAST(min(o_orderdate) AS DATE) FROM orders)) <= 90 THEN '0-90' WHEN (CAST(f AS DATE) - (SELECT CAST(min(o_orderdate) AS DATE) FROM orders)) <= 365 THEN '91-365' ELSE '366+' END AS bucket FROM f) SELECT bucket, count(*) AS n FROM g GROUP BY 1")
def _(s, d):
    o = read_table(s, d, "orders")
    f = read_table(s, d, "customer").select("c_custkey").join(o.groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("f")), c("c_custkey") == c("o_custkey"), "left")
    gap = F.datediff("f", "start")
    return f.crossJoin(F.broadcast(o.agg(F.to_date(F.min("o_orderdate")).alias("start")))).groupBy(F.when(c("f").isNull(), "none").when(gap <= 90, "0-90").when(gap <= 365, "91-365").otherwise("366+").alias("bucket")).agg(F.count("*").alias("n"))


@query("agg_industry_outcome", f"WITH {SL} SELECT category, count(*) AS n, round(avg(CAST(outcome_3 = 'Growth' AS INTEGER)), 6) AS growth, round(avg(CAST(outcome_3 = 'Decline' AS INTEGER)), 6) AS decline, round(avg(a), 6) AS mean_slope FROM lab GROUP BY 1", tables="p")
def _(s, d):
    return labelled(s, d).groupBy("category").agg(F.count("*").alias("n"), F.avg((c("outcome_3") == "Growth").cast("int")).alias("growth"), F.avg((c("outcome_3") == "Decline").cast("int")).alias("decline"), F.avg("slope_all_mm").alias("mean_slope"))


@query("agg_industry_region", "WITH x AS (SELECT year(o_orderdate) AS spec, c_mktsegment, n_name, count(*) AS n, avg(CAST(o_orderstatus = 'F' AS INTEGER)) AS share FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3 HAVING count(*) >= 10) SELECT c_mktsegment, n_name, count(*) AS specs, round(avg(share), 6) AS share FROM x GROUP BY 1, 2 ORDER BY round(avg(share), 9) DESC, c_mktsegment, n_name LIMIT 50")
def _(s, d):
    rows = read_table(s, d, "orders").join(read_table(s, d, "customer"), c("o_custkey") == c("c_custkey")).join(F.broadcast(read_table(s, d, "nation")), c("c_nationkey") == c("n_nationkey"))
    x = rows.groupBy(F.year("o_orderdate").alias("spec"), "c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.avg((c("o_orderstatus") == "F").cast("int")).alias("share")).where("n >= 10")
    return x.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("specs"), F.avg("share").alias("share")).orderBy(F.desc(F.round("share", 9)), "c_mktsegment", "n_name").limit(50)


@query("agg_demographics", f"WITH {SL} SELECT age, outcome_3, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY age)::DOUBLE, 6) AS share FROM lab JOIN meta USING (public_id) GROUP BY 1, 2", tables="p")
def _(s, d):
    return sm.shares_in_group(labelled(s, d).join(meta(s, d).select("public_id", "age"), "public_id"), ["age"], "outcome_3")


@query("dist_relative_ratio", "WITH x AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), y AS (SELECT *, sum(n) OVER (PARTITION BY source) AS total FROM x) SELECT source, lang, n, CAST(total AS BIGINT) AS total, round(n / total::DOUBLE, 6) AS ratio FROM y WHERE total >= 30")
def _(s, d):
    return sm.relative_ratio(read_table(s, d, "documents").select("source", "lang"), "source", "lang")


@query("dist_within_cluster", "SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang)::DOUBLE, 6) AS share FROM documents GROUP BY 1, 2")
def _(s, d):
    return sm.shares_in_group(read_table(s, d, "documents").select("source", "lang"), ["lang"], "source")


@query("agg_success_rate", "WITH x AS (SELECT lang, count(*) AS n, avg(quality) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT lang, n, round(rate, 6) AS rate, round((SELECT var_pop(rate) FROM x), 6) AS rate_variance FROM x")
def _(s, d):
    return sm.success_rate(read_table(s, d, "documents").select("doc_id", "lang").join(read_table(s, d, "labels"), "doc_id"), "lang", c("quality") == 1)


@query("rank_top_k", "SELECT c_mktsegment, c_custkey, c_acctbal, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 5")
def _(s, d):
    return sm.top_k(read_table(s, d, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), c("c_custkey")], 5).select("c_mktsegment", "c_custkey", "c_acctbal", "rank")


@query("select_examples", """WITH a AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 1), b AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT * FROM a) ORDER BY c_acctbal DESC, c_custkey LIMIT 1), z AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0 ORDER BY c_acctbal, c_custkey LIMIT 1)
SELECT 'A' AS rule, c_custkey FROM a UNION ALL SELECT 'B', c_custkey FROM b UNION ALL SELECT 'C', c_custkey FROM z""")
def _(s, d):
    rich = (c("c_acctbal") > 0, F.desc("c_acctbal"))
    return sm.select_examples(read_table(s, d, "customer"), [("A", *rich), ("B", *rich), ("C", c("c_acctbal") < 0, F.asc("c_acctbal"))], entity="c_custkey")


@query("screen_numeric", " UNION ALL ".join(f"SELECT '{m}' AS feature, round((sum(k * (g - t) ** 2)) / any_value(v), 6) AS score FROM (SELECT c_mktsegment, count(*) AS k, avg({m}) AS g FROM customer GROUP BY 1), (SELECT avg({m}) AS t, count(*) * var_pop({m}) AS v FROM customer)" for m in ("c_acctbal", "c_nationkey")))
def _(s, d):
    rows = read_table(s, d, "customer").select("c_mktsegment", "c_acctbal", c("c_nationkey").cast("double").alias("c_nationkey"))
    return sm.eta_squared(rows, "c_mktsegment", ["c_acctbal", "c_nationkey"])


_V = "SELECT '{f}' AS feature, round(sqrt(greatest(sum(n * n / (r * k)::DOUBLE) - 1, 0) / greatest(least(count(DISTINCT {f}) - 1, count(DISTINCT {g}) - 1), 1)), 6) AS score FROM (SELECT *, sum(n) OVER (PARTITION BY {f}) AS r, sum(n) OVER (PARTITION BY {g}) AS k FROM (SELECT {f}, {g}, count(*) AS n FROM {t} GROUP BY 1, 2))"


@query("screen_categorical", _V.format(f="o_orderpriority", g="o_orderstatus", t="orders"))
def _(s, d):
    return sm.cramers_v(read_table(s, d, "orders").select("o_orderpriority", "o_orderstatus"), "o_orderstatus", "o_orderpriority")


@query("screen_select", "SELECT kind, feature, score FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, feature) AS r FROM (SELECT 'numeric' AS kind, * FROM ({a}) UNION ALL SELECT 'category', * FROM ({b}))) WHERE r <= CASE WHEN kind = 'numeric' THEN 8 ELSE 4 END".format(a=" UNION ALL ".join(f"SELECT '{m}' AS feature, round((sum(k * (g - t) ** 2)) / any_value(v), 6) AS score FROM (SELECT c_mktsegment, count(*) AS k, avg({m}) AS g FROM customer GROUP BY 1), (SELECT avg({m}) AS t, count(*) * var_pop({m}) AS v FROM customer)" for m in ("c_acctbal", "c_nationkey")), b=_V.format(f="c_nationkey", g="c_mktsegment", t="customer")))
def _(s, d):
    cu = read_table(s, d, "customer")
    a = sm.eta_squared(cu.select("c_mktsegment", "c_acctbal", c("c_nationkey").cast("double").alias("c_nationkey")), "c_mktsegment", ["c_acctbal", "c_nationkey"]).withColumn("kind", F.lit("numeric"))
    both = a.unionByName(sm.cramers_v(cu.select("c_nationkey", "c_mktsegment"), "c_mktsegment", "c_nationkey").withColumn("kind", F.lit("category")))
    return sm.top_k(both, ["kind"], [F.desc("score"), c("feature")], 8).where("kind = 'numeric' OR rank <= 4").select("kind", "feature", "score")
