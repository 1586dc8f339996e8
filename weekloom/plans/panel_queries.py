"""Queries of sources, checks, cleaning and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from weekloom.operators import panel as op
from weekloom.operators import quality_checks as dq
from weekloom.plans.binding import panel, query
from weekloom.sources.tables import WEEKLY_SQL, meta, read_table, weekly

c = F.col


@query("src_panel_parquet", "SELECT public_id, date_id, round(sales_card, 6) AS sales_card, customer FROM weekly", tables="w")
def _(s, d):
    return weekly(s, d).select("public_id", "date_id", "sales_card", "customer")


@query("src_dim", "SELECT public_id, dong, sigungu, category, open_date, open_month, area, delivery_link, age FROM meta", tables="m")
def _(s, d):
    return meta(s, d)


@query("dq_required_columns", """SELECT 'lineitem' AS source, count(*) AS n_rows, 0 AS n_missing, 'ok' AS status FROM lineitem UNION ALL SELECT 'orders', count(*), 0, 'ok' FROM orders UNION ALL SELECT 'supplier', count(*), 1, 'missing' FROM supplier""")
def _(s, d):
    wanted = {"lineitem": ["l_suppkey", "l_shipdate"], "orders": ["o_orderkey", "o_custkey"], "supplier": ["s_suppkey", "s_city"]}
    return dq.required_columns({k: read_table(s, d, k) for k in wanted}, wanted)


@query("dq_missingness", """SELECT * FROM (SELECT 'customer' AS column, count(*) FILTER (WHERE customer = 1) AS n_null, round(count(*) FILTER (WHERE customer = 1) / count(*)::DOUBLE, 6) AS rate FROM weekly
 UNION ALL SELECT 'before_noon_sales', count(*) FILTER (WHERE before_noon_sales = 0), round(count(*) FILTER (WHERE before_noon_sales = 0) / count(*)::DOUBLE, 6) FROM weekly)""", tables="w")
def _(s, d):
    # the synthetic weeks have no nulls, so two values stand for them
    w = weekly(s, d).select(F.nullif("customer", F.lit(1)).alias("customer"), F.nullif("before_noon_sales", F.lit(0.0)).alias("before_noon_sales"))
    return dq.missingness(w, ["customer", "before_noon_sales"])


@query("dq_missingness_by_year", "SELECT year(date_id) AS year, count(*) AS n_rows, count(*) FILTER (WHERE customer = 1) AS n_null FROM weekly GROUP BY 1", tables="w")
def _(s, d):
    return dq.missingness_by(weekly(s, d).withColumn("customer", F.nullif("customer", F.lit(1))), F.year("date_id").alias("year"), "customer")


@query("dq_coverage", "SELECT public_id, count(DISTINCT date_id) AS weeks, min(date_id) AS first_date, max(date_id) AS last_date, round(avg(sales_card), 4) AS mean_sales, round(sum(sales_card), 2) AS total_sales FROM weekly GROUP BY 1", tables="w")
def _(s, d):
    return dq.coverage(weekly(s, d)).withColumns({"mean_sales": F.round("mean_sales", 4), "total_sales": F.round("total_sales", 2)})


@query("dq_id_overlap", """SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS n_left, (SELECT count(DISTINCT c_custkey) FROM customer) AS n_right,
 (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)) AS n_both""")
def _(s, d):
    return dq.id_overlap(read_table(s, d, "orders").select(c("o_custkey").alias("id")), read_table(s, d, "customer").select(c("c_custkey").alias("id")))


_shift = "(sales_card - 40000)"


@query("clean_negative", f"SELECT public_id, date_id, round(CASE WHEN {_shift} >= 0 THEN {_shift} END, 4) AS sales_card, round(greatest({_shift}, 0), 4) AS clipped FROM weekly", tables="w", digits=4)
def _(s, d):
    w = weekly(s, d).withColumn("sales_card", c("sales_card") - 40000).withColumn("clipped", c("sales_card"))
    return op.clean_negative(op.clean_negative(w), value="clipped", clip=True).select("public_id", "date_id", "sales_card", "clipped")


@query("dedup_entity_week", "SELECT l_suppkey, wk, l_extendedprice FROM (SELECT l_suppkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS wk, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey, date_trunc('week', l_shipdate) ORDER BY l_shipdate, l_extendedprice) AS r FROM lineitem) WHERE r = 1")
def _(s, d):
    rows = read_table(s, d, "lineitem").select("l_suppkey", F.to_date(F.date_trunc("week", "l_shipdate")).alias("wk"), "l_shipdate", "l_extendedprice")
    return op.dedup_entity_week(rows, entity="l_suppkey", period="wk").drop("l_shipdate")


@query("merge_entity_week", "SELECT l_suppkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS wk, round(avg(l_quantity), 6) AS l_quantity FROM lineitem GROUP BY 1, 2")
def _(s, d):
    rows = read_table(s, d, "lineitem").select("l_suppkey", F.to_date(F.date_trunc("week", "l_shipdate")).alias("wk"), "l_quantity")
    return op.merge_entity_week(rows, entity="l_suppkey", period="wk", value="l_quantity")


@query("filter_min_weeks", "SELECT o_custkey, n AS n_weeks FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) WHERE n >= 12")
def _(s, d):
    return op.filter_min_weeks(read_table(s, d, "orders"), entity="o_custkey", min_weeks=12).select("o_custkey", "n_weeks").distinct()


@query("filter_open_since", "SELECT public_id, count(*) AS n FROM weekly WHERE public_id IN (SELECT public_id FROM meta WHERE open_date >= DATE '1995-01-03') GROUP BY 1 HAVING count(*) >= 52".replace("FROM weekly", "FROM panel"), tables="p")
def _(s, d):
    p = panel(s, d)
    return op.filter_open_since(p.drop("n_weeks"), meta(s, d), since="1995-01-03").groupBy("public_id").agg(F.count("*").alias("n"))


@query("filter_outlier_pct", """SELECT o_custkey, round(m, 6) AS mean, m < lo OR m > hi AS removed FROM (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1),
 (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (SELECT avg(o_totalprice) AS m FROM orders GROUP BY o_custkey))""")
def _(s, d):
    return op.filter_outlier_pct(read_table(s, d, "orders"), entity="o_custkey", value="o_totalprice")


@query("filter_outlier_summary", """SELECT count(*) AS n, count(*) FILTER (WHERE m < lo OR m > hi) AS n_removed FROM (SELECT avg(o_totalprice) AS m FROM orders GROUP BY o_custkey),
 (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (SELECT avg(o_totalprice) AS m FROM orders GROUP BY o_custkey))""")
def _(s, d):
    return op.filter_outlier_pct(read_table(s, d, "orders"), entity="o_custkey", value="o_totalprice").agg(F.count("*").alias("n"), F.count_if("removed").alias("n_removed"))


@query("filter_outlier_iqr", """SELECT p_partkey, p_size, p_retailprice FROM (SELECT *, quantile_cont(p_retailprice, 0.25) OVER () AS a, quantile_cont(p_retailprice, 0.75) OVER () AS b FROM
 (SELECT * FROM (SELECT *, quantile_cont(p_size, 0.25) OVER () AS a0, quantile_cont(p_size, 0.75) OVER () AS b0 FROM part) WHERE p_size BETWEEN a0 - 0.21 * (b0 - a0) AND b0 + 0.21 * (b0 - a0))) WHERE p_retailprice BETWEEN a - 0.21 * (b - a) AND b + 0.21 * (b - a)""")
def _(s, d):
    return op.filter_outlier_iqr(read_table(s, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], k=0.21)


@query("winsorize", "SELECT s_suppkey, round(least(greatest(s_acctbal, quantile_cont(s_acctbal, 0.05) OVER ()), quantile_cont(s_acctbal, 0.95) OVER ()), 6) AS s_acctbal FROM supplier")
def _(s, d):
    return op.winsorize(read_table(s, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", low=0.05, high=0.95)


@query("winsorize_entity", "SELECT public_id, date_id, round(least(greatest(sales_card, quantile_cont(sales_card, 0.01) OVER (PARTITION BY public_id)), quantile_cont(sales_card, 0.99) OVER (PARTITION BY public_id)), 4) AS sales_card FROM weekly", tables="w", digits=4)
def _(s, d):
    return op.winsorize(weekly(s, d), "sales_card", entity="public_id").select("public_id", "date_id", "sales_card")


@query("filter_low_variance", "SELECT 'before_noon_sales' AS column, round(var_pop(before_noon_sales), 6) AS variance, coalesce(var_pop(before_noon_sales) <= 0.01, true) AS dropped FROM weekly UNION ALL SELECT 'customer', round(var_pop(customer), 6), coalesce(var_pop(customer) <= 0.01, true) FROM weekly UNION ALL SELECT 'one', 0.0, true", tables="w")
def _(s, d):
    return op.low_variance_columns(weekly(s, d).withColumn("one", F.lit(1.0)), ["before_noon_sales", "customer", "one"])


@query("standardize_cols", """SELECT s_suppkey, round(CASE WHEN coalesce(stddev_samp(v) OVER (), 0) <= 1e-12 THEN 0 ELSE (v - avg(v) OVER ()) / stddev_samp(v) OVER () END, 6) AS s_acctbal FROM
 (SELECT s_suppkey, least(greatest(a, quantile_cont(a, 0.01) OVER ()), quantile_cont(a, 0.99) OVER ()) AS v FROM (SELECT s_suppkey, coalesce(b, quantile_cont(b, 0.5) OVER ()) AS a FROM (SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS b FROM supplier)))""")
def _(s, d):
    return op.standardize_cols(op.clean_negative(read_table(s, d, "supplier").select("s_suppkey", "s_acctbal"), value="s_acctbal"), ["s_acctbal"])


@query("impute_const_median", """SELECT c_custkey, round(coalesce(b, quantile_cont(b, 0.5) OVER (PARTITION BY c_mktsegment), quantile_cont(b, 0.5) OVER ()), 6) AS c_acctbal FROM (SELECT *, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS b FROM customer)""")
def _(s, d):
    rows = op.clean_negative(read_table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), value="c_acctbal")
    return op.impute_const_median(rows, "c_acctbal", group="c_mktsegment").select("c_custkey", "c_acctbal")


_GAPS = """g AS (SELECT public_id, date_id, CASE WHEN customer % 2 = 0 THEN sales_card END AS v, row_number() OVER (PARTITION BY public_id ORDER BY date_id) AS p FROM weekly),
h AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS v0, first_value(v IGNORE NULLS) OVER b AS v1, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER a AS p0, first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER b AS p1 FROM g
 WINDOW a AS (PARTITION BY public_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY public_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("interp_linear", f"WITH {_GAPS} SELECT public_id, date_id, round(coalesce(v, v0 + (v1 - v0) * (p - p0) / nullif(p1 - p0, 0), v0, v1), 6) AS sales_card FROM h", tables="w")
def _(s, d):
    w = weekly(s, d).select("public_id", "date_id", F.when(c("customer") % 2 == 0, c("sales_card")).alias("sales_card"))
    return op.interp_linear(w, order="date_id")


_GRID = """g AS (SELECT e.public_id, t.date_id, w.sales_card AS v, row_number() OVER (PARTITION BY e.public_id ORDER BY t.date_id) AS p FROM (SELECT DISTINCT public_id FROM weekly) e CROSS JOIN (SELECT DISTINCT date_id FROM weekly) t LEFT JOIN weekly w ON w.public_id = e.public_id AND w.date_id = t.date_id),""" + _GAPS[_GAPS.index("\nh AS") :]


@query("align_grid", f"WITH {_GRID} SELECT public_id, date_id, round(coalesce(v, v0 + (v1 - v0) * (p - p0) / nullif(p1 - p0, 0), v0, v1), 6) AS sales_card FROM h", tables="w")
def _(s, d):
    return op.align_grid(weekly(s, d))


@query("global_week_index", "SELECT public_id, date_id, CAST(floor((date_id - (SELECT min(date_id) FROM weekly)) / 7.0) + 1 AS BIGINT) AS week_no FROM weekly", tables="w")
def _(s, d):
    return op.global_week_index(weekly(s, d)).select("public_id", "date_id", "week_no")


@query("entity_week_index", "SELECT public_id, date_id, week_idx FROM panel", tables="p")
def _(s, d):
    return panel(s, d).select("public_id", "date_id", c("week_idx").cast("long").alias("week_idx"))


@query("weeks_since_open", "SELECT public_id, date_id, CAST(greatest(floor((date_id - open_date) / 7.0), 0) AS BIGINT) AS weeks_open FROM panel", tables="p")
def _(s, d):
    return op.weeks_since_open(weekly(s, d).join(panel(s, d).select("public_id", "date_id"), ["public_id", "date_id"], "left_semi"), meta(s, d)).select("public_id", "date_id", c("weeks_open").cast("long").alias("weeks_open"))


@query("sales_total", "SELECT public_id, date_id, round(coalesce(sales_invoice, 0) + coalesce(sales_delivery, 0), 4) AS sales_total, round(coalesce(purchase_card, 0), 4) AS purchase_total FROM weekly", tables="w", digits=4)
def _(s, d):
    w = op.sales_total(weekly(s, d), ["sales_invoice", "sales_delivery"])
    return op.sales_total(w, ["purchase_card"], name="purchase_total").select("public_id", "date_id", "sales_total", "purchase_total")


@query("minmax_entity", "SELECT public_id, date_id, round(sales_card_mm, 6) AS sales_card_mm, round(trend_mm, 6) AS trend_mm FROM panel", tables="p")
def _(s, d):
    return panel(s, d).select("public_id", "date_id", "sales_card_mm", "trend_mm")


@query("zscore_entity", "SELECT public_id, date_id, round((sales_card - avg(sales_card) OVER e) / (CASE WHEN stddev_pop(sales_card) OVER e < 1e-6 THEN 1 ELSE stddev_pop(sales_card) OVER e END), 6) AS z FROM weekly WINDOW e AS (PARTITION BY public_id)", tables="w")
def _(s, d):
    return op.zscore_entity(weekly(s, d)).select("public_id", "date_id", "z")


@query("mean_norm_entity", "SELECT public_id, date_id, round(sales_card / avg(sales_card) OVER (PARTITION BY public_id), 6) AS norm FROM weekly", tables="w")
def _(s, d):
    return op.mean_norm_entity(weekly(s, d)).select("public_id", "date_id", "norm")


@query("market_share_week", "SELECT public_id, date_id, round(sales_card / nullif(sum(sales_card) OVER (PARTITION BY date_id), 0), 6) AS share FROM weekly", tables="w")
def _(s, d):
    return op.market_share_week(weekly(s, d)).select("public_id", "date_id", "share")


@query("new_customer_ratio", "SELECT public_id, date_id, round(customer_new / nullif(customer, 0)::DOUBLE, 6) AS nc_ratio FROM weekly", tables="w")
def _(s, d):
    return op.new_customer_ratio(weekly(s, d)).select("public_id", "date_id", "nc_ratio")


@query("classify_industry", "SELECT p_partkey, CASE WHEN contains(p_type, 'ECONOMY') THEN 'budget' WHEN contains(p_type, 'PROMO') THEN 'promotion' WHEN contains(p_type, 'STANDARD') THEN 'standard' WHEN contains(p_type, 'MEDIUM') THEN 'medium' WHEN contains(p_type, 'LARGE') THEN 'large' WHEN contains(p_type, 'SMALL') THEN 'small' ELSE 'other' END AS industry FROM part")
def _(s, d):
    return op.classify_industry(read_table(s, d, "part"), "p_type").select("p_partkey", "industry")


@query("owner_age_parse", "SELECT public_id, CAST(regexp_extract(age, '^([0-9]+)', 1) AS INTEGER) AS age_number, CAST(CAST(regexp_extract(age, '^([0-9]+)', 1) AS INTEGER) // 10 AS BIGINT) AS age_order, 2002 - CAST(substr(open_month, 1, 4) AS INTEGER) AS age_years FROM meta", tables="m")
def _(s, d):
    return op.owner_age_parse(meta(s, d)).select("public_id", "age_number", c("age_order").cast("long").alias("age_order"), "age_years")


@query("onehot_dummies", "SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS c_mktsegment_BUILDING, CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS c_mktsegment_MACHINERY FROM customer")
def _(s, d):
    return op.onehot(read_table(s, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", "c_mktsegment_BUILDING", "c_mktsegment_MACHINERY")


@query("derived_ratios", "SELECT public_id, date_id, round(sales_card / nullif(customer, 0), 4) AS per_customer, round(sales_card / nullif(area, 0), 4) AS per_area FROM panel", tables="p", digits=4)
def _(s, d):
    return panel(s, d).select("public_id", "date_id", F.try_divide("sales_card", "customer").alias("per_customer"), F.try_divide("sales_card", "area").alias("per_area"))


@query("trend_decompose", "SELECT public_id, week_idx, round(trend, 4) AS trend, round(resid, 4) AS resid FROM panel", tables="p", digits=4)
def _(s, d):
    return panel(s, d).select("public_id", c("week_idx").cast("long").alias("week_idx"), "trend", "resid")


@query("join_enrich", "SELECT w.public_id, date_id, round(sales_card, 4) AS sales_card, dong, category FROM weekly w LEFT JOIN meta USING (public_id)".replace("FROM weekly w", "FROM p0 w"), tables="p", digits=4)
def _(s, d):
    return weekly(s, d).join(meta(s, d), "public_id", "left").select("public_id", "date_id", "sales_card", "dong", "category")


@query("join_unified", "SELECT m.public_id, m.category, s.weeks, f.n_used, f.n_used IS NOT NULL AS in_panel FROM meta m LEFT JOIN (SELECT public_id, count(*) AS weeks FROM weekly GROUP BY 1) s USING (public_id) LEFT JOIN (SELECT public_id, count(*) AS n_used FROM panel GROUP BY 1) f USING (public_id)", tables="p")
def _(s, d):
    m, w = meta(s, d), weekly(s, d).groupBy("public_id").agg(F.count("*").alias("weeks"))
    f = panel(s, d).groupBy("public_id").agg(F.count("*").alias("n_used"))
    return m.join(w, "public_id", "left").join(f, "public_id", "left").select("public_id", "category", "weeks", "n_used", c("n_used").isNotNull().alias("in_panel"))


@query("join_semi_ids", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(s, d):
    return read_table(s, d, "orders").join(read_table(s, d, "customer").where("c_mktsegment = 'BUILDING'"), c("o_custkey") == c("c_custkey"), "left_semi").select("o_orderkey")


@query("join_inner_labels", "SELECT d.doc_id, n_chars, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def _(s, d):
    return read_table(s, d, "documents").select("doc_id", "n_chars").join(read_table(s, d, "labels"), "doc_id")


@query("anti_not_in_panel", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(s, d):
    return read_table(s, d, "documents").select("doc_id", "lang").join(read_table(s, d, "labels"), "doc_id", "left_anti")


@query("robust_master", "SELECT 'a' AS run, o_orderstatus AS level, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'b', o_orderpriority, count(*) FROM orders GROUP BY 2")
def _(s, d):
    o = read_table(s, d, "orders")
    parts = [o.groupBy(c("o_orderstatus").alias("level")).agg(F.count("*").alias("n")).withColumn("run", F.lit("a")), o.groupBy(c("o_orderpriority").alias("level")).agg(F.count("*").alias("n"), F.max("o_custkey").alias("extra")).withColumn("run", F.lit("b"))]
    common = [x for x in parts[0].columns if all(x in p.columns for p in parts)]
    return reduce(lambda a, b: a.unionByName(b), (p.select(common) for p in parts)).select("run", "level", "n")
