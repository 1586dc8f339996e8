"""Queries of events, matching, panel regressions and survival."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.operators import causal as op
from weekloom.operators import survival
from weekloom.operators.panel import build_panel, standardize_cols
from weekloom.operators.regression import controlled_profile, factor_regression, logit_groups
from weekloom.plans.binding import panel, query, slope_sql
from weekloom.plans.district_queries import _FE
from weekloom.plans.label_queries import _CU, customers
from weekloom.sources.tables import discard, meta, read_table, weekly, written

c = F.col
_GC = """g0 AS (SELECT public_id, week_idx, sales_card, sales_card_mm, customer, customer_new, coalesce(customer_new / nullif(customer, 0)::DOUBLE, 0) AS nc, row_number() OVER (PARTITION BY public_id ORDER BY week_idx) - 1 AS pos FROM panel),
g1 AS (SELECT *, CASE WHEN count(nc) OVER o >= 2 THEN avg(nc) OVER o END AS roll FROM g0 WINDOW o AS (PARTITION BY public_id ORDER BY week_idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
g2 AS (SELECT public_id, avg(nc) FILTER (WHERE pos < 8) + 1e-6 AS pre FROM g1 GROUP BY 1), g3 AS (SELECT public_id, roll, week_idx FROM (SELECT *, row_number() OVER (PARTITION BY public_id ORDER BY round(roll, 12) DESC, pos) AS rn FROM g1 WHERE pos >= 10) WHERE rn = 1),
gc AS (SELECT public_id, pre AS pre_nc_avg, roll AS peak_nc_avg, week_idx AS gc_week, (roll - pre) / pre AS gc_delta FROM g2 JOIN g3 USING (public_id)), gcf AS (SELECT *, gc_delta >= (SELECT quantile_cont(gc_delta, 0.7) FROM gc) AS has_gc FROM gc)"""


@query("gc_detect", f"WITH {_GC} SELECT public_id, round(pre_nc_avg, 6) AS pre_nc_avg, round(peak_nc_avg, 6) AS peak_nc_avg, gc_week, round(gc_delta, 4) AS gc_delta, has_gc FROM gcf", tables="p")
def _(s, d):
    return op.detect_rise(panel(s, d)).select("public_id", "pre_nc_avg", "peak_nc_avg", c("gc_week").cast("long").alias("gc_week"), F.round("gc_delta", 4).alias("gc_delta"), "has_gc")


_EW = f"{_GC}, ew AS (SELECT p.public_id, p.week_idx - gc_week AS event_time, p.sales_card, p.sales_card_mm, p.customer, p.customer_new, has_gc FROM panel p JOIN gcf USING (public_id) WHERE p.week_idx - gc_week >= -8 AND p.week_idx - gc_week < 8)"


@query("range_event_window", f"WITH {_EW} SELECT public_id, event_time, round(sales_card_mm, 6) AS sales_card_mm FROM ew", tables="p")
def _(s, d):
    p = panel(s, d)
    return op.event_window(p, op.detect_rise(p).select("public_id", "gc_week")).select("public_id", c("event_time").cast("long").alias("event_time"), "sales_card_mm")


@query("psm_pre_features", f"WITH {_EW} SELECT public_id, count(sales_card) AS n, round(avg(ln(1 + sales_card)), 6) AS pre_mean, round(stddev_pop(ln(1 + sales_card)), 6) AS pre_std, round({slope_sql('ln(1 + sales_card)', 'event_time')}, 6) AS pre_slope FROM ew WHERE event_time < 0 GROUP BY 1 HAVING count(sales_card) >= 3", tables="p")
def _(s, d):
    p = panel(s, d)
    return op.pre_features(op.event_window(p, op.detect_rise(p).select("public_id", "gc_week")))


_NM = "a AS (SELECT c_custkey AS id, c_acctbal AS s, c_nationkey AS st FROM customer WHERE c_custkey % 5 = 0), b AS (SELECT c_custkey AS id, c_acctbal AS s, c_nationkey AS st FROM customer WHERE c_custkey % 5 > 0)"


@query("nearest_match", f"WITH {_NM} SELECT treated, control, round(distance, 6) AS distance FROM (SELECT a.id AS treated, b.id AS control, abs(a.s - b.s) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY round(abs(a.s - b.s), 6), b.s, b.id) AS r FROM a, b) WHERE r = 1")
def _(s, d):
    cu = read_table(s, d, "customer")
    return op.nearest_match(cu.where("c_custkey % 5 = 0"), cu.where("c_custkey % 5 > 0"), key="c_custkey", score="c_acctbal")


@query("nearest_match_strata", f"WITH {_NM} SELECT treated, control, round(distance, 6) AS distance FROM (SELECT a.id AS treated, b.id AS control, abs(a.s - b.s) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY round(abs(a.s - b.s), 6), b.s, b.id) AS r FROM a JOIN b USING (st)) WHERE r = 1 AND distance < 100")
def _(s, d):
    cu = read_table(s, d, "customer")
    return op.nearest_match(cu.where("c_custkey % 5 = 0"), cu.where("c_custkey % 5 > 0"), key="c_custkey", score="c_acctbal", stratum="c_nationkey", caliper=100.0)


_DD = f"{_GC}, u AS (SELECT public_id, CAST(has_gc AS INTEGER) AS treated, {{week}} AS week{{extra}} FROM gcf{{from_}}), dl AS (SELECT p.public_id, treated{{key}}, avg(sales_card_mm) FILTER (WHERE p.week_idx >= week) - avg(sales_card_mm) FILTER (WHERE p.week_idx < week) AS delta FROM panel p JOIN u ON u.public_id = p.public_id AND p.week_idx >= week - 8 AND p.week_idx < week + 8 GROUP BY 1, 2, week{{key}} HAVING count(*) FILTER (WHERE p.week_idx < week) >= 3 AND count(*) FILTER (WHERE p.week_idx >= week) >= 3)"
_ATT = "count(delta) FILTER (WHERE treated = 1) AS n_treated, count(delta) FILTER (WHERE treated = 0) AS n_control, round(avg(delta) FILTER (WHERE treated = 1) - avg(delta) FILTER (WHERE treated = 0), 6) AS att, round((avg(delta) FILTER (WHERE treated = 1) - avg(delta) FILTER (WHERE treated = 0)) / sqrt(var_samp(delta) FILTER (WHERE treated = 1) / count(*) FILTER (WHERE treated = 1) + var_samp(delta) FILTER (WHERE treated = 0) / count(*) FILTER (WHERE treated = 0)), 6) AS t"


def units(p):
    return op.detect_rise(p).select("public_id", c("has_gc").cast("int").alias("treated"), c("gc_week").alias("week"))


@query("did_att", "WITH " + _DD.format(week="gc_week", extra="", from_="", key="") + f" SELECT {_ATT} FROM dl", tables="p")
def _(s, d):
    p = panel(s, d)
    return op.did_att(op.did_deltas(p, units(p)))


@query("did_placebo", "WITH " + _DD.format(week="12 + ((CAST(public_id AS BIGINT) + 1) * 2654435761 + round * 40503) % 28", extra=", round", from_=", (SELECT unnest(range(1, 21)) AS round)", key=", round") + f" SELECT CAST(round AS INTEGER) AS round, {_ATT} FROM dl GROUP BY 1", tables="p")
def _(s, d):
    p = panel(s, d)
    return op.did_placebo(p, units(p))


_PLACEBO = "WITH " + _DD.format(week="12 + ((CAST(public_id AS BIGINT) + 1) * 2654435761 + round * 40503) % 28", extra=", round", from_=", (SELECT unnest(range(1, 21)) AS round)", key=", round") + f", pr AS (SELECT round, {_ATT} FROM dl GROUP BY 1)"
_REAL = "WITH " + _DD.format(week="gc_week", extra="", from_="", key="") + f" SELECT {_ATT} FROM dl"


@query("did_placebo_summary", f"SELECT p.rounds, round(p.m, 5) AS placebo_mean, round(p.sd, 5) AS placebo_std, round(r.att, 5) AS att, round((r.att - p.m) / p.sd, 3) AS z FROM (SELECT count(att) AS rounds, avg(att) AS m, stddev_samp(att) AS sd FROM ({_PLACEBO} SELECT * FROM pr)) p, ({_REAL}) r", tables="p", digits=5)
def _(s, d):
    p = panel(s, d)
    return op.placebo_summary(op.did_placebo(p, units(p)), op.did_att(op.did_deltas(p, units(p)))).withColumn("z", F.round("z", 3))


_PR = f"{_EW}, pr AS (SELECT event_time, CAST(has_gc AS INTEGER) AS grp, avg(sales_card_mm) AS mean, stddev_samp(sales_card_mm) / sqrt(count(*)) AS sem, count(*) AS n, avg(customer_new / nullif(customer, 0)::DOUBLE) AS nc FROM ew GROUP BY 1, 2)"


def profile(s, d):
    p = panel(s, d)
    return op.event_profile(op.event_window(p, op.detect_rise(p).select("public_id", "gc_week", c("has_gc").cast("int").alias("grp"))), group="grp")


@query("es_profile", f"WITH {_PR} SELECT event_time, grp, round(mean, 6) AS mean, round(sem, 6) AS sem, n, round(nc, 6) AS nc FROM pr", tables="p")
def _(s, d):
    return profile(s, d).withColumn("event_time", c("event_time").cast("long"))


@query("es_difference", f"WITH {_PR}, df AS (SELECT event_time, max(mean) FILTER (WHERE grp = 1) - max(mean) FILTER (WHERE grp = 0) AS d FROM pr GROUP BY 1) SELECT round(avg(d) FILTER (WHERE event_time >= 0) - avg(d) FILTER (WHERE event_time < 0), 6) AS did, round(avg(d) FILTER (WHERE event_time < 0) / (stddev_samp(d) FILTER (WHERE event_time < 0) / sqrt(count(d) FILTER (WHERE event_time < 0))), 6) AS pre_t FROM df", tables="p")
def _(s, d):
    return op.profile_difference(profile(s, d), group="grp")


def linked_events(s, d):
    """Weeks around each entity's strongest rise, in two groups: with and without a delivery link.

    The panel is written once for the rise, its cut and the window, and goes; the
    window, 16 weeks of an entity at most, stays for the fit and its profile.
    """
    p = written(build_panel(weekly(s, d)).select("public_id", "week_idx", "sales_card_mm", "customer", "customer_new"), "panel")
    events = op.detect_rise(p).select("public_id", "gc_week").join(meta(s, d).select("public_id", "sigungu", "category"), "public_id", "left")
    rows = op.event_window(p, events).select("event_time", (c("public_id").cast("long") % 2).alias("grp"), "sales_card_mm", "sigungu", "category")
    rows = written(rows, "events")
    discard(p)
    return rows


@query("es_controlled")
def _(s, d):
    return controlled_profile(linked_events(s, d), "sales_card_mm", group="grp", controls=["sigungu", "category"])[0]


@query("es_controlled_profile")
def _(s, d):
    return controlled_profile(linked_events(s, d), "sales_card_mm", group="grp", controls=["sigungu", "category"])[1]


_CELL = "cm AS (SELECT event_time, CAST(public_id AS BIGINT) % 2 AS grp, avg(sales_card_mm) AS m FROM ew WHERE sales_card_mm IS NOT NULL GROUP BY 1, 2)"


@query("es_interactions", f"WITH {_EW}, {_CELL} SELECT CAST(a.event_time AS BIGINT) AS event_time, round(a.m - b.m - (SELECT m FROM cm WHERE event_time = -8 AND grp = 1) + (SELECT m FROM cm WHERE event_time = -8 AND grp = 0), 5) AS coefficient FROM cm a JOIN cm b USING (event_time) WHERE a.grp = 1 AND b.grp = 0 AND event_time > -8", tables="p", digits=5)
def _(s, d):
    """Without controls the products are differences of the groups' differences from the first event time."""
    rows = factor_regression(linked_events(s, d), "sales_card_mm", [("event_time",), ("grp",), ("event_time", "grp")], reference={"event_time": -8, "grp": 0}).coefficients
    return rows.where("term = 'event_time:grp'").select(F.split_part("level", F.lit(":"), F.lit(1)).cast("long").alias("event_time"), "coefficient")


_LAG = "q AS (SELECT public_id, week_idx, ln(1 + sales_card) AS y, lag(customer_new / nullif(customer, 0)::DOUBLE) OVER (PARTITION BY public_id ORDER BY week_idx) AS nc1 FROM panel), q2 AS (SELECT * FROM q WHERE nc1 IS NOT NULL)"


def lagged(s, d):
    from pyspark.sql import Window

    nc = F.try_divide(c("customer_new").cast("double"), c("customer"))
    w = Window.partitionBy("public_id").orderBy("week_idx")
    p = panel(s, d).withColumn("nc", nc)
    return p.select("public_id", "week_idx", F.log1p("sales_card").alias("y"), F.lag("nc", 1).over(w).alias("nc1"), F.lag("nc", 2).over(w).alias("nc2"), F.lag("nc", 4).over(w).alias("nc4"), F.lag(F.log1p("sales_card"), 1).over(w).alias("y1"))


@query("fe_twoway", f"WITH {_LAG}, " + _FE.format(e="public_id", t="week_idx", y="y", x="nc1", src="q2").replace(" AS x FROM m", " AS nc1 FROM m"), tables="p")
def _(s, d):
    return op.fe_twoway(lagged(s, d), "y", ["nc1"])


@query("fe_twoway_exact")
def _(s, d):
    return op.fe_twoway(lagged(s, d), "y", ["nc1", "nc2"], exact=True)


@query("fe_cluster_se")
def _(s, d):
    return op.fe_cluster_se(lagged(s, d).dropna(), "y", ["nc1", "nc2", "nc4", "y1"])


@query("granger_entity")
def _(s, d):
    return op.granger_entities(panel(s, d))


@query("granger_share")
def _(s, d):
    return op.granger_shares(op.granger_entities(panel(s, d)))


_KM = f"{_CU}, sv AS (SELECT c_mktsegment AS grp, survival_weeks AS t, CAST(weeks_to_end >= 26 AS INTEGER) AS e FROM k JOIN customer ON o_custkey = c_custkey WHERE survival_weeks > 0)"


def spells(s, d):
    from weekloom.operators.labels import label_closure

    return label_closure(customers(s, d), cutoffs=(26,)).join(read_table(s, d, "customer"), c("o_custkey") == c("c_custkey")).select(c("c_mktsegment").alias("grp"), c("survival_weeks").cast("long").alias("t"), c("is_closed").alias("e"), "c_acctbal", "c_nationkey")


@query("surv_km", f"WITH {_KM}, st AS (SELECT grp, t, count(*) AS m, sum(e) AS d FROM sv GROUP BY 1, 2), r AS (SELECT *, sum(m) OVER (PARTITION BY grp ORDER BY t DESC) AS n FROM st) SELECT grp, t, CAST(n AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, round(CASE WHEN max(CAST(d = n AS INTEGER)) OVER o = 1 THEN 0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n::DOUBLE) ELSE 0 END) OVER o) END, 6) AS survival FROM r WINDOW o AS (PARTITION BY grp ORDER BY t)")
def _(s, d):
    return op.kaplan_meier(spells(s, d), group="grp", time="t", event="e")


@query("surv_logrank")
def _(s, d):
    return op.log_rank(spells(s, d), group="grp", time="t", event="e")


def scaled_spells(s, d):
    x = spells(s, d).withColumn("c_nationkey", c("c_nationkey").cast("double"))
    return standardize_cols(x, ["c_acctbal", "c_nationkey"])


@query("surv_cox")
def _(s, d):
    return survival.cox(scaled_spells(s, d), ["c_acctbal", "c_nationkey"], time="t", event="e")


@query("surv_cox_groups")
def _(s, d):
    return survival.cox(scaled_spells(s, d), ["c_acctbal", "c_nationkey"], time="t", event="e", by="grp")


_PAIRS = "SELECT {key}count(*)::DOUBLE AS pairs, sum(CAST(a.x > b.x AS INTEGER))::DOUBLE AS concordant, sum(CAST(a.x = b.x AS INTEGER))::DOUBLE AS tied, round((sum(CAST(a.x > b.x AS INTEGER)) + sum(CAST(a.x = b.x AS INTEGER)) / 2.0) / count(*), 6) AS concordance FROM s2 a JOIN s2 b ON a.e = 1 AND (a.t < b.t OR a.t = b.t AND b.e = 0){on}"


@query("surv_concordance", f"WITH {_KM.replace('survival_weeks AS t', 'survival_weeks AS t, c_acctbal AS x')}, s2 AS (SELECT * FROM sv) {_PAIRS.format(key='', on='')}")
def _(s, d):
    return survival.concordance(spells(s, d).where("t > 0"), time="t", event="e", score="c_acctbal")


@query("surv_concordance_groups", f"WITH {_KM.replace('survival_weeks AS t', 'survival_weeks AS t, CAST(c_nationkey AS DOUBLE) AS x')}, s2 AS (SELECT * FROM sv) {_PAIRS.format(key='a.grp, ', on=' AND a.grp = b.grp')} GROUP BY a.grp")
def _(s, d):
    """Scores with many ties."""
    return survival.concordance(spells(s, d).where("t > 0"), time="t", event="e", score="c_nationkey", by="grp")


@query("surv_ph_check")
def _(s, d):
    return survival.ph_check(scaled_spells(s, d).where("t < 500"), ["c_acctbal", "c_nationkey"], time="t", event="e")


@query("model_ols", "WITH z AS (SELECT o_totalprice / 1000 AS y, CAST(month(o_orderdate) AS DOUBLE) AS x FROM orders) SELECT 'intercept' AS term, round(regr_intercept(y, x), 4) AS coefficient, round(regr_r2(y, x), 4) AS r2, count(*) AS n FROM z UNION ALL SELECT 'x', round(regr_slope(y, x), 4), round(regr_r2(y, x), 4), count(*) FROM z", digits=4)
def _(s, d):
    return op.ols(read_table(s, d, "orders").select((c("o_totalprice") / 1000).alias("y"), F.month("o_orderdate").cast("double").alias("x")), "y", ["x"])


@query("logit_cohort")
def _(s, d):
    rows = read_table(s, d, "documents").select("doc_id", "lang", (c("n_chars") / 1000).alias("x")).join(read_table(s, d, "labels").select("doc_id", "toxic"), "doc_id")
    return logit_groups(rows, "lang", "toxic", ["x"])


@query("coef_signs", "WITH z AS (SELECT year(o_orderdate) AS spec, c_mktsegment, corr(o_totalprice, c_acctbal) AS r FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT c_mktsegment, count(*) AS n, round(greatest(count(*) FILTER (WHERE r > 0), count(*) FILTER (WHERE r < 0)) / count(*)::DOUBLE, 6) AS sign_agreement, round(avg(CAST(abs(r) < 0.05 AS INTEGER)), 6) AS significant FROM z GROUP BY 1")
def _(s, d):
    rows = read_table(s, d, "orders").join(read_table(s, d, "customer"), c("o_custkey") == c("c_custkey"))
    z = rows.groupBy(F.year("o_orderdate").alias("spec"), "c_mktsegment").agg(F.corr("o_totalprice", "c_acctbal").alias("r")).withColumn("p", F.abs("r"))
    return op.coefficient_signs(z, predictor="c_mktsegment", coefficient="r", p="p")
