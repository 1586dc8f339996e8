"""Queries of competition, district vitality, external facts, calendar windows, edges and unit-year panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.operators import causal, district as op, networks as nw, windows as wn
from weekloom.operators.summaries import shares_in_group
from weekloom.plans.binding import panel, query, slope_sql
from weekloom.plans.label_queries import SL, labelled
from weekloom.sources.tables import read_table, weekly

c = F.col


def customers(s, d):
    n, r = read_table(s, d, "nation"), read_table(s, d, "region")
    places = n.join(F.broadcast(r), c("n_regionkey") == c("r_regionkey")).select("n_nationkey", c("n_name").alias("dong"), c("r_name").alias("sigungu"))
    return read_table(s, d, "customer").join(F.broadcast(places), c("c_nationkey") == c("n_nationkey")).select("c_custkey", "c_mktsegment", "c_acctbal", "dong", "sigungu")


_CU = "cu AS (SELECT c_custkey, c_mktsegment, c_acctbal, n_name AS dong, r_name AS sigungu FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query("comp_index", f"WITH {_CU}, x AS (SELECT *, count(*) OVER (PARTITION BY dong, c_mktsegment) AS n_same, count(*) OVER (PARTITION BY dong) AS n_total FROM cu) SELECT c_custkey, n_same, CAST(n_total AS BIGINT) AS n_total, round(n_same / n_total::DOUBLE, 6) AS comp_share, round(ln(1 + n_same / n_total::DOUBLE), 6) AS log_comp FROM x")
def _(s, d):
    return op.competition_index(customers(s, d), "dong", "c_mktsegment").select("c_custkey", "n_same", "n_total", "comp_share", "log_comp")


@query("comp_hhi", f"WITH {_CU}, x AS (SELECT dong, c_mktsegment, count(*) AS n FROM cu GROUP BY 1, 2) SELECT dong, CAST(sum(n) AS BIGINT) AS n_total, count(*) AS n_categories, round(sum(n * n) / (sum(n) * sum(n))::DOUBLE, 6) AS hhi FROM x GROUP BY 1")
def _(s, d):
    return op.hhi(customers(s, d), "dong", "c_mktsegment")


@query("comp_summary", f"WITH {_CU}, x AS (SELECT *, count(*) OVER (PARTITION BY dong, c_mktsegment) / (count(*) OVER (PARTITION BY dong))::DOUBLE AS share FROM cu) SELECT dong, count(*) AS n_total, count(DISTINCT c_mktsegment) AS n_categories, round(avg(share), 6) AS mean_competition FROM x GROUP BY 1")
def _(s, d):
    return op.competition_index(customers(s, d), "dong", "c_mktsegment").groupBy("dong").agg(F.count("*").alias("n_total"), F.count_distinct("c_mktsegment").alias("n_categories"), F.avg("comp_share").alias("mean_competition"))


@query("comp_category_shares", f"WITH {_CU} SELECT dong, round(avg(CAST(c_mktsegment = 'BUILDING' AS INTEGER)), 6) AS share_BUILDING, round(avg(CAST(c_mktsegment = 'MACHINERY' AS INTEGER)), 6) AS share_MACHINERY FROM cu GROUP BY 1")
def _(s, d):
    return op.category_shares(customers(s, d), "dong", "c_mktsegment", ["BUILDING", "MACHINERY"])


@query("comp_two_level", f"WITH {_CU} SELECT c_custkey, count(*) OVER (PARTITION BY dong) AS n_near, count(*) OVER (PARTITION BY dong, c_mktsegment) AS same_near, count(*) OVER (PARTITION BY sigungu) AS n_far, count(*) OVER (PARTITION BY sigungu, c_mktsegment) AS same_far FROM cu")
def _(s, d):
    return op.competition_two_level(customers(s, d), "dong", "sigungu", "c_mktsegment").select("c_custkey", "n_near", "same_near", "n_far", "same_far")


@query("comp_interactions", f"WITH {_CU}, x AS (SELECT *, count(*) OVER (PARTITION BY dong, c_mktsegment) / (count(*) OVER (PARTITION BY dong))::DOUBLE AS share FROM cu) SELECT c_custkey, round(CASE WHEN c_mktsegment = 'BUILDING' THEN share ELSE 0 END, 6) AS building_x_share FROM x")
def _(s, d):
    x = op.competition_index(customers(s, d), "dong", "c_mktsegment")
    return x.select("c_custkey", ((c("c_mktsegment") == "BUILDING").cast("int") * c("comp_share")).alias("building_x_share"))


@query("geo_stats", f"WITH {_CU}, f AS (SELECT sigungu, count(*) AS n_far, avg(c_acctbal) AS mean_far FROM cu GROUP BY 1) SELECT cu.sigungu, dong, count(*) AS n_near, round(avg(c_acctbal), 6) AS mean_near, any_value(n_far) AS n_far, round(any_value(mean_far), 6) AS mean_far, round(count(*) / any_value(n_far)::DOUBLE, 6) AS density FROM cu JOIN f ON cu.sigungu = f.sigungu GROUP BY 1, 2")
def _(s, d):
    return op.geo_stats(customers(s, d), "dong", "sigungu", "c_acctbal")


_LV = "count(*) AS n, count(*) FILTER (WHERE outcome_3 = 'Growth') AS growth, count(*) FILTER (WHERE outcome_3 = 'Decline') AS decline"
_V = f"WITH {SL}, v AS (SELECT {{place}}, {_LV}, avg(a) AS v3, median(a) AS v4 FROM lab GROUP BY 1) SELECT {{place}}, n, growth, decline, round((growth - decline) / n::DOUBLE, 6) AS v1, round(ln((growth + 0.5) / (decline + 0.5)), 6) AS v2, round(v3, 6) AS v3, round(v4, 6) AS v4, round((growth - decline) / (n + 20)::DOUBLE, 6) AS v5 FROM v"


@query("lev_candidates", _V.format(place="dong"), tables="p")
def _(s, d):
    return op.vitality(labelled(s, d), "dong", trend="slope_all_mm")


@query("lev_district", _V.format(place="sigungu"), tables="p")
def _(s, d):
    return op.vitality(labelled(s, d), "sigungu", trend="slope_all_mm")


@query("corr_formula_pairs", f"WITH {SL}, v AS (SELECT dong, {_LV}, avg(a) AS v3 FROM lab GROUP BY 1), z AS (SELECT (growth - decline) / n::DOUBLE AS v1, ln((growth + 0.5) / (decline + 0.5)) AS v2, v3 FROM v) SELECT 'v1' AS x, 'v2' AS y, round(corr(v1, v2), 6) AS pearson FROM z UNION ALL SELECT 'v1', 'v3', round(corr(v1, v3), 6) FROM z UNION ALL SELECT 'v2', 'v3', round(corr(v2, v3), 6) FROM z", tables="p")
def _(s, d):
    return op.correlation_grid(op.vitality(labelled(s, d), "dong", trend="slope_all_mm"), ["v1", "v2", "v3"])


@query("corr_leave_one_out", f"WITH {_CU}, g AS (SELECT dong, count(*)::DOUBLE AS x, avg(c_acctbal) AS y FROM cu GROUP BY 1) SELECT a.dong AS dropped, count(*) AS n, round(corr(b.x, b.y), 6) AS pearson FROM g a JOIN g b ON a.dong <> b.dong GROUP BY 1")
def _(s, d):
    g = customers(s, d).groupBy("dong").agg(F.count("*").alias("x"), F.avg("c_acctbal").alias("y"))
    return op.leave_one_out(g, key="dong", x="x", y="y")


_SP = "sp AS (SELECT CAST(c_nationkey AS INTEGER) AS place, CAST(o_orderdate AS DATE) AS a, CASE WHEN o_orderkey % 3 > 0 THEN CAST(last AS DATE) END AS b FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"


@query("range_active_interval", f"""WITH {_SP}, m AS (SELECT place, unnest(generate_series(date_trunc('month', min(a)), date_trunc('month', greatest(max(a) + INTERVAL 1 MONTH, max(b))), INTERVAL 1 MONTH)) AS month FROM sp GROUP BY 1)
SELECT m.place, CAST(m.month AS DATE) AS month, count(*) FILTER (WHERE a <= m.month AND (b IS NULL OR b > m.month + INTERVAL 1 MONTH - INTERVAL 1 DAY)) AS active, count(*) FILTER (WHERE b >= m.month AND b <= m.month + INTERVAL 1 MONTH - INTERVAL 1 DAY) AS closures,
 round(count(*) FILTER (WHERE b >= m.month AND b <= m.month + INTERVAL 1 MONTH - INTERVAL 1 DAY) / nullif(count(*) FILTER (WHERE a <= m.month AND (b IS NULL OR b > m.month + INTERVAL 1 MONTH - INTERVAL 1 DAY)), 0)::DOUBLE, 6) AS rate FROM m JOIN sp ON sp.place = m.place WHERE m.month BETWEEN DATE '1996-01-01' AND DATE '2000-12-01' GROUP BY 1, 2""")
def _(s, d):
    last = read_table(s, d, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.max("l_shipdate")).alias("last"))
    o = read_table(s, d, "orders").join(read_table(s, d, "customer"), c("o_custkey") == c("c_custkey")).join(last, c("o_orderkey") == c("l_orderkey"), "left")
    spells = o.select(c("c_nationkey").cast("int").alias("place"), F.to_date("o_orderdate").alias("a"), F.when(c("o_orderkey") % 3 > 0, c("last")).alias("b"))
    return op.active_interval(spells, place="place", start="a", end="b").where("month BETWEEN DATE '1996-01-01' AND DATE '2000-12-01'")


_EV = "ev AS (SELECT user_id % 25 AS place, ts, value FROM events)"


@query("ext_population_monthly", f"WITH {_EV}, x AS (SELECT place, CAST(ts AS DATE) AS day, count(*) AS v FROM ev GROUP BY 1, 2) SELECT place, CAST(date_trunc('month', day) AS DATE) AS month, round(avg(v), 6) AS population FROM x GROUP BY 1, 2")
def _(s, d):
    return op.monthly_from_hours(read_table(s, d, "events").withColumn("place", c("user_id") % 25), place="place", at="ts", value=F.count("*"))


@query("ext_address_district", "SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 2 = 0 THEN ' ' ELSE p_name END), ''), nullif(trim(p_brand), '')) AS address, nullif(regexp_extract(coalesce(nullif(trim(CASE WHEN p_size % 2 = 0 THEN ' ' ELSE p_name END), ''), nullif(trim(p_brand), '')), '([A-Za-z]+#[0-9]+|[a-z]+$)', 1), '') AS district FROM part")
def _(s, d):
    p = read_table(s, d, "part").withColumn("road", F.when(c("p_size") % 2 == 0, " ").otherwise(c("p_name")))
    return op.address_district(p, "road", "p_brand", "([A-Za-z]+#[0-9]+|[a-z]+$)").select("p_partkey", "address", "district")


@query("ext_macro_panel", f"WITH {_EV}, a AS (SELECT place, CAST(ts AS DATE) AS day, count(*) AS v FROM ev GROUP BY 1, 2), b AS (SELECT CAST(c_nationkey AS BIGINT) AS place, count(*) AS closures FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1) SELECT a.place, day, v, closures FROM a JOIN b ON a.place = b.place")
def _(s, d):
    a = read_table(s, d, "events").groupBy((c("user_id") % 25).alias("place"), F.to_date("ts").alias("day")).agg(F.count("*").alias("v"))
    b = read_table(s, d, "orders").where("o_orderstatus = 'F'").join(read_table(s, d, "customer"), c("o_custkey") == c("c_custkey")).groupBy(c("c_nationkey").cast("long").alias("place")).agg(F.count("*").alias("closures"))
    return a.join(b, "place")


@query("ext_population_change", f"WITH {_EV}, x AS (SELECT place, CAST(ts AS DATE) AS day, count(*)::DOUBLE AS v FROM ev GROUP BY 1, 2), y AS (SELECT place, arg_min(v, day) AS first, arg_max(v, day) AS last, avg(v) AS mean FROM x GROUP BY 1) SELECT place, first, last, round(mean, 6) AS mean, round(100 * (last - first) / first, 6) AS pct_change FROM y")
def _(s, d):
    x = read_table(s, d, "events").groupBy((c("user_id") % 25).alias("place"), F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("v"))
    return op.first_last_change(x, place="place", period="day", value="v")


_Q = "q AS (SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) / 100.0::DOUBLE AS amount, count(*) AS transactions, count(DISTINCT o_custkey) AS entities FROM orders GROUP BY 1)"


def quarters(s, d):
    return op.quarterly(read_table(s, d, "orders"), at="o_orderdate", amount=F.sum(F.floor(c("o_totalprice") * 100 + 0.5).cast("long")) / 100.0, entity="o_custkey")


@query("ext_quarterly", f"WITH {_Q} SELECT quarter, round(amount, 2) AS amount, transactions, entities FROM q", digits=2)
def _(s, d):
    return quarters(s, d)


@query("ext_qoq", f"WITH {_Q} SELECT quarter, round((amount - lag(amount) OVER (ORDER BY quarter)) / lag(amount) OVER (ORDER BY quarter), 6) AS qoq FROM q")
def _(s, d):
    return op.change_on_last(quarters(s, d), order="quarter", value="amount").select("quarter", "qoq")


def specs(s):
    return wn.spec_table(s, [1996, 1997], [1, 4, 7], [3, 6], [1])


_SPEC = """sp AS (SELECT 'sy' || y || '_sm' || m || '_w' || k || '_off1' AS spec_id, make_date(y, m, 1) AS fs, CAST(make_date(y, m, 1) + to_months(CAST(k AS INTEGER)) - INTERVAL 1 DAY AS DATE) AS fe, make_date(y + 1, m, 1) AS ts, CAST(make_date(y + 1, m, 1) + to_months(CAST(k AS INTEGER)) - INTERVAL 1 DAY AS DATE) AS te
 FROM (SELECT unnest([1996, 1997]) AS y), (SELECT unnest([1, 4, 7]) AS m), (SELECT unnest([3, 6]) AS k)),
r AS (SELECT w.*, sp.*, CASE WHEN date_id BETWEEN fs AND fe THEN 'feature' ELSE 'target' END AS segment FROM weekly w JOIN sp ON date_id BETWEEN fs AND fe OR date_id BETWEEN ts AND te)"""


@query("range_window_specs", f"WITH {_SPEC} SELECT spec_id, segment, count(*) AS n, round(avg(sales_card), 4) AS mean FROM r GROUP BY 1, 2", tables="w", digits=4)
def _(s, d):
    return wn.attach_specs(weekly(s, d), specs(s)).groupBy("spec_id", "segment").agg(F.count("*").alias("n"), F.avg("sales_card").alias("mean"))


@query("spec_inventory", f"WITH {_SPEC}, e AS (SELECT spec_id, public_id, max(CAST(segment = 'feature' AS INTEGER)) AS f, max(CAST(segment = 'target' AS INTEGER)) AS t FROM r GROUP BY 1, 2) SELECT spec_id, CAST(sum(f) AS BIGINT) AS n_feature, CAST(sum(t) AS BIGINT) AS n_target, CAST(sum(f * t) AS BIGINT) AS n_both FROM e GROUP BY 1", tables="w")
def _(s, d):
    return wn.spec_inventory(wn.attach_specs(weekly(s, d), specs(s)))


@query("feat_window_simple", f"""WITH {_SPEC}, f AS (SELECT *, (date_id - fs) // 7 AS x, ln(1 + sales_card) AS s, (fe - fs) // 7 + 1 AS weeks, row_number() OVER (PARTITION BY spec_id, public_id ORDER BY date_id) AS up, row_number() OVER (PARTITION BY spec_id, public_id ORDER BY date_id DESC) AS down FROM r WHERE segment = 'feature')
SELECT spec_id, public_id, count(s) AS n, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, round({slope_sql('s', 'x')}, 6) AS slope, round(avg(s) FILTER (WHERE down <= 4) - avg(s) FILTER (WHERE up <= 4), 6) AS sales_delta, round(stddev_pop(s) / (abs(avg(s)) + 1e-9), 6) AS cv FROM f GROUP BY 1, 2 HAVING count(s) >= ceil(0.7 * any_value(weeks))""", tables="w")
def _(s, d):
    return wn.window_simple(wn.attach_specs(weekly(s, d), specs(s)))


_TL = f"{_SPEC}, v AS (SELECT *, sales_card / nullif(avg(sales_card) OVER (PARTITION BY spec_id, public_id), 0) AS v FROM r), t AS (SELECT spec_id, public_id, count(v) AS n, {slope_sql('v', '((date_id - ts) // 7)')} AS slope FROM v WHERE segment = 'target' GROUP BY 1, 2), g AS (SELECT *, stddev_pop(slope) OVER (PARTITION BY spec_id) AS sg FROM t), lb AS (SELECT spec_id, public_id, slope, CASE WHEN slope > 0.5 * sg THEN 'Growth' WHEN slope < -0.5 * sg THEN 'Decline' ELSE 'Stable' END AS outcome_3 FROM g WHERE n >= 3)"


@query("spec_label_dist", f"WITH {_TL} SELECT spec_id, outcome_3, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY spec_id)::DOUBLE, 6) AS share FROM lb GROUP BY 1, 2", tables="w")
def _(s, d):
    return shares_in_group(wn.target_labels(wn.attach_specs(weekly(s, d), specs(s))), ["spec_id"], "outcome_3")


@query("spec_results_summary", f"WITH {_TL} SELECT spec_id, round(avg(slope), 6) AS mean, round(stddev_samp(slope), 6) AS sd, row_number() OVER (ORDER BY round(avg(slope), 9) DESC, spec_id) AS rank FROM lb GROUP BY 1", tables="w")
def _(s, d):
    from pyspark.sql import Window

    out = wn.target_labels(wn.attach_specs(weekly(s, d), specs(s))).groupBy("spec_id").agg(F.avg("slope").alias("mean"), F.stddev_samp("slope").alias("sd"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("mean", 9)), "spec_id")).cast("long"))


@query("self_label_stability", f"WITH {_TL} SELECT x.spec_id AS a, y.spec_id AS b, count(*) AS n, round(avg(CAST(x.outcome_3 = y.outcome_3 AS INTEGER)), 6) AS same FROM lb x JOIN lb y ON x.public_id = y.public_id AND x.spec_id < y.spec_id GROUP BY 1, 2", tables="w")
def _(s, d):
    return wn.self_label_stability(wn.target_labels(wn.attach_specs(weekly(s, d), specs(s))), panel="spec_id", entity="public_id", label="outcome_3")


@query("cross_method_match", f"WITH {SL}, z AS (SELECT outcome_3 AS a, CASE WHEN l > 0 THEN 'Growth' ELSE 'Decline' END AS b FROM lab) SELECT a, b, count(*) AS n, a = b AS hit FROM z GROUP BY 1, 2, 4", tables="p")
def _(s, d):
    return labelled(s, d).groupBy(c("outcome_3").alias("a"), F.when(c("slope_late_mm") > 0, "Growth").otherwise("Decline").alias("b")).agg(F.count("*").alias("n")).withColumn("hit", c("a") == c("b"))


@query("asof_recent_history", f"WITH {_SPEC} SELECT sp.spec_id, public_id, count(*) AS n, round(arg_max(sales_card, date_id), 6) AS last_value, round(arg_min(sales_card, date_id), 6) AS first_value FROM weekly JOIN sp ON date_id <= fe AND date_id > fe - 182 GROUP BY 1, 2 HAVING count(*) >= 12", tables="w")
def _(s, d):
    h = wn.recent_history(weekly(s, d), specs(s))
    return h.select("spec_id", "public_id", F.size("history").cast("long").alias("n"), F.element_at("history", -1).alias("last_value"), F.element_at("history", 1).alias("first_value"))


@query("spec_parse_id", f"WITH {_SPEC} SELECT spec_id, year(fs)::INTEGER AS year, month(fs)::INTEGER AS month, (date_diff('month', fs, fe + 1))::INTEGER AS weeks, 1 AS lag FROM sp", tables="w")
def _(s, d):
    weeks = wn.attach_specs(weekly(s, d), specs(s)).select("spec_id").distinct()
    return wn.parse_spec_id(weeks).select("spec_id", "year", "month", "weeks", "lag")


_RING = "m AS (SELECT c_nationkey, c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY ((c_custkey + 7) * 2654435761) % 1000003, c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer), e AS (SELECT a.c_custkey AS src, b.c_custkey AS dst FROM m a JOIN m b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND (b.i - a.i + a.n) % a.n BETWEEN 1 AND least(5, a.n - 1))"


def ring(s, d):
    return nw.cell_edges(read_table(s, d, "customer"), ["c_nationkey", "c_mktsegment"], entity="c_custkey", degree=5)


@query("graph_cell_edges", f"WITH {_RING} SELECT src, dst FROM e")
def _(s, d):
    return ring(s, d)


@query("graph_norm_weights", f"WITH {_RING}, x AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), y AS (SELECT * FROM x UNION ALL SELECT DISTINCT src, src FROM x), g AS (SELECT src, count(*) AS k FROM y GROUP BY 1) SELECT y.src, y.dst, round(1 / sqrt(a.k * b.k), 6) AS weight FROM y JOIN g a ON a.src = y.src JOIN g b ON b.src = y.dst")
def _(s, d):
    return nw.normalised_weights(ring(s, d))


def owners(s, d):
    lines = read_table(s, d, "lineitem").select(c("l_orderkey").alias("patent"), c("l_suppkey").alias("owner"))
    kind = F.element_at(F.array(F.lit("university"), F.lit("firm"), F.lit("institute")), (c("owner") % 3 + 1).cast("int"))
    return lines.distinct().join(read_table(s, d, "orders").select(c("o_orderkey").alias("patent"), F.year("o_orderdate").alias("year"), "o_orderpriority", (c("o_orderstatus") == "F").alias("triadic")), "patent").withColumn("kind", kind)


_OW = "ow AS (SELECT DISTINCT l_orderkey AS patent, l_suppkey AS owner, CAST(year(o_orderdate) AS INTEGER) AS year, CASE l_suppkey % 3 WHEN 0 THEN 'university' WHEN 1 THEN 'firm' ELSE 'institute' END AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query("pat_triadic_share", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS triadic, round(avg(CAST(o_orderstatus = 'F' AS INTEGER)), 6) AS share FROM orders GROUP BY 1, 2 HAVING count(*) >= 50")
def _(s, d):
    o = read_table(s, d, "orders").select(F.year("o_orderdate").alias("year"), "o_orderpriority", (c("o_orderstatus") == "F").alias("t"))
    return nw.triadic_share(o, ["year", "o_orderpriority"], "t", least=50)


@query("pat_two_mode_edges", f"WITH {_OW} SELECT x.year, x.owner AS a, y.owner AS b, count(*) AS n FROM ow x JOIN ow y ON x.patent = y.patent AND x.kind = 'university' AND y.kind = 'firm' GROUP BY 1, 2, 3")
def _(s, d):
    return nw.two_mode_edges(owners(s, d), record="patent", owner="owner", kind="kind", a="university", b="firm", by="year")


_OM = "om AS (SELECT x.owner AS a, y.owner AS b, count(*) AS n FROM ow x JOIN ow y ON x.patent = y.patent AND x.kind = 'university' AND y.kind = 'university' AND x.owner < y.owner GROUP BY 1, 2)"


@query("pat_one_mode_edges", f"WITH {_OW}, {_OM} SELECT * FROM om")
def _(s, d):
    return nw.one_mode_edges(owners(s, d), record="patent", owner="owner", kind="kind", a="university")


@query("pat_partner_concentration", f"WITH {_OW}, x AS (SELECT x.owner AS a, y.owner AS b, count(*) AS n FROM ow x JOIN ow y ON x.patent = y.patent AND x.kind = 'university' AND y.kind = 'firm' GROUP BY 1, 2) SELECT a, count(*) AS partners, CAST(sum(n) AS BIGINT) AS records, round(sum(n * n) / (sum(n) * sum(n))::DOUBLE, 6) AS hhi FROM x GROUP BY 1 ORDER BY sum(n) DESC, a LIMIT 20")
def _(s, d):
    return nw.partner_concentration(nw.two_mode_edges(owners(s, d), record="patent", owner="owner", kind="kind", a="university", b="firm", by="year"))


@query("uni_match_rate", "SELECT count(*) AS n, count(m) AS matched, round(count(m) / count(*)::DOUBLE, 6) AS rate FROM (SELECT DISTINCT c_custkey AS id FROM customer) a LEFT JOIN (SELECT DISTINCT o_custkey AS m FROM orders WHERE o_orderstatus = 'P') b ON a.id = b.m")
def _(s, d):
    return nw.match_rate(read_table(s, d, "customer").select(c("c_custkey").alias("id")), read_table(s, d, "orders").where("o_orderstatus = 'P'").select(c("o_custkey").alias("id")), key="id")


def unit_years(s, d):
    return read_table(s, d, "lineitem").groupBy(c("l_suppkey").alias("unit"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("v"), F.count("*").alias("k"))


_UY = "uy AS (SELECT l_suppkey AS unit, CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS v, count(*) AS k FROM lineitem GROUP BY 1, 2)"


@query("uni_percentile_panel", f"WITH {_UY} SELECT unit, year, round(100 * percent_rank() OVER (PARTITION BY year ORDER BY v), 6) AS pct FROM uy")
def _(s, d):
    return nw.percentile_panel(unit_years(s, d), unit="unit", year="year", value="v").select("unit", "year", "pct")


@query("uni_mobility", f"WITH {_UY}, p AS (SELECT unit, year, 100 * percent_rank() OVER (PARTITION BY year ORDER BY v) AS pct FROM uy) SELECT unit, round(max(pct) - min(pct), 6) AS range, round(arg_max(pct, year) - arg_min(pct, year), 6) AS mobility, arg_min(pct, year) BETWEEN 25 AND 75 AS mid_start FROM p GROUP BY 1")
def _(s, d):
    return nw.mobility(nw.percentile_panel(unit_years(s, d), unit="unit", year="year", value="v"), unit="unit", year="year")


@query("uni_volatility_yoy", f"WITH {_UY}, x AS (SELECT *, ln(1 + v) - lag(ln(1 + v)) OVER (PARTITION BY unit ORDER BY year) AS d FROM uy) SELECT unit, round(stddev_samp(ln(1 + v)), 6) AS volatility, round(avg(abs(d)), 6) AS mean_abs_change FROM x GROUP BY 1")
def _(s, d):
    return nw.yoy_volatility(unit_years(s, d), unit="unit", year="year", value="v")


@query("uni_lagged_corr", f"WITH {_UY} SELECT CAST(g AS INTEGER) AS lag, count(*) AS n, round(corr(a.v, b.k::DOUBLE), 6) AS pearson FROM uy a, (SELECT unnest([0, 1, 2, 3]) AS g), uy b WHERE a.unit = b.unit AND b.year = a.year + g GROUP BY 1")
def _(s, d):
    return nw.lagged_corr(unit_years(s, d), [0, 1, 2, 3], unit="unit", year="year", x="v", y="k")


@query("uni_impute", f"WITH {_UY}, g AS (SELECT unit, year, CASE WHEN year % 3 > 0 THEN v END AS v, row_number() OVER (PARTITION BY unit ORDER BY year) AS p FROM uy), h AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS v0, first_value(v IGNORE NULLS) OVER b AS v1, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER a AS p0, first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER b AS p1 FROM g WINDOW a AS (PARTITION BY unit ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY unit ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT unit, year, round(greatest(coalesce(v, v0 + (v1 - v0) * (p - p0) / nullif(p1 - p0, 0), v0, v1), 0)) AS v FROM h")
def _(s, d):
    rows = unit_years(s, d).select("unit", "year", F.when(c("year") % 3 > 0, c("v")).alias("v"))
    return nw.impute_unit(rows, unit="unit", year="year", value="v", count=True)


@query("uni_group_compare", f"WITH {_UY} SELECT unit % 3 AS grp, count(*) AS n, round(avg(v), 6) AS mean_v, round(avg(k), 6) AS mean_k FROM uy GROUP BY 1")
def _(s, d):
    return unit_years(s, d).groupBy((c("unit") % 3).alias("grp")).agg(F.count("*").alias("n"), F.avg("v").alias("mean_v"), F.avg("k").alias("mean_k"))


@query("uni_paradox", f"WITH {_UY}, z AS (SELECT *, v / k AS per FROM uy) SELECT unit, year FROM z WHERE v >= (SELECT quantile_cont(v, 0.6) FROM z) AND per <= (SELECT quantile_cont(per, 0.4) FROM z)")
def _(s, d):
    return nw.paradox_cases(unit_years(s, d).withColumn("per", c("v") / c("k")), high="v", low="per", at=0.6).select("unit", "year")


_FE = "z AS (SELECT {e} AS e, {t} AS t, {y} AS y, {x} AS x FROM {src}), m AS (SELECT *, y - avg(y) OVER (PARTITION BY e) - avg(y) OVER (PARTITION BY t) + avg(y) OVER () AS yd, x - avg(x) OVER (PARTITION BY e) - avg(x) OVER (PARTITION BY t) + avg(x) OVER () AS xd FROM z) SELECT count(*) AS n, round(sum(xd * yd) / sum(xd * xd), 6) AS x FROM m"


@query("uni_twfe", f"WITH {_UY}, " + _FE.format(e="unit", t="year", y="ln(1 + v)", x="ln(1 + k)", src="uy"))
def _(s, d):
    rows = unit_years(s, d).select("unit", "year", F.log1p("v").alias("y"), F.log1p("k").alias("x"))
    return causal.fe_twoway(rows, "y", ["x"], entity="unit", period="year")
