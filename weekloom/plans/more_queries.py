"""Queries of windows of any length, turns, agreement and hazards, and of files written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.operators import causal, features as ft, statistics as st, windows as wn
from weekloom.plans.binding import panel, query, slope_sql
from weekloom.plans.district_queries import _SPEC, specs
from weekloom.plans.label_queries import SL, labelled
from weekloom.sources.archives import read_zipped_csv, write_zipped_csv
from weekloom.sources.tables import fresh_folder, meta, read_dimension, read_encoded_csv, read_table, weekly, write_encoded_csv, write_table

c = F.col

_W = f"""{_SPEC}, v AS (SELECT spec_id, public_id, (date_id - fs) // 7 AS x, (fe - fs) // 7 + 1 AS n, ln(1 + sales_card) AS s, CASE WHEN customer > 0 THEN customer_new / customer::DOUBLE END AS nc FROM r WHERE segment = 'feature')"""


@query("feat_window_var", f"""WITH {_W} SELECT spec_id, public_id, count(s) AS n_feat_weeks, round(avg(s), 6) AS sales_mean, round({slope_sql('s', 'x')}, 6) AS slope_all, round({slope_sql('s', 'x', 'x < greatest(n // 3, 2)')}, 6) AS slope_1_3, round({slope_sql('s', 'x', 'x >= 2 * greatest(n // 3, 2)')}, 6) AS slope_3_3, round({slope_sql('s', 'x', 'x >= n // 2')}, 6) AS slope_second_half, round(coalesce(avg(nc) FILTER (WHERE x < greatest(n // 4, 1)), 0), 6) AS nc_first_q
 FROM v GROUP BY 1, 2 HAVING count(s) >= greatest(ceil(0.5 * any_value(n)), 2)""", tables="w")
def _(s, d):
    rows = wn.attach_specs(weekly(s, d), specs(s)).where("segment = 'feature'")
    return ft.feat_window_var(rows).select("spec_id", "public_id", "n_feat_weeks", "sales_mean", "slope_all", "slope_1_3", "slope_3_3", "slope_second_half", "nc_first_q")


_BY = f"{SL}, i AS (SELECT public_id, CASE WHEN l > 0 THEN 'rise' ELSE 'fall' END AS code, weeks // 2 AS wk FROM f)"


@query("es_by_code", f"WITH {_BY} SELECT code, CAST(p.week_idx - wk AS BIGINT) AS event_time, count(*) AS n, round(avg(sales_card_mm), 6) AS mean, round(stddev_samp(sales_card_mm) / sqrt(count(*)), 6) AS se FROM panel p JOIN i USING (public_id) WHERE p.week_idx - wk BETWEEN -12 AND 11 GROUP BY 1, 2", tables="p")
def _(s, d):
    f = labelled(s, d).select("public_id", F.when(c("slope_late_mm") > 0, "rise").otherwise("fall").alias("code"), F.floor(c("weeks") / 2).alias("gc_week"))
    out = causal.event_profile(causal.event_window(panel(s, d), f, width=12), group="code")
    return out.select("code", c("event_time").cast("long").alias("event_time"), "n", "mean", c("sem").alias("se"))


@query("es_trough_lead")
def _(s, d):
    p = panel(s, d)
    return causal.trough_lead(p, ft.change_point_slope(p))


@query("agree_ami")
def _(s, d):
    o = read_table(s, d, "orders").select("o_orderstatus", F.year("o_orderdate").alias("y"))
    return s.createDataFrame([(st.adjusted_mutual_information(o, "o_orderstatus", "y"),)], "ami double")


@query("clu_feature_means", f"WITH {SL} SELECT CAST(public_id AS BIGINT) % 3 AS cluster, round(avg(a) FILTER (WHERE outcome_3 = 'Growth'), 6) AS growth, round(avg(a) FILTER (WHERE outcome_3 = 'Decline'), 6) AS decline, round(avg(a) FILTER (WHERE outcome_3 = 'Stable'), 6) AS stable FROM lab GROUP BY 1", tables="p")
def _(s, d):
    means = [F.avg(F.when(c("outcome_3") == x.title(), c("slope_all_mm"))).alias(x) for x in ("growth", "decline", "stable")]
    return labelled(s, d).groupBy((c("public_id").cast("long") % 3).alias("cluster")).agg(*means)


@query("agree_conditional", """WITH x AS (SELECT o_orderpriority AS g, o_orderstatus AS a, year(o_orderdate) AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2, 3), t AS (SELECT g, sum(n) AS t, sum(n * ln(n)) AS rj FROM x GROUP BY 1),
ra AS (SELECT g, sum(n * ln(n)) AS ra FROM (SELECT g, a, sum(n) AS n FROM x GROUP BY 1, 2) GROUP BY 1), rb AS (SELECT g, sum(n * ln(n)) AS rb FROM (SELECT g, b, sum(n) AS n FROM x GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT t, ln(t) - ra / t AS ha, ln(t) - rb / t AS hb, ln(t) - rj / t AS hj FROM t JOIN ra USING (g) JOIN rb USING (g))
SELECT round(sum(t * CASE WHEN ha + hb > 1e-12 THEN (ha + hb - hj) / ((ha + hb) / 2) ELSE 1 END) / sum(t), 6) AS nmi FROM h""")
def _(s, d):
    o = read_table(s, d, "orders").select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("y"))
    return st.conditional_agreement(o, "o_orderstatus", "y", "o_orderpriority")


@query("src_dim_csv", "SELECT public_id, category, round(area, 6) AS area, CAST(date_trunc('month', open_date) AS DATE) AS open_date FROM meta", tables="m")
def _(s, d):
    path = fresh_folder(s, "dimension")
    write_table(meta(s, d).select("public_id", "category", "area", "open_month"), path, kind="csv")
    return read_dimension(s, path, "public_id string, category string, area double, open_month string").select("public_id", "category", "area", "open_date")


@query("src_encoded_csv", "SELECT 'nation' AS kind, n_nationkey AS k, n_name || ' 서울' AS name FROM nation UNION ALL SELECT 'region', r_regionkey, r_name || ' 부산' FROM region")
def _(s, d):
    out = None
    for kind, korean in (("nation", "서울"), ("region", "부산")):
        t = read_table(s, d, kind)
        path = fresh_folder(s, kind)
        write_encoded_csv(t.select(F.lit(kind).alias("kind"), c(f"{kind[0]}_{kind}key").cast("long").alias("k"), F.concat(c(f"{kind[0]}_name"), F.lit(f" {korean}")).alias("name"), F.lit(1).alias("other")), path, encoding="cp949")
        rows = read_encoded_csv(s, [path], "kind string, k long, name string, other int", ["kind", "k", "name"], encoding="cp949")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("src_zipped_csv", "SELECT p_partkey AS k, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' 서울' ELSE ' ☃' END AS name, round(p_retailprice, 2) AS price, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS size FROM part", digits=2)
def _(s, d):
    """Two sets of archives, of cp949 and of UTF-8; the size of the first isn't a number."""
    part = read_table(s, d, "part").select(c("p_partkey").cast("long").alias("k"), F.concat("p_name", F.when(c("p_partkey") % 3 == 0, " 서울").otherwise(" ☃")).alias("name"), c("p_retailprice").alias("price"), "p_size", F.lit("a,b").alias("other"))
    paths = write_zipped_csv(part.where("k % 3 = 0").withColumn("size", F.concat(c("p_size").cast("string"), F.lit("cm"))).drop("p_size"), fresh_folder(s, "zips"), encoding="cp949")
    paths += write_zipped_csv(part.where("k % 3 > 0").withColumnRenamed("p_size", "size"), fresh_folder(s, "zips"))
    return read_zipped_csv(s, paths, "k long, name string, price double, size int")


@query("sink_tables", "SELECT o_orderstatus AS status, year(o_orderdate) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2", digits=2)
def _(s, d):
    o = read_table(s, d, "orders").groupBy(c("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    parquet, text = fresh_folder(s, "result"), fresh_folder(s, "result_csv")
    write_table(o, parquet, by=["status"])
    write_table(s.read.parquet(parquet).select("status", "year", "n", "total"), text, kind="csv")
    return s.read.csv(text, header=True, schema="status string, year int, n long, total double")
