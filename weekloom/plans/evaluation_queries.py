"""Queries of tests, agreement, folds and score evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekloom.operators import evaluate as ev
from weekloom.operators import statistics as st
from weekloom.plans.binding import panel, query
from weekloom.sources.tables import read_table

c = F.col
_S = "s AS (SELECT doc_id, lang, source, n_chars, quality, toxic, (n_chars % 1000) / 1000.0::DOUBLE AS score, toxic = 1 AS t FROM documents JOIN labels USING (doc_id))"


def scores(s, d):
    rows = read_table(s, d, "documents").select("doc_id", "lang", "source", "n_chars").join(read_table(s, d, "labels"), "doc_id")
    return rows.withColumn("score", (c("n_chars") % 1000) / 1000.0)


def toxic():
    return c("toxic") == 1

_AVG_RANK = "(rank() OVER ({o}) + rank() OVER ({o}) + count(*) OVER ({p}) - 1) / 2.0::DOUBLE"


@query("test_anova", " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, round((sum(n * (a - g) ** 2) / (count(*) - 1)) / (sum(v) / (sum(n) - count(*))), 4) AS f FROM (SELECT c_mktsegment, count(*) AS n, avg({m}) AS a, count(*) * var_pop({m}) AS v FROM customer GROUP BY 1), (SELECT avg({m}) AS g FROM customer)" for m in ("c_acctbal", "c_nationkey")), digits=4)
def _(s, d):
    return st.anova(read_table(s, d, "customer").select("c_mktsegment", "c_acctbal", c("c_nationkey").cast("double").alias("c_nationkey")), "c_mktsegment", ["c_acctbal", "c_nationkey"])


@query("test_kruskal", f"""WITH {_S}, r AS (SELECT lang, (2 * rank() OVER (ORDER BY score) + count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM s), q AS (SELECT sum(x * x / m) AS q, count(*) AS k, sum(m)::DOUBLE AS t FROM (SELECT lang, sum(r) AS x, count(*) AS m FROM r GROUP BY 1)), ti AS (SELECT sum(n ** 3 - n) AS ties FROM (SELECT count(*)::DOUBLE AS n FROM s GROUP BY score)),
h AS (SELECT k, t, (12 / (t * (t + 1)) * q - 3 * (t + 1)) / (1 - ties / (t ** 3 - t)) AS h FROM q, ti) SELECT k, t AS n, round(h, 6) AS h, round(greatest((h - k + 1) / (t - k), 0), 6) AS eta_squared FROM h""")
def _(s, d):
    return st.kruskal(scores(s, d), "lang", "score")


@query("test_mannwhitney", f"""WITH {_S}, r AS (SELECT t, (2 * rank() OVER (ORDER BY score) + count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM s), u AS (SELECT count(*) FILTER (WHERE t) AS n1, count(*) FILTER (WHERE NOT t) AS n2, sum(r) FILTER (WHERE t) AS w FROM r), ti AS (SELECT sum(n ** 3 - n) AS ties FROM (SELECT count(*)::DOUBLE AS n FROM s GROUP BY score))
SELECT n1, n2, round(w - n1 * (n1 + 1) / 2.0, 6) AS u, round((w - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) / sqrt(n1 * n2 / 12.0::DOUBLE * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM u, ti""")
def _(s, d):
    return st.mann_whitney(scores(s, d), "score", toxic())


@query("test_welch_t", f"WITH {_S}, m AS (SELECT avg(score) FILTER (WHERE t) - avg(score) FILTER (WHERE NOT t) AS d, var_samp(score) FILTER (WHERE t) / count(*) FILTER (WHERE t) AS a, var_samp(score) FILTER (WHERE NOT t) / count(*) FILTER (WHERE NOT t) AS b, count(*) FILTER (WHERE t) AS n, count(*) FILTER (WHERE NOT t) AS k FROM s) SELECT round(d, 6) AS difference, round(d / sqrt(a + b), 6) AS t, round((a + b) ** 2 / (a * a / (n - 1) + b * b / (k - 1)), 6) AS df FROM m")
def _(s, d):
    return st.welch_t(scores(s, d), "score", toxic())


@query("test_paired_t", "SELECT count(*) AS n, round(avg(l - e), 6) AS mean, round(avg(l - e) / (stddev_samp(l - e) / sqrt(count(*))), 6) AS t FROM (SELECT public_id, avg(sales_card_mm) FILTER (WHERE week_idx < 10) AS e, avg(sales_card_mm) FILTER (WHERE week_idx BETWEEN 20 AND 29) AS l FROM panel GROUP BY 1)", tables="p")
def _(s, d):
    x = c("week_idx")
    rows = panel(s, d).groupBy("public_id").agg(F.avg(F.when(x < 10, c("sales_card_mm"))).alias("e"), F.avg(F.when(x.between(20, 29), c("sales_card_mm"))).alias("l"))
    return st.paired_t(rows, "l", "e")


_AG = """x AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {t} GROUP BY 1, 2), r AS (SELECT sum(n) AS n FROM x GROUP BY a), k AS (SELECT sum(n) AS n FROM x GROUP BY b), t AS (SELECT sum(n) AS t FROM x),
h AS (SELECT t, (SELECT -sum(n / t * ln(n / t)) FROM r) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM k) AS hb, (SELECT -sum(n / t * ln(n / t)) FROM x) AS hj, (SELECT sum(n * (n - 1) / 2) FROM x) AS p, (SELECT sum(n * (n - 1) / 2) FROM r) AS pa, (SELECT sum(n * (n - 1) / 2) FROM k) AS pb FROM t)
SELECT round((ha + hb - hj) / ((ha + hb) / 2), 6) AS nmi, round((p - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) AS ari FROM h"""


@query("agree_nmi_ari", "WITH " + _AG.format(a="o_orderstatus", b="year(o_orderdate)", t="orders"))
def _(s, d):
    return st.agreement(read_table(s, d, "orders").select("o_orderstatus", F.year("o_orderdate").alias("y")), "o_orderstatus", "y")


@query("boot_ci")
def _(s, d):
    return st.bootstrap_interval(scores(s, d), "score", key="doc_id")


@query("corr_pairs", f"""WITH {_S}, v AS (SELECT n_chars::DOUBLE AS x, score AS y FROM s), r AS (SELECT x, y, (2 * rank() OVER (ORDER BY x) + count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, (2 * rank() OVER (ORDER BY y) + count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM v)
SELECT 'n_chars' AS x, 'score' AS y, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r""")
def _(s, d):
    return st.spearman_pairs(scores(s, d), [("n_chars", "score")])


_HASH = "((doc_id) * 2654435761) % 1000003"


@query("fold_stratified", f"SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY {_HASH}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels")
def _(s, d):
    return ev.fold_stratified(read_table(s, d, "labels"), "quality", key="doc_id").select("doc_id", "quality", "fold")


@query("fold_hashed", f"SELECT doc_id, {_HASH} % 5 AS fold FROM labels")
def _(s, d):
    return ev.fold_hashed(read_table(s, d, "labels"), key="doc_id").select("doc_id", "fold")


@query("split_time", "WITH f AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS o FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN (o - DATE '1970-01-01') <= (SELECT median(o - DATE '1970-01-01') FROM f) THEN 'train' ELSE 'test' END AS part FROM f")
def _(s, d):
    f = read_table(s, d, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("o"))
    return ev.split_time(f, "o").select("o_custkey", "part")


@query("target_encode", f"""WITH {_S}, f AS (SELECT *, {_HASH} % 5 AS fold FROM s) SELECT a.doc_id, round((coalesce((SELECT 0), 0) + o.cs + 50 * o.g) / (o.cn + 50), 6) AS encoded FROM f a JOIN (SELECT x.fold, x.source, coalesce(sum(y.score) FILTER (WHERE y.source = x.source), 0) AS cs, count(y.score) FILTER (WHERE y.source = x.source) AS cn, avg(y.score) AS g FROM (SELECT DISTINCT fold, source FROM f) x JOIN f y ON y.fold <> x.fold GROUP BY 1, 2) o ON a.fold = o.fold AND a.source = o.source""")
def _(s, d):
    return ev.target_encode(ev.fold_hashed(scores(s, d), key="doc_id"), "source", "score").select("doc_id", "encoded")


@query("base_majority", f"""WITH {_S}, f AS (SELECT *, {_HASH} % 5 AS fold FROM s), m AS (SELECT fold, lang FROM (SELECT x.fold, y.lang, row_number() OVER (PARTITION BY x.fold ORDER BY count(*) DESC, y.lang) AS r FROM (SELECT DISTINCT fold FROM f) x JOIN f y ON y.fold <> x.fold GROUP BY 1, 2) WHERE r = 1)
SELECT fold, m.lang AS majority, round(avg(CAST(f.lang = m.lang AS INTEGER)), 6) AS accuracy FROM f JOIN m USING (fold) GROUP BY 1, 2""")
def _(s, d):
    return ev.majority_baseline(ev.fold_hashed(scores(s, d), key="doc_id"), "lang")


@query("base_naive_forecast", "WITH q AS (SELECT *, row_number() OVER (PARTITION BY public_id ORDER BY week_idx DESC) AS b FROM panel WHERE week_idx < 30) SELECT public_id, round(arg_max(sales_card, week_idx), 6) AS last, round(avg(sales_card) FILTER (WHERE b <= 4), 6) AS recent, round(avg(sales_card), 6) AS early, round(avg(sales_card) FILTER (WHERE week_idx BETWEEN 17 AND 28), 6) AS seasonal FROM q GROUP BY 1", tables="p")
def _(s, d):
    return ev.naive_forecasts(panel(s, d))


_P = "p AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS pred, CASE WHEN c_acctbal < 2000 THEN 'a' WHEN c_acctbal < 6000 THEN 'b' ELSE 'c' END AS truth FROM customer)"


def predictions(s, d):
    k, b = c("c_custkey") % 3, c("c_acctbal")
    return read_table(s, d, "customer").select("c_custkey", "c_mktsegment", F.when(k == 0, "a").when(k == 1, "b").otherwise("c").alias("pred"), F.when(b < 2000, "a").when(b < 6000, "b").otherwise("c").alias("truth"))


_CM = """k AS (SELECT x.c AS class, count(*) FILTER (WHERE truth = x.c) AS support, count(*) FILTER (WHERE pred = x.c) AS predicted, count(*) FILTER (WHERE truth = x.c AND pred = x.c) AS tp FROM p, (SELECT unnest(['a', 'b', 'c']) AS c) x GROUP BY 1),
m AS (SELECT class, support, tp / predicted::DOUBLE AS p, tp / support::DOUBLE AS r, 2 * tp / (support + predicted)::DOUBLE AS f FROM k)"""


@query("eval_multiclass", f"WITH {_P}, {_CM} SELECT class, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM m")
def _(s, d):
    return ev.class_metrics(predictions(s, d), "truth", "pred")


@query("eval_multiclass_overall", f"WITH {_P}, {_CM} SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(r * support) / sum(support), 6) AS accuracy, round(avg(f), 6) AS macro_f1, round(sum(f * support) / sum(support), 6) AS weighted_f1 FROM m")
def _(s, d):
    return ev.overall_metrics(predictions(s, d), "truth", "pred")


@query("eval_confusion", f"WITH {_P} SELECT truth, pred, count(*) AS n FROM p GROUP BY 1, 2")
def _(s, d):
    return ev.confusion(predictions(s, d), "truth", "pred")


@query("eval_auc", f"WITH {_S}, r AS (SELECT t, (2 * rank() OVER (ORDER BY score) + count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s), q AS (SELECT count(*) FILTER (WHERE t)::DOUBLE AS p, count(*) FILTER (WHERE NOT t)::DOUBLE AS n, sum(r) FILTER (WHERE t)::DOUBLE AS w FROM r) SELECT round((w - p * (p + 1) / 2) / (p * n), 6) AS auc FROM q")
def _(s, d):
    return ev.auc(scores(s, d), "score", toxic())


@query("eval_regression", "WITH e AS (SELECT public_id, sales_card AS y, trend AS p, avg(sales_card) OVER (PARTITION BY public_id) AS b FROM panel) SELECT count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(1 - avg((y - p) ** 2) / var_pop(y), 4) AS r2, round(sum(abs(y - p)) / sum(abs(y)), 4) AS wape, round(100 * (1 - avg(abs(y - p)) / avg(abs(y - b))), 4) AS mae_reduction_pct FROM e", tables="p", digits=4)
def _(s, d):
    from pyspark.sql import Window

    rows = panel(s, d).withColumn("b", F.avg("sales_card").over(Window.partitionBy("public_id")))
    return ev.regression_metrics(rows, "sales_card", "trend", baseline="b")


_OP = f"""{_S}, h AS (SELECT i, CAST(round(i * 0.05, 2) AS DOUBLE) AS threshold FROM range(1, 20) r(i)), o AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND t) AS tp, count(*) FILTER (WHERE score >= threshold AND NOT t) AS fp, count(*) FILTER (WHERE score < threshold AND t) AS fn, count(*) FILTER (WHERE score < threshold AND NOT t) AS tn FROM s, h GROUP BY 1)"""


@query("ews_operating_points", f"WITH {_OP} SELECT threshold, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, round((tp + fp) / (tp + fp + fn + tn)::DOUBLE, 6) AS flagged FROM o")
def _(s, d):
    return ev.operating_points(scores(s, d), "score", toxic())


@query("ews_cost", f"WITH {_OP}, u AS (SELECT scenario, threshold, tp * b - fp * k - fn * m AS utility FROM o, (VALUES ('low', 6, 3, 8), ('base', 10, 2, 8), ('high', 12, 1, 10)) v(scenario, b, k, m)) SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY utility DESC, threshold) = 1 AS is_best FROM u")
def _(s, d):
    return ev.cost_scenarios(ev.operating_points(scores(s, d), "score", toxic()), [("low", 6, 3, 8), ("base", 10, 2, 8), ("high", 12, 1, 10)])


_EDGES = ", ".join(f"quantile_cont(score, {i / 10})" for i in range(1, 10))


@query("ews_calibration", f"WITH {_S}, b AS (SELECT *, 1 + len(list_filter((SELECT list_distinct([{_EDGES}]) FROM s), lambda e: score > e)) AS bin FROM s) SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS predicted, round(avg(toxic), 6) AS observed, CAST(sum(toxic) AS BIGINT) AS cases, round(avg(toxic) - avg(score), 6) AS gap, round(sum(toxic) / (SELECT sum(toxic) FROM s)::DOUBLE, 6) AS capture FROM b GROUP BY 1")
def _(s, d):
    return ev.calibration_deciles(scores(s, d), "score", toxic())


@query("ews_reliability", f"WITH {_S} SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS predicted, round(avg(toxic), 6) AS observed FROM s GROUP BY 1")
def _(s, d):
    return ev.reliability(scores(s, d), "score", toxic())


@query("ews_brier_ap", f"WITH {_S}, a AS (SELECT score, sum(toxic) AS a FROM s GROUP BY 1), z AS (SELECT a, (SELECT count(*) FROM s x WHERE x.score >= a.score) AS seen, (SELECT sum(toxic) FROM s x WHERE x.score >= a.score) AS hits FROM a WHERE a > 0) SELECT (SELECT round(avg((score - toxic) ** 2), 6) FROM s) AS brier, (SELECT round(avg(toxic), 6) FROM s) AS base_rate, round(sum(a * hits / seen::DOUBLE) / sum(a), 6) AS average_precision FROM z")
def _(s, d):
    return ev.brier_ap(scores(s, d), "score", toxic())


@query("ews_top_decile", f"WITH {_S}, q AS (SELECT quantile_cont(score, 0.9) AS q FROM s) SELECT count(*) FILTER (WHERE score >= q) AS n_top, round(avg(toxic) FILTER (WHERE score >= q), 6) AS top_rate, round(avg(toxic), 6) AS base_rate, round(avg(toxic) FILTER (WHERE score >= q) / avg(toxic), 6) AS lift FROM s, q")
def _(s, d):
    return ev.top_decile(scores(s, d), "score", toxic())


@query("ews_segment", f"WITH {_S} SELECT source, count(*) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(stddev_samp(score), 6) AS sd FROM s GROUP BY 1 HAVING count(*) >= 15 ORDER BY avg(score) DESC, source LIMIT 8")
def _(s, d):
    return ev.segment_scores(scores(s, d), "source", "score", least=15)


@query("model_subgroup", f"WITH {_P} SELECT c_mktsegment, count(*) AS n, round(avg(CAST(truth = pred AS INTEGER)), 6) AS accuracy FROM p JOIN customer USING (c_custkey) GROUP BY 1")
def _(s, d):
    return predictions(s, d).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.avg((c("truth") == c("pred")).cast("int")).alias("accuracy"))
