"""Evaluation of predictions and early-warning scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.columns import ratio
from weekloom.operators.ordering import group_quantiles, quantiles, running_counts
from weekloom.operators.statistics import average_ranks

c = F.col
THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 20)]


def hashed(key: str, seed: int = 0) -> Column:
    """A number below 1,000,003 from an integer id, in plain integer arithmetic."""
    return ((c(key).cast("long") + seed) * 2654435761) % 1000003


def fold_stratified(df: DataFrame, label: str, *, key: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Fold by rank of the hashed key inside each class, so classes are spread evenly.

    Ranks are counted in buckets of the hash, so no task sorts a class; rows of
    one hash go by their key. A null class is a class.
    """
    rows = df.withColumns({"_h": hashed(key, seed), "_l": F.struct(label)})
    before = running_counts(rows, "_h", by=["_l"]).select("_l", "_h", (c("upto") - c("n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_l", "_h").orderBy(key)) - 1
    out = rows.withColumn("_place", place).join(before, ["_l", "_h"], "left")
    return out.withColumn("fold", ((F.coalesce("_before", F.lit(0)) + c("_place")) % k).cast("int")).select(*df.columns, "fold")


def fold_hashed(df: DataFrame, *, key: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Fold by hash alone: no shuffle, for tables with few huge classes."""
    return df.withColumn("fold", hashed(key, seed) % k)


def split_time(df: DataFrame, opened: str) -> DataFrame:
    """train: opened no later than the median opening day; else test."""
    day = F.datediff(opened, F.lit("1970-01-01").cast("date"))
    med = quantiles(df, [day], [0.5]).select(c("_q")[0][0].alias("_m"))
    return df.crossJoin(F.broadcast(med)).withColumn("part", F.when(day <= c("_m"), "train").otherwise("test")).drop("_m")


def target_encode(df: DataFrame, category: str, target: str, *, fold: str = "fold", m: float = 50.0) -> DataFrame:
    """Smoothed category mean from the other folds: totals less the fold's own; unseen categories get the global mean."""
    own = df.groupBy(fold, category).agg(F.sum(target).alias("fs"), F.count(target).alias("fn"))
    cat = df.groupBy(category).agg(F.sum(target).alias("cs"), F.count(target).alias("cn"))
    folds = df.groupBy(fold).agg(F.sum(target).alias("gs"), F.count(target).alias("gn"))
    total = df.agg(F.sum(target).alias("ts"), F.count(target).alias("tn"))
    out = df.join(own, [fold, category]).join(cat, category).join(F.broadcast(folds), fold).crossJoin(F.broadcast(total))
    mean = ratio(c("ts") - c("gs"), c("tn") - c("gn"))
    return out.withColumn("encoded", (c("cs") - c("fs") + m * mean) / (c("cn") - c("fn") + m)).drop("fs", "fn", "cs", "cn", "gs", "gn", "ts", "tn")


def majority_baseline(df: DataFrame, label: str, *, fold: str = "fold") -> DataFrame:
    """Accuracy in each fold of the other folds' most frequent class, ties to the first name."""
    counts = df.groupBy(fold, label).agg(F.count("*").alias("n"))
    total = counts.groupBy(label).agg(F.sum("n").alias("t"))
    cells = counts.select(fold).distinct().crossJoin(F.broadcast(total)).join(counts, [fold, label], "left").withColumn("rest", c("t") - F.coalesce("n", F.lit(0)))
    best = cells.withColumn("r", F.row_number().over(Window.partitionBy(fold).orderBy(F.desc("rest"), label))).where("r = 1")
    sizes = counts.groupBy(fold).agg(F.sum("n").alias("size"))
    return best.join(sizes, fold).select(fold, c(label).alias("majority"), ratio(F.coalesce("n", F.lit(0)), c("size")).alias("accuracy"))


def naive_forecasts(panel: DataFrame, *, entity: str = "public_id", order: str = "week_idx", value: str = "sales_card", weeks: int = 30) -> DataFrame:
    """Last value, mean of the last 4 weeks, mean of all, and seasonal mean of weeks 17..28 (else recent) before ``weeks``."""
    rows = panel.where(c(order) < weeks).withColumn("_b", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc(order))))
    out = rows.groupBy(entity).agg(F.max_by(value, order).alias("last"), F.avg(F.when(c("_b") <= 4, c(value))).alias("recent"), F.avg(value).alias("early"), F.avg(F.when(c(order).between(17, 28), c(value))).alias("_s"))
    return out.select(entity, "last", "recent", "early", F.coalesce("_s", "recent").alias("seasonal"))


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(truth, pred).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """precision, recall, f1 and support of each class, from the confusion counts; undefined is 0."""
    cells = confusion(df, truth, pred)
    hit = cells.where(c(truth) == c(pred)).select(c(truth).alias("class"), c("n").alias("tp"))
    rows, cols = cells.groupBy(c(truth).alias("class")).agg(F.sum("n").alias("support")), cells.groupBy(c(pred).alias("class")).agg(F.sum("n").alias("predicted"))
    out = rows.join(cols, "class", "outer").join(hit, "class", "left").fillna(0)
    p, r = F.coalesce(ratio(c("tp"), c("predicted")), F.lit(0.0)), F.coalesce(ratio(c("tp"), c("support")), F.lit(0.0))
    return out.select("class", "support", p.alias("precision"), r.alias("recall"), F.coalesce(ratio(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def overall_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Accuracy, macro and weighted F1."""
    m = class_metrics(df, truth, pred)
    return m.agg(F.sum("support").alias("n"), ratio(F.sum(c("recall") * c("support")), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), ratio(F.sum(c("f1") * c("support")), F.sum("support")).alias("weighted_f1"))


def auc(df: DataFrame, score: str, truth: Column) -> DataFrame:
    """Area under the ROC curve from average ranks, ties shared."""
    rows = df.select(c(score), truth.alias("_t"))
    cells = rows.groupBy(score).agg(F.count_if("_t").alias("a"), F.count("*").alias("m")).join(average_ranks(rows, score).select(score, "rank"), score)
    one = cells.agg(F.sum(c("a") * c("rank")).alias("r"), F.sum("a").cast("double").alias("p"), F.sum(c("m") - c("a")).cast("double").alias("q"))
    return one.select(ratio(c("r") - c("p") * (c("p") + 1) / 2, c("p") * c("q")).alias("auc"))


def regression_metrics(df: DataFrame, truth: str, pred: str, *, baseline: str | None = None) -> DataFrame:
    """MAE, RMSE, R2, WAPE, and the fall of MAE against a baseline in percent."""
    e = c(truth) - c(pred)
    extra = [(100 * (1 - ratio(F.avg(F.abs(e)), F.avg(F.abs(c(truth) - c(baseline)))))).alias("mae_reduction_pct")] if baseline else []
    return df.agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - ratio(F.avg(e * e), F.var_pop(truth))).alias("r2"), ratio(F.sum(F.abs(e)), F.sum(F.abs(truth))).alias("wape"), *extra)


def operating_points(df: DataFrame, score: str, truth: Column, *, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and flagged share at each threshold: one pass, all counts in one row."""
    cells = reduce(list.__add__, [[F.count_if((c(score) >= t) & truth).alias(f"tp{i}"), F.count_if((c(score) >= t) & ~truth).alias(f"fp{i}")] for i, t in enumerate(thresholds)])
    one = df.agg(F.count_if(truth).alias("p"), F.count_if(~truth).alias("q"), *cells)
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), c(f"tp{i}").alias("tp"), c(f"fp{i}").alias("fp")) for i, t in enumerate(thresholds))))
    out = one.select("p", "q", each.alias("x")).select("x.*", (c("p") - c("x.tp")).alias("fn"), (c("q") - c("x.fp")).alias("tn"))
    p, r = F.coalesce(ratio(c("tp"), c("tp") + c("fp")), F.lit(0.0)), F.coalesce(ratio(c("tp"), c("tp") + c("fn")), F.lit(0.0))
    return out.withColumns({"precision": p, "recall": r}).withColumns({"f1": F.coalesce(ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")), F.lit(0.0)), "flagged": ratio(c("tp") + c("fp"), c("tp") + c("fp") + c("fn") + c("tn"))})


def cost_scenarios(points: DataFrame, scenarios: list[tuple[str, int, int, int]]) -> DataFrame:
    """Utility tp * benefit - fp * cost - fn * miss by scenario and threshold; is_best marks the first maximum."""
    s = F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(b).alias("b"), F.lit(k).alias("k"), F.lit(m).alias("m")) for n, b, k, m in scenarios)))
    out = points.select("*", s.alias("s")).select(c("s.scenario").alias("scenario"), "threshold", (c("tp") * c("s.b") - c("fp") * c("s.k") - c("fn") * c("s.m")).alias("utility"))
    best = Window.partitionBy("scenario").orderBy(F.desc("utility"), "threshold")
    return out.withColumn("is_best", F.row_number().over(best) == 1)


def calibration_deciles(df: DataFrame, score: str, truth: Column, *, n: int = 10) -> DataFrame:
    """Equal-frequency score bins: predicted and observed rate, gap, cases, capture share."""
    from weekloom.operators.summaries import bin_right_closed

    rows = bin_right_closed(df.select(c(score), truth.cast("int").alias("_t")), score, n)
    out = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("predicted"), F.avg("_t").alias("observed"), F.sum("_t").alias("cases"))
    total = out.agg(F.sum("cases").alias("_c"))
    return out.crossJoin(F.broadcast(total)).withColumn("gap", c("observed") - c("predicted")).withColumn("capture", ratio(c("cases"), c("_c"))).drop("_c")


def reliability(df: DataFrame, score: str, truth: Column, *, n: int = 10) -> DataFrame:
    """Uniform score bins."""
    b = F.least(F.floor(c(score) * n), F.lit(n - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("predicted"), F.avg(truth.cast("int")).alias("observed"))


def brier_ap(df: DataFrame, score: str, truth: Column) -> DataFrame:
    """Brier score, base rate and average precision; equal scores are one step."""
    t = truth.cast("double")
    one = df.agg(F.avg((c(score) - t) * (c(score) - t)).alias("brier"), F.avg(t).alias("base_rate"))
    rows = df.select((-c(score)).alias("_s"), truth.alias("_t"))
    steps = rows.groupBy("_s").agg(F.count("*").alias("m"), F.count_if("_t").alias("a"))
    seen = average_ranks(rows, "_s").select("_s", (c("rank") + (c("n") - 1) / 2).alias("seen"))
    hits = average_ranks(rows.where("_t"), "_s").select("_s", (c("rank") + (c("n") - 1) / 2).alias("hits"))
    ap = steps.where("a > 0").join(seen, "_s").join(hits, "_s").agg(ratio(F.sum(c("a") * c("hits") / c("seen")), F.sum("a")).alias("average_precision"))
    return one.crossJoin(ap)


def top_decile(df: DataFrame, score: str, truth: Column, *, at: float = 0.9) -> DataFrame:
    """Rate among scores at or above the percentile, base rate and lift."""
    cut = quantiles(df, [score], [at]).select(c("_q")[0][0].alias("_q"))
    rows = df.select(c(score), truth.cast("int").alias("_t")).crossJoin(F.broadcast(cut))
    top = F.avg(F.when(c(score) >= c("_q"), c("_t")))
    return rows.agg(F.count_if(c(score) >= c("_q")).alias("n_top"), top.alias("top_rate"), F.avg("_t").alias("base_rate"), ratio(top, F.avg("_t")).alias("lift"))


def segment_scores(df: DataFrame, segment: str, score: str, *, least: int = 500, keep: int = 8) -> DataFrame:
    medians = group_quantiles(df, [segment], score, [0.5]).select(c(segment).alias("_s"), c("_q")[0].alias("median"))
    out = df.groupBy(segment).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"))
    out = out.join(medians, c(segment).eqNullSafe(c("_s")), "left").select(segment, "n", "mean", "median", "sd")
    return out.where(c("n") >= least).orderBy(F.desc("mean"), segment).limit(keep)
