"""Outcome and life-cycle labels. Global thresholds are one-row aggregates, broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.functions.columns import ratio
from weekloom.operators.ordering import quantiles

c = F.col


def band(x: Column, threshold: Column) -> Column:
    return F.when(x > threshold, "Growth").when(x < -threshold, "Decline").otherwise("Stable")


def label_outcome3(df: DataFrame, *, slope: str = "slope_all_mm", k: float = 0.5, ddof: int = 1, spec: list[str] | None = None) -> DataFrame:
    """Growth above k sigma of all slopes, Decline below -k sigma, else Stable; sigma of the whole table or of each ``spec``."""
    sigma = (F.stddev_samp if ddof else F.stddev_pop)(slope).alias("_sigma")
    joined = df.join(df.groupBy(*spec).agg(sigma), spec) if spec else df.crossJoin(F.broadcast(df.agg(sigma)))
    return joined.withColumn("outcome_3", band(c(slope), k * F.coalesce("_sigma", F.lit(0.0)))).drop("_sigma")


def label_12class(df: DataFrame, *, early: str = "slope_early_mm", late: str = "slope_late_mm") -> DataFrame:
    """Early sign, late sign, and X/Y/Z for Growth/Stable/Decline. Needs outcome_3."""
    sign = lambda x: F.when(c(x) > 0, "U").otherwise("D")
    suffix = F.when(c("outcome_3") == "Growth", "X").when(c("outcome_3") == "Stable", "Y").otherwise("Z")
    return df.withColumn("label", F.concat(sign(early), sign(late), F.lit("_"), suffix))


def label_6class(df: DataFrame, *, early: str = "slope_early_mm", late: str = "slope_late_mm", drop: str = "mdd") -> DataFrame:
    """Sign pair and high or low drawdown by the median; a falling pair counts as one whatever its drawdown."""
    med = quantiles(df, [drop], [0.5]).select(c("_q")[0][0].alias("_m"))
    pair = F.concat(F.when(c(early) > 0, "U").otherwise("D"), F.when(c(late) > 0, "U").otherwise("D"))
    return df.crossJoin(F.broadcast(med)).withColumn("label6", F.concat_ws("_", pair, F.when(c(drop) > c("_m"), "high").otherwise("low"))).drop("_m")


def label_terciles(df: DataFrame, *, slope: str = "slope_late_mm") -> DataFrame:
    """X in the upper third of late slopes, D in the lower, else U."""
    q = quantiles(df, [slope], [0.33, 0.67]).select(c("_q")[0].alias("_q"))
    return df.crossJoin(F.broadcast(q)).withColumn("udx", F.when(c(slope) >= c("_q")[1], "X").when(c(slope) <= c("_q")[0], "D").otherwise("U")).drop("_q")


def label_edge_change(df: DataFrame, *, first: str = "first_mean", last: str = "last_mean", slope: str = "log_slope", band_: float = 0.08, epsilon: float = 0.0) -> DataFrame:
    """X/Y/Z from the change between edge means, U/D from a slope with epsilon; a zero start gives 0 or 1."""
    change = F.coalesce(ratio(c(last) - c(first), F.abs(first)), F.when(c(last) > 0, 1.0).otherwise(0.0))
    return df.withColumns({"edge_change": change, "edge_label": F.concat(F.when(c(slope) >= epsilon, "U").otherwise("D"), F.when(change >= band_, "X").when(change <= -band_, "Z").otherwise("Y"))})


def label_final_code(inflection: DataFrame, clusters: DataFrame, patterns: dict[int, str], *, entity: str = "public_id") -> DataFrame:
    """Three-letter code: signs before and after the inflection, and the cluster's pattern; its life-cycle category."""
    out = inflection.join(clusters, entity)
    pattern = F.coalesce(*(F.when(c("cluster") == k, v) for k, v in patterns.items()), F.lit("Y"))
    code = F.concat(F.when(c("pre_slope") > 0, "U").otherwise("D"), F.when(c("post_slope") > 0, "U").otherwise("D"), pattern)
    out = out.withColumn("final_code", code)
    stage = F.when(c("final_code").startswith("UU"), "growth").when(c("final_code").startswith("UD"), "maturity").when(c("final_code").startswith("DU"), "recovery").otherwise("decline")
    return out.withColumn("life_stage", stage).withColumn("pattern", F.substring("final_code", 3, 1))


def label_outcome4(df: DataFrame, *, code: str = "final_code") -> DataFrame:
    """Recode of the code: UU, DU, UD, DD."""
    two = F.substring(code, 1, 2)
    return df.withColumn("outcome4", F.when(two == "UU", "sustained").when(two == "DU", "rebound").when(two == "UD", "reversal").otherwise("falling"))


def label_growth_binary(df: DataFrame, *, rate: str = "growth_rate", at: float = 1.0) -> DataFrame:
    return df.withColumn("grew", F.when(c(rate).isNotNull(), (c(rate) >= at).cast("int")))


def label_alt_rules(df: DataFrame, *, growth: str = "edge_growth", weeks: str = "weeks") -> DataFrame:
    """Three other rules: upper/lower 30 %, upper/lower 20 %, and sign gated by the median of weeks."""
    q = quantiles(df, [growth, weeks], [0.3, 0.7, 0.2, 0.8, 0.5]).select(c("_q")[0].alias("_q"), c("_q")[1][4].alias("_m"))
    g = c(growth)
    tri = lambda lo, hi: F.when(g >= hi, "Growth").when(g <= lo, "Decline").otherwise("Stable")
    gated = F.when(c(weeks) < c("_m"), "Stable").when(g > 0, "Growth").when(g < 0, "Decline").otherwise("Stable")
    return df.crossJoin(F.broadcast(q)).withColumns({"rule_30": tri(c("_q")[0], c("_q")[1]), "rule_20": tri(c("_q")[2], c("_q")[3]), "rule_gated": gated}).drop("_q", "_m")


def label_threshold_sweep(df: DataFrame, ks: list[float], *, slope: str = "slope_all_mm") -> DataFrame:
    """Class shares for every k."""
    sigma = df.agg(F.stddev_pop(slope).alias("_s"), F.count("*").alias("_n"))
    rows = df.crossJoin(F.broadcast(sigma)).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return rows.withColumn("outcome_3", band(c(slope), c("k") * c("_s"))).groupBy("k", "outcome_3").agg(F.count("*").alias("n"), ratio(F.count("*"), F.first("_n")).alias("share"))


def label_closure(df: DataFrame, *, last: str = "last_date", opened: str = "open_date", cutoffs: tuple[int, ...] = (4,)) -> DataFrame:
    """For every cutoff: closed if the last week lies at least so many weeks before the end of the table; survival weeks since opening."""
    end = df.agg(F.max(last).alias("_end"))
    rows = df.crossJoin(F.broadcast(end)).withColumn("weeks_to_end", F.greatest(F.floor(F.datediff("_end", last) / 7), F.lit(0)))
    rows = rows.withColumn("survival_weeks", F.greatest(F.floor(F.datediff(last, opened) / 7), F.lit(0)))
    rows = rows.withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs))))
    return rows.withColumn("is_closed", (c("weeks_to_end") >= c("cutoff")).cast("int")).drop("_end")
