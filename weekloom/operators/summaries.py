"""Group summaries, cross tables, bins, rankings and screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.columns import ratio
from weekloom.operators.ordering import quantiles

c = F.col


def summary_by_label(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """n, mean, sd, quartiles, min and max of columns by label, long form."""
    long = df.unpivot([label], columns, "metric", "value")
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = long.groupBy(label, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), q.alias("q"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.select(label, "metric", "n", "mean", "sd", c("q")[0].alias("q25"), c("q")[1].alias("median"), c("q")[2].alias("q75"), "low", "high")


def crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    """Counts of two labels in long form with row shares; margins are the cube's totals, written ``All``."""
    both = df.cube(row, col).agg(F.count("*").alias("n"), F.grouping(row).alias("_r"), F.grouping(col).alias("_c"))
    out = both.select(F.when(c("_r") == 1, "All").otherwise(c(row)).alias(row), F.when(c("_c") == 1, "All").otherwise(c(col)).alias(col), "n")
    totals = out.where(c(col) == "All").select(c(row).alias("_k"), c("n").alias("_t"))
    return out.join(totals, c(row) == c("_k")).select(row, col, "n", ratio(c("n"), c("_t")).alias("share"))


def bin_right_closed(df: DataFrame, column: str, n: int, *, name: str = "bin") -> DataFrame:
    """Equal-frequency bins with interpolated, right-closed edges; equal edges count once, so bins may be fewer. First bin is 1."""
    edges = quantiles(df, [column], [i / n for i in range(1, n)]).select(F.array_distinct(c("_q")[0]).alias("_e"))
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.when(c(column).isNotNull(), 1 + F.size(F.filter("_e", lambda e: c(column) > e)))).drop("_e")


def bin_rates(df: DataFrame, bin_: str, hits: dict[str, Column]) -> DataFrame:
    return df.groupBy(bin_).agg(F.count("*").alias("n"), *(F.avg(v.cast("int")).alias(k) for k, v in hits.items()))


def shares_in_group(df: DataFrame, group: list[str], label: str) -> DataFrame:
    """n and share of each label inside the group; the window runs on the small counts."""
    counts = df.groupBy(*group, label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", ratio(c("n"), F.sum("n").over(Window.partitionBy(*group))))


def relative_ratio(df: DataFrame, value: str, cluster: str, *, min_total: int = 30) -> DataFrame:
    """Share of each value that falls in a cluster, for values with enough rows."""
    out = df.groupBy(value, cluster).agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy(value)))
    return out.where(c("total") >= min_total).withColumn("ratio", ratio(c("n"), c("total")))


def success_rate(df: DataFrame, cluster: str, hit: Column) -> DataFrame:
    """Rate by cluster, and the variance of rates across clusters on every row."""
    rates = df.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(hit.cast("int")).alias("rate"))
    return rates.crossJoin(F.broadcast(rates.agg(F.var_pop("rate").alias("rate_variance"))))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(c("rank") <= k)


def select_examples(df: DataFrame, rules: list[tuple[str, Column, Column]], *, entity: str) -> DataFrame:
    """One entity for each rule in turn, none twice: each rule's first by its order among those not yet taken.

    A rule needs no more than its first len(rules) rows, so only those are kept.
    """
    n = len(rules)
    ranked = None
    for i, (name, condition, order) in enumerate(rules):
        best = df.where(condition).orderBy(order, entity).limit(n).withColumn("_o", F.row_number().over(Window.orderBy(order, entity))).select(F.lit(i).alias("i"), F.lit(name).alias("rule"), entity, "_o")
        ranked = best if ranked is None else ranked.union(best)
    taken = df.sparkSession.createDataFrame([], f"i int, rule string, {entity} {dict(df.dtypes)[entity]}")
    for i in range(n):
        free = ranked.where(c("i") == i).join(taken.select(entity), entity, "left_anti").orderBy("_o").limit(1).select("i", "rule", entity)
        taken = taken.union(free)
    return taken.select("rule", entity)


def eta_squared(df: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """Between-group share of variance of each column."""
    long = df.unpivot([cluster], columns, "feature", "v").where("v IS NOT NULL")
    groups = long.groupBy("feature", cluster).agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(c("v") * c("v")).alias("ss"))
    out = groups.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(c("s") * c("s") / c("n")).alias("b"))
    mean = c("s") * c("s") / c("n")
    return out.select("feature", F.coalesce(F.when(c("ss") - mean > 1e-12, (c("b") - mean) / F.nullif(c("ss") - mean, F.lit(0.0))), F.lit(0.0)).alias("score"))


def cramers_v(df: DataFrame, cluster: str, column: str) -> DataFrame:
    """Cramer's V of a category against a cluster: chi2 from cell counts and margins."""
    cells = df.groupBy(column, cluster).agg(F.count("*").alias("n"))
    cells = cells.withColumn("r", F.sum("n").over(Window.partitionBy(column))).withColumn("k", F.sum("n").over(Window.partitionBy(cluster)))
    one = cells.agg(F.sum("n").alias("t"), F.sum(c("n") * c("n") / (c("r") * c("k"))).alias("q"), F.count_distinct(column).alias("nr"), F.count_distinct(cluster).alias("nk"))
    return one.select(F.lit(column).alias("feature"), F.sqrt(F.greatest(c("q") - 1, F.lit(0.0)) / F.greatest(F.least(c("nr") - 1, c("nk") - 1), F.lit(1))).alias("score"))
