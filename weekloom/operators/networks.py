"""Edges between entities of a cell, and collaboration tables of many-owner records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.columns import ratio
from weekloom.operators.ordering import quantiles, running_counts

c = F.col


def cell_edges(df: DataFrame, keys: list[str], *, entity: str, degree: int = 30, seed: int = 7) -> DataFrame:
    """Ring edges inside each cell: members in hashed order, each linked to the next min(degree, n - 1).

    Linear in members however large a cell is. Rows with a null key have no edges. A number below 1,000,003 from the id gives the order.
    """
    rows = df.dropna(subset=keys).select(*keys, entity)
    w = Window.partitionBy(*keys)
    order = w.orderBy(((c(entity).cast("long") + seed) * 2654435761) % 1000003, entity)
    rows = rows.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(w)).where("n > 1")
    steps = rows.withColumn("shift", F.explode(F.sequence(F.lit(1), F.least(F.lit(degree), c("n") - 1).cast("int"))))
    source = steps.select(*keys, c(entity).alias("src"), ((c("i") + c("shift")) % c("n")).alias("i"))
    return source.join(rows.select(*keys, c(entity).alias("dst"), "i"), [*keys, "i"]).select("src", "dst")


def normalised_weights(edges: DataFrame) -> DataFrame:
    """Edges both ways with self loops, weighted 1 / sqrt(degree * degree)."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    nodes = both.select("src").distinct()
    full = both.union(nodes.select("src", c("src").alias("dst")))
    degree = full.groupBy("src").agg(F.count("*").alias("d"))
    return full.join(degree.withColumnRenamed("d", "du"), "src").join(degree.select(c("src").alias("dst"), c("d").alias("dv")), "dst").select("src", "dst", (1 / F.sqrt(c("du") * c("dv"))).alias("weight"))


def triadic_share(df: DataFrame, by: list[str], flag: str, *, least: int = 0) -> DataFrame:
    """Records, flagged ones and their share by group."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(flag).alias("triadic"), F.avg(c(flag).cast("int")).alias("share")).where(c("n") >= least)


def two_mode_edges(owners: DataFrame, *, record: str, owner: str, kind: str, a: str, b: str, by: str) -> DataFrame:
    """Pairs (owner of kind a, owner of kind b) of one record, counted by year. Records have few owners, so pairs stay few."""
    one = owners.select(record, by, owner, kind).distinct()
    left, right = one.where(c(kind) == a).select(record, by, c(owner).alias("a")), one.where(c(kind) == b).select(record, c(owner).alias("b"))
    return left.join(right, record).groupBy(by, "a", "b").agg(F.count("*").alias("n"))


def one_mode_edges(owners: DataFrame, *, record: str, owner: str, kind: str, a: str) -> DataFrame:
    """Pairs a < b of owners of one kind on one record, counted."""
    one = owners.where(c(kind) == a).select(record, owner).distinct()
    return one.select(record, c(owner).alias("a")).join(one.select(record, c(owner).alias("b")), record).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def partner_concentration(edges: DataFrame, *, unit: str = "a", partner: str = "b", top: int = 20) -> DataFrame:
    """Of the units with most joint records: partners, records and the Herfindahl index of partners."""
    cells = edges.groupBy(unit, partner).agg(F.sum("n").alias("n"))
    out = cells.groupBy(unit).agg(F.count("*").alias("partners"), F.sum("n").alias("records"), F.sum(c("n") * c("n")).alias("q"))
    return out.withColumn("hhi", ratio(c("q"), c("records") * c("records"))).drop("q").orderBy(F.desc("records"), unit).limit(top)


def match_rate(left: DataFrame, right: DataFrame, *, key: str) -> DataFrame:
    """Distinct names of the left table, those found in the right one, and their share."""
    a = left.select(key).distinct()
    b = right.select(key).distinct().withColumn("_m", F.lit(1))
    return a.join(b, key, "left").agg(F.count("*").alias("n"), F.count("_m").alias("matched"), ratio(F.count("_m"), F.count("*")).alias("rate"))


def percentile_panel(df: DataFrame, *, unit: str, year: str, value: str) -> DataFrame:
    """0-100 percentile rank inside each year, counted in buckets of values; nulls come first, and a null year is a year."""
    lowest = F.coalesce(c(value).cast("double"), F.lit(float("-inf")))
    rows = df.withColumns({"_v": lowest, "_y": F.struct(year)})
    rank = running_counts(rows, "_v", by=["_y"]).select("_y", "_v", F.when(c("total") > 1, (c("upto") - c("n")) / (c("total") - 1)).otherwise(0.0).alias("_r"))
    return rows.join(rank, ["_y", "_v"]).withColumn("pct", 100 * c("_r")).select(*df.columns, "pct")


def mobility(ranked: DataFrame, *, unit: str, year: str) -> DataFrame:
    """Range, last less first, and whether the unit began in the middle (25-75)."""
    return ranked.groupBy(unit).agg((F.max("pct") - F.min("pct")).alias("range"), (F.max_by("pct", year) - F.min_by("pct", year)).alias("mobility"), F.min_by("pct", year).between(25, 75).alias("mid_start"))


def yoy_volatility(df: DataFrame, *, unit: str, year: str, value: str) -> DataFrame:
    """Deviation of log values and mean absolute log change of each unit."""
    d = F.log1p(value) - F.lag(F.log1p(value)).over(Window.partitionBy(unit).orderBy(year))
    return df.withColumn("_d", d).groupBy(unit).agg(F.stddev_samp(F.log1p(value)).alias("volatility"), F.avg(F.abs("_d")).alias("mean_abs_change"))


def lagged_corr(df: DataFrame, lags: list[int], *, unit: str, year: str, x: str, y: str) -> DataFrame:
    """Pearson of x with y some years later, by lag."""
    from weekloom.operators.statistics import safe_corr

    a = df.select(unit, c(year).alias("_y"), c(x).cast("double").alias("x")).withColumn("lag", F.explode(F.array(*map(F.lit, lags))))
    b = df.select(unit, c(year).alias("_z"), c(y).cast("double").alias("y"))
    both = a.join(b, (a[unit] == b[unit]) & (c("_z") == c("_y") + c("lag")))
    return both.groupBy("lag").agg(F.count("*").alias("n"), safe_corr("x", "y").alias("pearson"))


def impute_unit(df: DataFrame, *, unit: str, year: str, value: str, count: bool = False, low: float = 0.0, high: float | None = None) -> DataFrame:
    """Interpolation inside the unit, not below ``low`` nor above ``high``, rounded for counts."""
    from weekloom.operators.panel import interp_linear

    out = interp_linear(df, entity=unit, order=year, value=value)
    v = F.greatest(c(value), F.lit(low))
    v = F.least(v, F.lit(high)) if high is not None else v
    return out.withColumn(value, F.when(c(value).isNotNull(), F.round(v) if count else v))


def paradox_cases(df: DataFrame, *, high: str, low: str, at: float = 0.75) -> DataFrame:
    """Rows in the upper part of one measure and the lower part of another."""
    q = quantiles(df, [high, low], [at, 1 - at]).select(c("_q")[0][0].alias("_h"), c("_q")[1][1].alias("_l"))
    return df.crossJoin(F.broadcast(q)).where((c(high) >= c("_h")) & (c(low) <= c("_l"))).drop("_h", "_l")
