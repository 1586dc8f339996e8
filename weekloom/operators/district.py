"""Local competition, district vitality, and external facts by district and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.columns import ratio
from weekloom.operators.statistics import safe_corr

c = F.col


def competition_index(df: DataFrame, place: str, category: str) -> DataFrame:
    """n_total, n_same, share and log1p of it for each row, from partial counts joined back: a dominant cell is summed map-side."""
    cells = df.groupBy(place, category).agg(F.count("*").alias("n_same"))
    totals = cells.groupBy(place).agg(F.sum("n_same").alias("n_total"))
    small = cells.join(totals, place)
    out = df.join(small, [place, category], "left")
    share = ratio(c("n_same"), c("n_total"))
    return out.withColumn("comp_share", share).withColumn("log_comp", F.log1p(share))


def hhi(df: DataFrame, place: str, category: str) -> DataFrame:
    """Herfindahl index of categories, rows, number of categories and mean competition share of each place."""
    cells = df.groupBy(place, category).agg(F.count("*").alias("n"))
    out = cells.groupBy(place).agg(F.sum("n").alias("n_total"), F.count("*").alias("n_categories"), F.sum(c("n") * c("n")).alias("q"))
    return out.select(place, "n_total", "n_categories", ratio(c("q"), c("n_total") * c("n_total")).alias("hhi"))


def category_shares(df: DataFrame, place: str, category: str, levels: list[str]) -> DataFrame:
    """Share of each category in a place, wide."""
    return df.groupBy(place).agg(*(F.avg(F.coalesce((c(category) == v).cast("int"), F.lit(0))).alias(f"share_{v}") for v in levels))


def competition_two_level(df: DataFrame, near: str, far: str, category: str) -> DataFrame:
    a = competition_index(df, near, category).withColumnsRenamed({"n_total": "n_near", "n_same": "same_near", "comp_share": "share_near"}).drop("log_comp")
    return competition_index(a, far, category).withColumnsRenamed({"n_total": "n_far", "n_same": "same_far", "comp_share": "share_far"}).drop("log_comp")


def geo_stats(df: DataFrame, near: str, far: str, value: str) -> DataFrame:
    """Rows and mean value of each near and far place, and the share of the far place's rows in the near one."""
    a = df.groupBy(far, near).agg(F.count("*").alias("n_near"), F.avg(value).alias("mean_near"))
    b = df.groupBy(far).agg(F.count("*").alias("n_far"), F.avg(value).alias("mean_far"))
    return a.join(b, far).withColumn("density", ratio(c("n_near"), c("n_far")))


def vitality(df: DataFrame, place: str, *, outcome: str = "outcome_3", trend: str = "trend") -> DataFrame:
    """Five indices of growth over decline: balance, log odds, mean trend, median trend, shrunk balance."""
    g, d, n = F.count_if(c(outcome) == "Growth"), F.count_if(c(outcome) == "Decline"), F.count("*")
    return df.groupBy(place).agg(n.alias("n"), g.alias("growth"), d.alias("decline"), ratio(g - d, n).alias("v1"), F.ln((g + 0.5) / (d + 0.5)).alias("v2"), F.avg(trend).alias("v3"), F.percentile(trend, F.lit(0.5)).alias("v4"), ratio(g - d, n + 20).alias("v5"))


def active_interval(spells: DataFrame, *, place: str, start: str, end: str) -> DataFrame:
    """Open, closed within, and closure rate by place and month.

    Active: started on or before the month's first day, and not ended or ended
    after its last. Each spell is two events and a running sum over months, so
    the work is linear in spells and in place-months; nothing is joined by range.
    """
    first = F.to_date(F.date_trunc("month", start))
    from_month = F.when(c(start) == first, first).otherwise(F.add_months(first, 1))
    ended = F.to_date(F.date_trunc("month", end))
    opens = spells.where(c(start).isNotNull()).select(place, from_month.alias("month"), F.lit(1).alias("delta"), F.lit(0).alias("closed"))
    last = F.when(ended < from_month, from_month).otherwise(ended)
    closes = spells.where(c(start).isNotNull() & c(end).isNotNull()).select(place, last.alias("month"), F.lit(-1).alias("delta"), F.lit(0).alias("closed"))
    closures = spells.where(c(end).isNotNull()).select(place, ended.alias("month"), F.lit(0).alias("delta"), F.lit(1).alias("closed"))
    events = opens.union(closes).union(closures).groupBy(place, "month").agg(F.sum("delta").alias("delta"), F.sum("closed").alias("closed"))
    span = events.groupBy(place).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    months = span.select(place, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    rows = months.join(events, [place, "month"], "left").fillna(0, ["delta", "closed"])
    run = Window.partitionBy(place).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(place, "month", F.sum("delta").over(run).alias("active"), c("closed").alias("closures")).withColumn("rate", ratio(c("closures"), c("active")))


def monthly_from_hours(df: DataFrame, *, place: str, at: str, value: Column) -> DataFrame:
    """Mean by day, then mean of days by month."""
    daily = df.groupBy(place, F.to_date(at).alias("day")).agg(value.alias("v"))
    return daily.groupBy(place, F.to_date(F.date_trunc("month", "day")).alias("month")).agg(F.avg("v").alias("population"))


def address_district(df: DataFrame, road: str, lot: str, pattern: str) -> DataFrame:
    """The road address if it isn't blank, else the lot address; district by pattern, null without a match."""
    address = F.coalesce(F.nullif(F.trim(road), F.lit("")), F.nullif(F.trim(lot), F.lit("")))
    return df.withColumn("address", address).withColumn("district", F.nullif(F.regexp_extract("address", pattern, 1), F.lit("")))


def first_last_change(df: DataFrame, *, place: str, period: str, value: str) -> DataFrame:
    """First, last (by period) and mean value, and percent change."""
    out = df.groupBy(place).agg(F.min_by(value, period).alias("first"), F.max_by(value, period).alias("last"), F.avg(value).alias("mean"))
    return out.withColumn("pct_change", 100 * ratio(c("last") - c("first"), c("first")))


def quarterly(df: DataFrame, *, at: str, amount: Column, entity: str) -> DataFrame:
    """Amount, rows and distinct entities by quarter."""
    q = F.concat_ws("Q", F.year(at), F.quarter(at))
    return df.groupBy(q.alias("quarter")).agg(amount.alias("amount"), F.count("*").alias("transactions"), F.count_distinct(entity).alias("entities"))


def change_on_last(df: DataFrame, *, order: str, value: str) -> DataFrame:
    """Change on the period before; for tables of a row a period."""
    before = F.lag(value).over(Window.orderBy(order))
    return df.withColumn("qoq", ratio(c(value) - before, before))


def leave_one_out(df: DataFrame, *, key: str, x: str, y: str) -> DataFrame:
    """Correlation with each row's place left out, from the totals less its own moments."""
    rows = df.select(key, c(x).cast("double").alias("x"), c(y).cast("double").alias("y")).dropna()
    rows = rows.crossJoin(F.broadcast(rows.agg(F.avg("x").alias("mx"), F.avg("y").alias("my")))).select(key, (c("x") - c("mx")).alias("x"), (c("y") - c("my")).alias("y"))
    m = {"n": F.lit(1.0), "sx": c("x"), "sy": c("y"), "xx": c("x") * c("x"), "yy": c("y") * c("y"), "xy": c("x") * c("y")}
    own = rows.groupBy(key).agg(*(F.sum(v).alias(k) for k, v in m.items()))
    total = own.agg(*(F.sum(k).alias(f"t_{k}") for k in m))
    r = {k: c(f"t_{k}") - c(k) for k in m}
    cov, vx, vy = r["xy"] - r["sx"] * r["sy"] / r["n"], r["xx"] - r["sx"] * r["sx"] / r["n"], r["yy"] - r["sy"] * r["sy"] / r["n"]
    return own.crossJoin(F.broadcast(total)).select(c(key).alias("dropped"), r["n"].cast("long").alias("n"), F.when((vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(vx * vy)).alias("pearson"))


def correlation_grid(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson of every pair of columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(safe_corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), c(f"r{i}").alias("pearson")) for i, (a, b) in enumerate(pairs)))).alias("p")).select("p.*")
