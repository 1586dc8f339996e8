"""Running counts and exact quantiles over all values of a table, in buckets, so that no task holds or sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def bucket_count(df: DataFrame) -> int:
    """As many buckets as the session deals its shuffles over, 64 at least."""
    return max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bucket_edges(value: str, buckets: int) -> Column:
    """Sorted edges of buckets of about equal size, as an aggregate."""
    return F.percentile_approx(value, [i / buckets for i in range(1, buckets)], F.lit(20 * buckets))


def bucket_of(value: Column, edges: Column, buckets: int) -> Column:
    """How many of the sorted edges lie below the value, by bisection."""
    steps = [1 << k for k in reversed(range((buckets - 1).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) < value, at + step).otherwise(at))


def running_counts(df: DataFrame, value: str, *, by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """(by, value, n, upto, total) for each distinct value: its rows, the rows up to it, and all rows of the group. Nulls aren't counted.

    Equal values are counted first; the running count then goes over buckets of
    distinct values, with each bucket's base from the bucket totals.
    """
    keys = by or []
    buckets = buckets or bucket_count(df)
    counts = df.where(c(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    edges = counts.groupBy(*keys).agg(bucket_edges(value, buckets).alias("_e"))
    placed = counts.join(edges, keys) if keys else counts.crossJoin(F.broadcast(edges))  # without keys one row
    placed = placed.withColumn("_b", bucket_of(c(value), c("_e"), buckets)).drop("_e")
    sums = placed.groupBy(*keys, "_b").agg(F.sum("n").alias("_s"))
    group = Window.partitionBy(*keys)
    base = sums.withColumns({"_base": F.coalesce(F.sum("_s").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("_s").over(group)}).drop("_s")
    inside = F.sum("n").over(Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    joined = placed.withColumn("_c", inside).join(base if keys else F.broadcast(base), [*keys, "_b"])
    return joined.select(*keys, value, "n", (c("_base") + c("_c")).alias("upto"), "total")


def running_sums(df: DataFrame, value: str, columns: list[str], *, descending: bool = False, buckets: int | None = None) -> DataFrame:
    """``df``, which has a row for each distinct value, with each column replaced by its sum over the rows up to (or, descending, from) its value."""
    buckets = buckets or bucket_count(df)
    edges = df.agg(bucket_edges(value, buckets).alias("_e"))
    placed = df.crossJoin(F.broadcast(edges)).withColumn("_b", bucket_of(c(value), c("_e"), buckets)).drop("_e")
    way = F.desc if descending else F.asc
    before = Window.partitionBy(F.lit(0)).orderBy(way("_b")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    base = placed.groupBy("_b").agg(*(F.sum(x).alias(x) for x in columns)).select("_b", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"_base_{x}") for x in columns))
    inside = Window.partitionBy("_b").orderBy(way(value)).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({x: F.sum(x).over(inside) for x in columns}).join(F.broadcast(base), "_b")
    return out.withColumns({x: c(x) + c(f"_base_{x}") for x in columns}).drop("_b", *(f"_base_{x}" for x in columns))


def group_quantiles(df: DataFrame, by: list[str], value: str | Column, points: list[float], *, name: str = "_q", buckets: int | None = None) -> DataFrame:
    """by and an array of the group's exact, linearly interpolated quantiles at ``points``, as ``percentile`` gives them.

    Nulls aren't counted, and a group without values has no row. A null key is a
    group of its own. No task holds a group's distinct values.
    """
    rows = df.select(F.struct(*(c(x) for x in by)).alias("_k"), (c(value) if isinstance(value, str) else value).cast("double").alias("_v"))
    seen = running_counts(rows, "_v", by=["_k"], buckets=buckets)
    return seen.groupBy("_k").agg(_ends(points).alias("_ends")).select("_k.*", _between("_ends").alias(name))


def _ends(points: list[float]) -> Column:
    """Of running counts: the values on either side of each point, and the weight of the second."""
    at = [F.lit(p) * (c("total") - 1) for p in points]
    return F.array(*(F.struct(F.min(F.when(c("upto") > F.floor(p), c("_v"))).alias("a"), F.min(F.when(c("upto") > F.ceil(p), c("_v"))).alias("b"), F.max(p - F.floor(p)).alias("w")) for p in at))


def _between(ends: str) -> Column:
    return F.transform(ends, lambda e: F.when(e["a"] == e["b"], e["a"]).otherwise((1 - e["w"]) * e["a"] + e["w"] * e["b"]))


def quantiles(df: DataFrame, columns: list[str | Column], points: list[float], *, name: str = "_q", buckets: int | None = None) -> DataFrame:
    """One row with an array of arrays: for each column its exact, linearly interpolated quantiles at ``points``.

    The same numbers as ``percentile``, whose last task would hold every
    distinct value. Nulls aren't counted; a column without values gives nulls.
    """
    cells = df.select(F.posexplode(F.array(*((c(x) if isinstance(x, str) else x).cast("double") for x in columns))).alias("_k", "_v"))
    seen = running_counts(cells, "_v", by=["_k"], buckets=buckets)
    rows = seen.groupBy("_k").agg(_ends(points).alias("_ends"))
    return rows.select("_k", _between("_ends").alias("_p")).agg(F.array(*(F.max(F.when(c("_k") == k, c("_p"))) for k in range(len(columns)))).alias(name))
