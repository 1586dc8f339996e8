"""Small column expressions that the jobs share. None divides by zero or returns NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null if b is 0 or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope as an aggregate; 0 with under 3 points or without variance."""
    x = F.when(y.isNotNull(), x.cast("double"))
    n, sx, sy = F.count(y), F.sum(x), F.sum(y)
    den = n * F.sum(x * x) - sx * sx
    return F.when((n >= 3) & (den > 1e-12), (n * F.sum(x * y) - sx * sy) / F.nullif(den, F.lit(0.0))).otherwise(0.0)


def slope_where(y: Column, x: Column, condition: Column) -> Column:
    return slope(F.when(condition, y), x)


def r2(y: Column, x: Column) -> Column:
    """Squared correlation as an aggregate; 0 with under 3 points or without variance."""
    ok = (F.count(y) >= 3) & (F.var_pop(y) > 1e-12) & (F.var_pop(F.when(y.isNotNull(), x)) > 1e-12)
    return F.when(ok, F.regr_r2(y, x.cast("double"))).otherwise(0.0)


def cv(y: Column, *, cap: float = 5.0) -> Column:
    """Population deviation over mean, capped, as an aggregate."""
    return F.least(F.stddev_pop(y) / (F.avg(y) + 1e-9), F.lit(cap))


def rounded(**columns: Column | int) -> list[Column]:
    return [F.round(c, 6).alias(name) for name, c in columns.items()]
