"""Checks of input tables: columns, missing values, coverage, id overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required_columns(tables: dict[str, DataFrame], wanted: dict[str, list[str]]) -> DataFrame:
    """source, n_rows, n_missing and status of each table."""
    reports = []
    for name, df in tables.items():
        missing = sum(x not in df.columns for x in wanted[name])
        reports.append(df.agg(F.lit(name).alias("source"), F.count("*").alias("n_rows"), F.lit(missing).alias("n_missing"), F.lit("missing" if missing else "ok").alias("status")))
    return reduce(DataFrame.unionByName, reports)


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_null and rate: one scan, then unpivot of its single row."""
    one = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(x).isNull()).alias(x) for x in columns))
    return one.unpivot(["_n"], columns, "column", "n_null").select("column", "n_null", F.try_divide("n_null", "_n").alias("rate"))


def missingness_by(df: DataFrame, group: Column, column: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n_rows"), F.count_if(F.col(column).isNull()).alias("n_null"))


def coverage(df: DataFrame, *, entity: str = "public_id", period: str = "date_id", value: str = "sales_card") -> DataFrame:
    return df.groupBy(entity).agg(F.count_distinct(period).alias("weeks"), F.min(period).alias("first_date"), F.max(period).alias("last_date"), F.avg(value).alias("mean_sales"), F.sum(value).alias("total_sales"))


def id_overlap(a: DataFrame, b: DataFrame, *, key: str = "id") -> DataFrame:
    """Distinct ids of either side and of both, from one union grouped by id."""
    sides = a.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).union(b.select(key, F.lit(0), F.lit(1))).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"), F.sum(F.col("l") * F.col("r")).alias("n_both"))
