"""Typed readers and writers, and the weekly panel's tables built from order lines."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The weekly fact table: one row for each entity and week.
WEEKLY_SCHEMA = T.StructType(
    [
        T.StructField("public_id", T.StringType()),
        T.StructField("date_id", T.DateType()),
        *(T.StructField(c, T.DoubleType()) for c in ("sales_card", "sales_invoice", "sales_delivery", "purchase_card")),
        *(T.StructField(c, T.LongType()) for c in ("customer", "customer_new")),
        *(T.StructField(c, T.DoubleType()) for c in ("before_noon_sales", "weekend_sales")),
    ]
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_panel(spark: SparkSession, path: str, *, entity: str = "public_id", period: str = "date_id", columns: list[str] | None = None) -> DataFrame:
    """Weekly facts with the entity as text and the period as date; only the chosen columns are scanned."""
    facts = spark.read.parquet(path)
    kept = [c for c in (columns or facts.columns) if c not in (entity, period)]
    return facts.select(F.col(entity).cast("string").alias(entity), F.to_date(F.col(period).cast("string")).alias(period), *kept)


def read_dimension(spark: SparkSession, path: str | list[str], schema: str | T.StructType, *, month: str = "open_month") -> DataFrame:
    """Entity dimension from CSV with a declared schema; ``month`` (yyyy-MM) becomes a date, bad values become null."""
    rows = spark.read.csv(path, schema=schema, header=True)
    return rows.withColumn("open_date", F.expr(f"try_to_date({month}, 'yyyy-MM')"))


def read_encoded_csv(spark: SparkSession, paths: list[str], schema: str | T.StructType, columns: list[str], *, encoding: str = "UTF-8") -> DataFrame:
    """Chosen columns of several CSV files of one encoding; bytes that it doesn't have become U+FFFD.

    Spark reads the Unicode encodings and ISO-8859-1. Others that keep commas,
    quotes and line ends apart from other bytes, such as Korean cp949, are read
    byte by byte and decoded in Arrow batches; no setting of the session changes.
    """
    if encoding.upper() in ("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16LE", "UTF-16BE"):
        return spark.read.csv(paths, schema=schema, header=True, encoding=encoding).select(*columns)
    rows = spark.read.csv(paths, schema=schema, header=True, encoding="ISO-8859-1").select(*columns)
    decoded = _recode("latin-1", encoding)
    return rows.select(*(decoded(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in rows.dtypes))


def write_encoded_csv(df: DataFrame, path: str, *, encoding: str) -> None:
    """CSV with a header in an encoding that Spark's writer doesn't have; characters outside it become question marks."""
    encoded = _recode(encoding, "latin-1")
    df.select(*(encoded(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes)).write.mode("overwrite").csv(path, header=True, encoding="ISO-8859-1")


def _recode(was: str, becomes: str):
    """Text whose characters stand for the bytes of one encoding, as text of another."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x if x is None else x.encode(was, "replace").decode(becomes, "replace"))

    return run


_own: dict[str, str] = {}


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``; where that is unset, on a local master, in a temporary folder of this process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="weekloom-")
            atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
        shared = "file://" + _own["dir"]
    return f"{shared.rstrip('/')}/weekloom-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into a new shared folder and read back: a short plan for loops, which survives lost executors."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._weekloom_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` after their last reader."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._weekloom_path).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_table(df: DataFrame, path: str, *, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Result table as Parquet or CSV with a header, in folders by ``by``."""
    out = df.write.mode("overwrite").partitionBy(*(by or []))
    out.parquet(path) if kind == "parquet" else out.option("header", True).csv(path)


def weekly_from_lines(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Supplier-week facts: sales in whole cents before the sum, customers, first-time customers, shares."""
    cents = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5).cast("long")
    tax = F.floor(F.col("l_extendedprice") * F.col("l_tax") * 100 + 0.5).cast("long")
    day = F.to_date("l_shipdate")
    rows = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").cast("string").alias("public_id"), F.to_date(F.date_trunc("week", day)).alias("date_id"), cents.alias("cents"), tax.alias("tax"), "l_returnflag", "l_linestatus", F.weekday(day).alias("dow"), "o_custkey"
    )
    # One row for each entity, week and customer: sums and both customer counts follow from it without distinct counts.
    visits = rows.groupBy("public_id", "date_id", "o_custkey").agg(
        F.sum("cents").alias("cents"), F.sum("tax").alias("tax"),
        *(F.coalesce(F.expr(f"sum(cents) FILTER (WHERE {condition})"), F.lit(0)).alias(name) for name, condition in (("invoice", "l_returnflag = 'A'"), ("delivery", "l_returnflag = 'R'"), ("noon", "l_linestatus = 'O'"), ("weekend", "dow >= 5"))),
    )
    visits = visits.withColumn("first_week", F.min("date_id").over(Window.partitionBy("public_id", "o_custkey")))
    return visits.groupBy("public_id", "date_id").agg(
        (F.sum("cents") / 100.0).alias("sales_card"),
        (F.sum("invoice") / 100.0).alias("sales_invoice"),
        (F.sum("delivery") / 100.0).alias("sales_delivery"),
        (F.sum("tax") / 100.0).alias("purchase_card"),
        F.count("o_custkey").alias("customer"),
        F.count_if((F.col("first_week") == F.col("date_id")) & F.col("o_custkey").isNotNull()).alias("customer_new"),
        F.expr("try_divide(1.0D * sum(noon), sum(cents))").alias("before_noon_sales"),
        F.expr("try_divide(1.0D * sum(weekend), sum(cents))").alias("weekend_sales"),
    )


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_from_lines(read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders"))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each supplier: place, main part type, first day, area, delivery link, age band."""
    t = {n: read_table(spark, sf_dir, n) for n in ("supplier", "nation", "region", "lineitem", "part")}
    kinds = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_type").agg(F.count("*").alias("n"))
    first = Window.partitionBy("l_suppkey").orderBy(F.desc("n"), "p_type")
    main = kinds.withColumn("r", F.row_number().over(first)).where("r = 1").select("l_suppkey", F.col("p_type").alias("category"))
    opened = t["lineitem"].groupBy(F.col("l_suppkey").alias("k")).agg(F.to_date(F.min("l_shipdate")).alias("open_date"))
    places = t["nation"].join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("dong"), F.col("r_name").alias("sigungu"))
    out = t["supplier"].join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    out = out.join(main, F.col("s_suppkey") == F.col("l_suppkey"), "left").join(opened, F.col("s_suppkey") == F.col("k"), "left")
    return out.select(
        F.col("s_suppkey").cast("string").alias("public_id"), "dong", "sigungu", "category", "open_date",
        F.date_format("open_date", "yyyy-MM").alias("open_month"), F.col("s_acctbal").alias("area"),
        (F.col("s_suppkey") % 2).cast("int").alias("delivery_link"), F.concat(((F.col("s_suppkey") % 6 + 1) * 10).cast("string"), F.lit("s")).alias("age"),
    )


WEEKLY_SQL = """lines AS (
 SELECT CAST(l_suppkey AS VARCHAR) AS public_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS date_id,
  CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT) AS cents, CAST(floor(l_extendedprice * l_tax * 100 + 0.5) AS BIGINT) AS tax,
  l_returnflag, l_linestatus, isodow(l_shipdate) AS dow, o_custkey
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
lines2 AS (SELECT *, min(date_id) OVER (PARTITION BY public_id, o_custkey) AS first_week FROM lines),
weekly AS (
 SELECT public_id, date_id, sum(cents) / 100.0::DOUBLE AS sales_card,
  coalesce(sum(cents) FILTER (WHERE l_returnflag = 'A'), 0) / 100.0::DOUBLE AS sales_invoice, coalesce(sum(cents) FILTER (WHERE l_returnflag = 'R'), 0) / 100.0::DOUBLE AS sales_delivery,
  sum(tax) / 100.0::DOUBLE AS purchase_card, count(DISTINCT o_custkey) AS customer, count(DISTINCT CASE WHEN first_week = date_id THEN o_custkey END) AS customer_new,
  coalesce(sum(cents) FILTER (WHERE l_linestatus = 'O'), 0)::DOUBLE / nullif(sum(cents), 0)::DOUBLE AS before_noon_sales,
  coalesce(sum(cents) FILTER (WHERE dow >= 6), 0)::DOUBLE / nullif(sum(cents), 0)::DOUBLE AS weekend_sales
 FROM lines2 GROUP BY 1, 2)"""

META_SQL = """kinds AS (SELECT l_suppkey, p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
main AS (SELECT l_suppkey, p_type AS category FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, p_type) AS r FROM kinds) WHERE r = 1),
opened AS (SELECT l_suppkey AS k, CAST(min(l_shipdate) AS DATE) AS open_date FROM lineitem GROUP BY 1),
meta AS (SELECT CAST(s_suppkey AS VARCHAR) AS public_id, n_name AS dong, r_name AS sigungu, category, open_date, strftime(open_date, '%Y-%m') AS open_month,
 s_acctbal AS area, CAST(s_suppkey % 2 AS INTEGER) AS delivery_link, CAST((s_suppkey % 6 + 1) * 10 AS VARCHAR) || 's' AS age
 FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN main ON s_suppkey = l_suppkey LEFT JOIN opened ON s_suppkey = k)"""
