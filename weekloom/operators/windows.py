"""Calendar feature and target windows, all specs in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekloom.functions.columns import slope

c = F.col


def spec_table(spark: SparkSession, years: list[int], months: list[int], lengths: list[int], lags: list[int]) -> DataFrame:
    """One row for each spec: id, first day and months of the feature window, lag to the target window. At most a few hundred rows."""
    rows = [(f"sy{y}_sm{m}_w{k}_off{lag}", y, m, k, lag) for y in years for m in months for k in lengths for lag in lags]
    out = spark.createDataFrame(rows, "spec_id string, base_year int, start_month int, months int, lag_years int")
    begin = F.make_date("base_year", "start_month", F.lit(1))
    end = F.date_sub(F.add_months(begin, c("months")), 1)
    return out.withColumns({"feat_start": begin, "feat_end": end, "target_start": F.add_months(begin, 12 * c("lag_years")), "target_end": F.date_sub(F.add_months(begin, 12 * c("lag_years") + c("months")), 1)})


def attach_specs(weekly: DataFrame, specs: DataFrame, *, period: str = "date_id") -> DataFrame:
    """Rows of every spec's two windows with ``segment``.

    A spec, of a few hundred, is broadcast once for each month of its windows,
    so that a row meets only those with its month, by an equal key.
    """
    d = c(period)
    segment = F.when(d.between(c("feat_start"), c("feat_end")), "feature").when(d.between(c("target_start"), c("target_end")), "target")
    months = [F.sequence(F.trunc(a, "month"), F.trunc(b, "month"), F.expr("interval 1 month")) for a, b in (("feat_start", "feat_end"), ("target_start", "target_end"))]
    by_month = specs.withColumn("_month", F.explode(F.array_distinct(F.concat(*months))))
    rows = weekly.join(F.broadcast(by_month), F.trunc(d, "month") == c("_month")).drop("_month")
    return rows.withColumn("segment", segment).where("segment is not null")


def expected_weeks(start: str, end: str) -> F.Column:
    return F.floor(F.datediff(end, start) / 7) + 1


def spec_inventory(rows: DataFrame, *, entity: str = "public_id") -> DataFrame:
    """Entities in the feature window, in the target window, and in both, by spec."""
    each = rows.groupBy("spec_id", entity).agg(F.max((c("segment") == "feature").cast("int")).alias("f"), F.max((c("segment") == "target").cast("int")).alias("t"))
    return each.groupBy("spec_id").agg(F.sum("f").alias("n_feature"), F.sum("t").alias("n_target"), F.sum(c("f") * c("t")).alias("n_both"))


def window_simple(rows: DataFrame, *, entity: str = "public_id", period: str = "date_id", share: float = 0.7) -> DataFrame:
    """Level, deviation, slope, edges and variation of log sales in the feature window; entities with ``share`` of its weeks."""
    weeks = expected_weeks("feat_start", "feat_end")
    f = rows.where("segment = 'feature'").withColumn("x", F.floor(F.datediff(period, "feat_start") / 7)).withColumn("s", F.log1p("sales_card")).withColumn("weeks", weeks)
    w = Window.partitionBy("spec_id", entity)
    f = f.withColumn("up", F.row_number().over(w.orderBy(period))).withColumn("down", F.row_number().over(w.orderBy(F.desc(period))))
    out = f.groupBy("spec_id", entity).agg(F.count("s").alias("n"), F.first("weeks").alias("weeks"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), slope(c("s"), c("x")).alias("slope"), (F.avg(F.when(c("down") <= 4, c("s"))) - F.avg(F.when(c("up") <= 4, c("s")))).alias("sales_delta"))
    return out.where(c("n") >= F.ceil(share * c("weeks"))).withColumn("cv", F.coalesce(c("std") / (F.abs("mean") + 1e-9), F.lit(0.0))).drop("weeks")


def target_labels(rows: DataFrame, *, entity: str = "public_id", period: str = "date_id", k: float = 0.5, least: int = 3) -> DataFrame:
    """Slope of sales over the entity's mean in both windows, labelled by each spec's own sigma taken before short targets go."""
    m = F.avg("sales_card").over(Window.partitionBy("spec_id", entity))
    t = rows.withColumn("v", c("sales_card") / F.nullif(m, F.lit(0.0))).where("segment = 'target'").withColumn("x", F.floor(F.datediff(period, "target_start") / 7))
    out = t.groupBy("spec_id", entity).agg(F.count("v").alias("n"), slope(c("v"), c("x")).alias("slope"))
    sigma = out.groupBy("spec_id").agg(F.stddev_pop("slope").alias("_s"))
    out = out.join(F.broadcast(sigma), "spec_id").where(c("n") >= least)
    return out.withColumn("outcome_3", F.when(c("slope") > k * c("_s"), "Growth").when(c("slope") < -k * c("_s"), "Decline").otherwise("Stable")).drop("_s")


def parse_spec_id(df: DataFrame, column: str = "spec_id") -> DataFrame:
    part = lambda i: F.regexp_extract(column, r"^sy(\d{4})_sm(\d+)_w(\d+)_off(\d+)$", i)
    return df.withColumns({name: F.nullif(part(i), F.lit("")).cast("int") for i, name in enumerate(("year", "month", "weeks", "lag"), 1)})


def self_label_stability(labels: DataFrame, *, panel: str, entity: str, label: str) -> DataFrame:
    """Of every pair of panels: entities in both, and the share with the same label."""
    a = labels.select(entity, c(panel).alias("a"), c(label).alias("la"))
    b = labels.select(entity, c(panel).alias("b"), c(label).alias("lb"))
    return a.join(b, entity).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.avg((c("la") == c("lb")).cast("int")).alias("same"))


def recent_history(weekly: DataFrame, specs: DataFrame, *, entity: str = "public_id", period: str = "date_id", value: str = "sales_card", weeks: int = 26, least: int = 12) -> DataFrame:
    """The last ``weeks`` weeks before each spec's feature end as an array, oldest first; entities with ``least`` points."""
    ends = specs.select("spec_id", "feat_end")
    rows = weekly.join(F.broadcast(ends), (c(period) <= c("feat_end")) & (c(period) > F.date_sub("feat_end", 7 * weeks)))
    got = rows.where(c(value).isNotNull()).groupBy("spec_id", entity).agg(F.array_sort(F.collect_list(F.struct(period, value))).alias("h")).where(F.size("h") >= least)
    return got.select("spec_id", entity, F.transform("h", lambda x: x[value]).alias("history"))
