"""Cleaning, filters and the indexed, interpolated panel. Every job is one entity-keyed plan without collects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.columns import ratio
from weekloom.operators.ordering import quantiles

KEYWORDS = [("ECONOMY", "budget"), ("PROMO", "promotion"), ("STANDARD", "standard"), ("MEDIUM", "medium"), ("LARGE", "large"), ("SMALL", "small")]


def clean_negative(df: DataFrame, *, value: str = "sales_card", clip: bool = False) -> DataFrame:
    """Negative values become null, or 0 with ``clip``."""
    v = F.col(value)
    return df.withColumn(value, F.greatest(v, F.lit(0.0)) if clip else F.when(v >= 0, v))


def dedup_entity_week(df: DataFrame, *, entity: str = "public_id", period: str = "date_id", order: list[str] | None = None) -> DataFrame:
    """One row for each entity and week: the first by ``order``, then by all columns, so that ties are settled."""
    rest = [c for c in df.columns if c not in (entity, period)]
    w = Window.partitionBy(entity, period).orderBy(*(order or []), *rest)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def merge_entity_week(df: DataFrame, *, entity: str = "public_id", period: str = "date_id", value: str = "sales_card", how: str = "avg") -> DataFrame:
    """One row for each entity and week with the mean or sum of its duplicates."""
    return df.groupBy(entity, period).agg(getattr(F, how)(value).alias(value))


def filter_min_weeks(df: DataFrame, *, entity: str = "public_id", min_weeks: int = 52) -> DataFrame:
    """Entities with at least ``min_weeks`` rows; a window on the panel's own key, so no join. Expects one row a week."""
    w = Window.partitionBy(entity)
    return df.withColumn("n_weeks", F.count(F.lit(1)).over(w)).where(F.col("n_weeks") >= min_weeks)


def filter_open_since(df: DataFrame, meta: DataFrame, *, entity: str = "public_id", since: str = "1995-01-01", min_weeks: int = 52) -> DataFrame:
    """Entities opened since a date and with enough weeks."""
    opened = meta.where(F.col("open_date") >= F.lit(since).cast("date")).select(entity)
    return filter_min_weeks(df.join(opened, entity, "left_semi"), entity=entity, min_weeks=min_weeks)


def entity_means(df: DataFrame, *, entity: str = "public_id", value: str = "sales_card") -> DataFrame:
    return df.groupBy(entity).agg(F.avg(value).alias("mean"))


def filter_outlier_pct(df: DataFrame, *, entity: str = "public_id", value: str = "sales_card", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """entity, mean and removed: whether the entity's mean lies outside the two percentiles of all means."""
    means = entity_means(df, entity=entity, value=value)
    edges = quantiles(means, ["mean"], [low, high], name="q").select(F.col("q")[0].alias("q"))  # one row
    return means.crossJoin(F.broadcast(edges)).select(entity, "mean", ((F.col("mean") < F.col("q")[0]) | (F.col("mean") > F.col("q")[1])).alias("removed"))


def filter_outlier_iqr(df: DataFrame, columns: list[str], *, k: float = 1.5) -> DataFrame:
    """Rows inside Q1 - k IQR .. Q3 + k IQR, one column after another: later quartiles see the earlier filters."""
    for c in columns:
        q = quantiles(df, [c], [0.25, 0.75])
        a, b = F.col("_q")[0][0], F.col("_q")[0][1]
        df = df.crossJoin(F.broadcast(q)).where(F.col(c).between(a - k * (b - a), b + k * (b - a))).drop("_q")
    return df


def winsorize(df: DataFrame, column: str, *, low: float = 0.01, high: float = 0.99, entity: str | None = None) -> DataFrame:
    """Clip a column at its quantiles, of the whole table or of each entity."""
    q = F.percentile(column, F.array(F.lit(low), F.lit(high)))
    if entity:
        joined = df.join(df.groupBy(entity).agg(q.alias("_q")), entity)
    else:
        joined = df.crossJoin(F.broadcast(quantiles(df, [column], [low, high]).select(F.col("_q")[0].alias("_q"))))
    c = F.col(column)
    return joined.withColumn(column, F.when(c.isNotNull(), F.least(F.greatest(c, F.col("_q")[0]), F.col("_q")[1]))).drop("_q")


def low_variance_columns(df: DataFrame, columns: list[str], *, at_most: float = 0.01) -> DataFrame:
    """column, variance and dropped for each numeric column."""
    one = df.agg(*(F.var_pop(c).alias(c) for c in columns))
    return one.unpivot([], columns, "column", "variance").withColumn("dropped", F.coalesce(F.col("variance") <= at_most, F.lit(True)))


def standardize_cols(df: DataFrame, columns: list[str], *, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Median-impute, winsorize and z-score (ddof 1) columns; a constant one becomes 0."""
    q = F.col("_q")
    df = df.crossJoin(F.broadcast(quantiles(df, columns, [0.5]))).withColumns({x: F.coalesce(x, q[k][0]) for k, x in enumerate(columns)}).drop("_q")
    df = df.crossJoin(F.broadcast(quantiles(df, columns, [low, high]))).withColumns({x: F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), q[k][0]), q[k][1])) for k, x in enumerate(columns)}).drop("_q")
    ms = df.agg(F.array(*(F.struct(F.avg(x).alias("a"), F.stddev_samp(x).alias("s")) for x in columns)).alias("_q"))
    return df.crossJoin(F.broadcast(ms)).withColumns({x: F.when(F.coalesce(q[k]["s"], F.lit(0.0)) <= 1e-12, 0.0).otherwise((F.col(x) - q[k]["a"]) / q[k]["s"]) for k, x in enumerate(columns)}).drop("_q")


def impute_const_median(df: DataFrame, column: str, *, group: str | None = None, constant: float | None = None) -> DataFrame:
    """Fill nulls by a constant, else the group's median, else the column's median."""
    if constant is not None:
        return df.withColumn(column, F.coalesce(column, F.lit(constant)))
    med = quantiles(df, [column], [0.5]).select(F.col("_q")[0][0].alias("_m"))
    out = df.crossJoin(F.broadcast(med))
    if group:
        out = out.join(df.groupBy(group).agg(F.percentile(column, F.lit(0.5)).alias("_g")), group, "left")
        return out.withColumn(column, F.coalesce(column, "_g", "_m")).drop("_m", "_g")
    return out.withColumn(column, F.coalesce(column, "_m")).drop("_m")


def entity_week_index(df: DataFrame, *, entity: str = "public_id", period: str = "date_id", cap: int | None = 108) -> DataFrame:
    """Ordinal of a row inside its entity, from 0; rows from ``cap`` on go."""
    out = df.withColumn("week_idx", F.row_number().over(Window.partitionBy(entity).orderBy(period)) - 1)
    return out if cap is None else out.where(F.col("week_idx") < cap)


def interp_linear(df: DataFrame, *, entity: str = "public_id", order: str = "week_idx", value: str = "sales_card") -> DataFrame:
    """Linear interpolation by row position, then fill forward and back: a leading gap takes the first value, a trailing one the last."""
    w = Window.partitionBy(entity).orderBy(order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    pos = F.row_number().over(w)
    out = df.withColumn("_p", pos)
    at = F.when(F.col(value).isNotNull(), F.col("_p"))
    out = out.withColumns({"_v0": F.last(value, True).over(before), "_v1": F.first(value, True).over(after), "_p0": F.last(at, True).over(before), "_p1": F.first(at, True).over(after)})
    inner = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_p") - F.col("_p0")) / F.nullif(F.col("_p1") - F.col("_p0"), F.lit(0))
    filled = F.coalesce(F.col(value), inner, F.col("_v0"), F.col("_v1"))
    return out.withColumn(value, filled).drop("_p", "_v0", "_v1", "_p0", "_p1")


def align_grid(df: DataFrame, *, entity: str = "public_id", period: str = "date_id", value: str = "sales_card") -> DataFrame:
    """Every entity on every week of the table, gaps interpolated. The weeks are a few hundred rows, hence the broadcast."""
    weeks = df.select(period).distinct()
    grid = df.select(entity).distinct().crossJoin(F.broadcast(weeks))
    return interp_linear(grid.join(df.select(entity, period, value), [entity, period], "left"), entity=entity, order=period, value=value)


def global_week_index(df: DataFrame, *, period: str = "date_id") -> DataFrame:
    """floor((date - first date) / 7) + 1 over the whole table."""
    return df.crossJoin(F.broadcast(df.agg(F.min(period).alias("_d0")))).withColumn("week_no", F.floor(F.datediff(period, "_d0") / 7) + 1).where("week_no > 0").drop("_d0")


def weeks_since_open(df: DataFrame, meta: DataFrame, *, entity: str = "public_id", period: str = "date_id") -> DataFrame:
    """Whole weeks since the opening date, not below 0."""
    return df.join(meta.select(entity, "open_date"), entity, "left").withColumn("weeks_open", F.greatest(F.floor(F.datediff(period, "open_date") / 7), F.lit(0)))


def sales_total(df: DataFrame, parts: list[str], *, name: str = "sales_total") -> DataFrame:
    """Sum of parts, null as 0."""
    total: Column = F.lit(0.0)
    for c in parts:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return df.withColumn(name, total)


def minmax_entity(df: DataFrame, columns: list[str], *, entity: str = "public_id", eps: float = 1e-9) -> DataFrame:
    """(x - min) / (max - min + eps) inside each entity as ``<column>_mm``."""
    w = Window.partitionBy(entity)
    return df.withColumns({f"{c}_mm": (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + eps) for c in columns})


def zscore_entity(df: DataFrame, *, entity: str = "public_id", value: str = "sales_card", ddof: int = 0) -> DataFrame:
    """z score inside each entity; ddof 0 with a deviation under 1e-6 set to 1, or ddof 1 plus 1e-9."""
    w = Window.partitionBy(entity)
    if ddof:
        scale = F.stddev_samp(value).over(w) + 1e-9
    else:
        s = F.stddev_pop(value).over(w)
        scale = F.when(s < 1e-6, 1.0).otherwise(s)
    return df.withColumn("z", (F.col(value) - F.avg(value).over(w)) / scale)


def mean_norm_entity(df: DataFrame, *, entity: str = "public_id", value: str = "sales_card") -> DataFrame:
    """Value over the entity's mean; a mean of 0 or null counts as 1."""
    m = F.avg(value).over(Window.partitionBy(entity))
    return df.withColumn("norm", F.col(value) / F.when(F.coalesce(m, F.lit(0.0)) == 0, 1.0).otherwise(m))


def market_share_week(df: DataFrame, *, period: str = "date_id", value: str = "sales_card") -> DataFrame:
    """Share of the week's total. Weeks are few and huge, so totals are summed map-side and joined back, not windowed."""
    totals = df.groupBy(period).agg(F.sum(value).alias("_t"))
    return df.join(F.broadcast(totals), period).withColumn("share", ratio(F.col(value), F.col("_t"))).drop("_t")


def new_customer_ratio(df: DataFrame, *, new: str = "customer_new", all_: str = "customer") -> DataFrame:
    return df.withColumn("nc_ratio", ratio(F.col(new), F.col(all_)))


def classify_industry(df: DataFrame, column: str, keywords: list[tuple[str, str]] = KEYWORDS, *, name: str = "industry", other: str = "other") -> DataFrame:
    """First keyword contained in the text wins."""
    out = F.lit(other)
    for word, label in reversed(keywords):
        out = F.when(F.col(column).contains(word), label).otherwise(out)
    return df.withColumn(name, out)


def owner_age_parse(df: DataFrame, *, column: str = "age", month: str = "open_month", year: int = 2002) -> DataFrame:
    """Leading digits of a band, the band's order, and years since a yyyy-MM month; text that doesn't parse is null."""
    digits = F.nullif(F.regexp_extract(column, r"^(\d+)", 1), F.lit(""))
    return df.withColumns({"age_number": digits.cast("int"), "age_order": F.expr(f"try_cast(nullif(regexp_extract({column}, '^([0-9]+)', 1), '') AS INT) div 10"), "age_years": F.lit(year) - F.expr(f"try_cast(substring({month}, 1, 4) AS INT)")})


def onehot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """0/1 columns for given levels; a null level has zeros."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in levels})


def trend_decompose(df: DataFrame, *, entity: str = "public_id", order: str = "week_idx", value: str = "sales_card", width: int = 5) -> DataFrame:
    """Centred moving mean as trend, and the rest. Even widths reach one further back."""
    w = Window.partitionBy(entity).orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2)
    return df.withColumn("trend", F.avg(value).over(w)).withColumn("resid", F.col(value) - F.col("trend"))


def build_panel(weekly: DataFrame, meta: DataFrame | None = None, *, entity: str = "public_id", min_weeks: int = 52, cap: int = 108, width: int = 5) -> DataFrame:
    """Cleaned weeks of entities with enough of them: index, dimension, interpolation, trend, and min-max columns.

    All windows and later aggregates are keyed by entity, so one large shuffle
    serves them all; the dimension, if given, is broadcast if the session finds
    it small.
    """
    out = filter_min_weeks(clean_negative(weekly), entity=entity, min_weeks=min_weeks)
    out = interp_linear(entity_week_index(out, entity=entity, cap=cap), entity=entity)
    out = minmax_entity(trend_decompose(out, entity=entity, width=width), ["sales_card", "trend"], entity=entity)
    return out if meta is None else out.join(meta, entity, "left")


PANEL_SQL = """p0 AS (SELECT *, CASE WHEN sales_card >= 0 THEN sales_card END AS v, count(*) OVER (PARTITION BY public_id) AS n_weeks FROM weekly),
p1 AS (SELECT * EXCLUDE (sales_card), row_number() OVER (PARTITION BY public_id ORDER BY date_id) - 1 AS week_idx FROM p0 WHERE n_weeks >= 52),
p2 AS (SELECT * EXCLUDE (v), v AS sales_card FROM p1 WHERE week_idx < 108),
p3 AS (SELECT *, avg(sales_card) OVER (PARTITION BY public_id ORDER BY week_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS trend FROM p2),
panel AS (SELECT p3.*, sales_card - trend AS resid,
 (sales_card - min(sales_card) OVER e) / (max(sales_card) OVER e - min(sales_card) OVER e + 1e-9) AS sales_card_mm,
 (trend - min(trend) OVER e) / (max(trend) OVER e - min(trend) OVER e + 1e-9) AS trend_mm,
 dong, sigungu, category, open_date, open_month, area, delivery_link, age
 FROM p3 LEFT JOIN meta USING (public_id) WINDOW e AS (PARTITION BY p3.public_id))"""
