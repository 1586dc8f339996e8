"""How a query is bound: a function of (spark, sf_dir), and the same result as SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.operators.panel import PANEL_SQL, build_panel
from weekloom.sources.tables import META_SQL, WEEKLY_SQL, meta, weekly

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_TABLES = {"w": f"WITH {WEEKLY_SQL}", "m": f"WITH {META_SQL}", "p": f"WITH {WEEKLY_SQL}, {META_SQL}, {PANEL_SQL}"}


def query(name: str, sql: str | None = None, *, tables: str = "", digits: int = 6):
    """Register a query under ``name``. ``tables`` names what its SQL and its function start from: w weekly, m meta, p panel.

    Spark's doubles are rounded to ``digits``; the SQL rounds its own.
    """

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql is not None:
            head = f"{_TABLES[tables]}, answer AS" if tables else "WITH answer AS"
            ORACLES[name] = f"{head} ({sql}) SELECT * FROM answer"
        return f

    return add


def rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*(F.round(F.col(f"`{c}`"), digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_panel(weekly(spark, sf_dir), meta(spark, sf_dir))


def r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits})"


def slope_sql(y: str, x: str, where: str = "TRUE") -> str:
    """DuckDB's form of the guarded slope."""
    v = f"CASE WHEN {where} THEN {y} END"
    return f"CASE WHEN count({v}) >= 3 AND var_pop(CASE WHEN ({v}) IS NOT NULL THEN {x} END) > 1e-12 THEN coalesce(regr_slope({v}, {x}), 0.0) ELSE 0.0 END"


def r2_sql(y: str, x: str, where: str = "TRUE") -> str:
    v, u = f"CASE WHEN {where} THEN {y} END", f"CASE WHEN {where} AND ({y}) IS NOT NULL THEN {x} END"
    return f"CASE WHEN count({v}) >= 3 AND var_pop({v}) > 1e-12 AND var_pop({u}) > 1e-12 THEN regr_r2({v}, {u}) ELSE 0.0 END"
