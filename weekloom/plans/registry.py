"""Every panel query and its SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weekloom.plans import binding, causal_queries, district_queries, evaluation_queries, feature_queries, label_queries, model_queries, more_queries, panel_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(binding.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(binding.ORACLES)
