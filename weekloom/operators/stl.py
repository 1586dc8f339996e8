"""Seasonal and trend decomposition by LOESS, robust, for many series at once: series of one length share every step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def _odd_over(x: float) -> int:
    """The smallest odd whole number of at least ``x``."""
    n = int(np.ceil(x))
    return n + (n % 2 == 0)


def loess(y: np.ndarray, at: np.ndarray, left: np.ndarray, size: int, span: int, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Local lines (tricube weights) through each row of ``y``, evaluated at the places ``at``; where nothing has weight, False in the second result.

    The line for a place uses the ``size`` values from ``left`` on. With a
    ``span`` longer than the series, the weights' reach grows by half of the rest.
    """
    n = y.shape[1]
    j = left[:, None] + np.arange(size)
    reach = np.maximum(at - left, left + size - 1 - at).astype(float) + max(span - n, 0) // 2
    away = np.abs(j - at[:, None])
    near = np.where(away <= 0.001 * reach[:, None], 1.0, (1 - (away / np.maximum(reach, 1e-300)[:, None]) ** 3) ** 3)
    w = np.where(away <= 0.999 * reach[:, None], near, 0.0)[None]
    if weights is not None:
        w = w * weights[:, j]
    total = w.sum(axis=2)
    some = np.broadcast_to(total > 0, (len(y), len(at)))
    w = w / np.where(total > 0, total, 1)[..., None]
    middle = (w * j).sum(axis=2)
    width = (w * (j - middle[..., None]) ** 2).sum(axis=2)
    sloped = (np.sqrt(width) > 0.001 * (n - 1)) & (reach > 0)
    slope = np.where(sloped, (at - middle) / np.where(sloped, width, 1), 0)
    w = w * (slope[..., None] * (j - middle[..., None]) + 1)
    return (w * y[:, j]).sum(axis=2), some


def smoothed(y: np.ndarray, span: int, weights: np.ndarray | None = None, *, beyond: bool = False) -> np.ndarray:
    """LOESS of each row of ``y`` at all its places; ``beyond`` adds the places before the first and after the last."""
    n = y.shape[1]
    size = min(span, n)
    place = np.arange(n)
    left = np.clip(place - (span - 1) // 2, 0, n - size) if span < n else np.zeros(n, int)
    out, some = loess(y, place, left, size, span, weights)
    out = np.where(some, out, y)
    if not beyond:
        return out
    ends, some = loess(y, np.array([-1, n]), np.array([0, n - size]), size, span, weights)
    ends = np.where(some, ends, out[:, [0, -1]])
    return np.concatenate([ends[:, :1], out, ends[:, 1:]], axis=1)


def _means(y: np.ndarray, width: int) -> np.ndarray:
    sums = np.cumsum(np.concatenate([np.zeros((len(y), 1)), y], axis=1), axis=1)
    return (sums[:, width:] - sums[:, :-width]) / width


def decompose(y: np.ndarray, period: int, *, seasonal: int = 7, robust: bool = True, inner: int | None = None, outer: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, weights) of each row of ``y``, of two periods or more.

    A pass smooths the values of each place in the period, takes a low-pass
    filter of that out, and smooths what is left as the trend. A robust fit has
    two passes for each of 15 rounds of weights from the rest's size; else five.
    """
    inner, outer = inner or (2 if robust else 5), (15 if robust else 0) if outer is None else outer
    trend_span, low_span = _odd_over(1.5 * period / (1 - 1.5 / seasonal)), _odd_over(period + 1)
    n = y.shape[1]
    trend, season, weights = np.zeros_like(y), np.zeros_like(y), None
    for k in range(outer + 1):
        for _ in range(inner):
            free = y - trend
            cycle = np.empty((len(y), n + 2 * period))
            for p in range(period):
                own = None if weights is None else weights[:, p::period]
                cycle[:, p::period] = smoothed(free[:, p::period], seasonal, own, beyond=True)
            low = smoothed(_means(_means(_means(cycle, period), period), 3), low_span)
            season = cycle[:, period : period + n] - low
            trend = smoothed(y - season, trend_span, weights)
        if k < outer:
            rest = np.abs(y - trend - season)
            scale = 6 * np.median(rest, axis=1, keepdims=True)
            part = rest / np.where(scale > 0, scale, 1)
            weights = np.where(rest <= 0.001 * scale, 1.0, np.where(rest <= 0.999 * scale, (1 - part**2) ** 2, 0.0))
    return trend, season, np.ones_like(y) if weights is None else weights


def stl_trend(panel: DataFrame, *, entity: str, order: str, value: str, period: int = 13, seasonal: int = 7, robust: bool = True, batch: int = 64) -> DataFrame:
    """entity, order, trend, seasonal and rest of every value, by STL with the given period.

    Each entity's values are gathered in order; a task then decomposes series of
    one length together, ``batch`` at a time. Series under two periods get a
    centred mean of ``period`` values as trend and no seasonal part. Null values
    are left out, as if their neighbours were adjacent; rows that repeat an
    entity and order stay apart, in the order of their values.
    """
    kind = dict(panel.dtypes)
    rows = panel.where(c(value).isNotNull()).groupBy(entity).agg(F.sort_array(F.collect_list(F.struct(c(order).alias("o"), c(value).cast("double").alias("v")))).alias("s"))
    series = rows.select(entity, F.transform("s", lambda x: x["v"]).alias("v"), F.transform("s", lambda x: x["o"]).alias("o"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for n, same in frame.groupby(frame["v"].map(len), sort=False):
                for first in range(0, len(same), batch):
                    part = same.iloc[first : first + batch]
                    y = np.stack(part["v"].to_list()).astype(float)
                    if n >= 2 * period:
                        trend, season, _ = decompose(y, period, seasonal=seasonal, robust=robust)
                    else:
                        trend, season = pd.DataFrame(y.T).rolling(period, min_periods=1, center=True).mean().to_numpy().T, np.zeros_like(y)
                    yield pd.DataFrame({entity: part[entity].to_numpy(), "o": part["o"].to_list(), "t": list(trend), "s": list(season), "r": list(y - trend - season)})

    out = series.mapInPandas(run, f"`{entity}` {kind[entity]}, o array<{kind[order]}>, t array<double>, s array<double>, r array<double>")
    one = out.select(entity, F.explode(F.arrays_zip("o", "t", "s", "r")).alias("x"))
    return one.select(entity, c("x.o").alias(order), c("x.t").alias("trend"), c("x.s").alias("seasonal"), c("x.r").alias("rest"))
