"""Weights of the greatest Sharpe ratio among strategies or names, within limits, without a covariance matrix on the driver.

A step of projected gradient ascent needs two aggregates: the book's mean and
deviation under the present weights, and for each name the mean of its return and
its covariance with the book. Both are sums over dates and names; what comes to the
driver is a number per name and step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import drop_stored, stored
from .construct import capped_simplex

YEAR = 252.0


def _moments(returns: DataFrame, w: dict[str, float], key: str) -> tuple[float, float, dict[str, tuple[float, float]]]:
    """(mean, variance of the book; name: (mean, covariance with the book)) under ``w``."""
    weight = F.create_map(*(F.lit(x) for kv in w.items() for x in kv))
    book = returns.groupBy("time").agg(F.sum(F.col("r") * F.element_at(weight, F.col(key))).alias("p"))
    both = returns.join(book, "time").groupBy(key).agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("p")).alias("sp"))
    n, mean, square = book.agg(F.count(F.lit(1)), F.avg("p"), F.avg(F.col("p") * F.col("p"))).first()
    rows = {r[0]: (r[1] / n, r[2] / n - r[1] / n * mean) for r in both.collect()}  # a row per name
    return mean, square - mean * mean, rows


def max_sharpe(returns: DataFrame, key: str = "strategy", least: float = 0.0, most: float = 1.0, rate: float = 0.0, steps: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """(key, w, mean, sharpe): long-only weights that sum to 1 and maximise the annual Sharpe ratio over ``rate``, each between ``least`` and ``most``.

    ``returns``: (time, key, r), a missing return is 0; a date counts once for the
    book. The names are few (strategies, sleeves). Where all means are equal the
    ratio is that of the least variance; names that do not vary together with their
    book count by their mean. Steps go along the gradient, as far as the ratio rises.
    """
    data = stored(returns.select("time", key, F.coalesce(F.nanvl(F.col("r").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("r")), "returns")
    names = sorted(r[0] for r in data.select(key).distinct().collect())
    kind = dict(returns.dtypes)[key]
    schema = f"{key} {kind}, w double, mean double, sharpe double"
    if not names:
        return returns.sparkSession.createDataFrame([], schema)
    lo, hi = np.full(len(names), least), np.full(len(names), most)
    project = lambda v: capped_simplex(v, 1.0, lo, hi, rounds=100)

    def look(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        mean, variance, rows = _moments(data, dict(zip(names, w.tolist(), strict=True)), key)
        m, c = (np.array([rows[n][k] for n in names]) for k in (0, 1))
        sd = np.sqrt(max(variance, 0.0)) + 1e-12
        excess = mean - rate / YEAR
        return excess / sd, m / sd - excess * c / sd**3, m

    w = project(np.full(len(names), 1 / len(names)))
    ratio, slope, means = look(w)
    size = 0.1 / (np.abs(slope).max() + 1e-12)
    for _ in range(steps):
        moved = project(w + size * slope)
        if np.abs(moved - w).max() < tolerance:
            break
        new, turned, _ = look(moved)
        if new > ratio:
            w, ratio, slope, size = moved, new, turned, size * 1.5
        else:
            size /= 3
    drop_stored(data)
    rows = [(n, float(x), float(m * YEAR), float(ratio * np.sqrt(YEAR))) for n, x, m in zip(names, w, means, strict=True)]
    return returns.sparkSession.createDataFrame(rows, schema)
