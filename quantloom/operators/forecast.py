"""Fitted forecasts of a series: features by windows, forests and boosted trees, intervals by a weighted bootstrap.

Features of a row look at the row's own and earlier values alone; the target is
the next value. Rows are split in time, so nothing after the split is learnt from.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAGS, WINDOWS = (1, 2, 3, 5), (21, 63, 126)
# Cumulative probabilities of a Poisson count with mean 1.
_POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999898047889443)


@dataclass(frozen=True)
class Forecast:
    trees: int = 100
    depth: int = 10
    boosts: int = 100
    boost_depth: int = 6
    share: float = 0.8  # of the rows, in order of time, that are learnt from
    blend: float = 0.5  # of the forest in the ensemble
    draws: int = 100  # of the bootstrap
    seed: int = 42


def features(series: DataFrame, exposures: tuple[str, ...] = (), by: tuple[str, ...] = ("book",), lags: tuple[int, ...] = LAGS, windows: tuple[int, ...] = WINDOWS) -> tuple[DataFrame, list[str]]:
    """(frame: by.., time, r, target, a column per feature; names) from (by.., time, r, exposures..): lagged values; mean, deviation, skewness and kurtosis of full windows; exposures by their share of the row's absolute sum, lagged and as a mean.

    Rows before the longest window is full are left out; the last row has no target.
    """
    order = Window.partitionBy(*by).orderBy("time")
    out: dict[str, Column] = {f"lag_{k}": F.lag("r", k).over(order) for k in lags}
    for n in windows:
        w = order.rowsBetween(-(n - 1), 0)
        out |= {f"mean_{n}": F.avg("r").over(w), f"std_{n}": F.stddev_samp("r").over(w), f"skew_{n}": F.coalesce(F.nanvl(F.skewness("r").over(w), F.lit(0.0)), F.lit(0.0)), f"kurt_{n}": F.coalesce(F.nanvl(F.kurtosis("r").over(w), F.lit(0.0)), F.lit(0.0))}
    size = reduce(lambda a, b: a + b, (F.abs(c) for c in exposures)) if exposures else None
    shares = series.withColumns({f"share_{c}": F.coalesce(F.col(c) / F.nullif(size, F.lit(0.0)), F.lit(0.0)) for c in exposures}) if exposures else series
    for c in exposures:
        out |= {f"{c}_lag": F.lag(f"share_{c}").over(order), f"{c}_mean": F.avg(f"share_{c}").over(order.rowsBetween(-20, 0))}
    full = max((*windows, max(lags) + 1))
    frame = shares.withColumns({**out, "target": F.lead("r").over(order), "row": F.row_number().over(order)}).filter(F.col("row") >= full)
    names = list(out)
    return frame.select(*by, "time", "r", "target", *names), names


def split(frame: DataFrame, share: float, by: tuple[str, ...] = ("book",)) -> DataFrame:
    """Adds ``learn``: whether a row is among the first ``share`` of its series' rows that have a target."""
    known = frame.groupBy(*by).agg(F.count("target").alias("known"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("time"))
    return frame.withColumn("place", place).join(known, list(by)).withColumn("learn", F.col("target").isNotNull() & (F.col("place") <= F.floor(F.col("known") * share))).drop("place", "known")


def _count(u: Column) -> Column:
    """A Poisson count of mean 1 from a uniform number."""
    return reduce(lambda a, p: a + (u > p[1]).cast("int"), list(enumerate(_POISSON)), F.lit(0))


def _draws(predictions: Column, trees: int, draws: int, seed: int) -> Column:
    """Means of the trees' predictions under ``draws`` sets of Poisson weights, the same sets for every row: a row's own interval, in one pass."""

    def mean(draw: Column) -> Column:
        uniform = lambda k: (F.pmod(F.xxhash64(draw, k, F.lit(seed)), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
        weighted = F.transform(F.arrays_zip(predictions.alias("p"), F.sequence(F.lit(1), F.lit(trees)).alias("k")), lambda x: F.struct(_count(uniform(x["k"])).cast("double").alias("w"), x["p"].alias("p")))
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
        return F.aggregate(weighted, zero, lambda acc, x: F.struct((acc["s"] + x["w"] * x["p"]).alias("s"), (acc["w"] + x["w"]).alias("w")), lambda acc: F.when(acc["w"] > 0, acc["s"] / acc["w"]))

    return F.array_compact(F.transform(F.sequence(F.lit(1), F.lit(draws)), mean))


def _quantile(values: Column, p: float) -> Column:
    """Linear between the neighbours of a sorted array."""
    at = (F.size(values) - 1) * p
    low = F.get(values, F.floor(at).cast("int"))
    return low + (F.get(values, F.ceil(at).cast("int")) - low) * (at - F.floor(at))


def forecast(frame: DataFrame, names: list[str], rule: Forecast = Forecast(), by: tuple[str, ...] = ("book",)) -> tuple[DataFrame, DataFrame]:
    """(forecasts, scores) from a frame of :func:`features`.

    forecasts: by.., time, target, learn, forest, boosted, forecast (their blend),
    mean, std, lower_95, lower_80, upper_80, upper_95 of the bootstrap over the
    forest's trees, moved to the blend. scores: learn, model, r2, rmse, n. All
    series are learnt from together; scaling comes from the rows learnt from.
    """
    marked = VectorAssembler(inputCols=names, outputCol="raw").transform(split(frame, rule.share, by))
    learnt = marked.filter("learn")
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(learnt).transform(marked)
    data = scaled.filter("learn").select("features", F.col("target").alias("label"))
    forest = RandomForestRegressor(numTrees=rule.trees, maxDepth=rule.depth, seed=rule.seed, featureSubsetStrategy="all", predictionCol="forest").fit(data)
    boosted = GBTRegressor(maxIter=rule.boosts, maxDepth=rule.boost_depth, seed=rule.seed, predictionCol="boosted").fit(data)
    out = boosted.transform(forest.transform(scaled))
    for k, tree in enumerate(forest.trees):
        out = tree.setPredictionCol(f"tree_{k}").transform(out)
    each = F.array(*(F.col(f"tree_{k}") for k in range(rule.trees)))
    blend = rule.blend * F.col("forest") + (1 - rule.blend) * F.col("boosted")
    # the forest's draws, moved to the ensemble: boosted trees are one sequence and have no draws of their own
    draws = F.sort_array(F.transform(_draws(each, rule.trees, rule.draws, rule.seed), lambda x: rule.blend * x + (1 - rule.blend) * F.col("boosted")))
    out = out.select(*by, "time", "target", "learn", "forest", "boosted", blend.alias("forecast"), draws.alias("draws"))
    mean = F.aggregate("draws", F.lit(0.0), lambda a, x: a + x) / F.size("draws")
    spread = F.sqrt(F.aggregate("draws", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.size("draws"))
    out = out.withColumn("mean", mean).withColumn("std", spread)
    bounds = {"lower_95": 0.025, "lower_80": 0.1, "upper_80": 0.9, "upper_95": 0.975}
    out = out.withColumns({c: _quantile(F.col("draws"), p) for c, p in bounds.items()}).drop("draws")
    long = out.filter("target is not null").unpivot(["learn", "target"], ["forest", "boosted", "forecast"], "model", "value")
    error = F.sum(F.pow(F.col("target") - F.col("value"), 2))
    scores = long.groupBy("learn", "model").agg((1 - error / F.nullif(F.var_pop("target") * F.count("target"), F.lit(0.0))).alias("r2"), F.sqrt(error / F.count("target")).alias("rmse"), F.count("target").alias("n"))
    return out, scores


def importances(model, names: list[str]) -> list[tuple[str, float]]:
    """(feature, importance) of a fitted forest or boosted model, the greatest first."""
    return sorted(zip(names, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])

