"""Sleeves: scores of several factor groups, each weighted by its own information coefficients, then weighted among each other.

Level one: within a sleeve, factors are weighted by their smoothed rank
correlation with forward returns, less where they resemble each other, for each of
the sleeve's horizons; the sleeve's score is the mean over horizons. Level two:
sleeves are weighted by their own smoothed correlation with the forward return,
less where sleeves resemble each other, times a prior that moves with the market's
drawdown. All series by date are aggregates or windows; correlations among factors
of one date are a matrix of factors by names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dsl

EPS = 1e-12


@dataclass(frozen=True)
class Sleeve:
    """``stress``: by how much full stress raises (or, below 0, cuts) the sleeve's weight."""

    name: str
    factors: tuple[str, ...]
    horizons: tuple[int, ...] = (21,)
    stress: float = 0.0


@dataclass(frozen=True)
class Weighting:
    decay: float = 0.95
    clip: float = 0.25
    penalty: float = 0.30
    least_diversity: float = 0.25
    least_weight: float = 0.012
    delay: int = 1
    boost: float = 0.0  # by how much the factor of the best mean smoothed correlation of ``boost_rows`` dates up to now gains
    boost_rows: int = 21


@dataclass(frozen=True)
class Allocation:
    horizon: int = 21
    decay: float = 0.94
    penalty: float = 0.35
    least_diversity: float = 0.25
    least_weight: float = 0.12
    drawdown_rows: int = 126
    full_stress: float = 0.10  # a drawdown of this much is full stress


def average_rank(x: str, *by: str) -> Column:
    """Rank within ``by``, the mean of their places for equal values."""
    part = Window.partitionBy(*by)
    return F.rank().over(part.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2


def rank_ic(values: DataFrame, *by: str, x: str = "z", y: str = "fwd") -> DataFrame:
    """(by.., ic): correlation of the ranks of ``x`` and ``y`` within ``by``; 0 where one of them does not vary."""
    ranked = values.select(*by, average_rank(x, *by).alias("a"), average_rank(y, *by).alias("b"))
    size = F.stddev_pop("a") * F.stddev_pop("b")
    return ranked.groupBy(*by).agg(F.coalesce(F.when(size > EPS, F.covar_pop("a", "b") / F.nullif(size, F.lit(0.0))), F.lit(0.0)).alias("ic"))


def smoothed(ic: DataFrame, keys: tuple[str, ...], decay: float, clip: float | None = None, delay: int = 1) -> DataFrame:
    """(time, keys.., s): clipped, delayed, then the bias-corrected exponential mean; 0 before the first."""
    x = F.col("ic") if clip is None else F.greatest(F.least("ic", F.lit(clip)), F.lit(-clip))
    order = Window.partitionBy(*keys).orderBy("time")
    series = ic.select("time", *keys, F.coalesce(F.lag(x, delay).over(order), F.lit(0.0)).alias("x"), (F.row_number().over(order) - 1).cast("double").alias("t"), F.to_json(F.struct(*keys)).alias("asset"))
    return dsl.compute(series, {"s": dsl.ewma(dsl.col("x"), decay)}, keys=("time", *keys))


def diversity(values: DataFrame, group: tuple[str, ...], member: str, x: str = "z") -> DataFrame:
    """(group.., member, p): one less the mean absolute correlation of a member's values with the other members', across the names of the group.

    A group's matrix (members by names) is in one task: both are bounded by the
    number of factors and of names on a date, not by the number of dates.
    """
    kinds = dict(values.dtypes)

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        z = p.pivot_table(index=member, columns="asset", values=x, aggfunc="first").fillna(0.0)
        v = z.to_numpy()
        n = len(z)
        if n < 2 or v.shape[1] < 2:
            out = np.ones(n)
        else:
            v = v - v.mean(1, keepdims=True)
            size = np.sqrt((v * v).sum(1))
            v = np.divide(v, size[:, None], out=np.zeros_like(v), where=size[:, None] > EPS)
            corr = np.abs(v @ v.T)
            np.fill_diagonal(corr, 0.0)
            out = 1 - corr.mean(1)
        return pd.DataFrame({**{g: k for g, k in zip(group, key, strict=True)}, member: z.index, "p": out})

    schema = ", ".join([*(f"{g} {kinds[g]}" for g in group), f"{member} {kinds[member]}", "p double"])
    return values.select(*group, member, "asset", x).groupBy(*group).applyInPandas(run, schema)


def normalised(raw: Column, *by: str) -> Column:
    """Shares of the sum within ``by``; equal where it is 0."""
    part = Window.partitionBy(*by)
    total = F.sum(raw).over(part)
    return F.when(total > EPS, raw / F.nullif(total, F.lit(0.0))).otherwise(1 / F.count(F.lit(1)).over(part))


def sleeve_scores(panel: DataFrame, sleeves: tuple[Sleeve, ...], rule: Weighting = Weighting()) -> tuple[DataFrame, DataFrame]:
    """(scores: time, sleeve, asset, score; weights: time, sleeve, factor, w) from a panel (time, asset, a column per factor, a column fwd_<h> per horizon).

    Scores and weights are means over the sleeve's horizons. Missing values are 0.
    Give a stored panel: it is read once for the scores and once per step of the weights.
    """
    names = list(dict.fromkeys(f for s in sleeves for f in s.factors))
    horizons = sorted({h for s in sleeves for h in s.horizons})
    zero = lambda c: F.round(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)), 9)
    clean = panel.select("time", "asset", *(zero(c).alias(c) for c in [*names, *(f"fwd_{h}" for h in horizons)]))
    long = clean.unpivot(["time", "asset", *(f"fwd_{h}" for h in horizons)], names, "factor", "z")
    ic = reduce(DataFrame.union, (rank_ic(long, "time", "factor", y=f"fwd_{h}").select("time", "factor", F.lit(h).alias("horizon"), "ic") for h in horizons))
    ic = smoothed(ic, ("factor", "horizon"), rule.decay, rule.clip, rule.delay)
    member = F.explode(F.array(*(F.struct(F.lit(s.name).alias("sleeve"), F.lit(f).alias("factor"), F.array(*map(F.lit, s.horizons)).alias("horizons")) for s in sleeves for f in s.factors)))
    spark = panel.sparkSession
    members = spark.range(1).select(member.alias("m")).select("m.*")  # as many as the sleeves list
    within = F.broadcast(members.select("sleeve", "factor"))
    share = ic.join(F.broadcast(members.select("sleeve", "factor", F.explode("horizons").alias("horizon"))), ["factor", "horizon"])
    share = share.withColumn("w", normalised(F.greatest("s", F.lit(0.0)), "time", "sleeve", "horizon"))
    part = Window.partitionBy("time", "sleeve", "horizon")
    cut = share
    if rule.penalty:
        apart = diversity(long.select("time", "asset", "factor", "z").join(within, "factor"), ("time", "sleeve"), "factor").withColumn("p", F.greatest("p", F.lit(rule.least_diversity)))
        cut = share.join(apart, ["time", "sleeve", "factor"]).withColumn("w", F.greatest(F.col("w") * (1 - rule.penalty * (1 - F.col("p"))), F.lit(0.0)))
        cut = cut.withColumn("w", F.col("w") / (F.sum("w").over(part) + EPS))
    if rule.least_weight:
        cut = cut.withColumn("floor", F.greatest("w", F.lit(rule.least_weight)))
        cut = cut.withColumn("w", F.when(F.sum("w").over(part) > EPS, F.col("floor") / (F.sum("floor").over(part) + EPS)).otherwise(F.col("w")))
    if rule.boost:
        recent = F.avg("s").over(Window.partitionBy("sleeve", "factor", "horizon").orderBy("time").rowsBetween(-(rule.boost_rows - 1), 0))
        low, high = F.min("recent").over(part), F.max("recent").over(part)
        cut = cut.withColumn("recent", recent).withColumn("gain", F.when(high - low > EPS, 1 + rule.boost * (F.col("recent") - low) / (high - low + EPS)).otherwise(1.0))
        cut = cut.withColumn("w", F.col("w") * F.col("gain")).withColumn("w", F.col("w") / (F.sum("w").over(part) + EPS))
    weights = cut.groupBy("time", "sleeve", "factor").agg(F.avg("w").alias("w"))
    scores = long.select("time", "asset", "factor", "z").join(weights, ["time", "factor"]).groupBy("time", "sleeve", "asset").agg(F.sum(F.col("z") * F.col("w")).alias("score"))
    return scores, weights


def drawdown(returns: DataFrame, rows: int) -> DataFrame:
    """(time, fall): how far the market, the mean return of all names, is below its highest point of ``rows`` dates."""
    order = Window.orderBy("time")  # a row per date
    market = returns.groupBy("time").agg(F.avg(F.coalesce("ret", F.lit(0.0))).alias("m"))
    market = market.withColumn("growth", F.exp(F.sum(F.log1p("m")).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    peak = F.max("growth").over(order.rowsBetween(-(rows - 1), 0))
    return market.select("time", F.greatest(F.least((peak - F.col("growth")) / (peak + EPS), F.lit(1.0)), F.lit(0.0)).alias("fall"))


def sleeve_weights(scores: DataFrame, panel: DataFrame, sleeves: tuple[Sleeve, ...], rule: Allocation = Allocation()) -> DataFrame:
    """(time, sleeve, w) from scores (time, sleeve, asset, score) and a panel (time, asset, ret, fwd_<horizon>): weights sum to 1 on every date."""
    fwd = f"fwd_{rule.horizon}"
    both = scores.select("time", "sleeve", "asset", F.round("score", 9).alias("z")).join(panel.select("time", "asset", F.round(F.coalesce(fwd, F.lit(0.0)), 9).alias("fwd")), ["time", "asset"])
    ic = smoothed(rank_ic(both, "time", "sleeve"), ("sleeve",), rule.decay)
    apart = diversity(both, ("time",), "sleeve")
    bounded = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(rule.least_diversity))
    apart = apart.select("time", "sleeve", bounded(1 - rule.penalty * (1 - bounded(F.col("p")))).alias("p"))
    stress = drawdown(panel, rule.drawdown_rows).select("time", F.least(F.col("fall") / (rule.full_stress + EPS), F.lit(1.0)).alias("stress"))
    tilt = F.create_map(*(F.lit(x) for s in sleeves for x in (s.name, float(s.stress))))[F.col("sleeve")]
    raw = F.greatest("s", F.lit(0.0)) * F.col("p") * (1 + tilt * F.col("stress"))
    raw = F.greatest(raw, F.lit(rule.least_weight))
    return ic.join(apart, ["time", "sleeve"]).join(stress, "time").select("time", "sleeve", normalised(raw, "time").alias("w"))


def combined(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(time, asset, score): the sleeves' scores by their weights."""
    return scores.join(weights, ["time", "sleeve"]).groupBy("time", "asset").agg(F.sum(F.col("score") * F.col("w")).alias("score"))


def factor_shares(weights: DataFrame, sleeve: DataFrame) -> DataFrame:
    """(time, factor, w): what each factor weighs over all sleeves, summing to 1."""
    total = weights.join(sleeve.withColumnRenamed("w", "sw"), ["time", "sleeve"]).groupBy("time", "factor").agg(F.sum(F.col("w") * F.col("sw")).alias("w"))
    return total.select("time", "factor", (F.col("w") / (F.sum("w").over(Window.partitionBy("time")) + EPS)).alias("w"))

