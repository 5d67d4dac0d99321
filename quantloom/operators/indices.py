"""Indices with members that change: membership intervals, the bars of members alone, weights by capitalisation, and books that hold an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import members_at


def ranked_membership(caps: DataFrame, names: int, period: str = "quarter") -> DataFrame:
    """(asset, start, end): the ``names`` of the largest mean cap of a ``period`` are members over the next one; adjoining periods are one interval, the last is open.

    ``caps``: (time, asset, cap). Ties go by name; names without a positive cap are left out.
    """
    begin = F.date_trunc(period, "time").cast("date")
    mean = caps.filter("cap > 0").groupBy(begin.alias("period"), "asset").agg(F.avg("cap").alias("cap"))
    best = mean.withColumn("k", F.row_number().over(Window.partitionBy("period").orderBy(F.desc(F.round("cap", 6)), "asset"))).filter(F.col("k") <= names)
    step = {"month": 1, "quarter": 3, "year": 12}[period]
    start = best.select("asset", F.add_months("period", step).alias("start"), F.add_months("period", 2 * step).alias("end"))
    last = start.agg(F.max("start")).first()[0]
    order = Window.partitionBy("asset").orderBy("start")
    new = F.coalesce((F.col("start") > F.lag("end").over(order)).cast("int"), F.lit(1))
    run = start.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    joined = run.groupBy("asset", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("start").alias("latest"))
    return joined.select("asset", "start", F.when(F.col("latest") < F.lit(last), F.col("end")).alias("end"))


def index_panel(bars: DataFrame, membership: DataFrame) -> DataFrame:
    """Bars (time, asset, ..) of names that are members at the bar's time, by membership intervals (asset, start, end)."""
    return members_at(bars, membership)


def index_caps(panel: DataFrame) -> DataFrame:
    """(time, asset, cap, w): capitalisation of the members (close x volume where ``cap`` is no column), carried on over gaps, and each one's share of the date."""
    cap = F.col("cap") if "cap" in panel.columns else F.col("close") * F.col("vol")
    carried = F.last(F.when(cap > 0, cap), True).over(Window.partitionBy("asset").orderBy("time").rowsBetween(Window.unboundedPreceding, 0))
    held = panel.select("time", "asset", F.coalesce(carried, F.lit(0.0)).alias("cap"))
    total = F.sum("cap").over(Window.partitionBy("time"))
    return held.select("time", "asset", "cap", F.when(total > 0, F.col("cap") / total).otherwise(0.0).alias("w"))


def index_book(panel: DataFrame, weighting: str = "equal", rebalance: str | None = None) -> DataFrame:
    """(time, asset, w) of a book that holds the index: ``equal`` or ``cap`` weights on rebalancing dates, drifting with returns between them.

    ``panel``: (time, asset, ret, ..) of members. ``rebalance``: day (None), week,
    month or quarter; between the first dates of two periods the names of the first
    keep their holdings, each grown by its returns; a name that leaves is sold when
    it leaves, and what is left counts as the whole.
    """
    if weighting not in ("equal", "cap"):
        raise ValueError(weighting)
    base = index_caps(panel) if weighting == "cap" else panel.select("time", "asset", (1.0 / F.count(F.lit(1)).over(Window.partitionBy("time"))).alias("w"))
    if rebalance in (None, "day"):
        return base.select("time", "asset", "w")
    period = F.date_trunc(rebalance, "time").cast("date")
    both = panel.select("time", "asset", "ret").join(base.select("time", "asset", "w"), ["time", "asset"]).withColumn("period", period)
    both = both.withColumn("first", F.min("time").over(Window.partitionBy("period")))
    order = Window.partitionBy("asset", "period").orderBy("time")
    # held on from the first date on: the weight of that date, grown by the returns since
    start = F.first(F.when(F.col("time") == F.col("first"), F.col("w"))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    since = F.sum(F.when(F.col("time") > F.col("first"), F.log1p(F.greatest(F.coalesce("ret", F.lit(0.0)), F.lit(-0.999999)))).otherwise(0.0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    grown = both.select("time", "asset", (start * F.exp(since)).alias("v")).filter("v is not null")
    return grown.select("time", "asset", (F.col("v") / F.sum("v").over(Window.partitionBy("time"))).alias("w"))


def index_returns(panel: DataFrame, book: DataFrame) -> DataFrame:
    """(time, r, names): the return of a book of the index, each date's weights earning the next bar's return of the same name."""
    dates = panel.select("time").distinct().withColumn("next", F.lead("time").over(Window.orderBy("time")))
    earned = book.join(dates, "time").select(F.col("next").alias("time"), "asset", "w").join(panel.select("time", "asset", "ret"), ["time", "asset"], "left")
    out = earned.filter("time is not null").groupBy("time").agg(F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("r"), F.count("ret").alias("names"))
    return out
