"""Monitoring of books, signals and data: functions of DataFrames with their limits as parameters.

A frame of positions has a row per (time, asset): ``w`` the weight, ``ret`` the
return of the bar. The queries at the end apply the functions to the book of
positions; their SQL is written on its own, not rendered from the functions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dsl import DUCK, Dialect
from ..functions.special import t_p_value
from .book import bars, book, regimes, series, signals
from .construct import capped_simplex
from .inference import t_p_sql
from .portfolio import _ic

YEAR = 252**0.5


def _r(x: Column, decimals: int = 6) -> Column:
    return F.round(x, decimals) + F.lit(0.0)


def _rounded(df: DataFrame, keys: tuple[str, ...], decimals: int = 6) -> DataFrame:
    return df.select(*(F.col(c) if c in keys or t not in ("double", "float") else _r(F.col(c), decimals).alias(c) for c, t in df.dtypes))


def _clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def _correlation(a: str, b: str) -> Column:
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 1e-12, F.covar_pop(a, b) / spread)


def signal_freshness(ic: DataFrame, lookback: int = 21) -> DataFrame:
    """(time, factor, ic) to one row: recent over past mean absolute correlation within 0 and 1, and its trend; 0.5 and unknown before twice ``lookback`` dates."""
    by_date = ic.groupBy("time").agg(F.avg(F.abs("ic")).alias("x"))
    numbered = by_date.withColumn("k", F.row_number().over(Window.orderBy(F.desc("time"))))
    s = numbered.agg(F.count("x").alias("n"), F.avg(F.when(F.col("k") <= lookback, F.col("x"))).alias("recent"), F.avg(F.when(F.col("k") > lookback, F.col("x"))).alias("past"))
    known = F.coalesce((F.col("n") >= 2 * lookback) & (F.col("past") >= 1e-12), F.lit(False))
    ratio = F.col("recent") / F.col("past")
    trend = F.when(~known, "unknown").when(ratio > 1.1, "improving").when(ratio < 0.9, "declining").otherwise("stable")
    return s.select(F.when(known, _clip(ratio, 0, 1)).otherwise(0.5).alias("freshness"), trend.alias("trend"))


def risk_budget(returns: DataFrame, target: float = 0.15, most: float = 0.25, drawdown_limit: float = -0.2) -> DataFrame:
    """(time, r) to one row: how much of the limits on deviation and present drawdown is used (0.6 and 0.4 of the whole)."""
    grown = returns.withColumn("g", F.sum(F.log1p("r")).over(Window.orderBy("time").rowsBetween(Window.unboundedPreceding, 0)))
    s = grown.agg((F.stddev_samp("r") * YEAR).alias("vol"), (1 - F.exp(F.max_by("g", "time") - F.max("g"))).alias("down"))
    vol, down = F.col("vol") / target, F.col("down") / abs(drawdown_limit)
    whole = 0.6 * vol + 0.4 * down
    return s.select("vol", "down", vol.alias("vol_used"), (1 - F.col("vol") / most).alias("vol_headroom"), down.alias("down_used"), F.greatest(1 - down, F.lit(0.0)).alias("down_headroom"), whole.alias("used"), F.greatest(1 - whole, F.lit(0.0)).alias("remaining"))


def sector_health(exposure: DataFrame, portfolio_vol: float | None = None) -> DataFrame:
    """(time, sector, x) to a row per sector: parts of a health score of 0 to 100, each relative to the other sectors; fewer than 20 rows give neutral parts."""
    order = Window.partitionBy("sector").orderBy("time")
    rows = exposure.filter("x is not null").withColumn("d", F.col("x") - F.lag("x").over(order)).withColumn("k", F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("time"))))
    within = lambda n, x: F.when(F.col("k") <= n, x)
    at = lambda n: F.max(F.when(F.col("k") == n, F.col("x")))
    s = rows.groupBy("sector").agg(
        F.count("x").alias("n"), (F.stddev_samp("d") * YEAR).alias("own_vol"), (F.stddev_samp("x") * YEAR).alias("spread"), at(1).alias("weight"), at(10).alias("tenth"),
        F.avg(within(5, F.col("x"))).alias("ma5"), F.avg(within(20, F.col("x"))).alias("ma20"), F.avg(within(10, (F.col("d") > 0).cast("double"))).alias("up"),
    )
    every = Window.partitionBy(F.lit(1))  # a row per sector
    enough = F.col("n") >= 20
    default = F.lit(portfolio_vol) if portfolio_vol else F.coalesce(F.avg("spread").over(every), F.lit(0.15))
    s = s.withColumn("volatility", F.when(enough, F.col("own_vol")).otherwise(default))
    s = s.withColumn("recent_return", F.when(enough & (F.col("tenth") != 0), F.col("weight") / F.col("tenth") - 1).otherwise(0.0))
    s = s.withColumn("momentum", F.when(enough & (F.round("ma20", 12) != 0), F.col("ma5") / F.col("ma20") - 1).otherwise(0.0))
    s = s.withColumn("trend_pct", F.when(enough, F.col("up")).otherwise(0.5))
    z = lambda c: (F.col(c) - F.avg(c).over(every)) / (F.stddev_pop(c).over(every) + 1e-8)
    squares, risk = F.col("weight") ** 2, F.abs("weight") * F.col("volatility")
    s = s.select(
        "sector", "weight", "volatility", "recent_return", "trend_pct", risk.alias("risk"), (100 * risk / (F.sum(risk).over(every) + 1e-12)).alias("risk_pct"),
        (12.5 + _clip(12.5 * z("momentum"), -12.5, 12.5)).alias("momentum_score"), (25 - _clip(12.5 * z("volatility"), -12.5, 12.5)).alias("volatility_score"),
        (20 * F.col("trend_pct")).alias("trend_score"), (10 + _clip(10 * z("recent_return"), -10, 10)).alias("return_score"), (10 * squares / (F.sum(squares).over(every) + 1e-8)).alias("penalty"),
    )
    total = F.col("momentum_score") + F.col("volatility_score") + F.col("trend_score") + F.col("return_score") - F.col("penalty")
    return s.withColumn("health_score", _clip(total, 0, 100))


def position_alerts(positions: DataFrame, most: float = 0.1, loss: float = -0.01, gain: float = 0.02) -> DataFrame:
    """A row per rule that an asset breaks: its weight, its trades of the last five bars against twice its mean, its whole profit (``pnl`` a bar)."""
    order = Window.partitionBy("asset").orderBy("time")
    rows = positions.withColumn("d", F.abs(F.col("w") - F.lag("w").over(order))).withColumn("k", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("time"))))
    s = rows.groupBy("asset").agg(F.abs(F.max_by("w", "time")).alias("last"), F.round(F.avg(F.when(F.col("k") <= 5, F.col("d"))), 12).alias("recent"), F.round(F.avg("d"), 12).alias("usual"), F.sum("pnl").alias("pnl"))
    alert = lambda severity, category, value: F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.col(value).alias("value"))
    found = F.array(
        F.when(F.col("last") > most, alert("warning", "concentration", "last")),
        F.when((F.col("recent") > 2 * F.col("usual")) & (F.col("usual") > 0), alert("info", "turnover", "recent")),
        F.when(F.col("pnl") < loss, alert("warning", "profit", "pnl")).when(F.col("pnl") > gain, alert("info", "profit", "pnl")),
    )
    return s.select("asset", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("a")).select("asset", "a.*")


def scorecard(returns: DataFrame, least: int = 20) -> DataFrame:
    """(time, asset, ret) to a row per asset of ratios, tail, moments, the t-statistic and its two-sided p-value; zeros (no p-value) below ``least`` rows. A value at risk is the 5 % quantile."""
    rows = returns.filter("ret is not null")
    order = Window.partitionBy("asset").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    grown = rows.withColumn("g", F.sum(F.log1p("ret")).over(order)).withColumn("down", F.exp(F.col("g") - F.max("g").over(order)) - 1)
    cut = rows.groupBy("asset").agg(F.expr("percentile(ret, 0.05)").alias("var_95"))
    negative = F.when(F.col("ret") < 0, F.col("ret"))
    s = grown.join(cut, "asset").groupBy("asset").agg(
        F.count("ret").alias("n"), (F.avg("ret") * 252).alias("mean"), (F.stddev_samp("ret") * YEAR).alias("vol"), F.count(negative).alias("losses"), (F.stddev_samp(negative) * YEAR).alias("below"),
        F.min("down").alias("max_drawdown"), F.first("var_95").alias("var_95"), F.avg(F.when(F.col("ret") <= F.col("var_95") + 1e-12, F.col("ret"))).alias("cvar_95"),
        F.min("ret").alias("worst"), F.skewness("ret").alias("skewness"), F.kurtosis("ret").alias("kurtosis"),
    )
    values = {
        "sharpe": F.col("mean") / (F.col("vol") + 1e-12),
        "sortino": F.col("mean") / (F.when(F.col("losses") > 0, F.col("below")).otherwise(F.col("vol")) + 1e-12),
        "calmar": F.col("mean") / (F.abs("max_drawdown") + 1e-12),
        **{c: F.col(c) for c in ("var_95", "cvar_95", "max_drawdown", "worst", "skewness", "kurtosis")},
        "t_stat": F.when(F.col("vol") > 1e-12, F.col("mean") / 252 / (F.col("vol") / YEAR / F.sqrt(F.col("n")))),
    }
    out = s.select("asset", "n", *(F.when(F.col("n") < least, 0.0).otherwise(v).alias(c) for c, v in values.items()))
    return out.withColumn("p_value", F.when((F.col("n") >= max(least, 2)) & F.col("t_stat").isNotNull(), t_p_value(F.col("t_stat"), F.col("n") - 1)))


def signal_quality(positions: DataFrame, horizons: int = 21, least: int = 20) -> DataFrame:
    """Correlation, plain and of average ranks, of an asset's weight with its return 1 to ``horizons`` bars on; horizons with fewer than ``least`` rows are left out."""
    order = Window.partitionBy("asset").orderBy("time")
    later = F.array(*(F.lead("ret", h).over(order) for h in range(1, horizons + 1)))
    long = positions.select("asset", "w", later.alias("ahead")).withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizons)))).select("asset", "horizon", "w", F.element_at("ahead", F.col("horizon")).alias("later")).filter("w is not null and later is not null")
    group = Window.partitionBy("asset", "horizon")
    rank = lambda c: F.rank().over(group.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("asset", "horizon", c)) - 1) / 2
    ranked = long.withColumn("a", rank("w")).withColumn("b", rank("later"))
    return ranked.groupBy("asset", "horizon").agg(F.count(F.lit(1)).alias("n"), _correlation("w", "later").alias("pearson_ic"), _correlation("a", "b").alias("rank_ic")).filter(F.col("n") >= least)


def hit_rates(positions: DataFrame) -> DataFrame:
    """How often an asset's position has the sign of the next return, and the mean size of that return when it has and has not; null below 21 rows or 11 positions."""
    rows = positions.withColumn("next", F.lead("ret").over(Window.partitionBy("asset").orderBy("time"))).filter("w is not null and next is not null")
    held = F.abs("w") > 1e-12
    right = F.signum("w") * F.signum("next") > 0
    size = F.abs("next")
    s = rows.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(held, 1)).alias("held"), F.avg(F.when(held, right.cast("double"))).alias("hit_rate"), F.coalesce(F.avg(F.when(held & right, size)), F.lit(0.0)).alias("mean_right"), F.coalesce(F.avg(F.when(held & ~right, size)), F.lit(0.0)).alias("mean_wrong"))
    enough = (F.col("n") > 20) & (F.col("held") > 10)
    return s.select("asset", "held", *(F.when(enough, F.col(c)).alias(c) for c in ("hit_rate", "mean_right", "mean_wrong")))


def returns_against_portfolio(positions: DataFrame, returns: DataFrame) -> DataFrame:
    """Growth of every asset and of the portfolio (time, r) over the bars that both have."""
    order = Window.partitionBy("asset").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    both = positions.filter("ret is not null").join(returns.filter("r is not null").select("time", "r"), "time")
    return both.select("time", "asset", (F.exp(F.sum(F.log1p("ret")).over(order)) - 1).alias("growth"), (F.exp(F.sum(F.log1p("r")).over(order)) - 1).alias("portfolio"))


def rolling_correlation(positions: DataFrame, returns: DataFrame, window: int = 63) -> DataFrame:
    """Correlation of an asset's returns with the portfolio's (time, r) over full windows."""
    over = Window.partitionBy("asset").orderBy("time").rowsBetween(1 - window, 0)
    both = positions.filter("ret is not null").join(returns.filter("r is not null").select("time", "r"), "time")
    spread = F.stddev_samp("ret").over(over) * F.stddev_samp("r").over(over)
    x = both.select("time", "asset", F.count("ret").over(over).alias("n"), F.when(spread > 1e-12, F.covar_samp("ret", "r").over(over) / spread).alias("corr"))
    return x.filter((F.col("n") >= window) & F.col("corr").isNotNull()).drop("n")


def regime_exposure(positions: DataFrame, regime: DataFrame) -> DataFrame:
    """Weights of every asset by regime (time, regime)."""
    held = F.abs("w") > 1e-12
    x = positions.join(regime.select("time", "regime"), "time")
    return x.groupBy("asset", "regime").agg(F.avg("w").alias("avg_weight"), F.max(F.abs("w")).alias("max_weight"), F.count(F.when(held, 1)).alias("bars_held"), F.count(F.lit(1)).alias("bars"), F.avg(held.cast("double")).alias("share_held"))


def rolling_risk(positions: DataFrame, window: int = 63, top: int = 5) -> DataFrame:
    """Deviation of today's weights over the ``window`` bars before, and the share of its variance that the ``top`` assets have.

    A weight meets its asset's past returns by bar number, so rows grow with
    (positions held x window); covariances with the portfolio of the date stand for
    the matrix of all assets.
    """
    numbers = positions.select("time").distinct().withColumn("i", F.row_number().over(Window.orderBy("time")))
    rows = positions.join(numbers, "time")
    held = rows.filter((F.abs("w") > 1e-12) & (F.col("i") > window)).select("time", "i", "asset", "w", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("lag"))
    x = held.withColumn("j", F.col("i") - F.col("lag")).join(rows.select("asset", F.col("i").alias("j"), "ret"), ["asset", "j"])
    mixed = x.withColumn("p", F.sum(F.col("w") * F.col("ret")).over(Window.partitionBy("time", "j")))
    parts = mixed.groupBy("time", "asset").agg((F.first("w") * F.covar_samp("ret", "p") * 252).alias("c"))
    ranked = parts.withColumn("k", F.row_number().over(Window.partitionBy("time").orderBy(F.desc(F.abs("c")), "asset")))
    s = ranked.groupBy("time").agg(F.sum("c").alias("variance"), F.sum(F.when(F.col("k") <= top, F.abs("c"))).alias("most"), F.count(F.lit(1)).alias("n_assets"))
    return s.select("time", F.sqrt(F.greatest("variance", F.lit(0.0))).alias("vol"), (F.col("most") / (F.col("variance") + 1e-12)).alias("top_share"), "n_assets")


def cap_weighted_index(panel: DataFrame) -> DataFrame:
    """(time, asset, cap, ret) to the return by capitalisation; a missing one is carried on from the asset's last."""
    before = Window.partitionBy("asset").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    x = panel.withColumn("c", F.coalesce(F.last("cap", True).over(before), F.lit(0.0)))
    total = F.sum("c")
    return x.groupBy("time").agg(F.when(total > 0, F.sum(F.col("c") * F.coalesce("ret", F.lit(0.0))) / total).otherwise(0.0).alias("ret"), F.count(F.when(F.col("c") > 0, 1)).alias("names"))


def apply_overlay(weights: DataFrame, budget: DataFrame, overlay: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights (time, asset, w) times the overlay (time, asset, scale), and the budget (time, budget) times its mean over the assets; where one is missing, 0."""
    w = weights.join(overlay.select("time", "asset", "scale"), ["time", "asset"], "left").select("time", "asset", F.coalesce(F.col("w") * F.col("scale"), F.lit(0.0)).alias("w"))
    mean = overlay.groupBy("time").agg(F.avg("scale").alias("scale"))
    return w, budget.join(mean, "time", "left").select("time", F.coalesce(F.col("budget") * F.col("scale"), F.lit(0.0)).alias("budget"))


def replaced_weights(weights: DataFrame, wanted: DataFrame) -> DataFrame:
    """Weights (asset, w) with those of ``wanted`` put in their place, or added."""
    return weights.select("asset", "w").join(wanted.select("asset", F.col("w").alias("x")), "asset", "full").select("asset", F.coalesce("x", "w").alias("w"))


def constrained_book(weights: DataFrame, gross: float = 1.0, net: float | None = None, least: float = 0.0, most: float = 0.1, pins: tuple[str, ...] = ()) -> DataFrame:
    """(time, asset, w) with each side of a date projected to its part of ``gross``, weights at most ``most``, those of pins at least ``least``; no ``net`` keeps the sides' parts."""
    sides = Window.partitionBy("time")
    long, short = F.sum(F.greatest("w", F.lit(0.0))).over(sides), F.sum(F.greatest(-F.col("w"), F.lit(0.0))).over(sides)
    up = F.lit((gross + net) / 2) if net is not None else F.when(long + short > 0, long / (long + short + 1e-12) * gross).otherwise(gross / 2)
    down = F.lit((gross - net) / 2) if net is not None else F.when(long + short > 0, short / (long + short + 1e-12) * gross).otherwise(gross / 2)
    x = weights.withColumn("w", F.coalesce("w", F.lit(0.0))).select("time", "asset", "w", F.signum("w").alias("side"), F.when(F.col("w") > 0, up).when(F.col("w") < 0, down).otherwise(0.0).alias("target"))

    def project(part):
        side = part["side"].iloc[0]
        lo = part["asset"].isin(pins).to_numpy() * least
        found = capped_simplex(part["w"].abs().to_numpy(), part["target"].iloc[0], lo, np.full(len(part), most)) if side else part["w"].to_numpy()
        return part.assign(w=found * (side or 1.0))[["time", "asset", "w"]]

    return x.groupBy("time", "side").applyInPandas(project, weights.select("time", "asset", F.col("w").cast("double").alias("w")).schema)


def grid_surface(df: DataFrame, first: tuple[str, list[float]], second: tuple[str, list[float]], score: Callable[[Column, Column], Column]) -> DataFrame:
    """Score of every pair of two parameters' values: a row per value of the first, a column per value of the second; ``score`` makes an aggregate of both."""
    (a, many), (b, wide) = first, second
    rows = df.withColumn(a, F.explode(F.array(*map(F.lit, many))))
    return rows.groupBy(a).agg(*(score(F.col(a), F.lit(v)).alias(f"{b}_{v:g}".replace(".", "_")) for v in wide))


def all_checks(panel: DataFrame, gap: int = 5) -> DataFrame:
    """Bars (time, asset, open, high, low, close, vol) to counts by asset and check: gaps of over ``gap`` days, order and sign of prices, volumes, repeated keys."""
    row = {
        "high_below_low": "high < low", "high_below_open": "high < open", "high_below_close": "high < close", "low_above_open": "low > open", "low_above_close": "low > close",
        "negative_close": "close < 0", "zero_close": "close = 0", "negative_volume": "vol < 0", "zero_volume": "vol = 0",
    }
    before = F.lag("time").over(Window.partitionBy("asset").orderBy("time"))
    x = panel.withColumn("gap", F.datediff("time", before))
    counts = {c: F.count(F.when(F.expr(t), 1)) for c, t in row.items()} | {"gaps": F.count(F.when(F.col("gap") > gap, 1)), "repeated": F.count(F.when(F.col("gap") == 0, 1))}
    return x.groupBy("asset").agg(*(v.alias(c) for c, v in counts.items())).unpivot("asset", list(counts), "check", "n")


def _frame(spark: SparkSession, sf_dir: str, of: Callable[[Dialect], str], columns: str = "*") -> DataFrame:
    return spark.sql(f"select {columns} from {of(Dialect('spark', sf_dir))} x")


def _positions(spark, sf_dir):
    return _frame(spark, sf_dir, book, "time, asset, w, wl, ret, sector, wl * ret pnl, close * vol cap")


def _regimes(d: Dialect) -> str:
    return f"(select time, regime from {regimes(d)} y)"


def _overlay(d: Dialect) -> str:
    return f"(select time, asset, least(greatest(1 - 2 * round(atr / nullif(close, 0), 8), 0.5e0), 1.25e0) scale from {signals(d)} y)"


def _overlaid(spark, sf_dir):
    b = _positions(spark, sf_dir)
    w, budget = apply_overlay(b, b.select("time").distinct().withColumn("budget", F.lit(1.2)), _frame(spark, sf_dir, _overlay))
    return w.join(budget, "time")


_GRID = (("bps", [0.0, 5.0, 10.0, 20.0]), ("leverage", [0.5, 1.0, 2.0]))


def _surface(spark, sf_dir):
    return grid_surface(_frame(spark, sf_dir, series, "r, turnover"), *_GRID, lambda bps, leverage: F.sum(F.log1p(F.greatest(leverage * (F.col("r") - F.col("turnover") * bps / 1e4), F.lit(-0.99)))))


QUERIES = {
    "signal_freshness": lambda s, p: _rounded(signal_freshness(_frame(s, p, _ic)), ()),
    "risk_budget": lambda s, p: _rounded(risk_budget(_frame(s, p, series)), ()),
    "sector_health": lambda s, p: _rounded(sector_health(_positions(s, p).groupBy("time", "sector").agg(F.round(F.sum("w"), 10).alias("x"))), ("sector",), 5),
    "position_alerts": lambda s, p: _rounded(position_alerts(_positions(s, p)), ()),
    "scorecard": lambda s, p: _rounded(scorecard(_positions(s, p)), (), 5),
    "signal_quality": lambda s, p: _rounded(signal_quality(_positions(s, p)), ()),
    "hit_rates": lambda s, p: _rounded(hit_rates(_positions(s, p)), ()),
    "returns_against_portfolio": lambda s, p: _rounded(returns_against_portfolio(_positions(s, p), _frame(s, p, series)), ()),
    "rolling_stock_correlation": lambda s, p: _rounded(rolling_correlation(_positions(s, p), _frame(s, p, series)), ()),
    "regime_exposure": lambda s, p: _rounded(regime_exposure(_positions(s, p), _frame(s, p, _regimes)), ()),
    "rolling_risk": lambda s, p: _rounded(rolling_risk(_positions(s, p)), (), 5),
    "cap_weighted_index": lambda s, p: _rounded(cap_weighted_index(_positions(s, p).withColumn("cap", F.expr("case when cap > 0 then cap end"))), ()),
    "overlaid_book": lambda s, p: _rounded(_overlaid(s, p), ()),
    "whatif_constraints": lambda s, p: _rounded(constrained_book(_positions(s, p), gross=1.0, net=0.2, least=0.05, most=0.15, pins=("Brand#11",)), ()),
    "cost_leverage_surface": lambda s, p: _rounded(_surface(s, p), ("bps",), 5),
    "all_checks": lambda s, p: all_checks(_frame(s, p, lambda d: bars(d, unit="day")).filter("vol > 0")),
}


def oracles() -> dict[str, str]:
    """SQL of the queries but ``whatif_constraints``, whose projection is tested against a plain search."""
    d = DUCK
    b, s, q = f"(select *, wl * ret pnl from {book(d)} k)", series(d), lambda x, n=6: f"round({x}, {n}) + 0.0"
    past = "avg(x) filter (k > 21)"
    tail = f"(select asset, quantile_cont(ret, 0.05) v from {b} y group by asset)"
    path = f"(select asset, ret, g / max(g) over (partition by asset order by time) - 1 down from (select asset, time, ret, product(1 + ret) over (partition by asset order by time rows between unbounded preceding and current row) g from {b} y) z)"
    moments = f"(select asset, avg(ret) m, stddev_pop(ret) sd from {b} y group by asset)"
    long = f"(select a.asset, h.h horizon, a.w w, c.ret x from {b} a cross join (select unnest(range(1, 22))::int h) h join {b} c on c.asset = a.asset and c.t = a.t + h.h)"
    ranks = f"(select *, rank() over (partition by asset, horizon order by w) + (count(*) over (partition by asset, horizon, w) - 1) / 2.0 rw, rank() over (partition by asset, horizon order by x) + (count(*) over (partition by asset, horizon, x) - 1) / 2.0 rx from {long} l)"
    corr = lambda u, v: q(f"case when stddev_pop({u}) * stddev_pop({v}) > 1e-12 then covar_pop({u}, {v}) / (stddev_pop({u}) * stddev_pop({v})) end")
    follow = f"(select a.asset, a.w, c.ret x, sign(a.w) * sign(c.ret) > 0 hit from {b} a join {b} c on c.asset = a.asset and c.t = a.t + 1)"
    run = "over (partition by asset order by time rows between unbounded preceding and current row)"
    roll = "over (partition by asset order by time rows between 62 preceding and current row)"
    pair = f"(select x.time, x.asset, x.w * y.w * covar_samp(p.ret, o.ret) * 252 c from {b} x join {b} y on x.time = y.time and abs(x.w) > 1e-12 and abs(y.w) > 1e-12 and x.t >= 63 join {b} p on p.asset = x.asset and p.t between x.t - 63 and x.t - 1 join {b} o on o.asset = y.asset and o.t = p.t group by x.time, x.asset, y.asset, x.w, y.w)"
    part = f"(select time, asset, sum(c) c, row_number() over (partition by time order by abs(sum(c)) desc) k from {pair} z group by time, asset)"
    stat = "(ar / 252 / (av / sqrt(252) / sqrt(n)))"
    cost = lambda v: q(f"sum(ln(1 + greatest({v} * (r - turnover * bps / 1e4), -0.99)))", 5)
    day = f"(select *, (time - lag(time) over (partition by asset order by time))::int gap from {bars(d, unit='day')} x where vol > 0)"
    checks = {"high_below_low": "high < low", "high_below_open": "high < open", "high_below_close": "high < close", "low_above_open": "low > open", "low_above_close": "low > close", "negative_close": "close < 0", "zero_close": "close = 0", "negative_volume": "vol < 0", "zero_volume": "vol = 0", "gaps": "gap > 5", "repeated": "gap = 0"}
    return {
        "signal_freshness": f"with f as (select x, row_number() over (order by time desc) k from (select time, avg(abs(ic)) x from {_ic(d)} i group by time) y), g as (select count(*) n, avg(x) filter (k <= 21) / {past} ratio, {past} past from f) select {q('case when n >= 42 and past >= 1e-12 then least(greatest(ratio, 0), 1) else 0.5 end')} freshness, case when n < 42 or past is null or past < 1e-12 then 'unknown' when ratio > 1.1 then 'improving' when ratio < 0.9 then 'declining' else 'stable' end trend from g",
        "risk_budget": f"with c as (select time, r, product(1 + r) over (order by time) g from {s} x), v as (select stddev_samp(r) * sqrt(252) vol, 1 - arg_max(g, time) / max(g) down from c) select {q('vol')} vol, {q('down')} down, {q('vol / 0.15')} vol_used, {q('(0.25 - vol) / 0.25')} vol_headroom, {q('down / 0.2')} down_used, {q('greatest((0.2 - down) / 0.2, 0)')} down_headroom, {q('0.6 * vol / 0.15 + 0.4 * down / 0.2')} used, {q('greatest(1 - 0.6 * vol / 0.15 - 0.4 * down / 0.2, 0)')} remaining from v",
        "sector_health": f"""with e as (select time, sector, round(sum(w), 10) x from {b} y group by time, sector), l as (select sector, list(x order by time desc) v, list(x order by time) f, count(*) n from e group by sector),
a as (select sector, v[1] weight, n, list_aggregate(list_transform(range(1, n), lambda i: f[i + 1] - f[i]), 'stddev_samp') * sqrt(252) own, list_aggregate(f, 'stddev_samp') * sqrt(252) spread, case when n >= 20 and v[10] <> 0 then v[1] / v[10] - 1 else 0 end recent, case when n >= 20 and round(list_avg(v[1:20]), 12) <> 0 then list_avg(v[1:5]) / list_avg(v[1:20]) - 1 else 0 end mom, case when n >= 20 then len(list_filter(range(1, 11), lambda i: v[i] > v[i + 1])) / 10.0 else 0.5 end up from l),
c as (select *, case when n >= 20 then own else coalesce((select avg(spread) from a), 0.15) end vol from a), z as (select *, (mom - (select avg(mom) from c)) / ((select stddev_pop(mom) from c) + 1e-8) zm, (vol - (select avg(vol) from c)) / ((select stddev_pop(vol) from c) + 1e-8) zv, (recent - (select avg(recent) from c)) / ((select stddev_pop(recent) from c) + 1e-8) zr from c),
p as (select *, 12.5 + greatest(least(12.5 * zm, 12.5), -12.5) pm, 25 - greatest(least(12.5 * zv, 12.5), -12.5) pv, 20 * up pt, 10 + greatest(least(10 * zr, 10), -10) pr, weight * weight / ((select sum(weight * weight) from c) + 1e-8) * 10 pen, abs(weight) * vol risk from z)
select sector, {q('weight', 5)} weight, {q('vol', 5)} volatility, {q('recent', 5)} recent_return, {q('up::double', 5)} trend_pct, {q('risk', 5)} risk, {q('100 * risk / ((select sum(risk) from p) + 1e-12)', 5)} risk_pct, {q('pm', 5)} momentum_score, {q('pv', 5)} volatility_score, {q('pt::double', 5)} trend_score, {q('pr', 5)} return_score, {q('pen', 5)} penalty, {q('greatest(least(pm + pv + pt + pr - pen, 100), 0)', 5)} health_score from p""",
        "position_alerts": f"with x as (select *, abs(w - lag(w) over (partition by asset order by time)) d, row_number() over (partition by asset order by time desc) k from {b} y), g as (select asset, abs(arg_max(w, time)) last, round(avg(d) filter (k <= 5), 12) recent, round(avg(d), 12) usual, sum(pnl) pnl from x group by asset) select asset, 'warning' severity, 'concentration' category, {q('last')} \"value\" from g where last > 0.1 union all select asset, 'info', 'turnover', {q('recent')} from g where recent > 2 * usual and usual > 0 union all select asset, case when pnl < 0 then 'warning' else 'info' end, 'profit', {q('pnl')} from g where pnl < -0.01 or pnl > 0.02",
        "scorecard": f"select asset, n, {', '.join(f'case when n < 20 then 0e0 else {q(v, 5)} end {c}' for c, v in {'sharpe': 'ar / (av + 1e-12)', 'sortino': 'ar / (case when losses > 0 then below else av end + 1e-12)', 'calmar': 'ar / (abs(dd) + 1e-12)', 'var_95': 'v', 'cvar_95': 'tail', 'max_drawdown': 'dd', 'worst': 'worst', 'skewness': 'm3', 'kurtosis': 'm4 - 3', 't_stat': f'case when av > 1e-12 then {stat} end'}.items())}, case when n >= 20 and av > 1e-12 then {q(t_p_sql(stat, '(n - 1)'), 5)} end p_value from (select asset, count(*) n, avg(ret) * 252 ar, stddev_samp(ret) * sqrt(252) av, count(*) filter (ret < 0) losses, stddev_samp(ret) filter (ret < 0) * sqrt(252) below, min(down) dd, any_value(v) v, avg(ret) filter (ret <= v + 1e-12) tail, min(ret) worst, avg(power((ret - m) / nullif(sd, 0), 3)) m3, avg(power((ret - m) / nullif(sd, 0), 4)) m4 from {path} p join {tail} using (asset) join {moments} using (asset) group by asset) u",
        "signal_quality": f"select asset, horizon, count(*) n, {corr('w', 'x')} pearson_ic, {corr('rw', 'rx')} rank_ic from {ranks} r group by asset, horizon having count(*) >= 20",
        "hit_rates": f"with f as {follow}, g as (select asset, count(*) n, count(*) filter (w <> 0) held, avg(hit::int) filter (w <> 0) h, coalesce(avg(abs(x)) filter (w <> 0 and hit), 0) a, coalesce(avg(abs(x)) filter (w <> 0 and not hit), 0) z from f group by asset) select asset, held, {', '.join(f'case when n > 20 and held > 10 then {q(v)} end {c}' for c, v in {'hit_rate': 'h', 'mean_right': 'a', 'mean_wrong': 'z'}.items())} from g",
        "returns_against_portfolio": f"select time, asset, {q(f'product(1 + ret) {run} - 1')} growth, {q(f'product(1 + r) {run} - 1')} portfolio from {b} y join (select time, r from {s} x) z using (time)",
        "rolling_stock_correlation": f"select * from (select time, asset, case when count(*) {roll} >= 63 and stddev_samp(ret) {roll} * stddev_samp(r) {roll} > 1e-12 then {q(f'corr(ret, r) {roll}')} end corr from {b} y join (select time, r from {s} x) z using (time)) u where corr is not null",
        "regime_exposure": f"select asset, regime, {q('avg(w)')} avg_weight, {q('max(abs(w))')} max_weight, count(*) filter (w <> 0) bars_held, count(*) bars, {q('count(*) filter (w <> 0) / count(*)')} share_held from {b} y join {_regimes(d)} z using (time) group by asset, regime",
        "rolling_risk": f"select time, {q('sqrt(greatest(sum(c), 0))', 5)} vol, {q('sum(abs(c)) filter (k <= 5) / (sum(c) + 1e-12)', 5)} top_share, count(*) n_assets from {part} u group by time",
        "cap_weighted_index": f"with f as (select time, ret, coalesce(last_value(case when close * vol > 0 then close * vol end ignore nulls) {run}, 0) c from {b} y) select time, {q('case when sum(c) > 0 then sum(c * ret) / sum(c) else 0 end')} ret, count(*) filter (c > 0) names from f group by time",
        "overlaid_book": f"with o as (select * from {_overlay(d)} y) select time, asset, {q('coalesce(w * scale, 0)')} w, {q('coalesce(1.2 * m, 0)')} budget from {b} k left join o using (time, asset) left join (select time, avg(scale) m from o group by time) u using (time)",
        "cost_leverage_surface": f"select bps, {cost(0.5)} leverage_0_5, {cost(1.0)} leverage_1, {cost(2.0)} leverage_2 from {s} x cross join (select unnest([0.0, 5.0, 10.0, 20.0])::double bps) g group by bps",
        "all_checks": " union all ".join(f"select asset, '{c}' \"check\", count(*) filter ({t}) n from {day} y group by asset" for c, t in checks.items()),
    }
