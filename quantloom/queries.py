"""All queries of the panel engine and their SQL for the other engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dsl
from .functions import factors as X
from .operators import analytics, book, monitor, portfolio, studies, warehouse
from .plans import panel, strategies
from .sources import panel_store
from .streaming import bars as stream

Query = Callable[[SparkSession, str], DataFrame]


def _calendar(d: dsl.Dialect) -> str:
    """Daily panel with the exact start days of week, month, quarter and year."""
    flag = lambda test: f"case when {test} then 1e0 else 0e0 end"
    return f"(select *, {flag(book.weekday(d, 'time') + ' = 0')} starts_weekday, {flag('day(time) = 1')} starts_month, {flag('day(time) = 1 and month(time) % 3 = 1')} starts_quarter, {flag('day(time) = 1 and month(time) = 1')} starts_year from {panel.panel_sql(d, unit='day')} p)"


def _to_date(d: dsl.Dialect) -> str:
    b = X.Base()
    return dsl.sql(_calendar(d), {f"ret_{p[0]}td": X.to_date(b, p) for p in ("week", "month", "quarter", "year")}, decimals=6, d=d)


def _primitives(d: dsl.Dialect) -> str:
    b = X.Base(X.Windows(beta=26))
    r = b.ret
    out = {"ret": r, "mkt": b.mkt, "log_ret": dsl.fn("ln", 1 + r), "sma20": X.sma(r, 20), "std20": X.std(r, 20), "std20_sample": dsl.roll("std1", 20, r), "ema20": dsl.ema(r, 2 / 21, 20), "ewma95": dsl.ewma(r, 0.95), "max20": dsl.roll("max", 20, b.close), "min20": dsl.roll("min", 20, b.close), "atr14": b.atr(14), "beta26": b.beta, "resid": b.resid, "corr20": dsl.roll("corr", 20, r, b.mkt), "median20": dsl.roll("q0.5", 20, r), "sma20_half": X.sma(r, 20, 10), "prior20": dsl.roll("avg", 20, r, skip=1), "rank": dsl.cs("rank", dsl.fn("round", r, 10)), "dense": dsl.cs("dense_rank", dsl.fn("round", r, 10)), "z": dsl.robust_z(r)}
    return dsl.sql(panel.panel_sql(d), out, decimals=6, d=d)


def _timeframe_bars(d: dsl.Dialect) -> str:
    """Rolling bars of 5, 21 and 63 rows with half windows allowed, and returns over them."""
    b = X.Base()
    out = {}
    for n in (5, 21, 63):
        high, low = b.bars(n, n // 2)
        out |= {f"high{n}": high, f"low{n}": low, f"open{n}": dsl.lag(b.open, n - 1), f"vol{n}": X.total(b.vol, n, n // 2), f"position{n}": dsl.fn("round", dsl.clip(dsl.nz((b.close - low) / (high - low + dsl.EPS), 0.5), 0, 1), 6), f"ret{n}": dsl.fn("round", dsl.clip(dsl.nz(b.period(n)), -0.999, 10), 6)}
    return dsl.sql(panel.panel_sql(d), out, d=d)


def _order_flow_twice(d: dsl.Dialect) -> str:
    """The flow and mean-reversion factors of the specialised libraries, which score what is a score already."""
    lib = X.library(X.Base())
    return dsl.sql(panel.panel_sql(d), X.scored(X.scored({**lib["order_flow"], **lib["mean_reversion"]})), decimals=3, d=d)


def _pooled_ic(d: dsl.Dialect) -> str:
    """Rank correlation of returns over three horizons with forward returns, pooled over the 63 dates before."""
    b = X.Base()
    out = {f"r{n}": dsl.fn("round", dsl.nz(b.period(n)), 10) for n in (5, 21, 63)} | {"f": dsl.fn("round", dsl.nz(dsl.lead(b.ret)), 10)}
    base = f"({dsl.sql(panel.panel_sql(d), out, d=d)})"
    rank = lambda x: f"(rank() over (partition by time order by {x}) + (count(*) over (partition by time, {x}) - 1) / 2e0)"
    parts = []
    w = "(order by time rows between 63 preceding and 1 preceding)"
    for n in (5, 21, 63):
        sums = f"(select time, cast(count(*) as double) c, sum(a) a, sum(b) b, sum(a * a) aa, sum(b * b) bb, sum(a * b) ab from (select time, {rank(f'r{n}')} a, {rank('f')} b from {base} x) y group by time)"
        roll = f"(select time, sum(c) over {w} c, sum(a) over {w} a, sum(b) over {w} b, sum(aa) over {w} aa, sum(bb) over {w} bb, sum(ab) over {w} ab from {sums} s)"
        parts.append(f"select time, {n} horizon, round((c * ab - a * b) / nullif(sqrt(c * aa - a * a) * sqrt(c * bb - b * b), 0), 6) + 0.0 ic from {roll} z where c > 10")
    return " union all ".join(parts)


TEXTS: dict[str, Callable[[dsl.Dialect], str]] = {f"factors_{kind}": (lambda d, kind=kind: dsl.sql(panel.panel_sql(d), X.scored(X.library(X.Base())[kind]), decimals=4, d=d)) for kind in X.categories()}
TEXTS |= {"returns_to_date": _to_date, "math_primitives": _primitives, "timeframe_bars": _timeframe_bars, "factors_scored_twice": _order_flow_twice, "pooled_timeframe_ic": _pooled_ic}
TEXTS |= {f.__name__: f for module in (warehouse, portfolio, analytics) for f in module.OPERATORS}
TEXTS |= {f.__name__: f for f in stream.BATCH_TWINS}


def _text_query(text: Callable[[dsl.Dialect], str]) -> Query:
    return lambda spark, sf_dir: spark.sql(text(dsl.Dialect("spark", sf_dir)))


def factor_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every factor's score in long form: time, asset, factor, z."""
    names = X.V4_24
    known = X.registry()
    wide = dsl.compute(panel.panel(spark, sf_dir), X.scored({n: known[n][1] for n in names}), decimals=4)
    return wide.unpivot(["time", "asset"], list(names), "factor", "z")


def factor_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, k) for n, (k, _) in X.registry().items()], "factor string, category string")


def _strategies(*names: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return strategies.run(spark, sf_dir, names).withColumn("w", F.round("w", 6)).withColumn("budget", F.round("budget", 6))

    return query


def strategy_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategies.catalogue(spark)


def strategy_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = panel.panel(spark, sf_dir)
    w = strategies.run(spark, sf_dir, ("exchange_24", "flow_25"), bars=bars)
    ret = dsl.compute(bars, {"ret": X.Base().ret})
    return strategies.diagnostics(w, ret)


def queries() -> dict[str, Query]:
    out = {name: _text_query(text) for name, text in TEXTS.items()}
    out |= {"factor_panel": factor_panel, "factor_registry": factor_registry, "strategy_catalogue": strategy_catalogue, "strategy_diagnostics": strategy_diagnostics}
    out |= {f"strategy_{n}": _strategies(n) for n in strategies.STRATEGIES}
    out |= panel_store.READS  # their texts stay as SQL for the other engine
    out |= {f.__name__: f for f in stream.STREAMS} | monitor.QUERIES | studies.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    return {name: text(dsl.DUCK) for name, text in TEXTS.items()} | stream.ORACLES | monitor.oracles() | studies.oracles()
