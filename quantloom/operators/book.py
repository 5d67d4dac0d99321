"""Relations that the portfolio operators stand on: a book of positions over the panel, its daily series, and text helpers of both SQL dialects."""

from __future__ import annotations

from ..functions import factors as X
from ..functions.dsl import Dialect, col, fn, fwd, lag, nz, robust_z, sql
from ..plans.panel import panel_sql

SEATS = 5


def r(x: str, decimals: int = 6) -> str:
    return f"round({x}, {decimals}) + 0.0"


def q(d: Dialect, x: str, p: float) -> str:
    return f"percentile({x}, {p})" if d.spark else f"quantile_cont({x}, {p})"


def weekday(d: Dialect, x: str) -> str:
    """0 on Monday."""
    return f"weekday({x})" if d.spark else f"(isodow({x}) - 1)"


def days(d: Dialect, later: str, earlier: str) -> str:
    return f"datediff({later}, {earlier})" if d.spark else f"datediff('day', {earlier}, {later})"


def plus(d: Dialect, x: str, k: int) -> str:
    return f"date_add({x}, {k})" if d.spark else f"cast({x} + interval '{k} days' as date)"


def each_day(d: Dialect, first: str, last: str, step: int = 1) -> str:
    """A subquery with a row per ``step`` days (column day)."""
    if d.spark:
        return f"(select explode(sequence({first}, {last}, interval {step} days)) day)"
    return f"(select cast(unnest(generate_series({first}, {last}, interval '{step} days')) as date) as day)"


def ignore_nulls(d: Dialect, x: str, over: str) -> str:
    return f"last({x}, true) over {over}" if d.spark else f"last_value({x} ignore nulls) over {over}"


def bars(d: Dialect, asset: str = "brand", unit: str = "week") -> str:
    return panel_sql(d, asset, unit)


def signals(d: Dialect) -> str:
    """Panel with returns, a score, forward returns over four bars and the true range."""
    b = X.Base()
    ret = fn("round", b.ret, 10)
    out = {"open": b.open, "high": b.high, "low": b.low, "close": b.close, "vol": b.vol, "t": col("t"), "ret": ret, "score": fn("round", robust_z(b.period(4)), 6)}
    out |= {"quality": fn("round", robust_z(-X.std(b.ret, 8)), 6), "flow": fn("round", robust_z(b.ofi(5)), 6)}
    out |= {"fwd": nz(fn("exp", fwd("sum", 4, fn("ln", 1 + b.ret))) - 1)}
    out |= {"atr": b.atr(14), "prev_close": nz(lag(b.close))}
    return f"({sql(bars(d), out, d=d)})"


def book(d: Dialect, score: str = "score") -> str:
    """Positions: SEATS longs of 0.12 and as many shorts of 0.08 by score, ties by name; ``wl`` is the weight of the bar before."""
    return f"""(select *, coalesce(lag(w) over (partition by asset order by time), 0e0) wl, substr(asset, 1, 7) sector,
 coalesce(case when ret <> 0 then 1e0 end / nullif(count(case when ret <> 0 then 1 end) over (partition by time), 0), 0e0) bw
 from (select *, case when up <= {SEATS} then 12e-2 when down <= {SEATS} then -8e-2 else 0e0 end w
  from (select *, row_number() over (partition by time order by {score} desc, asset) up, row_number() over (partition by time order by {score}, asset desc) down from {signals(d)} s) ranked) seated)"""


def series(d: Dialect, score: str = "score") -> str:
    """A row per bar: the book's return, the market's, exposures and turnover."""
    return f"""(select time, round(greatest(sum(wl * ret), -0.99), 10) r, round(avg(ret), 10) m, sum(abs(w)) gross, sum(w) net, sum(w * w) hhi, count(case when abs(w) > 1e-12 then 1 end) n,
 case when min(t) = 0 then 0e0 else sum(abs(w - wl)) end turnover, sum(abs(w - wl) * atr / nullif(close, 0)) atr_turnover from {book(d, score)} b group by time)"""


def strategies(d: Dialect) -> str:
    """The series of three books, by strategy."""
    return "(" + " union all ".join(f"select '{name}' strategy, * from {series(d, score)} x" for name, score in (("momentum", "score"), ("reversal", "-score"), ("calm", "quality"))) + ")"


def positions(d: Dialect) -> str:
    """The weights of three books, by strategy."""
    return "(" + " union all ".join(f"select '{name}' strategy, time, asset, w, wl, ret from {book(d, score)} x" for name, score in (("momentum", "score"), ("reversal", "-score"), ("calm", "quality"))) + ")"


OVER = "(order by time rows between unbounded preceding and current row)"


def window(n: int, skip: int = 0, by: str = "") -> str:
    end = f"{skip} preceding" if skip else "current row"
    part = f"partition by {by} " if by else ""
    return f"({part}order by time rows between {n - 1 + skip} preceding and {end})"


def curve(x: str = "r", by: str = "") -> str:
    """Growth of 1."""
    part = f"partition by {by} " if by else ""
    return f"exp(sum(ln(1 + {x})) over ({part}order by time rows between unbounded preceding and current row))"


def regimes(d: Dialect, lookback: int = 52, short: int = 13, source: str | None = None) -> str:
    """Series (time, r) with a regime, columns vol, vol_z, trend_corr and skew beside it.

    vol is the annualised deviation of ``lookback`` bars, vol_z its distance from
    its own mean of ``short`` bars, trend_corr the correlation of returns with the
    lagged mean of ``lookback`` bars, skew that of the population; each needs a full
    window. Calm (vol_z below -0.5) goes before trend (correlation above 0.3, vol_z
    not above 1), that before crisis (vol_z above 1, skew below -0.5). The defaults
    are a year and a quarter of weekly bars (252 and 63 of daily ones).
    """
    full = lambda x, v, n: f"case when count({v}) over {window(n)} >= {n} then {x} over {window(n)} end"
    one = f"(select *, {full('stddev_samp(r)', 'r', lookback)} * sqrt(252e0) vol, {full('avg(r)', 'r', lookback)} trend from {source or series(d)} x)"
    two = f"(select *, coalesce(lag(trend) over (order by time), 0e0) past from {one} y)"
    moments = ", ".join(f"{full(f'avg(power(r, {k}))', 'r', short)} m{k}" for k in (1, 2, 3))
    z = f"(vol - {full('avg(vol)', 'vol', short)}) / ({full('stddev_samp(vol)', 'vol', short)} + 1e-12)"
    spread = lambda v: f"(case when stddev_samp({v}) over {window(short)} > 1e-12 then stddev_samp({v}) over {window(short)} end)"
    corr = f"{full('covar_samp(r, past)', 'r', short)} / ({spread('r')} * {spread('past')})"
    three = f"(select *, round({z}, 8) vol_z, round({corr}, 8) trend_corr, {moments} from {two} z)"
    four = f"(select *, round((m3 - 3 * m1 * m2 + 2 * power(m1, 3)) / nullif(power(greatest(m2 - m1 * m1, 0e0), 1.5e0), 0), 8) skew from {three} u)"
    return f"(select *, case when vol_z < -0.5 then 'calm' when abs(trend_corr) > 0.3 and coalesce(vol_z, 0) <= 1 then 'trend' when vol_z > 1 and skew < -0.5 then 'crisis' else 'normal' end regime from {four} v)"


PERFORMANCE = """count(*) n, round(avg({r}) * 252, 6) + 0.0 ann_return, round(stddev_pop({r}) * sqrt(252.0), 6) + 0.0 ann_vol, round(avg({r}) / nullif(stddev_pop({r}), 0) * sqrt(252.0), 5) + 0.0 sharpe,
 round(avg({r}) / nullif(sqrt(avg(power(least({r}, 0.0), 2))), 0) * sqrt(252.0), 5) + 0.0 sortino, round(sum(ln(1 + {r})), 6) + 0.0 log_return,
 round(avg(case when {r} > 0 then 1e0 else 0e0 end), 6) win_rate, round(sum(greatest({r}, 0.0)) / nullif(-sum(least({r}, 0.0)), 0), 5) + 0.0 profit_factor, round(max({r}), 6) + 0.0 best, round(min({r}), 6) + 0.0 worst"""


def performance(x: str = "r") -> str:
    return PERFORMANCE.format(r=x)
