"""Signals, weighting, portfolio rules, costs and diagnostics, as queries over the book of positions."""

from __future__ import annotations

from ..functions import factors as X
from ..functions.dsl import Dialect, ewma, sql
from .book import SEATS, bars, book, positions, q, r, series, signals, window

SIGNALS = ("score", "quality", "flow")


def _long(d: Dialect) -> str:
    """(time, asset, factor, z, fwd, ret)"""
    return "(" + " union all ".join(f"select time, asset, '{f}' factor, {f} z, fwd, ret, t from {signals(d)} s" for f in SIGNALS) + ")"


def _average_rank(x: str, by: str) -> str:
    return f"(rank() over (partition by {by} order by {x}) + (count(*) over (partition by {by}, {x}) - 1) / 2e0)"


def _ic(d: Dialect) -> str:
    """Spearman correlation of each factor with forward returns, by date."""
    ranked = f"(select time, factor, {_average_rank('z', 'time, factor')} a, {_average_rank('fwd', 'time, factor')} b from {_long(d)} l)"
    return f"(select time, factor, coalesce(case when stddev_pop(a) * stddev_pop(b) > 1e-12 then covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) end, 0e0) ic from {ranked} x group by time, factor)"


def forward_returns(d):
    return f"select time, asset, {r('fwd')} fwd from {signals(d)} s"


def rank_ic(d):
    return f"select time, factor, {r('ic')} ic from {_ic(d)} x"


def _smooth(d: Dialect, lam: float = 0.95, delay: int = 1) -> str:
    """Clipped, delayed and exponentially smoothed correlations; a delay beyond the label's span looks at no later return."""
    numbered = f"(select time, factor as asset, least(greatest(lag(ic, {delay}) over (partition by factor order by time), -0.2), 0.2) x, cast(row_number() over (partition by factor order by time) - 1 as double) t from {_ic(d)} i)"
    return f"(select time, asset factor, round(s, 9) s from ({sql(numbered, {'s': ewma(X.col('x'), lam)}, d=d)}) e)"


def smooth_ic(d):
    return f"select time, factor, {r('s')} ic_smooth from {_smooth(d)} x"


def _weights(d: Dialect, delay: int = 1) -> str:
    total = "sum(greatest(s, 0e0)) over (partition by time)"
    return f"(select time, factor, case when {total} > 1e-12 then greatest(s, 0e0) / nullif({total}, 0) else 1e0 / count(*) over (partition by time) end fw from {_smooth(d, delay=delay)} x)"


def ic_weights(d):
    """Positive part, normalised; equal where none is positive."""
    return f"select time, factor, {r('fw')} weight from {_weights(d)} x"


def ic_weights_leak_free(d):
    """The same with a delay beyond the label's span."""
    return f"select time, factor, {r('fw')} weight from {_weights(d, delay=5)} x"


def ic_weights_absolute(d):
    """Signed weights by absolute mass."""
    return f"select time, factor, {r('coalesce(s / nullif(sum(abs(s)) over (partition by time), 0), 0e0)')} weight from {_smooth(d)} x"


def composite_score(d):
    return f"select l.time, l.asset, {r('sum(l.z * w.fw)')} score from {_long(d)} l join {_weights(d)} w on l.time = w.time and l.factor = w.factor group by l.time, l.asset"


def _correlations(d: Dialect) -> str:
    pair = "stddev_pop(a.z) * stddev_pop(b.z)"
    return f"(select a.time, a.factor f1, b.factor f2, coalesce(case when {pair} > 1e-12 then covar_pop(a.z, b.z) / nullif({pair}, 0) end, 0e0) c from {_long(d)} a join {_long(d)} b on a.time = b.time and a.asset = b.asset group by a.time, a.factor, b.factor)"


def factor_correlations(d):
    return f"select time, f1, f2, {r('c')} corr from {_correlations(d)} x where f1 < f2"


def correlation_penalty(d):
    """One less the mean absolute correlation with the other factors, at least 0.2; then the penalised weights."""
    n = len(SIGNALS)
    pen = f"(select time, f1 factor, greatest(1 - sum(case when f1 <> f2 then abs(c) else 0e0 end) / {n}, 0.2e0) p from {_correlations(d)} x group by time, f1)"
    w = "w.fw * (1 - 0.35e0 * (1 - p.p))"
    return f"select w.time, w.factor, {r('p.p')} penalty, {r(f'{w} / nullif(sum({w}) over (partition by w.time), 0)')} weight from {_weights(d)} w join {pen} p on w.time = p.time and w.factor = p.factor"


def weight_floor(d):
    """Weights with a floor of 0.05, normalised anew."""
    return f"select time, factor, {r('greatest(fw, 0.05e0) / nullif(sum(greatest(fw, 0.05e0)) over (partition by time), 0)')} weight from {_weights(d)} x"


def kendall_ic(d):
    """Kendall's tau-b of score and forward return, by date (over all pairs of the date)."""
    s = f"(select time, asset, score, round(fwd, 9) fwd from {signals(d)} s)"
    sg = "sign(a.score - b.score) * sign(a.fwd - b.fwd)"
    return f"select a.time, round(sum({sg}) / nullif(sqrt(cast(sum(abs(sign(a.score - b.score))) as double)) * sqrt(cast(sum(abs(sign(a.fwd - b.fwd))) as double)), 0), 6) + 0.0 tau, count(*) pairs from {s} a join {s} b on a.time = b.time and a.asset < b.asset group by a.time"


def quintile_returns(d):
    """Buckets by the quantiles of the score, edges that coincide dropped; mean forward return of each."""
    edges = ", ".join(f"{q(d, 'score', p / 5)} e{p}" for p in range(1, 5))
    cut = f"(select time, {edges} from {signals(d)} s group by time)"
    bucket = "1 + " + " + ".join(f"(case when s.score > c.e{p} then 1 else 0 end)" for p in range(1, 5))
    return f"select s.time, {bucket} bucket, {r('avg(s.fwd)')} mean_fwd, count(*) n from {signals(d)} s join {cut} c on s.time = c.time group by s.time, {bucket}"


def ic_decay(d):
    """Correlation of the score with the return of one bar, 1 to 6 bars on."""
    parts = " union all ".join(f"select time, score, {h} h, lead(ret, {h}) over (partition by asset order by time) x from {signals(d)} s" for h in range(1, 7))
    return f"select h, round(avg(c), 6) + 0.0 mean_ic, count(*) dates from (select time, h, covar_pop(score, x) / nullif(stddev_pop(score) * stddev_pop(x), 0) c from ({parts}) p where x is not null group by time, h having count(*) >= 10 and stddev_pop(score) * stddev_pop(x) > 1e-12) y group by h"


def holding_period(d):
    """The last horizon whose mean correlation still rises, 5 if none does."""
    return f"select coalesce(max(case when mean_ic > before then h end), 5) horizon from (select h, mean_ic, lag(mean_ic) over (order by h) before from ({ic_decay(d)}) x) y"


def decile_spread(d):
    """Assets in five groups by absolute score; top less bottom mean forward return."""
    ranked = f"(select time, asset, fwd, floor((row_number() over (partition by time order by abs(score) desc, asset) - 1) / 5) g from {signals(d)} s)"
    return f"select time, {r('avg(case when g = 0 then fwd end) - avg(case when g = 4 then fwd end)')} spread from {ranked} x group by time"


def equal_topk(d):
    """Pins first, then by score where positive; equal weights."""
    ranked = f"(select time, asset, row_number() over (partition by time order by case when asset = 'Brand#11' then 0 else 1 end, score desc, asset) k, score from {signals(d)} s where score > 0 or asset = 'Brand#11')"
    return f"select time, asset, 1e0 / count(*) over (partition by time) w from {ranked} x where k <= {2 * SEATS}"


def positions_by_date(d):
    return f"select time, asset, w, wl from {book(d)} b where w <> 0 or wl <> 0"


def budget(d):
    """Gross target: 0.15 over the smoothed deviation, times a throttle by the market's drawdown, within limits."""
    s = f"(select time, r, m, cast(row_number() over (order by time) - 1 as double) t, 'book' asset from {series(d)} x)"
    e = sql(s, {"v": ewma(X.square(X.col("r")), 0.95), "r": X.col("r"), "g": X.fn("exp", X.cum("sum", X.fn("ln", 1 + X.col("m"))))}, keys=("time", "asset"), d=d)
    peak = f"max(g) over {window(252)}"
    return f"select time, round(least(greatest(least(greatest(0.15 / (sqrt(v) * sqrt(252e0) + 1e-8), 0.3), 1.5) * least(greatest(1 - 0.6 * ({peak} - g) / ({peak} + 1e-12), 0.5), 1), 0.3), 1.5), 6) budget from ({e}) x"


def equal_weight_benchmark(d):
    """Mean of the returns that are not exactly 0."""
    return f"select time, {r('sum(bw * ret)')} ret, count(case when ret <> 0 then 1 end) names from {book(d)} b group by time"


def cap_weight_benchmark(d):
    """Weighted by the day's close times volume."""
    cap = "(case when close * vol > 0 then close * vol end)"
    return f"select time, {r(f'coalesce(sum({cap} * ret) / nullif(sum({cap}), 0), 0e0)')} ret from {signals(d)} s group by time"


def exchange_benchmarks(d):
    return f"select time, sector, {r('avg(case when ret <> 0 then ret end)')} ret, count(*) n from {book(d)} b group by time, sector"


def risk_overlay(d):
    """Scale by each asset's volatility and the market's drawdown."""
    b = X.Base()
    vol = X.roll("std", 63, b.ret, mp=1) * 252**0.5 + 1e-12
    market = X.cs("avg", X.nz(b.ret))
    growth = X.fn("exp", X.cum("sum", X.fn("ln", 1 + market)))
    peak = X.roll("max", 126, growth, mp=1)
    by_vol = X.when(vol.gt(0.22), 0.16 / 0.22, X.clip(0.16 / vol, 0.5, 1.25))
    by_dd = X.clip(1 - 0.6 * (peak - growth) / (peak + 1e-12), 0.55, 1.25)
    return sql(bars(d), {"vol_scale": by_vol, "dd_scale": by_dd, "overlay": X.clip(by_vol * by_dd, 0.5, 1.25)}, decimals=6, d=d)


def softmax_tilt(d):
    """Longs tilted by their clipped score, weights of a date summing to 1."""
    s = f"(select time, asset, 1e0 / {SEATS} w, least(greatest((score - avg(score) over (partition by time)) / (stddev_pop(score) over (partition by time) + 1e-12), -3), 3) z from {book(d)} b where w > 0)"
    return f"select time, asset, {r('w * exp(0.85e0 * round(z, 9)) / sum(w * exp(0.85e0 * round(z, 9))) over (partition by time)')} w from {s} x"


def whatif_blacklist(d):
    """The last book without some names, and how its measures change."""
    last = f"(select asset, w, case when asset in ('Brand#11', 'Brand#22') then 0e0 else w end x from {book(d)} b where time = (select max(time) from {bars(d)} p))"
    return f"select 'gross' metric, {r('sum(abs(w))')} base, {r('sum(abs(x))')} whatif from {last} l union all select 'net', {r('sum(w)')}, {r('sum(x)')} from {last} l union all select 'hhi', {r('sum(w * w)')}, {r('sum(x * x)')} from {last} l union all select 'names', count(case when abs(w) > 1e-12 then 1 end), count(case when abs(x) > 1e-12 then 1 end) from {last} l"


def whatif_seats(d):
    """Only the best three each side, pins kept, power tilt of 0.5, rounded to a grid."""
    ranked = f"(select asset, w, row_number() over (order by w desc, asset) a, row_number() over (order by w, asset) b from {book(d)} k where time = (select max(time) from {bars(d)} p))"
    kept = f"(select asset, case when (w > 0 and a <= 3) or (w < 0 and b <= 3) or asset = 'Brand#11' then w else 0e0 end w from {ranked} x)"
    return f"select asset, round(sign(w) * sqrt(abs(w)) * sum(abs(w)) over () / nullif(sum(sqrt(abs(w))) over (), 0) / 0.005, 0) * 0.005 + 0e0 w from {kept} y"


def cost_schemes(d):
    """Flat, percentage, range-based and tiered cost of each bar's trades."""
    x = "abs(w - wl)"
    tier = f"case when {x} <= 0.01 then 5e-4 when {x} <= 0.05 then 10e-4 when {x} <= 0.10 then 15e-4 else 25e-4 end"
    return f"select time, {r(f'sum({x}) * 10e-4', 8)} flat, {r(f'sum({x}) * 5e-4', 8)} pct, {r(f'sum(0.05e0 * coalesce(atr / nullif(close, 0), 0e0) * {x})', 8)} ranged, {r(f'sum({x} * {tier})', 8)} tiered from {book(d)} b group by time"


def cost_drag(d):
    """Average and yearly cost, turnover, and cost over turnover, by scheme."""
    c = f"({cost_schemes(d)})"
    parts = " union all ".join(f"select '{n}' scheme, {n} cost, x.time from {c} x" for n in ("flat", "pct", "ranged", "tiered"))
    return f"select scheme, {r('avg(cost)', 8)} mean_cost, {r('avg(cost) * 252')} yearly, {r('sum(cost)')} total, {r('sum(cost) / nullif(sum(turnover), 0)', 8)} per_turnover from ({parts}) c join {series(d)} s on c.time = s.time group by scheme"


def portfolio_diagnostics(d):
    """Daily measures of the book, with net returns under three cost schemes."""
    return f"select time, {r('r')} port_ret, {r('m')} mkt_ret, {r('r - m')} active_ret, {r('gross')} gross, {r('net')} net, n, {r('hhi')} hhi, {r('turnover')} turnover, {r('turnover * 10e-4')} tc_flat, {r('coalesce(atr_turnover, 0e0) * 0.05e0')} tc_atr, {r('r - turnover * 10e-4')} net_flat, {r('r - coalesce(atr_turnover, 0e0) * 0.05e0')} net_atr, {r('r - turnover * 5e-4')} net_5bps from {series(d)} s"


def factor_exposure(d):
    return f"select l.time, l.factor, {r('sum(l.z * b.w)')} exposure from {_long(d)} l join {book(d)} b on l.time = b.time and l.asset = b.asset group by l.time, l.factor"


def factor_vectors(d):
    """Per asset: exposures of the last date and a summary of its history in the book."""
    return f"select asset, {r('max_by(score, time)')} score_last, {r('max_by(quality, time)')} quality_last, {r('max_by(flow, time)')} flow_last, {r('sum(wl * ret)')} total_pnl_contrib, {r('avg(score)')} mean_score, {r('stddev_pop(score)')} score_vol, count(case when abs(w) > 1e-12 then 1 end) days_held, {r('avg(w)')} avg_weight, {r('avg(case when abs(w) > 1e-12 then w end)')} avg_weight_when_held from {book(d)} b group by asset"


def cost_by_asset(d):
    x = "abs(w - wl)"
    return f"select asset, {r(f'sum({x}) * 10e-4', 8)} total_cost, count(case when {x} > 1e-12 then 1 end) trades, {r(f'sum({x})')} turnover, {r(f'sum({x}) * 10e-4 / nullif(count(case when {x} > 1e-12 then 1 end), 0)', 8)} per_trade from {book(d)} b group by asset"


def cost_by_month(d):
    return f"select last_day(time) month_end, {r('sum(turnover) * 10e-4', 8)} cost, count(*) bars from {series(d)} s group by last_day(time)"


def cost_by_size(d):
    """Trades in five buckets of size by quantile; where quantiles are equal, the lower bucket has their trades."""
    trades = f"(select abs(w - wl) x from {book(d)} b where abs(w - wl) > 1e-12)"
    edges = f"(select {', '.join(f'round(percentile_cont(0.{k}) within group (order by x), 10) q{k}' for k in (2, 4, 6, 8))} from {trades} t)"
    bucket = "case when x <= q2 then 'XS' when x <= q4 then 'S' when x <= q6 then 'M' when x <= q8 then 'L' else 'XL' end"
    return f"select size_bucket, {r('avg(x) * 100')} avg_delta_pct, {r('sum(x) * 10e-4')} total_tc, {r('avg(x * 10e-4) / (avg(x) + 1e-12) * 1e4')} avg_tc_bps, count(*) n_trades from (select round(x, 10) x, {bucket.replace('x <=', 'round(x, 10) <=')} size_bucket from {trades} t cross join {edges} e) u group by size_bucket"


def cost_sensitivity(d):
    """Return, deviation and their ratio net of 0 to 30 basis points."""
    net = "(s.r - s.turnover * g.bps / 1e4)"
    return f"select g.bps, {r(f'avg({net}) * 252')} ann_return, {r(f'stddev_samp({net}) * sqrt(252e0)')} ann_vol, {r(f'avg({net}) / nullif(stddev_samp({net}), 0) * sqrt(252e0)', 5)} sharpe from {series(d)} s cross join (values (0e0), (5e0), (10e0), (20e0), (30e0)) g(bps) group by g.bps"


def turnover_efficiency(d):
    return f"select {r('(exp(sum(ln(1 + r))) - 1) / nullif(avg(turnover), 0)', 5)} efficiency, {r('avg(turnover)')} mean_turnover, {r('max(turnover)')} max_turnover, {r(q(d, 'turnover', 0.9))} p90_turnover from {series(d)} s"


def range_cost_share(d):
    """Part of the range-based cost that falls on the quarter of names with the widest ranges."""
    a = f"(select asset, avg(atr / nullif(close, 0)) a, sum(abs(w - wl) * coalesce(atr / nullif(close, 0), 0e0)) c from {book(d)} b group by asset)"
    return f"select {r('avg(a)')} mean_range, {r(q(d, 'a', 0.75))} p75, {r('sum(case when a >= e then c end) / nullif(sum(c), 0)')} top_share from {a} x cross join (select {q(d, 'a', 0.75)} e from {a} y) z".replace(f"{r(q(d, 'a', 0.75))} p75", f"{r('max(e)')} p75")


def aggregated_positions(d):
    """Three books added up, with how many hold a name and the cash left."""
    s = f"(select time, asset, sum(w) / 3 w, count(case when w <> 0 then 1 end) holders from {positions(d)} p group by time, asset)"
    return f"select time, asset, {r('w')} w, holders from {s} x where holders > 0 union all select time, 'CASH', {r('1 - sum(w)')}, 0 from {s} x group by time"


def holdings_overlap(d):
    """Jaccard index of the books' names, pair by pair, over all dates."""
    h = f"(select strategy, time, asset from {positions(d)} p where w <> 0)"
    n = f"(select strategy, count(*) n from {h} h group by strategy)"
    both = f"(select a.strategy s1, b.strategy s2, count(*) k from {h} a join {h} b on a.time = b.time and a.asset = b.asset and a.strategy < b.strategy group by a.strategy, b.strategy)"
    return f"select s1, s2, {r('k / cast(x.n + y.n - k as double)')} jaccard from {both} b join {n} x on x.strategy = s1 join {n} y on y.strategy = s2"


def trade_list(d):
    """Changes of at least 0.002 between two dates, with their kind."""
    kind = "case when wl = 0 then 'NEW' when w = 0 then 'EXIT' when sign(w) <> sign(wl) then 'FLIP' else 'SIZE' end"
    return f"select time, asset, {r('w - wl')} delta, case when w > wl then 'BUY' else 'SELL' end side, {kind} kind from {book(d)} b where abs(w - wl) >= 0.002"


def expected_rebalance_pnl(d):
    return f"select time, {r('sum((w - wl) * fwd)')} expected from {book(d)} b group by time"


def new_and_exited(d):
    """Names that joined or left the book, by date (EXCEPT both ways)."""
    now, before = (f"select time, asset from {book(d)} b where {x} <> 0" for x in ("w", "wl"))
    return f"select time, asset, 'entered' change from ({now} except {before}) a union all select time, asset, 'left' from ({before} except {now}) b"


OPERATORS = (forward_returns, rank_ic, smooth_ic, ic_weights, ic_weights_leak_free, ic_weights_absolute, composite_score, factor_correlations, correlation_penalty, weight_floor, kendall_ic, quintile_returns, ic_decay, holding_period, decile_spread, equal_topk, positions_by_date, budget, equal_weight_benchmark, cap_weight_benchmark, exchange_benchmarks, risk_overlay, softmax_tilt, whatif_blacklist, whatif_seats, cost_schemes, cost_drag, portfolio_diagnostics, factor_exposure, factor_vectors, cost_by_asset, cost_by_month, cost_by_size, cost_sensitivity, turnover_efficiency, range_cost_share, aggregated_positions, holdings_overlap, trade_list, expected_rebalance_pnl, new_and_exited)
