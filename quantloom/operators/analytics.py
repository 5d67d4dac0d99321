"""Performance, exposure, attribution, risk, regimes, single names and calendars, as queries over the book of positions."""

from __future__ import annotations

from ..functions.dsl import Dialect
from .book import OVER, book, curve, days, performance, q, r, regimes, series, signals, strategies, weekday, window

ANN = "sqrt(252e0)"


def _dd(x: str = "r", by: str = "") -> str:
    """A relation's drawdown needs the growth first: use over a subquery with column g."""
    part = f"partition by {by} " if by else ""
    return f"g / max(g) over ({part}order by time rows between unbounded preceding and current row) - 1"


def _growth(d: Dialect) -> str:
    return f"(select time, r, m, turnover, {curve()} g, {curve('m')} gm from {series(d)} s)"


def _last(d: Dialect) -> str:
    return f"(select asset, sector, w, score, quality, flow, ret from {book(d)} b where time = (select max(time) from {signals(d)} t))"


def drawdown(d):
    return f"select time, {r('g')} growth, {r(_dd())} drawdown from {_growth(d)} x"


def additive_drawdown(d):
    """Drawdown of summed returns."""
    return f"select time, {r(f'c - max(c) over {OVER}')} drawdown from (select time, sum(r) over {OVER} c from {series(d)} s) x"


def performance_summary(d):
    """One row of measures over the whole history."""
    return f"select {performance()}, {r('avg(gross)')} mean_gross, {r('avg(net)')} mean_net, {r('avg(turnover)')} mean_turnover, {r('avg(turnover) * 10e-4 * 252')} tc_drag, {r('avg(hhi)')} mean_hhi from {series(d)} s"


def month_extremes(d):
    """Best and worst month by summed returns; worst drawdown; return over it."""
    m = f"(select last_day(time) k, sum(r) s from {series(d)} x group by last_day(time))"
    dd = f"(select min(dd) x from (select {_dd()} dd from {_growth(d)} g) y)"
    return f"select {r('max(m.s)')} best_month, {r('min(m.s)')} worst_month, {r('max(dd.x)')} max_drawdown, {r('max(a.a) / nullif(abs(max(dd.x)), 0)', 5)} calmar from {m} m cross join {dd} dd cross join (select avg(r) * 252 a from {series(d)} s) a"


def period_returns(d):
    """Growth of the last 7 days, month and year."""
    spans = {"week": 7, "month": 31, "year": 365}
    parts = [f"select '{n}' period, {r('exp(sum(ln(1 + s.r))) - 1')} ret from {series(d)} s cross join (select max(time) t from {series(d)} x) e where {days(d, 'e.t', 's.time')} <= {k}" for n, k in spans.items()]
    return " union all ".join(parts)


def rolling_sharpe(d):
    w = window(52)
    return f"select time, case when count(r) over {w} >= 52 then {r(f'avg(r) over {w} / (stddev_samp(r) over {w} + 1e-12) * {ANN}', 5)} end sharpe from {series(d)} s"


def rolling_metrics(d):
    """Ratio, downside ratio, deviation and share of gains over 26 bars."""
    w = window(26)
    return f"select time, {r(f'avg(r) over {w} / (stddev_samp(r) over {w} + 1e-8) * {ANN}', 5)} sharpe, {r(f'avg(r) over {w} / (sqrt(avg(power(least(r, 0e0), 2)) over {w}) + 1e-8) * {ANN}', 5)} sortino, {r(f'stddev_samp(r) over {w} * {ANN}')} vol, {r(f'avg(case when r > 0 then 1e0 else 0e0 end) over {w}')} win from {series(d)} s"


def exposure_series(d):
    """Long, short, net and gross, with counts, by date."""
    return f"select time, {r('sum(greatest(w, 0e0))')} long_exposure, {r('-sum(least(w, 0e0))')} short_exposure, {r('sum(w)')} net, {r('sum(abs(w))')} gross, count(case when w > 0 then 1 end) longs, count(case when w < 0 then 1 end) shorts from {book(d)} b group by time"


def exposure_summary(d):
    return f"select {r('sum(abs(w))')} gross, {r('sum(w)')} net, {r('sum(greatest(w, 0e0))')} longs, {r('-sum(least(w, 0e0))')} shorts, count(case when abs(w) > 1e-12 then 1 end) n, {r('sum(w * w)')} hhi, {r('1 / nullif(sum(w * w) / power(sum(abs(w)), 2), 0)', 4)} effective_n from {_last(d)} l"


def exposure_history(d):
    """Where the last net exposure stands in its past."""
    return f"select {r('avg(net)')} mean_net, {r('stddev_samp(net)')} std_net, {r('min(net)')} min_net, {r('max(net)')} max_net, {r('(max_by(net, time) - avg(net)) / (stddev_samp(net) + 1e-12)', 4)} z from {series(d)} s"


def exposure_changes(d):
    return f"select time, {r('gross - lag(gross) over (order by time)')} d_gross, {r('net - lag(net) over (order by time)')} d_net from {series(d)} s"


def top_positions(d):
    ranked = f"(select asset, w, row_number() over (order by w desc, asset) a, row_number() over (order by w, asset) b from {_last(d)} l)"
    return f"select asset, {r('w')} w, case when w > 0 then 'long' else 'short' end side from {ranked} x where (w > 0 and a <= 3) or (w < 0 and b <= 3)"


def position_breakdown(d):
    return f"select asset, {r('w')} w, {r('abs(w) / nullif(sum(abs(w)) over (partition by sign(w)), 0)')} side_share from {_last(d)} l where w <> 0"


def concentration_by_side(d):
    return f"select time, case when w > 0 then 'long' else 'short' end side, {r('sum(w * w) / nullif(power(sum(w), 2), 0)')} hhi, count(*) n from {book(d)} b where w <> 0 group by time, case when w > 0 then 'long' else 'short' end"


def concentration(d):
    """Share of the largest 1 and 5 names, index and effective number, by date."""
    ranked = f"(select time, abs(w) a, row_number() over (partition by time order by abs(w) desc, asset) k from {book(d)} b where w <> 0)"
    return f"select time, {r('sum(case when k <= 1 then a end) / nullif(sum(a), 0)')} top1, {r('sum(case when k <= 5 then a end) / nullif(sum(a), 0)')} top5, {r('sum(a * a) / nullif(power(sum(a), 2), 0)')} hhi, {r('power(sum(a), 2) / nullif(sum(a * a), 0)', 4)} effective_n from {ranked} x group by time"


def hit_rate(d):
    return f"select time, {r('avg(case when wl * ret > 0 then 1e0 else 0e0 end)')} hit_rate, count(*) held from {book(d)} b where wl <> 0 group by time"


def winner_loser_sizing(d):
    return f"select {r('avg(case when wl * ret > 0 then abs(wl) end)')} winners, {r('avg(case when wl * ret < 0 then abs(wl) end)')} losers from {book(d)} b where wl <> 0"


def factor_attribution(d):
    """Exposure times the factor's return (its long-short spread), and what is left."""
    fr = f"(select time, avg(score * ret) f1, avg(flow * ret) f2 from (select time, ret, lag(score) over (partition by asset order by time) score, lag(flow) over (partition by asset order by time) flow from {signals(d)} s) x group by time)"
    ex = f"(select time, sum(wl * ls) e1, sum(wl * lf) e2, sum(wl * ret) p from (select time, wl, ret, lag(score) over (partition by asset order by time) ls, lag(flow) over (partition by asset order by time) lf from {book(d)} b) y group by time)"
    return f"select e.time, {r('coalesce(e1 * f1, 0e0)')} by_score, {r('coalesce(e2 * f2, 0e0)')} by_flow, {r('p - coalesce(e1 * f1, 0e0) - coalesce(e2 * f2, 0e0)')} specific from {ex} e join {fr} f on e.time = f.time"


def rolling_regression(d):
    """Slope, intercept and fit of the book on the market over 52 bars."""
    w = window(52)
    cov, var, vr = f"covar_pop(r, m) over {w}", f"var_pop(m) over {w}", f"var_pop(r) over {w}"
    beta = f"({cov}) / nullif({var}, 0)"
    return f"select time, {r(beta)} beta, {r(f'avg(r) over {w} - ({beta}) * (avg(m) over {w})')} alpha, {r(f'power({cov}, 2) / nullif(({var}) * ({vr}), 0)')} r2 from {series(d)} s"


def market_decomposition(d):
    """The book's return as beta times the market and the rest, compounded."""
    b = f"(select covar_pop(r, m) / nullif(var_pop(m), 0) b from {series(d)} s)"
    x = f"(select s.time, s.r, b.b * s.m f, s.r - b.b * s.m i from {series(d)} s cross join {b} b)"
    return f"select time, {r('r')} total, {r('f')} systematic, {r('i')} specific, {r(f'sum(f) over {OVER}')} cum_systematic, {r(f'sum(i) over {OVER}')} cum_specific from {x} y"


def brinson_by_asset(d):
    """Allocation, selection and interaction against the equal-weight benchmark."""
    x = f"(select time, wl pw, lag(bw) over (partition by asset order by time) b, ret, avg(ret) over (partition by time) br from {book(d)} k)"
    return f"select time, {r('sum((pw - coalesce(b, 0e0)) * br)')} allocation, {r('sum(coalesce(b, 0e0) * (ret - br))')} selection, {r('sum((pw - coalesce(b, 0e0)) * (ret - br))')} interaction from {x} x group by time"


def brinson_by_sector(d):
    x = f"(select time, sector, sum(wl) pw, sum(bw) b, coalesce(case when abs(sum(wl)) > 1e-9 then sum(wl * ret) / nullif(sum(wl), 0) end, 0e0) pr, coalesce(case when abs(sum(bw)) > 1e-9 then sum(bw * ret) / nullif(sum(bw), 0) end, 0e0) br from {book(d)} k group by time, sector)"
    y = f"(select *, sum(b * br) over (partition by time) total from {x} x)"
    return f"select time, {r('sum((pw - b) * (br - total))')} allocation, {r('sum(b * (pr - br))')} selection, {r('sum((pw - b) * (pr - br))')} interaction from {y} y group by time"


def sector_attribution(d):
    return f"select time, sector, {r('sum(wl * ret)')} contribution, {r('sum(w)')} exposure, {r('sum(abs(w))')} gross from {book(d)} b group by time, sector"


def sector_concentration(d):
    s = f"(select sector, sum(abs(w)) g from {_last(d)} l group by sector)"
    return f"select {r('sum(g * g) / nullif(power(sum(g), 2), 0)')} hhi, {r('power(sum(g), 2) / nullif(sum(g * g), 0)', 4)} effective_n, {r('max(g) / nullif(sum(g), 0)')} largest from {s} x"


def sector_risk(d):
    """Covariance of each sector's contribution with the book over its variance."""
    c = f"(select time, sector, sum(wl * ret) c from {book(d)} b group by time, sector)"
    return f"select c.sector, {r('covar_samp(c.c, s.r) / nullif(var_samp(s.r), 0)')} share from {c} c join {series(d)} s on c.time = s.time group by c.sector"


def risk_contribution(d):
    """Each name's share of the book's variance, of the last 52 bars."""
    recent = f"(select max(t) - 52 t0 from {signals(d)} x)"
    return f"select b.asset, {r('covar_samp(b.wl * b.ret, s.r) / nullif(var_samp(s.r), 0)')} share, {r(f'stddev_samp(b.wl * b.ret) * {ANN}')} vol from {book(d)} b join {series(d)} s on b.time = s.time cross join {recent} z where b.t > z.t0 group by b.asset"


def realised_book_risk(d):
    """Deviation of what the last book would have earned over the last 52 bars, and of its difference from equal weights."""
    x = f"(select b.time, sum(l.w * b.ret) p, sum(l.w * b.ret) - avg(b.ret) a from {signals(d)} b join {_last(d)} l on l.asset = b.asset where b.t > (select max(t) - 52 from {signals(d)} y) group by b.time)"
    return f"select {r(f'stddev_samp(p) * {ANN}')} vol, {r(f'stddev_samp(a) * {ANN}')} tracking_error from {x} x"


def factor_covariance(d):
    f = f"(select time, avg(score * ret) f1, avg(quality * ret) f2, avg(flow * ret) f3 from {signals(d)} s group by time)"
    parts = " union all ".join(f"select 'f{i}' a, 'f{j}' b, {r(f'covar_samp(f{i}, f{j})', 9)} cov from {f} x" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j)
    return parts


def asset_correlations(d):
    a = f"(select time, asset, ret from {signals(d)} s where t > (select max(t) - 104 from {signals(d)} y))"
    pair = "stddev_pop(a.ret) * stddev_pop(b.ret)"
    return f"select a.asset a1, b.asset a2, {r(f'case when {pair} > 1e-12 then covar_pop(a.ret, b.ret) / nullif({pair}, 0) end')} corr from {a} a join {a} b on a.time = b.time and a.asset < b.asset group by a.asset, b.asset"


def risk_cone(d):
    s = f"(select avg(r) mu, stddev_samp(r) sd from {series(d)} x)"
    return f"select h, {r('100 * (1 + mu * h)', 5)} centre, {r('100 * (1 + mu * h) * exp(sd * sqrt(cast(h as double)))', 5)} up1, {r('100 * (1 + mu * h) * exp(-sd * sqrt(cast(h as double)))', 5)} down1, {r('100 * (1 + mu * h) * exp(2 * sd * sqrt(cast(h as double)))', 5)} up2, {r('100 * (1 + mu * h) * exp(-2 * sd * sqrt(cast(h as double)))', 5)} down2 from {s} s cross join (values (1), (2), (3), (4), (5)) g(h)"


def expected_return(d):
    """Drift of the last 21 bars and its place in the whole history."""
    s = f"(select r, row_number() over (order by time desc) k from {series(d)} x)"
    return f"select {r('avg(case when k <= 21 then r end)', 8)} recent, {r('avg(r)', 8)} mean, {r('stddev_samp(r)', 8)} sd, {r('(avg(case when k <= 21 then r end) - avg(r)) / (stddev_samp(r) + 1e-12)')} z from {s} y"


def up_down_capture(d):
    return f"select {r('avg(case when m > 0 then r end) / nullif(avg(case when m > 0 then m end), 0)', 5)} up, {r('avg(case when m < 0 then r end) / nullif(avg(case when m < 0 then m end), 0)', 5)} down, {r('avg(case when r > m then 1e0 else 0e0 end)')} batting from {series(d)} s"


def rolling_beta(d):
    """Over the 52 bars before: sample covariance over population variance."""
    w = window(52, skip=1)
    return f"select time, case when count(r) over {w} >= 52 then {r(f'covar_samp(r, m) over {w} / (var_pop(m) over {w} + 1e-12)')} end beta from {series(d)} s"


def beta_stability(d):
    return f"select {r('avg(beta)')} mean, {r('stddev_samp(beta)')} sd, {r('min(beta)')} least, {r('max(beta)')} most from (select beta from ({rolling_beta(d)}) b where beta is not null) x"


def specific_risk(d):
    """Deviation of what the market does not explain, by asset."""
    return f"select asset, {r(f'sqrt(greatest(var_samp(ret) - power(covar_samp(ret, m), 2) / nullif(var_samp(m), 0), 0e0)) * {ANN}')} specific, {r('covar_samp(ret, m) / nullif(var_samp(m), 0)')} beta from (select asset, ret, avg(ret) over (partition by time) m from {signals(d)} s) x group by asset"


def value_at_risk(d):
    cut = f"(select {q(d, 'r', 0.05)} v95, {q(d, 'r', 0.01)} v99 from {series(d)} s)"
    return f"select {r('max(v95)')} var95, {r('avg(case when r <= v95 then r end)')} cvar95, {r('max(v99)')} var99, {r('avg(case when r <= v99 then r end)')} cvar99 from {series(d)} s cross join {cut} c"


def tail_metrics(d):
    """Extremes, biased moments, and the share beyond three deviations."""
    z = f"(select r, time, avg(r) over () mu, stddev_pop(r) over () sd from {series(d)} s)"
    return f"select {r('min(r)')} worst, {r('avg(power((r - mu) / nullif(sd, 0), 3))', 5)} skew, {r('avg(power((r - mu) / nullif(sd, 0), 4)) - 3', 4)} kurt, {r('avg(case when abs(r - mu) > 3 * sd then 1e0 else 0e0 end)')} beyond3 from {z} x"


def rolling_tail_risk(d):
    w = window(63)
    return f"select time, case when count(r) over {w} >= 63 then {r(q(d, 'r', 0.05) + f' over {w}')} end var95, {r(f'min(r) over {w}')} worst from {series(d)} s"


def regime_series(d):
    return f"select time, regime, {r('vol', 8)} vol, vol_z + 0.0 vol_z, trend_corr + 0.0 trend_corr, skew + 0.0 skew from {regimes(d)} x"


def regime_performance(d):
    return f"select regime, {performance()} from {regimes(d)} x group by regime having count(*) >= 5"


def regime_durations(d):
    """Lengths of runs of one regime (islands)."""
    runs = f"(select regime, sum(new) over {OVER} k from (select time, regime, case when regime = lag(regime) over (order by time) then 0 else 1 end new from {regimes(d)} x) y)"
    return f"select regime, count(*) runs, {r('avg(n)')} mean_bars, max(n) longest from (select regime, k, count(*) n from {runs} z group by regime, k) u group by regime"


def strategy_regimes(d):
    """Mean return of each book by regime, a column each."""
    x = f"(select s.strategy, s.r, g.regime from {strategies(d)} s join {regimes(d)} g on s.time = g.time)"
    return f"select strategy, {', '.join(r(f'avg(case when regime = {n!r} then r end)', 8) + ' ' + n for n in ('calm', 'normal', 'trend', 'crisis'))} from {x} x group by strategy"


def gamma_exposure(d):
    return f"select time, {r('sum(wl * ret * ret) - sum(wl * ret)')} gamma from {book(d)} b group by time"


def payoff_asymmetry(d):
    up, down = "case when m > 0 then {} end", "case when m < 0 then {} end"
    b = lambda x: f"covar_samp({x.format('r')}, {x.format('m')}) / nullif(var_samp({x.format('m')}), 0)"
    return f"select {r(b(up))} up_beta, {r(b(down))} down_beta, {r(b(up) + ' - ' + b(down))} asymmetry from {series(d)} s"


def capacity(d):
    """Capital at which a name of the last book takes five days of 5 % of its mean volume."""
    adv = f"(select asset, avg(vol * close) adv from {signals(d)} s where t > (select max(t) - 63 from {signals(d)} y) group by asset)"
    return f"select min_by(l.asset, a.adv / abs(l.w)) bottleneck, {r('min(a.adv * 0.05e0 * 5 / abs(l.w))', 2)} capacity from {_last(d)} l join {adv} a on a.asset = l.asset where abs(l.w) > 1e-12"


def forecast_features(d):
    """Lags, rolling moments and the next return as target."""
    lags = ", ".join(f"{r(f'lag(r, {k}) over (order by time)')} lag{k}" for k in (1, 2, 3, 5))
    rolls = ", ".join(f"{r(f'avg(r) over {window(n)}', 8)} mean{n}, {r(f'stddev_samp(r) over {window(n)}', 8)} std{n}" for n in (21, 63, 126))
    return f"select time, {lags}, {rolls}, {r('lead(r) over (order by time)')} target from {series(d)} s"


def spread_proxy(d):
    """Twice the deviation of log price changes over 21 bars."""
    x = f"(select time, asset, ln(close) - lag(ln(close)) over (partition by asset order by time) x from {signals(d)} s where close > 0)"
    w = window(21, by="asset")
    return f"select time, asset, case when count(x) over {w} >= 21 then {r(f'2 * stddev_samp(x) over {w}')} end spread from {x} y"


def impact_estimate(d):
    w = window(63, by="asset")
    med = q(d, "vol", 0.5)
    return f"select time, asset, {r(f'0.1e0 * sqrt(abs(w) / nullif({med} over {w}, 0))', 8)} impact from {book(d)} b"


def scenarios(d):
    """Named date ranges joined with the series they fall on."""
    names = "(values ('early', date '1992-06-01', date '1993-06-30'), ('middle', date '1995-01-01', date '1995-12-31'), ('late', date '1998-01-01', date '1998-10-31'))"
    x = f"(select n.name, s.time, s.r, sum(s.r) over (partition by n.name order by s.time) c from {names} n(name, a, b) join {series(d)} s on s.time between n.a and n.b)"
    return f"select name, count(*) bars, {r('exp(sum(ln(1 + r))) - 1')} ret, {r('min(c - p)')} max_dd, {r(f'stddev_samp(r) * {ANN}')} vol, {r('min(r)')} worst from (select *, max(c) over (partition by name order by time rows between unbounded preceding and current row) p from {x} x) y group by name"


def compare_strategies(d):
    return f"select strategy, {performance()}, {r('avg(turnover)')} turnover from {strategies(d)} s group by strategy"


def strategy_correlations(d):
    return f"select a.strategy s1, b.strategy s2, {r('covar_pop(a.r, b.r) / nullif(stddev_pop(a.r) * stddev_pop(b.r), 0)')} corr from {strategies(d)} a join {strategies(d)} b on a.time = b.time and a.strategy < b.strategy group by a.strategy, b.strategy"


def strategy_rolling_correlations(d):
    x = f"(select a.time, a.strategy || '/' || b.strategy pair, a.r x, b.r y from {strategies(d)} a join {strategies(d)} b on a.time = b.time and a.strategy < b.strategy)"
    w = window(52, by="pair")
    return f"select time, pair, case when count(x) over {w} >= 52 then {r(f'covar_pop(x, y) over {w} / nullif((stddev_pop(x) over {w}) * (stddev_pop(y) over {w}), 0)')} end corr from {x} z"


def risk_parity(d):
    """Weights by inverse volatility, and in proportion to it."""
    v = f"(select strategy, stddev_samp(r) v from {strategies(d)} s group by strategy)"
    return f"select strategy, {r('(1 / nullif(v, 0)) / sum(1 / nullif(v, 0)) over ()')} inverse_vol, {r('v / sum(v) over ()')} proportional from {v} x"


def rotation_signals(d):
    """Momentum and ratio of each book in buckets; the strongest class is tested first."""
    x = f"(select strategy, exp(sum(case when k <= 21 then ln(1 + r) end)) - 1 mom, avg(case when k <= 63 then r end) / nullif(stddev_samp(case when k <= 63 then r end), 0) * {ANN} sh from (select *, row_number() over (partition by strategy order by time desc) k from {strategies(d)} s) y group by strategy)"
    return f"select strategy, {r('mom')} momentum, {r('sh', 4)} sharpe, case when mom > 0.05 and sh > 1 then 'strong buy' when mom > 0 and sh > 0 then 'buy' when mom < -0.05 and sh < -1 then 'strong sell' when mom < 0 and sh < 0 then 'sell' else 'hold' end signal from {x} z"


def rotation_velocity(d):
    """How much the ranks of a date moved in 21 bars."""
    k = f"(select time, asset, t, dense_rank() over (partition by time order by score) k from {signals(d)} s)"
    return f"select time, {r('sum(abs(k - before)) / count(*)')} velocity from (select time, k, lag(k, 21) over (partition by asset order by time) before from {k} x) y where before is not null group by time"


def sector_rotation(d):
    s = f"(select time, sector, sum(w) w from {book(d)} b group by time, sector)"
    return f"select time, sector, {r('w - lag(w, 13) over (partition by sector order by time)')} change from {s} x"


def timing_skill(d):
    """Correlation, sign agreement and sum of lagged weights with returns, by asset."""
    pair = "stddev_pop(wl) * stddev_pop(ret)"
    return f"select asset, {r(f'case when {pair} > 1e-12 then covar_pop(wl, ret) / nullif({pair}, 0) end')} corr, {r('avg(case when wl * ret > 0 then 1e0 when wl * ret < 0 then 0e0 end)')} hit_rate, {r('sum(wl * ret)')} pnl from {book(d)} b group by asset"


def signal_decay(d):
    """Autocorrelation of the book's returns, 1 to 10 bars."""
    parts = " union all ".join(f"select {k} lag_bars, r, lag(r, {k}) over (order by time) b from {series(d)} s" for k in range(1, 11))
    return f"select lag_bars, {r('covar_pop(r, b) / nullif(stddev_pop(r) * stddev_pop(b), 0)')} corr from ({parts}) x where b is not null group by lag_bars"


def turnover_analysis(d):
    return f"select {r('avg(turnover)')} mean, {r('stddev_samp(turnover)')} sd, {r('max(turnover)')} most, {r(q(d, 'turnover', 0.5))} median, {r('avg(turnover) * 252')} yearly, {r('avg(turnover) * 252 * 10e-4')} yearly_cost from {series(d)} s"


def trade_quality(d):
    x = f"(select time, asset, abs(w - wl) size, sign(w - wl) * fwd gain from {book(d)} b where abs(w - wl) > 1e-12)"
    return f"select count(*) trades, {r('avg(size)')} mean_size, {r('avg(case when gain > 0 then 1e0 else 0e0 end)')} timing, {r('avg(gain)')} mean_gain from {x} x"


def trade_islands(d):
    """Holding periods of each asset: entry, exit, bars, profit; one that still runs has no exit."""
    held = f"(select time, asset, wl, w, ret, sum(case when w <> 0 and wl = 0 then 1 else 0 end) over (partition by asset order by time rows between unbounded preceding and current row) k from {book(d)} b)"
    return f"select asset, k trade, min(time) entry, case when max_by(w, time) = 0 then max(time) end exit, count(*) bars, {r('sum(wl * ret)')} pnl from {held} x where k > 0 and (w <> 0 or wl <> 0) group by asset, k"


def position_changes(d):
    """ENTRY, EXIT, INCREASE and DECREASE counts of each asset."""
    kind = "case when wl = 0 and w <> 0 then 'ENTRY' when wl <> 0 and w = 0 then 'EXIT' when abs(w) > abs(wl) then 'INCREASE' when abs(w) < abs(wl) then 'DECREASE' end"
    return f"select asset, {', '.join(f'count(case when {kind} = {n!r} then 1 end) {n.lower()}' for n in ('ENTRY', 'EXIT', 'INCREASE', 'DECREASE'))} from {book(d)} b group by asset"


def stock_metrics(d):
    """Per asset: deviation, ratios, tail, beta, days held and profit."""
    x = f"(select asset, wl, w, ret, avg(ret) over (partition by time) m from {book(d)} b)"
    return f"select asset, {r(f'stddev_samp(ret) * {ANN}')} vol, {r(f'avg(ret) / nullif(stddev_samp(ret), 0) * {ANN}', 5)} sharpe, {r(q(d, 'ret', 0.05))} var95, {r('covar_samp(ret, m) / nullif(var_samp(m), 0)')} beta, count(case when w <> 0 then 1 end) held, {r('sum(wl * ret)')} pnl, {r('max(ret)')} best, {r('min(ret)')} worst from {x} x group by asset"


def stock_screen(d):
    """Names held for long enough with a profit, and whether they are held now."""
    return f"select asset, count(case when w <> 0 then 1 end) held, {r('sum(wl * ret)')} pnl, max_by(w, time) <> 0 current, case when max_by(w, time) > 0 then 'long' when max_by(w, time) < 0 then 'short' else 'none' end side from {book(d)} b group by asset having count(case when w <> 0 then 1 end) >= 50"


def stock_contribution(d):
    return f"select time, asset, {r('wl * ret')} contribution, {r('wl / nullif(sum(abs(wl)) over (partition by time), 0)')} share from {book(d)} b where wl <> 0"


def stock_rolling(d):
    """Return, deviation and gains over 21 bars, by asset."""
    w = window(21, by="asset")
    return f"select time, asset, {r(f'exp(sum(ln(1 + ret)) over {w}) - 1')} ret21, {r(f'stddev_samp(ret) over {w} * {ANN}')} vol, {r(f'avg(case when ret > 0 then 1e0 else 0e0 end) over {w}')} win from {signals(d)} s"


def stock_beta_rolling(d):
    x = f"(select time, asset, ret, avg(ret) over (partition by time) m from {signals(d)} s)"
    w = window(63, by="asset")
    return f"select time, asset, case when count(ret) over {w} >= 63 then {r(f'covar_samp(ret, m) over {w} / (var_samp(m) over {w} + 1e-12)')} end beta from {x} y"


def stock_distribution(d):
    """Moments, Jarque-Bera statistic and t-statistic of each asset's returns."""
    z = f"(select asset, ret, avg(ret) over (partition by asset) mu, stddev_pop(ret) over (partition by asset) sd from {signals(d)} s)"
    skew, kurt = "avg(power((ret - mu) / nullif(sd, 0), 3))", "(avg(power((ret - mu) / nullif(sd, 0), 4)) - 3)"
    return f"select asset, count(*) n, {r('avg(ret)', 8)} mean, {r(skew, 5)} skew, {r(kurt, 4)} kurt, {r(f'count(*) / 6e0 * (power({skew}, 2) + power({kurt}, 2) / 4)', 2)} jarque_bera, {r('avg(ret) / nullif(stddev_samp(ret) / sqrt(cast(count(*) as double)), 0)', 5)} t_stat, {r(q(d, 'ret', 0.25))} p25, {r(q(d, 'ret', 0.75))} p75 from {z} x group by asset"


def stock_histogram(d):
    """Ten equal bins of the market's returns."""
    b = f"(select min(m) lo, max(m) hi from {series(d)} s)"
    x = f"(select least(cast(floor((s.m - b.lo) / nullif(b.hi - b.lo, 0) * 10) as int), 9) bin from {series(d)} s cross join {b} b)"
    return f"select bin, count(*) n from {x} x group by bin"


def losing_streaks(d):
    """Longest run of losses, by book."""
    k = f"(select strategy, r, sum(case when r >= 0 then 1 else 0 end) over (partition by strategy order by time rows between unbounded preceding and current row) k from {strategies(d)} s)"
    return f"select strategy, max(n) longest from (select strategy, k, count(case when r < 0 then 1 end) n from {k} x group by strategy, k) y group by strategy"


def stock_forward(d):
    """Expected return and band of each name over 1, 5 and 21 bars."""
    s = f"(select asset, 0.001e0 * max_by(score, time) base, stddev_samp(ret) sd from {signals(d)} x group by asset)"
    h = "sqrt(cast(h as double))"
    return f"select asset, h, {r(f'base * {h}', 8)} expected, {r(f'base * {h} - sd * {h}', 8)} low, {r(f'base * {h} + sd * {h}', 8)} high from {s} s cross join (values (1), (5), (21)) g(h)"


def stock_ratings(d):
    """Weighted score of signals, performance and risk, as a rating."""
    x = f"(select asset, 0.4e0 * max_by(score, time) / 5 + 0.25e0 * greatest(least(avg(ret) / nullif(stddev_samp(ret), 0) * {ANN} / 3, 1), -1) + 0.2e0 * max_by(flow, time) / 5 + 0.1e0 * max_by(quality, time) / 5 + 0.05e0 * sign(round(sum(wl * ret), 9)) s from {book(d)} b group by asset)"
    return f"select asset, {r('s', 5)} rating_score, case when s >= 0.6 then 'STRONG BUY' when s >= 0.2 then 'BUY' when s <= -0.6 then 'STRONG SELL' when s <= -0.2 then 'SELL' else 'HOLD' end rating from {x} x"


def stock_grades(d):
    """Ranks of four measures across assets as letters."""
    x = f"(select asset, avg(ret) a, -stddev_samp(ret) b, sum(wl * ret) c, count(case when w <> 0 then 1 end) e from {book(d)} k group by asset)"
    s = "(percent_rank() over (order by round(a, 9)) + percent_rank() over (order by round(b, 9)) + percent_rank() over (order by round(c, 9)) + percent_rank() over (order by e)) / 4"
    return f"select asset, {r('s')} grade_score, case when s >= 0.8 then 'A' when s >= 0.6 then 'B' when s >= 0.4 then 'C' when s >= 0.2 then 'D' else 'F' end grade from (select asset, {s} s from {x} x) y"


def normal_quantiles(d):
    """Sorted standardised returns of the book with their plotting positions."""
    return f"select row_number() over (order by r, time) k, {r('(row_number() over (order by r, time) - 0.5e0) / count(*) over ()')} p, {r('(r - avg(r) over ()) / nullif(stddev_samp(r) over (), 0)', 5)} z from {series(d)} s"


def calendar_by_weekday(d):
    """Daily market returns by weekday."""
    x = f"(select time, avg(ret) m from (select time, close / nullif(lag(close) over (partition by asset order by time), 0) - 1 ret from {_daily(d)} b) y group by time)"
    wd = weekday(d, "time")
    return f"select {wd} weekday, count(m) n, {r('avg(m)', 8)} mean, {r('stddev_samp(m)', 8)} sd, {r('max(m)')} best, {r('min(m)')} worst from {x} x group by {wd}"


def _daily(d: Dialect) -> str:
    from .book import bars

    return bars(d, unit="day")


def calendar_by_month(d):
    """Year by month, a column a month."""
    return f"select year(time) y, {', '.join(r(f'avg(case when month(time) = {k} then r end)', 8) + f' m{k}' for k in range(1, 13))} from {series(d)} s group by year(time)"


def calendar_weeks(d):
    return f"select year(time) y, weekofyear(time) w, {r('sum(r)')} ret from {series(d)} s group by year(time), weekofyear(time)"


def calendar_breakdown(d):
    return f"select quarter(time) k, count(*) n, {r('avg(r)', 8)} mean, {r('stddev_samp(r)', 8)} sd, {r('min(r)')} least, {r('max(r)')} most from {series(d)} s group by quarter(time)"


def anomalies(d):
    """Returns beyond 2.5 deviations of the last 20 bars."""
    w = window(20)
    return f"select time, {r('r')} r, {r('z', 4)} z from (select time, r, (r - avg(r) over {w}) / nullif(stddev_samp(r) over {w}, 0) z, count(r) over {w} n from {series(d)} s) x where n >= 20 and abs(round(z, 6)) > 2.5"


def insights(d):
    """Rules over the book's state, a row per rule that holds, with its severity."""
    s = f"(select count(*) n, min_by(r, time) r0, {q(d, 'r', 0.05)} v95, avg(r) / nullif(stddev_samp(r), 0) * {ANN} sharpe, stddev_samp(r) * {ANN} vol, avg(turnover) turnover, avg(gross) gross, max(hhi) hhi from {series(d)} x)"
    rules = {"volatility above 20 %": ("vol > 0.2", "warning"), "ratio below 0": ("sharpe < 0", "critical"), "ratio above 1": ("sharpe > 1", "good"), "turnover above 50 %": ("turnover > 0.5", "warning"), "5 % loss beyond 3 %": ("v95 < -0.03", "warning"), "gross below 1": ("gross < 1", "info"), "concentrated": ("hhi > 0.05", "info")}
    return " union all ".join(f"select '{n}' rule, '{sev}' severity from {s} s where {test}" for n, (test, sev) in rules.items())


def insight_summary(d):
    return f"select severity, count(*) n from ({insights(d)}) x group by severity"


def structural_changes(d):
    """Concentration and names of the book, first year against the last."""
    x = f"(select asset, w, t, t < 52 early, t > (select max(t) - 52 from {signals(d)} y) late from {book(d)} b where w <> 0)"
    return f"select {r('sum(case when early then w * w end) / nullif(count(case when early then 1 end), 0)', 8)} early_hhi, {r('sum(case when late then w * w end) / nullif(count(case when late then 1 end), 0)', 8)} late_hhi, count(distinct case when early then asset end) early_names, count(distinct case when late then asset end) late_names from {x} x"


def run_metrics(d):
    """Yearly log growth, deviation and their ratio of each book."""
    return f"select strategy, {r('sum(ln(1 + r)) * 52 / count(*)')} log_growth, {r('stddev_samp(r) * sqrt(52e0)')} vol, {r('sum(ln(1 + r)) * 52 / count(*) / nullif(stddev_samp(r) * sqrt(52e0), 0)', 5)} ratio, {r('avg(case when r > 0 then 1e0 else 0e0 end)')} win from {strategies(d)} s group by strategy"


OPERATORS = tuple(f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_"))
