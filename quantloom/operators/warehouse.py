"""Operators of the price warehouse: reads by interval, key and date, merges, upserts, calendars, gaps and data checks."""

from __future__ import annotations

from ..functions.dsl import Dialect
from .book import bars, days, each_day, ignore_nulls, plus, q, r, weekday


def _universe(d: Dialect) -> str:
    """Assets with the first and last bar that traded; those of some series are open-ended."""
    return f"""(select asset, upper(asset) symbol, 'EX' || substr(asset, 7, 1) exchange, min(time) first_seen, case when substr(asset, 8, 1) in ('1', '2') then max(time) end last_seen
 from {bars(d)} u where vol > 0 group by asset)"""


def universe_as_of(d):
    """Members on a date: intervals with open ends."""
    return f"select asset, symbol, exchange, first_seen, last_seen from {_universe(d)} u where (first_seen is null or first_seen <= date '1995-06-01') and (last_seen is null or last_seen >= date '1995-06-01')"


def bars_of_asset(d):
    """One asset, a range of dates."""
    return f"select time, asset, open open, high high, low low, close close, vol, is_liquid from {bars(d)} b where asset = 'Brand#13' and time between date '1994-01-01' and date '1995-12-31'"


def bars_by_day(d):
    """Daily bars, dense."""
    return f"select time, asset, open open, high high, low low, close close, vol from {bars(d, unit='day')} b where vol > 0"


def bars_by_supplier(d):
    """A wide cross-section."""
    return f"select time, asset, close close, vol, is_liquid, t from {bars(d, 'supplier')} b"


def cross_section(d):
    """All assets on one date."""
    return f"select time, asset, close close, vol from {bars(d)} b where time = (select max(time) from {bars(d)} x where time <= date '1996-03-15')"


def date_bounds(d):
    """First and last date."""
    return f"select min(time) first_date, max(time) last_date, count(distinct time) dates, count(distinct asset) assets from {bars(d)} b"


def symbol_history(d):
    """Latest bars of a symbol, any case, joined with the universe."""
    return f"select b.time, u.symbol, b.close close, b.vol from {bars(d)} b join {_universe(d)} u on b.asset = u.asset where upper(u.symbol) = upper('brand#21') order by b.time desc limit 50"


def symbols(d):
    return f"select distinct symbol from {_universe(d)} u"


def exchange_members(d):
    """Universe of some exchanges, pinned ids added."""
    return f"select asset from {_universe(d)} u where upper(exchange) in ('EX1', 'EX3') union select 'Brand#55' asset"


def members_only(d):
    """Semi join of bars with an exchange's list."""
    return f"select time, asset, close close from {bars(d)} b where exists (select 1 from {_universe(d)} u where u.asset = b.asset and u.exchange = 'EX2')"


def id_translation(d):
    """EXCH:TICKER ids split and matched both ways; ids without a colon drop out, the first id of a ticker wins."""
    ids = f"(select 'id-' || lower(replace(asset, '#', '')) server_id, exchange || ':' || replace(asset, '#', '') user_id from {_universe(d)} u union all select 'id-zz', 'NOCOLON' union all select 'id-zzz', 'EX9:Brand11')"
    return f"select split_part(user_id, ':', 2) ticker, min(server_id) server_id, count(*) candidates from {ids} i where user_id like '%:%' group by split_part(user_id, ':', 2)"


def field_long(d):
    """Fields of a bar as rows."""
    parts = " union all ".join(f"select time, asset, '{f}' field, {f} value from {bars(d)} b where vol > 0" for f in ("close", "high", "low", "vol"))
    return f"select * from ({parts}) x"


def field_pivot(d):
    """And back, the first value of a cell."""
    return f"select time, asset, max(case when field = 'close' then value end) close, max(case when field = 'vol' then value end) vol from ({field_long(d)}) x group by time, asset"


def market_cap(d):
    """Close times volume as a stand-in, carried over gaps; not positive is missing."""
    over = "(partition by asset order by time rows between unbounded preceding and current row)"
    return f"select time, asset, {ignore_nulls(d, 'case when close * vol > 0 then close * vol end', over)} mcap from {bars(d)} b"


def merged_sources(d):
    """Two sources of one panel: the second wins a date and asset that both have."""
    both = f"select time, asset, close, 1 priority from {bars(d)} a where time <= date '1996-12-31' union all select time, asset, close * 1.01e0, 2 from {bars(d)} b where time >= date '1996-06-01' and vol > 0"
    return f"select time, asset, close close, priority from (select *, row_number() over (partition by time, asset order by priority desc) k from ({both}) u) x where k = 1"


def upserted_universe(d):
    """Old and new rows of the universe: names kept, first date the least, last date the greatest."""
    old = f"(select * from {_universe(d)} u where exchange <> 'EX5')"
    new = f"(select asset, symbol, exchange, {plus(d, 'first_seen', -30)} first_seen, last_seen from {_universe(d)} u where exchange <> 'EX1')"
    return f"select coalesce(o.asset, n.asset) asset, coalesce(n.symbol, o.symbol) symbol, coalesce(least(o.first_seen, n.first_seen), o.first_seen, n.first_seen) first_seen, o.asset is null is_new from {old} o full outer join {new} n on o.asset = n.asset"


def insert_ignored(d):
    """Rows of a batch whose key is new, after those that are there."""
    have = f"(select time, asset, close from {bars(d)} b where time <= date '1996-12-31' and vol > 0)"
    batch = f"(select time, asset, close * 2 close from {bars(d)} b where time >= date '1996-06-01' and vol > 0)"
    return f"select time, asset, close close, 0 added from {have} h union all select n.time, n.asset, n.close, 1 from {batch} n where not exists (select 1 from {have} h where h.time = n.time and h.asset = n.asset)"


def seen_dates(d):
    """First and last date of each asset, from its bars."""
    return f"select asset, min(time) first_seen, max(time) last_seen, count(*) bars from {bars(d)} b where vol > 0 group by asset"


def date_chunks(d):
    """A range in chunks of 756 trading days."""
    step = int(756 * 365 / 252)
    return f"select day start_date, least({plus(d, 'day', step - 1)}, date '1999-12-31') end_date from {each_day(d, 'date ' + repr('1990-01-01'), 'date ' + repr('1999-12-31'), step)} c"


def trading_days(d):
    """Weekdays of a range."""
    return f"select day from {each_day(d, 'date ' + repr('1996-01-01'), 'date ' + repr('1996-12-31'))} c where {weekday(d, 'day')} < 5"


def last_trading_day(d):
    """Each day's latest weekday."""
    wd = weekday(d, "day")
    back = f"case when {wd} = 5 then {plus(d, 'day', -1)} when {wd} = 6 then {plus(d, 'day', -2)} else day end"
    return f"select day, {back} trading_day from {each_day(d, 'date ' + repr('1996-01-01'), 'date ' + repr('1996-03-31'))} c"


def missing_days(d):
    """Weekdays on which an asset did not trade."""
    traded = f"(select asset, time from {bars(d, unit='day')} b where vol > 0)"
    return f"select a.asset, c.day from (select distinct asset from {traded} t) a cross join (select day from {each_day(d, 'date ' + repr('1995-01-01'), 'date ' + repr('1995-01-31'))} e where {weekday(d, 'day')} < 5) c where not exists (select 1 from {traded} t where t.asset = a.asset and t.time = c.day)"


def head_tail_gaps(d):
    """What a target range lacks before the first and after the last date."""
    have = f"(select min(time) a, max(time) b from {bars(d)} x)"
    return f"select 'head' gap, date '1991-06-01' gap_start, {plus(d, 'a', -1)} gap_end from {have} h where a > date '1991-06-01' union all select 'tail', {plus(d, 'b', 1)}, date '2000-06-30' from {have} h where b < date '2000-06-30'"


def continuity(d):
    """Gaps of more than five calendar days between trading days of an asset."""
    x = f"select asset, time, lag(time) over (partition by asset order by time) before from {bars(d, unit='day')} b where vol > 0"
    return f"select asset, before gap_start, time gap_end, {days(d, 'time', 'before')} gap_days from ({x}) x where {days(d, 'time', 'before')} > 5"


def price_checks(d):
    """Rows that break the order of prices or are negative, by asset."""
    tests = {"high_below_low": "high < low", "high_below_open": "high < open", "high_below_close": "high < close", "low_above_open": "low > open", "low_above_close": "low > close", "negative_close": "close < 0", "zero_close": "close = 0"}
    return f"select asset, {', '.join(f'count(case when {t} then 1 end) {n}' for n, t in tests.items())} from {bars(d)} b group by asset"


def volume_checks(d):
    """Negative volumes, and the share of bars without any."""
    return f"select asset, count(case when vol < 0 then 1 end) negative, round(avg(case when vol = 0 then 1e0 else 0e0 end), 6) zero_share, avg(case when vol = 0 then 1e0 else 0e0 end) > 0.1 flagged from {bars(d)} b group by asset"


def duplicate_keys(d):
    """Keys that occur more than once."""
    return f"select l_orderkey, l_linenumber, count(*) n from {d.table('lineitem')} x group by l_orderkey, l_linenumber having count(*) > 1"


def sanitised(d):
    """Missing and infinite ratios as 0, in the width that files keep."""
    return f"select time, asset, coalesce(close / nullif(vol, 0), 0e0) ratio, cast(vol as int) vol from {bars(d)} b"


def wide_closes(d):
    """A column per asset."""
    names = [f"Brand#{i}{j}" for i in (1, 2) for j in range(1, 6)]
    return f"select time, {', '.join(f'max(case when asset = {n!r} then close end) {n.lower().replace('#', '')}' for n in names)} from {bars(d)} b group by time"


def liquidity_quantiles(d):
    """Spread of traded volume by exchange."""
    return f"select substr(asset, 7, 1) exchange, {r(q(d, 'vol', 0.1))} p10, {r(q(d, 'vol', 0.5))} p50, {r(q(d, 'vol', 0.9))} p90 from {bars(d)} b where vol > 0 group by substr(asset, 7, 1)"


OPERATORS = (universe_as_of, bars_of_asset, bars_by_day, bars_by_supplier, cross_section, date_bounds, symbol_history, symbols, exchange_members, members_only, id_translation, field_long, field_pivot, market_cap, merged_sources, upserted_universe, insert_ignored, seen_dates, date_chunks, trading_days, last_trading_day, missing_days, head_tail_gaps, continuity, price_checks, volume_checks, duplicate_keys, sanitised, wide_closes, liquidity_quantiles)
