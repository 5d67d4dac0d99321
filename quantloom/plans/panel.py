"""Panels of bars from the order lines: asset by brand or supplier, time by week or day, dense over both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.dsl import Dialect
from ..shared import stored

# A total order of order lines within a bar
_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
ASSETS = {"brand": "p_brand", "supplier": "cast(l_suppkey as {text})"}


def panel_sql(d: Dialect, asset: str = "brand", unit: str = "week") -> str:
    """Bars of the order lines; gaps carry the close on with volume 0.

    Before an asset's first bar prices are 0. Columns: time, asset, open, high,
    low, close, vol, is_liquid, t (row number of the asset from 0).
    """
    return _dense(d, _bars(d, asset, unit))


def _bars(d: Dialect, asset: str, unit: str) -> str:
    """The expressions ``lines`` and ``bars``: asset, time, o, h, l, c, v where there are lines."""
    name = ASSETS[asset].format(text="string" if d.spark else "varchar")
    key = f"{d.fun('struct')}({_ORDER})"
    lines = d.table("lineitem")
    joined = f"{lines} join {d.table('part')} on l_partkey = p_partkey" if asset == "brand" else lines
    return f"""lines as (select {name} asset, cast(date_trunc('{unit}', l_shipdate) as date) time, l_extendedprice / l_quantity price, l_quantity q, {key} k from {joined}),
bars as (select asset, time, {d.fun("min_by")}(price, k) o, max(price) h, min(price) l, {d.fun("max_by")}(price, k) c, cast(sum(q) as double) v from lines group by asset, time)"""


def _dense(d: Dialect, bars: str) -> str:
    carry = "last(c, true)" if d.spark else "last_value(c ignore nulls)"
    return f"""(with {bars},
grid as (select a.asset, t.time from (select distinct asset from bars) a cross join (select distinct time from bars) t),
dense as (select g.asset, g.time, o, h, l, c, v, {carry} over (partition by g.asset order by g.time rows between unbounded preceding and current row) p,
  cast(row_number() over (partition by g.asset order by g.time) - 1 as double) t from grid g left join bars b on b.asset = g.asset and b.time = g.time)
select time, asset, coalesce(o, p, 0e0) open, coalesce(h, p, 0e0) high, coalesce(l, p, 0e0) low, coalesce(c, p, 0e0) close, coalesce(v, 0e0) vol,
  case when v > 0 then 1e0 else 0e0 end is_liquid, t from dense)"""


def panel(spark: SparkSession, folder: str, asset: str = "brand", unit: str = "week") -> DataFrame:
    """The panel of :func:`panel_sql` over stored bars: the lines are read once, however often the panel is."""
    d = Dialect("spark", folder)
    bars = stored(spark.sql(f"with {_bars(d, asset, unit)} select * from bars"), "bars")
    return spark.sql(f"select * from {_dense(d, 'bars as (select * from {bars})')}", bars=bars)
