"""As-of joins: for every row of one table the latest row of another at or before its time, by key.

Both tables are laid one after the other and a window takes the last row of the
right side so far; nothing meets in pairs. A key's time is cut into spans, so a
key that holds a large share of all rows is many groups; what a span starts with
is the last right row of the spans before, found on one row per key and span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPANS = 64  # that the time of all rows is cut into


def _span(at: Column, low: float, high: float, spans: int) -> Column:
    width = (high - low) / spans or 1.0
    return F.least(F.greatest(F.floor((at - low) / width), F.lit(0)), F.lit(spans - 1)).cast("int")


def _number(column: Column) -> Column:
    """A time or number as a double, for cutting only."""
    return column.cast("timestamp").cast("double")


def asof_join(left: DataFrame, right: DataFrame, on: str = "time", by: tuple[str, ...] = ("asset",), right_on: str | None = None, within: Column | None = None, strict: bool = False, forward: bool = False, spans: int = SPANS) -> DataFrame:
    """``left`` with ``right_<on>`` and the other columns of ``right``: those of its latest row of equal ``by`` at or before ``on``; null where there is none.

    ``strict`` looks before ``on`` only; ``forward`` takes the earliest row at or
    after (after) instead. ``within``: a condition on the joined columns (tolerance,
    end of an interval), beyond which the right columns are null. ``right_on``: the
    right side's time column (default ``on``), a date, timestamp or number like the
    left's. Every left row stays once. Of right rows with one key and time the one
    with the greatest values wins. Null keys and times match nothing. Names in both
    tables other than keys and times are an error.
    """
    right_on = right_on or on
    values = [c for c in right.columns if c not in (*by, right_on)]
    clash = {*values, f"right_{on}"} & set(left.columns)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    number = (lambda c: F.col(c).cast("double")) if dict(left.dtypes)[on] in ("int", "bigint", "double", "float", "smallint", "tinyint") else (lambda c: _number(F.col(c)))
    usable = lambda df, at: df.filter(" and ".join(f"`{c}` is not null" for c in (*by, at)))
    good = usable(left, on)
    limits = usable(right, right_on).agg(F.min(number(right_on)), F.max(number(right_on))).first()
    low, high = (0.0, 0.0) if limits[0] is None else (float(limits[0]), float(limits[1]))
    span = lambda c: _span(number(c), low, high, spans)
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(by)]
    names = [f"k{i}" for i in range(len(by))]
    row = F.struct(F.col(right_on).alias("at"), F.struct(*values).alias("values")) if values else F.struct(F.col(right_on).alias("at"), F.struct(F.lit(0)).alias("values"))
    # one right row a time: the greatest values
    hits = usable(right, right_on).select(*keys, F.col(right_on).alias("t"), span(right_on).alias("span"), row.alias("hit")).groupBy(*names, "t", "span").agg(F.max("hit").alias("hit"))
    asks = good.select(*keys, F.col(on).alias("t"), span(on).alias("span"), F.struct(*left.columns).alias("row"))
    first = strict != forward  # of equal times, a left row goes before the right one where that must not count
    side = lambda df, left_side: df.withColumn("side", F.lit(0 if left_side == first else 1))
    both = side(asks, True).unionByName(side(hits, False), allowMissingColumns=True)
    order = [F.desc("t"), F.desc("side")] if forward else [F.col("t"), F.col("side")]
    inside = Window.partitionBy(*names, "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("here", F.last("hit", True).over(inside)).filter("row is not null")
    # what a span starts with: the best of the spans before it (behind it), on a row per key and span
    ends = hits.groupBy(*names, "span").agg((F.min("hit") if forward else F.max("hit")).alias("edge"))
    needed = asks.select(*names, "span").distinct().join(ends, [*names, "span"], "full")
    earlier = Window.partitionBy(*names).orderBy(F.desc("span") if forward else F.col("span")).rowsBetween(Window.unboundedPreceding, -1)
    carried = needed.select(*names, "span", F.last("edge", True).over(earlier).alias("carried"))
    out = found.join(carried, [*names, "span"], "left").select("row", F.coalesce("here", "carried").alias("hit"))
    rest = left.filter(" or ".join(f"`{c}` is null" for c in (*by, on))).select(F.struct(*left.columns).alias("row"), F.lit(None).cast(out.schema["hit"].dataType).alias("hit"))
    out = out.union(rest).select("row.*", F.col("hit.at").alias(f"right_{on}"), *(F.col(f"hit.values.{c}").alias(c) for c in values))
    if within is None:
        return out
    keep = F.coalesce(within, F.lit(False))
    return out.select(*left.columns, *(F.when(keep, F.col(c)).alias(c) for c in (f"right_{on}", *values)))


def members_at(rows: DataFrame, membership: DataFrame, on: str = "time", by: tuple[str, ...] = ("asset",), start: str = "start", end: str = "end") -> DataFrame:
    """Rows whose key is a member at their time: ``membership`` (by.., start, end, ..) holds disjoint intervals [start, end), an open end is null."""
    inside = F.col(f"right_{on}").isNotNull() & (F.col(end).isNull() | (F.col(on) < F.col(end)))
    joined = asof_join(rows, membership, on, by, right_on=start, within=inside)
    return joined.filter(f"right_{on} is not null").withColumnRenamed(f"right_{on}", start)
