"""Portfolio construction that feeds each date's weights into the next, over the names that can hold a weight.

A book depends on the book of the date before, so it is serial in time. What it
needs of a date are its candidates alone - the names with a seat and the pinned
ones - since every other name's limits are 0. Ranking, smoothing, liquidity and
seats by regime are windows over the whole grid; the recursion then streams over
candidates in order of time and carries one book from batch to batch, so a task
holds a batch and a book, never a grid of dates and names. Budgets and the final
projection are aggregates and per-date maps again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dsl
from .sleeves import drawdown

EPS = 1e-12


def capped_simplex(v: np.ndarray, total: float, lo: np.ndarray, hi: np.ndarray, rounds: int = 60, times: np.ndarray | None = None) -> np.ndarray:
    """The nearest point to ``v`` with sum ``total`` and lo <= w <= hi; ``lo`` or ``hi`` itself where no such point exists.

    The shift that makes the clipped sum right is found by halving an interval
    ``rounds`` times; what is left over goes to the coordinates within their limits.
    ``times``: how many equal coordinates each one stands for.
    """
    n = np.ones(len(v)) if times is None else times
    room = np.maximum(hi - lo, 0)
    need = total - (n * lo).sum()
    if need <= EPS:
        return lo.astype(float)
    if need >= (n * room).sum() - EPS:
        return lo + room
    above = v - lo
    some = n > 0
    low, high = (above - room)[some].min(), above[some].max()
    for _ in range(rounds):
        middle = (low + high) / 2
        if (n * np.clip(above - middle, 0, room)).sum() > need:
            low = middle
        else:
            high = middle
    w = lo + np.clip(above - (low + high) / 2, 0, room)
    free = (w > lo + EPS) & (w < hi - EPS) & some
    left = total - (n * w).sum()
    if abs(left) > 1e-10 and free.any():
        w[free] += left / n[free].sum()
        w = np.clip(w, lo, hi)
    return w


def softmax_tilt(w: np.ndarray, score: np.ndarray, chosen: np.ndarray, alpha: float, limit: float = 3.0) -> np.ndarray:
    """Weights of the chosen names times exp(alpha z), summing to 1; alpha 0 only normalises."""
    out = np.zeros_like(w)
    if not chosen.any():
        return out
    part = w[chosen]
    if alpha:
        s = score[chosen]
        part = part * np.exp(alpha * np.clip((s - s.mean()) / (s.std() + EPS), -limit, limit))
    out[chosen] = part / (part.sum() + EPS)
    return out


@dataclass(frozen=True)
class Gate:
    """A book is kept where ``benefit`` times the spread of scores is below the cost of the trade: turnover at ``bps``."""

    bps: float = 10.0
    benefit: float = 1.0

    def trades(self, before: np.ndarray, after: np.ndarray, spread: float) -> bool:
        return self.benefit * spread >= np.abs(after - before).sum() * self.bps / 1e4


@dataclass(frozen=True)
class Rules:
    """Seats, limits and smoothing; ``shorts`` 0 is a long-only book. ``split``: a fixed share of longs, or by the sides' score mass.

    ``longs_volatile`` and ``vol_volatile`` hold on dates that the regime calls
    volatile (seats of a long-only book alone). ``lever`` False keeps the gross at
    ``gross``. ``pins`` are names that always have a seat. ``equal`` gives the
    first ``longs`` names with a positive score one weight.
    """

    longs: int = 20
    shorts: int = 0
    max_pos: float = 0.10
    min_pos: float = 0.002
    smooth: int = 3
    blend: float = 0.30
    tilt: float = 0.85
    split: str = "prop_mass"
    long_share: float = 0.60
    target_vol: float = 0.15
    lev_cap: float = 1.5
    lev_min: float = 0.3
    decay: float = 0.95
    drawdown_rows: int = 252
    longs_volatile: int | None = None
    vol_volatile: float | None = None
    stretch: float = 0.60
    floor: float = 0.50
    gross: float = 1.0
    lever: bool = True
    pins: tuple[str, ...] = ()
    gate: Gate | None = None
    equal: bool = False


def _spread(s: np.ndarray, chosen: np.ndarray, mass: float) -> np.ndarray:
    """Mass by how far a score is above the least chosen one."""
    out = np.zeros(len(s))
    if chosen.any():
        x = s[chosen] - s[chosen].min() + 1e-6
        out[chosen] = x / (x.sum() + EPS) * mass
    return out


def next_book(s: np.ndarray, long: np.ndarray, short: np.ndarray, before: np.ndarray, rules: Rules, spread: float | None = None, first: bool = False) -> np.ndarray:
    """Weights of one date from the candidates' scores, their sides and the weights before.

    Names without a side have 0 limits. ``spread`` is the deviation of scores that
    the gate of a book with shorts looks at (that of all names).
    """
    lo, hi = np.where(long, rules.min_pos, 0.0), np.where(long, rules.max_pos, 0.0)
    gate = None if first else rules.gate
    if not rules.shorts:
        unit = capped_simplex(softmax_tilt(_spread(s, long, 1.0), s, long, rules.tilt), 1.0, lo, hi)
        if gate and not gate.trades(before, unit, float(s[long].std()) if long.any() else 0.0):
            return capped_simplex(before, 1.0, lo, hi)
        mixed = softmax_tilt(rules.blend * unit + (1 - rules.blend) * before, s, long, rules.tilt / 2)
        return capped_simplex(mixed, 1.0, lo, hi)
    if rules.split == "fixed":
        up = min(max(rules.long_share, 0.0), 1.0)
    else:
        a, b = np.abs(s[long]).sum(), np.abs(s[short]).sum()
        up = a / (a + b + EPS)
    slo, shi = np.where(short, rules.min_pos, 0.0), np.where(short, rules.max_pos, 0.0)
    top = _spread(s, long, up) if up > 0 else np.zeros(len(s))
    bottom = _spread(-s, short, 1 - up) if up < 1 else np.zeros(len(s))
    target = top - bottom
    if rules.tilt > 0:
        if up > 0:
            target = np.where(long, softmax_tilt(np.abs(top), s, long, rules.tilt) * up, target)
        if up < 1:
            target = np.where(short, -softmax_tilt(np.abs(bottom), -s, short, rules.tilt) * (1 - up), target)
    sides = lambda w: capped_simplex(np.maximum(w, 0), up, lo, hi) - capped_simplex(np.maximum(-w, 0), 1 - up, slo, shi)
    unit = sides(target)
    if gate and not gate.trades(before, unit, spread or 0.0):
        return before.copy()
    return sides(rules.blend * unit + (1 - rules.blend) * before)


_BY_DATE = ("strategy", "time")


def candidates(scores: DataFrame, rules: Rules, regime: DataFrame | None = None) -> DataFrame:
    """(strategy, time, asset, s, long, short, spread): names with a seat on a date.

    ``scores``: (strategy, time, asset, score) and, where liquidity counts, a column
    ``liquidity`` that multiplies the smoothed score. Missing and NaN values are 0.
    ``regime``: (time, and any of volatile boolean, seats int). Ties in score go by name.
    """
    zero = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    past = Window.partitionBy("strategy", "asset").orderBy("time").rowsBetween(-(max(rules.smooth, 1) - 1), 0)
    s = F.avg(zero("score")).over(past)
    if "liquidity" in scores.columns:
        s = s * zero("liquidity")
    df = scores.withColumn("s", s).select("strategy", "time", "asset", "s")
    seats = F.lit(rules.longs)
    if regime is not None:
        has = regime.columns
        quiet = F.when(F.col("volatile"), F.lit(rules.longs if rules.longs_volatile is None else rules.longs_volatile)).otherwise(rules.longs) if "volatile" in has else F.lit(rules.longs)
        if not rules.shorts:
            seats = F.coalesce("seats", quiet) if "seats" in has else quiet
        df = df.join(regime.select("time", *(c for c in ("volatile", "seats") if c in has)), "time", "left")
    date = Window.partitionBy(*_BY_DATE)
    up, down = F.row_number().over(date.orderBy(F.desc("s"), "asset")), F.row_number().over(date.orderBy("s", F.desc("asset")))
    pinned = F.col("asset").isin(*rules.pins) if rules.pins else F.lit(False)
    df = df.select(*_BY_DATE, "asset", "s", F.stddev_pop("s").over(date).alias("spread"), (F.coalesce(up <= seats, F.lit(False)) | pinned).alias("long"), (down <= rules.shorts).alias("short"), pinned.alias("pinned"), up.alias("up"))
    return df.filter("long or short")


def _dates(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, object, pd.DataFrame]]:
    """Whole dates from batches in order of strategy and time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        whole = pd.concat([*held, batch], ignore_index=True) if held else batch.reset_index(drop=True)
        same = (whole["strategy"].shift() == whole["strategy"]) & (whole["time"].shift() == whole["time"])
        starts = np.flatnonzero(~same.to_numpy())
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            part = whole.iloc[a:b]
            yield part["strategy"].iat[0], part["time"].iat[0], part
        held = [whole.iloc[starts[-1] :]]
    if held:
        yield held[0]["strategy"].iat[0], held[0]["time"].iat[0], held[0]


def unit_book(chosen: DataFrame, rules: Rules) -> DataFrame:
    """(strategy, time, asset, u): weights of gross 1, each date blended with the one before; names without a weight are left out."""
    if rules.equal:
        by = Window.partitionBy(*_BY_DATE).orderBy(F.desc("pinned"), "up")  # pinned names come first, then by score
        held = chosen.withColumn("k", F.row_number().over(by)).filter(F.col("k") <= rules.longs)
        return held.select(*_BY_DATE, "asset", (1.0 / F.count(F.lit(1)).over(Window.partitionBy(*_BY_DATE))).alias("u"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, {}
        out: list[pd.DataFrame] = []
        rows = 0
        for strategy, time, part in _dates(batches):
            first = strategy != last
            if first:
                last, held = strategy, {}
            names = part["asset"].tolist()
            others = [a for a in held if a not in set(names)]
            all_names = [*names, *others]
            none = np.zeros(len(others))
            before = np.array([held.get(a, 0.0) for a in all_names])
            s = np.concatenate([part["s"].to_numpy(float), none])
            long, short = (np.concatenate([part[c].to_numpy(bool), none > 0]) for c in ("long", "short"))
            w = next_book(s, long, short, before, rules, float(part["spread"].iat[0]), first)
            held = {a: x for a, x in zip(all_names, w.tolist(), strict=True) if x}
            out.append(pd.DataFrame({"strategy": strategy, "time": time, "asset": list(held), "u": list(held.values())}))
            rows += len(held)
            if rows > 10_000:
                yield pd.concat(out, ignore_index=True)
                out, rows = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    kind = dict(chosen.dtypes)
    # a strategy's dates are one stream: they follow from each other
    ordered = chosen.repartition("strategy").sortWithinPartitions("strategy", "time", "asset")
    return ordered.select(*_BY_DATE, "asset", "s", "long", "short", "spread").mapInPandas(run, f"strategy string, time {kind['time']}, asset string, u double")


def budgets(unit: DataFrame, dates: DataFrame, returns: DataFrame, rules: Rules, regime: DataFrame | None = None) -> DataFrame:
    """(strategy, time, budget): target volatility over the book's smoothed one, throttled by the market's drawdown, times the regime's leverage.

    ``dates``: (strategy, time) of every date; ``returns``: (time, asset, ret).
    ``regime``: (time, and any of volatile boolean, target_vol double, leverage double).
    """
    if not rules.lever:
        return dates.select("strategy", "time", F.lit(float(rules.gross)).alias("budget"))
    order = Window.orderBy("time")  # a row per date
    throttle = F.greatest(F.least(1 - rules.stretch * F.col("fall"), F.lit(1.0)), F.lit(rules.floor))
    market = drawdown(returns, rules.drawdown_rows).select("time", throttle.alias("throttle"), F.lead("time").over(order).alias("next"))
    # a date's weights earn the next date's returns
    earned = unit.join(market.select("time", "next"), "time").select("strategy", F.col("next").alias("time"), "asset", F.abs("u").alias("u")).join(returns, ["time", "asset"])
    earned = earned.groupBy("strategy", "time").agg(F.sum(F.col("u") * F.coalesce("ret", F.lit(0.0))).alias("r"))
    series = dates.join(earned, ["strategy", "time"], "left").select(F.col("strategy").alias("asset"), "time", F.coalesce("r", F.lit(0.0)).alias("r"), (F.row_number().over(Window.partitionBy("strategy").orderBy("time")) - 1).cast("double").alias("t"))
    vol = dsl.fn("sqrt", dsl.decayed(dsl.col("r") * dsl.col("r") * (1 - rules.decay), rules.decay)) * 252.0**0.5
    out = dsl.compute(series, {"vol": vol}).withColumnRenamed("asset", "strategy").join(market.select("time", "throttle"), "time")
    target, lever = F.lit(rules.target_vol), F.lit(1.0)
    if regime is not None:
        has = regime.columns
        if "volatile" in has and rules.vol_volatile is not None:
            target = F.when(F.col("volatile"), rules.vol_volatile).otherwise(target)
        if "target_vol" in has:
            target = F.coalesce("target_vol", target)
        if "leverage" in has:
            lever = F.coalesce("leverage", lever)
        out = out.join(regime.select("time", *(c for c in ("volatile", "target_vol", "leverage") if c in has)), "time", "left")
    within = lambda x: F.greatest(F.least(x, F.lit(rules.lev_cap)), F.lit(rules.lev_min))
    return out.select("strategy", "time", (within(within(target / (F.col("vol") + 1e-8)) * F.col("throttle") * lever) * rules.gross).alias("budget"))


def final_book(unit: DataFrame, budget: DataFrame, cells: DataFrame, rules: Rules) -> DataFrame:
    """(strategy, time, asset, w, budget) for every one of ``cells`` (strategy, time, asset).

    A long-only book is projected onto its budget with no name above ``max_pos``;
    what the limits leave over falls on all names alike, which one number a date holds.
    """
    sized = cells.groupBy(*_BY_DATE).agg(F.count(F.lit(1)).alias("names")).join(budget, list(_BY_DATE))
    if rules.shorts or rules.equal:
        out = cells.join(sized, list(_BY_DATE)).join(unit, [*_BY_DATE, "asset"], "left")
        return out.select(*_BY_DATE, "asset", (F.coalesce("u", F.lit(0.0)) * F.col("budget")).alias("w"), "budget")
    kind = dict(cells.dtypes)["time"]
    held = unit.groupBy(*_BY_DATE).agg(F.collect_list(F.struct("asset", "u")).alias("held"))  # as many as have seats

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rest, books = [], []
            for names, budget, held in zip(b["names"], b["budget"], b["held"], strict=True):
                held = [] if held is None else list(held)
                v = np.array([*(h["u"] * budget for h in held), 0.0])
                times = np.array([*np.ones(len(held)), names - len(held)], float)
                w = capped_simplex(v, budget, np.zeros(len(v)), np.full(len(v), rules.max_pos), times=times)
                rest.append(float(w[-1]) if names > len(held) else 0.0)
                books.append([{"asset": h["asset"], "w": x} for h, x in zip(held, w.tolist(), strict=False)])
            yield pd.DataFrame({"strategy": b["strategy"], "time": b["time"], "budget": b["budget"], "rest": rest, "book": books})

    dates = sized.join(held, list(_BY_DATE), "left").mapInPandas(project, f"strategy string, time {kind}, budget double, rest double, book array<struct<asset:string,w:double>>")
    # one pass over the books for both: the names held, and the rest of every date
    weights = dates.select(*_BY_DATE, F.explode_outer(F.concat(F.col("book"), F.array(F.struct(F.lit(None).cast("string").alias("asset"), F.col("rest").alias("w"))))).alias("x"), "budget").select(*_BY_DATE, "x.asset", "x.w", "budget")
    rest = weights.filter("asset is null").select(*_BY_DATE, F.col("w").alias("rest"), "budget")
    out = cells.join(rest, list(_BY_DATE)).join(weights.filter("asset is not null").drop("budget"), [*_BY_DATE, "asset"], "left")
    return out.select(*_BY_DATE, "asset", F.coalesce("w", "rest").alias("w"), "budget")


def build(scores: DataFrame, rules: dict[str, Rules], regime: DataFrame | None = None) -> DataFrame:
    """(strategy, time, asset, w, budget) from (strategy, time, asset, score, ret[, liquidity]).

    Null and NaN scores and returns count as 0; rows that repeat a key count once
    (the least); strategies without rules and an empty table give no rows. ``scores``
    is read several times: pass a stored table.
    """
    more = ["liquidity"] if "liquidity" in scores.columns else []
    cells = scores.groupBy(*_BY_DATE, "asset").agg(*(F.min(c).alias(c) for c in ("score", "ret", *more)))
    parts = []
    for same in dict.fromkeys(rules.values()):
        names = [k for k, r in rules.items() if r == same]
        mine = cells.filter(F.col("strategy").isin(*names))
        unit = unit_book(candidates(mine, same, regime), same)
        # strategies of one call look at one market; each has its own rows of it
        keys = mine.select(*_BY_DATE, "asset")
        returns = mine.groupBy("time", "asset").agg(F.max(F.nanvl("ret", F.lit(0.0))).alias("ret"))
        budget = budgets(unit, mine.select(*_BY_DATE).distinct(), returns, same, regime)
        parts.append(final_book(unit, budget, keys, same))
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Overlay:
    """Limits of :func:`overlay`: a name's volatility against its target, and the market's drawdown."""

    vol_rows: int = 63
    target_vol: float = 0.16
    max_vol: float = 0.22
    drawdown_rows: int = 126
    stretch: float = 0.60
    floor: float = 0.55
    least: float = 0.5
    most: float = 1.25


def overlay(returns: DataFrame, rule: Overlay = Overlay()) -> DataFrame:
    """(time, asset, scale) from (time, asset, ret): target over realised volatility, cut to target / max_vol beyond max_vol, times the throttle by drawdown."""
    past = Window.partitionBy("asset").orderBy("time").rowsBetween(-(rule.vol_rows - 1), 0)
    vol = F.coalesce(F.stddev_pop("ret").over(past), F.lit(0.0)) * 252.0**0.5 + EPS
    within = lambda x, lo: F.greatest(F.least(x, F.lit(rule.most)), F.lit(lo))
    scale = F.when(vol <= rule.max_vol, within(rule.target_vol / vol, rule.least)).otherwise(rule.target_vol / (rule.max_vol + EPS))
    throttle = within(1 - rule.stretch * F.col("fall"), rule.floor)
    both = returns.withColumn("scale", scale).join(drawdown(returns, rule.drawdown_rows), "time")
    return both.select("time", "asset", within(F.col("scale") * throttle, rule.least).alias("scale"))


def overlaid(book: DataFrame, scales: DataFrame) -> DataFrame:
    """A book (strategy, time, asset, w, budget) with weights times their scales, and budgets times the date's mean scale."""
    mean = F.avg("scale").over(Window.partitionBy(*_BY_DATE))
    return book.join(scales, ["time", "asset"], "left").select(*_BY_DATE, "asset", F.coalesce(F.col("w") * F.col("scale"), F.lit(0.0)).alias("w"), (F.col("budget") * F.coalesce(mean, F.lit(0.0))).alias("budget"))
