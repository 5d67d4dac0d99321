"""Strategies as configurations of one pipeline: factors, weights by information coefficient, construction, overlay, diagnostics."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dsl
from ..functions import factors as X
from ..operators import sleeves as V
from ..operators.construct import Overlay, Rules, build, overlaid, overlay
from ..shared import drop_stored, stored
from .panel import panel


@dataclass(frozen=True)
class Strategy:
    """``factors`` are weighted by ``weighting`` against the return of ``horizon`` bars; with ``sleeves`` each sleeve has factors and horizons of its own and ``allocation`` weighs the sleeves."""

    name: str
    factors: tuple[str, ...]
    rules: Rules
    weighting: V.Weighting = V.Weighting(clip=0.20, penalty=0.0, least_weight=0.0)
    cost_bps: float = 10.0
    horizon: int = 21
    windows: X.Windows = field(default_factory=X.Windows)
    sleeves: tuple[V.Sleeve, ...] = ()
    allocation: V.Allocation = V.Allocation()
    overlay: Overlay | None = None


# Windows, factor lists, seats, limits and rates of the strategies.
_FAST = X.Windows(beta=126, idio=42, down=42, corr=42, ema_fast=12, ema_slow=26, atr=14)
_COMPOSER = replace(_FAST, mom=63, sector=42, value=252)
_WIDE = X.Windows(beta=126, idio=52, down=52, corr=52, ema_fast=16, ema_slow=42, atr=28, sector=63, value=240)

MOMENTUM_SLEEVE = V.Sleeve(
    "momentum",
    ("breakout", "calm_flow", "cross_momentum", "hloc_close_position", "lrev", "ma_cloud", "momentum_acceleration", "mtf_ic_momentum", "prox_52w_high", "rel_sector_mom", "resid_mom", "resid_mom_long", "resid_mom_mix", "resid_mom_short", "slope", "srev", "trend_consistency", "vol_breakout", "vol_surprise"),
    (21, 63),
    -0.60,
)
REVERSION_SLEEVE = V.Sleeve(
    "reversion",
    ("disposition_alpha", "lrev", "mean_reversion_speed", "ou_equilibrium_dist", "ou_halflife_signal", "ou_momentum_blend", "ou_predicted_return", "ou_regime_indicator", "ou_reversion_strength", "ou_zscore_med", "ou_zscore_short", "srev"),
    (5, 21),
    0.40,
)
FLOW_SLEEVE = V.Sleeve(
    "flow",
    ("amihud_inv", "efficiency_ratio", "glft_flow_toxicity", "glft_impact_asymmetry", "glft_inventory_risk_prem", "glft_inventory_signal", "glft_mm_edge", "glft_ofi_med", "glft_ofi_momentum", "glft_ofi_short", "glft_spread_adjusted_mom", "glft_toxic_momentum", "information_flow", "liquidity_momentum", "micro_noise"),
    (5, 21),
    0.20,
)
DEFENSIVE_SLEEVE = V.Sleeve(
    "defensive",
    ("amihud_inv", "beta_stability", "idio_jump_freq", "idio_tail_risk", "inv_down", "inv_idio", "inv_vol", "kurtosis_factor", "liquidity", "low_beta", "low_corr", "micro_noise", "mtf_alignment", "quality_defensive", "quality_score", "regime_momentum", "skewness_factor", "value_mom", "value_score", "vol_of_vol"),
    (21,),
    0.80,
)
_SLEEVES = (MOMENTUM_SLEEVE, REVERSION_SLEEVE, FLOW_SLEEVE, DEFENSIVE_SLEEVE)

STRATEGIES = {
    s.name: s
    for s in (
        Strategy("exchange_24", X.V4_24, Rules(longs=20, longs_volatile=15, max_pos=0.10, min_pos=0.002, target_vol=0.15, vol_volatile=0.20, lev_cap=1.5, lev_min=0.3, blend=0.30, smooth=3, tilt=0.85, stretch=0.60, floor=0.50, drawdown_rows=252)),
        Strategy(
            "hybrid_11",
            ("inv_vol", "inv_idio", "inv_down", "low_corr", "low_beta", "liquidity", "resid_mom", "srev", "breakout", "slope", "calm_flow"),
            Rules(longs=11, max_pos=0.10, min_pos=0.002, target_vol=0.25, lev_cap=1.5, lev_min=0.3, blend=0.30, smooth=3, tilt=0.90, stretch=0.60, floor=0.50, drawdown_rows=252),
            V.Weighting(decay=0.93, clip=0.20, penalty=0.0, least_weight=0.0),
            cost_bps=2.0,
        ),
        Strategy(
            "composer_32",
            ("inv_vol", "inv_idio", "inv_down", "low_corr", "low_beta", "liquidity", "amihud_inv", "beta_stability", "resid_mom", "resid_mom_short", "resid_mom_long", "resid_mom_mix", "srev", "lrev", "rel_sector_mom", "breakout", "prox_52w_high", "slope", "ma_cloud", "vol_breakout", "calm_flow", "vol_surprise", "idio_tail_risk", "idio_jump_freq", "micro_noise", "value_mom", "quality_defensive", "quality_score", "value_score", "cross_momentum", "cross_volatility", "cross_liquidity"),
            Rules(longs=25, longs_volatile=20, max_pos=0.08, min_pos=0.001, target_vol=0.18, vol_volatile=0.22, lev_cap=1.6, lev_min=0.4, blend=0.35, smooth=5, tilt=0.90, stretch=0.70, floor=0.45, drawdown_rows=126),
            V.Weighting(decay=0.94, clip=0.25, penalty=0.0, least_weight=0.01),
            cost_bps=5.0,
            windows=_COMPOSER,
        ),
        Strategy(
            "composer_36",
            ("inv_vol", "inv_idio", "inv_down", "low_corr", "low_beta", "liquidity", "amihud_inv", "beta_stability", "idio_tail_risk", "resid_mom", "resid_mom_short", "resid_mom_long", "resid_mom_mix", "srev", "lrev", "rel_sector_mom", "cross_momentum", "mtf_ic_momentum", "breakout", "prox_52w_high", "slope", "ma_cloud", "vol_breakout", "calm_flow", "hloc_close_position", "vol_surprise", "idio_jump_freq", "micro_noise", "vol_of_vol", "value_mom", "quality_defensive", "quality_score", "value_score", "efficiency_ratio", "attention_momentum", "momentum_quality_ratio"),
            Rules(longs=18, shorts=6, max_pos=0.10, min_pos=0.001, target_vol=0.20, vol_volatile=0.18, lev_cap=1.7, lev_min=0.5, blend=0.40, smooth=5, tilt=0.92, stretch=0.75, floor=0.50, drawdown_rows=126),
            V.Weighting(decay=0.96, clip=0.30, penalty=0.0, least_weight=0.015, boost=0.1),
            cost_bps=8.0,
            windows=_COMPOSER,
        ),
        Strategy(
            "behaviour_32",
            (*X.NEURAL, "inv_vol", "inv_idio", "low_beta", "resid_mom", "resid_mom_mix", "mtf_ic_momentum", "srev", "lrev", "breakout", "slope", "ma_cloud", "liquidity", "amihud_inv", "idio_tail_risk", "beta_stability", "mtf_alignment", "hloc_close_position"),
            Rules(longs=12, shorts=8, max_pos=0.12, min_pos=0.003, target_vol=0.18, vol_volatile=0.12, lev_cap=1.8, lev_min=0.4, blend=0.35, smooth=3, tilt=0.90, stretch=0.65, floor=0.45, drawdown_rows=252),
            V.Weighting(decay=0.94, clip=0.20, penalty=0.0, least_weight=0.0),
        ),
        Strategy(
            "behaviour_40",
            (*X.NEURAL, "inv_vol", "inv_idio", "inv_down", "low_corr", "low_beta", "liquidity", "amihud_inv", "beta_stability", "resid_mom", "resid_mom_short", "resid_mom_long", "resid_mom_mix", "srev", "lrev", "mtf_ic_momentum", "trend_consistency", "breakout", "slope", "ma_cloud", "prox_52w_high", "hloc_close_position", "calm_flow", "value_mom", "quality_defensive", "quality_score"),
            Rules(longs=14, shorts=6, max_pos=0.09, min_pos=0.002, target_vol=0.16, vol_volatile=0.12, lev_cap=1.65, lev_min=0.45, blend=0.38, smooth=4, tilt=0.88, stretch=0.70, floor=0.50, drawdown_rows=126),
            cost_bps=8.0,
            windows=_WIDE,
        ),
        Strategy(
            "defensive_38",
            ("inv_vol", "inv_idio", "inv_down", "low_corr", "low_beta", "liquidity", "amihud_inv", "beta_stability", "micro_noise", "idio_tail_risk", "resid_mom", "resid_mom_short", "resid_mom_long", "resid_mom_mix", "mtf_alignment", "mtf_alignment_strength", "trend_consistency", "momentum_acceleration", "mtf_ic_momentum", "ret_1m", "ret_1q", "ret_2_12m", "srev", "breakout", "slope", "ma_cloud", "vol_breakout", "calm_flow", "prox_52w_high", "hloc_range_expansion", "hloc_close_position", "value_mom", "quality_defensive", "quality_score", "value_score", "rel_sector_mom", "cross_liquidity", "cross_volatility"),
            Rules(longs=28, longs_volatile=22, max_pos=0.07, min_pos=0.0015, target_vol=0.16, vol_volatile=0.18, lev_cap=1.60, lev_min=0.40, blend=0.32, smooth=5, tilt=0.92, stretch=0.65, floor=0.55, drawdown_rows=126),
            V.Weighting(decay=0.94, clip=0.20, penalty=0.35, least_diversity=0.25, least_weight=0.0),
            cost_bps=6.0,
            windows=replace(_FAST, ema_fast=16, ema_slow=48, atr=28, sector=63, value=240),
            overlay=Overlay(vol_rows=63, target_vol=0.16, max_vol=0.22, drawdown_rows=126, stretch=0.65, floor=0.55),
        ),
        Strategy(
            "sleeves",
            tuple(sorted({f for s in _SLEEVES for f in s.factors})),
            Rules(longs=16, shorts=6, max_pos=0.08, min_pos=0.0015, target_vol=0.15, vol_volatile=0.11, lev_cap=1.55, lev_min=0.40, blend=0.34, smooth=4, tilt=0.88, stretch=0.70, floor=0.50, drawdown_rows=126),
            V.Weighting(decay=0.95, clip=0.25, penalty=0.30, least_diversity=0.25, least_weight=0.012),
            cost_bps=8.0,
            windows=_WIDE,
            sleeves=_SLEEVES,
            allocation=V.Allocation(horizon=21, decay=0.94, penalty=0.35, least_diversity=0.25, least_weight=0.12, drawdown_rows=126, full_stress=0.10),
            overlay=Overlay(vol_rows=63, target_vol=0.15, max_vol=0.22, drawdown_rows=126, stretch=0.70, floor=0.50),
        ),
        Strategy(
            "reversion_24",
            (*X.OU, "srev", "lrev", "inv_vol", "inv_idio", "inv_down", "low_beta", "liquidity", "amihud_inv", "resid_mom", "resid_mom_mix", "breakout", "slope", "ma_cloud", "calm_flow", "beta_stability", "quality_defensive"),
            Rules(longs=15, shorts=10, max_pos=0.08, min_pos=0.002, target_vol=0.14, vol_volatile=0.10, lev_cap=1.5, lev_min=0.4, blend=0.25, smooth=3, tilt=0.80, stretch=0.65, floor=0.50, drawdown_rows=126),
            V.Weighting(decay=0.94, clip=0.20, penalty=0.0, least_weight=0.0),
            cost_bps=8.0,
            windows=_FAST,
        ),
        Strategy(
            "flow_25",
            (*X.GLFT, "liquidity", "amihud_inv", "inv_vol", "inv_idio", "inv_down", "low_beta", "resid_mom", "resid_mom_mix", "srev", "breakout", "slope", "calm_flow", "vol_breakout", "beta_stability", "micro_noise"),
            Rules(longs=16, shorts=8, max_pos=0.08, min_pos=0.002, target_vol=0.15, vol_volatile=0.11, lev_cap=1.55, lev_min=0.40, blend=0.28, smooth=3, tilt=0.85, stretch=0.68, floor=0.48, drawdown_rows=126),
            V.Weighting(decay=0.94, clip=0.20, penalty=0.0, least_weight=0.0),
            cost_bps=6.0,
            windows=_FAST,
        ),
        Strategy(
            "flow_30",
            (*X.GLFT, *X.GLFT_2, "liquidity", "amihud_inv", "inv_vol", "inv_idio", "inv_down", "low_beta", "resid_mom", "resid_mom_mix", "srev", "lrev", "breakout", "slope", "calm_flow", "vol_breakout"),
            Rules(longs=14, shorts=10, max_pos=0.085, min_pos=0.003, target_vol=0.16, vol_volatile=0.12, lev_cap=1.6, lev_min=0.35, blend=0.30, smooth=3, tilt=0.88, stretch=0.70, floor=0.45, drawdown_rows=126),
            cost_bps=5.5,
            windows=replace(_FAST, vpin=42, inventory_decay=0.94),
        ),
        Strategy(
            "flow_40",
            (*X.GLFT, *X.GLFT_2, *X.GLFT_3, "liquidity", "amihud_inv", "inv_vol", "inv_idio", "inv_down", "low_beta", "low_corr", "resid_mom", "resid_mom_mix", "srev", "lrev", "breakout", "slope", "calm_flow", "beta_stability", "quality_defensive"),
            Rules(longs=12, shorts=8, max_pos=0.075, min_pos=0.004, target_vol=0.13, vol_volatile=0.09, lev_cap=1.45, lev_min=0.40, blend=0.32, smooth=3, tilt=0.90, stretch=0.75, floor=0.50, drawdown_rows=126),
            V.Weighting(decay=0.96, clip=0.20, penalty=0.0, least_weight=0.0),
            cost_bps=5.0,
            windows=replace(_FAST, vpin=42, inventory_decay=0.94),
        ),
    )
}


def register(strategy: Strategy) -> Strategy:
    STRATEGIES[strategy.name] = strategy
    return strategy


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(s.name, len(s.factors), s.rules.longs, s.rules.shorts, s.rules.max_pos, s.rules.target_vol, s.rules.lev_cap, float(s.cost_bps), s.weighting.decay) for s in STRATEGIES.values()]
    return spark.createDataFrame(rows, "strategy string, factors int, longs int, shorts int, max_pos double, target_vol double, lev_cap double, cost_bps double, decay double")


def factor_table(bars: DataFrame, s: Strategy) -> DataFrame:
    """(time, asset, a column per factor, ret, liquidity, fwd_<h> of every horizon) of a panel, stored: what the strategy's later steps read."""
    known = X.registry(s.windows)
    b = X.Base(s.windows)
    horizons = sorted({s.horizon, s.allocation.horizon, *(h for v in s.sleeves for h in v.horizons)})
    fwd = {f"fwd_{h}": dsl.nz(dsl.fn("exp", dsl.fwd("sum", h, dsl.fn("ln", 1 + b.ret))) - 1) for h in horizons}
    out = {**X.scored({f: known[f][1] for f in s.factors}), **fwd, "ret": b.ret, "liquidity": dsl.col("is_liquid")}
    return stored(dsl.compute(bars, out), "factors")


def sleeve_table(table: DataFrame, s: Strategy) -> tuple[DataFrame, DataFrame]:
    """(scores: time, sleeve, asset, score; weights: time, sleeve, w) of a strategy's factor table; without sleeves all factors are one."""
    parts = s.sleeves or (V.Sleeve("all", s.factors, (s.horizon,)),)
    scores, _ = V.sleeve_scores(table, parts, s.weighting)
    if not s.sleeves:
        return scores, scores.select("time", "sleeve").distinct().withColumn("w", F.lit(1.0))
    scores = stored(scores, "sleeves")
    return scores, V.sleeve_weights(scores, table, parts, s.allocation)


def scores(table: DataFrame, s: Strategy) -> DataFrame:
    """(strategy, time, asset, score, ret, liquidity)."""
    total = V.combined(*sleeve_table(table, s))
    return total.join(table.select("time", "asset", "ret", "liquidity"), ["time", "asset"]).select(F.lit(s.name).alias("strategy"), "time", "asset", F.round("score", 9).alias("score"), "ret", "liquidity")


def run(spark: SparkSession, folder: str, names: tuple[str, ...], regime: DataFrame | None = None, bars: DataFrame | None = None, **overrides) -> DataFrame:
    """Weights (strategy, time, asset, w, budget) of some strategies over one panel (``bars``, or that of the folder); ``overrides`` replace fields of their configurations."""
    parts = []
    bars = panel(spark, folder) if bars is None else bars
    for s in (replace(STRATEGIES[n], **overrides) for n in names):
        table = factor_table(bars, s)
        signals = stored(scores(table, s), "scores")
        book = build(signals, {s.name: s.rules}, regime)
        if s.overlay:
            book = overlaid(book, overlay(signals.select("time", "asset", "ret"), s.overlay))
        drop_stored(table)
        parts.append(book)
    return reduce(DataFrame.unionByName, parts)


def diagnostics(weights: DataFrame, returns: DataFrame, bps: float = 10.0) -> DataFrame:
    """Daily return, exposures, turnover and cost of each strategy, weights lagged one bar."""
    w = weights.join(returns, ["time", "asset"]).selectExpr("*", "coalesce(lag(w) over (partition by strategy, asset order by time), 0d) wl")
    return w.groupBy("strategy", "time").agg(F.sum(F.expr("wl * ret")).alias("port_ret"), F.avg("ret").alias("mkt_ret"), F.sum(F.abs("w")).alias("gross"), F.sum("w").alias("net"), F.sum(F.expr("abs(w - wl)")).alias("turnover"), (F.sum(F.expr("abs(w - wl)")) * bps / 1e4).alias("cost"), F.first("budget").alias("budget"))
