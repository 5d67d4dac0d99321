"""The factor library as expressions: base columns, shared parts, and a registry of factors by category."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields, replace

from .dsl import EPS, E, clip, col, cs, cum, ema, fn, lag, nz, robust_z, roll, when

WEEK, MONTH, QUARTER, YEAR = 5, 21, 63, 252


@dataclass(frozen=True)
class Windows:
    """Rows of each window; ``scaled`` multiplies all of them."""

    beta: int = 162
    idio: int = 63
    down: int = 63
    corr: int = 63
    adv: int = 63
    adv_short: int = 5
    mom: int = 84
    mom_short: int = 21
    mom_long: int = 126
    rev: int = 5
    rev_long: int = 21
    donchian: int = 63
    ema_fast: int = 20
    ema_slow: int = 42
    atr: int = 42
    sector: int = 63
    value: int = 200
    week: int = WEEK
    month: int = MONTH
    quarter: int = QUARTER
    year: int = YEAR
    ic: int = 63
    ou_short: int = 21
    ou_med: int = 63
    ofi_short: int = 5
    ofi_med: int = 21
    ofi_long: int = 63
    vpin: int = 50
    spread: int = 21
    impact: int = 42
    efficiency: int = 21
    attention: int = 10
    disposition: int = 63
    skew: int = 63
    kurt: int = 63
    vov: int = 21
    persistence: int = 42
    inventory_decay: float = 0.95

    def scaled(self, factor: float, least: int = 5) -> Windows:
        """All windows times ``factor``, rounded, at least ``least`` rows (the weekly ones at least 2)."""
        out = {}
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, int):
                out[f.name] = max(2 if f.name in ("week", "rev", "ofi_short", "adv_short") else least, round(value * factor))
        return replace(self, **out)


def sma(x: E, n: int, mp: int | None = None) -> E:
    return roll("avg", n, x, mp=mp)


def std(x: E, n: int, mp: int | None = None) -> E:
    return roll("std", n, x, mp=mp)


def total(x: E, n: int, mp: int | None = None) -> E:
    return roll("sum", n, x, mp=mp)


def least(*x) -> E:
    return fn("least", *x)


def most(*x) -> E:
    return fn("greatest", *x)


def absolute(x: E) -> E:
    return fn("abs", x)


def square(x: E) -> E:
    return x * x


@dataclass
class Base:
    """Parts that factors share. Prices are never missing here: the panel carries closes on and starts at 0."""

    w: Windows = field(default_factory=Windows)

    def __post_init__(self):
        w = self.w
        self.open, self.high, self.low, self.close, self.vol = map(col, ("open", "high", "low", "close", "vol"))
        self.ret = most(nz(self.close / lag(self.close) - 1), -0.999999)
        self.mkt = cs("avg", self.ret)
        cov = sma(self.ret * self.mkt, w.beta) - sma(self.ret, w.beta) * sma(self.mkt, w.beta)
        var = sma(square(self.mkt), w.beta) - square(sma(self.mkt, w.beta))
        self.beta = nz(cov / (var + EPS))
        self.resid = self.ret - self.beta * self.mkt
        self.dollar = self.close * self.vol
        self.prev = lag(self.close)
        self.tr = nz(most(self.high - self.low, absolute(self.high - self.prev), absolute(self.low - self.prev)) * when(E("isnull", self.prev), 0.0, 1.0))
        self.adv = nz(sma(self.dollar, w.adv))
        self.adv_rel = self.adv / (cs("avg", self.adv) + EPS)
        self.range = self.high - self.low
        self.ln_close = when(self.close.gt(0), fn("ln", when(self.close.gt(0), self.close)), 0.0)
        self.ln_range = when(self.low.gt(0), fn("ln", most(self.high / (self.low + EPS), 1.0)), 0.0)
        step = self.close - self.prev
        self.signed = nz(fn("sign", step)) * self.vol

    def atr(self, n: int) -> E:
        return nz(sma(self.tr, n))

    def period(self, k: int) -> E:
        return self.close / lag(self.close, k) - 1

    def rel(self, x: E) -> E:
        """Demeaned across assets."""
        return x - cs("avg", x)

    def ofi(self, n: int) -> E:
        mp = max(2, n // 2)
        return clip(nz(total(self.signed, n, mp) / (total(self.vol, n, mp) + EPS)), -1, 1)

    @property
    def vpin(self) -> E:
        n = self.w.vpin
        up, down = (total(when(test, self.vol, 0.0), n, n // 2) for test in (self.signed.gt(0), self.signed.lt(0)))
        return nz(absolute(up - down) / (up + down + EPS))

    def inventory(self, span: int | None = None) -> E:
        span = round(1 / (1 - self.w.inventory_decay)) if span is None else span
        return ema(self.signed, 2 / (span + 1), mp=span)

    def ou(self, n: int) -> dict[str, E]:
        """Rolling AR(1) of the log close: speed, mean, deviation, half-life, distance."""
        mp = max(3, n // 2)
        x, before = self.ln_close, lag(self.ln_close)
        mx, mb = sma(x, n, mp), sma(before, n, mp)
        b = (sma(x * before, n, mp) - mx * mb) / (square(std(before, n, mp)) + EPS)
        b = fn("round", b, 12)
        b = when(absolute(b).lt(0.9999), b, 0.9999 * fn("sign", b))
        a = mx - b * mb
        speed = -fn("ln", absolute(b) + EPS)
        speed = when(speed.gt(0), speed, EPS)
        mean = a / (1.0 - b + EPS)
        sigma = std(x - (a + b * before), n, mp)
        half = clip(math.log(2.0) / (speed + EPS), 2.0, 42.0)
        return {"theta": nz(speed), "mu": nz(mean), "sigma": nz(sigma), "half": nz(half, 42.0), "z": nz(clip((x - mean) / (sigma + EPS), -3, 3))}

    def bars(self, n: int, mp: int | None = None) -> tuple[E, E]:
        return roll("max", n, self.high, mp=mp), roll("min", n, self.low, mp=mp)


def library(b: Base) -> dict[str, dict[str, E]]:
    """{category: {factor: raw expression}}; a missing value is 0 before the score across assets."""
    w, ret, resid, close, vol = b.w, b.ret, b.resid, b.close, b.vol
    out: dict[str, dict[str, E]] = {}
    idio = nz(std(resid, w.idio))
    inv_vol = 1 / (b.atr(w.atr) + EPS)
    inv_idio = 1 / (idio + EPS)
    out["defensive"] = {
        "inv_vol": inv_vol,
        "inv_idio": inv_idio,
        "inv_down": 1 / (nz(std(least(ret, 0.0), w.down)) + EPS),
        "low_corr": -roll("corr", w.corr, ret, b.mkt),
        "low_beta": -b.beta,
    }
    out["liquidity"] = {"liquidity": b.adv_rel, "amihud_inv": 1 / (absolute(ret) / (b.dollar + EPS) + EPS)}
    m, short, long = (nz(sma(resid, n)) for n in (w.mom, w.mom_short, w.mom_long))
    reversal = -b.period(w.rev)
    out["momentum"] = {"resid_mom": m, "resid_mom_short": short, "resid_mom_long": long, "resid_mom_mix": 0.5 * m + 0.3 * long + 0.2 * short, "cross_momentum": b.rel(nz(sma(ret, w.mom)))}
    out["reversal"] = {"srev": reversal, "lrev": -b.period(w.rev_long)}
    top, bottom = roll("max", w.donchian, close), roll("min", w.donchian, close)
    year_top, year_bottom = roll("max", w.year, close), roll("min", w.year, close)
    fast, slow = ema(close, 2 / (w.ema_fast + 1), w.ema_fast), ema(close, 2 / (w.ema_slow + 1), w.ema_slow)
    atr, atr20 = b.atr(w.atr), b.atr(20)
    out["technical"] = {
        "breakout": (close - bottom) / (top - bottom + EPS),
        "slope": (fast - slow) / (atr + EPS),
        "calm_flow": -(sma(vol, w.adv_short) / (sma(vol, w.adv) + EPS) - 1),
        "prox_52w_high": -(close / (year_top + EPS) - 1),
        "vol_surprise": b.dollar / (sma(b.dollar, 20) + EPS) - 1,
        "vol_breakout": (atr / (nz(sma(atr, 20)) + EPS) - 1) * when(m.gt(0), 1.0, 0.0),
        "ma_cloud": 0.6 * (close - sma(close, 50)) / (atr20 + EPS) + 0.4 * (close - sma(close, 200)) / (atr20 + EPS),
    }
    adv = sma(b.dollar, w.adv)
    parkinson = sma(square(b.ln_range), 20) / (4 * math.log(2))
    out["risk"] = {
        "idio_tail_risk": -(roll("q0.05", 20, resid, mp=10) / (nz(std(resid, 20)) + EPS)),
        "idio_jump_freq": -sma(when(absolute(resid).gt(2.5 * (idio + EPS)), 1.0, 0.0), 20),
        "beta_stability": -absolute(sma(b.beta, w.month) - lag(sma(b.beta, w.month), w.month)),
        "micro_noise": -(sma(square(ret), 20) / (parkinson + EPS)),
        "quality_score": nz(0.4 / (atr + EPS) + 0.3 * adv / (cs("avg", adv) + EPS) + 0.3 / (idio + EPS)),  # 0 until the volume's window is full
    }
    out["value"] = {"value_score": -(close / sma(close, w.value) - 1), "value_mom": m * nz(reversal), "quality_defensive": b.adv_rel * inv_vol}
    out["cross_section"] = {"rel_sector_mom": b.rel(nz(sma(ret, w.sector))), "cross_volatility": b.rel(nz(std(ret, w.idio))), "cross_liquidity": b.rel(b.adv)}
    out["timeframe"], out["timeframe_quality"] = timeframes(b)
    out["behaviour"] = behaviour(b)
    out["mean_reversion"] = mean_reversion(b)
    out["order_flow"] = order_flow(b)
    out["order_flow_extended"] = order_flow_extended(b)
    return out


def timeframes(b: Base) -> tuple[dict[str, E], dict[str, E]]:
    w, ret, close = b.w, b.ret, b.close
    k = {"week": w.week, "month": w.month, "quarter": w.quarter, "year": w.year}
    p = {name: nz(b.period(n)) for name, n in k.items()}
    first = {f"ret_{short}td": p[name] for short, name in (("w", "week"), ("m", "month"), ("q", "quarter"), ("y", "year"))}
    first |= {f"ret_1{short}": p[name] for short, name in (("w", "week"), ("m", "month"), ("q", "quarter"), ("y", "year"))}
    first["ret_2_12m"] = p["year"] - p["month"]
    one = lambda x: when(x.gt(0), 1.0, 0.0)
    ic = {name: nz(roll("corr", w.ic, lag(p[name], k[name]), p[name])) for name in ("week", "month", "quarter")}
    pos = {name: most(x, 0.0) for name, x in ic.items()}
    mass = pos["week"] + pos["month"] + pos["quarter"] + EPS
    ic_mom = (pos["week"] * p["week"] + pos["month"] * p["month"] + pos["quarter"] * p["quarter"]) / mass
    mean3 = (p["week"] + p["month"] + p["quarter"]) / 3
    std3 = fn("sqrt", (square(p["week"] - mean3) + square(p["month"] - mean3) + square(p["quarter"] - mean3)) / 3)
    sigma = std(ret, w.quarter)
    # least squares over the logs of the horizons
    logs = {name: math.log(k[name]) for name in ("week", "month", "quarter")}
    centre = sum(logs.values()) / 3
    spread = sum((x - centre) ** 2 for x in logs.values())
    scaled = {name: p[name] / (sma(absolute(p[name]), w.quarter, 10) + EPS) for name in logs}
    slope = sum(((logs[name] - centre) / spread) * scaled[name] for name in logs)
    high5, low5 = b.bars(w.week)
    high21, low21 = b.bars(w.month)
    position = clip(nz((close - low21) / (high21 - low21 + EPS), 0.5), 0, 1)
    second = {
        "mtf_alignment": one(p["week"]) + one(p["month"]) + one(p["quarter"]) + one(p["year"]),
        "mtf_alignment_strength": clip(nz(p["week"] / (std(p["week"], w.quarter) + EPS)) + nz(p["month"] / (std(p["month"], w.quarter) + EPS)) + nz(p["quarter"] / (std(p["quarter"], w.quarter) + EPS)) + nz(p["year"] / (std(p["year"], w.year - 2) + EPS)), -10, 10),
        "trend_consistency": 1 / (std3 + EPS),
        "mtf_ic_momentum": ic_mom,
        "mtf_ic_regime": when(ic["week"].ge(ic["month"]) & ic["week"].ge(ic["quarter"]), 1.0, when(ic["month"].ge(ic["quarter"]), 2.0, 3.0)),
        "momentum_acceleration": clip(p["week"] / (sigma + EPS) - p["month"] / (sigma + EPS), -5, 5),
        "mtf_slope": clip(slope, -5, 5),
        "hloc_range_expansion": clip((high5 - low5) / (high21 - low21 + EPS), 0, 3),
        "hloc_close_position": position,
        "hloc_momentum_quality": p["month"] * (position - 0.5) * 2,
        "relative_mtf_momentum": ic_mom - sma(b.mkt, w.month),
        "sector_relative_mtf": b.rel(nz(ic_mom)),
    }
    return first, second


def behaviour(b: Base) -> dict[str, E]:
    w, ret, resid, close, vol = b.w, b.ret, b.resid, b.close, b.vol
    top, bottom = roll("max", w.year, close), roll("min", w.year, close)
    middle = (top + bottom) / 2
    attention = fn("sign", ret) * (clip(vol / (sma(vol, w.adv) + EPS), 0.1, 10) - 1) * absolute(clip(ret / (std(ret, w.month) + EPS), -3, 3))
    gain = when(sma(ret, w.month).gt(0), 1.0, 0.0)
    step = absolute(close - b.prev)
    move = close - lag(close, w.efficiency)
    up = sma(b.dollar * when(ret.gt(0), 1.0, 0.0) * absolute(ret), w.adv)
    down = sma(b.dollar * when(ret.lt(0), 1.0, 0.0) * absolute(ret), w.adv)
    slow = ema(close, 2 / (w.ema_slow + 1), w.ema_slow)
    dev = nz((close - slow) / (slow + EPS))
    vol21, vol63 = std(ret, w.month), std(ret, w.quarter)
    calm = clip(1 / (1 + fn("exp", -2 * (vol21 / (vol63 + EPS) - 1))), 0.2, 0.8)
    m84, r84 = nz(sma(resid, w.mom)), nz(sma(ret, w.mom))
    spread = cs("std", ret)
    return {
        "attention_momentum": sma(nz(attention), w.attention),
        "disposition_alpha": sma(nz(-(close - middle) / (middle + EPS) * (0.5 + 0.5 * gain)), w.disposition),
        "anchoring_bias": 0.6 * nz(clip(close / (top + EPS), 0, 1), 0.5) + 0.4 * nz(clip((close - bottom) / (top - bottom + EPS), 0, 1), 0.5),
        "efficiency_ratio": clip(nz(absolute(move) / (total(step, w.efficiency) + EPS) * fn("sign", move)), -1, 1),
        "information_flow": (up - down) / (up + down + EPS),
        "mean_reversion_speed": -roll("corr", w.quarter, dev, lag(dev), mp=21),
        "momentum_quality_ratio": clip(r84 / (std(ret, w.mom) + EPS) * math.sqrt(252), -5, 5),
        "momentum_persistence": clip(nz(roll("corr", w.persistence, ret, lag(ret), mp=21)), -1, 1),
        "momentum_divergence": clip((m84 - r84) / (vol63 + EPS), -3, 3),
        "vol_of_vol": 1 / (std(std(ret, w.vov), w.quarter) + EPS),
        "skewness_factor": clip(roll("skew", w.skew, ret, mp=21), -3, 3),
        "kurtosis_factor": -clip(roll("kurt", w.kurt, ret, mp=21), -10, 20),
        "regime_momentum": calm * nz(sma(resid, w.mom_short)) + (1 - calm) * nz(sma(resid, w.mom_long)),
        "cross_sectional_dispersion": sma(nz(b.rel(ret) * sma(spread, w.month) / (cum("avg", spread) + EPS)), w.month),
        "liquidity_momentum": m84 * clip(b.adv_rel, 0, 5) / 2.5,
    }


def mean_reversion(b: Base) -> dict[str, E]:
    s, m = b.ou(b.w.ou_short), b.ou(b.w.ou_med)
    half = clip((m["half"] - 2.0) / 40.0, 0, 1)
    momentum = 0.6 * robust_z(total(b.ret, 21, 15)) + 0.4 * robust_z(total(b.ret, 63, 42))
    return {
        "ou_zscore_short": -s["z"],
        "ou_zscore_med": -m["z"],
        "ou_halflife_signal": 1 / (m["half"] + 1),
        "ou_reversion_strength": m["theta"],
        "ou_predicted_return": m["theta"] * (m["mu"] - b.ln_close),
        "ou_regime_indicator": -absolute(m["half"] - cs("median", m["half"])),
        "ou_equilibrium_dist": -clip((b.ln_close - (0.3 * s["mu"] + 0.7 * m["mu"])) / (0.3 * s["sigma"] + 0.7 * m["sigma"] + EPS), -3, 3),
        "ou_momentum_blend": half * momentum + (1 - half) * robust_z(-total(b.ret, 5, 3)),
    }


def order_flow(b: Base) -> dict[str, E]:
    w, ret, vol = b.w, b.ret, b.vol
    n = w.impact
    up, down = when(ret.gt(0), 1.0, 0.0), when(ret.lt(0), 1.0, 0.0)
    half = n // 2
    asymmetry = nz(total(up * ret * vol, n, half) / (total(up * vol, n, half) + EPS)) - nz(absolute(total(down * ret * vol, n, half)) / (total(down * vol, n, half) + EPS))
    spread = sma(b.ln_range, w.spread)
    inventory = b.inventory()
    return {
        "glft_ofi_short": b.ofi(w.ofi_short),
        "glft_ofi_med": b.ofi(w.ofi_med),
        "glft_ofi_momentum": b.ofi(w.ofi_short) - b.ofi(w.ofi_long),
        "glft_flow_toxicity": -b.vpin,
        "glft_toxic_momentum": -(sma(b.vpin, 5, 3) - sma(b.vpin, 21, 14)),
        "glft_impact_asymmetry": asymmetry,
        "glft_inventory_signal": -inventory,
        "glft_inventory_risk_prem": std(inventory, n, 21),
        "glft_spread_adjusted_mom": total(ret, 21, 15) - 2 * spread,
        "glft_mm_edge": 0.4 * robust_z(-b.vpin) + 0.3 * robust_z(std(ret, 21)) + 0.3 * robust_z(-total(ret, 5)),
    }


def order_flow_extended(b: Base) -> dict[str, E]:
    """Impact, volume-clock flow, bulk classification, and flow against the market."""
    w, ret, vol, close, sv = b.w, b.ret, b.vol, b.close, b.signed
    n = w.impact
    dr, ds = ret - sma(ret, n), sv - sma(sv, n)
    bulk = (close - b.low) / (b.range + EPS)
    buy, sell = total(vol * bulk, 10), total(vol * (1 - bulk), 10)
    flow = b.ofi(w.ofi_med)
    inventory = b.inventory(20)
    spread = nz(sma(b.ln_range, w.spread))
    illiquid = nz(sma(absolute(ret) / (b.dollar + EPS), n))
    relative = nz(vol / (sma(vol, w.adv) + EPS))
    mean_vpin, mean_flow = cs("avg", b.vpin), cs("avg", flow)
    cov = sma(ret * sv, 14) - sma(ret, 14) * sma(sv, 14)
    both = (sma(square(sv), 14) - square(sma(sv, 14))) * (sma(square(ret), 14) - square(sma(ret, 14)))
    o5, o63 = b.ofi(w.ofi_short), b.ofi(w.ofi_long)
    sign = lambda x: fn("sign", fn("round", x, 12))
    return {
        "glft_kyle_lambda": -(sma(dr * ds, n) / (sma(square(ds), n) + EPS)),
        "glft_volume_clock_ofi": total(sv * close, 21) / (total(vol * close, 21) + EPS),
        "glft_bvc_imbalance": (buy - sell) / (buy + sell + EPS),
        "glft_flow_dispersion": cs("std", flow) / (absolute(flow - cs("median", flow)) + EPS),
        "glft_reservation_signal": -(inventory * square(nz(std(ret, 14)))) / (close + EPS),
        "glft_amihud_hybrid": 0.4 * robust_z(-illiquid) + 0.3 * robust_z(-spread) + 0.3 * robust_z(relative),
        "glft_mtf_ofi_alignment": (sign(o5) + sign(flow) + sign(o63)) * (absolute(o5) + absolute(flow) + absolute(o63)) / 3,
        "glft_sector_rel_flow": flow - mean_flow,
        "glft_regime_toxicity": -b.vpin / (sma(mean_vpin, 42) + EPS),
        "glft_market_flow_mom": flow * (sma(mean_flow, 5) - sma(mean_flow, 21)),
        "glft_exec_quality": 0.25 * (robust_z(-spread) + robust_z(-illiquid) + robust_z(relative) + robust_z(-b.vpin)),
        "glft_adverse_decomp": clip(1 - square(cov) / (both + EPS), 0, 1),
        "glft_optimal_spread": square(std(ret, 21)) + 2 * fn("ln", 1 + 1 / (relative + EPS)) - spread,
        "glft_flow_persistence": nz(roll("corr", 10, o5, lag(o5))) * o5,
    }


def to_date(b: Base, period: str) -> E:
    """Return since the close at the period's start day; the start row is 0, and before the first start the first row is the base. A base of 0 gives 0."""
    unit = {"week": "weekday", "month": "month", "quarter": "quarter", "year": "year"}[period]
    start = col(f"starts_{unit}").eq(1.0)
    base = fn("coalesce", cum("last", when(start, b.close)), cum("max", when(col("t").eq(0), b.close)))
    return when(start, 0.0, nz(b.close / when(base.gt(0), base) - 1))


# The named factor sets.
V4_24 = ("inv_vol", "inv_idio", "inv_down", "low_corr", "low_beta", "liquidity", "amihud_inv", "resid_mom", "srev", "breakout", "slope", "calm_flow", "prox_52w_high", "resid_mom_mix", "vol_surprise", "vol_breakout", "ma_cloud", "idio_tail_risk", "idio_jump_freq", "beta_stability", "micro_noise", "value_mom", "quality_defensive", "rel_sector_mom")
DEFENSIVE = ("inv_vol", "inv_idio", "inv_down", "low_corr", "low_beta", "liquidity", "amihud_inv")
ALPHA = ("resid_mom", "srev", "breakout", "slope", "calm_flow", "prox_52w_high", "resid_mom_mix", "vol_surprise", "vol_breakout", "ma_cloud")
QUALITY = ("idio_tail_risk", "idio_jump_freq", "beta_stability", "micro_noise", "quality_score")
TIMEFRAMES = ("ret_wtd", "ret_mtd", "ret_qtd", "ret_ytd", "ret_1w", "ret_1m", "ret_1q", "ret_2_12m", "mtf_alignment", "mtf_alignment_strength", "trend_consistency", "mtf_ic_momentum", "momentum_acceleration", "mtf_slope", "hloc_close_position", "hloc_momentum_quality")
OU = ("ou_zscore_short", "ou_zscore_med", "ou_halflife_signal", "ou_reversion_strength", "ou_predicted_return", "ou_regime_indicator", "ou_equilibrium_dist", "ou_momentum_blend")
GLFT = ("glft_ofi_short", "glft_ofi_med", "glft_ofi_momentum", "glft_flow_toxicity", "glft_toxic_momentum", "glft_impact_asymmetry", "glft_inventory_signal", "glft_inventory_risk_prem", "glft_spread_adjusted_mom", "glft_mm_edge")
GLFT_2 = ("glft_kyle_lambda", "glft_volume_clock_ofi", "glft_bvc_imbalance", "glft_flow_dispersion", "glft_reservation_signal", "glft_amihud_hybrid")
GLFT_3 = ("glft_mtf_ofi_alignment", "glft_sector_rel_flow", "glft_regime_toxicity", "glft_market_flow_mom", "glft_exec_quality", "glft_adverse_decomp", "glft_optimal_spread", "glft_flow_persistence")
NEURAL = ("attention_momentum", "disposition_alpha", "anchoring_bias", "efficiency_ratio", "information_flow", "mean_reversion_speed", "momentum_quality_ratio", "momentum_persistence", "momentum_divergence", "vol_of_vol", "skewness_factor", "kurtosis_factor", "regime_momentum", "cross_sectional_dispersion", "liquidity_momentum")


def registry(w: Windows | None = None) -> dict[str, tuple[str, E]]:
    """{factor: (category, raw expression)}."""
    return {name: (kind, e) for kind, group in library(Base(w or Windows())).items() for name, e in group.items()}


def names(category: str | None = None) -> list[str]:
    return [n for n, (kind, _) in registry().items() if category in (None, kind)]


def categories() -> list[str]:
    return list(library(Base()))


def scored(raw: dict[str, E]) -> dict[str, E]:
    """The score across assets of every raw factor; a constant row scores 0."""
    return {name: robust_z(x) for name, x in raw.items()}
