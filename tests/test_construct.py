"""Construction rules, strategies and stored tables."""

import json
from datetime import date

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import construct as C
from quantloom.plans import strategies as S
from quantloom.sources import artifacts, prices


def test_capped_simplex():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(2, 12))
        lo, hi = np.full(n, 0.01), np.full(n, 0.4)
        w = C.capped_simplex(rng.standard_normal(n), 1.0, lo, hi)
        if n * 0.4 >= 1:
            assert w.sum() == pytest.approx(1) and (w >= lo - 1e-12).all() and (w <= hi + 1e-12).all()
        else:
            assert w == pytest.approx(hi)
    v = np.array([0.5, 0.3, 0.2])
    assert C.capped_simplex(v, 1.0, np.zeros(3), np.ones(3)) == pytest.approx(v)


def test_tilt():
    w = C.softmax_tilt(np.array([0.5, 0.5, 0.0]), np.array([1.0, 0.0, 9.0]), np.array([True, True, False]), 0.85)
    assert w.sum() == pytest.approx(1) and w[0] > w[1] and w[2] == 0
    assert C.softmax_tilt(np.ones(2), np.ones(2), np.zeros(2, bool), 1.0).tolist() == [0, 0]


def dense_books(scores, liquid, rules, names, seats, pins):
    """A plain loop over the whole grid of dates and names."""
    smooth = pd.DataFrame(scores).fillna(0.0).rolling(rules.smooth, min_periods=1).mean().to_numpy() * liquid
    dates, n = smooth.shape
    out, before = np.zeros((dates, n)), np.zeros(n)
    for t in range(dates):
        s = smooth[t] if rules.shorts else smooth[t] - smooth[t].min() + 1e-6
        order = np.argsort(-s, kind="stable")
        long, short = pins.copy(), np.zeros(n, bool)
        long[order[: seats[t]]] = True
        if rules.shorts:
            short[order[-rules.shorts :]] = True
        lo, hi = np.where(long, rules.min_pos, 0.0), np.where(long, rules.max_pos, 0.0)
        slo, shi = np.where(short, rules.min_pos, 0.0), np.where(short, rules.max_pos, 0.0)
        if rules.equal:
            chosen = [k for k in np.flatnonzero(pins)][: rules.longs]
            chosen += [k for k in order if k not in chosen][: rules.longs - len(chosen)]
            out[t, chosen] = 1 / len(chosen)
            continue
        if not rules.shorts:
            x = s[long] - s[long].min() + 1e-6
            target = np.zeros(n)
            target[long] = x / (x.sum() + 1e-12)
            unit = C.capped_simplex(C.softmax_tilt(target, s, long, rules.tilt), 1.0, lo, hi)
            if t and rules.gate and not rules.gate.trades(before, unit, s[long].std()):
                before = C.capped_simplex(before, 1.0, lo, hi)
            else:
                before = C.capped_simplex(C.softmax_tilt(rules.blend * unit + (1 - rules.blend) * before, s, long, rules.tilt * 0.5), 1.0, lo, hi)
        else:
            mass = np.abs(s[long]).sum(), np.abs(s[short]).sum()
            up = rules.long_share if rules.split == "fixed" else mass[0] / (sum(mass) + 1e-12)
            sides = {}
            for name, side, share, sign in (("top", long, up, 1), ("bottom", short, 1 - up, -1)):
                x = sign * s[side]
                w = np.zeros(n)
                w[side] = (x - x.min() + 1e-6) / ((x - x.min() + 1e-6).sum() + 1e-12) * share
                sides[name] = C.softmax_tilt(w, sign * s, side, rules.tilt) * share if rules.tilt else w
            target = np.where(short, -sides["bottom"], sides["top"]) if rules.tilt else sides["top"] - sides["bottom"]
            project = lambda w: C.capped_simplex(np.maximum(w, 0), up, lo, hi) - C.capped_simplex(np.maximum(-w, 0), 1 - up, slo, shi)  # noqa: B023, E731
            unit = project(target)
            if not (t and rules.gate and not rules.gate.trades(before, unit, s.std())):
                before = project(rules.blend * unit + (1 - rules.blend) * before)
        out[t] = before
    return out


def dense_budget(unit, returns, rules, target, lever):
    book = np.concatenate([[0.0], (np.abs(unit[:-1]) * returns[1:]).sum(1)])
    v, vol = 0.0, np.zeros(len(book))
    for t, x in enumerate(book):
        v = rules.decay * v + (1 - rules.decay) * x * x
        vol[t] = np.sqrt(v)
    growth = np.cumprod(1 + returns.mean(1))
    peak = pd.Series(growth).rolling(rules.drawdown_rows, min_periods=1).max().to_numpy()
    throttle = np.clip(1 - rules.stretch * (peak - growth) / (peak + 1e-12), rules.floor, 1.0)
    base = np.clip(target / (vol * np.sqrt(252.0) + 1e-8), rules.lev_min, rules.lev_cap)
    return np.clip(base * throttle * lever, rules.lev_min, rules.lev_cap) * rules.gross


BOOKS = {
    "long": C.Rules(longs=5, max_pos=0.25, drawdown_rows=10),
    "capped": C.Rules(longs=3, max_pos=0.3, lev_cap=1.9, target_vol=3.0, tilt=0.0, smooth=1),
    "both": C.Rules(longs=4, shorts=3, max_pos=0.25, drawdown_rows=10),
    "fixed": C.Rules(longs=3, shorts=2, max_pos=0.4, split="fixed", tilt=0.0),
    "gated": C.Rules(longs=4, max_pos=0.3, gate=C.Gate(bps=4000, benefit=0.5)),
    "gated_both": C.Rules(longs=4, shorts=4, max_pos=0.3, gate=C.Gate(bps=4000, benefit=0.25)),
    "regimes": C.Rules(longs=6, longs_volatile=3, vol_volatile=0.05, max_pos=0.35, pins=("a03", "a07")),
    "equal": C.Rules(longs=4, equal=True, pins=("a09",)),
    "flat": C.Rules(longs=4, shorts=4, max_pos=0.3, lever=False, gross=0.9),
}


def test_books_equal_a_loop_over_the_grid(spark):
    rng = np.random.default_rng(2)
    dates, n = 45, 12
    names = [f"a{k:02d}" for k in range(n)]
    days = pd.date_range("2024-01-01", periods=dates).date
    scores, ret = rng.standard_normal((dates, n)).round(3), rng.standard_normal((dates, n)) / 40
    scores[3, :] = 0
    scores[5, 4] = np.nan
    liquid = (rng.random((dates, n)) > 0.1).astype(float)
    volatile, seats = rng.random(dates) > 0.6, rng.random(dates) > 0.8
    rows = [(b, days[t], names[k], None if np.isnan(scores[t, k]) else float(scores[t, k]), float(ret[t, k]), float(liquid[t, k])) for b in BOOKS for t in range(dates) for k in range(n)]
    frame = spark.createDataFrame(rows, "strategy string, time date, asset string, score double, ret double, liquidity double").repartition(5)
    regime = spark.createDataFrame([(days[t], bool(volatile[t]), 2 if seats[t] else None, 0.2 if t == 30 else None, 0.8 if t % 7 == 0 else None) for t in range(dates)], "time date, volatile boolean, seats int, target_vol double, leverage double")
    plain, special = {k: r for k, r in BOOKS.items() if k != "regimes"}, {"regimes": BOOKS["regimes"]}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = C.build(frame, plain).toPandas()
        got = pd.concat([got, C.build(frame, special, regime).toPandas()])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    kept = 0
    for b, rules in BOOKS.items():
        pins = np.array([a in rules.pins for a in names])
        if b == "regimes":
            by = [2 if seats[t] else rules.longs_volatile if volatile[t] else rules.longs for t in range(dates)]
            target = np.where(volatile, rules.vol_volatile, rules.target_vol)
            target[30] = 0.2
            lever = np.array([0.8 if t % 7 == 0 else 1.0 for t in range(dates)])
        else:
            by, target, lever = [rules.longs] * dates, rules.target_vol, 1.0
        unit = dense_books(scores, liquid, rules, names, by, pins)
        budget = dense_budget(unit, ret, rules, target, lever) if rules.lever else np.full(dates, rules.gross)
        want = unit * budget[:, None]
        if not rules.shorts and not rules.equal:
            want = np.stack([C.capped_simplex(row, x, np.zeros(n), np.full(n, rules.max_pos)) for row, x in zip(want, budget, strict=True)])
        mine = got[got.strategy == b].pivot(index="time", columns="asset", values="w").to_numpy()
        assert np.allclose(mine, want, rtol=0, atol=1e-8), b
        assert np.allclose(got[got.strategy == b].groupby("time").budget.first(), budget, rtol=0, atol=1e-9), b
        kept += (np.abs(np.diff(unit, axis=0)).sum(1) == 0).sum() if rules.gate else 0
    assert kept  # the gate held some books
    spread = got[(got.strategy == "capped")].groupby("time").w.agg(lambda w: (w > 1e-9).sum())
    assert spread.max() == n  # what the limits left over fell on all names


def test_no_scores_no_book(spark):
    nothing = spark.createDataFrame([], "strategy string, time date, asset string, score double, ret double")
    assert C.build(nothing, {"x": C.Rules(longs=2)}).count() == 0


def test_overlay(spark):
    rng = np.random.default_rng(4)
    ret = rng.standard_normal((40, 3)) / 60
    days = pd.date_range("2024-01-01", periods=40).date
    frame = spark.createDataFrame([(days[t], f"a{k}", float(ret[t, k])) for t in range(40) for k in range(3)], "time date, asset string, ret double")
    rule = C.Overlay(vol_rows=8, drawdown_rows=12)
    vol = pd.DataFrame(ret).rolling(8, min_periods=1).std(ddof=0).fillna(0).to_numpy() * np.sqrt(252) + 1e-12
    scale = np.where(vol <= 0.22, np.clip(0.16 / vol, 0.5, 1.25), 0.16 / 0.22)
    growth = np.cumprod(1 + ret.mean(1))
    peak = pd.Series(growth).rolling(12, min_periods=1).max().to_numpy()
    want = np.clip(scale * np.clip(1 - 0.6 * (peak - growth) / peak, 0.55, 1.25)[:, None], 0.5, 1.25)
    got = C.overlay(frame, rule).toPandas().pivot(index="time", columns="asset", values="scale").to_numpy()
    assert np.allclose(got, want, rtol=0, atol=1e-9)


def test_strategies_use_known_factors():
    from quantloom.functions.factors import registry

    known = set(registry())
    assert len(S.STRATEGIES) == 12
    for s in S.STRATEGIES.values():
        assert set(s.factors) <= known and len(set(s.factors)) == len(s.factors), s.name
    assert [len(S.STRATEGIES[n].factors) for n in ("exchange_24", "composer_32", "composer_36", "behaviour_32", "behaviour_40", "defensive_38", "reversion_24", "flow_25", "flow_30", "flow_40")] == [24, 32, 36, 32, 40, 38, 24, 25, 30, 40]


def test_strategy_runs(spark):
    w = S.run(spark, "/root/testdata/sf0.001", ("hybrid_11",)).toPandas()
    assert len(w) and (w.w >= -1e-12).all() and w.groupby("time").w.sum().max() <= 1.5 + 1e-9


def test_warehouse(spark, tmp_path):
    w = prices.Warehouse(spark, str(tmp_path / "w"))
    rows = lambda *x: spark.createDataFrame(list(x), "asset string, date date, close double")
    w.insert_ignore("ohlcv", rows(("a", date(2024, 1, 2), 1.0), ("a", date(2024, 1, 2), 9.0)), ("asset", "date"))
    w.insert_ignore("ohlcv", rows(("a", date(2024, 1, 2), 5.0), ("b", date(2024, 1, 3), 2.0)), ("asset", "date"))
    assert w.read("ohlcv").count() == 2 and not w.read("ohlcv").filter("close = 5").count()
    u = lambda *x: spark.createDataFrame(list(x), "asset string, name string, first date, last date")
    w.upsert("universe", u(("a", "A", date(2024, 1, 2), date(2024, 1, 9))), ("asset",), ("first",), ("last",))
    w.upsert("universe", u(("a", None, date(2023, 1, 2), date(2023, 1, 9)), ("b", "B", None, None)), ("asset",), ("first",), ("last",))
    assert sorted(map(tuple, w.read("universe").collect())) == [("a", "A", date(2023, 1, 2), date(2024, 1, 9)), ("b", "B", None, None)]
    calls = []

    def fetch(a, b):
        calls.append((a, b))
        return rows(("c", a, 3.0))

    assert prices.ingest(w, fetch, date(2024, 1, 1), date(2024, 1, 5)) == "success"
    assert calls == [(date(2024, 1, 1), date(2024, 1, 1)), (date(2024, 1, 4), date(2024, 1, 5))]
    assert w.read("ingestion_log").first().status == "success"
    w.drop("ohlcv")
    assert not w.exists("ohlcv")


def test_paged_source(spark, tmp_path):
    page = {"data": [{"symbol": s, "date": "2024-01-02T00:00:00", "open": 1, "high": 2, "low": 1, "close": 2, "volume": None} for s in ("A", "B", "Z")]}
    (tmp_path / "page.json").write_text(json.dumps(page))
    spark.dataSource.register(prices.EodSource)
    df = spark.read.format("eod").option("symbols", "A,B").option("url", f"file://{tmp_path}/page.json").load()
    assert sorted((r.symbol, r.volume) for r in df.collect()) == [("A", None), ("B", None)]


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(date(2024, 1, 2), "a", 0.1234567), (date(2024, 1, 2), "b", float("nan")), (date(2024, 1, 3), "a", float("inf"))], "time date, asset string, w double")
    artifacts.write_wide(df, str(tmp_path / "wide"), "asset", "w")
    back = artifacts.to_long(artifacts.numeric(artifacts.with_time(artifacts.read_csv(spark, str(tmp_path / "wide")))))
    assert sorted((r.asset, r.w) for r in back.collect()) == [("a", 0.0), ("a", 0.123457), ("b", 0.0), ("b", 0.0)]
    artifacts.write_long(df, str(tmp_path), "weights", "s", "20240103_1200")
    assert artifacts.read_run(spark, str(tmp_path), "weights", "s", "20240103_1200", first="2024-01-03").count() == 1
    assert artifacts.tags(["x_20240101_0930.csv", "x_20240102.csv", "x_20240101_0930.csv", "none"]) == ["20240102", "20240101_0930"]
