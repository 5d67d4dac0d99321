"""Risk model, tests of returns, as-of joins, indices, sleeves and forecasts against numpy, pandas and closed forms."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import special
from quantloom.operators import asof, forecast, indices, inference, risk_model, sleeves

DAYS = [date(2024, 1, 1) + timedelta(days=k) for k in range(200)]


def t_tail(t, df):
    """Two-sided p-value of Student's t for whole df by its finite series, terms in the order of the textbook."""
    angle = math.atan(abs(t) / math.sqrt(df))
    c = math.cos(angle)
    if df % 2:
        total, term = 0.0, c
        for k in range((df - 1) // 2):
            total += term
            term *= c * c * (2 * k + 2) / (2 * k + 3)
        return 1 - 2 / math.pi * (angle + math.sin(angle) * total)
    total, term = 0.0, 1.0
    for k in range(df // 2):
        total += term
        term *= c * c * (2 * k + 1) / (2 * k + 2)
    return 1 - math.sin(angle) * total


def test_special_functions(spark):
    ts = [(t, df) for t in (0.0, 0.3, -1.1, 2.5, 7.0) for df in (1, 2, 3, 10, 51, 400, 5001)]
    got = spark.createDataFrame(ts, "t double, df int").select("t", "df", special.t_p_value(F.col("t"), F.col("df")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(t_tail(r.t, r.df), abs=1e-10), r
    chi = [(x, k) for x in (0.0, 0.4, 3.0, 11.0, 60.0) for k in (1, 2, 4, 10, 60)]
    for r in spark.createDataFrame(chi, "x double, k int").select("x", "k", special.chi2_p_value(F.col("x"), F.col("k")).alias("p")).collect():
        if r.k == 1:
            want = math.erfc(math.sqrt(r.x / 2))
        else:
            want = math.exp(-r.x / 2) * sum((r.x / 2) ** j / math.factorial(j) for j in range(r.k // 2))
        assert r.p == pytest.approx(want, abs=1e-10), r
    row = spark.range(1).select(
        special.log_gamma(F.lit(0.5)), special.log_gamma(F.lit(171.3)), special.log_gamma(F.lit(1e-3)), special.normal_p_value(F.lit(1.96)), special.f_p_value(F.lit(3.0), F.lit(2), F.lit(8)), special.beta_regularised(F.lit(2.0), F.lit(3.0), F.lit(0.25)), special.beta_regularised(F.lit(2.0), F.lit(-1.0), F.lit(0.25)), special.beta_regularised(F.lit(2.0), F.lit(1.0), F.lit(0)), special.beta_regularised(F.lit(2.0), F.lit(1.0), F.lit(1))
    ).first()
    want = [math.lgamma(0.5), math.lgamma(171.3), math.lgamma(1e-3), math.erfc(1.96 / math.sqrt(2)), (1 + 2 * 3.0 / 8) ** -4, 6 * 0.25**2 - 8 * 0.25**3 + 3 * 0.25**4, None, 0.0, 1.0]
    for a, b in zip(row, want, strict=True):
        assert a == (None if b is None else pytest.approx(b, rel=1e-11, abs=1e-13))


def test_tests_of_returns(spark):
    rng = np.random.default_rng(1)
    x = {"a": rng.normal(0.05, 1, 60), "b": rng.exponential(1, 60), "c": np.zeros(60), "d": np.array([0.5])}
    frame = spark.createDataFrame([(DAYS[k], n, float(v)) for n, vs in x.items() for k, v in enumerate(vs)] + [(DAYS[0], "a", None)], "time date, asset string, ret double")
    got = {r.asset: r for r in inference.mean_test(frame, "asset").collect()}
    for n in "ab":
        t = x[n].mean() / (x[n].std(ddof=1) / math.sqrt(60))
        assert (got[n].n, got[n].t_stat, got[n].p_value) == (60, pytest.approx(t), pytest.approx(t_tail(t, 59), abs=1e-10))
    assert got["b"].significant and got["c"].p_value is None and got["d"].t_stat is None
    jb = {r.asset: r for r in inference.jarque_bera(frame, "asset").collect()}
    z = (x["b"] - x["b"].mean()) / x["b"].std()
    want = 60 / 6 * ((z**3).mean() ** 2 + ((z**4).mean() - 3) ** 2 / 4)
    assert jb["b"].statistic == pytest.approx(want) and jb["b"].p_value == pytest.approx(math.exp(-want / 2)) and jb["c"].p_value is None
    pair = inference.paired_test(frame.filter("asset in ('a', 'b')").withColumnRenamed("ret", "r"), "asset").collect()
    d = x["a"] - x["b"]
    assert len(pair) == 1 and pair[0].p_value == pytest.approx(t_tail(d.mean() / (d.std(ddof=1) / math.sqrt(60)), 59), abs=1e-10)


def test_risk_model(spark):
    rng = np.random.default_rng(2)
    names, factors = [f"n{k}" for k in range(7)], ["f", "g", "h"]
    x, f = rng.normal(size=(7, 3)), rng.normal(size=(90, 3)) / 50
    spec, bench = np.abs(rng.normal(size=7)) / 60, np.full(7, 1 / 7)
    books = {"p": rng.normal(size=7) / 4, "q": np.array([0.5, 0.5, 0, 0, 0, 0, 0.0])}
    cov = pd.DataFrame(f[-60:]).cov().to_numpy()
    returns = spark.createDataFrame([(DAYS[t], factors[k], float(f[t, k])) for t in range(90) for k in range(3)], "time date, factor string, f double")
    covariance = risk_model.factor_covariance(returns, 60)
    for r in covariance.collect():
        assert r["cov"] == pytest.approx(cov[factors.index(r.a), factors.index(r.b)], abs=1e-12)
    decayed = pd.DataFrame(f[-60:]).ewm(halflife=15).cov().iloc[-3:].to_numpy()
    for r in risk_model.factor_covariance(returns, 60, 15).collect():
        assert r["cov"] == pytest.approx(decayed[factors.index(r.a), factors.index(r.b)], abs=1e-12)
    weights = spark.createDataFrame([(b, n, float(w) / 2) for b, ws in books.items() for n, w in zip(names, ws, strict=True)] * 2 + [("p", "unknown", 1.0)], "book string, asset string, w double")
    exposures = spark.createDataFrame([(n, factors[k], float(x[i, k])) for i, n in enumerate(names) for k in range(3)], "asset string, factor string, x double")
    specific = spark.createDataFrame([(n, float(s)) for n, s in zip(names, spec, strict=True)], "asset string, specific double")
    equal = spark.createDataFrame([(n, 1 / 7) for n in names], "asset string, w double")
    got = {r.book: r for r in risk_model.ex_ante_risk(weights, exposures, covariance, specific, equal).collect()}
    year = math.sqrt(252)
    for b, w in books.items():
        e, a = x.T @ w, x.T @ (w - bench)
        v, s = e @ cov @ e, (w**2 * spec**2).sum()
        assert got[b].factor_risk == pytest.approx(year * math.sqrt(v)) and got[b].specific_risk == pytest.approx(year * math.sqrt(s))
        assert got[b].total_risk == pytest.approx(year * math.sqrt(v + s))
        assert got[b].tracking_error == pytest.approx(year * math.sqrt(a @ cov @ a + ((w - bench) ** 2 * spec**2).sum()))
        assert got[b].diversification == pytest.approx((np.abs(w) * spec).sum() / (year * math.sqrt(v + s)))
        assert got[b].correlation == pytest.approx(year * np.abs(e * (cov @ e)).sum() / math.sqrt(v) - year * math.sqrt(v), abs=1e-9)
    parts = risk_model.contributions(weights, exposures, covariance).groupBy("book").agg(F.sum("contribution").alias("c")).collect()
    assert {r.book: r.c for r in parts} == {b: pytest.approx(got[b].factor_risk) for b in books}
    plain = {r.book: r for r in risk_model.ex_ante_risk(weights, exposures, covariance).collect()}
    assert plain["q"].specific_risk == pytest.approx(year * math.sqrt(0.04 * 0.5)) and plain["q"].tracking_error == 0 and plain["q"].diversification == 1


@pytest.mark.parametrize("spans", [1, 5, 64])
@pytest.mark.parametrize("strict, forward", [(False, False), (True, False), (False, True), (True, True)])
def test_asof_join(spark, spans, strict, forward):
    rng = np.random.default_rng(7)
    base = datetime(2024, 1, 1)
    keys = ["a"] * 60 + ["b"] * 5 + ["only"] * 3
    left = pd.DataFrame({"id": range(len(keys)), "key": keys, "at": [base + timedelta(minutes=int(m)) for m in rng.integers(0, 300, len(keys))]})
    rk = ["a"] * 40 + ["b"] * 3 + ["other"] * 2
    right = pd.DataFrame({"key": rk, "at": [base + timedelta(minutes=int(m)) for m in rng.integers(30, 260, len(rk))], "v": rng.integers(0, 99, len(rk))})
    kept = right.sort_values("v").groupby(["key", "at"], as_index=False).last().sort_values("at")
    kept["right_at"] = kept["at"]
    want = pd.merge_asof(left.sort_values("at"), kept, on="at", by="key", allow_exact_matches=not strict, direction="forward" if forward else "backward").sort_values("id")
    rows = [(int(r.id), r.key, r.at.to_pydatetime()) for r in left.itertuples()] + [(100, None, base), (101, "a", None)]
    l = spark.createDataFrame(rows, "id long, key string, at timestamp")  # noqa: E741
    r = spark.createDataFrame([(x.key, x.at.to_pydatetime(), int(x.v)) for x in right.itertuples()] + [(None, base, 1), ("a", None, 2)], "key string, at timestamp, v long")
    got = {x.id: x for x in asof.asof_join(l, r, "at", ("key",), strict=strict, forward=forward, spans=spans).collect()}
    assert len(got) == len(rows) and got[100].v is None and got[101].v is None
    for x in want.itertuples():
        assert (got[x.id].v, got[x.id].right_at) == ((None, None) if pd.isna(x.v) else (x.v, x.right_at.to_pydatetime()))
    near = asof.asof_join(l, r, "at", ("key",), within=F.col("right_at") >= F.col("at") - F.expr("interval 5 minutes"), spans=spans)
    assert near.count() == len(rows) and near.filter("v is not null and right_at < at - interval 5 minutes").isEmpty()
    plan = l._jdf and asof.asof_join(l, r, "at", ("key",))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        asof.asof_join(l.withColumn("v", F.lit(1)), r, "at", ("key",))


def test_indices(spark):
    caps = {"a": [5, 5, 5, 1], "b": [4, 1, 4, 4], "c": [1, 4, 1, 5], "d": [0, 0, 0, 0]}
    days = [date(2024, 1 + 3 * q, 1) for q in range(4)] + [date(2025, 1, 1)]
    frame = spark.createDataFrame([(days[q], n, float(c)) for n, cs in caps.items() for q, c in enumerate(cs)], "time date, asset string, cap double")
    m = indices.ranked_membership(frame, 2)
    assert sorted((r.asset, r.start, r.end) for r in m.collect()) == [("a", days[1], days[4]), ("b", days[1], days[2]), ("b", days[3], None), ("c", days[2], days[3]), ("c", days[4], None)]
    bars = [(d, n, 0.1 * (k + 1) if n == "a" else 0.0, 10.0, float(k)) for k, d in enumerate([days[1], days[1] + timedelta(1), days[1] + timedelta(2), days[2]]) for n in "abc"]
    panel = indices.index_panel(spark.createDataFrame(bars, "time date, asset string, ret double, close double, vol double"), m)
    assert sorted((r.time, r.asset) for r in panel.collect()) == [(d, n) for d, ns in ((days[1], "ab"), (days[1] + timedelta(1), "ab"), (days[1] + timedelta(2), "ab"), (days[2], "ac")) for n in ns]
    book = {(r.time, r.asset): r.w for r in indices.index_book(panel, "equal", "quarter").collect()}
    grown = 0.5 * 1.2 * 1.3
    assert book[days[1], "a"] == 0.5 and book[days[1] + timedelta(2), "a"] == pytest.approx(grown / (grown + 0.5)) and book[days[2], "c"] == 0.5
    earned = {r.time: r.r for r in indices.index_returns(panel, indices.index_book(panel, "equal", "quarter")).collect()}
    assert earned[days[1] + timedelta(1)] == pytest.approx(0.5 * 0.2) and earned[days[2]] == pytest.approx(book[days[1] + timedelta(2), "a"] * 0.4)
    cap = {(r.time, r.asset): r.w for r in indices.index_caps(panel).collect()}
    assert cap[days[1], "a"] == 0 and cap[days[2], "a"] == 0.5
    with pytest.raises(ValueError):
        indices.index_book(panel, "price")


def spearman(a, b):
    a, b = pd.Series(a).rank().to_numpy(), pd.Series(b).rank().to_numpy()
    return 0.0 if a.std() * b.std() <= 1e-12 else float(((a - a.mean()) * (b - b.mean())).mean() / (a.std() * b.std()))


def ewma(x, lam):
    out, s, w = [], 0.0, 0.0
    for v in x:
        s, w = lam * s + (1 - lam) * v, lam * w + (1 - lam)
        out.append(s / (w + 1e-12))
    return np.array(out)


def unlike(z):
    """One less the mean absolute correlation with the others; rows are members."""
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.nan_to_num(np.corrcoef(z))
    np.fill_diagonal(c, 0)
    return 1 - np.abs(c).mean(1)


def test_sleeves(spark):
    rng = np.random.default_rng(5)
    T, N, factors = 30, 8, ["p", "q", "r", "s"]
    z = {f: rng.normal(size=(T, N)).round(4) for f in factors}
    z["q"] = (z["p"] + 0.3 * z["q"]).round(4)
    z["s"][3] = 0.0
    ret = rng.normal(size=(T, N)) / 50
    fwd = {h: np.vstack([np.expm1(np.log1p(ret[t + 1 : t + 1 + h]).sum(0)) if t + h < T else np.zeros(N) for t in range(T)]).round(9) for h in (2, 3)}
    rows = [(DAYS[t], f"n{k}", *(float(z[f][t, k]) for f in factors), float(ret[t, k]), *(float(fwd[h][t, k]) for h in (2, 3))) for t in range(T) for k in range(N)]
    panel = spark.createDataFrame(rows, f"time date, asset string, {', '.join(f + ' double' for f in factors)}, ret double, fwd_2 double, fwd_3 double")
    parts = (sleeves.Sleeve("one", ("p", "q", "r"), (2, 3), -0.6), sleeves.Sleeve("two", ("r", "s"), (3,), 0.8))
    rule = sleeves.Weighting(decay=0.9, clip=0.2, penalty=0.3, least_diversity=0.25, least_weight=0.05, boost=0.1, boost_rows=4)
    smooth = {(f, h): ewma(np.concatenate([[0.0], np.clip([spearman(z[f][t], fwd[h][t]) for t in range(T)], -0.2, 0.2)[:-1]]), 0.9) for f in factors for h in (2, 3)}
    want, weights = {}, {}
    for s in parts:
        pen = np.array([np.maximum(unlike(np.stack([z[f][t] for f in s.factors])), 0.25) for t in range(T)])
        total = 0
        for h in s.horizons:
            raw = np.maximum(np.stack([smooth[f, h] for f in s.factors], 1), 0)
            sums = raw.sum(1, keepdims=True)
            w = np.where(sums > 1e-12, raw / np.where(sums > 1e-12, sums, 1), 1 / len(s.factors)) * (1 - 0.3 * (1 - pen))
            w = w / (w.sum(1, keepdims=True) + 1e-12)
            w = np.maximum(w, 0.05) / (np.maximum(w, 0.05).sum(1, keepdims=True) + 1e-12)
            recent = pd.DataFrame(np.stack([smooth[f, h] for f in s.factors], 1)).rolling(4, min_periods=1).mean().to_numpy()
            low, high = recent.min(1, keepdims=True), recent.max(1, keepdims=True)
            w = w * np.where(high - low > 1e-12, 1 + 0.1 * (recent - low) / (high - low + 1e-12), 1.0)
            total = total + w / (w.sum(1, keepdims=True) + 1e-12) / len(s.horizons)
        weights[s.name] = total
        want[s.name] = sum(total[:, [k]] * z[f] for k, f in enumerate(s.factors))
    scores, shares = sleeves.sleeve_scores(panel, parts, rule)
    for r in scores.collect():
        assert r.score == pytest.approx(want[r.sleeve][DAYS.index(r.time), int(r.asset[1:])], abs=1e-8)
    for r in shares.collect():
        s = next(s for s in parts if s.name == r.sleeve)
        assert r.w == pytest.approx(weights[r.sleeve][DAYS.index(r.time), s.factors.index(r.factor)], abs=1e-8)
    alloc = sleeves.Allocation(horizon=3, decay=0.8, penalty=0.35, least_weight=0.12, drawdown_rows=6, full_stress=0.02)
    ic = np.stack([ewma(np.concatenate([[0.0], [spearman(want[s.name][t].round(9), fwd[3][t]) for t in range(T)][:-1]]), 0.8) for s in parts], 1)
    pen = np.array([np.clip(unlike(np.stack([want[s.name][t] for s in parts])), 0.25, 1) for t in range(T)])
    growth = np.cumprod(1 + ret.mean(1))
    peak = pd.Series(growth).rolling(6, min_periods=1).max().to_numpy()
    stress = np.clip((peak - growth) / peak / 0.02, 0, 1)
    raw = np.maximum(np.maximum(ic, 0) * np.clip(1 - 0.35 * (1 - pen), 0.25, 1) * (1 + np.outer(stress, [-0.6, 0.8])), 0.12)
    raw /= raw.sum(1, keepdims=True)
    got = sleeves.sleeve_weights(scores, panel, parts, alloc)
    for r in got.collect():
        assert r.w == pytest.approx(raw[DAYS.index(r.time), [s.name for s in parts].index(r.sleeve)], abs=1e-7)
    both = {(r.time, r.asset): r.score for r in sleeves.combined(scores, got).collect()}
    assert both[DAYS[9], "n2"] == pytest.approx(sum(raw[9, k] * want[s.name][9, 2] for k, s in enumerate(parts)), abs=1e-7)
    assert sleeves.factor_shares(shares, got).groupBy("time").agg(F.sum("w").alias("w")).filter("abs(w - 1) > 1e-6").isEmpty()


def test_forecast(spark):
    rng = np.random.default_rng(9)
    T = 160
    r = np.zeros(T)
    for t in range(1, T):
        r[t] = 0.7 * r[t - 1] + rng.normal() / 100
    series = spark.createDataFrame([("b", DAYS[t], float(r[t]), float(rng.normal()), 1.0) for t in range(T)], "book string, time date, r double, gross double, net double")
    frame, names = forecast.features(series, ("gross", "net"), lags=(1, 2), windows=(5, 10))
    rows = frame.orderBy("time").collect()
    assert len(rows) == T - 9 and rows[-1].target is None
    first = rows[0].asDict()
    assert first["lag_2"] == pytest.approx(r[7]) and first["mean_5"] == pytest.approx(r[5:10].mean()) and first["std_10"] == pytest.approx(r[:10].std(ddof=1)) and first["target"] == pytest.approx(r[10])
    # no feature of a row changes when later values do
    changed = series.withColumn("r", F.when(F.col("time") > DAYS[80], F.lit(9.0)).otherwise(F.col("r"))).withColumn("gross", F.when(F.col("time") > DAYS[80], F.lit(-5.0)).otherwise(F.col("gross")))
    other = {x.time: x for x in forecast.features(changed, ("gross", "net"), lags=(1, 2), windows=(5, 10))[0].collect()}
    for x in rows:
        if x.time <= DAYS[80]:
            assert [x[n] for n in names] == pytest.approx([other[x.time][n] for n in names])
    rule = forecast.Forecast(trees=8, depth=3, boosts=4, boost_depth=2, draws=40)
    out, scores = forecast.forecast(frame, names, rule)
    got = out.orderBy("time").toPandas()
    assert len(got) == len(rows) and got.learn.sum() == math.floor((T - 10) * 0.8) and not got.learn.iloc[-1]
    assert (got.lower_95 <= got.lower_80).all() and (got.lower_80 <= got.upper_80).all() and (got.upper_80 <= got.upper_95).all() and (got["std"] >= 0).all()
    assert np.allclose(got.forecast, 0.5 * got.forest + 0.5 * got.boosted)
    r2 = {(x.learn, x.model): x.r2 for x in scores.collect()}
    assert r2[True, "forecast"] > 0.3 and len(r2) == 6
