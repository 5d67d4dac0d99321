"""Regimes, overlays and cost buckets against plain pandas versions of their definitions."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from quantloom import queries as panel
from quantloom.functions import dsl as X
from quantloom.operators.book import book, regimes, signals

TABLES = "/root/testdata/sf0.001"


def regimes_by_pandas(r: pd.Series, lookback: int, short: int) -> pd.Series:
    vol = r.rolling(lookback).std() * np.sqrt(252)
    z = (vol - vol.rolling(short).mean()) / (vol.rolling(short).std() + 1e-12)
    past = r.rolling(lookback).mean().shift(1).fillna(0)
    corr = pd.Series([np.nan if i < short - 1 or past[i - short + 1 : i + 1].std() < 1e-12 else np.corrcoef(r[i - short + 1 : i + 1], past[i - short + 1 : i + 1])[0, 1] for i in range(len(r))])
    skew = r.rolling(short).apply(lambda x: ((x - x.mean()) ** 3).mean() / ((x - x.mean()) ** 2).mean() ** 1.5, raw=True)
    out = pd.Series("normal", r.index)
    out[(z > 1) & (skew < -0.5)] = "crisis"
    out[(corr.abs() > 0.3) & ~(z > 1)] = "trend"
    out[z < -0.5] = "calm"
    return out


def test_regimes(spark):
    rng = np.random.default_rng(4)
    r = pd.Series(rng.normal(0, 0.01, 420) * np.where(np.arange(420) % 90 < 20, 2.5, 1))
    r[rng.choice(420, 12)] -= 0.06
    pd_frame = pd.DataFrame({"time": pd.date_range("2020-01-01", periods=420), "r": r})
    spark.createDataFrame(pd_frame).createOrReplaceTempView("some_returns")
    want = regimes_by_pandas(r, 60, 20)
    assert set(want) == {"calm", "trend", "crisis", "normal"}
    got = spark.sql(f"select time, regime from {regimes(X.SPARK, 60, 20, '(select * from some_returns)')} x order by time").toPandas()
    assert got.regime.tolist() == want.tolist()


@pytest.fixture(scope="module")
def run():
    con = duckdb.connect()
    for name in ("lineitem", "part", "orders"):
        con.execute(f"create view {name} as select * from '{TABLES}/{name}.parquet'")
    return lambda sql: con.execute(sql).df()


def test_overlay_follows_the_market(run):
    got = run(panel.oracle_sql()["risk_overlay"]).pivot(index="time", columns="asset", values="dd_scale")
    ret = run(f"select time, asset, ret from {signals(X.DUCK)} s").pivot(index="time", columns="asset", values="ret")
    growth = (1 + ret.fillna(0).mean(axis=1)).cumprod()
    peak = growth.rolling(126, min_periods=1).max()
    want = (1 - 0.6 * (peak - growth) / (peak + 1e-12)).clip(0.55, 1.25)
    assert (got.nunique(axis=1) == 1).all() and want.nunique() > 10
    assert got.iloc[:, 0].to_numpy() == pytest.approx(want.to_numpy(), abs=2e-6)


def test_cost_buckets(run):
    got = run(panel.oracle_sql()["cost_by_size"]).set_index("size_bucket")
    b = run(f"select w, wl from {book(X.DUCK)} b")
    x = (b.w - b.wl).abs().round(10)
    x = x[x > 1e-12]
    edges = x.quantile([0.2, 0.4, 0.6, 0.8]).round(10).to_numpy()
    bucket = np.array(["XS", "S", "M", "L", "XL"])[np.searchsorted(edges, x, "left")]
    want = x.groupby(bucket).agg(["count", "sum"])
    assert got.n_trades.to_dict() == want["count"].to_dict()
    assert got.total_tc.sort_index().to_numpy() == pytest.approx((want["sum"] * 10e-4).sort_index().to_numpy(), abs=1e-6)
