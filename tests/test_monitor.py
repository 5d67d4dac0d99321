"""Monitoring functions against SQL written on its own, and against plain versions on small frames."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest

from quantloom.operators import monitor

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run():
    con = duckdb.connect()
    for name in ("lineitem", "part", "orders"):
        con.execute(f"create view {name} as select * from '{TABLES}/{name}.parquet'")
    return lambda sql: con.execute(sql).df()


@pytest.mark.parametrize("name", sorted(monitor.oracles()))
def test_queries(spark, run, name):
    got, want = monitor.QUERIES[name](spark, TABLES).toPandas(), run(monitor.oracles()[name])
    assert set(got.columns) == set(want.columns) and len(got) == len(want) > 0
    keys = [c for c in want.columns if want[c].dtype.kind not in "f"] + [c for c in want.columns if want[c].dtype.kind == "f"]
    for frame in (got, want):
        for c in keys:
            if frame[c].dtype == object or frame[c].dtype.kind == "M":
                frame[c] = frame[c].astype(str).str[:10] if c == "time" else frame[c]
    got, want = (f[keys].sort_values(keys).reset_index(drop=True) for f in (got, want))
    for c in keys:
        if want[c].dtype.kind == "f":
            assert got[c].to_numpy(float) == pytest.approx(want[c].to_numpy(float), abs=3e-5, rel=1e-4, nan_ok=True), c
        else:
            assert got[c].tolist() == want[c].tolist(), c


def projected(v, target, lo, hi):
    """Least shift by bisection."""
    a, z = v.min() - hi - 1, v.max() + 1
    for _ in range(200):
        m = (a + z) / 2
        a, z = (m, z) if np.clip(v - m, lo, hi).sum() > target else (a, m)
    return np.clip(v - m, lo, hi)


def test_constrained_book(spark):
    rng = np.random.default_rng(3)
    rows = [(dt.date(2020, 1, d), f"a{i:02d}", float(x)) for d in range(1, 6) for i, x in enumerate(rng.normal(0, 0.1, 24))] + [(dt.date(2020, 1, 1), "nothing", None)]
    got = monitor.constrained_book(spark.createDataFrame(rows, "time date, asset string, w double"), gross=1.0, net=0.2, least=0.03, most=0.12, pins=("a03",)).toPandas()
    assert len(got) == len(rows)
    for day, part in got.groupby("time"):
        w = part.set_index("asset").w
        before = pd.Series({a: x for t, a, x in rows if t == day and x is not None})
        for side, target in ((1, 0.6), (-1, 0.4)):
            v = before[np.sign(before) == side].abs()
            want = projected(v.to_numpy(), target, np.where(v.index == "a03", 0.03, 0.0), 0.12)
            assert (w[v.index] * side).to_numpy() == pytest.approx(want, abs=1e-6)


def test_rolling_risk_equals_the_full_matrix(spark):
    rng = np.random.default_rng(5)
    days, names, n = pd.date_range("2020-01-01", periods=30), list("abcdefgh"), 10
    ret, w = rng.normal(0, 0.01, (30, 8)), np.where(rng.random((30, 8)) < 0.3, 0.0, rng.normal(0, 0.1, (30, 8)))
    frame = pd.DataFrame([(d, a, w[i, j], ret[i, j]) for i, d in enumerate(days) for j, a in enumerate(names)], columns=["time", "asset", "w", "ret"])
    got = monitor.rolling_risk(spark.createDataFrame(frame), window=n, top=2).orderBy("time").toPandas()
    assert len(got) == 30 - n
    for i, row in enumerate(got.itertuples(), n):
        cov = np.cov(ret[i - n : i].T) * 252
        parts = np.sort(np.abs(w[i] * (cov @ w[i])))[::-1]
        assert row.vol == pytest.approx(np.sqrt(w[i] @ cov @ w[i]), rel=1e-9)
        assert row.top_share == pytest.approx(parts[:2].sum() / (w[i] @ cov @ w[i]), rel=1e-6)
        assert row.n_assets == np.count_nonzero(w[i])


def test_replaced_weights_and_short_histories(spark):
    a = spark.createDataFrame([("x", 0.1), ("y", 0.2)], "asset string, w double")
    b = spark.createDataFrame([("y", 0.0), ("z", 0.3)], "asset string, w double")
    assert sorted(map(tuple, monitor.replaced_weights(a, b).collect())) == [("x", 0.1), ("y", 0.0), ("z", 0.3)]
    ic = spark.createDataFrame([(dt.date(2020, 1, d), "f", 0.1) for d in range(1, 9)], "time date, factor string, ic double")
    assert tuple(monitor.signal_freshness(ic).first()) == (0.5, "unknown")
    few = spark.createDataFrame([(dt.date(2020, 1, d), "x", 0.01) for d in range(1, 9)], "time date, asset string, ret double")
    row = monitor.scorecard(few).first()
    assert row.n == 8 and row.sharpe == row.t_stat == 0.0
