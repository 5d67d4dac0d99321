"""Exponential means over long series against a plain loop."""

import numpy as np
import pytest

from quantloom.functions import dsl as X

ROWS = 20_000


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    x = rng.normal(size=ROWS)
    x[rng.random(ROWS) < 0.05] = np.nan
    x[9_000:13_000] = np.nan  # longer than a block
    return x


@pytest.fixture(scope="module")
def panel(spark, series):
    rows = [(t, a, t, None if np.isnan(v) else float(v) * s) for a, s in (("A", 1.0), ("B", -2.0)) for t, v in enumerate(series)]
    return spark.createDataFrame(rows, "time long, asset string, t long, x double")


def ema_loop(x, alpha, mp):
    out, s = [], 0.0
    for t, v in enumerate(np.nan_to_num(x)):
        s = v if t == 0 else (1 - alpha) * s + alpha * v
        out.append(s if t >= mp - 1 else 0.0)
    return out


def ewma_loop(x, lam):
    out, s, w = [], 0.0, 0.0
    for v in x:
        s, w = (lam * s + (1 - lam) * v, lam * w + (1 - lam)) if not np.isnan(v) else (lam * s, lam * w)
        out.append(s / (w + X.EPS))
    return out


def test_long_series(panel, series):
    outputs = {"fast": X.ema(X.col("x"), 2 / 6), "slow": X.ema(X.col("x"), 2 / 21, 20), "low": X.ewma(X.col("x"), 0.9), "high": X.ewma(X.col("x"), 0.999)}
    got = X.compute(panel, outputs).orderBy("asset", "time").toPandas()
    assert got.notna().all().all()
    for asset, scale in (("A", 1.0), ("B", -2.0)):
        x, mine = series * scale, got[got.asset == asset]
        assert np.allclose(mine.fast, ema_loop(x, 2 / 6, 1), rtol=0, atol=1e-9)
        assert np.allclose(mine.slow, ema_loop(x, 2 / 21, 20), rtol=0, atol=1e-9)
        assert np.allclose(mine.low, ewma_loop(x, 0.9), rtol=0, atol=1e-9)
        assert np.allclose(mine.high, ewma_loop(x, 0.999), rtol=0, atol=1e-9)
