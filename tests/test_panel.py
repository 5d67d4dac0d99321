"""Panel operators against DuckDB at the smallest scale, and recursions against plain Python."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from quantloom import queries as Q
from quantloom.functions import dsl
from quantloom.functions import factors as X
from quantloom.plans import panel, strategies

FOLDER = "/root/testdata/sf0.001"
SOME = ("universe_as_of", "date_chunks", "missing_days", "upserted_universe", "insert_ignored", "merged_sources", "price_checks", "rank_ic", "composite_score", "correlation_penalty", "quintile_returns", "kendall_ic", "budget", "cost_schemes", "trade_list", "drawdown", "brinson_by_sector", "regime_durations", "trade_islands", "stock_grades", "factors_reversal", "factors_value", "math_primitives", "batch_sessions", "stream_hourly_bars", "stream_sliding_volume")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "part", "events"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_same_rows_in_both_engines(spark, duck, name):
    a = Q.queries()[name](spark, FOLDER).toPandas()
    b = duck.sql(Q.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    for x in (a, b):
        for c in cols:
            v = x[c].dropna()
            if len(v) and hasattr(v.iloc[0], "year"):
                x[c] = pd.to_datetime(x[c]).astype("datetime64[us]")
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=1e-6)


def test_every_text_has_both_dialects():
    for name, text in Q.TEXTS.items():
        assert text(dsl.Dialect("spark", "/x")) and text(dsl.DUCK), name
    assert set(Q.oracle_sql()) <= set(Q.queries())


def panel_of(spark, closes):
    rows = [(pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=t), a, c, c, c, c, 1.0 + t, 1.0, float(t)) for a, s in closes.items() for t, c in enumerate(s)]
    return spark.createDataFrame(rows, "time date, asset string, open double, high double, low double, close double, vol double, is_liquid double, t double")


def test_recursions_and_gaps(spark):
    x = [1.0, 2.0, None, 5.0, 4.0, None, 7.0]
    rows = [(pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=t), "a", v, float(t)) for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "time date, asset string, x double, t double")
    got = dsl.compute(df, {"e": dsl.ewma(dsl.col("x"), 0.9), "m": dsl.ema(dsl.col("x"), 0.5)}).orderBy("time").toPandas()
    s = w = 0.0
    m = x[0]
    for t, v in enumerate(x):
        if v is not None:
            s, w = 0.9 * s + 0.1 * v, 0.9 * w + 0.1
        else:
            s, w = 0.9 * s, 0.9 * w
        m = m if t == 0 else 0.5 * m + 0.5 * (v or 0)
        assert got.e[t] == pytest.approx(s / (w + 1e-12)) and got.m[t] == pytest.approx(m)


def test_score_of_constant_and_odd_rows(spark):
    p = panel_of(spark, {"a": [1.0, 1.0], "b": [1.0, 1.0], "c": [0.0, 1.0]})
    got = dsl.compute(p, {"z": dsl.robust_z(dsl.col("close"))}).toPandas()
    assert got.z.tolist().count(0.0) == 5 and got.z.min() == -5
    ret = dsl.compute(p, {"r": X.Base().ret}).toPandas()
    assert np.isfinite(ret.r).all()


def test_registry_is_complete():
    known = X.registry()
    for group in (X.V4_24, X.DEFENSIVE, X.ALPHA, X.QUALITY, X.TIMEFRAMES, X.OU, X.GLFT, X.GLFT_2, X.GLFT_3, X.NEURAL):
        assert set(group) <= set(known)
    assert X.Windows().scaled(0.1).week == 2 and X.Windows().scaled(2).mom == 168
    assert "reversal" in X.categories() and X.names("reversal") == ["srev", "lrev"]


def test_kendall_of_every_date(spark):
    """Against all pairs of each date in numpy: both engines share one text, so their agreement says nothing of dates left out."""
    from quantloom.operators.book import signals

    rows = spark.sql(f"select time, asset, score, round(fwd, 9) fwd from {signals(dsl.Dialect('spark', FOLDER))} s").toPandas()
    want = {}
    for time, day in rows.groupby("time"):
        i, j = np.triu_indices(len(day), 1)
        if not len(i):
            continue
        a, b = (np.sign(v[i] - v[j]) for v in (day.score.to_numpy(), day.fwd.to_numpy()))
        under = np.sqrt(np.abs(a).sum()) * np.sqrt(np.abs(b).sum())
        want[time] = ((a * b).sum() / under if under else None, len(i))
    got = {r.time: (r.tau, r.pairs) for r in Q.queries()["kendall_ic"](spark, FOLDER).collect()}
    assert sorted(got) == sorted(want) and len(got) > 300
    for time, (tau, pairs) in want.items():
        assert got[time] == (tau if tau is None else pytest.approx(tau, abs=1e-6), pairs)


def test_lines_are_read_once(spark, monkeypatch):
    """The panel stands on stored bars, and strategies of one call share it with their returns."""
    bars = panel.panel(spark, FOLDER)
    want = spark.sql(f"select * from {panel.panel_sql(dsl.Dialect('spark', FOLDER))}")
    lines = lambda df: [f for f in df.inputFiles() if "lineitem" in f]
    assert lines(want) and not lines(bars)
    assert bars.dtypes == want.dtypes and bars.exceptAll(want).isEmpty() and want.exceptAll(bars).isEmpty()
    seen = []
    monkeypatch.setattr(strategies, "factor_table", lambda b, s: seen.append(b) or b)
    monkeypatch.setattr(strategies, "scores", lambda t, s: t.selectExpr(f"'{s.name}' strategy", "time", "asset", "0d w", "1d budget"))
    monkeypatch.setattr(strategies, "build", lambda t, *_: t)
    monkeypatch.setattr(strategies, "stored", lambda df, _: df)
    monkeypatch.setattr(strategies, "drop_stored", lambda _: None)
    out = Q.strategy_diagnostics(spark, FOLDER)
    assert not lines(out) and len(seen) == 2 and seen[0] is seen[1]
    assert out.count() == 2 * want.select("time").distinct().count()


def test_panel_of_no_lines(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/lineitem.parquet").filter("false").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{FOLDER}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    assert panel.panel(spark, str(tmp_path)).count() == 0
