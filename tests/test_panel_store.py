"""Clustered reads against the dense panel, and weights of the greatest Sharpe ratio against an active-set solution."""

import shutil
from datetime import date

import numpy as np
import pytest

from quantloom.operators import allocation
from quantloom.plans import panel
from quantloom.sources import panel_store

SF = "/root/testdata/sf0.001"


def test_reads_open_only_what_they_need(spark, monkeypatch):
    monkeypatch.setattr(panel_store, "BUCKET_ROWS", 900)
    bars = panel.panel(spark, SF)
    store = panel_store.PanelStore(spark, bars)
    assert store.buckets == 10
    want = bars.filter("asset = 'Brand#13' and time between date '1994-01-01' and date '1995-12-31'")
    got = store.of_asset("Brand#13", date(1994, 1, 1), date(1995, 12, 31))
    assert got.columns == bars.columns and got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(asset), " in plan
    day = store.latest(date(1996, 3, 15))
    assert day == bars.filter("time <= date '1996-03-15'").agg({"time": "max"}).first()[0]
    one = store.at(day)
    assert one.count() == 25 and one.exceptAll(bars.filter(bars.time == day)).isEmpty()
    assert "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().executedPlan().toString()
    assert store.at(store.latest(date(1900, 1, 1))).count() == 0 and store.of_asset("none").count() == 0


def test_built_anew_when_inputs_change(spark, tmp_path):
    for t in ("lineitem", "part"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    first = panel_store.panel_store(spark, str(tmp_path))
    assert panel_store.panel_store(spark, str(tmp_path)) is first
    spark.read.parquet(f"{SF}/lineitem.parquet").limit(500).toPandas().to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
    assert panel_store.panel_store(spark, str(tmp_path)) is not first


def best_subset(r):
    """Of all sets of names whose unconstrained weights are not negative, the one of the greatest ratio."""
    mu, cov = r.mean(0), np.cov(r.T, bias=True)
    found = (-np.inf, None)
    n = len(mu)
    for mask in range(1, 1 << n):
        at = [k for k in range(n) if mask >> k & 1]
        w = np.linalg.solve(cov[np.ix_(at, at)], mu[at])
        if w.sum() <= 0 or (w < -1e-12).any():
            continue
        w = w / w.sum()
        ratio = w @ mu[at] / np.sqrt(w @ cov[np.ix_(at, at)] @ w)
        if ratio > found[0]:
            found = ratio, {k: x for k, x in zip(at, w, strict=True)}
    return found


def test_max_sharpe(spark):
    rng = np.random.default_rng(11)
    r = rng.normal([0.002, 0.001, -0.001, 0.0015, 0.0], [0.02, 0.01, 0.01, 0.03, 0.005], (120, 5))
    r[:, 3] += 0.5 * r[:, 0]
    rows = [(date.fromordinal(738000 + t), f"s{k}", float(r[t, k])) for t in range(120) for k in range(5)]
    frame = spark.createDataFrame(rows, "time date, strategy string, r double").coalesce(2)
    ratio, want = best_subset(r)
    got = {int(x.strategy[1:]): x for x in allocation.max_sharpe(frame).collect()}
    assert sum(x.w for x in got.values()) == pytest.approx(1) and got[0].sharpe == pytest.approx(ratio * np.sqrt(252), rel=1e-4)
    for k in range(5):
        assert got[k].w == pytest.approx(want.get(k, 0.0), abs=0.02) and got[k].mean == pytest.approx(r[:, k].mean() * 252)
    capped = allocation.max_sharpe(frame, least=0.05, most=0.4, steps=20).collect()
    assert all(0.05 - 1e-9 <= x.w <= 0.4 + 1e-9 for x in capped) and sum(x.w for x in capped) == pytest.approx(1)
    assert allocation.max_sharpe(frame.filter("false")).count() == 0
