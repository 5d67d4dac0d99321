"""Panels kept by day, freshness, metrics and requests kept apart."""

import io
import itertools
import json
import time
import urllib.request
from datetime import date

from quantloom.sources import cache, prices


def panel(spark, days=3):
    return spark.createDataFrame([(date(2024, 1, d), a, 1.0, 2.0, 0.5, 1.5, 10.0) for d in range(1, days + 1) for a in "xy"], "time date, asset string, open double, high double, low double, close double, vol double")


def test_valid_panels(spark):
    p = panel(spark)
    assert cache.valid_panel(p) and not cache.valid_panel(None) and not cache.valid_panel(p.drop("vol"))
    assert not cache.valid_panel(cache.empty_panel(spark)) and not cache.valid_panel(p.union(p))
    assert cache.empty_panel(spark).schema.names == p.schema.names


def test_freshness(spark):
    p = panel(spark, 5)  # to Friday, 5 January 2024
    assert not cache.needs_bars(p, date(2024, 1, 7)) and cache.needs_bars(p, date(2024, 1, 8))
    assert not cache.needs_bars(p, date(2024, 1, 8), holidays={date(2024, 1, 8)})
    assert not cache.needs_bars(p, date(2024, 6, 1)) and cache.needs_bars(p, date(2024, 6, 1), force=True)
    assert not cache.needs_bars(None, date(2024, 1, 8)) and cache.needs_bars(cache.empty_panel(spark), date(2024, 1, 8), force=True)
    assert cache.missing_days(date(2024, 1, 4), date(2024, 1, 9), 30) == [date(2024, 1, d) for d in (5, 8, 9)]


def test_cache(spark, tmp_path):
    c = cache.PanelCache(spark, str(tmp_path / "cache"))
    assert c.info() == [] and c.load("large", date(2024, 1, 9)) is None
    for d in (2, 8, 9):
        assert c.save("large", panel(spark), date(2024, 1, d))
    assert not c.save("small", panel(spark).limit(0), date(2024, 1, 9))
    assert c.save("large", panel(spark, 4), date(2024, 1, 9)) and c.load("large", date(2024, 1, 9)).count() == 8
    assert c.cleanup(date(2024, 1, 9)) == 1 and [e["day"].day for e in c.info()] == [9, 8]
    (tmp_path / "cache" / "20240109_torn").mkdir()
    panel(spark).drop("close").write.parquet(str(tmp_path / "cache" / "20240109_odd"))
    assert not c.is_valid("torn", date(2024, 1, 9))
    assert c.repair() == {"valid": 2, "removed": 2} and c.clear(date(2024, 1, 8)) == 1 and c.clear() == 1 and c.info() == []


def test_metrics_are_replaced(spark, tmp_path):
    w = prices.Warehouse(spark, str(tmp_path / "w"))
    listed = spark.createDataFrame([("hash_rate", "blocks")], "metric string, about string")
    rows = lambda v: lambda lo, hi: spark.createDataFrame([("hash_rate", date(2024, 1, d), v) for d in range(lo.day, hi.day + 1)], "metric string, date date, value double")
    assert prices.ingest_metrics(w, listed, rows(1.0), date(2024, 1, 1), date(2024, 1, 3)) == "success"
    assert prices.ingest_metrics(w, spark.createDataFrame([("hash_rate", "work"), ("fees", "paid")], "metric string, about string"), rows(2.0), date(2024, 1, 1), date(2024, 1, 5)) == "success"
    assert {(r.date.day, r.value) for r in w.read("metric_values").collect()} == {(1, 1.0), (2, 1.0), (3, 1.0), (4, 2.0), (5, 2.0)}
    assert {tuple(r) for r in w.read("metrics").collect()} == {("hash_rate", "work"), ("fees", "paid")}
    last = prices.most_recent(w.read("metric_values"), "metric").collect()
    assert [(r.date.day, r.value) for r in last] == [(5, 2.0)]


def test_requests_keep_apart(monkeypatch):
    asked = []

    def page(url, timeout):
        asked.append(time.monotonic())
        if len(asked) == 2:
            raise OSError("try again")
        row = {"symbol": "x", "date": "2024-01-02", "close": 1}
        return io.BytesIO(json.dumps({"data": [row] * (2 if len(asked) < 4 else 1)}).encode())

    monkeypatch.setattr(urllib.request, "urlopen", page)
    reader = prices.EodReader({"symbols": "x", "limit": "2", "delay": "0.2", "url": "http://nowhere/?s={symbols}&o={offset}"})
    got = list(reader.read(reader.partitions()[0]))
    assert len(got) == 5 and len(asked) == 4 and min(b - a for a, b in itertools.pairwise(asked)) >= 0.199
