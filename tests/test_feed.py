"""The end-of-day source as a stream: restarts neither lose nor repeat a row."""

import json
from datetime import date, timedelta

import pytest
from pyspark.errors import StreamingQueryException

from quantloom.sources import prices


@pytest.fixture()
def service(tmp_path, spark):
    rows = [{"symbol": s, "date": f"{date(2024, 1, 1) + timedelta(days=k)}T00:00:00", "open": k, "high": k, "low": k, "close": k, "volume": 1} for s in ("A", "B", "C") for k in range(20)]
    (tmp_path / "page.json").write_text(json.dumps({"data": rows}))
    spark.dataSource.register(prices.EodSource)

    def open_stream(until, symbols="A,B"):
        return spark.readStream.format("eod").option("symbols", symbols).option("group", 1).option("days", 4).option("date_from", "2024-01-01").option("until", until).option("url", f"file://{tmp_path}/page.json").load()

    return open_stream, str(tmp_path / "feed")


def kept(spark, folder):
    return sorted((r.symbol, r.date.day) for r in spark.read.schema(f"{prices.BARS}, batch long").parquet(f"{folder}/rows").collect())


def test_goes_on_where_it_was(spark, service):
    stream, folder = service
    prices.feed(stream("2024-01-05"), folder)
    assert kept(spark, folder) == [(s, d) for s in "AB" for d in range(1, 6)]
    prices.feed(stream("2024-01-05"), folder)
    assert kept(spark, folder) == [(s, d) for s in "AB" for d in range(1, 6)]
    # a new symbol starts at the first date, the others go on
    prices.feed(stream("2024-01-09", "A,B,C"), folder)
    assert kept(spark, folder) == [(s, d) for s in "ABC" for d in range(1, 10)]
    assert prices.read_feed(spark, folder).count() == 27


def test_killed_between_two_batches(spark, service):
    stream, folder = service
    prices.feed(stream("2024-01-03"), folder)

    def die(_, number):
        raise RuntimeError("killed")

    # the part is written, but the batch is not committed
    with pytest.raises(StreamingQueryException):
        prices.feed(stream("2024-01-08"), folder, die)
    assert len(kept(spark, folder)) == 16
    # the repeated batch keeps its own end, the next one goes on from there
    prices.feed(stream("2024-01-10"), folder)
    assert kept(spark, folder) == [(s, d) for s in "AB" for d in range(1, 11)]
    rows = prices.read_feed(spark, folder)
    assert rows.count() == 20 and rows.filter("close = day(date) - 1").count() == 20


def test_tasks_of_a_batch():
    r = prices.EodStreamReader({"symbols": "A,B,C", "date_from": "2024-01-01", "days": "10", "group": "2", "until": "2024-01-25"})
    start = {"A": "2024-01-05", "B": "2024-01-05"}
    pages = [(p.symbols, p.first, p.last) for p in r.partitions(start, r.latestOffset())]
    assert pages == [(["A", "B"], "2024-01-06", "2024-01-15"), (["A", "B"], "2024-01-16", "2024-01-25"), (["C"], "2024-01-01", "2024-01-10"), (["C"], "2024-01-11", "2024-01-20"), (["C"], "2024-01-21", "2024-01-25")]
    assert r.partitions(r.latestOffset(), r.latestOffset()) == []
