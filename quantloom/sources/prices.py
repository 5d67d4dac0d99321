"""Price sources: a paged end-of-day service as a Python data source, incremental ingest with gap fill, and a warehouse of Parquet tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

BARS = "symbol string, date date, open double, high double, low double, close double, volume double"


class _Page(InputPartition):
    def __init__(self, symbols: list[str], first: str = "", last: str = ""):
        self.symbols, self.first, self.last = symbols, first, last


def _groups(options: dict) -> list[list[str]]:
    symbols = [s.strip() for s in options["symbols"].split(",") if s.strip()]
    size = int(options.get("group", 50))
    return [symbols[i : i + size] for i in range(0, len(symbols), size)]


def _fetched(options: dict, page: _Page):
    """Rows of some symbols within the page's dates (open where empty); pages of the service are fetched until a short one."""
    import time
    from urllib.request import urlopen

    limit, offset = int(options.get("limit", 1000)), 0
    delay, asked = float(options.get("delay", 0)), None
    while True:
        url = options["url"].format(symbols=",".join(page.symbols), date_from=page.first, date_to=page.last, offset=offset, limit=limit)
        for attempt in range(3):
            if asked is not None:
                time.sleep(max(0.0, asked + delay - time.monotonic()))
            asked = time.monotonic()
            try:
                with urlopen(url, timeout=30) as answer:
                    rows = json.load(answer)["data"]
                break
            except OSError:
                if attempt == 2:
                    raise
                time.sleep(2**attempt)
        for r in rows:
            day = r["date"][:10]
            if r["symbol"] in page.symbols and (not page.first or day >= page.first) and (not page.last or day <= page.last):
                yield (r["symbol"], date.fromisoformat(day), *(float(r[k]) if r.get(k) is not None else None for k in ("open", "high", "low", "close", "volume")))
        if len(rows) < limit or "{offset}" not in options["url"]:
            return
        offset += limit


class EodReader(DataSourceReader):
    """A task per group of symbols. ``url`` holds {symbols}, {date_from}, {date_to}, {offset} and {limit}; requests of a task start at least ``delay`` seconds apart."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_Page(g, self.options.get("date_from", ""), self.options.get("date_to", "")) for g in _groups(self.options)]

    def read(self, partition):
        yield from _fetched(self.options, partition)


class EodStreamReader(DataSourceStreamReader):
    """The same service as a stream: an offset holds, for every symbol, the last date that was read.

    A batch fetches what lies between two offsets, a task per group of symbols and
    ``days`` dates. A symbol that is new in the options starts at ``date_from``; one
    that is gone stays in the offset, so it goes on where it was if it comes back.
    ``until`` is the last date that the service has (default: today).
    """

    def __init__(self, options: dict):
        self.options = options

    def _first(self) -> str:
        return (date.fromisoformat(self.options["date_from"]) - timedelta(days=1)).isoformat()

    def initialOffset(self) -> dict:
        return {s: self._first() for g in _groups(self.options) for s in g}

    def latestOffset(self) -> dict:
        last = self.options.get("until") or date.today().isoformat()
        return {s: last for g in _groups(self.options) for s in g}

    def partitions(self, start: dict, end: dict):
        out, days = [], int(self.options.get("days", 756))
        for group in _groups(self.options):
            # symbols that stand at one date are asked for together
            at: dict[tuple[str, str], list[str]] = {}
            for s in group:
                if s in end:
                    at.setdefault((start.get(s, self._first()), end[s]), []).append(s)
            for (done, last), symbols in at.items():
                lo, hi = date.fromisoformat(done) + timedelta(days=1), date.fromisoformat(last)
                while lo <= hi:
                    stop = min(lo + timedelta(days=days - 1), hi)
                    out.append(_Page(symbols, lo.isoformat(), stop.isoformat()))
                    lo = stop + timedelta(days=1)
        return out

    def read(self, partition):
        yield from _fetched(self.options, partition)


class EodSource(DataSource):
    """``spark.read.format("eod")``, or ``spark.readStream``, after ``spark.dataSource.register(EodSource)``."""

    @classmethod
    def name(cls):
        return "eod"

    def schema(self):
        return BARS

    def reader(self, schema):
        return EodReader(self.options)

    def streamReader(self, schema):
        return EodStreamReader(self.options)


def feed(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run a stream over all that is there into ``folder``: a part per batch, written whole and over a part of the same batch.

    A batch that is repeated after a crash reads the same offsets and replaces its
    own part, so nothing is lost and nothing is twice. ``each`` is called after a part
    is written.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/rows/batch={number}")
        if each:
            each(batch, number)

    query = None
    while query is None or any(p.numInputRows for p in query.recentProgress):  # a run that repeats a batch ends with it
        query = stream.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination()


def read_feed(spark: SparkSession, folder: str, keys: tuple[str, ...] = ("symbol", "date"), schema: str = BARS) -> DataFrame:
    """Rows of a feed, of those that share a key the one of the latest batch; rows with a null key are left out."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/rows").filter(" and ".join(f"{k} is not null" for k in keys))
    names = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("r")).select("r.*")


class Warehouse:
    """Tables under one folder. A write goes to a new version; readers see a version only once it is complete."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self, name: str) -> list[int]:
        fs, p = self._fs(f"{self.folder}/{name}")
        if not fs.exists(p):
            return []
        done = []
        for s in fs.listStatus(p):
            n = s.getPath().getName()
            if n.startswith("v") and fs.exists(self._fs(f"{self.folder}/{name}/{n}/_SUCCESS")[1]):
                done.append(int(n[1:]))
        return sorted(done)

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/v{self._versions(name)[-1]}")

    def write(self, name: str, df: DataFrame) -> None:
        old = self._versions(name)
        new = old[-1] + 1 if old else 0
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}/v{new}")
        for v in old[:-1]:  # the last version stays for readers that have it open
            fs, p = self._fs(f"{self.folder}/{name}/v{v}")
            fs.delete(p, True)

    def drop(self, name: str) -> None:
        fs, p = self._fs(f"{self.folder}/{name}")
        fs.delete(p, True)

    def insert_ignore(self, name: str, rows: DataFrame, keys: tuple[str, ...]) -> None:
        """Append rows whose key is new; of rows that share a key, one."""
        fresh = rows.dropDuplicates(list(keys))
        if self.exists(name):
            have = self.read(name)
            fresh = have.unionByName(fresh.join(have.select(*keys), list(keys), "left_anti"))
        self.write(name, fresh)

    def upsert(self, name: str, rows: DataFrame, keys: tuple[str, ...], least: tuple[str, ...] = (), most: tuple[str, ...] = ()) -> None:
        """Replace rows by key; a null keeps what is there, ``least`` and ``most`` columns keep the smaller or larger value."""
        if not self.exists(name):
            return self.write(name, rows.dropDuplicates(list(keys)))
        have = self.read(name)
        both = have.alias("o").join(rows.dropDuplicates(list(keys)).alias("n"), list(keys), "full")
        value = lambda c: F.least(f"o.{c}", f"n.{c}") if c in least else F.greatest(f"o.{c}", f"n.{c}") if c in most else F.coalesce(f"n.{c}", f"o.{c}")
        self.write(name, both.select(*keys, *(value(c).alias(c) for c in have.columns if c not in keys)))


def gaps(first: date | None, last: date | None, start: date, end: date) -> list[tuple[date, date]]:
    """What a target range lacks before ``first`` and after ``last``; all of it where there is nothing."""
    if first is None or last is None:
        return [(start, end)]
    out = []
    if start < first:
        out.append((start, min(end, first - timedelta(days=1))))
    if end > last:
        out.append((max(start, last + timedelta(days=1)), end))
    return out


def chunks(start: date, end: date, trading_days: int = 756) -> list[tuple[date, date]]:
    step = int(trading_days * 365 / 252)
    out = []
    while start <= end:
        stop = min(start + timedelta(days=step - 1), end)
        out.append((start, stop))
        start = stop + timedelta(days=1)
    return out


def most_recent(rows: DataFrame, key: str = "symbol") -> DataFrame:
    """The last row of every symbol."""
    return rows.filter("date is not null").groupBy(key).agg(F.max_by(F.struct(*rows.columns), "date").alias("r")).select("r.*")


def ingest_metrics(w: Warehouse, listed: DataFrame, fetch: Callable[[date, date], DataFrame], start: date, end: date, table: str = "metric_values") -> str:
    """Keep what is known of metrics (``listed``: metric and more), then fetch what their values (metric, date, value) lack; a value fetched again replaces the old one."""
    w.upsert("metrics", listed, ("metric",))
    return ingest(w, fetch, start, end, table, ("metric", "date"), replace=True)


def ingest(w: Warehouse, fetch: Callable[[date, date], DataFrame], start: date, end: date, table: str = "ohlcv", keys: tuple[str, ...] = ("asset", "date"), replace: bool = False) -> str:
    """Fetch what the range lacks, chunk by chunk, insert what is new (``replace``: rows of a known key too) and log the run; a chunk that fails does not stop the others."""
    have = w.read(table).agg(F.min("date"), F.max("date")).first() if w.exists(table) else (None, None)
    good, bad, errors = 0, 0, []
    for a, b in gaps(have[0], have[1], start, end):
        for lo, hi in chunks(a, b):
            try:
                (w.upsert if replace else w.insert_ignore)(table, fetch(lo, hi), keys)
                good += 1
            except Exception as e:  # noqa: BLE001 - a source may fail in any way; the log keeps what it said
                bad += 1
                errors.append(str(e)[:200])
    status = "success" if not bad else "partial" if good else "failed"
    log = w.spark.createDataFrame([(start, end, good, bad, status, "; ".join(errors))], "start date, end date, chunks int, failed int, status string, errors string")
    w.write("ingestion_log", w.read("ingestion_log").unionByName(log) if w.exists("ingestion_log") else log)
    return status
