"""Panels kept by day, and whether a panel needs newer bars."""

from __future__ import annotations

from collections.abc import Collection
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEEDED = ("time", "asset", "open", "high", "low", "close", "vol")


def valid_panel(panel: DataFrame | None, needed: Collection[str] = NEEDED) -> bool:
    """Whether a panel has the columns, at least one row and no key (time, asset) twice or null."""
    if panel is None or not set(needed) <= set(panel.columns):
        return False
    odd = panel.groupBy("time", "asset").count().filter("count > 1 or time is null or asset is null")
    return not panel.isEmpty() and odd.isEmpty()


def empty_panel(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "time date, asset string, " + ", ".join(f"{c} double" for c in NEEDED[2:]))


def missing_days(last: date, target: date, lookback: int, holidays: Collection[date] = ()) -> list[date]:
    """Trading days after ``last`` up to ``target``; none where the gap is over ``lookback`` days, as a full load is due then."""
    if last >= target or (target - last).days > lookback:
        return []
    days = (last + timedelta(days=k) for k in range(1, (target - last).days + 1))
    return [d for d in days if d.weekday() < 5 and d not in holidays]


def needs_bars(panel: DataFrame | None, target: date, lookback: int = 30, force: bool = False, holidays: Collection[date] = ()) -> bool:
    """Whether to ask a source for newer bars; ``force`` asks for any day that is missing, however large the gap."""
    last = panel.agg(F.max(F.col("time").cast("date"))).first()[0] if panel is not None and "time" in panel.columns else None
    if last is None:
        return force
    return force and last < target or bool(missing_days(last, target, lookback, holidays))


class PanelCache:
    """Panels by (name, day), a Parquet folder each. One counts once its write is complete; an incomplete one is never read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _path(self, name: str, day: date) -> str:
        return f"{self.folder}/{day:%Y%m%d}_{name}"

    def _remove(self, name: str, day: date) -> None:
        fs, p = self._fs(self._path(name, day))
        fs.delete(p, True)

    def info(self) -> list[dict]:
        """name, day, bytes and complete of every panel, the newest first."""
        fs, root = self._fs(self.folder)
        found = []
        for s in fs.listStatus(root) if fs.exists(root) else []:
            day, _, name = s.getPath().getName().partition("_")
            if len(day) == 8 and day.isdigit() and name:
                path = s.getPath()
                done = fs.exists(self._fs(f"{path}/_SUCCESS")[1])
                found.append({"name": name, "day": date(int(day[:4]), int(day[4:6]), int(day[6:])), "bytes": fs.getContentSummary(path).getLength(), "complete": done})
        return sorted(found, key=lambda e: (e["day"], e["name"]), reverse=True)

    def is_valid(self, name: str, day: date) -> bool:
        return self.load(name, day) is not None

    def save(self, name: str, panel: DataFrame, day: date) -> bool:
        """Keep a valid panel in place of the day's; False and nothing written for one that is not valid."""
        if not valid_panel(panel):
            return False
        panel.write.mode("overwrite").option("compression", "zstd").parquet(self._path(name, day))
        return True

    def load(self, name: str, day: date) -> DataFrame | None:
        fs, p = self._fs(f"{self._path(name, day)}/_SUCCESS")
        return self.spark.read.parquet(self._path(name, day)) if fs.exists(p) else None

    def cleanup(self, day: date, keep_days: int = 3) -> int:
        """Remove panels of more than ``keep_days`` days before ``day``; how many."""
        old = [e for e in self.info() if e["day"] < day - timedelta(days=keep_days)]
        for e in old:
            self._remove(e["name"], e["day"])
        return len(old)

    def clear(self, day: date | None = None) -> int:
        """Remove the panels of one day, or all."""
        some = [e for e in self.info() if day in (None, e["day"])]
        for e in some:
            self._remove(e["name"], e["day"])
        return len(some)

    def repair(self) -> dict[str, int]:
        """Remove panels that are incomplete or not valid."""
        bad = [e for e in self.info() if not e["complete"] or not valid_panel(self.load(e["name"], e["day"]))]
        kept = len(self.info()) - len(bad)
        for e in bad:
            self._remove(e["name"], e["day"])
        return {"valid": kept, "removed": len(bad)}
