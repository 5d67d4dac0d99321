"""A panel of bars kept twice, by asset and by time, so that a read of one asset or one date opens one file.

Built once for a state of its inputs - their files, sizes and times - and built
anew when they change. By asset: a folder per bucket of a hash of the asset, rows
in order of asset and time. By time: a folder per year, rows in order of time and
asset. Reads filter on bucket or year, which prunes folders, and on asset or time,
which the row groups' statistics and the scan take.
"""

from __future__ import annotations

import hashlib
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..functions.dsl import Dialect
from ..operators.book import bars
from ..shared import drop_stored, fresh_path, stored

BUCKET_ROWS = 2_000_000  # of one bucket of assets
_known: dict[tuple[str, str], "PanelStore"] = {}


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of all files under some paths."""
    out = hashlib.blake2b(digest_size=16)
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = []
        files = fs.listFiles(where, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        out.update(repr(sorted(found)).encode())
    return out.hexdigest()


class PanelStore:
    """Bars (time, asset, open, high, low, close, vol, is_liquid, t) under one folder of the shared one."""

    def __init__(self, spark: SparkSession, panel: DataFrame):
        self.spark, self.path = spark, fresh_path(spark, "panel")
        panel = stored(panel, "bars")
        self.buckets = max(1, -(-panel.count() // BUCKET_ROWS))
        by_asset = panel.withColumn("bucket", self._bucket(F.col("asset")))
        by_asset.repartition("bucket").sortWithinPartitions("bucket", "asset", "time").write.partitionBy("bucket").option("parquet.block.size", 4 << 20).parquet(f"{self.path}/by_asset")
        self.schema = panel.schema
        assets = self.spark.read.parquet(f"{self.path}/by_asset")
        by_time = assets.drop("bucket").withColumn("year", F.year("time"))
        by_time.repartition("year").sortWithinPartitions("year", "time", "asset").write.partitionBy("year").option("parquet.block.size", 4 << 20).parquet(f"{self.path}/by_time")
        assets.filter("vol > 0").groupBy("asset").agg(F.min("time").alias("first_seen"), F.max("time").alias("last_seen")).coalesce(1).write.parquet(f"{self.path}/assets")
        assets.select("time").distinct().coalesce(1).sortWithinPartitions("time").write.parquet(f"{self.path}/dates")
        read = lambda name, extra: spark.read.schema(self._typed(extra)).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        drop_stored(panel)
        self._assets, self._times = read("by_asset", "bucket"), read("by_time", "year")
        self.assets, self.dates = spark.read.parquet(f"{self.path}/assets"), spark.read.parquet(f"{self.path}/dates")

    def _typed(self, extra: str) -> StructType:
        return StructType([*self.schema.fields]).add(extra, IntegerType())

    def _bucket(self, asset):
        return F.pmod(F.xxhash64(asset), F.lit(self.buckets)).cast("int")

    def of_asset(self, asset: str, first: date | None = None, last: date | None = None) -> DataFrame:
        """Bars of one asset between two dates, both included; open where None."""
        out = self._assets.filter((F.col("bucket") == self._bucket(F.lit(asset))) & (F.col("asset") == asset))
        out = out.filter(F.col("time") >= F.lit(first)) if first else out
        return (out.filter(F.col("time") <= F.lit(last)) if last else out).drop("bucket")

    def latest(self, day: date) -> date | None:
        """The last date with bars at or before ``day``."""
        return self.dates.filter(F.col("time") <= F.lit(day)).agg(F.max("time")).first()[0]

    def at(self, day: date | None) -> DataFrame:
        """All assets on one date; none where it is None."""
        if day is None:
            return self._times.filter("false").drop("year")
        return self._times.filter((F.col("year") == day.year) & (F.col("time") == F.lit(day))).drop("year")


def panel_store(spark: SparkSession, folder: str, asset: str = "brand", unit: str = "week") -> PanelStore:
    """The store of a panel of the test tables, built where there is none of their present state."""
    inputs = [f"{folder}/lineitem.parquet", *([f"{folder}/part.parquet"] if asset == "brand" else [])]
    key = spark.sparkContext.applicationId, f"{asset} {unit} {fingerprint(spark, *inputs)}"
    if key not in _known:
        _known[key] = PanelStore(spark, spark.sql(f"select * from {bars(Dialect('spark', folder), asset, unit)} x"))
    return _known[key]


def bars_of_asset(spark: SparkSession, folder: str) -> DataFrame:
    """One asset, a range of dates."""
    return panel_store(spark, folder).of_asset("Brand#13", date(1994, 1, 1), date(1995, 12, 31)).select("time", "asset", "open", "high", "low", "close", "vol", "is_liquid")


def cross_section(spark: SparkSession, folder: str) -> DataFrame:
    """All assets on one date."""
    store = panel_store(spark, folder)
    return store.at(store.latest(date(1996, 3, 15))).select("time", "asset", "close", "vol")


def symbol_history(spark: SparkSession, folder: str) -> DataFrame:
    """Latest bars of a symbol, any case; the symbol is looked up among the assets first."""
    store = panel_store(spark, folder)
    found = store.assets.filter(F.upper("asset") == F.upper(F.lit("brand#21"))).select("asset").first()
    rows = store.of_asset(found[0] if found else "")
    return rows.select("time", F.upper("asset").alias("symbol"), "close", "vol").orderBy(F.desc("time")).limit(50)


READS = {f.__name__: f for f in (bars_of_asset, cross_section, symbol_history)}
