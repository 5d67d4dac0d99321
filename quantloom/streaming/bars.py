"""Event streams: hourly bars, sliding volume, sessions, and duplicates dropped, each with a batch twin.

The streams read a folder of Parquet files as it fills. Watermarks bound the
state; ``available_now`` runs a stream over all that is there and hands its result
over as a table, so a stream can be compared with its twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dsl import Dialect
from ..shared import fresh_path

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a stream; late events are dropped after an hour."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    # a stream reads folders: the pattern matches the one table, be it a file or a folder of files
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{folder}/events.parquet*")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


def hourly(events: DataFrame) -> DataFrame:
    """Open, high, low, close, volume and count of each event type and hour."""
    first = F.struct("ts", "event_id")
    return (
        events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.min_by("value", first).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", first).alias("close"), F.round(F.sum("value"), 6).alias("volume"), F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("hour"), "event_type", "open", "high", "low", "close", "volume", "n")
    )


def sliding(events: DataFrame) -> DataFrame:
    """Volume of six hours, every two hours."""
    return events.groupBy(F.window("ts", "6 hours", "2 hours").alias("w"), "event_type").agg(F.round(F.sum("value"), 6).alias("volume"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "volume", "n")


def sessions(events: DataFrame) -> DataFrame:
    """Visits of a user: events less than 30 minutes apart."""
    return events.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("value")).select(F.col("w.start").alias("start"), "user_id", "n", "value")


def without_duplicates(events: DataFrame) -> DataFrame:
    """Each event once, however often it arrives within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def available_now(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all files that are there; returns its last result as a table in the shared folder."""
    spark = result.sparkSession
    where = fresh_path(spark, "stream")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{where}/out")

    result.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{where}/out")


def stream_hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return available_now(hourly(read_events(spark, sf_dir)))


def stream_sliding_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return available_now(sliding(read_events(spark, sf_dir)))


def _hour_sql(d: Dialect) -> str:
    key = f"{d.fun('struct')}(ts, event_id)"
    return f"select date_trunc('hour', cast(ts as timestamp)) as hour, event_type, min_by(value, {key}) open, max(value) high, min(value) low, max_by(value, {key}) close, round(sum(value), 6) volume, count(*) n from {d.table('events')} e group by 1, 2"


def batch_hourly_bars(d: Dialect) -> str:
    return _hour_sql(d)


def batch_sessions(d: Dialect) -> str:
    """Visits by gaps of 30 minutes, over the whole table."""
    gap = "interval 30 minutes" if d.spark else "interval '30 minutes'"
    new = f"(select user_id, ts, value, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + {gap} then 0 else 1 end new, event_id from {d.table('events')} e)"
    k = f"(select user_id, ts, value, sum(new) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) k from {new} x)"
    return f"select min(ts) as start, user_id, count(*) n, round(sum(value), 6) as value from {k} y group by user_id, k"


def latest_per_user(d: Dialect) -> str:
    """The newest event of each user."""
    return f"select user_id, event_id, ts, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) k from {d.table('events')} e) x where k = 1"


_SLIDING = "select cast(s.start as timestamp) as start, event_type, round(sum(value), 6) volume, count(*) n from (select *, unnest(generate_series(time_bucket(interval '2 hours', ts) - interval '4 hours', time_bucket(interval '2 hours', ts), interval '2 hours')) as start from events) s group by 1, 2"
STREAMS = (stream_hourly_bars, stream_sliding_volume)
BATCH_TWINS = (batch_hourly_bars, batch_sessions, latest_per_user)
ORACLES = {"stream_hourly_bars": _hour_sql(Dialect("duck")), "stream_sliding_volume": _SLIDING}
