"""Files of a run: long tables as Parquet, wide ones as CSV, metadata as JSON; and what is read back and cleaned."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING = ("", "NA", "N/A", "null", "NULL", "nan", "NaN")
KINDS = ("weights", "budget", "factor_weights", "ic", "diagnostics", "exposure", "factor_vectors", "meta")


def sanitise(df: DataFrame, decimals: int | None = None) -> DataFrame:
    """NaN and infinities of double and float columns as 0, rounded half to even."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)
            c = F.bround(c, decimals) if decimals is not None else c
        out.append(c.alias(name))
    return df.select(*out)


def write_long(df: DataFrame, folder: str, kind: str, strategy: str, tag: str) -> str:
    """A table of a run, partitioned by strategy and tag; a run that is written again replaces its own partition only."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    path = f"{folder}/{kind}/strategy={strategy}/tag={tag}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def write_wide(df: DataFrame, path: str, column: str, value: str, decimals: int = 6) -> None:
    """One CSV column per value of ``column``; the columns are listed first, so rows are not scanned twice for a pivot."""
    names = [r[0] for r in df.select(column).distinct().orderBy(column).collect()]  # assets or factors: the width of a file
    wide = df.groupBy("time").pivot(column, names).agg(F.first(value))
    sanitise(wide, decimals).orderBy("time").write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; the usual words for missing values become null."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    text = [n for n, kind in df.dtypes if kind == "string"]
    return df.withColumns({n: F.when(F.trim(n).isin(*MISSING), None).otherwise(F.col(n)) for n in text})


def numeric(df: DataFrame, keep: tuple[str, ...] = ("time",)) -> DataFrame:
    """Every other column as a double; what cannot be read, NaN and infinities are 0."""
    return sanitise(df.select(*(F.col(n) if n in keep else F.coalesce(F.expr(f"try_cast(`{n}` as double)"), F.lit(0.0)).alias(n) for n in df.columns)))


def with_time(df: DataFrame) -> DataFrame:
    """The time column by its name (time, date or datetime), parsed; rows without a time go, the rest is sorted."""
    found = next((c for c in df.columns if c.lower() in ("time", "date", "datetime")), df.columns[0])
    parsed = df.withColumn("time", F.expr(f"try_cast(`{found}` as timestamp)"))
    return (parsed if found == "time" else parsed.drop(found)).filter("time is not null").orderBy("time")


def to_long(df: DataFrame, value: str = "w", name: str = "asset") -> DataFrame:
    return df.unpivot(["time"], [c for c in df.columns if c != "time"], name, value)


def read_run(spark: SparkSession, folder: str, kind: str, strategy: str, tag: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """A run's table, optionally between two dates (both included)."""
    df = spark.read.parquet(f"{folder}/{kind}/strategy={strategy}/tag={tag}")
    if first:
        df = df.filter(F.col("time") >= first)
    return df.filter(F.col("time") <= last) if last else df


def tags(names: list[str]) -> list[str]:
    """Tags like 20240131_093000 in file names, newest first, each once."""
    found = {m.group(0) for n in names for m in [re.search(r"\d{8}(?:_\d{4,6})?", n)] if m}
    return sorted(found, reverse=True)
