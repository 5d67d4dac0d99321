"""Tables in the folder that driver and executors share: where a plan is cut, and what many plans read."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a new one in local mode (tests) and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quantloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the application's own part of the shared folder, which goes when the driver ends or with :func:`clear`."""
    folder = f"{shared_dir(spark)}/quantloom/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders[folder] = spark
    return f"{folder}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends there, and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_stored(df: DataFrame) -> None:
    """Delete a table of :func:`stored` that is needed no more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, name)


def clear(spark: SparkSession) -> None:
    """Delete all that this application stored in the shared folder; results that still read it fail from then on."""
    for folder in [f for f in _folders if f.endswith(f"/{spark.sparkContext.applicationId}")]:
        _folders.pop(folder)
        delete(spark, folder)


@atexit.register
def _clear_all() -> None:
    for folder, spark in list(_folders.items()):
        try:
            delete(spark, folder)
        except Exception:  # noqa: BLE001, S110 - the driver ends: a session that is gone leaves its folder
            pass
