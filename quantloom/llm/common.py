"""Helpers that the operators of this subpackage share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..shared import drop_stored, fresh_path  # noqa: F401 - for the operators

CHUNK_BYTES = 4 << 20  # text bytes that one numpy pass works on
BATCH_CONF, BATCH_BYTES, SPARK_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20, 64 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of about BATCH_BYTES on their way to Python workers, where the session has Spark's default of 64 MB: whole texts make large batches, and executor and worker hold one each."""
    if spark.conf.get(BATCH_CONF, f"{SPARK_BATCH_BYTES}b") == f"{SPARK_BATCH_BYTES}b":
        spark.conf.set(BATCH_CONF, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, what: str) -> DataFrame:
    """:func:`quantloom.shared.stored`, with batches bounded for the Python workers that fill it."""
    bounded_batches(df.sparkSession)
    return shared.stored(df, what)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes in a column: one cheap pass, from which operators size their shards."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def parts_for(n_bytes: int, each: int, least: int = 8) -> int:
    return max(least, -(-n_bytes // each))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    else:
        column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def release() -> None:
    """Hand freed memory back to the machine: Spark keeps a worker for later tasks, beside others of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def tidied(work: Callable, *args):
    """``work(*args)``, then :func:`release`."""
    try:
        return work(*args)
    finally:
        release()


def tidily(run: Callable) -> Callable:
    """A worker over batches that ends with :func:`release`."""

    def worker(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return worker


def by_chunk(batches: Iterator[pa.RecordBatch], column: str, work: Callable, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """``work(rows, data, offsets)`` over pieces of every Arrow batch; it returns a RecordBatch or None."""
    for batch in batches:
        data, off = utf8(batch.column(batch.schema.get_field_index(column)))
        for i, j in chunks(off, size):
            out = work(batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i])
            if out is not None and out.num_rows:
                yield out


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column whose values lie one after the other in ``data`` (lengths in bytes)."""
    off = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=off[1:])
    data = np.ascontiguousarray(data).view(np.uint8)
    if off[-1] < 2**31 - 1:
        return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])
    raise ValueError("over 2 GB in one batch")


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place where possible."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
