"""Packing along a Hilbert curve: near documents share sequences, and almost nothing is padded.

A document's vector is the sum of pseudo-random signs of its token ids (feature
hashing straight into DIMS dimensions, ids weighted by the root of their
count); its direction is quantised to BITS bits a dimension and becomes a key
on the Hilbert curve. Documents are range-sorted by (key, id, ids); each range
is one stream that is cut into full sequences, its rest into sequences of
powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import binary_array, mix64, parts_for, stored, tidily, utf8
from .huffman import _with_end

DIMS, BITS = 3, 16
RANGE_BYTES = 24 << 20  # ids in one range, about
SEQUENCES = 40  # bits of a sequence's number within its range


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of every row of integers below 2**bits (Skilling's transform)."""
    x = [points[:, k].astype(np.int64) for k in range(points.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    x = [v ^ t for v in x]
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | v >> b & 1
    return key


def document_keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hilbert key of each document from its ids; a document without ids gets 0."""
    rows = np.repeat(np.arange(len(counts)), counts)
    pair = rows * np.int64(1 << 32) + ids
    pair.sort()
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    weight = np.sqrt(np.diff(np.append(first, len(pair))))
    row, token = pair[first] >> 32, (pair[first] & 0xFFFFFFFF).astype(np.uint64)
    h = mix64(token + np.uint64(1))
    point = np.empty((len(counts), DIMS))
    for k in range(DIMS):
        sign = ((h >> np.uint64(20 * k)) & np.uint64(0xFFFFF)).astype(np.float64) / 0x80000 - 1
        point[:, k] = np.bincount(row, sign * weight, minlength=len(counts))
    size = np.sqrt((point**2).sum(1))
    size[size == 0] = 1
    cell = np.clip(((point / size[:, None] + 1) * (1 << (BITS - 1))).astype(np.int64), 0, (1 << BITS) - 1)
    return np.where(counts > 0, hilbert_keys(cell), 0)


def pieces(counts: np.ndarray, length: int, first: int, used: int, last: bool, total: int) -> tuple[np.ndarray, ...]:
    """Cut documents that follow each other in a stream, the first at place ``used``: (row, start, length, sequence, offset).

    ``total`` is the stream's length if ``last``: what remains after the full
    sequences is cut at its powers of two, largest first.
    """
    ends = used + np.cumsum(counts)
    stop = int(ends[-1]) if len(ends) else used
    cuts = np.arange(used - used % length + length, stop, length)
    borders = [np.arange(0, stop + length, length)]
    if last:
        at = total - total % length
        left = total % length
        borders = [np.arange(0, at + 1, length)]
        while left:
            part = 1 << (left.bit_length() - 1)
            at, left = at + part, left - part
            borders.append(np.array([at]))
    borders = np.concatenate(borders)
    cuts = borders[(borders > used) & (borders < stop)]
    marks = np.unique(np.concatenate([[used], cuts, ends[counts > 0]]))
    begin, n = marks[:-1], np.diff(marks)
    row = np.searchsorted(ends, begin, "right")
    sequence = np.searchsorted(borders, begin, "right") - 1
    return row, begin - (ends - counts)[row], n, first + sequence, begin - borders[sequence]


def pack_by_curve(docs: DataFrame, path: str, pattern: str, end_id: int = 1, length: int = 2048, key: str = "doc_id", text: str = "text", vocabulary: int = 1 << 16) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` ids. A row per piece.

    Returns key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids
    (the piece's ids, little-endian unsigned 32-bit) and curve_key. Null texts
    are the end id alone; equal documents lie side by side, those with equal keys
    too in the order of their ids; a null key is kept and sorts first; an empty
    table gives no rows. Every id is in exactly one piece. ``vocabulary`` (ids are
    below it) sets how wide ids are stored on the way.
    """
    kind = dict(docs.dtypes)[key]
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    width = np.dtype(dtype).itemsize

    def encode(batches):
        def work(rows, ids, counts):
            keys = document_keys(ids, counts)
            out, n = _with_end(ids, counts, end_id)
            return pa.RecordBatch.from_arrays([rows.column(0), pa.array(keys), binary_array(out.astype(dtype), width * n)], names=["key", "curve_key", "ids"])

        yield from bpe.encode_batches(batches, path, pattern, work)

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    coded = stored(source.mapInArrow(tidily(encode), f"key {kind}, curve_key long, ids binary"), "packing-ids")
    total = int(coded.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0])

    def pack(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << SEQUENCES
        stream = 0  # ids of this range so far
        held: list = []  # rows in the sequence that is not yet full: they are cut when the range ends

        def emit(rows, counts, data, last):
            nonlocal stream
            row, start, n, sequence, offset = pieces(counts, length, base, stream, last, stream + int(counts.sum()))
            ends = np.concatenate([[0], np.cumsum(counts)])
            at = ends[row] + start
            raw = memoryview(data.tobytes())
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + n).tolist(), strict=True)), np.int64, len(n))
            stream += int(counts.sum())
            taken = rows.take(pa.array(row))
            return pa.RecordBatch.from_arrays([taken.column(0), pa.array(start), pa.array(n), pa.array(crc), pa.array(counts[row]), pa.array(sequence), pa.array(offset), binary_array(data, 4 * n), taken.column(1)], schema=schema_of(taken))

        def schema_of(rows):
            return pa.schema([("doc", rows.schema.field(0).type), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("curve_key", pa.int64())])

        for b in batches:
            data, off = utf8(b.column(2))
            data, n = data.view(dtype).astype("<u4"), np.diff(off) // width
            held.append((b.select([0, 1]), n, data))
            size = sum(int(x[1].sum()) for x in held)
            if size < 8 * length:
                continue
            rows, n, data = _joined(held)
            # keep back the rows that end within the last sequence that could be a full one
            ends = np.cumsum(n)
            full = (stream + int(ends[-1])) // length * length - stream
            safe = int(np.searchsorted(ends, full, "right"))
            held = [(rows.slice(safe), n[safe:], data[int(ends[safe - 1]) if safe else 0 :])]
            if safe:
                yield emit(rows.slice(0, safe), n[:safe], data[: int(ends[safe - 1])], False)
        if held:
            rows, n, data = _joined(held)
            if len(n):
                yield emit(rows, n, data, True)

    parts = coded.repartitionByRange(parts_for(total, RANGE_BYTES), "curve_key", "key").sortWithinPartitions("curve_key", "key", "ids")
    schema = f"doc {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, curve_key long"
    return parts.select("key", "curve_key", "ids").mapInArrow(tidily(pack), schema).withColumnRenamed("doc", key)


def _joined(held: list) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    if len(held) == 1:
        return held[0]
    rows = pa.Table.from_batches([x[0] for x in held]).combine_chunks().to_batches()[0]
    return rows, np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
