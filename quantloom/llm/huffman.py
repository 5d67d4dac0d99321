"""Token ids in files: canonical length-limited Huffman code of global counts, independent blocks, bit-offset checkpoints.

A file holds the ids of consecutive documents. Layout, little-endian::

    b"QLHUF1\\0\\0" | code lengths (u8 by id) | blocks | document index | footer

A block holds up to BLOCK ids: its checkpoints (u32 bit offset of every LANE-th
id) and then the bits. The document index is (doc_id i64, ids i64) per document.
The footer gives sizes and places. Blocks decode on their own; within one, all
lanes advance together through a table of 2**MAX_BITS entries.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, files
from .common import binary_array, drop_stored, fresh_path, parts_for, stored, tidily, utf8

MAGIC = b"QLHUF1\0\0"
MAX_BITS, BLOCK, LANE = 18, 1 << 16, 256
PLACES = 4096  # files whose places one window sums up
FILE_BYTES = 24 << 20  # ids (as stored, compressed) that one file takes, about


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); 0 for ids that never occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("limit is too small for so many ids")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(leaves))
        row = both[by]
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
    need = 2 * len(leaves) - 2
    for leaf in reversed(levels):
        n = int(leaf[:need].sum())
        lengths[order[:n]] += 1
        need = 2 * (need - n)
    return lengths


class Code:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        n = lengths[order].astype(np.int64)
        width = np.int64(1) << (MAX_BITS - n)
        first = np.cumsum(width) - width
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = first >> (MAX_BITS - n)
        self.symbol = np.zeros(1 << MAX_BITS, np.int32)
        self.taken = np.ones(1 << MAX_BITS, np.uint8)
        total = int(width.sum())
        self.symbol[:total] = np.repeat(order, width)
        self.taken[:total] = np.repeat(n, width)

    def pack(self, ids: np.ndarray) -> bytes:
        """One block."""
        n = self.lengths[ids].astype(np.uint64)
        code = self.codes[ids]
        ends = np.cumsum(n)
        at = ends - n
        word, room = (at >> np.uint64(6)).astype(np.int64), np.uint64(64) - (at & np.uint64(63))
        over = n > room
        left = np.where(over, np.uint64(0), room - n)
        right = np.where(over, n - room, np.uint64(0))
        high = np.where(over, code >> right, code << left)
        out = np.zeros(int(ends[-1] >> np.uint64(6)) + 2, np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[starts]] = np.bitwise_or.reduceat(high, starts)
        spill = np.flatnonzero(over)
        out[word[spill] + 1] |= code[spill] << (np.uint64(64) - right[spill])
        marks = at[::LANE].astype("<u4").tobytes()
        return marks + out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8]

    def unpack(self, block: bytes, n: int) -> np.ndarray:
        """The ``n`` ids of one block."""
        lanes = -(-n // LANE)
        at = np.frombuffer(block, "<u4", lanes).astype(np.int64)
        d = np.frombuffer(block + b"\0\0\0\0", np.uint8, offset=4 * lanes).astype(np.uint32)
        peek = d[:-3] << np.uint32(24) | d[1:-2] << np.uint32(16) | d[2:-1] << np.uint32(8) | d[3:]
        out = np.empty((min(LANE, n), lanes), np.int32)
        last = len(peek) - 1
        for k in range(len(out)):
            window = peek[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32) >> np.uint32(32 - MAX_BITS)
            out[k] = self.symbol[window]
            at += self.taken[window]
        return out.T.ravel()[:n] if n >= LANE else out[:n, 0]


class Writer:
    def __init__(self, path: str, code: Code):
        self.file, self.code = files.create(path), code
        self.file.write(MAGIC + code.lengths.tobytes())
        self.place, self.blocks, self.docs, self.counts, self.rest, self.held = len(MAGIC) + len(code.lengths), [], [], [], [], 0

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.counts.append(counts)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 4 * BLOCK:
            self._flush(BLOCK)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.int32)
        i = 0
        while len(ids) - i >= least and i < len(ids):
            part = ids[i : i + BLOCK]
            block = self.code.pack(part)
            self.file.write(block)
            self.blocks.append((self.place, len(block), len(part)))
            self.place += len(block)
            i += len(part)
        self.rest, self.held = [ids[i:]], len(ids) - i

    def close(self) -> tuple[int, int]:
        self._flush(1)
        docs = np.concatenate(self.docs).astype("<i8") if self.docs else np.zeros(0, "<i8")
        counts = np.concatenate(self.counts).astype("<i8") if self.counts else np.zeros(0, "<i8")
        blocks = np.array(self.blocks, "<i8").reshape(-1, 3)
        self.file.write(docs.tobytes() + counts.tobytes() + blocks.tobytes())
        self.file.write(struct.pack("<4q", self.place, len(docs), len(blocks), len(self.code.lengths)) + MAGIC)
        self.file.close()
        return len(docs), int(np.abs(counts).sum())


def read_file(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, ids per document - below zero where the id is null -, nothing) once, then (.., .., ids) of every block, by range reads."""
    with files.open_random(path) as f:
        size = f.size()
        place, n_docs, n_blocks, vocabulary = struct.unpack("<4q", files.read_range(f, size - 40, 32))
        if files.read_range(f, size - 8, 8) != MAGIC:
            raise ValueError(f"{path} is no file of this format")
        tail = files.read_range(f, place, 16 * n_docs + 24 * n_blocks)
        docs = np.frombuffer(tail, "<i8", n_docs)
        counts = np.frombuffer(tail, "<i8", n_docs, 8 * n_docs)
        blocks = np.frombuffer(tail, "<i8", 3 * n_blocks, 16 * n_docs).reshape(-1, 3)
        code = Code(np.frombuffer(files.read_range(f, len(MAGIC), vocabulary), np.uint8))
        yield docs, counts, np.zeros(0, np.int32)
        for at, length, n in blocks.tolist():
            yield docs, counts, code.unpack(files.read_range(f, at, length), n)


def encoded(docs: DataFrame, path: str, pattern: str, end_id: int, dtype: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) with ids as unsigned integers of ``dtype``, ``end_id`` last."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        def work(rows, ids, counts):
            out, n = _with_end(ids, counts, end_id)
            return pa.RecordBatch.from_arrays([rows.column(0), binary_array(out.astype(dtype), np.dtype(dtype).itemsize * n)], names=[key, "ids"])

        yield from bpe.encode_batches(batches, path, pattern, work)

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(tidily(run), f"{key} {kind}, ids binary")


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    n = counts + 1
    out = np.full(int(n.sum()), end_id, np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, n


def write_token_files(docs: DataFrame, path: str, pattern: str, vocabulary: int, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, write the ids in ascending order of ``key``; returns a stored table (part, file, start, docs, ids), a row per file: ``start`` is its first id's place.

    Documents with equal keys follow each other in the order of their ids; a null
    key sorts first and stays null (its count is stored below zero); a null text gives the end
    id alone; an empty table gives no files. What reaches the driver are the
    counts by id, bounded by the vocabulary; places are running sums in Spark.
    """
    spark = docs.sparkSession
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    width = np.dtype(dtype).itemsize
    ids = stored(encoded(docs, path, pattern, end_id, dtype, key, text), "ids")

    def count(batches):
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            data, _ = utf8(b.column(0))
            total += np.bincount(data.view(dtype), minlength=vocabulary)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])

    totals = np.zeros(vocabulary, np.int64)
    for r in ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        totals[r.id] = r.n
    lengths = code_lengths(totals)
    folder = fresh_path(spark, "huffman")

    def write(batches):
        from pyspark import TaskContext

        name, out, code = f"{folder}/{uuid.uuid4().hex}.ids", None, Code(lengths)
        for b in batches:
            data, off = utf8(b.column(1))
            if out is None:
                out = Writer(name, code)
            counts = np.diff(off) // width
            unnamed = b.column(0).is_null().to_numpy(zero_copy_only=False)
            doc_ids = b.column(0).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            out.add(doc_ids, np.where(unnamed, -counts, counts), data.view(dtype).astype(np.int32))
        if out is not None:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([name]), pa.array([n_docs]), pa.array([n_ids])], names=["part", "file", "docs", "ids"])

    n_bytes = int(totals.sum()) * width
    parts = ids.repartitionByRange(parts_for(n_bytes, FILE_BYTES), key).sortWithinPartitions(key, "ids")
    manifest = stored(parts.mapInArrow(tidily(write), "part long, file string, docs long, ids long"), "huffman-manifest")
    drop_stored(ids)
    placed = stored(_placed(manifest), "huffman-files")
    drop_stored(manifest)
    return placed


def _placed(manifest: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all parts before: a running sum within blocks of PLACES parts, and one over the blocks."""
    blocks = manifest.withColumn("block", F.floor(F.col("part") / PLACES))
    sums = blocks.groupBy("block").agg(F.sum("ids").alias("all"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per PLACES files
    sums = sums.select("block", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("ids").over(inside), F.lit(0))
    return blocks.join(sums, "block").select("part", "file", start.cast("long").alias("start"), "docs", "ids")


def read_token_files(listed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, decoded from the files that the table of :func:`write_token_files` names: key, start, n_tokens, ids_crc32."""
    schema = f"{key} long, start long, n_tokens long, ids_crc32 long"

    def read(batches):
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                blocks = read_file(name)
                docs, counts, _ = next(blocks)
                unnamed, counts = counts < 0, np.abs(counts)
                crc = np.zeros(len(docs), np.int64)
                i, left, running = 0, int(counts[0]) if len(counts) else 0, 0
                for _, _, ids in blocks:
                    raw, at = memoryview(ids.astype("<u4").tobytes()), 0
                    while at < len(ids):
                        n = min(left, len(ids) - at)
                        running = zlib.crc32(raw[4 * at : 4 * (at + n)], running)
                        at, left = at + n, left - n
                        if not left:
                            crc[i], running, i = running, 0, i + 1
                            left = int(counts[i]) if i < len(counts) else 0
                start = base + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=unnamed), pa.array(start), pa.array(counts), pa.array(crc)], names=[key, "start", "n_tokens", "ids_crc32"])

    tasks = max(1, listed.count())
    return listed.select("file", "start").repartition(tasks).mapInArrow(tidily(read), schema)
