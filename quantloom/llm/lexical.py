"""Ranked lexical search: shards of documents with postings in compressed rows and precomputed integer impacts.

A shard holds about SHARD_BYTES of text: its distinct terms, for each term the
range of its postings, and a posting's document and impact,
(1000000000*tf) div (1000*tf + 12*m), where m depends on the document's length
against the mean. Impacts are ready in the shard; a term's weight needs only its
document frequency, which is the sum of its posting counts over the shards, and is
applied while searching. A search adds a query's terms one at a time into a dense
accumulator over the shard's documents, takes the best k by a partition that keeps
every tie of the last place until ids decide, and merges the lists of shards: first
those of a task, then all of them in a window.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, parts_for, stored, text_bytes, tidily, utf8
from .words import TERM, Words

SHARD_BYTES = 6 << 20  # text bytes of one shard; a longer text stands alone
QUERY_BYTES = 2 << 20  # text bytes of the queries that go through the shards at once
SCALE, TERM_FACTOR, LENGTH_FACTOR, BASE, SLOPE = 1_000_000_000, 1000, 12, 75, 25  # of the impact

_SHARD = "docs binary, keyed binary, terms binary, sizes binary, first binary, who binary, impact binary"


@dataclass(frozen=True)
class LexicalIndex:
    """``shards``: a stored table, a row per shard; ``documents`` and ``terms``: how many hold a term, and all their terms."""

    shards: DataFrame
    documents: int
    terms: int


def _totals(docs: DataFrame, text: str) -> tuple[int, int]:
    def run(batches):
        some = total = 0
        for batch in batches:
            data, off = utf8(batch.column(0))
            inside = TERM[data]
            opens = inside.copy()
            opens[1:] &= ~inside[:-1]
            first = off[:-1][off[1:] > off[:-1]]
            opens[first] = inside[first]
            n = np.diff(np.concatenate([[0], np.cumsum(opens)])[off])
            some, total = some + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_pydict({"n": [some], "l": [total]})

    got = docs.select(text).mapInArrow(tidily(run), "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return int(got[0] or 0), int(got[1] or 0)


def _shard(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, documents: int, terms: int) -> pa.RecordBatch | None:
    """The row of one shard; documents without a term are in none of its lists."""
    w = Words(data, offsets, lower=True, member=TERM)
    if not len(w.start):
        return None
    code, names = w.codes()
    held, tf = np.unique(code.astype(np.int64) << 32 | w.doc, return_counts=True)
    who = (held & 0xFFFFFFFF).astype(np.int32)
    first = np.searchsorted(held >> 32, np.arange(len(names) + 1)).astype(np.int64)
    length, place = np.unique(w.count, return_inverse=True)
    m = np.array([100 - SLOPE + SLOPE * int(n) * documents // terms for n in length], np.int64)[place]
    tf = tf.astype(np.int64)
    impact = (SCALE * tf // (TERM_FACTOR * tf + LENGTH_FACTOR * m[who])).astype(np.int32)
    spelt, off = utf8(names)
    columns = (ids.fill_null(0).to_numpy(zero_copy_only=False), (~np.asarray(ids.is_null())).astype(np.uint8), spelt, np.diff(off).astype(np.int32), first, who, impact)
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns], names=[f.split()[0] for f in _SHARD.split(", ")])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> LexicalIndex:
    """Index every row of ``docs``. Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased.

    A null text has no term; such rows are not counted. Rows that repeat a key are
    documents of their own. Only the key and the text are read. A text longer than
    a shard is one shard.
    """
    documents, terms = _totals(docs, text)

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            data = np.concatenate([d for _, d, _ in held])
            base = np.cumsum([0, *(len(d) for _, d, _ in held)])
            off = np.concatenate([o[:-1] + b for (_, _, o), b in zip(held, base, strict=False)] + [base[-1:]])
            return _shard(pa.concat_arrays([k for k, _, _ in held]), data, off, documents, terms)

        for batch in batches:
            data, off = utf8(batch.column(1))
            ids = batch.column(0).cast(pa.int64())
            at = 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(off, off[at] + SHARD_BYTES - size, "right")) - 1) if size < SHARD_BYTES else at
                to = min(to, len(ids))
                if to > at:
                    held.append((ids.slice(at, to - at), data[off[at] : off[to]].copy(), off[at : to + 1] - off[at]))
                    size += int(off[to] - off[at])
                    at = to
                if size >= SHARD_BYTES or at < len(ids):
                    row = flush()
                    held.clear()
                    size = 0
                    if row is not None:
                        yield row
        if held:
            row = flush()
            if row is not None:
                yield row

    return LexicalIndex(stored(docs.select(F.col(key).cast("long"), text).mapInArrow(tidily(run), _SHARD), "postings"), documents, terms)


class _Shard:
    def __init__(self, row: dict):
        self.docs = np.frombuffer(row["docs"], np.int64)
        self.keyed = np.frombuffer(row["keyed"], np.uint8) > 0
        sizes = np.frombuffer(row["sizes"], np.int32)
        off = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=off[1:])
        self.names = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(row["terms"])])
        self.first = np.frombuffer(row["first"], np.int64)
        self.who = np.frombuffer(row["who"], np.int32)
        self.impact = np.frombuffer(row["impact"], np.int32)

    def find(self, terms: pa.Array) -> np.ndarray:
        """Place of each term in the shard, -1 where it has none."""
        return pc.fill_null(pc.index_in(terms, value_set=self.names), -1).to_numpy(zero_copy_only=False)


def _shards(batches) -> Iterator[_Shard]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield _Shard({n: batch.column(k)[row].as_buffer() for k, n in enumerate(batch.schema.names)})


def _frequencies(shards: DataFrame, terms: list[bytes]) -> np.ndarray:
    """In how many documents each term occurs: posting counts, summed over shards."""

    def run(batches):
        asked = pa.array(terms, pa.large_binary())
        total = np.zeros(len(terms), np.int64)
        for s in _shards(batches):
            at = s.find(asked)
            there = at >= 0
            total[there] += s.first[at[there] + 1] - s.first[at[there]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(len(terms), np.int64)
    for r in shards.mapInArrow(tidily(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row per term of one block of queries
        out[r.term] = r.n
    return out


def top(score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores above 0, best first, equal ones by ``order``: all that tie with the last place are held until order decides."""
    if len(score) > k:
        least = score[np.argpartition(score, len(score) - k)[len(score) - k :]].min()
        some = np.flatnonzero(score >= max(int(least), 1))
    else:
        some = np.flatnonzero(score > 0)
    return some[np.lexsort((order[some], -score[some]))[:k]]


def _ranked(shards: DataFrame, terms: list[bytes], asked: list[tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """(query, null_id, doc_id, score): the best ``k`` of every task's shards for each query, a query being its terms' places and weights."""

    def run(batches):
        spelt = pa.array(terms, pa.large_binary())
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in asked]
        for s in _shards(batches):
            at = s.find(spelt)
            # keys in order, null keys last: their place decides ties
            by = np.lexsort((s.docs, ~s.keyed))
            order = np.empty(len(by), np.int64)
            order[by] = np.arange(len(by))
            for q, (places, weights) in enumerate(asked):
                score = np.zeros(len(s.docs), np.int64)
                for t, weight in zip(at[places].tolist(), weights.tolist(), strict=True):
                    if t >= 0:
                        a, b = s.first[t], s.first[t + 1]
                        score[s.who[a:b]] += s.impact[a:b] * np.int64(weight)
                won = top(score, order, k)
                if len(won):
                    old = best[q]
                    ids, null, value = np.concatenate([old[0], s.docs[won]]), np.concatenate([old[1], ~s.keyed[won]]), np.concatenate([old[2], score[won]])
                    keep = np.lexsort((ids, null, -value))[:k]
                    best[q] = ids[keep], null[keep], value[keep]
        n = [len(x[0]) for x in best]
        if sum(n):
            ids, null, value = (np.concatenate([x[j] for x in best]) for j in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(n)), n)), pa.array(ids, mask=null), pa.array(value)], names=["query", "doc_id", "score"])

    return shards.mapInArrow(tidily(run), "query long, doc_id long, score long")


def search(index: LexicalIndex, queries: DataFrame, key: str = "item_id", text: str = "text", k: int = 20) -> DataFrame:
    """(key, rank, doc_id, score): for each row of ``queries`` the ``k`` documents of the highest score above 0, ties by ascending doc_id (null ids last).

    A term that a query repeats counts as often. A null text, or one without an
    indexed term, gives no rows; rows that repeat a key are queries of their own, with
    ranks of their own. Queries go through the shards in blocks of QUERY_BYTES of
    text, so what a task holds of them is bounded. Scores are 64-bit integers.
    """
    blocks = parts_for(text_bytes(queries, text), QUERY_BYTES, 1)
    wanted = queries.select(F.col(key).alias("key"), F.col(text).alias("text"))
    parts = []
    for b in range(blocks):
        block = wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("key", "text"), F.lit(blocks)) == b)
        rows = block.collect()  # one block: about QUERY_BYTES
        data = [(r.text or "").encode() for r in rows]
        off = np.cumsum([0, *map(len, data)])
        w = Words(np.frombuffer(b"".join(data), np.uint8), off, lower=True, member=TERM)
        code, names = w.codes()
        terms = names.to_pylist()
        frequency = _frequencies(index.shards, terms)
        weight = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * int(n) + 1))) for n in frequency], np.int64)
        asked = []
        for q in range(len(rows)):
            times = Counter(code[np.searchsorted(w.doc, q) : np.searchsorted(w.doc, q, "right")].tolist())
            found = np.array([t for t in times if frequency[t] and weight[t]], np.int64)
            asked.append((found, weight[found] * np.array([times[t] for t in found.tolist()], np.int64)))
        got = _ranked(index.shards, terms, asked, k)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        last = got.withColumn("rank", rank).filter(F.col("rank") <= k)
        names_of = queries.sparkSession.createDataFrame([(q, r.key) for q, r in enumerate(rows)], f"query long, key {dict(queries.dtypes)[key]}")
        parts.append(last.join(F.broadcast(names_of), "query").select(F.col("key").alias(key), "rank", "doc_id", "score"))
    return reduce(DataFrame.union, parts)


def ranked_documents(docs: DataFrame, queries: DataFrame, k: int = 20, query_key: str = "item_id") -> DataFrame:
    """:func:`build_index` and :func:`search` in one; the index is deleted when the result, a row per query and rank, is stored."""
    index = build_index(docs)
    out = stored(search(index, queries, query_key, k=k), "ranked")
    drop_stored(index.shards)
    return out


ORACLE = r"""with d as (select doc_id, row_number() over () row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') t from documents),
h as (select row, doc_id, t, len(t)::bigint n from d where len(t) > 0),
g as (select count(*)::hugeint nn, sum(n)::hugeint l from h),
q as (select item_id, row_number() over () item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') t from benchmark),
a as (select item_id, item, term, count(*)::bigint times from (select item_id, item, unnest(t) term from q) group by all),
v as (select distinct term from a),
p as (select row, term, count(*)::bigint tf from (select row, unnest(t) term from h) semi join v using (term) group by all),
w as (select term, floor(1000 * ln((2 * (select nn from g) + 2)::double / (2 * count(*) + 1)::double))::bigint w from p group by term),
s as (select item, any_value(item_id) item_id, row, any_value(doc_id) doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * nn) // l)::bigint))))::bigint score
  from a join p using (term) join w using (term) join h using (row) cross join g group by item, row),
r as (select item_id, (row_number() over (partition by item order by score desc, doc_id nulls last))::int rank, doc_id, score from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 20"""
