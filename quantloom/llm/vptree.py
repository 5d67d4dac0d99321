"""Nearest neighbours by largest inner product: a vantage-point tree per shard.

A shard's vectors get one more component that makes all norms equal to the
shard's largest; then the largest inner product is the least Euclidean distance,
which is a metric. A tree node keeps for both children the range of distances to
its vantage point; a child is pruned for a query when ``factor`` times the
triangle inequality's bound exceeds the distance of its k-th best so far. With
``factor`` 1 results are exact; larger factors prune more.

Queries walk a tree together: first each goes down to its own leaf, which gives a
first k-th distance, then one pass visits every node with the queries that still
need it. Distances from matrix products differ in their last bits, so another pass
takes all points as near as the k-th up to rounding; exact scores and ids decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARD_ROWS, LEAF, QUERY_BLOCK = 8192, 256, 2048
QUERY_PART = 256  # queries whose candidates are held at once


class Tree:
    """``order``: rows by leaf. Nodes are arrays; a leaf has ``left`` -1 and rows ``lo``:``hi`` of order."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        norms = (x**2).sum(1)
        self.top = float(norms.max())
        self.x = np.concatenate([x, np.sqrt(np.maximum(self.top - norms, 0))[:, None]], 1)
        self.order, self.nodes = np.arange(len(x)), []
        stack = [(0, len(x), None, 0)]
        while stack:
            lo, hi, parent, side = stack.pop()
            me = len(self.nodes)
            if parent is not None:
                self.nodes[parent]["kids"][side] = me
            rows = self.order[lo:hi]
            point = self.x[rows[(len(rows) * 7919) % len(rows) if len(rows) else 0]]
            far = self.x[rows[np.argmax(((self.x[rows] - point) ** 2).sum(1))]]  # a corner of the node spreads distances most
            d = np.sqrt(((self.x[rows] - far) ** 2).sum(1))
            node = {"lo": lo, "hi": hi, "kids": None}
            self.nodes.append(node)
            if hi - lo <= leaf or d.max() == d.min():
                continue
            by = np.argsort(d, kind="stable")
            self.order[lo:hi], d = rows[by], d[by]
            mid = (hi - lo) // 2
            node |= {"point": far, "ranges": ((d[0], d[mid - 1]), (d[mid], d[-1])), "split": d[mid], "kids": [0, 0]}
            stack += [(lo, lo + mid, me, 0), (lo + mid, hi, me, 1)]
        self.sorted = self.x[self.order]

    def search(self, queries: np.ndarray, k: int, factor: float, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, found) of the ``k`` nearest of every query, -1 where fewer; ``own`` is the row to leave out or -1."""
        q = np.concatenate([queries, np.zeros((len(queries), 1))], 1)
        q2 = (q**2).sum(1)
        best = np.full((len(q), k), np.inf)
        rows = np.full((len(q), k), -1)
        started = np.full(len(q), -1)

        def leaf(n: int, who: np.ndarray) -> None:
            node = self.nodes[n]
            for lo in range(node["lo"], node["hi"], 4096):
                hi = min(lo + 4096, node["hi"])
                d = np.maximum(q2[who, None] + self.top - 2 * (q[who] @ self.sorted[lo:hi].T), 0)
                name = self.order[lo:hi]
                d[name[None, :] == own[who, None]] = np.inf
                all_d, all_r = np.concatenate([best[who], d], 1), np.concatenate([rows[who], np.broadcast_to(name, d.shape)], 1)
                # ties at the k-th place: the smaller row wins, so rows must be in id order
                top = np.lexsort((all_r, all_d), axis=1)[:, :k] if all_d.shape[1] <= 2 * k else _least(all_d, all_r, k)
                best[who], rows[who] = np.take_along_axis(all_d, top, 1), np.take_along_axis(all_r, top, 1)

        def down(n: int, who: np.ndarray) -> None:
            node = self.nodes[n]
            if node["kids"] is None:
                started[who] = n
                leaf(n, who)
                return
            near = ((q[who] - node["point"]) ** 2).sum(1) < node["split"] ** 2
            for side, part in ((0, who[near]), (1, who[~near])):
                if len(part):
                    down(node["kids"][side], part)

        def visit(n: int, who: np.ndarray) -> None:
            node = self.nodes[n]
            if node["kids"] is None:
                who = who[started[who] != n]
                if len(who):
                    leaf(n, who)
                return
            d = np.sqrt(((q[who] - node["point"]) ** 2).sum(1))
            for side in (0, 1):
                lo, hi = node["ranges"][side]
                bound = np.maximum(np.maximum(d - hi, lo - d), 0)
                # a small slack keeps rounding from pruning a tie
                part = who[factor * bound <= np.sqrt(best[who, -1]) * (1 + 1e-9) + 1e-7]
                if len(part):
                    visit(node["kids"][side], part)

        everyone = np.arange(len(q))
        down(0, everyone)
        visit(0, everyone)
        rows[np.isinf(best)] = -1
        return rows, best

    def within(self, queries: np.ndarray, limit: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) of all rows whose squared distance is at most the query's ``limit``, up to rounding."""
        q = np.concatenate([queries, np.zeros((len(queries), 1))], 1)
        q2 = (q**2).sum(1)
        limit = limit + 4 * (q.shape[1] + 8) * np.finfo(float).eps * (q2 + self.top)  # more than products of any order can differ by
        reach = np.sqrt(limit) * (1 + 1e-9) + 1e-7
        pairs = [(np.zeros(0, np.int64),) * 2]

        def visit(n: int, who: np.ndarray) -> None:
            node = self.nodes[n]
            if node["kids"] is None:
                for lo in range(node["lo"], node["hi"], 4096):
                    hi = min(lo + 4096, node["hi"])
                    d = q2[who, None] + self.top - 2 * (q[who] @ self.sorted[lo:hi].T)
                    at, col = np.nonzero(d <= limit[who, None])
                    pairs.append((who[at], self.order[lo:hi][col]))
                return
            d = np.sqrt(((q[who] - node["point"]) ** 2).sum(1))
            for side in (0, 1):
                lo, hi = node["ranges"][side]
                part = who[factor * np.maximum(np.maximum(d - hi, lo - d), 0) <= reach[who]]
                if len(part):
                    visit(node["kids"][side], part)

        visit(0, np.arange(len(q)))
        return tuple(np.concatenate(x) for x in zip(*pairs, strict=True))


def _least(d: np.ndarray, r: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least by (d, r): a partition, then all that tie with its border."""
    part = np.argpartition(d, k - 1, 1)[:, :k]
    edge = np.take_along_axis(d, part, 1).max(1)
    tie = (d <= edge[:, None] * (1 + 1e-9) + 1e-12).sum(1)
    wide = int(min(tie.max(), d.shape[1]))
    if wide > k:
        part = np.argpartition(d, min(wide, d.shape[1] - 1) - 1, 1)[:, :wide]
    by = np.lexsort((np.take_along_axis(r, part, 1), np.take_along_axis(d, part, 1)), axis=1)[:, :k]
    return np.take_along_axis(part, by, 1)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v double[]) of vectors that are not null, not empty, not zero and have finite components only."""
    v = F.col(vector)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    good = v.isNotNull() & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0)
    return df.filter(F.col(key).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def search(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20, factor: float = 1.0) -> DataFrame:
    """The ``k`` nearest rows of every row whose key is divisible by ``every``.

    Returns query_id, rank, vec_id, score (inner product in double precision,
    summed in order of the components). Ties go to the smaller key; a row is no
    candidate of its own query. Vectors that are null, empty, zero or not finite
    take no part, nor do rows of a null key or of another length than the query; rows
    that repeat a key are candidates each, and the least of their vectors asks. An
    empty table gives no rows.

    Vectors are hashed to shards of about SHARD_ROWS rows, packed to one row
    each; queries are packed to blocks of QUERY_BLOCK. A task searches one shard
    for one block, so neither side is ever broadcast; a window keeps the k best
    of a query from the k of each shard.
    """
    spark = df.sparkSession
    vectors = stored(usable(df, key, vector).withColumn("size", F.size("v")), "vectors")
    n, queries = vectors.agg(F.count(F.lit(1)), F.count(F.when(F.col("id") % every == 0, 1))).first()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-queries // QUERY_BLOCK))

    def pack(batches):
        # Arrow batches of one group may come in pieces: gather, then give one packed row
        ids, flat, sizes, where = [], [], [], None
        for b in batches:
            where = b.column(0)[0].as_py() if b.num_rows else where
            ids.append(b.column(1).to_numpy())
            flat.append(b.column(2).flatten().to_numpy())
            sizes.append(b.column(3).to_numpy())
        if where is None:
            return
        ids, flat, sizes = np.concatenate(ids), np.concatenate(flat), np.concatenate(sizes)
        yield pa.RecordBatch.from_arrays([pa.array([where], pa.int32()), pa.array([ids.tobytes()]), pa.array([flat.tobytes()]), pa.array([sizes.astype("<i4").tobytes()])], names=["k", "ids", "flat", "sizes"])

    def packed(rows: DataFrame, parts: int) -> DataFrame:
        keyed = rows.select(F.pmod(F.xxhash64("id", F.lit(parts)), F.lit(parts)).cast("int").alias("k"), "id", "v", "size")
        return keyed.groupBy("k").applyInArrow(_gathered(pack), "k int, ids binary, flat binary, sizes binary")

    # a row for each (shard, block): both sides are dealt by that pair
    shard = packed(vectors, shards).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = packed(vectors.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).withColumn("size", F.size("v")), blocks).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("k"), F.col("k").alias("block"), F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"), F.col("sizes").alias("q_sizes"))
    pairs = shard.join(asked, ["k", "block"])

    def find(batches):
        for b in batches:
            for ids, flat, sizes, q_ids, q_flat, q_sizes in zip(*(b.column(c).to_pylist() for c in ("ids", "flat", "sizes", "q_ids", "q_flat", "q_sizes")), strict=True):
                yield from _search_packed(_unpacked(ids, flat, sizes), _unpacked(q_ids, q_flat, q_sizes), k, factor)

    found = pairs.mapInArrow(find, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def _gathered(pack):
    """applyInArrow hands over a table; ``pack`` takes batches."""

    def run(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(pack(t.to_batches())))

    return run


def _unpacked(ids: bytes, flat: bytes, sizes: bytes) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of the vectors: (ids in order, matrix)."""
    ids, flat, sizes = np.frombuffer(ids, np.int64), np.frombuffer(flat, np.float64), np.frombuffer(sizes, "<i4")
    start = np.cumsum(sizes) - sizes
    out = {}
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        at = at[np.argsort(ids[at], kind="stable")]
        out[int(size)] = ids[at], flat[start[at][:, None] + np.arange(size)]
    return out


def _search_packed(rows: dict, queries: dict, k: int, factor: float):
    for size, (q_ids, q) in queries.items():
        if size not in rows:
            continue
        ids, x = rows[size]
        # equal vectors are one point, whose rows stand in id order from first[point] on
        seen: dict[bytes, int] = {}
        point = np.array([seen.setdefault(v.tobytes(), len(seen)) for v in x])
        members = np.argsort(point, kind="stable")
        count = np.bincount(point)
        first = np.cumsum(count) - count
        x = x[members[first]]
        tree, scale = Tree(x / float(np.abs(x).max())), float(np.abs(q).max())  # keeps squares finite
        # rows of the query's own id are no candidates: so many places more are looked at
        own = np.searchsorted(ids, q_ids, "right") - np.searchsorted(ids, q_ids, "left")
        for extra in np.unique(own):
            some = np.flatnonzero(own == extra)
            for who in np.split(some, range(QUERY_PART, len(some), QUERY_PART)):
                yield _best(tree, q[who] / scale, q[who], q_ids[who], x, ids, members, first, count, k, k + int(extra), factor)


def _best(tree: Tree, scaled, q, q_ids, x, ids, members, first, count, k: int, wide: int, factor: float) -> pa.RecordBatch:
    """The ``k`` best rows of every query by exact score and id, from all points as near as the ``wide``-th, ties and rounding included."""
    _, best = tree.search(scaled, wide, factor, np.full(len(q), -1))
    at, of = tree.within(scaled, best[:, -1], factor)
    score = np.zeros(len(at))
    for c in range(q.shape[1]):  # in order of the components, for any batch alike
        score += q[at, c] * x[of, c]
    # rows of one point tie, so its first ``wide`` ids are enough
    n = np.minimum(count[of], wide)
    row = members[np.repeat(first[of] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    at, score = np.repeat(at, n), np.repeat(score, n)
    keep = ids[row] != q_ids[at]
    at, row, score = at[keep], row[keep], score[keep]
    by = np.lexsort((ids[row], -score, at))
    at, row, score = at[by], row[by], score[by]
    top = np.arange(len(at)) - np.searchsorted(at, np.arange(len(q_ids)))[at] < k
    return pa.RecordBatch.from_arrays([pa.array(q_ids[at[top]]), pa.array(ids[row[top]]), pa.array(score[top])], names=["query_id", "vec_id", "score"])
