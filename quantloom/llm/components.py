"""Connected components of links too many for one machine: contraction within tasks, large-star and small-star steps over stored tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored

LINKS = 1_000_000  # that a task contracts


def _large_star(e: DataFrame) -> DataFrame:
    """For every u, link its larger neighbours to the least of u and its neighbours."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """For every u, link itself and its smaller neighbours to the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select("v", "m").union(least.select("u", "m")).toDF("u", "v")


def contracted(links: DataFrame) -> DataFrame:
    """A star per connected part of what each task holds: (u, v), v the least node of u's part."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            node, label = _labels(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)))
            moved = np.flatnonzero(label != np.arange(len(node)))
            for lo in range(0, len(moved), 1 << 17):
                some = moved[lo : lo + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label[some]])], names=["u", "v"])

    return links.mapInArrow(run, "u long, v long")


def _labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in order and the place of the least node of each one's part: roots hook onto smaller roots."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(node))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return node, label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long); the component is its least node.

    Links are contracted to stars task by task, LINKS of them to a task; where one
    task held them all, that is the answer. Otherwise large-star and small-star
    steps follow, contracted again each round. Aggregates run before each shuffle
    and joins are plain equi-joins, so a node with very many links is split like
    any skewed key. Every round is a table in the shared folder; the one before is
    deleted.
    """
    e = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    mark = None
    for _ in range(rounds):
        tasks = max(1, -(-e.count() // LINKS))
        new = stored(contracted(e.coalesce(tasks)), "links")
        drop_stored(e)
        e = new
        if tasks == 1:
            break
        star = stored(_small_star(_large_star(e)).filter("u <> v").distinct(), "links")
        got = tuple(star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_stored(e)
        e = star
        if got == mark:
            break
        mark = got
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
