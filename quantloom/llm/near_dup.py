"""Near duplicates by a chosen-path set similarity join.

Documents are sets of hashed word shingles. Equal sets collapse to one node
first. A tree branches the nodes by selected minwise tokens: its root by one
coordinate of their signatures, a branch that still holds over SMALL nodes by one
or two further coordinates (1.25 on average, the inverse of the similarity, so a
similar pair is expected to stay together once a level), chosen by the branch's
path, the same for all its nodes. Trees are independent; TREES of them bring the
chance to miss a pair at the threshold below 1e-5. Small branches are compared
exhaustively on sketches, and what may be similar is confirmed on the full sets.
A branch of up to BRANCH nodes is one row group of a task, which goes on with its
tree in memory; larger ones branch on as tables, level by level.
What sketches connect is a family; full sets are gathered once per family, not per
pair, and compared all with all by a product of 0/1 matrices. Only connectivity
is asked for, so a family gives at most a link per node. A large branch of mostly
near copies, which no level would split, is connected through its leaders. In a
family of over FAMILY nodes each node is confirmed with its most similar leader
first, and then only nodes outside the largest component are compared with the
whole family, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_array, by_chunk, drop_stored, mix64, stored, tidily, utf8
from .components import components
from .words import Words

COORDS, TREES, SMALL, DEPTH = 128, 16, 128, 3
BRANCH = 8192  # nodes of a branch that one task follows further
LEADERS = 4  # of a large branch
CHUNK = 1 << 20  # text bytes of one pass
FAMILY = 2048  # nodes that are compared all with all in one task
MARGIN = 0.17  # a sketch may fall short of the threshold by this (4.8 standard deviations of 128 coordinates)
BITS = 1 << 26  # of the filter of the documents whose sets are needed: 8 MB at any size

_rng = np.random.default_rng(97)
_A = _rng.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(row: np.ndarray, h: np.ndarray, docs: int) -> np.ndarray:
    """(documents, COORDS) 32-bit minwise values; rows without shingles are all ones."""
    out = np.full((docs, COORDS), 0xFFFFFFFF, np.uint32)
    if len(h):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        who = row[first]
        x = mix64(h)
        for k in range(COORDS):
            out[who, k] = np.minimum.reduceat(((x * _A[k]) >> np.uint64(32)).astype(np.uint32), first)
    return out


def node_ids(row: np.ndarray, h: np.ndarray, docs: int) -> np.ndarray:
    """A 64-bit digest of each set."""
    total = np.zeros(docs, np.uint64)
    if len(h):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        total[row[first]] = np.add.reduceat(mix64(h ^ np.uint64(0xD6E8FEB86659FD93)), first) + np.diff(np.append(first, len(h))).astype(np.uint64)
    return mix64(total).view(np.int64)


def text_mark(text: str) -> Column:
    """64 bits of a digest of a whole text: with the key they tell rows apart."""
    return F.xxhash64(F.sha2(F.col(text), 256))


def sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, mark, n, node, roots, sketch) of every row; the last three null for empty sets. Roots are 32-bit tokens, one a tree; sketches hold 8 bits of every coordinate."""

    def run(batches):
        def work(rows, data, offsets):
            docs = rows.num_rows
            row, h = Words(data, offsets, lower=True).shingles(shingle)
            n = np.bincount(row, minlength=docs)
            sig = signatures(row, h, docs)
            none = n == 0
            short = (sig * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
            node = pa.array(node_ids(row, h, docs), mask=none)
            wide = binary_array(sig[:, :TREES].astype("<u4"), np.full(docs, 4 * TREES))
            thin = binary_array(short, np.full(docs, COORDS))
            empty = pa.nulls(docs, pa.binary())
            keep = pa.array(~none)
            return pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(n.astype(np.int64)), node, pc.if_else(keep, wide, empty), pc.if_else(keep, thin, empty)], names=["doc_id", "mark", "n", "node", "roots", "sketch"])

        yield from by_chunk(batches, "text", work, CHUNK)

    return docs.withColumn("mark", text_mark("text")).mapInArrow(tidily(run), "doc_id long, mark long, n long, node long, roots binary, sketch binary")



def branches(nodes: DataFrame, least: float) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Tables of branches that a task follows further (path, node, depth), of larger ones that no level would split (path, a: leader, b: node, est), and pairs (a, b, est) of such a branch's nodes with its most similar leader.

    A large branch whose nodes are mostly alike is taken out of the tree at once:
    further tokens would keep it together. Others branch on, up to DEPTH levels.
    """
    thin = nodes.select("node", "sketch")
    roots = F.array(*(F.xxhash64(F.lit(r), F.substring("roots", 4 * r + 1, 4)) for r in range(TREES)))
    level = nodes.select("node", F.explode(roots).alias("path"))
    small: list[DataFrame] = []
    whole: list[DataFrame] = []
    pairs: list[DataFrame] = []
    for depth in range(DEPTH + 1):
        sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        held = stored(level.join(sizes, "path").select("path", "node", "size"), "branches")
        small.append(held.filter(F.col("size") <= BRANCH).select("path", "node", F.lit(depth).alias("depth")))
        large = held.filter(F.col("size") > BRANCH).select("path", "node")
        if large.isEmpty():
            break
        chosen = F.array_distinct(F.array(*(F.min_by("node", F.xxhash64("node", "path", F.lit(i))) for i in range(LEADERS))))
        lead = large.groupBy("path").agg(chosen.alias("all")).select("path", F.explode("all").alias("lead"))
        lead = lead.join(thin.select(F.col("node").alias("lead"), F.col("sketch").alias("other")), "lead")
        lead = lead.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("lead", "other"))).alias("leads"))  # LEADERS at most
        near = stored(large.join(thin, "node").join(lead, "path").select("path", "node", "sketch", "leads.lead", "leads.other").mapInArrow(_against(least), "path long, a long, b long, est double, best boolean"), "leaders")
        pairs.append(near.filter(F.col("est") >= least).select("a", "b", "est"))
        near = near.filter("best")
        alike = near.groupBy("path").agg(F.avg(F.when(F.col("est") >= least, 1.0).otherwise(0.0)).alias("share"))
        done = alike.filter(F.lit(depth == DEPTH) | (F.col("share") >= 0.5)).select("path")
        whole.append(near.join(done, "path", "left_semi"))
        wide = near.join(done, "path", "left_anti").select("path", F.col("b").alias("node")).join(thin, "node")
        at = lambda j: F.pmod(F.xxhash64("path", F.lit(j)), F.lit(COORDS)).cast("int")
        child = lambda j: F.xxhash64(F.col("path"), F.lit(j), F.substring("sketch", at(j) + 1, F.lit(1)))
        one, two = F.array(child(1)), F.array(child(1), child(2))
        level = wide.select("node", F.explode(F.when(F.pmod(F.xxhash64("path", F.lit(3)), F.lit(4)) == 0, two).otherwise(one)).alias("path"))
    return small, whole, pairs


def _against(least: float):
    """(path, node, sketch, leaders, their sketches) to (path, other leader, node, estimate, best): those of ``least`` or more, and the best in any case."""

    def run(batches):
        for b in batches:
            node = b.column(1).to_numpy()
            sketch = utf8(b.column(2))[0].reshape(-1, COORDS)
            count = np.diff(b.column(3).offsets.to_numpy())
            lead = b.column(3).flatten().to_numpy()
            other = utf8(b.column(4).flatten())[0].reshape(-1, COORDS)
            row = np.repeat(np.arange(len(node)), count)
            est = np.where(lead == node[row], -1.0, ((sketch[row] == other).mean(1) - 1 / 256) * (256 / 255))
            order = np.lexsort((lead, -est, row))
            best = np.zeros(len(lead), bool)
            best[order[np.cumsum(count) - count]] = True
            keep = np.flatnonzero(best | (est >= least))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[keep])), pa.array(lead[keep]), pa.array(node[row[keep]]), pa.array(est[keep]), pa.array(best[keep])], names=["path", "a", "b", "est", "best"])

    return run


def _beyond(whole: DataFrame, thin: DataFrame, least: float) -> DataFrame:
    """Pairs of a large branch's nodes that no leader is like with the branch, in blocks: a node has one pair per block and leader of what it is like."""
    near = F.col("est") >= least
    marked = whole.select("path", F.col("b").alias("node"), F.when(near, F.col("a")).otherwise(F.col("b")).alias("lead"), (~near).alias("out"))
    sizes = marked.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / FAMILY).cast("int").alias("blocks"), F.ceil(F.count(F.when(F.col("out"), 1)) / FAMILY).cast("int").alias("outs")).filter("outs > 0")
    rows = marked.join(sizes, "path").join(thin, "node")
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    group = lambda a, b: F.xxhash64("path", a, b).alias("path")
    fixed = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("outs") - 1))).select(group(own(F.col("blocks")), F.col("j")), "node", "sketch", "lead", F.lit(1).alias("side"))
    copied = rows.filter("out").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(group(F.col("i"), own(F.col("outs"))), "node", "sketch", "lead", F.lit(0).alias("side"))

    def run(batches):
        for rows, starts in whole_groups(batches):
            node, lead, side = (rows.column(k).to_numpy() for k in (1, 3, 4))
            sketch = utf8(rows.column(2))[0].reshape(-1, COORDS)
            out: list = []
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                fixed = i + np.flatnonzero(side[i:j] == 1)
                for k in i + np.flatnonzero(side[i:j] == 0):
                    est = _alike(sketch[k], sketch[fixed]) if len(fixed) else np.zeros(0)
                    hit = np.flatnonzero((est >= least) & (node[fixed] != node[k]))
                    if len(hit):
                        _, one = np.unique(lead[fixed[hit]], return_index=True)
                        out += [(int(min(node[k], node[m])), int(max(node[k], node[m])), float(e)) for m, e in zip(fixed[hit[one]], est[hit[one]], strict=True)]
            if out:
                yield _pair_batch(out)

    return fixed.union(copied).repartition("path").sortWithinPartitions("path").mapInArrow(tidily(run), _pairs_schema())


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by their first column, cut so that none of its groups is split: (rows, first row of each group and the end)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        keys = b.column(0).to_numpy()
        if keys[-1] == held[0].column(0)[0].as_py():
            continue
        cut = int(np.searchsorted(keys == keys[-1], True))
        done = held[:-1] + [b.slice(0, cut)]
        held = [b.slice(cut)]
        t = pa.Table.from_batches(done).combine_chunks()
        if t.num_rows:
            rows = t.to_batches()[0]
            yield rows, _starts(rows)
    if held:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield rows, _starts(rows)


def _starts(rows: pa.RecordBatch) -> np.ndarray:
    k = rows.column(0).to_numpy()
    return np.append(np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])), len(k))


def _alike(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarity of a sketch with many; 8-bit values agree by chance once in 256."""
    return ((many == one).mean(1) - 1 / 256) * (256 / 255)


def _pairs_schema():
    return "a long, b long, est double"


def _tree(least: float):
    """Groups of (path, node, depth, sketch): the pairs that connect what is alike in the branch of a tree."""

    def run(batches):
        for rows, starts in whole_groups(batches):
            path, node, depth = (rows.column(k).to_numpy() for k in range(3))
            sketch = utf8(rows.column(3))[0].reshape(-1, COORDS)
            two = starts[:-1][np.diff(starts) == 2]
            est = ((sketch[two] == sketch[two + 1]).mean(1) - 1 / 256) * (256 / 255)
            two, est = two[est >= least], est[est >= least]
            found = [(np.minimum(node[two], node[two + 1]), np.maximum(node[two], node[two + 1]), est)]
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if j - i > 2:
                    order = i + np.argsort(node[i:j])
                    found += _follow(node[order], sketch[order], path[i : i + 1].view(np.uint64), int(depth[i]), least)
            a, b, e = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(e)], names=["a", "b", "est"])

    return run


def _follow(node: np.ndarray, sketch: np.ndarray, path: np.ndarray, depth: int, least: float) -> list:
    """Pairs (a, b, est) of a branch whose nodes come in order: small ones all with all, others through leaders or by further tokens."""
    if len(node) < 2:
        return []
    if len(node) <= SMALL:
        return _compared(node, sketch, np.arange(len(node)), least)
    leads = np.unique([np.argmin(mix64(node.view(np.uint64) ^ mix64(path + np.uint64(k)))) for k in range(LEADERS)])
    est = np.stack([_alike(sketch[k], sketch) for k in leads])
    near = est >= least
    near[np.arange(len(leads)), leads] = False
    k, row = np.nonzero(near)
    out = [(node[leads[k]], node[row], est[k, row])]
    alone = np.flatnonzero(~near.any(0))
    if depth >= DEPTH or 2 * (len(node) - len(alone)) >= len(node):
        return out + _compared(node, sketch, alone, least)
    for which in (1, 2) if int(mix64(path + np.uint64(3))[0]) % 4 == 0 else (1,):
        key = mix64(path + np.uint64(16 + which))
        token = sketch[:, int(key[0] % np.uint64(COORDS))]
        order = np.argsort(token, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(token[order])) + 1):
            out += _follow(node[part], sketch[part], mix64(key + token[part[:1]]), depth + 1, least)
    return out


def _compared(node: np.ndarray, sketch: np.ndarray, some: np.ndarray, least: float) -> list:
    """Rows ``some`` against all: of what is connected, a pair for each row but the least."""
    label = np.arange(len(node))
    step = max(1, (32 << 20) // max(1, len(node) * COORDS))
    hits = []
    for lo in range(0, len(some), step):
        part = some[lo : lo + step]
        same = np.stack([(sketch == sketch[k]).sum(1) for k in part])
        k, row = np.nonzero((same / COORDS - 1 / 256) * (256 / 255) >= least)
        keep = part[k] != row
        hits.append((part[k[keep]], row[keep]))
    if not hits:
        return []
    a, b = (np.concatenate(x) for x in zip(*hits, strict=True))
    while True:  # roots hook onto smaller roots until every hit lies within one
        x, y = label[a], label[b]
        if (x == y).all():
            break
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label != label[label]).any():
            label = label[label]
    joined = np.flatnonzero(label != np.arange(len(node)))
    est = ((sketch[joined] == sketch[label[joined]]).mean(1) - 1 / 256) * (256 / 255)
    return [(node[label[joined]], node[joined], est)]


def _pair_batch(out: list) -> pa.RecordBatch:
    a, b, e = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(e, pa.float64())], names=["a", "b", "est"])


def exact_links(batches, percent: int):
    """Groups of (group, node, side, items): links (a, b) that connect what is similar on full sets.

    Rows of side 0 are compared with all rows of their group. Intersections of
    all pairs at once are a product of the 0/1 matrix of sets and shared tokens,
    taken in slices of bounded size. A group gives at most one link per node.
    """
    for rows, starts in whole_groups(batches):
        node, side = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        data, off = utf8(rows.column(3))
        data, off = data.view(np.uint64), off // 8
        out_a, out_b = [], []
        for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            head = np.flatnonzero(side[i:j] == 0)
            if j - i < 2 or not len(head):
                continue
            size = np.diff(off[i : j + 1])
            if j - i == 2:
                both = np.sort(data[off[i] : off[j]])
                shared = np.array([[0, int((both[1:] == both[:-1]).sum())]])
                head = head[:1]
                if head[0] == 1:
                    shared = shared[:, ::-1]
            else:
                shared = _shared(data[off[i] : off[j]], np.repeat(np.arange(j - i), size), head, j - i)
            alike = np.empty(shared.shape, bool)
            for lo in range(0, len(head), 256):  # wide integers for some rows at a time
                some = shared[lo : lo + 256].astype(np.int64)
                alike[lo : lo + 256] = (100 + percent) * some >= percent * (size[head[lo : lo + 256]][:, None] + size[None, :])
            del shared
            alike[np.arange(len(head)), head] = False
            label, none = np.arange(j - i, dtype=np.int32), np.int32(j - i)
            while True:  # least label of a node's similar ones, both ways, until nothing changes
                new = label.copy()
                low = new[head]
                for h in range(0, len(head), 256):
                    np.minimum(low[h : h + 256], np.where(alike[h : h + 256], label[None, :], none).min(1), out=low[h : h + 256])
                new[head] = low
                for h in range(0, len(head), 256):
                    np.minimum(new, np.where(alike[h : h + 256], low[h : h + 256, None], none).min(0), out=new)
                if (new == label).all():
                    break
                label = new
            name = np.full(j - i, np.iinfo(np.int64).max)
            np.minimum.at(name, label, node[i:j])
            joined = np.flatnonzero(name[label] != node[i:j])
            out_a += name[label[joined]].tolist()
            out_b += node[i:j][joined].tolist()
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def _shared(items: np.ndarray, row: np.ndarray, head: np.ndarray, rows: int) -> np.ndarray:
    """(head, rows): sizes of intersections."""
    order = np.argsort(items)
    items, row = items[order], row[order]
    new = np.ones(len(items), bool)
    new[1:] = items[1:] != items[:-1]
    token = np.cumsum(new) - 1
    common = np.bincount(token)[token] > 1  # what only one set has is in no intersection
    token, row = token[common], row[common]
    out = np.zeros((len(head), rows), np.int32)
    if not len(token):
        return out
    starts = np.ones(len(token), bool)
    starts[1:] = token[1:] != token[:-1]
    token = np.cumsum(starts) - 1
    wide = max(64, (1 << 20) // rows)
    for lo in range(0, int(token[-1]) + 1, wide):
        a, b = np.searchsorted(token, [lo, lo + wide])
        m = np.zeros((rows, wide), np.float32)
        m[row[a:b], token[a:b] - lo] = 1
        for h in range(0, len(head), 256):  # products of bounded size
            out[h : h + 256] += np.rint(m[head[h : h + 256]] @ m.T).astype(np.int32)
    return out


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, items) of the nodes in ``wanted``, from the texts of their representatives.

    A filter of BITS bits, of one size whatever the input, spares the other texts.
    """
    wanted = stored(nodes.select("node", "rep").join(wanted.select("node").distinct(), "node"), "wanted")
    maps = wanted.groupBy(F.expr(f"bitmap_bucket_number(pmod(xxhash64(rep), {BITS}l) + 1)").alias("at")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position(pmod(xxhash64(rep), {BITS}l) + 1))").alias("bits")).collect()
    filled = np.zeros(BITS // 8 + 8192, np.uint8)
    for r in maps:  # 4 KB each, BITS bits at most
        start = (r["at"] - 1) * 4096
        filled[start : start + 4096] = np.frombuffer(r["bits"], np.uint8)

    def sets(batches):
        def work(rows, data, offsets):
            row, h = Words(data, offsets, lower=True).shingles(shingle)
            n = np.bincount(row, minlength=rows.num_rows)
            return pa.RecordBatch.from_arrays([rows.column(0), pa.array(node_ids(row, h, rows.num_rows)), binary_array(h, 8 * n)], names=["rep", "node", "items"])

        for b in batches:
            bits = b.column(2).to_numpy()
            kept = b.filter(pa.array((filled[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)))
            yield from by_chunk([kept.select([0, 1])], "text", work, CHUNK)

    keyed = docs.withColumn("bit", F.expr(f"bitmap_bit_position(pmod(xxhash64(doc_id), {BITS}l) + 1) + (bitmap_bucket_number(pmod(xxhash64(doc_id), {BITS}l) + 1) - 1) * 32768"))
    return keyed.mapInArrow(tidily(sets), "rep long, node long, items binary").join(wanted, ["rep", "node"], "left_semi").groupBy("node").agg(F.first("items").alias("items"))


def confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets have ``100 * intersection >= percent * union``."""
    items = full_sets(docs, nodes, pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b"))), shingle)
    full = pairs.select("a", "b").join(items.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(items.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")

    def check(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(both) - same))
            yield b.select([2, 3]).filter(pa.array(keep, pa.bool_()))

    return full.select("x", "y", "a", "b").mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """A row per row of ``docs``: key, n_shingles, component_id (least key linked with it, itself included), kept.

    Sets are of distinct ``shingle``-word shingles of the text with A-Z
    lower-cased; a shorter text is one shingle; a text without words, empty or
    null, is linked with nothing. Rows of a null key take no part: their component
    is null and they are kept. Rows that repeat a key are documents of their own
    with the same name. Other columns are not read; an empty table gives no rows.
    """
    out = _labelled(docs, key, text, shingle, percent)
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.col("name").alias("component_id"), F.coalesce(F.col("name") == F.col("doc_id"), F.lit(True)).alias("kept"))


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near copies: of every component the row of the least key (of equal keys, the least mark of the text) stays; all columns stay.

    Rows are judged by key and text, so a key with several texts loses only those
    that resemble another row. Of rows equal in key and text one stays. Rows
    without words or with a null key all stay.
    """
    found = _labelled(docs, key, text, shingle, percent).filter("name is not null and node is not null").select("doc_id", "mark", "group", "name")
    best = found.filter("doc_id = name").groupBy("group").agg(F.min("mark").alias("best"))
    # nearly every row is its own component: only the others are joined back
    gone = found.join(best, "group").filter("doc_id <> name or mark <> best").select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct()
    lost = gone.alias("gone")
    same = (F.col(f"docs.{key}").cast("long") == F.col("gone.gone_id")) & (text_mark(f"docs.{text}") == F.col("gone.gone_mark"))
    kept = docs.alias("docs").join(lost, same, "left_anti")
    # rows that repeat key and text are copies as well; there are few, so only they are compared
    twice = stored(docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col(key).alias("again")), "repeated-ids")
    if twice.isEmpty():
        drop_stored(twice)
        return kept
    again = F.col(f"docs.{key}") == F.col("twice.again")
    once, more = (kept.join(twice.alias("twice"), again, how) for how in ("left_anti", "left_semi"))
    return once.union(more.dropDuplicates([key, text]))


def _labelled(docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """(doc_id, mark, n, node, group, name) of every row: ``name`` is the least key of its component, which ``group`` tells from others of that key."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = stored(sketched(source, shingle), "sketches")
    nodes = stored(rows.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min(F.struct("doc_id", "roots", "sketch")).alias("x")).select("node", F.col("x.doc_id").alias("rep"), "x.roots", "x.sketch"), "nodes")
    least = percent / 100 - MARGIN
    small, whole, leaders = branches(nodes, least)
    thin = nodes.select("node", "sketch")
    members = _union(small).join(thin, "node").select("path", "node", "depth", "sketch")
    star = _union([members.repartition("path").sortWithinPartitions("path").mapInArrow(tidily(_tree(least)), _pairs_schema()), *leaders])
    if whole:
        star = star.union(_beyond(_union(whole), thin, least))
    pairs = stored(star.groupBy("a", "b").agg(F.max("est").alias("est")), "pairs")
    for used in (*small, *leaders):
        drop_stored(used)
    # a family is what sketches connect: all pairs that may be similar lie within one
    family = stored(components(pairs).withColumnRenamed("component", "family"), "families")
    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("k"))
    placed = stored(family.join(sizes, "family"), "families")
    few = placed.filter(F.col("k") <= FAMILY)
    items = full_sets(source, nodes, few, shingle).join(few.select("node", "family"), "node")
    exact = lambda batches: exact_links(batches, percent)
    grouped = lambda df: df.repartition("group").sortWithinPartitions("group").mapInArrow(tidily(exact), "a long, b long")
    links = stored(grouped(items.select(F.col("family").alias("group"), "node", F.lit(0).alias("side"), "items")), "links")
    # a small family's links are stars around the least node, and its nodes are in no other family
    found = links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(links.select(F.col("a"), F.col("a")).distinct())
    many = placed.filter(F.col("k") > FAMILY)
    if not many.isEmpty():
        found = found.union(components(_large_families(source, nodes, pairs, many, shingle, percent, grouped)))
    found = stored(found, "components")
    # a component's name is the least key among the documents of its nodes
    placed = nodes.select("node", "rep").join(found, "node")
    names = placed.groupBy("component").agg(F.min("rep").alias("name"))
    labels = placed.join(names, "component").select("node", F.col("component").alias("group"), "name")
    plain = nodes.join(found, "node", "left_anti").select("node", F.col("node").alias("group"), F.col("rep").alias("name"))
    out = rows.select("doc_id", "mark", "n", "node").join(labels.union(plain), "node", "left")
    name = F.when(F.col("doc_id").isNotNull(), F.coalesce("name", "doc_id"))
    return out.select("doc_id", "mark", "n", "node", "group", name.alias("name"))


def _large_families(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, many: DataFrame, shingle: int, percent: int, grouped) -> DataFrame:
    """Links of families of over FAMILY nodes: each node with its most similar leader first, then all nodes outside a family's largest component with the whole family, in blocks."""
    best = pairs.join(many.select(F.col("node").alias("b")), "b").groupBy("b").agg(F.max(F.struct("est", "a")).alias("x")).select("x.a", "b")
    first = stored(confirmed(docs, nodes, best, shingle, percent), "confirmed")
    found = components(first)
    m = stored(many.join(found, "node", "left").select("node", "family", "k", F.coalesce("component", "node").alias("component")), "large")
    sizes = m.groupBy("family", "component").agg(F.count(F.lit(1)).alias("c"))
    most = sizes.groupBy("family").agg(F.max(F.struct("c", "component")).alias("x"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    blocks = lambda n: F.ceil(n / FAMILY).cast("int")
    plan = most.select("family", F.col("x.component").alias("main"), blocks(F.col("n")).alias("all_blocks"), blocks(F.col("n") - F.col("x.c")).alias("out_blocks"))
    items = full_sets(docs, nodes, m.join(plan, "family", "left_semi"), shingle)
    rows = m.join(plan, "family").join(items, "node")
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    group = lambda a, b: F.xxhash64("family", a, b).alias("group")
    fixed = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1))).select(group(own(F.col("all_blocks")), F.col("j")), "node", F.lit(1).alias("side"), "items")
    outside = rows.filter(F.col("component") != F.col("main")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)))
    copied = outside.select(group(F.col("i"), own(F.col("out_blocks"))), "node", F.lit(0).alias("side"), "items")
    return first.union(grouped(fixed.union(copied)))
