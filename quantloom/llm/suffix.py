"""Removal of repeated passages by suffix arrays: every byte covered by a string of WINDOW bytes that also starts earlier.

Where a string of WINDOW bytes repeats, so does the least GRAM-byte gram in it
(its anchor). Windows of a text that share an anchor form a run; runs of equal
anchors are the only ones that can hold equal windows, wherever they are. So

1. every run sends fingerprints (anchor, whole run), its place and length to the
   anchor's shard; within a batch equal runs are already reduced to the first;
2. an anchor's shard knows then: anchors of one run are no repeats; of equal runs
   all but the first are repeats; runs of one anchor that differ stay open;
3. open runs send their bytes. A shard of open runs gets a suffix array
   (Larsson-Sadakane refinement), common prefixes of neighbours (Kasai) and with
   them the classes of equal windows; arrays of large shards are built in parts
   and merged by binary search of one part's classes in the other's. Of a class
   all windows but the first are repeats;
4. repeats go back to their documents, which drop what they cover.

Shards are of bounded size whatever the input: their number follows the bytes. An
anchor with very many different runs (a passage in as many variants) is spread by
128-bit digests of its windows instead, which settle them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_array, chunks, mix64, stored, text_bytes, tidied, tidily, utf8

WINDOW, GRAM = 100, 20
SPAN = WINDOW - GRAM + 1  # grams in a window
ANCHOR_SHARD = 4 << 20  # text bytes for which one shard of anchors stands
TEXT_SHARD = 3 << 20  # text bytes of one shard of documents
OPEN_SHARD = 2 << 20  # text bytes for which one shard of open runs stands
CHUNK_BYTES = 1 << 20  # text bytes of one numpy pass
PART = 1 << 20  # bytes of open runs in one suffix array
WIDE = 4096  # different runs of one anchor, beyond which its windows are spread
BITS = 1 << 26  # of the filter of documents that hold repeats: 8 MB at any size
FIRST = -(2**63)  # stands for a null key, which sorts first

_rng = np.random.default_rng(31)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every position, by doubling."""
    h = _BYTE[data]
    two = h[:-1] * _MULT[0] + h[1:]
    four = two[:-2] * _MULT[1] + two[2:]
    eight = four[:-4] * _MULT[2] + four[4:]
    sixteen = eight[:-8] * _MULT[3] + eight[8:]
    n = len(data) - GRAM + 1
    return mix64(sixteen[:n] * _MULT[4] + four[16 : 16 + n])


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows by anchor: (row, first window's place in data, windows, anchor hash)."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if len(data) < WINDOW:
        return none
    g = grams(data)
    # the least gram, leftmost of equals: the place is in the low bits
    place = np.uint64((1 << 24) - 1)
    if len(g) > int(place):
        raise ValueError("too many bytes in one piece")
    low = (g & ~place) | np.arange(len(g), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = SPAN - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    at = (low & place).astype(np.int64)
    # windows that lie within a document
    length = np.diff(offsets)
    fits = np.zeros(len(data) + 1, np.int32)
    long = length >= WINDOW
    np.add.at(fits, offsets[:-1][long], 1)
    np.add.at(fits, offsets[1:][long] - WINDOW + 1, -1)
    start = np.flatnonzero(np.cumsum(fits)[: len(at)] > 0)
    if not len(start):
        return none
    anchor = at[start]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(new)
    lo, count = start[first], np.diff(np.append(first, len(start)))
    return np.searchsorted(offsets, lo, "right") - 1, lo, count, g[anchor[first]]


class Fingerprints:
    """Hashes of byte ranges from prefix sums."""

    _power = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)
    _R = np.uint64(0x9E3779B97F4A7C15)
    _S = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def __init__(self, data: np.ndarray):
        cls, n = Fingerprints, len(data) + 1
        if len(cls._power) < n:
            size = max(n, CHUNK_BYTES + (1 << 18))
            cls._power, cls._inverse = (np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, x))]) for x in (cls._R, cls._S))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * cls._power[: n - 1])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * Fingerprints._inverse[start] + (end - start).astype(np.uint64) * _MULT[5])


# --- suffix arrays -----------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes (Larsson-Sadakane).

    Ranks by 8 bytes come first; each round doubles the depth by sorting on the
    rank that many bytes on, only within groups that are not yet single. What lies
    behind the end counts as least. The order is full, as Kasai's walk needs it.
    """
    n = len(text)
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key <<= np.uint64(8)
        key |= wide[k : n + k]
    return sorted_suffixes(key, 8)


def sorted_suffixes(key: np.ndarray, h: int) -> np.ndarray:
    """Suffixes in order, given a key that ranks them by their first ``h`` letters."""
    n = len(key)
    sa = np.argsort(key).astype(np.int32)
    key = key[sa]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    group = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), np.int32(0)))
    rank = np.empty(n, np.int32)
    rank[sa] = group
    while True:
        single = head.copy()
        single[:-1] &= head[1:]
        open_at = np.flatnonzero(~single).astype(np.int32)  # places in sa of groups that hold more than one
        if not len(open_at):
            return sa
        who = sa[open_at]
        follow = who.astype(np.int64) + h
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)] + np.int64(1), 0)
        second |= group[open_at].astype(np.int64) << 32
        by = np.argsort(second)
        sa[open_at] = who[by]
        second = second[by]
        split = np.ones(len(by), bool)
        split[1:] = second[1:] != second[:-1]
        head[open_at] = split
        group[open_at] = np.maximum.accumulate(np.where(split, open_at, np.int32(0)))
        rank[sa[open_at]] = group[open_at]
        h *= 2


def kasai(text: np.ndarray, sa: np.ndarray, cap: int, lanes: int = 4096) -> np.ndarray:
    """Common prefix of every suffix in ``sa`` with the one before it, up to ``cap`` bytes.

    Kasai's walk in text order - a prefix of l at one position leaves at least
    l - 1 at the next - taken by many lanes at once, each over its own stretch.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int32)
    each = -(-n // min(lanes, n)) if n else 1
    i = np.arange(0, n, each)
    stop = np.minimum(i + each, n)
    length = np.zeros(len(i), np.int64)
    padded = np.concatenate([text, np.zeros(cap + 1, np.uint8)])
    while len(i):
        j = before[i]
        a, b = i + length, j + length
        more = (j >= 0) & (length < cap) & (a < n) & (b < n)
        more &= padded[a] == padded[np.where(more, b, 0)]
        done = ~more
        out[i[done]] = length[done]
        length = np.where(more, length + 1, np.maximum(length - 1, 0))
        i = i + done
        left = i < stop
        if not left.all():
            i, stop, length = i[left], stop[left], length[left]
    lcp = out[sa]
    return lcp


def window_classes(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (their starts in ``text``) in suffix order, and for each whether it begins a class of equal windows."""
    sa = suffix_array(text)
    lcp = kasai(text, sa, WINDOW)
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    hit = wanted[sa]
    # between two wanted neighbours the least common prefix on the way counts: a class border is any drop
    border = np.cumsum(lcp < WINDOW)[hit]
    order = sa[hit]
    return order, np.concatenate([[True], border[1:] != border[:-1]]) if len(order) else np.zeros(0, bool)


def first_places(text: np.ndarray, length: np.ndarray, windows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For every window of the runs in ``text`` (one after the other, ``length`` bytes each), whether an equal one is before it.

    ``order`` ranks the runs; windows of a run follow each other. Parts of about
    PART bytes get suffix arrays of their own, whose classes are then merged.
    """
    base = np.cumsum(length) - length
    run = np.repeat(np.arange(len(length)), windows)
    inner = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin, value = base[run] + inner, order[run] << 8 | inner
    repeated = np.zeros(len(run), bool)
    where = np.zeros(len(text), np.int64)
    where[begin] = np.arange(len(run))
    names, least, holder = np.zeros(0, f"S{WINDOW}"), np.zeros(0, np.int64), np.zeros(0, np.int64)
    several = len(text) > PART + (PART >> 1)
    for i, j in chunks(np.append(base, len(text)), PART) if several else [(0, len(base))]:
        lo, hi = int(base[i]), int(base[j - 1] + length[j - 1])
        some = np.flatnonzero((run >= i) & (run < j)) if several else np.arange(len(run))
        places, head = window_classes(text[lo:hi], begin[some] - lo)
        at = where[places + lo]
        first = np.flatnonzero(head)
        low = np.minimum.reduceat(value[at], first)
        of = np.cumsum(head) - 1
        mine = value[at] == low[of]
        repeated[at[~mine]] = True
        if not several:
            break
        owner = np.zeros(len(first), np.int64)
        owner[of[mine]] = at[mine]
        # merge: this part's classes, sorted already, are looked up in those of the parts before
        text_of = np.lib.stride_tricks.sliding_window_view(text[lo:hi], WINDOW)[places[first]]
        new = np.ascontiguousarray(text_of).view(f"S{WINDOW}").ravel()
        spot = np.searchsorted(names, new)
        same = np.zeros(len(new), bool)
        inside = spot < len(names)
        same[inside] = names[spot[inside]] == new[inside]
        earlier = same.copy()
        earlier[same] = least[spot[same]] < low[same]
        repeated[owner[earlier]] = True
        later = same & ~earlier
        repeated[holder[spot[later]]] = True
        least[spot[later]], holder[spot[later]] = low[later], owner[later]
        names, least, holder = np.insert(names, spot[~same], new[~same]), np.insert(least, spot[~same], low[~same]), np.insert(holder, spot[~same], owner[~same])
    return repeated


# --- the distributed steps ---------------------------------------------------


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of a batch (key, text): (rows, marks of their whole texts, place of each piece in its text, data, offsets); a very long text comes in pieces that overlap by WINDOW - 1."""
    data, off = utf8(batch.column(1))
    for i, j in chunks(off, CHUNK_BYTES):
        marks = _marks(data, off[i : j + 1])
        if off[j] - off[i] <= 2 * CHUNK_BYTES:
            yield batch.slice(i, j - i), marks, np.zeros(j - i, np.int64), data[off[i] : off[j]], off[i : j + 1] - off[i]
            continue
        for a in range(int(off[i]), int(off[j]), CHUNK_BYTES):
            b = min(a + CHUNK_BYTES + WINDOW - 1, int(off[j]))
            yield batch.slice(i, 1), marks, np.array([a - off[i]]), data[a:b], np.array([0, b - a])


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(FIRST).to_numpy(zero_copy_only=False)


def _marks(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """25 bits of each text, which tell rows of one key apart."""
    return np.array([int.from_bytes(hashlib.blake2b(data[a:b].tobytes(), digest_size=4).digest(), "little") & 0x1FFFFFF for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.uint32)


def _packed(key: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row per value of ``key``, the columns packed as bytes."""
    by = np.argsort(key, kind="stable")
    k = key[by]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(k)))
    arrays = [pa.array(k[first].astype(np.int32))] + [binary_array(c[by], n * c.dtype.itemsize) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=["k", *(f"c{i}" for i in range(len(columns)))])


def _unpack(t: pa.Table, kinds: tuple, first: int = 1) -> list[np.ndarray]:
    return [np.concatenate([utf8(c)[0].view(kind) for c in t.column(first + i).chunks] or [np.zeros(0, kind)]) for i, kind in enumerate(kinds)]


RUN = (np.uint64, np.uint64, np.int64, np.int32, np.uint32)  # anchor, fingerprint, key, place, mark << 7 | windows - 1
PLACE = (np.int64, np.int32, np.uint32)


def _shape(n: int) -> str:
    return "k int, " + ", ".join(f"c{i} binary" for i in range(n))


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Marks rows, sorted by ``keys``, that differ from the row before."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _taken(flat: np.ndarray, start: np.ndarray, size: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Slices of ``flat`` one after the other, about ``step`` bytes at a time: places are eight times as wide as bytes."""
    stop = np.cumsum(size)
    out = np.empty(int(stop[-1]) if len(stop) else 0, flat.dtype)
    i = 0
    while i < len(size):
        base = int(stop[i] - size[i])
        j = max(i + 1, int(np.searchsorted(stop, base + step, "right")))
        n = size[i:j]
        out[base : int(stop[j - 1])] = flat[np.repeat(start[i:j] - (stop[i:j] - n - base), n) + np.arange(int(n.sum()))]
        i = j
    return out


class _Seen:
    """First places of runs that a task has met, by fingerprint: a run with an earlier equal in the task is a repeat there already, so a passage of every text sends a few rows a task to its anchor instead of one a piece. Of fixed size: a forgotten run goes to its anchor again."""

    SLOTS = 1 << 17

    def __init__(self):
        n = self.SLOTS
        self.anchor, self.print_of = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.key, self.x, self.at = np.zeros(n, np.int64), np.zeros(n, np.uint32), np.zeros(n, np.int32)

    def earlier(self, anchor, print_of, key, x, at) -> np.ndarray:
        """Which runs have an equal one before them (key, mark, place); the others are kept in mind."""
        slot = (print_of % np.uint64(self.SLOTS)).astype(np.int64)
        hit = (self.print_of[slot] == print_of) & (self.anchor[slot] == anchor)
        k, m, p = self.key[slot], self.x[slot], self.at[slot]
        out = hit & ((k < key) | (k == key) & ((m < x) | (m == x) & (p < at)))
        new = np.flatnonzero(~out)
        slot = slot[new]
        self.anchor[slot], self.print_of[slot], self.key[slot], self.x[slot], self.at[slot] = anchor[new], print_of[new], key[new], x[new], at[new]
        return out


def repeats(docs: DataFrame, total: int) -> tuple[DataFrame, int]:
    """Rows (k: shard of documents, c0 keys, c1 places, c2 marks and windows) of all repeated windows, and the number of shards. ``docs``: (key, text)."""
    shards = _prime(max(3, total // TEXT_SHARD))
    anchors = max(2, total // ANCHOR_SHARD)
    opens = max(2, total // OPEN_SHARD)

    def find(batches):
        seen = _Seen()
        for batch in batches:
            for rows, marks, place, data, off in _rows(batch):
                row, lo, count, anchor = runs(data, off)
                if not len(row):
                    continue
                keys = _ids(rows.column(0))
                print_of = Fingerprints(data).of(lo, lo + count + WINDOW - 1)
                key, at = keys[row], (lo - off[row] + place[row]).astype(np.int32)
                x = marks[row] << np.uint32(7) | (count - 1).astype(np.uint32)
                # equal runs of this piece: the first by (key, mark, place) goes to its anchor, the others are repeats already;
                # equal prints are of one length, so x orders them by mark alone
                by = np.lexsort((at, x, key, print_of, anchor))
                by = by[_firsts(anchor[by], print_of[by], key[by], x[by], at[by])]  # a row that repeats key and text is no other document
                new = _firsts(anchor[by], print_of[by])
                one, more = by[new], by[~new]
                again = seen.earlier(anchor[one], print_of[one], key[one], x[one], at[one])
                one, more = one[~again], np.concatenate([more, one[again]])
                yield _packed((anchor[one] % np.uint64(anchors)).astype(np.int64), [anchor[one], print_of[one], key[one], at[one], x[one]])
                if len(more):
                    blank = np.zeros(len(more), np.uint64)
                    yield _packed(-1 - key[more] % shards, [blank, blank, key[more], at[more], x[more]])

    def settle(t: pa.Table) -> pa.Table:
        k = t.column(0)[0].as_py()
        anchor, print_of, key, at, x = _unpack(t, RUN)
        if k < 0:  # repeats found within a batch pass through
            out = [_settled(np.full(len(key), -1 - k), np.zeros(len(key), np.int8), key, at, x, anchor)]
            return pa.Table.from_batches(out, SETTLED)
        by = np.lexsort((at, x, key, print_of, anchor))
        by = by[_firsts(*(v[by] for v in (anchor, print_of, key, x, at)))]
        anchor, print_of, key, at, x = (v[by] for v in (anchor, print_of, key, at, x))
        group, same = _firsts(anchor), _firsts(anchor, print_of)
        of = np.cumsum(group) - 1
        kinds = np.bincount(of, same)[of]  # different runs of the anchor
        state = np.where(~same, 0, np.where(kinds > WIDE, 2, np.where(kinds > 1, 1, -1)))
        keep = state >= 0
        return pa.Table.from_batches([_settled(key[keep] % shards, state[keep].astype(np.int8), key[keep], at[keep], x[keep], anchor[keep])], SETTLED)

    pieces = docs.mapInArrow(tidily(find), _shape(5))
    settled = stored(pieces.groupBy("k").applyInArrow(lambda t: tidied(settle, t), "k int, state tinyint, c0 binary, c1 binary, c2 binary, c3 binary"), "runs")
    known = settled.filter("state = 0").select("k", "c0", "c1", "c2")
    unsure = settled.filter("state > 0")

    def send(_, left: pa.Table, right: pa.Table) -> pa.Table:
        """Bytes of open runs, to the shard of their anchor; of anchors with very many runs the windows' digests, to their own shards."""
        out = []
        if right.num_rows and left.num_rows:
            state = np.repeat(right.column(1).to_numpy(), [len(v) // 8 for v in right.column(2).to_pylist()])
            key, at, x, anchor = _unpack(right, (*PLACE, np.uint64), 2)
            sent = set()
            for name, mark, body in _texts(left):
                if (name, mark) in sent:  # a row that repeats key and text
                    continue
                sent.add((name, mark))
                mine = np.flatnonzero((key == name) & (x >> np.uint32(7) == mark)) if len(key) < 64 else _between(key, x, name, mark)
                if not len(mine):
                    continue
                place, count = at[mine].astype(np.int64), (x[mine] & np.uint32(127)).astype(np.int64) + 1
                wide = state[mine] == 2
                first = place[~wide]
                n = count[~wide]
                target = (mix64(anchor[mine][~wide]) % np.uint64(opens)).astype(np.int64)
                size = n + WINDOW - 1
                if len(first):
                    flat = _taken(body, first, size)
                    out.append((np.full(len(n), name), first.astype(np.int32), (mark << np.uint32(7) | (n - 1).astype(np.uint32)).astype(np.uint32), target, flat, size))
                if wide.any():  # a digest of every window, to the shard of the digest
                    each = np.repeat(place[wide], count[wide]) + np.arange(int(count[wide].sum())) - np.repeat(np.cumsum(count[wide]) - count[wide], count[wide])
                    raw = body.tobytes()
                    prints = np.frombuffer(b"".join(hashlib.blake2b(raw[p : p + WINDOW], digest_size=16).digest() for p in each.tolist()), np.uint8)
                    where = -1 - (prints.view(np.uint64)[::2] % np.uint64(opens)).astype(np.int64)
                    out.append((np.full(len(each), name), each.astype(np.int32), np.full(len(each), mark << np.uint32(7), np.uint32), where, prints, np.full(len(each), 16)))
        schema = pa.schema([("k", pa.int32()), ("c0", pa.binary()), ("c1", pa.binary()), ("c2", pa.binary()), ("c3", pa.binary())])
        if not out:
            return schema.empty_table()
        name, first, x, target, size = (np.concatenate([o[i] for o in out]) for i in (0, 1, 2, 3, 5))
        flat = np.concatenate([o[4] for o in out])
        by = np.argsort(target, kind="stable")
        b = _packed(target, [name, first, x])
        start = np.cumsum(size) - size
        moved = _taken(flat, start[by], size[by])
        sums = np.add.reduceat(size[by], np.flatnonzero(_firsts(target[by])))
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([*b.columns, binary_array(moved, sums)], schema=schema)])

    def resolve(t: pa.Table) -> pa.Table:
        key, at, x, text = _unpack(t, (*PLACE, np.uint8))
        if t.column(0)[0].as_py() < 0:  # windows by their digests
            d = text.view(np.uint64).reshape(-1, 2)
            by = np.lexsort((at, x, key, d[:, 1], d[:, 0]))
            again = by[~_firsts(d[by, 0], d[by, 1])]
            return pa.Table.from_batches([_packed(key[again] % shards, [key[again], at[again], x[again]])])
        windows = (x & np.uint32(127)).astype(np.int64) + 1
        order = np.empty(len(key), np.int64)
        order[np.lexsort((at, x >> np.uint32(7), key))] = np.arange(len(key))
        again = first_places(text, windows + WINDOW - 1, windows, order)
        run = np.repeat(np.arange(len(key)), windows)[again]
        inner = (np.arange(len(again)) - np.repeat(np.cumsum(windows) - windows, windows))[again]
        if not len(run):
            return pa.schema([("k", pa.int32()), ("c0", pa.binary()), ("c1", pa.binary()), ("c2", pa.binary())]).empty_table()
        # neighbouring windows of a run as one
        new = np.concatenate([[True], (run[1:] != run[:-1]) | (inner[1:] != inner[:-1] + 1)])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(run)))
        run, inner = run[first], inner[first]
        place = (at[run] + inner).astype(np.int32)
        return pa.Table.from_batches([_packed(key[run] % shards, [key[run], place, x[run] >> np.uint32(7) << np.uint32(7) | (n - 1).astype(np.uint32)])])

    sharded = _with_shard(_holding(docs, _bitmap(unsure)), shards)
    sent = sharded.groupBy("k").cogroup(unsure.groupBy("k")).applyInArrow(lambda k, left, right: tidied(send, k, left, right), _shape(4))
    resolved = sent.groupBy("k").applyInArrow(lambda t: tidied(resolve, t), _shape(3))
    return stored(known.union(resolved), "repeats"), shards


SETTLED = pa.schema([("k", pa.int32()), ("state", pa.int8()), ("c0", pa.binary()), ("c1", pa.binary()), ("c2", pa.binary()), ("c3", pa.binary())])


def _settled(shard, state, key, at, x, anchor) -> pa.RecordBatch:
    code = shard.astype(np.int64) * 4 + state
    b = _packed(code, [key, at, x, anchor])
    k = b.column(0).to_numpy()
    return pa.RecordBatch.from_arrays([pa.array((k // 4).astype(np.int32)), pa.array((k % 4).astype(np.int8)), *b.columns[1:]], schema=SETTLED)


def _between(key: np.ndarray, x: np.ndarray, name: int, mark: int) -> np.ndarray:
    """Rows of one document, by an index that is made once for a shard."""
    cached = _between.__dict__
    if cached.get("of") is not key:
        order = np.lexsort((x, key))
        cached |= {"of": key, "order": order, "key": key[order], "mark": (x >> np.uint32(7))[order]}
    i, j = np.searchsorted(cached["key"], [name, name], "left")[0], np.searchsorted(cached["key"], name, "right")
    lo = i + np.searchsorted(cached["mark"][i:j], mark, "left")
    hi = i + np.searchsorted(cached["mark"][i:j], mark, "right")
    return cached["order"][lo:hi]


def _texts(t: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
    """(key, mark, bytes) of every row of a table (k, key, text, ..)."""
    for b in t.to_batches():
        data, off = utf8(b.column(2))
        for name, mark, i, j in zip(_ids(b.column(1)).tolist(), _marks(data, off), off[:-1].tolist(), off[1:].tolist(), strict=True):
            yield name, mark, data[i:j]


def _prime(n: int) -> int:
    """The least prime from ``n`` on: shards by key modulo it are even for keys of any step."""
    while any(n % p == 0 for p in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _with_shard(docs: DataFrame, shards: int) -> DataFrame:
    first = docs.columns[0]
    k = F.pmod(F.coalesce(F.col(first).cast("long"), F.lit(FIRST)), F.lit(shards)).cast("int")
    return docs.select(k.alias("k"), *docs.columns)


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids.view(np.uint64).copy()) % np.uint64(BITS)).astype(np.int64)


def _bitmap(found: DataFrame) -> np.ndarray:
    """BITS bits, those of the keys in ``found`` (c0) set: of one size whatever the input, sent in pieces of 4 KB."""

    def bits(batches):
        have = np.zeros(BITS // 8, np.uint8)
        for b in batches:
            at = _bit(np.unique(utf8(b.column(0))[0].view(np.int64)))
            np.bitwise_or.at(have, at >> 3, (1 << (at & 7)).astype(np.uint8))
        page = have.reshape(-1, 4096)
        for k in np.flatnonzero(page.any(1)):
            at = np.flatnonzero(np.unpackbits(page[k], bitorder="little"))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int64))], names=["page", "at"])

    pages = found.select("c0").mapInArrow(bits, "page int, at long").groupBy("page").agg(F.expr("bitmap_construct_agg(at)").alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in pages.toLocalIterator():
        out[r.page * 4096 : (r.page + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _held(bitmap: np.ndarray, yes: bool):
    """Of batches of documents those whose key's bit is set (``yes``) or not; a few of the former hold nothing."""

    def run(batches):
        for b in batches:
            at = _bit(_ids(b.column(0)))
            hit = (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            yield b.filter(pa.array(hit if yes else ~hit))

    return run


def _holding(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    return docs.mapInArrow(_held(bitmap, True), docs.schema)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """Drop every byte covered by a WINDOW-byte string that also starts earlier, in a smaller key or before in the same text.

    Returns the other columns of ``docs`` with key, n_bytes, n_removed, n_spans,
    kept_sha256 and, with ``keep_text``, the kept bytes as text (a character cut
    by a removal is dropped). Clashing names are no matter: other columns travel
    as one struct named ``other``. A null text is empty; texts below WINDOW bytes
    keep all. A null key sorts first. Rows of one key with different texts are
    documents ordered by a hash of the text; rows that repeat key and text are one
    document, shown as often. An empty table gives no rows.
    """
    others = [c for c in docs.columns if c not in (key, text)]
    other = F.struct(*others) if others else F.struct(F.lit(None).cast("string").alias("none"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), other.alias("other"))
    found, shards = repeats(rows.select("key", "text"), text_bytes(rows))
    bitmap = _bitmap(found)
    schema = f"key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, other {rows.schema['other'].dataType.simpleString()}"

    def result(b, columns: list) -> pa.RecordBatch:
        keys, other, sizes, removed, spans, digests, kept = columns
        return pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string()), other], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "other"])

    def plain(batches):
        for whole in batches:
            _, off = utf8(whole.column(1))
            for i, j in chunks(off, 2 * CHUNK_BYTES):
                b = whole.slice(i, j - i)
                texts = b.column(1).to_pylist()
                raw = [t.encode() for t in texts]
                zero = [0] * len(raw)
                yield result(b, [b.column(0), b.column(2), [len(r) for r in raw], zero, zero, [hashlib.sha256(r).hexdigest() for r in raw], texts if keep_text else [None] * len(raw)])

    def cut(_, left: pa.Table, right: pa.Table) -> pa.Table:
        names, places, marks = _unpack(right, PLACE) if right.num_rows else [np.zeros(0, k) for k in PLACE]
        sizes, removed, spans, digests, kept = [], [], [], [], []
        for name, mark, body in _texts(left):
            mine = _between(names, marks, name, mark)
            gone = np.zeros(len(body) + 1, np.int32)
            if len(mine):
                start = places[mine].astype(np.int64)
                np.add.at(gone, start, 1)
                np.add.at(gone, start + (marks[mine] & np.uint32(127)).astype(np.int64) + WINDOW, -1)
            lost = np.cumsum(gone)[:-1] > 0
            rest = body[~lost].tobytes()
            sizes.append(len(body))
            removed.append(int(lost.sum()))
            spans.append(int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum()) if len(lost) else 0)
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode("utf-8", "ignore") if keep_text else None)
        left = left.combine_chunks()
        one = lambda c: left.column(c).combine_chunks() if left.num_rows else pa.array([], left.schema.field(c).type)
        parts = [one("key"), one("other"), sizes, removed, spans, digests, kept]
        parts[:2] = [p.chunk(0) if isinstance(p, pa.ChunkedArray) else p for p in parts[:2]]
        return pa.Table.from_batches([result(left, parts)])

    untouched = _held(bitmap, False)
    clean = rows.mapInArrow(tidily(lambda batches: plain(untouched(batches))), schema)  # one worker a task for both steps
    touched = _with_shard(_holding(rows, bitmap), shards)
    changed = touched.groupBy("k").cogroup(found.groupBy("k")).applyInArrow(lambda k, left, right: tidied(cut, k, left, right), schema)
    return clean.union(changed).withColumnRenamed("key", key)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return remove_repeats(docs.select(key, text), key, text, keep_text=False).select(key, "n_bytes", "n_removed", "n_spans", "kept_sha256")
