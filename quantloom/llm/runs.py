"""Periodic runs of words: all maximal repetitions of a text by its suffix array, longest-previous-factor array and LZ blocks.

A run is a maximal stretch of words with smallest period q that holds at least
REPEATS periods and LEAST words. Texts are sequences of exact word numbers. Only
texts in which some window of ``ceil(2/3 * LEAST)`` words occurs twice can hold a
run (the run and itself, moved on by its period), so only those go on:

1. suffix array (Larsson-Sadakane) and common prefixes (Kasai), of the texts laid
   one after the other, each with letters of its own, and of the same reversed;
2. longest previous factor of every word, from neighbours in suffix order among
   smaller places; it cuts the text into LZ blocks;
3. Main's extensions: at every border between blocks, for every period that a run
   over this border can have, how far the period reaches to both sides. A run with
   three periods either reaches over a border where its period is at most the
   block behind or before it, or lies strictly inside a block;
4. runs inside a block are copies of runs inside its earlier occurrence: runs lie
   in order of their start, blocks are taken from left to right.

Extensions are range minima over common prefixes, all borders and periods of a
group of texts in one numpy pass, level by level of a sparse table.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_chunk, mix64, tidily
from .suffix import kasai, sorted_suffixes
from .words import Words

LEAST, REPEATS = 24, 3
CHUNK = 2 << 20  # text bytes of one numpy pass
GROUP = 1 << 18  # words whose suffix array is built at once; a longer text stands alone
_TURN = np.uint64(0x9E3779B97F4A7C15)


class _Order:
    """Suffix order of letters, and common prefixes of any two places."""

    def __init__(self, letters: np.ndarray, longest: int):
        n = len(letters)
        follow = np.concatenate([letters[1:], [0]]).astype(np.uint64)
        self.sa = sorted_suffixes(letters.astype(np.uint64) << np.uint64(32) | follow, 2)
        self.rank = np.empty(n, np.int32)
        self.rank[self.sa] = np.arange(n, dtype=np.int32)
        self.lcp = kasai(letters, self.sa, longest)  # with the suffix before

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at ``a`` and ``b`` (different places)."""
        x, y = self.rank[a], self.rank[b]
        lo, hi = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(a), np.int32)
        by = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[by], np.arange(int(level.max(initial=0)) + 2))
        table = self.lcp
        for k in range(len(bounds) - 1):
            some = by[bounds[k] : bounds[k + 1]]
            if len(some):
                out[some] = np.minimum(table[lo[some]], table[hi[some] - (1 << k) + 1])
            if bounds[k + 1] == len(by):
                break
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
        return out


def longest_previous(sa: np.ndarray, lcp: np.ndarray) -> tuple[list[int], list[int]]:
    """For every place, the longest factor there that also starts earlier, and such an earlier place: of the places before, the neighbours in suffix order hold it. Places leave the order from the last to the first."""
    n = len(sa)
    order = sa.tolist()
    shared = [*lcp.tolist(), 0]
    shared[0] = 0
    before, after = list(range(-1, n)), list(range(1, n + 2))
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    length, source = [0] * n, [-1] * n
    for i, r in zip(range(n - 1, -1, -1), rank[::-1].tolist(), strict=True):
        nxt, prv = after[r], before[r]
        up, down = shared[r], shared[nxt]
        if up >= down:
            least = down
            if up:
                length[i], source[i] = up, order[prv]
        else:
            least = up
            length[i], source[i] = down, order[nxt]
        shared[nxt] = least
        before[nxt] = prv
        if prv >= 0:
            after[prv] = nxt
    return length, source


def _blocks(length: list[int], begin: int, end: int) -> list[int]:
    """First places of the LZ blocks of one text."""
    out, i = [], begin
    while i < end:
        out.append(i)
        i += length[i] or 1
    return out


def _periods(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, period): the numbers from 1 to count[row]."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + 1


def runs_of(code: np.ndarray, offsets: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[np.ndarray]:
    """For each text (word numbers between offsets) its runs as rows (start, length, period), by start, then period. ``repeats`` is at least 3."""
    texts = len(offsets) - 1
    doc = np.repeat(np.arange(texts), np.diff(offsets))
    # letters are a text's own, so no factor reaches over two; each text ends in a letter that occurs once
    _, own = np.unique(doc.astype(np.int64) << 32 | code, return_inverse=True)
    begin = offsets[:-1] + np.arange(texts)
    end = offsets[1:] + np.arange(texts)
    total = len(code) + texts
    letters = np.zeros(total, np.int64)
    ends = np.zeros(total, bool)
    ends[end] = True
    letters[~ends] = own + 1
    letters[ends] = len(code) + 1 + np.arange(texts)
    longest = int(np.diff(offsets).max(initial=0))
    forward = _Order(letters, longest)
    backward = _Order(letters[::-1], longest)
    length, source = longest_previous(forward.sa, forward.lcp)
    found: list[np.ndarray] = []
    borders, reach, low, high, blocks = [], [], [], [], []
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        mine = _blocks(length, a, b)
        blocks.append(mine)
        borders += [*mine, b]
        sizes = np.diff([*mine, b]) if mine else np.zeros(0, np.int64)
        reach.append(np.stack([np.concatenate([[0], sizes]), np.concatenate([sizes, [0]])]))
        low += [a] * (len(mine) + 1)
        high += [b] * (len(mine) + 1)
    border, first, last = np.array(borders, np.int64), np.array(low, np.int64), np.array(high, np.int64)
    before, behind = np.concatenate(reach, axis=1) if reach else np.zeros((2, 0), np.int64)
    third = (last - first) // repeats
    sides = (
        (np.minimum(np.minimum(behind, third), last - border - 1), 0),  # the period lies behind the border
        (np.minimum(np.minimum(np.maximum(before, behind), third), border - first), -1),  # before it
    )
    for count, shift in sides:
        row, p = _periods(np.maximum(count, 0))
        left = border[row] + shift * p
        right = left + p
        ahead = forward.common(left, right).astype(np.int64)
        # backwards from the places before both; none before the first of a text
        back = np.zeros(len(row), np.int64)
        some = left > first[row]
        back[some] = backward.common(total - left[some], total - right[some])
        back = np.minimum(back, left - first[row])
        size = p + ahead + back
        good = size >= np.maximum(least, repeats * p)
        found.append(np.stack([left - back, size, p, row])[:, good])
    start, size, period, row = np.concatenate(found, axis=1)
    # a stretch is found with multiples of its period as well: the least is its own
    by = np.lexsort((period, size, start))
    start, size, period = start[by], size[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (size[1:] != size[:-1])
    start, size, period = start[new], size[new], period[new]
    at = np.searchsorted(start, begin), np.searchsorted(start, end)
    out = []
    for k in range(texts):
        mine = list(zip(*(x[at[0][k] : at[1][k]].tolist() for x in (start, size, period)), strict=True))
        if mine:
            _copied(mine, blocks[k], length, source, int(end[k]), least)
        got = np.array(mine, np.int64).reshape(-1, 3)
        got[:, 0] -= begin[k]
        out.append(got[np.lexsort((got[:, 2], got[:, 0]))])
    return out


def _copied(runs: list[tuple[int, int, int]], blocks: list[int], length: list[int], source: list[int], end: int, least: int) -> None:
    """Adds to ``runs`` (in order of start) those that lie strictly inside a block, from the block's earlier occurrence."""
    for x in blocks:
        size = length[x]
        if size < least + 2:
            continue
        begin, move = source[x], x - source[x]
        stop = begin + size
        k = bisect_right(runs, (begin, end + 1, 0))
        while k < len(runs) and runs[k][0] < stop:
            s, n, p = runs[k]
            if s + n < stop:
                copy = (s + move, n, p)
                place = bisect_right(runs, copy)
                if not (place and runs[place - 1] == copy):
                    insort(runs, copy)
            k += 1


def may_repeat(code: np.ndarray, doc: np.ndarray, texts: int, width: int) -> np.ndarray:
    """Texts in which some window of ``width`` words occurs twice, by hashes: more may be named, none is missed."""
    out = np.zeros(texts, bool)
    n = len(code) - width + 1
    if n <= 0:
        return out
    h, done, total = mix64(code.astype(np.uint64) + np.uint64(1)), 0, np.zeros(n, np.uint64)
    k = 1
    while k <= width:  # windows of the powers of two in width, one behind the other
        if width & k:
            total = mix64(total * _TURN + h[done : done + n])
            done += k
        k *= 2
        if k <= width:
            h = mix64(h[: -(k // 2)] * _TURN + h[k // 2 :])
    inside = np.flatnonzero(doc[:n] == doc[width - 1 :])
    total = total[inside] ^ mix64(doc[inside].astype(np.uint64))
    by = np.argsort(total)
    twice = total[by][1:] == total[by][:-1]
    out[doc[inside[by[1:]][twice]]] = True
    out[doc[inside[by[:-1]][twice]]] = True
    return out


def injected(ids: list, count: np.ndarray) -> np.ndarray:
    """Source of each word where every tenth key gets a periodic tail: h = crc32 of the decimal key, g = h // 10; if h % 10 = 0, words from a = g % n on repeat the first p = 1 + (n - a) // (3 + g % 8) of them. A null key changes nothing."""
    base = np.cumsum(count) - count
    out = np.arange(int(count.sum()))
    for k, (key, n) in enumerate(zip(ids, count.tolist(), strict=True)):
        if key is None or not n:
            continue
        h = zlib.crc32(str(key).encode())
        if h % 10:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        lo = int(base[k]) + a
        out[lo : lo + n - a] = lo + np.arange(n - a) % p
    return out


COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _best(runs: np.ndarray) -> list[int]:
    """The run with the greatest exact length / period; the first in order of start and period of equal ones."""
    top = runs[0].tolist()
    for r in runs[1:].tolist():
        if r[1] * top[2] > top[1] * r[2]:
            top = r
    return top


def _found(w: Words, code: np.ndarray, docs: int, least: int, repeats: int) -> list[np.ndarray]:
    """Runs of every text of a piece."""
    out = [np.zeros((0, 3), np.int64)] * docs
    wanted = np.flatnonzero(may_repeat(code, w.doc, docs, -(-2 * least // 3)))
    first = np.cumsum(w.count) - w.count
    size = np.cumsum(w.count[wanted])
    i = 0
    while i < len(wanted):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + GROUP, "right")))
        some = wanted[i:j]
        off = np.concatenate([[0], np.cumsum(w.count[some])])
        at = np.repeat(first[some] - off[:-1], w.count[some]) + np.arange(off[-1])
        for k, runs in zip(some.tolist(), runs_of(code[at], off, least, repeats), strict=True):
            out[k] = runs
        i = j
    return out


def _collapsed(w: Words, source: np.ndarray, runs: list[np.ndarray], data: np.ndarray) -> list[bytes]:
    """The kept words of every text, joined by a space: what a run covers after its first period goes."""
    first = np.cumsum(w.count) - w.count
    drop = np.zeros(len(source) + 1, np.int64)
    for k, r in enumerate(runs):
        if len(r):
            np.add.at(drop, first[k] + r[:, 0] + r[:, 2], 1)
            np.add.at(drop, first[k] + r[:, 0] + r[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
    word = source[kept]
    length = w.length[word] + 1
    stop = np.cumsum(length)
    at = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(w.start[word] - (stop - length), length)
    raw = data[np.minimum(at, max(len(data) - 1, 0))]
    raw[stop - 1] = 32
    text = raw.tobytes()
    bound = np.concatenate([[0], stop])[np.searchsorted(w.doc[kept] if len(w.doc) else kept, np.arange(len(w.count) + 1))]
    return [text[a : max(a, b - 1)] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, repeats: int = REPEATS, source: Callable | None = None, outputs: bool = True) -> DataFrame:
    """A row per row of ``docs``: its runs, the text without what they repeat, and digests of both.

    Columns: the key; ``n_runs``; ``start`` (word number), ``length``, ``period``
    and ``exponent_milli`` of the run with the greatest exponent (ties: smallest
    start, then period), null where there is none; ``runs_sha256`` of the lines
    ``start,length,period`` of every run; ``collapsed_sha256`` of the kept words
    joined by a space; with ``outputs`` also ``runs`` and ``collapsed`` themselves.

    Words are ``[^\\x20\\x09-\\x0D]+``. ``source(keys, counts)`` may replace words
    by others of the same text. A null or empty text has no words: no run, the
    digests of the empty string. Rows are judged one by one, so repeated rows and
    null keys give rows of their own; columns beside key and text are not read. A
    very long text stands alone in a pass. No shuffle.
    """
    if repeats < 3 or least < 2:
        raise ValueError("runs hold at least three periods and two words")

    def run(batches):
        def work(rows, data, offsets):
            w = Words(data, offsets)
            docs = rows.num_rows
            taken = source(rows.column(0).to_pylist(), w.count) if source else np.arange(len(w.start))
            code = w.codes()[0][taken]
            found = _found(w, code, docs, least, repeats)
            texts = _collapsed(w, taken, found, data)
            lines = ["".join(f"{s},{n},{p}\n" for s, n, p in r.tolist()) for r in found]
            best = [_best(r) if len(r) else [None] * 3 for r in found]
            longs = [pa.array([b[j] for b in best], pa.int64()) for j in range(3)]
            power = pa.array([None if b[0] is None else 1000 * b[1] // b[2] for b in best], pa.int64())
            digests = [pa.array([_digest(x.encode()) for x in lines]), pa.array([_digest(x) for x in texts])]
            own = [pa.array(lines), pa.array(texts, pa.binary()).view(pa.string())] if outputs else []
            return pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(r) for r in found], pa.int64()), *longs, power, *digests, *own], names=names)

        yield from by_chunk(batches, text, work, CHUNK)

    columns = f"{COLUMNS}, runs string, collapsed string" if outputs else COLUMNS
    names = [key, *(c.split()[0] for c in columns.split(", "))]
    return docs.select(key, text).mapInArrow(tidily(run), f"`{key}` {dict(docs.dtypes)[key]}, {columns}")
