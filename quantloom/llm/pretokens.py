"""Pre-tokens of byte-level BPE in numpy: boundaries of many texts in one pass, and a table from pre-token to ids.

The boundaries are those of the pattern below, found from runs of character
classes instead of by a regular-expression engine.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

from .common import mix64

# Fixed value: the pattern of the published vocabularies that this module knows how to cut.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for name, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(name, text):
            a, b = m.span()
            points = np.arange(a, b)
            out[points + np.where(points >= 0xD800, 0x800, 0)] = kind
    return out


def boundaries(cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First code point of every pre-token. ``starts``: where the (non-empty) texts begin in ``cp``."""
    n = len(cp)
    kind = _classes()[cp]
    fresh = np.zeros(n + 1, bool)  # a text begins
    fresh[starts] = True
    fresh[n] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= fresh[:n]
    solid = kind != SPACE
    begin = change.copy()
    # a run of white space gives its last character up to what follows in the text
    last = np.zeros(n, bool)
    last[:-1] = ~solid[:-1] & solid[1:] & ~fresh[1:n]
    begin |= last
    # and a plain space joins it
    joined = np.flatnonzero(last & (cp == 32)) + 1
    begin[joined] = False
    # contractions: an apostrophe that begins a pre-token, alone in its run
    quote = np.flatnonzero((cp == 39) & begin)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~fresh[quote + 1]]
    if len(quote):
        one = cp[quote + 1]
        second = quote + 2
        there = (second < n) & ~fresh[np.minimum(second, n)]
        two = np.where(there, cp[np.minimum(second, n - 1)], 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 2
        quote, size = quote[size > 0], size[size > 0]
        begin[quote + 1] = False
        after = quote + 1 + size
        inside = after < n
        begin[after[inside]] = True
    return np.flatnonzero(begin)


class PretokenEncoder:
    """Encode whole texts; each distinct pre-token is encoded once and its ids kept, up to MAX pre-tokens."""

    MAX, LONG = 900_000, 200

    def __init__(self, encode_words: Callable[[list[str]], list[list[int]]]):
        self.encode_words = encode_words
        self.clear()

    def clear(self) -> None:
        size = 1 << 21
        self.mask = np.int64(size - 1)
        self.keys, self.slot_of = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self.flat, self.used, self.n = np.zeros(1 << 19, np.int32), 0, 0
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        # the pre-tokens themselves, as code points one after the other: a hit by hash is compared with its entry
        self.points, self.points_used = np.zeros(1 << 19, np.uint32), 0
        self.point_start, self.point_length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    _power = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    @classmethod
    def _powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._power) < n:
            base = 0xD1342543DE82EF95
            size = max(n, 1 << 20)
            cls._power, cls._inverse = (np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, np.uint64(x)))]) for x in (base, pow(base, -1, 1 << 64)))
        return cls._power, cls._inverse

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each pre-token by its hash, -1 where it is new."""
        out = np.full(len(h), -1, np.int64)
        at = (h & np.uint64(self.mask)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            key = self.keys[at]
            hit = key == h[left]
            out[left[hit]] = self.slot_of[at[hit]]
            go = ~hit & (key != 0)
            left, at = left[go], at[go] + 1 & self.mask
        return out

    def _insert(self, h: np.ndarray, number: np.ndarray) -> None:
        at = (h & np.uint64(self.mask)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.keys[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.keys[at[won]], self.slot_of[at[won]] = h[won], number[won]
            rest = np.ones(len(h), bool)
            rest[won] = False
            h, number, at = h[rest], number[rest], at[rest]
            at = np.where(self.keys[at] != 0, at + 1 & self.mask, at)

    def _store(self, words: list[str]) -> np.ndarray:
        """Numbers of new entries for ``words``."""
        ids = self.encode_words(words)
        new = np.arange(self.n, self.n + len(words))
        for flat, used, start, length, values, kind in (("flat", "used", "start", "length", ids, np.int32), ("points", "points_used", "point_start", "point_length", [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words], np.uint32)):
            sizes = np.fromiter(map(len, values), np.int64, len(values))
            at, more = getattr(self, used), int(sizes.sum())
            held = getattr(self, flat)
            if at + more > len(held):
                held = np.concatenate([held[:at], np.zeros(max(more, at), kind)])
                setattr(self, flat, held)
            held[at : at + more] = np.concatenate(values) if kind is np.uint32 else np.fromiter((x for y in values for x in y), kind, more)
            for name, x in ((start, at + np.cumsum(sizes) - sizes), (length, sizes)):
                column = getattr(self, name)
                if self.n + len(words) > len(column):
                    column = np.concatenate([column[: self.n], np.zeros(max(len(words), self.n), column.dtype)])
                    setattr(self, name, column)
                column[new] = x
            setattr(self, used, at + more)
        self.n += len(words)
        return new

    def _other(self, cp: np.ndarray, begin: np.ndarray, stop: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Pre-tokens that are not the entry found for their hash. ``begin``/``stop`` cover ``cp`` without a gap."""
        wrong = self.point_length[which] != stop - begin
        at = np.repeat(self.point_start[which] - begin, stop - begin)
        at += np.arange(len(cp))
        differs = self.points[np.minimum(at, len(self.points) - 1)] != cp
        if differs.any():
            wrong |= np.logical_or.reduceat(differs, begin)
        return np.flatnonzero(wrong)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        if self.n > self.MAX:
            self.clear()
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        ends = np.cumsum(size)
        begin = boundaries(cp, (ends - size)[size > 0])
        stop = np.append(begin[1:], len(cp))
        power, inverse = self._powers(len(cp) + 1)
        sums = np.empty(len(cp) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((cp.astype(np.uint64) + np.uint64(0x9E3779B9)) * power[: len(cp)], out=sums[1:])
        h = mix64((sums[stop] - sums[begin]) * inverse[begin] + (stop - begin).astype(np.uint64))
        h |= np.uint64(1) << np.uint64(63)  # never 0, which marks a free place
        which = self._find(h)
        new = np.flatnonzero(which < 0)
        forget = False
        if len(new):
            names, first = np.unique(h[new], return_index=True)
            first = new[first]
            words = [cp[a:b].tobytes().decode("utf-32-le") for a, b in zip(begin[first].tolist(), stop[first].tolist(), strict=True)]
            forget = bool((stop[first] - begin[first] > self.LONG).any())
            for k in range(0, len(words), 50_000):
                self._insert(names[k : k + 50_000], self._store(words[k : k + 50_000]))
            which[new] = self._find(h[new])
        other = self._other(cp, begin, stop, which)
        if len(other):  # equal hashes of different pre-tokens: they get entries that no hash leads to
            words = [cp[a:b].tobytes().decode("utf-32-le") for a, b in zip(begin[other].tolist(), stop[other].tolist(), strict=True)]
            distinct = {w: k for k, w in enumerate(dict.fromkeys(words))}
            which[other] = self._store(list(distinct))[[distinct[w] for w in words]]
            forget |= any(len(w) > self.LONG for w in words)
        n = self.length[which].astype(np.int64)
        total = np.cumsum(n)
        at = np.arange(int(total[-1]))
        at += np.repeat(self.start[which] - (total - n), n)
        ids = self.flat[at]
        bound = np.searchsorted(begin, np.concatenate([[0], ends]))
        counts = np.diff(np.concatenate([[0], total])[bound])
        if forget:  # very long pre-tokens are not kept
            self.clear()
        return ids, counts
