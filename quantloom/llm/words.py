"""Words and terms of UTF-8 text, many documents to a numpy pass: their places, 64-bit hashes and exact codes."""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa

from .common import mix64

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORD = np.ones(256, bool)  # [^\x20\x09-\x0D]
WORD[[0x20, *range(0x09, 0x0E)]] = False
TERM = np.ones(256, bool)  # [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]
TERM[:128] = False
TERM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_SAME = np.arange(256, dtype=np.uint8)
_SMALL = _SAME.copy()
_SMALL[65:91] = _SAME[97:123]
LONG = 64  # bytes, beyond which a word is known by a cryptographic digest: the sums below collide for long words made to collide
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(max(n, 1024), _STEP))])
    return _powers


def _digest(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class Words:
    """``start``/``end`` (byte positions) and ``doc`` (row index) of every word; ``hash`` and ``codes`` when asked for.

    A word is a maximal run of bytes of ``member``, by default ``[^\\x20\\x09-\\x0D]+``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, member: np.ndarray = WORD):
        solid = member[data]
        opens, closes = solid.copy(), solid.copy()
        opens[1:] &= ~solid[:-1]
        closes[:-1] &= ~solid[1:]
        full = offsets[:-1][offsets[1:] > offsets[:-1]]
        opens[full] = solid[full]
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        closes[last] = solid[last]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1)
        self._body = (_SMALL if lower else _SAME)[data[solid]]  # the words one after the other

    @property
    def length(self) -> np.ndarray:
        return self.end - self.start

    @cached_property
    def hash(self) -> np.ndarray:
        length = self.length
        if not len(length):
            return np.zeros(0, np.uint64)
        first = np.cumsum(length) - length
        body = _BYTE[self._body]
        at = np.arange(len(body)) - np.repeat(first, length)
        body *= powers(LONG)[np.minimum(at, LONG - 1)]
        out = mix64(np.add.reduceat(body, first) + length.astype(np.uint64))
        long = np.flatnonzero(length > LONG)
        if len(long):
            raw = self._body.tobytes()
            out[long] = [_digest(raw[a:b]) for a, b in zip(first[long].tolist(), (first + length)[long].tolist(), strict=True)]
        return out

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """(number of each word, the distinct words as binary): equal numbers exactly for equal words."""
        off = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(self.length, out=off[1:])
        coded = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(off), pa.py_buffer(self._body)]).dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every window of ``n`` words within a document."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        total = self.hash[at] * _MULT[0]
        for k in range(1, n):
            total += self.hash[at + k] * _MULT[k]
        return at, mix64(total)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of the distinct shingles, by row and hash; a document of fewer than ``n`` words has its whole sequence as one."""
        at, h = self.grams(n)
        doc = self.doc[at]
        short = np.flatnonzero((self.count > 0) & (self.count < n))
        if len(short):
            first = np.searchsorted(self.doc, short)
            extra = np.full(len(short), np.uint64(n))
            for k in range(n - 1):
                has = self.count[short] > k
                extra[has] += self.hash[first[has] + k] * _MULT[k + 32]
            doc, h = np.concatenate([doc, short]), np.concatenate([h, mix64(extra)])
        if not len(h):
            return doc, h
        # rows hold few distinct bits: sort by hash within rows, row by row in one pass
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        return doc[new], h[new]
