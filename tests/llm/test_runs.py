"""Periodic runs against a scan of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quantloom.llm import runs


def scanned(code, least, repeats):
    """Every stretch that keeps a period, each under its smallest one."""
    out = {}
    for p in range(1, len(code) // repeats + 1):
        i = 0
        while i + p < len(code):
            j = i
            while j + p < len(code) and code[j] == code[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, repeats * p):
                out.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


def words_of(key, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(key).encode()), len(w)
    if key is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(key, text):
    w = words_of(key, text)
    found = scanned(w, 24, 3)
    drop = {i for s, n, p in found for i in range(s + p, s + n)}
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    power = 1000 * best[1] // best[2] if found else None
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, " ".join(x for i, x in enumerate(w) if i not in drop))]
    return (key, len(found), *best, power, *digest)


def test_runs_of_random_words():
    draw = random.Random(5)
    for _ in range(300):
        texts = []
        for _ in range(draw.randint(1, 4)):
            n, letters, t = draw.randint(0, 90), draw.choice([1, 2, 2, 3, 5]), []
            while len(t) < n:
                if t and draw.random() < 0.5:
                    a = draw.randrange(len(t))
                    t += t[a : draw.randint(a, len(t))] * draw.randint(1, 5)
                else:
                    t += [draw.randrange(letters) for _ in range(draw.randint(1, 6))]
            texts.append(t[:160])
        least = draw.choice([2, 3, 6, 24])
        off = np.cumsum([0, *map(len, texts)])
        for t, got in zip(texts, runs.runs_of(np.array([x for t in texts for x in t], np.int64), off, least), strict=True):
            assert [tuple(r) for r in got.tolist()] == scanned(t, least, 3)


def test_prefilter_names_every_text_with_a_run():
    off = np.array([0, 30, 60])
    code = np.concatenate([np.arange(30), np.tile([1, 2], 15)])
    assert runs.may_repeat(code, np.repeat([0, 1], 30), 2, 16).tolist() == [False, True]
    assert [len(r) for r in runs.runs_of(code, off)] == [0, 1]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    nested = (["a", "b"] * 13 + ["c"]) * 4
    texts = [None, "", " \t\n", "x", "x " * 23, "x " * 24, "a b c " * 8, "a b " * 40 + "c d e " * 9 + "a b " * 40, " ".join(nested), "   ".join("pq" * 30), " ".join(draw.choice("ab") for _ in range(900)), " ".join(f"w{k % 7} v" for k in range(3000)), " ".join(f"u{k}" for k in range(400))]
    long = "q" * 70
    texts += [f"{long}1 {long}2 " * 12, " ".join(["z"] * 5000)]
    return [(k, t) for k, t in enumerate(texts)] + [(7, texts[7]), (7, texts[8]), (None, "a b " * 20)] + [(k, "one two three four five " * 30) for k in range(100, 180)]


def test_rows_equal_a_scan(spark, rows, monkeypatch):
    docs = spark.createDataFrame([(k, t, 1, "s") for k, t in rows], "doc_id long, text string, start long, runs string")
    want = sorted((expected(k, t) for k, t in rows), key=str)
    assert sorted(map(tuple, runs.collapse_runs(docs, source=runs.injected, outputs=False).collect()), key=str) == want
    monkeypatch.setattr(runs, "GROUP", 50)
    monkeypatch.setattr(runs, "CHUNK", 500)
    full = runs.collapse_runs(docs, source=runs.injected).collect()
    assert sorted((tuple(r)[:8] for r in full), key=str) == want
    assert all(hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 and hashlib.sha256(r.runs.encode()).hexdigest() == r.runs_sha256 for r in full)
    assert any(zlib.crc32(str(k).encode()) % 10 == 0 and t for k, t in rows)
    assert runs.collapse_runs(docs.filter("false")).count() == 0
    with pytest.raises(ValueError):
        runs.collapse_runs(docs, repeats=2)
