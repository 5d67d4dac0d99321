"""Words made so that sums modulo 2**64 collide: a Thue-Morse word and its complement are different texts all the same."""

import hashlib
from collections import defaultdict

import public_tokenizers as P
import pytest

from quantloom.llm import bpe, huffman, near_dup, packing, pretokens, weak_quality

from .test_operators import JSON, crc, ids_of


def morse(letters, n=10):
    word = letters[0]
    swap = str.maketrans(letters, letters[::-1])
    for _ in range(n):
        word += word.translate(swap)
    return word


A, B = morse("ab"), morse("ba")
ROWS = [(1, A), (2, B), (3, f"{A} {B} {A}"), (4, f"{B} {A} {A}"), (5, "plain words")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)


def test_words_collide_without_a_digest():
    assert A != B and len(A) == 1024
    import numpy as np

    base = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1024)], np.uint64)
    one, two = (int((np.frombuffer(x.encode(), np.uint8).astype(np.uint64) * base).sum()) for x in (A, B))
    assert one == two


def test_byte_bpe(docs):
    got = {r.doc_id: r for r in bpe.bpe_digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for k, t in ROWS:
        ids = ids_of(t)
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_token_files(spark, docs):
    for r in huffman.read_token_files(huffman.write_token_files(docs, JSON, P.PATTERN, 50_257)).collect():
        want = [*ids_of(dict(ROWS)[r.doc_id]), 0]
        assert (r.n_tokens, r.ids_crc32) == (len(want), crc(want))


def test_packing(docs):
    found = defaultdict(int)
    for r in packing.pack_by_curve(docs, JSON, P.PATTERN).collect():
        want = [*ids_of(dict(ROWS)[r.doc_id]), 1]
        assert (r.doc_tokens, r.ids_crc32) == (len(want), crc(want[r.start : r.start + r.length]))
        found[r.doc_id] += r.length
    assert found == {k: len(ids_of(t)) + 1 for k, t in ROWS}


def test_near_duplicates(spark):
    rows = [(1, f"{A} one two three"), (2, f"{B} one two three"), (3, A), (4, B)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(k, k, True) for k, _ in rows]


def test_repeated_words(spark):
    text = f"{A} q r {B} q r x"
    got = weak_quality.quality(spark.createDataFrame([(1, text), (2, f"{A} q r {A} q r x")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {1: 0, 2: 6}


def test_equal_hashes_of_short_pretokens(monkeypatch):
    monkeypatch.setattr(pretokens, "mix64", lambda x: x & x.dtype.type(7))
    words = [f" w{k}" for k in range(200)] + [" w5", "x", ""]
    seen = {}
    encoder = pretokens.PretokenEncoder(lambda ws: [[seen.setdefault(w, len(seen)), 7] for w in ws])
    for _ in range(2):
        ids, counts = encoder(words)
        assert counts.tolist() == [4] * 201 + [2, 0]
        pairs = [ids[a : a + 2].tolist() for a in range(0, len(ids), 2)]
        assert pairs == [[seen[p], 7] for w in words if w for p in ([" w", w[2:]] if w != "x" else ["x"])]
