"""Ranked search against a plain scorer."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from quantloom.llm import lexical

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERMS.findall((text or "").translate(SMALL))


def scored(docs, queries, k):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    count, total = len(held), sum(sum(c.values()) for _, c in held)
    out = []
    for item, text in queries:
        rows = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * count // total
            s = 0
            for t in terms(text):
                if c[t]:
                    df = sum(t in x for _, x in held)
                    s += math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0:
                rows.append((-s, d is None, d or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


DOCS = [(k, f"alpha{k % 3} Beta gamma gamma {'delta ' * (k % 5)} x{k}") for k in range(40)] + [(100, None), (101, ""), (102, "-- !!"), (103, "ÄÖ ä ÉCOLE école KK"), (5, "beta beta beta"), (5, "beta beta beta"), (None, "gamma alpha1 beta"), (104, "delta " * 30_000 + "end"), (-3, "beta beta beta"), (105, "q" * 5000)]
QUERIES = [(1, "BETA gamma"), (2, None), (3, "nothing here"), (4, "école alpha1 alpha1 delta x7"), (4, "beta"), (5, ""), (6, "q" * 5000 + " end-of"), (None, "ä")]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in DOCS], "doc_id long, text string, score long, terms string").repartition(3)
    return docs, spark.createDataFrame([(q, t, 2) for q, t in QUERIES], "item_id long, text string, rank int")


@pytest.mark.parametrize("k", [1, 3, 20, 100])
def test_search_equals_a_plain_scorer(tables, monkeypatch, k):
    docs, queries = tables
    want = scored(DOCS, QUERIES, k)
    assert sorted(map(tuple, lexical.ranked_documents(docs, queries, k).collect()), key=str) == want
    monkeypatch.setattr(lexical, "SHARD_BYTES", 200)
    monkeypatch.setattr(lexical, "QUERY_BYTES", 2000)
    assert sorted(map(tuple, lexical.ranked_documents(docs, queries, k).collect()), key=str) == want


def test_nothing_to_find(tables):
    docs, queries = tables
    assert lexical.ranked_documents(docs.filter("false"), queries).count() == 0
    assert lexical.ranked_documents(docs, queries.filter("false")).count() == 0


def test_a_partition_keeps_every_tie():
    score = np.array([5, 7, 5, 5, 0, 5, 9])
    order = np.array([6, 5, 4, 3, 2, 1, 0])
    assert lexical.top(score, order, 3).tolist() == [6, 1, 5]
    assert lexical.top(score, order, 10).tolist() == [6, 1, 5, 3, 2, 0]
    assert lexical.top(np.zeros(30, np.int64), np.arange(30), 5).tolist() == []


def test_equal_impacts_from_every_shard_size(tables, monkeypatch):
    docs, _ = tables
    index = lexical.build_index(docs)
    assert (index.documents, index.terms) == (len([1 for _, t in DOCS if terms(t)]), sum(len(terms(t)) for _, t in DOCS))
    rows = index.shards.collect()
    assert sum(len(np.frombuffer(r.impact, np.int32)) for r in rows) == sum(len(set(terms(t))) for _, t in DOCS)
