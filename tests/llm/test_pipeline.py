"""The pipeline against a brute-force version of its stages, and its entries."""

import re
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quantloom.llm import secret_scan

from .test_operators import jaccard_components, passage


def sentence(rng, parts, n=40):
    return " ".join("".join(rng.choice(parts, 3)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    parts = {"en": ["the", "ing", "tion", "and", "er"], "fr": ["eau", "ment", "que", "ée", "oi"]}
    rows = []
    for k in range(60):
        lang = ("en", "fr")[k % 2]
        rows.append((k, sentence(rng, parts[lang]), lang))
    shared = passage(4, 160)
    rows += [(100, rows[0][1] + " extra", "en"), (101, rows[0][1], "en"), (102, rows[3][1] + f" {shared}", "fr"), (103, sentence(rng, parts["en"]) + f" {shared} end", "en")]
    rows += [(104, "12345 !!", "en"), (105, None, "fr"), (106, sentence(rng, parts["en"]) + " password = hunter2222 done", "en"), (107, rows[5][1], "fr"), (107, rows[5][1], "fr")]
    path = tmp_path_factory.mktemp("docs")
    spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def brute(rows):
    rows = [(k, t) for k, t, _ in rows if t and re.search(r"[^\W\d_]", t)]
    comp = jaccard_components(rows, 5, 80)
    rows = sorted({(k, t) for k, t in rows if comp[k][1] == k})
    seen, out = set(), []
    for k, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        t = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        out.append((k, re.sub(secret_scan.ASSIGN, lambda m: "[secret]" if len(m[2]) >= 6 else m[0], t)))
    return dict(out)


def test_pipeline(spark, folder):
    path, rows = folder
    want = brute(rows)
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, path).collect():
        pieces[r.doc_id].append(r)
    assert sorted(pieces) == sorted(want)
    import zlib

    for k, t in want.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        mine = sorted(pieces[k], key=lambda r: r.start)
        assert sum(r.length for r in mine) == len(ids), k
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder[0])
        assert docs.columns == list(corpus_pipeline.COLUMNS), name


def test_entry_lists_the_queries():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in found} and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def test_rows_are_known_by_key_and_text(spark):
    rng = np.random.default_rng(3)
    t, u, v = (sentence(rng, ["ba", "do", "ki", "lu"], 60) for _ in range(3))
    rows = [(1, t), (5, t), (5, u), (7, u + " more"), (7, v), (7, v), (8, ""), (8, None), (None, t), (9, v), (None, t)]
    docs = spark.createDataFrame([(k, x, "en", "s", 1) for k, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, t), (5, u), (7, v), (8, ""), (8, None), (None, t), (None, t)], key=str)


def test_stages_of_an_empty_table_and_of_one_text_under_one_key(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    near = " ".join(f"w{k}" for k in range(90))
    twins = spark.createDataFrame([(4, near, "en", "s", 1), (4, near + " x", "en", "s", 1)], kind)
    assert corpus_pipeline.near_duplicate_stage(spark, twins, "").count() == 1
    nothing = twins.filter("false")
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, nothing, str(tmp_path)).count() == 0
