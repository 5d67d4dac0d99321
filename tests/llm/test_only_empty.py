"""Tables whose texts are all null or empty: a batch without a byte."""

import hashlib

import public_tokenizers as P
import pytest

from quantloom.llm import bpe, huffman, language, lexical, near_dup, packing, runs, secret_scan, suffix, templates, warc, weak_quality

JSON = P.path("byte_bpe_50k.json")
NONE = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, ""), (None, None)], "doc_id long, text string").coalesce(1)


def test_texts(docs):
    assert {(r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix.remove_repeats(docs).collect()} == {(0, 0, NONE)}
    assert all(r.kept and r.n_shingles == 0 for r in near_dup.near_duplicates(docs).collect())
    assert near_dup.first_of_each(docs).count() == 4
    assert sorted(r.n_tokens for r in huffman.read_token_files(huffman.write_token_files(docs, JSON, P.PATTERN, 50_257)).collect()) == [1] * 4
    assert {(r.n_tokens, r.decoded_sha256) for r in bpe.bpe_digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()} == {(0, NONE)}
    assert [r.length for r in packing.pack_by_curve(docs, JSON, P.PATTERN).collect()] == [1] * 4
    assert {r.spans for r in secret_scan.digests(docs).collect()} == {""}
    assert {(r.n_words, r.kept) for r in weak_quality.quality(docs).collect()} == {(0, False)}
    assert {(r.n_runs, r.start, r.collapsed) for r in runs.collapse_runs(docs, source=runs.injected).collect()} == {(0, None, "")}
    assert lexical.ranked_documents(docs, docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_language(docs):
    seen = language.identify(docs.selectExpr("*", "'en' lang")).collect()
    assert {r.lang_pred for r in seen} == {"und"} and len(seen) == 4


def test_pages(docs):
    pages = docs.selectExpr("doc_id page_id", "cast(null as string) url", "text html")
    assert {(r.text, r.n_chars) for r in templates.main_text(pages).collect()} == {("", 0)}
    assert warc.read_archives(warc.write_archives(pages)).count() == 4
