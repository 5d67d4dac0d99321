"""Thin queries of the operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, huffman, language, lexical, near_dup, packing, runs, secret_scan, templates, vptree, warc, weak_quality
from .common import table

VOCABULARY = 50_257


def _tokenizers():
    import public_tokenizers

    return public_tokenizers


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest).drop("payload", "url")


def op2_vantage_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.search(table(spark, sf_dir, "embeddings"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix

    return suffix.digests(table(spark, sf_dir, "documents"))


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op5_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _tokenizers()
    written = huffman.write_token_files(table(spark, sf_dir, "documents"), p.path("byte_bpe_50k.json"), p.PATTERN, VOCABULARY)
    return huffman.read_token_files(written)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _tokenizers()
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.quality(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _tokenizers()
    return packing.pack_by_curve(table(spark, sf_dir, "documents"), p.path("byte_bpe_50k.json"), p.PATTERN).drop("ids", "curve_key")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapse_runs(table(spark, sf_dir, "documents"), source=runs.injected, outputs=False)


def op12_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.main_text(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_warc, op2_vantage_point, op3_suffix_dedup, op4_chosen_path, op5_huffman, op6_secrets, op7_byte_bpe, op8_weak_quality, op9_language, op10_curve_packing, op11_periodic_runs, op12_impact_search, op13_template_text)
    return {f.__name__: f for f in found}


WARC_SQL = """with p as (select page_id, coalesce(html, '') h from pages),
g as (select sha1(h) d, max(page_id) m from p where strlen(h) >= 1000 group by 1 having count(*) > 1),
x as (select page_id, strlen(h)::bigint payload_bytes, sha1(h) payload_digest, m from p left join g on sha1(h) = d)
select page_id, payload_bytes, payload_digest, case when page_id < m then 'revisit' else 'response' end record_type, case when page_id < m then m end refers_to from x"""

VECTOR_SQL = """with v as (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e) score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e))
select query_id, rank::int rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) where rank <= 20"""

NEAR_SQL = r"""with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) end) sh from d),
n as (select doc_id, len(sh)::bigint n_shingles from s),
u as (select doc_id, unnest(sh) h from s),
c as (select h from u group by h having count(*) > 1),
i as (select a.doc_id a, b.doc_id b, count(*) k from (select * from u semi join c using (h)) a join (select * from u semi join c using (h)) b on a.h = b.h and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n_shingles + y.n_shingles - k)),
r as (select doc_id, doc_id c from n union select r.doc_id, e.b from r join e on r.c = e.a),
m as (select doc_id, min(c) component_id from r group by 1)
select doc_id, n_shingles, component_id, doc_id = component_id kept from n join m using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": WARC_SQL, "op2_vantage_point": VECTOR_SQL, "op4_chosen_path": NEAR_SQL, "op6_secrets": secret_scan.oracle(), "op12_impact_search": lexical.ORACLE}
