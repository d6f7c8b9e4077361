"""The queries ``opN_<name>`` over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import decontamination, language_id, near_dedup, neighbours, packing, quality, substring_dedup, toxicity, url_filters, warc
from ravelin.llm.lake import table

#: (action, host, path) of the rules that op6 is asked to apply.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language_id.fit(documents.where(~held_out()), tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    return language_id.predict(documents, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.flag(documents, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.capture_log(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("record_id", "kind", "canonical_url", "status", "base_id", "resolved_id", "payload_ref", "payload_digest", headers.alias("headers"))


OP5_SQL = """
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest,
         TIMESTAMP '2024-01-01' + to_minutes(((page_id % 100000 + 100000) % 100000)) AS moment FROM pages
), log AS (
  SELECT page_id * 2 AS record_id, 'response' AS kind, url, moment, digest AS etag, strftime(moment, '%Y-%m-%d %H:%M:%S') AS lm,
         page_id AS ref, digest, NULL AS dt FROM p
  UNION ALL
  SELECT page_id * 2 + 1, 'revisit',
         regexp_replace(url, '#.*$', '') || CASE WHEN page_id % 11 = 0 THEN '/gone' ELSE '' END || '#again',
         moment + INTERVAL 90 MINUTE,
         CASE WHEN page_id % 5 = 0 THEN 'new-' || digest WHEN page_id % 7 <> 0 THEN digest END,
         CASE WHEN page_id % 7 <> 0 AND page_id % 5 <> 0 THEN strftime(moment, '%Y-%m-%d %H:%M:%S') END,
         NULL, NULL, strftime(moment, '%Y-%m-%d %H:%M:%S') FROM p WHERE page_id % 3 = 0
), u AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS bare FROM log
), parts AS (
  SELECT *, regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www\\.|:(80|443)$', '', 'g') AS host,
         regexp_replace(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))), '&') AS q FROM u
), c AS (SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS surt FROM parts
), ranked AS (
  SELECT v.record_id, b.record_id AS base_id, b.etag AS b_etag, b.lm AS b_lm, b.ref AS b_ref, b.digest AS b_digest,
         row_number() OVER (PARTITION BY v.record_id ORDER BY b.moment DESC, b.record_id DESC) AS k
  FROM c v JOIN c b ON v.kind = 'revisit' AND b.kind = 'response' AND v.surt = b.surt
   AND (b.moment < v.moment OR (b.moment = v.moment AND b.record_id < v.record_id))
), j AS (
  SELECT c.*, r.base_id, r.b_ref, r.b_digest,
    CASE WHEN kind = 'response' THEN 'full' WHEN r.base_id IS NULL THEN 'orphan'
         WHEN coalesce(etag <> b_etag, false) OR coalesce(lm <> b_lm, false) THEN 'mismatch'
         WHEN (etag = b_etag) IS NULL AND (lm = b_lm) IS NULL THEN 'unvalidated' ELSE 'resolved' END AS status
  FROM c LEFT JOIN ranked r ON r.record_id = c.record_id AND r.k = 1
)
SELECT record_id, kind, surt AS canonical_url, status, base_id,
  CASE WHEN kind = 'response' THEN record_id WHEN status = 'resolved' THEN base_id END AS resolved_id,
  CASE WHEN kind = 'response' THEN ref WHEN status = 'resolved' THEN b_ref END AS payload_ref,
  CASE WHEN kind = 'response' THEN digest WHEN status = 'resolved' THEN b_digest END AS payload_digest,
  CASE WHEN kind = 'response' THEN 'cache-control=max-age=60;content-type=text/html;etag=' || digest
       WHEN status = 'resolved' THEN 'cache-control=max-age=600;content-type=text/html;date=' || dt || ';etag=' || b_digest
       ELSE 'cache-control=max-age=600;content-type=text/plain;date=' || dt END AS headers
FROM j
"""


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rules_frame(spark, RULES))


OP6_SQL = """
WITH r(action, h, p) AS (VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'), ('block','example.net','/de/8'), ('block','org','/es/')),
u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS k FROM pages
), m AS (
  SELECT u.k, r.action, r.h || r.p AS rule,
         row_number() OVER (PARTITION BY u.k ORDER BY length(r.h || r.p) DESC, length(r.h) DESC, r.action DESC) AS best
  FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.action, 'allow') AS verdict FROM u LEFT JOIN m ON m.k = u.k AND m.best = 1
"""


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.similar_classes(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.judged(table(spark, sf_dir, "documents"), trusted)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_url_filters": op6_url_filters,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_quality": op10_quality,
}
SQL: dict[str, str] = {"op5_warc_revisits": OP5_SQL, "op6_url_filters": OP6_SQL}
