"""The queries ``opN_<name>`` over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontam, fingerprint, langid, licenses, mixing, neardup, quality, substring, tokenbin, warc
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.readings(table(spark, sf_dir, "documents"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"))


def op10_tokenbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_fingerprint": op2_fingerprint,
    "op3_warc": op3_warc,
    "op4_decontam": op4_decontam,
    "op5_langid": op5_langid,
    "op6_neardup": op6_neardup,
    "op7_licenses": op7_licenses,
    "op8_quality": op8_quality,
    "op9_substring": op9_substring,
    "op10_tokenbin": op10_tokenbin,
}

OP3 = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS payload, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
), k AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS keeper FROM p
)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM k
"""

OP9 = """
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), x AS (
    SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM w WHERE len(words) >= 13
), g AS (
    SELECT doc_id, p, min(doc_id) OVER (PARTITION BY array_to_string(words[p:p + 12], ' ')) AS low FROM x
), gone AS (
    SELECT doc_id, list(DISTINCT c) AS at FROM (SELECT doc_id, unnest(range(p, p + 13)) AS c FROM g WHERE low < doc_id) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone.at), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda i: gone.at IS NULL OR NOT list_contains(gone.at, i)), lambda i: words[i]), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""

SQL: dict[str, str] = {"op3_warc": OP3, "op9_substring": OP9}
