"""The queries of this subpackage, by name, and their SQL for the same tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import bpe, chat, decontam, filter_audit, license, linedup, minhash, packing, pii, quality, repair, suffix, warc

RANKS = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.report(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.report(_table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(_table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_decontamination, op3_token_packing, op4_byte_bpe, op5_pii, op6_quality_rules, op7_suffix_dedup, op8_line_dedup, op9_warc, op10_license_scan, op11_chat_format, op12_filter_audit, op13_turn_repair)}

_OP2_SQL = r"""
WITH norm AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') IF x <> ''] AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS name, [x FOR x IN regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') IF x <> ''] AS ws FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT name, least(8, len(ws)) AS size, array_to_string(ws[i:i + least(8, len(ws)) - 1], ' ') AS w FROM (SELECT name, ws, unnest(range(1, greatest(1, len(ws) - 7) + 1)) AS i FROM items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS w FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM norm, sizes WHERE len(ws) >= size)),
hit AS (SELECT doc_id, name, size, i FROM dw JOIN win USING (size, w)),
cov AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS i FROM (SELECT DISTINCT doc_id, i, size FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT name) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(its.n, 0) >= 2 AS contaminated
FROM norm LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
ORACLE_SQL = {"op2_decontamination": _OP2_SQL, "op6_quality_rules": quality.JUDGE_SQL, "op8_line_dedup": linedup.REPORT_SQL, "op9_warc": warc.ROUND_TRIP_SQL, "op11_chat_format": chat.REPORT_SQL, "op12_filter_audit": filter_audit.REPORT_SQL}
