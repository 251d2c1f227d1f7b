"""From raw documents to token ids: five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of docs; ``n_chars`` follows ``text`` where a stage changes it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, decontam, linedup, minhash, quality
from codeloom.llm.queries import RANKS


def _columns(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """changed has docs' columns and a new text: set n_chars to its length where docs has that column."""
    if "n_chars" not in docs.columns:
        return changed
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; so does a document of which they leave no word."""
    done = linedup.dedup(docs)
    left = done.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    text = F.when(F.col("n_removed") > 0, F.col("text")).otherwise(F.col("row.text"))
    return _columns(left.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8 or more)."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with two benchmark items or more go; a single item's words are cut out of the text."""
    return _columns(decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of every document; decoding gives the text's bytes again."""
    encoded = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Byte-level BPE can't be written in SQL; the pipeline is tested against a plain version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
