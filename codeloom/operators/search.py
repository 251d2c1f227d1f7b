"""Ranked symbol search and index status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import schema as S
from codeloom.functions import scalars as X
from codeloom.operators import references as R


def filtered(symbols: DataFrame, *, file: str | None = None, kind: str | None = None, exported_only: bool = False) -> DataFrame:
    if file:
        symbols = symbols.where(F.contains(F.lower("file"), F.lit(file.lower())))
    if kind:
        symbols = symbols.where(F.col("kind") == kind)
    return symbols.where("exported") if exported_only else symbols


def ranked(symbols: DataFrame, calls: DataFrame, query: str = "", *, limit: int = 50, **filters) -> DataFrame:
    """Matching symbols: exported first, then by score, number of calls, name and file. Without a query all match."""
    score = X.match_score(F.col("name"), query) if query else F.lit(1.0)
    hits = filtered(symbols, **filters).withColumn("score", score).where("score > 0")
    hits = hits.join(R.caller_counts(calls), "name", "left").withColumn("n_calls", F.coalesce("n_calls", F.lit(0).cast("long")))
    order = [F.col("exported").desc(), F.col("score").desc(), F.col("n_calls").desc(), "name", "file", "line", "id"]
    return hits.orderBy(*order).limit(limit)


def by_file(hits: DataFrame) -> DataFrame:
    """Hits grouped by file, files by their first hit. hits: ``rank, file, ...``."""
    return hits.groupBy("file").agg(F.min("rank").alias("rank"), F.array_sort(F.collect_list(F.struct("rank", "name", "kind", "line"))).alias("hits")).orderBy("rank")


def rendered(hits: DataFrame) -> DataFrame:
    """One line of text for each hit."""
    text = F.concat(F.col("kind"), F.lit(" "), "name", F.lit("  "), "file", F.lit(":"), F.col("line").cast("string"), F.lit("  score "), F.format_number("score", 2), F.lit("  calls "), F.col("n_calls").cast("string"))
    return hits.select(text.alias("text"))


def status(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: files, symbols, and languages in the order in which they are met."""
    langs = files.groupBy("lang").agg(F.min("seq").alias("first"))
    listed = langs.agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "lang"))), lambda x: x["lang"]).alias("languages"))
    return files.agg(F.count("*").alias("n_files")).crossJoin(symbols.agg(F.count("*").alias("n_symbols"))).crossJoin(listed)  # one row each


def integrity(files: DataFrame, examples: int = 3) -> DataFrame:
    """Files that weren't parsed whole: counts by status, and the first few in index order."""
    bad = files.where(F.col("diagnostic.status").isin("partial", "failed"))
    counts = bad.groupBy(F.col("diagnostic.status").alias("status")).agg(F.count("*").alias("n_files"), F.min(F.struct("seq", "path")).alias("first"))
    few = bad.orderBy("seq").limit(examples).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "path"))), lambda x: x["path"]).alias("examples"))
    return counts.select("status", "n_files").crossJoin(few)  # one row


def diagnostics(files: DataFrame) -> DataFrame:
    """Files by parse status; a file without a diagnostic is unknown, not parsed."""
    return files.groupBy(F.coalesce("diagnostic.status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n_files"))


def density(symbols: DataFrame) -> DataFrame:
    """Weight of what a file declares, less for bloated files and tests."""
    weight = X.kind_weight(F.col("kind")) + F.when(F.col("exported"), S.EXPORT_BONUS).otherwise(0.0)
    by = symbols.groupBy(F.col("file").alias("path")).agg(F.sum(weight).alias("total"), F.count("*").alias("n_symbols"))
    damp = F.when(X.is_test_path(F.col("path")), S.TEST_DAMP).otherwise(1.0)
    return by.select("path", "n_symbols", (F.col("total") / (1 + S.BLOAT * F.col("n_symbols")) * damp).alias("density"))
