"""Index maintenance: what to keep, what to extract again, and whether two generations differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan(scan: DataFrame, previous: DataFrame, forced: list[str] = ()) -> DataFrame:
    """scan (``path, mtime_ms``) with ``action`` reuse or extract.

    A file is reused if its time is that of the previous generation, it didn't fail then and it isn't forced ('*' forces
    all). Files that are gone drop out, as the scan is the left side.
    """
    old = previous.select("path", F.col("mtime_ms").alias("old_ms"), F.coalesce("diagnostic.status", F.lit("unknown")).alias("status"))
    force = F.lit("*" in forced) | (F.col("path").isin(list(forced)) if forced else F.lit(False))
    same = (F.col("mtime_ms") == F.col("old_ms")) & (F.col("status") != "failed") & ~force
    return scan.join(old, "path", "left").withColumn("action", F.when(same, "reuse").otherwise("extract")).drop("old_ms", "status")


def merge(plan_: DataFrame, previous: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """The next generation of one table: kept rows of reused files and fresh rows of the others."""
    kept = previous.join(plan_.where("action = 'reuse'").select(F.col("path").alias(key)), key, "left_semi")
    return kept.unionByName(fresh)


def fingerprint(table: DataFrame, key: str) -> DataFrame:
    """An order-free hash of a table's rows for each file."""
    return table.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.to_json(F.struct(*table.columns))).cast("decimal(38,0)")).alias("h"))


def difference(new: DataFrame, old: DataFrame, key: str = "path") -> DataFrame:
    """``path, change`` of the files whose rows differ between two generations."""
    a, b = fingerprint(new, key).alias("a"), fingerprint(old, key).alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    change = F.when(F.col("b.h").isNull(), "added").when(F.col("a.h").isNull(), "removed").when((F.col("a.h") != F.col("b.h")) | (F.col("a.n") != F.col("b.n")), "changed")
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), change.alias("change")).where("change is not null")
