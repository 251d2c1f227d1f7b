"""Cutting the lineage of plans, by compressed tables that later plans read in part."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The session's shared ``spark.checkpoint.dir``, or the context's checkpoint folder; a local one only in local sessions."""
    global _own_dir
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where
    set_by_hand = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_by_hand.isDefined():
        return set_by_hand.get()
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own_dir = _own_dir or "file://" + tempfile.mkdtemp(prefix="codeloom-")
    return _own_dir


def kept(df: DataFrame, *instead_of: DataFrame) -> DataFrame:
    """The rows as a compressed table in the shared folder, without order.

    It cuts the lineage, and the plan begins anew with the table's own size: a checkpoint's would stay the product of all
    joins before, which doubles in digits with each round of a loop. Later plans read only the columns that they need, filter
    in the scan, and broadcast a small side below the session's limit and never beyond it. Tables that df was made from and
    that nothing else needs (instead_of) are deleted at once, all others when the driver's JVM ends.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/codeloom-{uuid.uuid4().hex}"
    path, store = _hadoop(spark, where)
    try:
        df.write.option("compression", "zstd").parquet(where)
    except BaseException:
        store.delete(path, True)
        raise
    store.deleteOnExit(path)
    for old in instead_of:
        path, store = _hadoop(spark, old.kept_at)
        store.delete(path, True)
    out = spark.read.schema(df.schema).parquet(where)
    out.kept_at = where
    return out


def small_or_merged(df: DataFrame, most: int = 500_000) -> DataFrame:
    """One side of a join: sent to every task if it has at most so many rows, else sorted and merged.

    Compressed files tell little of the rows in memory, so that what looks small on disk can be too large for the driver.
    """
    return df.hint("broadcast" if df.count() <= most else "merge")


def kept_in_order(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: rows keep their partitions and order. Not for loops, see ``kept``."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def _hadoop(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
