"""An index that follows a tree: every micro-batch of changed paths becomes a new generation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans.api import CodeIndex


def follow(spark: SparkSession, root: str, base: str, checkpoint: str, *, interval: str = "1 second"):
    """Start a query that refreshes the index of root after changes. Stop it with ``.stop()``.

    A batch only says which paths to force; the scan stays the source of truth, so a lost or repeated batch does no harm.
    """
    from codeloom.sources import tree

    tree.register(spark)
    stream = spark.readStream.format("source_tree_events").option("root", root)
    if place := re.match(r"(?:file:(?://)?)?(/.*)", checkpoint):  # snapshots outlive the query where a path can be opened
        stream = stream.option("stateDir", f"{place[1]}/tree_states")
    events = stream.load()

    def apply(batch: DataFrame, _: int) -> None:
        paths = [r.path for r in batch.select("path").dropDuplicates(["path"]).collect()]  # of one micro-batch
        if paths:
            CodeIndex.refresh(spark, root, base, forced=paths)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
