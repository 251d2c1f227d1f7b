"""Coalescing of file events, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = "120 milliseconds"


def coalesced(events: DataFrame, gap: str = GAP, late: str = "10 seconds") -> DataFrame:
    """``root, start, stop, n_events, paths``: bursts of events of one root that are less than gap apart.

    events: ``root, ts, path``; works on streams (with a watermark) and on tables.
    """
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy("root", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n_events"), F.array_sort(F.collect_set("path")).alias("paths")).select("root", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n_events", "paths")
