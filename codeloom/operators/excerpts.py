"""Line ranges of source excerpts: windows, subtraction, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_CHARS, MOST_LINES = 1600, 80
BEFORE, AFTER, HEADER = 3, 5, 3


def lines(text: Column, start: Column, stop: Column) -> Column:
    """Lines start..stop (1-based, inclusive) of a text."""
    return F.array_join(F.slice(F.split(text, "\n", -1), start, F.greatest(F.lit(0), stop - start + 1)), "\n")


def variants(declarations: DataFrame) -> DataFrame:
    """``id, rank, form, start, stop, excerpt``: the forms of an excerpt that fit, best first.

    declarations: ``id, text, line, end_line, focus, signature``. Whole declaration, window around the focus line,
    header, signature; each within the limits on characters and lines.
    """
    at, end = F.col("line"), F.col("end_line")
    focus = F.coalesce("focus", "line")
    low, high = F.greatest(at, focus - BEFORE), F.least(end, focus + AFTER)
    forms = F.array(
        F.struct(F.lit(0).alias("rank"), F.lit("complete").alias("form"), at.alias("start"), end.alias("stop")),
        F.struct(F.lit(1).alias("rank"), F.lit("window").alias("form"), low.alias("start"), high.alias("stop")),
        F.struct(F.lit(2).alias("rank"), F.lit("header").alias("form"), at.alias("start"), F.least(end, at + HEADER - 1).alias("stop")),
        F.struct(F.lit(3).alias("rank"), F.lit("signature").alias("form"), at.alias("start"), at.alias("stop")),
    )
    rows = declarations.select("id", "text", "signature", F.explode(forms).alias("f")).select("id", "text", "signature", "f.*")
    body = F.when(F.col("form") == "signature", F.col("signature")).otherwise(lines(F.col("text"), F.col("start"), F.col("stop")))
    return rows.withColumn("excerpt", body).where((F.length("excerpt") <= MOST_CHARS) & (F.col("stop") - F.col("start") + 1 < MOST_LINES)).select("id", "rank", "form", "start", "stop", "excerpt")


def best_variant(declarations: DataFrame) -> DataFrame:
    return variants(declarations).groupBy("id").agg(F.min_by(F.struct("form", "start", "stop", "excerpt"), "rank").alias("b")).select("id", "b.*")


def subtract(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """``file, start, stop``: what is left of the wanted line ranges without the taken ones, as maximal ranges.

    Without a row for each line: the taken ranges of a file are merged, and the gaps between them cut each wanted range.
    """
    w = Window.partitionBy("file").orderBy("start", "stop")
    t = taken.select("file", "start", "stop").where("stop >= start").withColumn("top", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("new", (F.col("top").isNull() | (F.col("start") > F.col("top") + 1)).cast("int")).withColumn("grp", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = t.groupBy("file", "grp").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    far = F.lit(2_147_483_647)
    after = merged.withColumn("next", F.lead("start").over(Window.partitionBy("file").orderBy("start")))
    gaps = after.select("file", (F.col("stop") + 1).alias("g0"), (F.coalesce("next", far) - 1).alias("g1")).unionByName(merged.groupBy("file").agg(F.lit(0).alias("g0"), (F.min("start") - 1).alias("g1")))
    keys = merged.select("file").distinct()
    cutd = wanted.join(gaps, "file").select("file", F.greatest("start", "g0").alias("start"), F.least("stop", "g1").alias("stop")).where("start <= stop")
    return cutd.unionByName(wanted.select("file", "start", "stop").join(keys, "file", "left_anti")).distinct()


def uncovered(ranges: DataFrame) -> DataFrame:
    """``file, gap_start, gap_stop``: line gaps between the ranges of a file, by a running maximum of their ends."""
    w = Window.partitionBy("file").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("top", F.max("stop").over(w)).where("start > top + 1").select("file", (F.col("top") + 1).alias("gap_start"), (F.col("start") - 1).alias("gap_stop"))
