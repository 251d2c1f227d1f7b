"""The contexts of many changes in one plan: every step is keyed by the change, and limits are windows within it.

``codeloom.plans.api`` answers for one change and collects bounded rows; this is the form for a history of changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.checkpoints import kept
from codeloom.functions import scalars as X
from codeloom.operators import change, diff, graph

KEY = ("diff_id",)


def changed_symbols(ranges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``diff_id, id, name, kind, file, line, ord``: the declarations that each change's line ranges touch, in order.

    ranges: ``diff_id, file, start, stop``.
    """
    hit = diff.overlaps(ranges.select("diff_id", "file", "start", "stop"), symbols.select("id", "name", "kind", "file", "line", "end_line"))
    order = F.row_number().over(Window.partitionBy("diff_id").orderBy("file", "line", "id")).cast("long")
    return hit.select("diff_id", "id", "name", "kind", "file", "line").distinct().withColumn("ord", order)


def first(rows: DataFrame, most: int, *order) -> DataFrame:
    """The first rows of each change; ``rank`` from 1, and ``total``, the number that there were."""
    own = Window.partitionBy(*KEY)
    ranked = rows.withColumn("rank", F.row_number().over(own.orderBy(*order))).withColumn("total", F.count("*").over(own))
    return ranked.where(F.col("rank") <= most)


def dependents(resolved: DataFrame, ranges: DataFrame, most: int = 40) -> DataFrame:
    """The files that import each change's files; needs no calls. resolved, ranges: as in ``contexts``."""
    paths = ranges.select("diff_id", F.col("file").alias("path")).distinct()
    return first(change.dependents(resolved, paths, KEY), most, "file", "changed_file", "specifier")


def contexts(files: DataFrame, symbols: DataFrame, resolved: DataFrame, modules: DataFrame, calls: DataFrame, edges: DataFrame, ranges: DataFrame, *, max_depth: int = 3, max_impact: int = 40, max_tests: int = 20) -> dict[str, DataFrame]:
    """Tables by name, each with ``diff_id``, ``rank`` and ``total``: changed, callers, impact, dependents, tests.

    resolved: imports with their targets; modules: the module graph; ranges: as in ``changed_symbols``.
    """
    changed = kept(changed_symbols(ranges, symbols))
    info = symbols.select("id", "name", "kind", "file", "line")
    reach = graph.impact(edges, changed.select("diff_id", "id", "ord"), max_depth, KEY)
    direct = graph.direct_callers(edges, changed.select("diff_id", "id", "ord"), KEY)
    label = X.label_of(F.col("strength")).alias("resolution")
    named = lambda df: df.join(info, "id").select("diff_id", "id", "name", "kind", "file", "line", "depth", "strength", label, "via_target", "via_file", "via_line")
    far = kept(named(reach.where("depth >= 2")))
    paths = ranges.select("diff_id", F.col("file").alias("path")).distinct()
    near = far.groupBy("diff_id", F.col("file").alias("path")).agg(F.min("depth").alias("depth"))
    tests = change.affected_tests(files, modules, calls, paths, changed.select("diff_id", "name"), near, KEY)
    return {
        "changed": first(changed, max_impact, "file", "line", "id"),
        "callers": first(named(direct), max_impact, "file", "line", "id"),
        "impact": first(far, max_impact, "depth", F.desc("strength"), "file", "line", "id"),
        "dependents": dependents(resolved, ranges, max_impact),
        "tests": first(tests.withColumnRenamed("rank", "strength_rank"), max_tests, "strength_rank", F.col("distance").asc_nulls_last(), "file"),
    }


def graph_edges(tables: dict[str, DataFrame], *, call_nodes: int = 20, imports: int = 10) -> DataFrame:
    """``diff_id, source, target, kind, label``: each change's bounded graph of calls and imports, for display.

    A caller's edge stays if what it calls is changed or listed before it.
    """
    listed = tables["callers"].select("diff_id", "id", "via_target", "resolution", F.col("rank").alias("at")).unionByName(tables["impact"].select("diff_id", "id", "via_target", "resolution", (F.col("rank") + 1_000_000).alias("at")))
    listed = first(listed, call_nodes, "at").drop("total")
    nodes = tables["changed"].select("diff_id", F.col("id").alias("via_target"), F.lit(0).alias("from_rank")).unionByName(listed.select("diff_id", F.col("id").alias("via_target"), F.col("rank").alias("from_rank")))
    nodes = nodes.groupBy("diff_id", "via_target").agg(F.min("from_rank").alias("from_rank"))
    calls = listed.join(nodes, ["diff_id", "via_target"]).where(F.col("from_rank") < F.col("rank")).select("diff_id", F.col("id").alias("source"), F.col("via_target").alias("target"), F.lit("calls").alias("kind"), F.col("resolution").alias("label"))
    through = tables["dependents"].where(F.col("rank") <= imports).select("diff_id", F.concat(F.lit("file:"), "file").alias("source"), F.concat(F.lit("file:"), "changed_file").alias("target"), F.lit("imports").alias("kind"), F.lit("import-scoped").alias("label"))
    return calls.unionByName(through)


def summary(tables: dict[str, DataFrame], ranges: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``diff_id``, the totals of each table, and ``cut``: the names of the tables that were cut, sorted."""
    out = ranges.select("diff_id").distinct()
    for name, rows in tables.items():
        out = out.join(rows.groupBy("diff_id").agg(F.max("total").alias(f"n_{name}")), "diff_id", "left")
    out = out.na.fill(0)
    cut = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"n_{n}") > limits[n], F.lit(n)) for n in sorted(tables)])), ",")
    return out.withColumn("cut", cut)
