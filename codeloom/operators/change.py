"""What a change affects beyond calls: importing files and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import schema as S
from codeloom.functions import scalars as X


def dependents(resolved: DataFrame, changed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``file, changed_file, specifier``: who imports a changed file, by the first specifier that does. changed: ``path``, and by."""
    hit = resolved.where("target <> file").join(changed.select(*by, F.col("path").alias("target")), "target")
    return hit.groupBy(*by, "file", F.col("target").alias("changed_file")).agg(F.min_by("specifier", "seq").alias("specifier"))


def affected_tests(files: DataFrame, graph: DataFrame, calls: DataFrame, changed_files: DataFrame, changed_names: DataFrame, impact_files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``file, reason, rank, distance, resolution``: each test file with its strongest reason.

    changed_files ``path``; changed_names ``name``; impact_files ``path, depth`` (least depth); and the columns of by in each of
    them where they hold many changes.
    """
    tests = files.where(X.is_test_path(F.col("path"))).select(F.col("path").alias("file"))
    row = lambda df, reason, distance, label: df.select(*by, "file", F.lit(S.TEST_RANK[reason]).alias("rank"), F.lit(reason).alias("reason"), distance.cast("int").alias("distance"), F.lit(label).alias("resolution"))
    imports = tests.join(graph.withColumnRenamed("src", "file"), "file")
    changed = changed_files.select(*by, F.col("path").alias("dst")).distinct()
    own = row(tests.join(changed.withColumnRenamed("dst", "file"), "file"), "changed-test", F.lit(0), "exact")
    direct = row(imports.join(changed, "dst").select(*by, "file").distinct(), "imports-changed-file", F.lit(1), "import-scoped")
    near = imports.join(impact_files.select(*by, F.col("path").alias("dst"), "depth"), "dst").groupBy(*by, "file").agg(F.min("depth").alias("depth"))
    named = calls.select("file", "name").distinct().join(tests, "file", "left_semi").join(changed_names.select(*by, "name").distinct(), "name").select(*by, "file").distinct()
    stems = changed_files.select(*by, X.path_stem(F.col("path")).alias("stem")).distinct()
    alike = tests.withColumn("stem", X.path_stem(F.col("file"))).join(stems, "stem")
    every = own.unionByName(direct).unionByName(row(near, "imports-impact-file", F.col("depth"), "import-scoped")).unionByName(row(named, "references-symbol-name", F.lit(1), "name-only"))
    every = every.unionByName(row(alike, "path-convention", F.lit(None), "name-only"))
    best = every.groupBy(*by, "file").agg(F.min_by(F.struct("reason", "distance", "resolution"), "rank").alias("b"), F.min("rank").alias("rank"))
    return best.select(*by, "file", "rank", "b.reason", "b.distance", "b.resolution")


def ordered_tests(tests: DataFrame, limit: int = 20) -> DataFrame:
    return tests.orderBy("rank", F.col("distance").asc_nulls_last(), "file").limit(limit)


def narrowed(result: dict, files: set[str]) -> dict:
    """The part of a change's (bounded) result that starts in some files: their declarations and what reaches those."""
    changed = [r for r in result["changed"] if r["file"] in files]
    ids = {r["id"] for r in changed}
    callers = [r for r in result["callers"] if r["via_target"] in ids]
    reached, impact = ids | {r["id"] for r in callers}, []
    for r in sorted(result["impact"], key=lambda r: r["depth"]):
        if r["via_target"] in reached:
            reached.add(r["id"])
            impact.append(r)
    kept = {"dependents": [r for r in result["dependents"] if r["changed_file"] in files], "paths": [r for r in result["paths"] if r["changed_id"] in ids]}
    return {**result, "changed": changed, "callers": callers, "impact": impact, **kept}
