"""Stores, run records and text helpers."""

import json

from codeloom.operators import excerpts, stats
from codeloom.parsing import extract
from codeloom.sources import store


def test_generations(spark, tmp_path):
    base = f"file://{tmp_path}/s"
    empty = {t: spark.createDataFrame([], schema) for t, schema in __import__("codeloom.schema", fromlist=["x"]).TABLES.items()}
    assert store.load(spark, base, "/r") is None
    first = store.save(spark, base, "/r", empty)
    second = store.save(spark, base, "/r", empty)
    assert first != second and store.load(spark, base, "/r")["files"].count() == 0
    assert store.load(spark, base, "/other") is None


def test_run_records(spark, tmp_path):
    good = {"run_id": "1", "block_id": "b", "arm_id": "stock", "tokens": {"input": 3}, "success": True, "excluded": False}
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.run.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "bad.run.json").write_text("{ not json")
    (tmp_path / "other.json").write_text(json.dumps(good))
    rows = store.runs(spark, f"file://{tmp_path}").collect()
    assert [(r.run_id, r.tokens.input) for r in rows] == [("1", 3)]


def test_sql_table_functions(spark):
    from codeloom.operators import diff

    diff.register(spark)
    extract.register(spark)
    assert spark.sql("SELECT status FROM parse_unified_diff('--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n')").first()[0] == "modified"
    assert spark.sql("SELECT name FROM code_symbols_of('def f(): pass', 'python', 'a.py')").first()[0] == "f"


def test_line_ranges(spark):
    want = spark.createDataFrame([("f", 1, 10), ("f", 20, 25), ("g", 1, 2)], "file string, start int, stop int")
    take = spark.createDataFrame([("f", 3, 4), ("f", 4, 6), ("f", 9, 22)], "file string, start int, stop int")
    got = sorted((r.file, r.start, r.stop) for r in excerpts.subtract(want, take).collect())
    assert got == [("f", 1, 2), ("f", 7, 8), ("f", 23, 25), ("g", 1, 2)]


def test_bootstrap_of_nothing_and_of_one_value(spark):
    none = spark.createDataFrame([], "at long, value double")
    assert stats.bootstrap(none, iterations=10).count() == 0
    one = stats.bootstrap(spark.createDataFrame([(0, 2.0), (1, 2.0)], "at long, value double"), iterations=20).first()
    assert (one.low, one.high, one.estimate) == (2.0, 2.0, 2.0)
