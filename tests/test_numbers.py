"""Queries over edges carry numbers in place of ids, and make edges once."""

import os
import random

import duckdb
import pytest

from codeloom.operators import graph, references
from codeloom.plans import queries
from codeloom.plans.adapters import Adapter

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["entry_paths", "impact_files", "impact_labels"])
def test_steps_write_no_text_and_edges_are_made_once(spark, monkeypatch, name):
    written, made = [], []
    monkeypatch.setattr(graph, "kept", lambda df, *old, real=graph.kept: written.append(df.dtypes) or real(df, *old))
    monkeypatch.setattr(references, "settled", lambda *x, real=references.settled: made.append(1) or real(*x))
    got = queries.QUERIES[name](spark, SF)
    assert len(written) > 3 and not [t for t in written if any(kind != "bigint" and kind != "int" for _, kind in t)]
    assert len(made) == 1 and not got.isEmpty()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "world_top" not in plan  # read back, not made once more


@pytest.mark.parametrize("name", ["entry_paths", "impact_files", "impact_labels", "neighbourhood"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_reach_is_impact_without_calls(spark):
    rng = random.Random(5)
    calls = [(rng.choice([None, *range(40)]), rng.randrange(40), "f", i, rng.choice((1, 1, 2, 3)), i) for i in range(160)]
    edges = spark.createDataFrame(calls, "source_id long, target_id long, call_file string, call_line int, strength int, seq long")
    changed = spark.createDataFrame([(c, i, i) for c in range(6) for i in (c, c + 20)], "c int, id long, ord long")
    links = edges.where("source_id is not null").groupBy("source_id", "target_id").agg({"strength": "max"}).withColumnRenamed("max(strength)", "strength")
    for few in (graph._FEW_ENDS, 0):
        graph._FEW_ENDS, before = few, graph._FEW_ENDS
        got = graph.reach(links, changed, 3, ("c",))
        graph._FEW_ENDS = before
        want = graph.impact(edges, changed, 3, ("c",))
        assert rows(got.select("c", "id", "depth", "strength")) == rows(want.select("c", "id", "depth", "strength"))
        assert got.where("depth = 3").count() > 10


def test_what_was_seen_is_told_after_paths_are_grouped(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(graph, "kept", lambda df, *old, real=graph.kept: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, *old))
    links = spark.createDataFrame([(1, 0, 2), (2, 0, 1), (3, 1, 3), (3, 2, 1), (0, 3, 3)], "source_id long, target_id long, strength int")
    got = graph.reach(links, spark.createDataFrame([(0,)], "id long")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 2), (2, 1, 1), (3, 2, 2)]
    assert not any("LeftAnti" in p for p in plans)  # moved below the grouping, it would deal out every path


def test_neighbours_come_from_calls_dealt_out_by_owner(spark):
    a = Adapter(spark, SF)
    _, calls, ids = queries._by_number(a)
    got = references.settled_neighbours(calls, a.files)
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "target_id" in text and "called-by" in text
    name = {r.no: r.id for r in ids.collect()}
    assert [name[n] for n in sorted(name)] == sorted(name.values())  # numbers keep the order of the ids
    want = references.neighbours(queries._edges(a))
    assert sorted((name[r.id], r.direction, name[r.other], r.label, r.line) for r in got.collect()) == sorted(map(tuple, want.collect()))
