"""Queries take whole tables, not a part of their ids."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import scalars as X
from codeloom.plans import queries
from codeloom.plans.adapters import Adapter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def a(spark):
    return Adapter(spark, SF)


def test_calls_come_from_every_line_item(a):
    n = a.table("supplier").count()
    k = F.col("l_orderkey")
    site = a.table("lineitem").join(a.table("part"), F.col("l_partkey") == F.col("p_partkey")).select(
        "l_suppkey", "p_name", "l_linenumber", F.when(k % 9 != 0, k % 15 * n), F.when(F.col("l_linenumber") == 3, F.col("l_partkey") % 7)
    )
    assert a.calls.count() == site.distinct().count()


def test_term_overlap_ranks_all_parts(spark, tmp_path):
    items = [(1, "polished copper tubes"), (2, "copper"), (3, "nothing alike"), (4, "polished copper plated steel tubes")]
    kinds = ["SMALL BRASS", "LARGE PLATED STEEL", "COPPER TUBES", "POLISHED COPPER TUBES"]
    parts = [(k, kinds[0] if k < 60 else kinds[k % 4]) for k in range(80)] + [(80, "copper")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    terms = lambda table, key, text: {r[0]: set(r[1]) for r in spark.read.parquet(f"{tmp_path}/{table}.parquet").select(key, X.context_terms(F.col(text))).collect()}
    t, u = terms("benchmark", "item_id", "text"), terms("part", "p_partkey", "p_type")
    want = sorted((i, p, len(t[i] & u[p])) for i in t for p in sorted(u, key=lambda p: (-len(t[i] & u[p]), p))[:3])
    got = sorted((r.item_id, r.p_partkey, r.n) for r in queries.QUERIES["term_overlap_topk"](spark, str(tmp_path)).collect())
    assert got == want and max(n for _, _, n in got) > 2


def test_every_part_gives_a_task(spark, a):
    got = queries.QUERIES["exact_symbol_names"](spark, SF)
    assert got.select("task_id").distinct().count() == a.table("part").count()


def test_neighbours_of_every_symbol_with_edges(spark, a):
    e = queries._edges(a).where("source_id is not null")
    ends = e.select("source_id").union(e.select("target_id")).distinct()
    got = queries.QUERIES["neighbourhood"](spark, SF).select("id").distinct()
    assert ends.exceptAll(got).count() == 0


def test_changed_symbols_are_those_of_the_edited_ranges(spark, a):
    pids = {r.pid for r in queries.QUERIES["hunk_symbol_overlap"](spark, SF).collect()}
    changed = {r.ord for r in queries._changed(a).collect()}
    assert changed == pids and any(p % 97 for p in pids)


def test_entry_paths_of_all_edited_symbols_to_depth_three(spark, a):
    e, s = queries._edges(a), queries._symbols(a)
    back = {}
    for r in e.where("source_id is not null").select("source_id", "target_id").distinct().collect():
        back.setdefault(r.target_id, set()).add(r.source_id)
    entries = {r.id for r in queries.graph.entry_symbols(s, queries.references.incoming_counts(e)).collect()}
    want = set()
    for r in queries._changed(a).collect():
        seen, front = {r.id}, {r.id}
        for depth in (1, 2, 3):
            front = {x for t in front for x in back.get(t, ())} - seen
            seen |= front
            want |= {(r.id, x, depth) for x in front & entries}
    got = queries.QUERIES["entry_paths"](spark, SF).select("changed_id", "entry_id", "depth").collect()
    assert {tuple(x) for x in got} == want
