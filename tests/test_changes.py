"""Hunks and declarations by blocks of lines, many changes in one plan, packs without repeated lines, a task's part of a change."""

import os
import random

from pyspark.sql import functions as F

from codeloom.operators import batch, diff, graph
from codeloom.plans import report
from codeloom.plans.api import CodeIndex
from codeloom.sources import tree


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(1)
    ranges = lambda n, tag: [(rng.choice("ab"), a := rng.choice([1, 15, 16, 17, 255, 256, rng.randrange(1, 9000)]), a + rng.choice([0, 1, 14, 15, 16, 240, 5000]), f"{tag}{k}") for k in range(n)]
    hunks, decls = ranges(60, "h"), ranges(60, "d")
    h = spark.createDataFrame(hunks, "file string, start int, stop int, h string")
    d = spark.createDataFrame(decls, "file string, line int, end_line int, d string")
    got = sorted((r.h, r.d) for r in diff.overlaps(h, d).collect())
    want = sorted((x[3], y[3]) for x in hunks for y in decls if x[0] == y[0] and y[1] <= x[2] and y[2] >= x[1])
    assert got == want
    lost = sorted(r.h for r in diff.outside(h, d).collect())
    assert lost == sorted({x[3] for x in hunks} - {x for x, _ in want})


def test_one_file_of_very_many_declarations(spark):
    n = 100_000
    k = F.col("id").cast("int")
    d = spark.range(n).select(F.lit("f").alias("file"), (10 * k).alias("line"), (10 * k + 5).alias("end_line"), k.alias("d"))
    h = spark.range(2 * n).select(F.lit("f").alias("file"), (5 * k + 2).alias("start"), (5 * k + 3).alias("stop"), k.alias("h"))
    touched = diff.overlaps(h, d)
    assert touched.count() == n and touched.where("h <> 2 * d").isEmpty()
    assert diff.outside(h, d, touched).count() == n


def test_batch_equals_single_changes(spark):
    rng = random.Random(2)
    ids = [f"s{k}" for k in range(30)]
    edges = spark.createDataFrame([(rng.choice(ids), rng.choice(ids), "f", k, rng.choice([1, 2, 3]), k) for k in range(60)], "source_id string, target_id string, call_file string, call_line int, strength int, seq long")
    changes = {c: sorted(rng.sample(ids, 2)) for c in range(6)}
    rows = [(c, i, k) for c, own in changes.items() for k, i in enumerate(own)]
    many = graph.impact(edges, spark.createDataFrame(rows, "diff_id int, id string, ord long"), by=("diff_id",)).collect()
    direct = graph.direct_callers(edges, spark.createDataFrame(rows, "diff_id int, id string, ord long"), ("diff_id",)).collect()
    for c, own in list(changes.items())[:2]:
        one = spark.createDataFrame([(i, k) for k, i in enumerate(own)], "id string, ord long")
        assert sorted(tuple(r)[1:] for r in many if r.diff_id == c) == sorted(map(tuple, graph.impact(edges, one).collect()))
        assert sorted(tuple(r)[1:] for r in direct if r.diff_id == c) == sorted(map(tuple, graph.direct_callers(edges, one).collect()))
    assert {r.depth for r in many} == {1, 2, 3}


def test_contexts_of_many_changes(spark):
    files = [("src/a.ts", "export function core() {}\nexport function other() {}\n"), ("src/b.ts", "import { core } from './a'\nexport function mid() { core() }\n"), ("src/c.ts", "import { mid } from './b'\nexport function top() { mid() }\n"), ("src/a.spec.ts", "import { core } from './a'\ncore()\n")]
    index = CodeIndex.from_sources(spark, files)
    ranges = spark.createDataFrame([(1, "src/a.ts", 1, 1), (2, "src/a.ts", 2, 2), (3, "src/b.ts", 2, 2)], "diff_id int, file string, start int, stop int")
    tables = batch.contexts(index.files, index.symbols, index.resolved, index.module_graph, index.calls, index.edges, ranges, max_impact=1)
    names = lambda n, c: sorted((r.diff_id, r[c]) for r in tables[n].collect())
    assert names("changed", "name") == [(1, "core"), (2, "other"), (3, "mid")]
    assert names("callers", "name") == [(1, "mid"), (3, "top")] and names("impact", "name") == [(1, "top")]
    assert names("tests", "file") == [(1, "src/a.spec.ts"), (2, "src/a.spec.ts")]
    counts = {r.diff_id: (r.n_callers, r.n_impact, r.n_dependents, r.cut) for r in batch.summary(tables, ranges, {"changed": 1, "callers": 1, "impact": 1, "dependents": 1, "tests": 20}).collect()}
    assert counts == {1: (1, 1, 2, "dependents"), 2: (0, 0, 2, "dependents"), 3: (1, 0, 1, "")}
    drawn = sorted((r.diff_id, r.kind, r.source.split(":")[-1]) for r in batch.graph_edges(tables).where("kind = 'calls'").collect())
    assert drawn == [(1, "calls", "mid@1"), (1, "calls", "top@1"), (3, "calls", "top@1")]


def test_pack_shows_no_line_twice():
    form = lambda file, start, n, head="h": {"head": head, "file": file, "start": start, "lines": [f"{file}{start + k}" for k in range(n)]}
    items = [
        {"key": 1, "file": "a", "priority": 9, "forms": [form("a", 1, 5)]},
        {"key": 2, "file": "a", "priority": 8, "forms": [form("a", 4, 4)]},
        {"key": 3, "file": "a", "priority": 7, "forms": [form("a", 2, 3), "short"]},
        {"key": 4, "file": "a", "priority": 6, "forms": [form("a", 6, 1)]},
        {"key": 5, "file": "b", "priority": 5, "forms": [form("b", 1, 1)]},
        {"key": 6, "file": "c", "priority": 4, "text": "gone"},
        {"key": 7, "priority": 3, "text": "free"},
    ]
    got = report.select_pack(items, 1000, max_files=2)
    assert [i["text"] for i in got] == ["h\na1\na2\na3\na4\na5", "h\n@@ 6-7\na6\na7", "short", "h\nb1", "free"]
    shown = [line for i in got for line in i["text"].split("\n") if line[0] in "abc"]
    assert len(shown) == len(set(shown))
    small = report.select_pack([items[0], {"key": 8, "file": "a", "priority": 8, "forms": [form("a", 1, 9)]}], len("h\na1\na2\na3\na4\na5") + len("h\n@@ 6-9\na6\na7\na8\na9") + 2)
    assert len(small) == 2, "an excerpt's cost is told after it's cut"


def test_task_part_comes_before_the_limit(spark):
    foreign = [("a.ts", "export function core() {}\nexport function one() { core() }\n" + "".join(f"export function f{k:02d}() {{ one() }}\n" for k in range(41)))]
    mine = [("z.ts", "export function mine() {}\nexport function near() { mine() }\nexport function far() { near() }\n")]
    index = CodeIndex.from_sources(spark, foreign + mine)
    diff_text = "".join(f"diff --git a/{p} b/{p}\n--- a/{p}\n+++ b/{p}\n@@ -1,1 +1,1 @@\n-x\n+y\n" for p in ("a.ts", "z.ts"))
    whole = index.change_context(diff_text=diff_text, max_impact=40)
    assert len(whole["impact"]) == 40 and "far" not in {r["name"] for r in whole["impact"]}
    own = index.change_context(diff_text=diff_text, max_impact=40, only_files={"z.ts"})
    assert [r["name"] for r in own["impact"]] == ["far"] and [r["name"] for r in own["callers"]] == ["near"]
    assert own["files"] == ["a.ts", "z.ts"] and {r["file"] for r in own["changed"]} == {"z.ts"}


def test_refresh_opens_stale_files_only(spark, tmp_path):
    root, base = tmp_path / "r", f"file://{tmp_path}/i"
    root.mkdir()
    for k in range(5):
        (root / f"f{k}.ts").write_text(f"export function f{k}() {{}}\n")
    CodeIndex.refresh(spark, str(root), base)
    (root / "f3.ts").write_text("export function changed() {}\n")
    os.utime(root / "f3.ts", (1, 1))
    opened, read = [], tree.read_files
    try:
        tree.read_files = lambda paths, root: opened.append(read(paths, root).count()) or read(paths, root)
        index = CodeIndex.refresh(spark, str(root), base)
    finally:
        tree.read_files = read
    assert opened == [1] and {r.name for r in index.symbols.collect()} == {"f0", "f1", "f2", "f4", "changed"}
