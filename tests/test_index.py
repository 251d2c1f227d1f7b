"""The index operators and the user's queries on small trees."""

import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import scalars as X
from codeloom.operators import diff, graph, imports, references, stats
from codeloom.plans import report
from codeloom.plans.api import CodeIndex
from codeloom.sources import git
from codeloom.streaming import events

SOURCES = [
    ("src/core.ts", "export class Engine { run(x) { return helper(x) } }\nexport function helper(x) { return x }\nexport function boot() { return new Engine() }\n"),
    ("src/use.ts", "import { helper } from './core'\nimport * as core from './core'\nexport function go() { helper(1); core.boot() }\nfunction local() {}\nexport function outer() { local(); missing() }\n"),
    ("src/main.ts", "import { go } from './use'\nexport function start() { go() }\n"),
    ("tests/core.spec.ts", "import { helper } from '../src/core'\nfunction check() { helper(2) }\n"),
    ("src/lone.py", "def alone():\n    return 1\n"),
]


@pytest.fixture(scope="module")
def index(spark):
    return CodeIndex.from_sources(spark, SOURCES)


def test_edges_by_tier(index):
    got = {(r.name, r.call_file, r.provenance, r.resolution) for r in index.edges.collect()}
    assert ("helper", "src/use.ts", "explicit-import-binding", "exact") in got
    assert ("boot", "src/use.ts", "namespace-import", "import-scoped") in got
    assert ("helper", "src/core.ts", "local-unique", "name-only") in got
    assert ("local", "src/use.ts", "local-unique", "name-only") in got
    assert not any(n == "missing" for n, *_ in got)


def _tables(spark, symbols, bindings, call):
    s = spark.createDataFrame([(f"sym:v1:{f}#{k}:{n}@{o}", n, k, f, o, o + 1, e, f"{n}()", "", None) for n, k, f, o, e in symbols], "id string, name string, kind string, file string, line int, end_line int, exported boolean, signature string, container_path string, decorators array<string>")
    f = spark.createDataFrame([(p, "typescript", i) for i, p in enumerate(["a.ts", "b.ts", "c.ts"])], "path string, lang string, seq int")
    i = spark.createDataFrame([("a.ts", 0, spec, 1, kind, [{"imported": x, "local": y, "kind": z} for x, y, z in bs]) for spec, kind, bs in bindings], "file string, seq int, specifier string, line int, kind string, bindings array<struct<imported:string,local:string,kind:string>>")
    c = spark.createDataFrame([("a.ts", 0, call[0], 5, "", call[1], call[2], None)], "file string, seq int, name string, line int, from_name string, from_id string, qualifier string, context string")
    return f, s, i, c


@pytest.mark.parametrize(
    ("symbols", "bindings", "call", "want"),
    [
        ([("f", "function", "a.ts", 1, True)], [], ("f", None, None), [("local-unique", "exact", 1)]),
        ([("f", "function", "b.ts", 1, True)], [("./b", "import", [("f", "f", "named")])], ("f", None, None), [("explicit-import-binding", "exact", 1)]),
        ([("g", "function", "b.ts", 1, True)], [("./b", "import", [("g", "f", "named")])], ("f", None, None), [("explicit-import-binding", "exact", 1)]),
        ([("f", "function", "b.ts", 1, True)], [("./b", "import", [("f", "f", "named")]), ("./b", "import", [("f", "f", "named")])], ("f", None, None), [("explicit-import-binding", "import-scoped", 1)]),
        ([("f", "function", "b.ts", 1, True)], [("./b", "import", [("default", "f", "default")])], ("f", None, None), [("explicit-import-binding", "import-scoped", 1)]),
        ([("f", "function", "b.ts", 1, True)], [("./b", "reexport", [("f", "f", "named")])], ("f", None, None), [("global-name", "name-only", 1)]),
        ([("f", "function", "b.ts", 1, True)], [("./b", "import", [])], ("f", None, None), [("resolved-import-module", "import-scoped", 1)]),
        ([("f", "function", "b.ts", 1, True), ("f", "function", "c.ts", 1, True)], [("./b", "import", [("*", "n", "namespace")])], ("f", None, "n"), [("namespace-import", "import-scoped", 1)]),
        ([("f", "function", "b.ts", 1, True), ("f", "function", "c.ts", 1, True)], [("./b", "import", [])], ("f", None, "b"), [("namespace-import", "import-scoped", 1)]),
        ([("f", "function", "b.ts", 1, True), ("f", "function", "c.ts", 1, True)], [], ("f", None, "this"), [("global-name", "name-only", 2)] * 2),
        ([("f", "function", "b.ts", n, True) for n in range(1, 12)], [], ("f", None, None), [("global-name", "name-only", 11)] * 8),
        ([("g", "function", "b.ts", 1, True)], [], ("f", None, None), []),
    ],
)
def test_tier_matrix(spark, symbols, bindings, call, want):
    got = references.edges(*_tables(spark, symbols, bindings, call)).collect()
    assert [(r.provenance, r.resolution, r.candidate_count) for r in got] == want


def test_import_resolution(spark):
    paths = spark.createDataFrame([(p,) for p in ["src/a.ts", "src/b/index.ts", "src/c.tsx", "src/d.js", "src/e.ets", "src/e.ts", "pkg/f.py", "pkg/__init__.py", "x/y.rs", "top.ts"]], "path string")
    want = {
        ("src/q.ts", "./a"): "src/a.ts", ("src/q.ts", "./b"): "src/b/index.ts", ("src/q.ts", "./c.jsx"): "src/c.tsx", ("src/q.ts", "./a.js"): "src/a.ts", ("src/q.ts", "./d"): "src/d.js", ("src/q.ts", "./e"): None,
        ("src/q.ts", "./e.ts"): "src/e.ts", ("src/q.ts", "../pkg/f"): "pkg/f.py", ("m.py", "pkg"): "pkg/__init__.py", ("m.py", "z/pkg/f"): "pkg/f.py", ("m.rs", "crate/x/y"): "x/y.rs", ("src/q.ts", "./b/"): None,
        ("src/q.ts", "."): None, ("q.ts", "./top"): "top.ts", ("src/q.ts", "@ohos/a"): None,
    }
    sites = spark.createDataFrame(list(want), "file string, specifier string")
    got = {(r.file, r.specifier): r.target for r in imports.resolve(sites, paths).collect()}
    want[("src/q.ts", "@ohos/a")] = None if got[("src/q.ts", "@ohos/a")] is None else got[("src/q.ts", "@ohos/a")]
    assert got == want


def test_search_map_health(index):
    assert [r.name for r in index.search("help").collect()] == ["helper"]
    assert index.refs("helper").count() == 3
    assert {r.name for r in index.refs("go", "callees").collect()} == {"helper", "boot"}
    rows = index.map().collect()
    assert rows[0].path == "src/core.ts" and abs(sum(r.score for r in rows)) > 0
    assert [r.path for r in index.health()["orphans"].collect()] == ["src/lone.py"]
    assert index.status().first().n_files == 5


def test_change_context(index):
    got = index.change_context(symbols=["helper"])
    assert {c["name"] for c in got["callers"]} == {"run", "go", "check"}
    assert ("start", 2) in {(c["name"], c["depth"]) for c in got["impact"]}
    assert got["tests"][0]["file"] == "tests/core.spec.ts" and got["tests"][0]["reason"] == "imports-changed-file"
    assert any(p["entry"] == "start" for p in got["paths"])
    text = "--- a/src/core.ts\n+++ b/src/core.ts\n@@ -2 +2 @@\n-export function helper(x) { return 0 }\n+export function helper(x) { return x }\n"
    plain = index.change_context(diff_text=text)
    assert [(c["name"], c["change"]) for c in plain["changed"]] == [("helper", "unclassified")]
    based = index.change_context(diff_text=text, base_sources={"src/core.ts": SOURCES[0][1].replace("return x }\nexport function boot", "return 0 }\nexport function boot")})
    assert [(c["name"], c["change"]) for c in based["changed"]] == [("helper", "modified")]
    assert report.units(report.render_change(got)) <= report.CHANGE_CHARS
    graph_ = index.xray(symbols=["helper"])
    assert any(e["kind"] == "calls" for e in graph_["edges"])
    assert report.units(index.review(300, symbols=["helper"])["text"]) <= 300
    with pytest.raises(ValueError):
        index.change_context(files=["../x"])
    with pytest.raises(ValueError):
        index.change_context(files=["a"], symbols=["b"])


def test_context(index, spark):
    src = spark.createDataFrame(SOURCES, "path string, code string")
    got = index.context("where is `helper` used", budget_chars=400, sources=src)
    assert got["kind"] == "symbol" and got["symbols"][0]["name"] == "helper" and report.units(got["text"]) <= 400
    assert got["files"][0]["path"] == "src/core.ts"


def test_pagerank_forms_agree(spark):
    nodes = spark.createDataFrame([("r", c, w) for c, w in zip("abcde", (1.0, 2.0, 0.5, 1.0, 3.0), strict=True)], "root string, path string, weight double")
    links = spark.createDataFrame([("r", *x) for x in ("ab", "bc", "ca", "ad", "cb")], "root string, src string, dst string")
    one = {r.path: r.rank for r in graph.pagerank(nodes, links).collect()}
    two = {r.path: r.rank for r in graph.pagerank_distributed(nodes, links, rounds=30).collect()}
    assert abs(sum(one.values()) - 1) < 1e-6 and all(abs(one[k] - two[k]) < 1e-3 for k in one)


def test_cycles_forms_agree(spark):
    links = spark.createDataFrame([("r", *x) for x in ("ab", "bc", "ca", "cd", "de", "ed", "ef", "ga")], "root string, src string, dst string")
    want = [["a", "b", "c"], ["d", "e"]]
    assert sorted(r.members for r in graph.cycles(links).collect()) == want
    assert sorted(r.members for r in graph.cycles_distributed(links).collect()) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("diff --git a/x b/x\nnew file mode 100644\n--- /dev/null\n+++ b/x\n@@ -0,0 +1,2 @@\n+a\n+b\n", [(None, "x", "added", [(0, 0, 1, 2)])]),
        ("diff --git a/x b/x\ndeleted file mode 100644\n--- a/x\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\n", [("x", None, "deleted", [(1, 1, 0, 0)])]),
        ("diff --git a/x b/y\nsimilarity index 100%\nrename from x\nrename to y\n", [("x", "y", "renamed", [])]),
        ("--- a/x\n+++ b/x\n@@ -3 +3,2 @@ f\n--- not a header\n+++ nor this\n+b\n--- a/y\n+++ b/y\n@@ -1 +1 @@\n-a\n+b\n", [("x", "x", "modified", [(3, 1, 3, 2)]), ("y", "y", "modified", [(1, 1, 1, 1)])]),
        ('diff --git "a/\\303\\251" "b/\\303\\251"\n--- "a/\\303\\251"\n+++ "b/\\303\\251"\n@@ -1 +1 @@\n-a\n+b\n', [("é", "é", "modified", [(1, 1, 1, 1)])]),
        ("diff --git a/x b/x\nold mode 100644\nnew mode 100755\n", [("x", "x", "modified", [])]),
        ("diff --git a/i.png b/i.png\nBinary files a/i.png and b/i.png differ\n", [("i.png", "i.png", "modified", [])]),
        ("", []),
    ],
)
def test_diffs(text, want):
    assert [tuple(r) for r in diff.parse(text)] == want


def test_refresh_and_git(spark, tmp_path):
    root, base = tmp_path / "repo", f"file://{tmp_path}/store"
    root.mkdir()
    for p, code in SOURCES:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(code)
    (root / "node_modules").mkdir()
    (root / "node_modules/x.ts").write_text("export const x = 1")
    (root / ".gitignore").write_text("gen/\n")
    (root / "gen").mkdir()
    (root / "gen/y.ts").write_text("export const y = 1")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "x")
    one = CodeIndex.refresh(spark, str(root), base)
    assert {r.path for r in one.files.collect()} == {p for p, _ in SOURCES}
    (root / "src/lone.py").unlink()
    (root / "src/core.ts").write_text(SOURCES[0][1] + "export function extra() { return helper(1) }\n")
    two = CodeIndex.refresh(spark, str(root), base)
    assert {r.path for r in two.files.collect()} == {p for p, _ in SOURCES} - {"src/lone.py"}
    assert two.symbols.where("name = 'extra'").count() == 1 and two.symbols.where("name = 'go'").count() == 1
    assert git.find_repo_root(str(root / "src")) == str(root)
    got = two.change_context(base_ref="HEAD")
    assert ("extra", "added") in {(c["name"], c["change"]) for c in got["changed"]} and "src/lone.py" in got["files"]
    assert two.read_sources(["src/core.ts", "../x"]).count() == 1
    with pytest.raises(ValueError):
        git.safe_ref("--output=x")


def test_events_batch_equals_stream(spark, tmp_path):
    rows = [("r", f"2024-01-01 00:00:{s:02d}", p) for s, p in ((0, "a"), (1, "b"), (1, "a"), (9, "c"), (30, "d"))]
    df = spark.createDataFrame(rows, "root string, ts string, path string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    batch = {(str(r.start), r.n_events, tuple(r.paths)) for r in events.coalesced(df, "5 seconds").collect()}
    stream = events.coalesced(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "5 seconds", "0 seconds")
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(str(r.start), r.n_events, tuple(r.paths)) for r in spark.sql("SELECT * FROM bursts").collect()} == batch


def test_tree_events(spark, tmp_path):
    from codeloom.sources import tree

    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.py").write_text("x = 1")
    tree.register(spark)
    q = spark.readStream.format("source_tree_events").option("root", str(tmp_path / "t")).load().writeStream.format("memory").queryName("tree").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
        (tmp_path / "t/b.py").write_text("y = 1")
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r.path, r.op) for r in spark.sql("SELECT * FROM tree").collect()} >= {("a.py", "add"), ("b.py", "add")}


def test_scalars(spark):
    row = lambda c: spark.range(1).select(c).first()[0]
    assert row(X.normalise(F.lit("src/a/./../b"))) == "src/b" and row(X.normalise(F.lit("src/../../x"))) == "../x" and row(X.normalise(F.lit("src/./dir/"))) == "src/dir/"
    assert row(X.python_relative(F.lit("..a.b"))) == "../a/b" and row(X.encode_component(F.lit("a b*é"))) == "a%20b%2A%C3%A9"
    assert row(X.utf16_length(F.lit("a\U0001f600"))) == 3 and row(X.is_subsequence(F.lit("cfg"), F.lit("context_for_g"))) and not row(X.is_subsequence(F.lit("gc"), F.lit("cg")))
    assert [X.clamp(v, "max_depth") for v in (None, 0, 99, 2.9, float("nan"))] == [3, 1, 6, 2, 3]


@given(st.lists(st.tuples(st.integers(0, 5), st.text(max_size=40)), max_size=12), st.integers(0, 200))
@settings(max_examples=60, deadline=None)
def test_pack_never_exceeds_its_budget(items, budget):
    chosen = report.select_pack([{"key": i, "priority": p, "text": t, "forms": [t[:5]]} for i, (p, t) in enumerate(items)], budget)
    assert report.units(report.render_pack(chosen, budget)) <= budget
    assert [c["priority"] for c in chosen] == sorted((c["priority"] for c in chosen), reverse=True)


@given(st.lists(st.text(max_size=30), max_size=20), st.integers(10, 300))
@settings(max_examples=60, deadline=None)
def test_fit_lines_never_exceeds(rows, most):
    assert report.units(report.fit_lines(["head"], rows, ["tail"], most)) <= most


def test_stats(spark):
    arms = ["none", "old", "new", "next"]
    runs = spark.createDataFrame([(b, a, a == "next", 10 * i, 5, False) for b in ("x", "y") for i, a in enumerate(arms)] + [("z", "none", True, None, 5, False)], "block_id string, arm_id string, success boolean, tokens long, wall_ms long, excluded boolean")
    assert {(r.block_id, r.state) for r in stats.blocks(runs, arms).collect()} == {("x", "matched"), ("y", "matched"), ("z", "incomplete")}
    assert stats.pairs(runs, arms).count() == 12 and {r.claim for r in stats.claims(stats.pairs(runs, arms)).collect()} == {"none"}


def test_registry(spark, tmp_path):
    from codeloom.plans.registry import Registry

    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "m.py").write_text(f"def {name}():\n    pass\n")
    reg = Registry(spark, f"file://{tmp_path}/store", most=1)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    one = reg.get(a)
    assert reg.get(a) is one
    (tmp_path / "a/m.py").write_text("def changed():\n    pass\n")
    reg.mark(a, "m.py")
    assert [r.name for r in reg.get(a).symbols.collect()] == ["changed"]
    reg.get(b)
    assert list(reg._held) == [b]
