"""Per-file kernels: symbols, ids, imports, calls, parse states."""

import pytest

from codeloom.parsing.extract import extract_text, language_for
from codeloom.sources import ignore


def names(r, kind=None):
    return [s["name"] for s in r["symbols"] if kind is None or s["kind"] == kind]


def test_python():
    r = extract_text("import os.path as p\nfrom ..a.b import c as d\nclass K:\n    def m(self):\n        return self.n(p.join())\n\ndef top():\n    K()\n", "python", "x/y.py")
    assert [(s["kind"], s["name"], s["exported"]) for s in r["symbols"]] == [("class", "K", True), ("method", "m", False), ("function", "top", True)]
    assert [i["specifier"] for i in r["imports"]] == ["os/path", "../a/b"]
    assert r["imports"][1]["bindings"] == [{"imported": "c", "local": "d", "kind": "named"}]
    assert {(c["name"], c["from_name"], c["qualifier"]) for c in r["calls"]} == {("n", "m", "self"), ("join", "m", "p"), ("K", "top", None)}
    assert extract_text("def f(:\n  x\n\ndef g():\n    pass\n", "python", "a.py")["diagnostic"]["status"] == "partial"


def test_typescript():
    code = """import d, { a as b } from './m'
import * as ns from "../n"
export { q } from './q'
export default class Shape { private x = 1; draw(c: C): void { ns.go(c); b() } }
export interface I { run(): void }
export type Al = string
export const f = (a) => { const local = 1; g(a) }
// function ghost() {}
let v = "function ghost() {"
"""
    r = extract_text(code, "typescript", "s.ts")
    assert set(names(r)) == {"Shape", "x", "draw", "I", "run", "Al", "f", "v"}
    assert {s["name"] for s in r["symbols"] if s["exported"]} == {"Shape", "I", "Al", "f"}
    assert [(i["specifier"], i["kind"]) for i in r["imports"]] == [("./m", "import"), ("../n", "import"), ("./q", "reexport")]
    assert {(c["name"], c["qualifier"]) for c in r["calls"]} == {("go", "ns"), ("b", None), ("g", None)}


def test_go_rust_java_cpp():
    go = extract_text('package m\nimport al "x/y"\ntype S struct{}\nfunc (s *S) Run() { al.Do() }\nfunc help() {}\n', "go", "m.go")
    assert [(s["name"], s["kind"], s["exported"]) for s in go["symbols"]] == [("S", "class", True), ("Run", "method", True), ("help", "function", False)]
    assert go["symbols"][1]["id"].endswith("#class:S@1/method:Run@1") and go["imports"][0]["bindings"][0]["local"] == "al"
    rust = extract_text("use crate::a::{b, c as d};\npub struct P {}\npub(crate) enum E { A }\nimpl P { pub fn new() -> P { helper() } }\nfn helper() {}\n", "rust", "l.rs")
    assert {s["name"] for s in rust["symbols"] if s["exported"]} == {"P", "new"} and rust["imports"][0]["specifier"] == "crate/a"
    java = extract_text("package p; import a.b.C; public class J { public int go(int a) { return new K().run(a); } private void z() {} }", "java", "J.java")
    assert [(s["name"], s["exported"]) for s in java["symbols"]] == [("J", True), ("go", True), ("z", False)]
    cpp = extract_text('#include "a/b.h"\nclass C { int p; public: void run(int a) { go(a); } };\nstatic int hid() { return 1; }\nint C::other() { return hid(); }\n', "cpp", "c.cpp")
    assert {(s["name"], s["kind"], s["exported"]) for s in cpp["symbols"]} == {("C", "class", True), ("p", "field", False), ("run", "method", True), ("hid", "function", False), ("other", "method", True)}
    assert cpp["imports"][0]["specifier"] == "a/b.h"


def test_arkts():
    r = extract_text("@Entry\n@Component\nstruct Page {\n  build() {\n    Column() {\n      Text('a')\n        .size(3)\n    }\n  }\n}\n", "arkts", "p.ets")
    assert r["symbols"][0]["signature"] == "struct Page" and r["symbols"][0]["line"] == 1 and r["symbols"][0]["decorators"] == ["@Entry", "@Component"]
    assert [(c["name"], c["context"]) for c in r["calls"]] == [("Column", "arkui"), ("Text", "arkui")]


def test_ids_survive_blank_lines_and_count_twins():
    one = extract_text("def f():\n    pass\n\ndef f():\n    pass\n", "python", "a b.py")
    two = extract_text("\n\n# note\ndef f():\n    pass\n\n\n\ndef f():\n    pass\n", "python", "a b.py")
    assert [s["id"] for s in one["symbols"]] == [s["id"] for s in two["symbols"]] == ["sym:v1:a%20b.py#function:f@1", "sym:v1:a%20b.py#function:f@2"]


def test_odd_files():
    assert extract_text(None, "go", "a.go")["diagnostic"]["status"] == "failed"
    assert extract_text("x", None, "a.txt")["diagnostic"]["status"] == "failed"
    assert extract_text("", "typescript", "a.ts")["diagnostic"]["status"] == "parsed"
    assert extract_text("function f() {", "javascript", "a.js")["diagnostic"]["status"] == "partial"
    assert language_for("a/B.TSX") == "typescript" and language_for("x.h") == "cpp" and language_for("README") is None


@pytest.mark.parametrize(
    ("rules", "path", "want"),
    [
        ({"": "*.log\n!keep.log"}, "a/keep.log", False), ({"": "*.log\n!keep.log"}, "a/b.log", True), ({"": "build/"}, "build/x.ts", True), ({"": "build/"}, "src/build", False),
        ({"": "/top.ts"}, "a/top.ts", False), ({"": "/top.ts"}, "top.ts", True), ({"": "a/**/z.ts"}, "a/b/c/z.ts", True), ({"": "dir\n!dir/keep.ts"}, "dir/keep.ts", True),
        ({"": "*.ts", "pkg": "!*.ts"}, "pkg/a.ts", False), ({"": "*.ts", "pkg": "!*.ts"}, "a.ts", True), ({"": "# c\n\n"}, "a.ts", False), ({"": "[ab].ts"}, "x/b.ts", True),
    ],
)
def test_ignore_rules(rules, path, want):
    assert ignore.ignored(rules, path) is want


def test_statements_that_patterns_get_wrong():
    go = extract_text("package m\nvar (\n  a = 1\n)\ntype (\n  Q struct{}\n  Z = int\n)\nfunc F() { g() }\n", "go", "a.go")
    assert [(s["name"], s["kind"]) for s in go["symbols"]] == [("Q", "class"), ("Z", "type"), ("F", "function")] and [c["name"] for c in go["calls"]] == ["g"]
    cpp = extract_text("template<class K, class W> class Map {};\nstruct B { operator bool(); bool operator==(const B& o); int operator()(int a); };\nint (*fp(int))(double) { return pick(); }\nvoid f() { S<int>::k(); }\n", "cpp", "a.cpp")
    assert names(cpp) == ["Map", "B", "fp", "f"] and {(c["name"], c["qualifier"]) for c in cpp["calls"]} == {("pick", None), ("k", "S<int>")}
    js = extract_text("const a = 1, b = 2\nlet q = (x, y) => x\nvar e, g\nconst h = [1, 2]\n", "javascript", "a.js")
    assert names(js) == ["a", "b", "q", "e", "g", "h"]
    ts = extract_text("export let c: Map<string, number> = new Box(), d = f(1, 2)\n", "typescript", "a.ts")
    assert names(ts) == ["c", "d"] and all(s["exported"] for s in ts["symbols"])
    ets = "@Component\nstruct P {\n  build() {\n    Column() {\n      Text('a')\n        .onClick(() => {\n          Foo()\n        })\n      ForEach(this.l, (i) => {\n        Row()\n      })\n    }\n  }\n  plain() {\n    Bar()\n  }\n}\n@Builder\nfunction made() {\n  Baz()\n}\n"
    assert {c["name"]: c["context"] for c in extract_text(ets, "arkts", "p.ets")["calls"]} == {"Column": "arkui", "Text": "arkui", "Foo": None, "ForEach": "arkui", "Row": "arkui", "Bar": None, "Baz": "arkui"}
    assert extract_text("class J { void go() { new K().run(); } }", "java", "J.java")["calls"][1]["qualifier"] == "new K()"
