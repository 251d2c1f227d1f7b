"""The recovering parser of scripts, declarators of C, owners in ids, and durable snapshots of a tree. Nothing here needs Spark."""

import os

import pytest

from codeloom.parsing import wellformed
from codeloom.parsing.extract import extract_text
from codeloom.sources.tree import TreeStream

WHOLE = [
    "const f = async <T,>(x: T): Promise<T> => { for await (const y of g(x)) yield_(y); return x }",
    "export default { data() { return { a: 1 } }, get x() { return 1 }, async *['k']() {}, ...rest }",
    "type A<T> = T extends (infer U)[] ? U : { [K in keyof T]?: T[K] } | `a${string}`;\ninterface I<T> extends J<T> { (x: number): void; readonly [k: string]: T }",
    "class A<T> extends B<T> implements C, D { #p = 1; static { init() } declare x: number; constructor(private readonly y?: string) { super() } get v(): T { return this.#p as T } abstract m(): void }",
    "label: for (let i = 0, n = 3; i < n; i++) { if (i in o) continue label; else break }\ndo { x-- } while (x > 0)\nswitch (x) { case 1: { a() } default: b() }",
    "const r = a / b / c, s = /[/]\\/(?:x)/g, t = x ? y : z ? (q) : (w) => w\nlet u = a < b, v = f<number>(1), w = <any>x, z = x! as unknown as string",
    "import d, { type A, b as c } from './x'\nimport type { T } from './t'\nexport * as n from 'm'\nexport { d as default, c }\nimport j from './j.json' with { type: 'json' }",
    "@dec({ a: 1 }) export class K { @Input() a = 1; @Out b!: E<string>; @H('x') on(@P() p: string) {} }\ndeclare module 'm' { export const x: number }\ndeclare global { interface Window { a: 1 } }\nexport enum E { A = 1 << 2, B }",
    "x = y\n++z\nreturn_\n(a ?? b)?.c?.[d]?.(e)\nnew Foo\nnew (bar())()\nthrow new Error(`a ${`b ${c}`} d`)",
    "function over(a: string): void\nfunction over(a: any, ...rest: number[]): asserts a is string { void 0 }\nvar { a, b: [c = 1, , d], ...e } = f()",
]


@pytest.mark.parametrize("code", WHOLE)
def test_whole_texts_have_no_issues(code):
    assert wellformed.check(code, "typescript")[0] == []


@pytest.mark.parametrize(
    ("code", "issues"),
    [
        ("const broken = (", [("missing", 1)]), ("let x = ;\nlet y = 2", [("error", 1)]), ("foo(1,,2)\nbar()", [("error", 1)]), ("}\n}", [("error", 1), ("error", 2)]),
        ("class A {\n  m( {\n}\nclass B {}", None), ("if (a { b() }\nlet c = ]\nd()", [("error", 1), ("error", 2)]), ("try { a() }\nb()", [("error", 2)]), ("const s = 'abc\nlet t = 1", None), ("/* never closed", [("missing", 1)]),
    ],
)
def test_broken_texts(code, issues):
    got = wellformed.check(code, "typescript")[0]
    assert got == issues if issues is not None else got


def test_parser_goes_on_behind_an_error():
    r = extract_text("let a = ;\nfunction f() { g() }\nconst b = (\n", "javascript", "a.js")
    assert [(s["name"], s["kind"]) for s in r["symbols"]] == [("a", "variable"), ("f", "function"), ("b", "variable")]
    assert r["diagnostic"]["status"] == "partial" and (r["diagnostic"]["error_count"], r["diagnostic"]["missing_count"]) == (1, 1)
    assert [i["line"] for i in r["diagnostic"]["issues"]] == [1, 3]
    assert wellformed.check("<a>text</a>", "javascript") is None and wellformed.check("(" * 50_000, "javascript") in (None, ([("missing", 1)], []))


def test_long_text_is_read_in_linear_time():
    code = "export class A { m() { return this.x({ k() { z() } }).y([1, 2]) } }\n" * 3000
    issues, found = wellformed.check(code, "typescript")
    assert issues == [] and len(found) == 6000


@pytest.mark.parametrize(
    ("code", "names"),
    [
        ("class A { public: int x, y; };", ["A", "x", "y"]), ("int *p, **q;", ["p", "q"]), ("typedef int (*cb)(int);", ["cb"]), ("struct S { int a; } s, *t;", ["s", "S", "a", "t"]), ("int a[2][3] = {{1}}, (*b)[4], &c = d;", ["a", "b", "c"]),
        ("std::map<int, std::pair<A, B>> m, n;", ["m", "n"]), ("static unsigned long long big = 1;", ["big"]), ("int f(int a, int b);", ["f"]), ("return_t r;", ["r"]), ("using namespace std;\nfriend class X;\nstruct Y;", []), ("x = 3;", []),
    ],
)
def test_declarators(code, names):
    assert [s["name"] for s in extract_text(code, "cpp", "a.cpp")["symbols"]] == names


def test_owners():
    own = lambda lang, code: [s["self_path"] for s in extract_text(code, lang, "a")["symbols"]]
    assert own("cpp", "void n::W::go() {}\nnamespace n { class W {}; }\nvoid lost::f() {}")[0] == "namespace:n@1/class:W@1/method:go@1"
    assert own("cpp", "void lost::f() {}") == ["owner:lost@1/method:f@1"]
    assert own("rust", "trait T { fn a(&self); }") == ["trait:T@1", "trait:T@1/method:a@1"]
    assert own("go", "func (s *S) Run() {}\ntype S struct{}") == ["class:S@1/method:Run@1", "class:S@1"]
    assert own("javascript", "const t = { k() {} }") == ["owner:t@1", "owner:t@1/method:k@1"]


@pytest.mark.parametrize("durable", [True, False])
def test_stream_of_a_tree_survives_a_restart(tmp_path, durable):
    root = tmp_path / "r"
    (root / "src").mkdir(parents=True)
    options = {"root": str(root)} | ({"stateDir": str(tmp_path / "state")} if durable else {})
    for p, code in (("a.ts", "1"), ("src/b.ts", "1"), ("src/c.ts", "1"), ("src/no.txt", "")):
        (root / p).write_text(code)
    stream = TreeStream(options)
    # partitions are read by a copy of the reader that was made before any snapshot
    events = lambda s, a, b: sorted((r[1], r[2]) for part in s.partitions(a, b) for r in TreeStream(options).read(part))
    first = stream.latestOffset()
    assert events(stream, stream.initialOffset(), first) == [("a.ts", "add"), ("src/b.ts", "add"), ("src/c.ts", "add")]
    stream.commit(first)
    (root / "a.ts").write_text("2")
    os.utime(root / "a.ts", (5, 5))
    (root / "src/b.ts").unlink()
    (root / "new.ts").write_text("1")
    again = TreeStream(options) if durable else stream
    second = again.latestOffset()
    assert events(again, first, second) == [("a.ts", "change"), ("new.ts", "add"), ("src/b.ts", "unlink")]
    assert again.latestOffset() == second and events(again, second, second) == []
