"""Extraction of every language over one source file for each part, with the rows that each file must give.

A template is a source in which ``{n}`` is the part's number; parts are dealt out over a language's templates. Its rows are
a draft of the kernels' that was read over line by line, and mended together with them: what, name, kind, line, detail and
owner. Of the file, name is its parse state, line its first issue's, and detail the counts of errors and missing parts;
detail is "exported" or "" of a symbol, the locally bound names of an import, and the receiver of a call; owner is a
symbol's scope and the declaration that a call stands in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.parsing import extract

SOURCES: dict[str, tuple[str, list[tuple[str, list[tuple[str, str, str, int, str, str]]]]]] = {
    "python": (
        "py",
        [
            (
                'import os.path as p\nfrom ..a.b import c as d{n}\nclass K{n}:\n    def m(self):\n        return p.join(h{n}())\n\ndef top{n}():\n    K{n}()\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'K{n}', 'class', 3, 'exported', ''), ('symbol', 'm', 'method', 4, '', 'class:K{n}@1'), ('symbol', 'top{n}', 'function', 7, 'exported', ''), ('import', 'os/path', 'import', 1, 'p', ''), ('import', '../a/b', 'import', 2, 'd{n}', ''), ('call', 'h{n}', '', 5, '', 'm'), ('call', 'join', '', 5, 'p', 'm'), ('call', 'K{n}', '', 8, '', 'top{n}')],
            ),
            (
                'import a{n}, b.c\nfrom . import d as e\n@deco(x)\nasync def f{n}(p=g()):\n    await h()\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'f{n}', 'function', 4, 'exported', ''), ('import', 'a{n}', 'import', 1, 'a{n}', ''), ('import', 'b/c', 'import', 1, 'b', ''), ('import', './', 'import', 2, 'e', ''), ('call', 'deco', '', 3, '', ''), ('call', 'g', '', 4, '', 'f{n}'), ('call', 'h', '', 5, '', 'f{n}')],
            ),
            (
                'class A{n}(Base):\n    x = 1\n    class B:\n        def m(self):\n            self.go{n}()\n    @staticmethod\n    def s(): pass\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'A{n}', 'class', 1, 'exported', ''), ('symbol', 'B', 'class', 3, '', 'class:A{n}@1'), ('symbol', 'm', 'method', 4, '', 'class:A{n}@1/class:B@1'), ('symbol', 's', 'method', 7, '', 'class:A{n}@1'), ('call', 'go{n}', '', 5, 'self', 'm')],
            ),
            (
                'def f{n}(:\n    pass\n',
                [('file', 'failed', '', 1, '2,0', '')],
            ),
            (
                'def outer{n}():\n    def inner():\n        deep{n}()\n    return inner()\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'outer{n}', 'function', 1, 'exported', ''), ('symbol', 'inner', 'function', 2, '', 'function:outer{n}@1'), ('call', 'deep{n}', '', 3, '', 'inner'), ('call', 'inner', '', 4, '', 'outer{n}')],
            ),
            (
                'from m{n} import *\nx = [y() for y in z()]\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('import', 'm{n}', 'import', 1, '*', ''), ('call', 'y', '', 2, '', ''), ('call', 'z', '', 2, '', '')],
            ),
        ],
    ),
    "typescript": (
        "ts",
        [
            (
                "import d, { a as b } from './m{n}'\nexport { q } from './q'\nexport class S{n} {\n  draw(c: C): void { d.go(c); b() }\n}\nexport const v{n}: Map<string, number> = new Box(), w = 2\nfunction f() { const x = 1, y = 2; return g{n}() }\nexport type T{n} = string\n",
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'S{n}', 'class', 3, 'exported', ''), ('symbol', 'draw', 'method', 4, '', 'class:S{n}@1'), ('symbol', 'v{n}', 'variable', 6, 'exported', ''), ('symbol', 'w', 'variable', 6, 'exported', ''), ('symbol', 'f', 'function', 7, '', ''), ('symbol', 'T{n}', 'type', 8, 'exported', ''), ('import', './m{n}', 'import', 1, 'd,b', ''), ('import', './q', 'reexport', 2, 'q', ''), ('call', 'b', '', 4, '', 'draw'), ('call', 'go', '', 4, 'd', 'draw'), ('call', 'Box', '', 6, '', 'v{n}'), ('call', 'g{n}', '', 7, '', 'f')],
            ),
            (
                'export default class { m{n}() { this.go{n}() } }\nexport abstract class A{n} { static s = 1; get g() { return 2 } }\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'm{n}', 'method', 1, '', ''), ('symbol', 'A{n}', 'class', 2, 'exported', ''), ('symbol', 's', 'field', 2, '', 'class:A{n}@1'), ('symbol', 'g', 'method', 2, '', 'class:A{n}@1'), ('call', 'go{n}', '', 1, 'this', 'm{n}')],
            ),
            (
                'namespace N{n} { export function inner(): void {} }\nexport enum E{n} { A, B = 2 }\ninterface I { run(x: number): void }\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'inner', 'function', 1, 'exported', ''), ('symbol', 'E{n}', 'enum', 2, 'exported', ''), ('symbol', 'I', 'interface', 3, '', ''), ('symbol', 'run', 'method', 3, '', 'interface:I@1')],
            ),
            (
                'const table = { open{n}() { dial{n}() }, shut: () => hang(), async *gen() {} }\nexport const pick{n} = (a: string) => a.trim()\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'table', 'variable', 1, '', ''), ('symbol', 'open{n}', 'method', 1, '', 'owner:table@1'), ('symbol', 'gen', 'method', 1, '', 'owner:table@1'), ('symbol', 'pick{n}', 'variable', 2, 'exported', ''), ('call', 'dial{n}', '', 1, '', 'open{n}'), ('call', 'hang', '', 1, '', 'table'), ('call', 'trim', '', 2, 'a', 'pick{n}')],
            ),
            (
                "import type { T } from './t{n}'\nimport './side'\nexport * as all from '../all'\nfunction gen<T extends { id: string }>(x: T): T[] { return [make{n}<T>(x)] }\n",
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'gen', 'function', 4, '', ''), ('import', './t{n}', 'import', 1, 'T', ''), ('import', './side', 'import', 2, '', ''), ('import', '../all', 'reexport', 3, 'all', ''), ('call', 'make{n}', '', 4, '', 'gen')],
            ),
            (
                'export function broken{n}( {\n  return 1\n}\nfunction next() { ok{n}() }\n',
                [('file', 'partial', '', 2, '1,1', ''), ('symbol', 'next', 'function', 4, '', ''), ('call', 'ok{n}', '', 4, '', 'next')],
            ),
            (
                'const half{n} = (\n',
                [('file', 'partial', '', 1, '0,1', ''), ('symbol', 'half{n}', 'variable', 1, '', '')],
            ),
            (
                'let a{n} = ;\nlet b = 2\nfoo{n}(1,,2)\n',
                [('file', 'partial', '', 1, '2,0', ''), ('symbol', 'a{n}', 'variable', 1, '', ''), ('symbol', 'b', 'variable', 2, '', ''), ('call', 'foo{n}', '', 3, '', '')],
            ),
            (
                'class C{n} {\n  constructor(private x: number) { super.init() }\n  async load?(): Promise<void>\n  private y!: string\n}\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'C{n}', 'class', 1, '', ''), ('symbol', 'constructor', 'method', 2, '', 'class:C{n}@1'), ('symbol', 'load', 'method', 3, '', 'class:C{n}@1'), ('symbol', 'y', 'field', 4, '', 'class:C{n}@1'), ('call', 'init', '', 2, 'super', 'constructor')],
            ),
            (
                '@Injectable()\nexport class D{n} { @Input() size = 1; @Hook() on{n}() {} }\nabstract class Q { abstract run(): void }\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'D{n}', 'class', 2, 'exported', ''), ('symbol', 'size', 'field', 2, '', 'class:D{n}@1'), ('symbol', 'on{n}', 'method', 2, '', 'class:D{n}@1'), ('symbol', 'Q', 'class', 3, '', ''), ('symbol', 'run', 'method', 3, '', 'class:Q@1'), ('call', 'Injectable', '', 1, '', ''), ('call', 'Hook', '', 2, '', ''), ('call', 'Input', '', 2, '', '')],
            ),
        ],
    ),
    "javascript": (
        "js",
        [
            (
                "import * as ns from '../n{n}'\nconst a{n} = 1, b = 2\nexport function f{n}(x) { return ns.h(x) }\n// function ghost() {}\n",
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'a{n}', 'variable', 2, '', ''), ('symbol', 'b', 'variable', 2, '', ''), ('symbol', 'f{n}', 'function', 3, 'exported', ''), ('import', '../n{n}', 'import', 1, 'ns', ''), ('call', 'h', '', 3, 'ns', 'f{n}')],
            ),
            (
                'module.exports = { k{n}() { z{n}() }, v: 1 }\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'k{n}', 'method', 1, '', ''), ('call', 'z{n}', '', 1, '', 'k{n}')],
            ),
            (
                'function* seq{n}() { yield next() }\nasync function load() { await get{n}() }\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'seq{n}', 'function', 1, '', ''), ('symbol', 'load', 'function', 2, '', ''), ('call', 'next', '', 1, '', 'seq{n}'), ('call', 'get{n}', '', 2, '', 'load')],
            ),
            (
                'class B{n} extends A { static make() { return new B{n}() } get size() { return 1 } }\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'B{n}', 'class', 1, '', ''), ('symbol', 'make', 'method', 1, '', 'class:B{n}@1'), ('symbol', 'size', 'method', 1, '', 'class:B{n}@1'), ('call', 'B{n}', '', 1, '', 'make')],
            ),
            (
                'const broken{n} = (\n',
                [('file', 'partial', '', 1, '0,1', ''), ('symbol', 'broken{n}', 'variable', 1, '', '')],
            ),
            (
                'if (a { b{n}() }\nfunction fine{n}() {}\n',
                [('file', 'partial', '', 1, '1,0', ''), ('symbol', 'fine{n}', 'function', 2, '', ''), ('call', 'b{n}', '', 1, '', '')],
            ),
            (
                'const r = /[(]\\/x/g.test(s), t{n} = `a${f()}b`\nexport default function main{n}() { r.go() }\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'r', 'variable', 1, '', ''), ('symbol', 't{n}', 'variable', 1, '', ''), ('symbol', 'main{n}', 'function', 2, 'exported', ''), ('call', 'go', '', 2, 'r', 'main{n}')],
            ),
            (
                "import d{n}, * as ns from 'pkg'\nexport { d{n} as default } from './x'\nvar e1 = function named() { call{n}() }\n",
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'e1', 'variable', 3, '', ''), ('import', 'pkg', 'import', 1, 'd{n},ns', ''), ('import', './x', 'reexport', 2, 'default', ''), ('call', 'call{n}', '', 3, '', 'e1')],
            ),
            (
                'try { risky{n}() } catch { recover() } finally { done() }\nfor (const x of list()) use(x)\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('call', 'done', '', 1, '', ''), ('call', 'recover', '', 1, '', ''), ('call', 'risky{n}', '', 1, '', ''), ('call', 'list', '', 2, '', ''), ('call', 'use', '', 2, '', '')],
            ),
            (
                '}\nlet after{n} = 1\n',
                [('file', 'partial', '', 1, '1,0', ''), ('symbol', 'after{n}', 'variable', 2, '', '')],
            ),
        ],
    ),
    "arkts": (
        "ets",
        [
            (
                '@Component\nstruct P{n} {\n  build() {\n    Column() {\n    }\n  }\n  plain{n}() {\n    Bar()\n  }\n}\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'P{n}', 'class', 1, '', ''), ('symbol', 'build', 'method', 3, '', 'class:P{n}@1'), ('symbol', 'plain{n}', 'method', 7, '', 'class:P{n}@1'), ('call', 'Column', 'arkui', 4, '', 'build'), ('call', 'Bar', '', 8, '', 'plain{n}')],
            ),
            (
                "@Entry\n@Component\nstruct Page{n} {\n  @State count: number = 0\n  build() {\n    Row() {\n      Text('a').fontSize(3)\n    }\n  }\n}\n",
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'Page{n}', 'class', 1, '', ''), ('symbol', 'count', 'field', 4, '', 'class:Page{n}@1'), ('symbol', 'build', 'method', 5, '', 'class:Page{n}@1'), ('call', 'Row', 'arkui', 6, '', 'build'), ('call', 'Text', 'arkui', 7, '', 'build')],
            ),
            (
                "@Builder\nfunction Card{n}() {\n  Column() {\n    Image('x')\n  }\n}\n",
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'Card{n}', 'function', 1, '', ''), ('call', 'Column', 'arkui', 3, '', 'Card{n}'), ('call', 'Image', 'arkui', 4, '', 'Card{n}')],
            ),
            (
                "export class Model{n} { name: string = ''; save() { store{n}(this.name) } }\nexport enum K { A }\n",
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'Model{n}', 'class', 1, 'exported', ''), ('symbol', 'name', 'field', 1, '', 'class:Model{n}@1'), ('symbol', 'save', 'method', 1, '', 'class:Model{n}@1'), ('symbol', 'K', 'enum', 2, 'exported', ''), ('call', 'store{n}', '', 1, '', 'save')],
            ),
            (
                'struct Broken{n} {\n  build() {\n    Column() {\n',
                [('file', 'partial', '', 3, '0,1', ''), ('symbol', 'Broken{n}', 'class', 1, '', ''), ('symbol', 'build', 'method', 2, '', 'class:Broken{n}@1'), ('call', 'Column', 'arkui', 3, '', 'build')],
            ),
            (
                "import { a as b } from './m{n}'\nexport function plain{n}() { b() }\n",
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'plain{n}', 'function', 2, 'exported', ''), ('import', './m{n}', 'import', 1, 'b', ''), ('call', 'b', '', 2, '', 'plain{n}')],
            ),
        ],
    ),
    "go": (
        "go",
        [
            (
                'package m\nimport al "x/y{n}"\nvar (\n  a = 1\n)\ntype (\n  Q{n} struct{ x int }\n  r interface { M() }\n)\ntype S struct{}\nfunc (s *S) Run{n}() { al.Do() }\nfunc help() { g{n}() }\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'Q{n}', 'class', 7, 'exported', ''), ('symbol', 'r', 'interface', 8, '', ''), ('symbol', 'S', 'class', 10, 'exported', ''), ('symbol', 'Run{n}', 'method', 11, 'exported', 'class:S@1'), ('symbol', 'help', 'function', 12, '', ''), ('import', 'x/y{n}', 'import', 2, 'al', ''), ('call', 'Do', '', 11, 'al', 'Run{n}'), ('call', 'g{n}', '', 12, '', 'help')],
            ),
            (
                'package p\nimport (\n  "fmt"\n  . "dot{n}"\n  _ "blank"\n)\ntype G[T any] struct{ v T }\nfunc (g *G[T]) Put{n}(v T) { fmt.Println(v) }\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'G', 'class', 7, 'exported', ''), ('symbol', 'Put{n}', 'method', 8, 'exported', 'class:G@1'), ('import', 'fmt', 'import', 3, 'fmt', ''), ('import', 'dot{n}', 'import', 4, '*', ''), ('import', 'blank', 'import', 5, '', ''), ('call', 'Println', '', 8, 'fmt', 'Put{n}')],
            ),
            (
                'package p\ntype Reader{n} interface { Read(b []byte) (int, error) }\nfunc New{n}[T any](x T) *T { return helper(x) }\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'Reader{n}', 'interface', 2, 'exported', ''), ('symbol', 'New{n}', 'function', 3, 'exported', ''), ('call', 'helper', '', 3, '', 'New{n}')],
            ),
            (
                'package p\nfunc F{n}() {\n  go func() { work{n}() }()\n  defer shut()\n',
                [('file', 'partial', '', 2, '0,1', ''), ('symbol', 'F{n}', 'function', 2, 'exported', ''), ('call', 'work{n}', '', 3, '', 'F{n}'), ('call', 'shut', '', 4, '', 'F{n}')],
            ),
            (
                'package p\nconst C = 1\nvar V{n} = build()\nfunc (T) M() {}\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'M', 'method', 4, 'exported', 'class:T@1'), ('call', 'build', '', 3, '', '')],
            ),
        ],
    ),
    "rust": (
        "rs",
        [
            (
                'use crate::a{n}::{b, c as d};\npub struct P{n} {}\npub(crate) enum E { A }\nimpl P{n} { pub fn new() -> P{n} { helper{n}() } }\nfn helper{n}() { b::run(); }\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'P{n}', 'class', 2, 'exported', ''), ('symbol', 'E', 'enum', 3, '', ''), ('symbol', 'new', 'method', 4, 'exported', 'impl:P{n}@1'), ('symbol', 'helper{n}', 'function', 5, '', ''), ('import', 'crate/a{n}', 'import', 1, 'b,d', ''), ('call', 'helper{n}', '', 4, '', 'new'), ('call', 'run', '', 5, 'b', 'helper{n}')],
            ),
            (
                'pub trait Draw{n} { fn draw(&self); fn twice(&self) { self.draw() } }\nimpl Draw{n} for Circle { fn draw(&self) { paint{n}() } }\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'Draw{n}', 'interface', 1, 'exported', ''), ('symbol', 'draw', 'method', 1, '', 'trait:Draw{n}@1'), ('symbol', 'twice', 'method', 1, '', 'trait:Draw{n}@1'), ('symbol', 'draw', 'method', 2, '', 'impl:Draw{n}%20for%20Circle@1'), ('call', 'draw', '', 1, 'self', 'twice'), ('call', 'paint{n}', '', 2, '', 'draw')],
            ),
            (
                'mod inner{n} { pub fn f() { super::g() } }\npub const MAX: u32 = 3;\nmacro_rules! m { () => {} }\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'f', 'function', 1, 'exported', ''), ('call', 'g', '', 1, 'super', 'f')],
            ),
            (
                "use std::io::*;\npub use self::a{n}::B;\npub async unsafe fn run{n}<T: Clone>(x: &'static str) -> T { x.go::<T>() }\n",
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'run{n}', 'function', 3, 'exported', ''), ('import', 'std/io', 'import', 1, '*', ''), ('import', 'self/a{n}/B', 'import', 2, 'B', ''), ('call', 'go', '', 3, 'x', 'run{n}')],
            ),
            (
                'pub union U{n} { a: u32 }\nenum E { A(u8), B { x: i32 } }\nfn open{n}() {\n',
                [('file', 'partial', '', 3, '0,1', ''), ('symbol', 'U{n}', 'class', 1, 'exported', ''), ('symbol', 'E', 'enum', 2, '', ''), ('symbol', 'open{n}', 'function', 3, '', '')],
            ),
        ],
    ),
    "java": (
        "java",
        [
            (
                'package p;\nimport a.b.C{n};\nimport static d.E.max;\npublic class J{n} {\n  public int go(int a) { return new K().run{n}(a); }\n  private void z() { go(1); }\n}\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'J{n}', 'class', 4, 'exported', ''), ('symbol', 'go', 'method', 5, 'exported', 'class:J{n}@1'), ('symbol', 'z', 'method', 6, '', 'class:J{n}@1'), ('import', 'a/b/C{n}', 'import', 2, 'C{n}', ''), ('import', 'd/E', 'import', 3, 'max', ''), ('call', 'K', '', 5, '', 'go'), ('call', 'run{n}', '', 5, 'new K()', 'go'), ('call', 'go', '', 6, '', 'z')],
            ),
            (
                'package p;\nimport a.b.*;\npublic interface I{n} { void run(); default int two() { return go{n}(); } }\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'I{n}', 'interface', 3, 'exported', ''), ('symbol', 'run', 'method', 3, 'exported', 'interface:I{n}@1'), ('symbol', 'two', 'method', 3, 'exported', 'interface:I{n}@1'), ('import', 'a/b', 'import', 2, '*', ''), ('call', 'go{n}', '', 3, '', 'two')],
            ),
            (
                'class Outer{n} {\n  Outer{n}() { init(); }\n  static class In { protected <T> T get(T x) { return x; } }\n}\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'Outer{n}', 'class', 1, '', ''), ('symbol', 'Outer{n}', 'method', 2, '', 'class:Outer{n}@1'), ('symbol', 'In', 'class', 3, '', 'class:Outer{n}@1'), ('symbol', 'get', 'method', 3, '', 'class:Outer{n}@1/class:In@1'), ('call', 'init', '', 2, '', 'Outer{n}')],
            ),
            (
                'public enum E{n} { A, B; int f() { return g{n}(); } }\nrecord R(int x) {}\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'E{n}', 'enum', 1, 'exported', ''), ('symbol', 'f', 'method', 1, '', 'owner:E{n}@1'), ('symbol', 'R', 'class', 2, '', ''), ('call', 'g{n}', '', 1, '', 'f')],
            ),
            (
                'class Half{n} { void m() { call{n}();\n',
                [('file', 'partial', '', 1, '0,2', ''), ('symbol', 'Half{n}', 'class', 1, '', ''), ('symbol', 'm', 'method', 1, '', 'class:Half{n}@1'), ('call', 'call{n}', '', 1, '', 'm')],
            ),
        ],
    ),
    "c": (
        "c",
        [
            (
                '#include "a/b{n}.h"\n#define MAX(a, b) pick(a, b)\nstruct S{n} { int x; };\nstatic int hid() { return 1; }\nint run{n}(int a) { return hid(); }\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'S{n}', 'class', 3, 'exported', ''), ('symbol', 'x', 'field', 3, 'exported', 'class:S{n}@1'), ('symbol', 'hid', 'function', 4, '', ''), ('symbol', 'run{n}', 'function', 5, 'exported', ''), ('import', 'a/b{n}.h', 'include', 1, '', ''), ('call', 'hid', '', 5, '', 'run{n}')],
            ),
            (
                'int *p{n}, **q, r[3];\nstatic const char *names[] = {"a", "b"};\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'p{n}', 'variable', 1, 'exported', ''), ('symbol', 'q', 'variable', 1, 'exported', ''), ('symbol', 'r', 'variable', 1, 'exported', ''), ('symbol', 'names', 'variable', 2, '', '')],
            ),
            (
                'typedef int (*cb{n})(int);\ntypedef struct P { int a, b; } P, *PP{n};\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'cb{n}', 'type', 1, 'exported', ''), ('symbol', 'P', 'type', 2, 'exported', ''), ('symbol', 'P', 'class', 2, 'exported', 'owner:P@1'), ('symbol', 'a', 'field', 2, 'exported', 'owner:P@1/class:P@1'), ('symbol', 'b', 'field', 2, 'exported', 'owner:P@1/class:P@1'), ('symbol', 'PP{n}', 'type', 2, 'exported', '')],
            ),
            (
                'int (*handler{n})(int, char), other = 3;\nunsigned long size{n}(void);\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'handler{n}', 'function', 1, 'exported', ''), ('symbol', 'other', 'variable', 1, 'exported', ''), ('symbol', 'size{n}', 'function', 2, 'exported', '')],
            ),
            (
                'struct S{n} { int n : 3, m : 2; struct In { int k; } in, *ptr; void (*go)(void); };\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'S{n}', 'class', 1, 'exported', ''), ('symbol', 'n', 'field', 1, 'exported', 'class:S{n}@1'), ('symbol', 'm', 'field', 1, 'exported', 'class:S{n}@1'), ('symbol', 'In', 'class', 1, 'exported', 'class:S{n}@1'), ('symbol', 'k', 'field', 1, 'exported', 'class:S{n}@1/class:In@1'), ('symbol', 'ptr', 'field', 1, 'exported', 'class:S{n}@1'), ('symbol', 'go', 'method', 1, 'exported', 'class:S{n}@1')],
            ),
            (
                'enum E{n} { A, B };\nint f{n}(int a) { int local = g(a); return local; }\nextern int e[3][4];\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'E{n}', 'enum', 1, 'exported', ''), ('symbol', 'f{n}', 'function', 2, 'exported', ''), ('symbol', 'e', 'variable', 3, 'exported', ''), ('call', 'g', '', 2, '', 'f{n}')],
            ),
            (
                'void open{n}(void) {\n  if (x) {\n',
                [('file', 'partial', '', 1, '0,2', ''), ('symbol', 'open{n}', 'function', 1, 'exported', '')],
            ),
            (
                'int a{n} = f(3), b = 4;\nstruct Q *mk{n}(void) { return get(); }\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'a{n}', 'variable', 1, 'exported', ''), ('symbol', 'b', 'variable', 1, 'exported', ''), ('symbol', 'mk{n}', 'function', 2, 'exported', ''), ('call', 'f', '', 1, '', 'a{n}'), ('call', 'get', '', 2, '', 'mk{n}')],
            ),
            (
                '#include <stdio.h>\n#include "own{n}.h"\nstatic int hid{n};\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'hid{n}', 'variable', 3, '', ''), ('import', 'own{n}.h', 'include', 2, '', '')],
            ),
            (
                'int (*(*ff{n})(int))(double);\nint (*table{n}[4])(void);\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'ff{n}', 'function', 1, 'exported', ''), ('symbol', 'table{n}', 'function', 2, 'exported', '')],
            ),
        ],
    ),
    "cpp": (
        "cpp",
        [
            (
                'template<class K, class W> class Map{n} { K k; };\nstruct B { operator bool() const { return ok(); } };\nint (*fp{n}(int))(double) { return pick(); }\nvoid f() { S<int>::k{n}(); int x = int(3); }\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'Map{n}', 'class', 1, 'exported', ''), ('symbol', 'k', 'field', 1, '', 'class:Map{n}@1'), ('symbol', 'B', 'class', 2, 'exported', ''), ('symbol', 'fp{n}', 'function', 3, 'exported', ''), ('symbol', 'f', 'function', 4, 'exported', ''), ('call', 'ok', '', 2, '', ''), ('call', 'pick', '', 3, '', 'fp{n}'), ('call', 'k{n}', '', 4, 'S<int>', 'f')],
            ),
            (
                'class A{n} { public: int x, y; private: unsigned long z = 3, *w[4]; };\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'A{n}', 'class', 1, 'exported', ''), ('symbol', 'x', 'field', 1, 'exported', 'class:A{n}@1'), ('symbol', 'y', 'field', 1, 'exported', 'class:A{n}@1'), ('symbol', 'z', 'field', 1, '', 'class:A{n}@1'), ('symbol', 'w', 'field', 1, '', 'class:A{n}@1')],
            ),
            (
                'int *p{n}, &r = *p{n};\nstd::vector<int> v{n}{1, 2}, u;\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'p{n}', 'variable', 1, 'exported', ''), ('symbol', 'r', 'variable', 1, 'exported', ''), ('symbol', 'v{n}', 'variable', 2, 'exported', ''), ('symbol', 'u', 'variable', 2, 'exported', '')],
            ),
            (
                'using X{n} = int;\ntypedef std::map<int, A> M{n}, *MP;\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'X{n}', 'type', 1, 'exported', ''), ('symbol', 'M{n}', 'type', 2, 'exported', ''), ('symbol', 'MP', 'type', 2, 'exported', '')],
            ),
            (
                'namespace n{n} { int in_ns; static int hid; class W { void draw(); }; }\nvoid n{n}::W::draw() { paint(); }\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'n{n}', 'module', 1, 'exported', ''), ('symbol', 'in_ns', 'variable', 1, 'exported', 'namespace:n{n}@1'), ('symbol', 'hid', 'variable', 1, '', 'namespace:n{n}@1'), ('symbol', 'W', 'class', 1, 'exported', 'namespace:n{n}@1'), ('symbol', 'draw', 'method', 1, '', 'namespace:n{n}@1/class:W@1'), ('symbol', 'draw', 'method', 2, 'exported', 'namespace:n{n}@1/class:W@1'), ('call', 'paint', '', 2, '', 'draw')],
            ),
            (
                'auto l{n} = [](int a) { return g(a); };\nint a = f(3), b(4);\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'l{n}', 'variable', 1, 'exported', ''), ('symbol', 'a', 'variable', 2, 'exported', ''), ('symbol', 'b', 'variable', 2, 'exported', ''), ('call', 'g', '', 1, '', 'l{n}'), ('call', 'f', '', 2, '', 'a')],
            ),
            (
                'extern "C" { int ext; void cfn{n}(int); }\nnamespace { int anon; }\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'ext', 'variable', 1, 'exported', ''), ('symbol', 'cfn{n}', 'function', 1, 'exported', ''), ('symbol', 'anon', 'variable', 2, 'exported', '')],
            ),
            (
                'struct V{n} { V{n}(int a) : x(a) {} ~V{n}(); V{n} &operator=(const V{n} &o) { return *this; } int x; };\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'V{n}', 'class', 1, 'exported', ''), ('symbol', 'V{n}', 'method', 1, 'exported', 'class:V{n}@1'), ('symbol', '~V{n}', 'method', 1, 'exported', 'class:V{n}@1'), ('symbol', 'x', 'field', 1, 'exported', 'class:V{n}@1')],
            ),
            (
                'void lost{n}::f() { run{n}(); }\nconst int (*arr{n})[3];\n',
                [('file', 'parsed', '', 0, '0,0', ''), ('symbol', 'f', 'method', 1, 'exported', 'owner:lost{n}@1'), ('symbol', 'arr{n}', 'variable', 2, 'exported', ''), ('call', 'run{n}', '', 1, '', 'f')],
            ),
            (
                'class Half{n} { void m() { call{n}();\n',
                [('file', 'partial', '', 1, '0,2', ''), ('symbol', 'Half{n}', 'class', 1, 'exported', ''), ('symbol', 'm', 'method', 1, '', 'class:Half{n}@1'), ('call', 'call{n}', '', 1, '', 'm')],
            ),
        ],
    ),
}


def extracted(part: DataFrame, lang: str) -> DataFrame:
    """``path, what, name, kind, line, detail, owner`` of the file of every part."""
    ext, templates = SOURCES[lang]
    n = F.col("p_partkey").cast("string")
    code = F.get(F.array(*[F.lit(c) for c, _ in templates]), (F.col("p_partkey") % len(templates)).cast("int"))
    sources = part.select(F.concat(F.lit("src/p"), n, F.lit(f".{ext}")).alias("path"), F.lit(lang).alias("lang"), F.replace(code, F.lit("{n}"), n).alias("code"))
    none = F.lit("")
    row = lambda what, name, kind, line, detail, owner: F.struct(F.lit(what).alias("what"), name.alias("name"), kind.alias("kind"), line.alias("line"), detail.alias("detail"), owner.alias("owner"))
    d = F.col("diagnostic")
    rows = F.concat(
        F.array(row("file", d["status"], none, F.coalesce(F.get(d["issues"], F.lit(0))["line"], F.lit(0)), F.concat_ws(",", d["error_count"], d["missing_count"]), none)),
        F.transform("symbols", lambda s: row("symbol", s["name"], s["kind"], s["line"], F.when(s["exported"], "exported").otherwise(none), s["container_path"])),
        F.transform("imports", lambda i: row("import", i["specifier"], i["kind"], i["line"], F.array_join(F.transform(F.coalesce(i["bindings"], F.array()), lambda b: b["local"]), ","), none)),
        F.transform("calls", lambda c: row("call", c["name"], F.coalesce(c["context"], none), c["line"], F.coalesce(c["qualifier"], none), c["from_name"])),
    )
    return extract.extract(extract.dealt(sources)).select("path", F.explode(rows).alias("r")).select("path", "r.*")


def sql(lang: str) -> str:
    """The rows written down for one language, for every part."""
    ext, templates = SOURCES[lang]
    text = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {text(what)}, {text(name)}, {text(kind)}, {line}, {text(detail)}, {text(owner)})" for k, (_, rows) in enumerate(templates) for what, name, kind, line, detail, owner in rows)
    fill = lambda c: f"replace({c}, '{{n}}', CAST(p_partkey AS VARCHAR)) AS {c}"
    return f"SELECT concat('src/p', CAST(p_partkey AS VARCHAR), '.{ext}') AS path, what, {fill('name')}, kind, CAST(line AS INT) AS line, {fill('detail')}, {fill('owner')} FROM part JOIN (VALUES {values}) AS v(k, what, name, kind, line, detail, owner) ON p_partkey % {len(templates)} = k"
