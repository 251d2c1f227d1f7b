"""Declarations, imports and calls of brace languages, by patterns over blanked code."""

from __future__ import annotations

import re
from collections.abc import Iterator

from codeloom.parsing import declarators, wellformed
from codeloom.parsing.lexer import Braces, Lines, closing, scan
from codeloom.parsing.model import Call, Parsed, Symbol, binding, imported

_ID = r"[A-Za-z_$][\w$]*"
# Words that look like calls or declarations and aren't.
_NOT_CALLS = set("if for while switch return sizeof else do case super import in catch".split())
_NOT_CALLS_OF = {
    "typescript": set("function typeof await new throw of yield delete void with constructor async get set".split()), "go": set("var const type func defer go select range make new append len cap panic recover copy close delete interface struct map chan".split()),
    "rust": set("match loop fn impl pub move as where unsafe struct enum trait type use mod let mut ref dyn Some Ok Err None".split()), "java": set("new throw synchronized assert try instanceof this".split()),
    "cpp": set("int char bool void float double short long signed unsigned auto wchar_t template typename using namespace new throw delete alignof decltype noexcept static_assert typeid alignas defined operator co_await co_return".split()),
}
_BODY = re.compile(r"[()\[\]{;]")
_IN_RECEIVER = re.compile(r"[\w$.?:@]")
# A name that a call can follow is read whole, and from its beginning.
_CALL = re.compile(r"(?:\bnew\s+|(?<![A-Za-z_$]))(?P<name>[A-Za-z_$][\w$]*+)\s*(?:::)?(?:<[\w\s,<>\[\]&:*.?$]*>)?\s*!?\(")
_SAME = {"javascript": "typescript", "arkts": "typescript", "c": "cpp"}


def _each(pattern: str, code: str, *words: str) -> Iterator[re.Match]:
    """The matches of a pattern, each of which holds one of the words: most files lack most of them."""
    for w in words:
        if w in code:
            return re.finditer(pattern, code)
    return iter(())


class _Source:
    def __init__(self, code: str, lang: str):
        self.raw, self.lang = code, lang
        self.code = scan(code, lang)
        self.braces, self.lines = Braces(self.code), Lines(code)
        self.symbols: list[Symbol] = []
        self.imports: list[dict] = []
        self.calls: list[Call] = []
        self.not_calls = _NOT_CALLS | _NOT_CALLS_OF.get(_SAME.get(lang, lang), set())
        self.taken: set[int] = set()  # starts of names that are declared here, so they aren't calls

    def body_end(self, at: int) -> int:
        """End (exclusive) of the declaration whose body or semicolon follows position at."""
        depth = 0
        for m in _BODY.finditer(self.code, at):
            c = m[0]
            if c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif c == "{" and depth <= 0:
                return self.braces.pairs.get(m.start(), len(self.code) - 1) + 1
            elif c == ";" and depth <= 0:
                return m.start() + 1
        return len(self.code)

    def add(self, m: re.Match, name: str, kind: str, stop: int, exported: bool, head: str, **more) -> Symbol:
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        s = Symbol(name, kind, start, stop, self.lines.of(start), self.lines.of(max(start, stop - 1)), exported, head, **more)
        self.symbols.append(s)
        self.taken.add(m.start("name") if "name" in m.re.groupindex else start)
        return s

    def issues(self) -> list[tuple[str, int]]:
        out = [("missing", self.lines.of(p)) for p in self.braces.open_left]
        return out + [("error", 1)] * (self.braces.unmatched - len(self.braces.open_left))

    def find_calls(self, scoped: str = r"\.|\?\.|::|->") -> None:
        ends = re.compile(rf"(?:{scoped})$")
        for m in _CALL.finditer(self.code):
            name, at = m["name"], m.start("name")
            if name in self.not_calls or at in self.taken:
                continue
            stop = at
            while stop and self.code[stop - 1].isspace():
                stop -= 1
            before = self.code[max(0, stop - 16) : stop]
            q = None
            if r := ends.search(before):
                q = self._receiver(stop - len(before) + r.start())
                if q is None:
                    continue
            elif re.search(r"\b(?:function|fn|func|def|class|interface|enum|struct)$", before):
                continue
            if "!" in m[0][len(name) :] and self.lang == "rust":
                continue
            self.calls.append(Call(name, at, self.lines.of(at), q))

    def _receiver(self, end: int) -> str | None:
        """The text of the expression that a member is called on, which ends at a position."""
        code, i = self.code, end
        while i > 0:
            c = code[i - 1]
            if c in ")]":
                depth, j = 0, i - 1
                while j >= 0:
                    depth += code[j] in ")]"
                    depth -= code[j] in "(["
                    if depth == 0:
                        break
                    j -= 1
                i = max(0, j)
            elif _IN_RECEIVER.match(c) or (c == ">" and code[i - 2 : i] == "->"):
                i -= 2 if c == ">" else 1
            elif c == ">" and (j := self._angle(code, i - 1)) is not None:
                i = j
            elif c in "\"'`":
                j = code.rfind(c, 0, i - 1)
                i = j if j >= 0 else i - 1
                break
            else:
                break
        if made := re.search(r"\bnew\s+$", code[max(0, i - 40) : i]):
            i = max(0, i - 40) + made.start()
        text = self.raw[i:end].strip().strip(".:?")
        return text or None

    @staticmethod
    def _angle(before: str, at: int) -> int | None:
        """Where the type arguments that end at position at begin, if a name stands before them."""
        depth = 0
        for j in range(at, max(-1, at - 200), -1):
            if before[j] in ";{}":
                return None
            depth += (before[j] == ">") - (before[j] == "<")
            if depth == 0:
                return j if re.search(r"\w$", before[max(0, j - 1) : j]) else None
        return None


def _string(raw: str, at: int) -> str:
    m = re.compile(r"""\s*(["'`])(.*?)\1""", re.S).match(raw, at)
    return m[2] if m else ""


# -- TypeScript, JavaScript, ArkTS -------------------------------------------------------------------------------------
def script(code: str, lang: str) -> Parsed:
    s = _Source(code, lang)
    typed = lang in ("typescript", "arkts")
    export = r"(?P<export>export\s+)?(?:default\s+)?(?:declare\s+)?"
    top = lambda at: s.braces.enclosing(at)
    checked = wellformed.check(code, lang)

    for m in _each(r"\bimport\s+(?:type\s+)?(?P<what>[\w$*{},\s]*?)\s*(?:from\s*)?(?=[\"'])", s.code, "import"):
        s.imports.append(imported(_string(s.raw, m.end()), s.lines.of(m.start()), "import", _es_bindings(m["what"])))
    for m in _each(r"\bexport\s+(?:type\s+)?(?P<what>\*(?:\s+as\s+[\w$]+)?|\{[^}]*\})\s*from\s*(?=[\"'])", s.code, "export"):
        s.imports.append(imported(_string(s.raw, m.end()), s.lines.of(m.start()), "reexport", _es_bindings(m["what"])))
    s.imports.sort(key=lambda i: i["line"])

    bodies: dict[int, str] = {}  # bodies of classes and interfaces
    kinds = r"abstract\s+class|class" + (r"|interface|enum|namespace|struct" if typed else "")
    for m in _each(rf"{export}(?:const\s+(?=enum))?(?:abstract\s+)?\b(?P<kind>{kinds})\s+(?P<name>{_ID})", s.code, "class", "interface", "enum", "namespace", "struct"):
        kind = m["kind"].split()[-1]
        if kind == "namespace" or (kind == "struct" and lang != "arkts"):
            continue
        open_ = s.code.find("{", m.end())
        if open_ < 0:
            continue
        stop = s.braces.pairs.get(open_, len(s.code) - 1) + 1
        start, decorators = _decorated(s, m.start())
        sym = s.add(m, m["name"], "class" if kind == "struct" else kind, stop, bool(m["export"]), ("struct " if kind == "struct" else "") + m["name"], decorators=decorators)
        if lang == "arkts" and decorators:
            sym.start, sym.line = start, s.lines.of(start)
        if kind != "enum":
            bodies[open_] = kind
    for m in () if checked else re.finditer(rf"{export}(?:async\s+)?\bfunction\s*\*?\s*(?P<name>{_ID})\s*(?:<[^()]*>)?\s*(?=\()", s.code):
        close = closing(s.code, m.end())
        start, decorators = _decorated(s, m.start())
        s.add(m, m["name"], "function", s.body_end(close + 1), bool(m["export"]), m["name"] + s.raw[m.end() : close + 1], decorators=decorators)
    if typed:
        for m in _each(rf"(?:^|(?<=[\n;}}]))\s*{export}type\s+(?P<name>{_ID})\s*(?:<[^=]*>)?\s*=", s.code, "type"):
            end = re.compile(r";|\n(?=\s*(?:export|import|const|let|type|function|class|interface|enum)\b)|\n\s*\n|$").search(s.code, m.end())
            s.add(m, m["name"], "type", end.start() + 1 if end else len(s.code), bool(m["export"]), m["name"])
    for m in _each(rf"(?:^|(?<=[\n;{{}}]))\s*{export}(?:const|let|var)\s+(?P<name>{_ID})\s*(?P<after>[:=;,\n])", s.code, "const", "let", "var"):
        if top(m.start("name")) < 0:
            stop = _value_end(s, m.end())
            first = m.end("name")
            if m["after"] == "," or s.code[stop - 1 : stop] != ";" or "," in s.code[first:stop]:
                stop = _declarators(s, m, first, stop)
            s.add(m, m["name"], "variable", min(stop, len(s.code)), bool(m["export"]), m["name"])
    for open_, _kind in bodies.items():
        if checked and _kind != "interface":
            continue
        close = s.braces.pairs.get(open_, len(s.code))
        for m in re.finditer(rf"(?:^|(?<=[;{{}}\n]))\s*(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set|accessor|declare)\s+)*\*?\s*(?P<name>[#]?{_ID})\s*[?!]?\s*(?:<[^()=;]*>)?\s*(?P<next>[(:=;])", s.code[open_ + 1 : close]):
            at = open_ + 1 + m.start("name")
            if s.braces.enclosing(at) != open_ or m["name"] in {"if", "for", "while", "switch", "return", "catch", "function", "super"}:
                continue
            decorators = _decorated(s, open_ + 1 + m.start() + len(m[0]) - len(m[0].lstrip()))[1]
            whole = re.compile(re.escape(m["name"])).match(s.code, at)
            if m["next"] == "(":
                paren = s.code.index("(", at)
                end = closing(s.code, paren)
                stop = s.body_end(end + 1)
                sym = s.add(whole, m["name"], "method", min(stop, close), False, m["name"] + s.raw[paren : end + 1], decorators=decorators)
                s.taken.add(at)
                sym.exported = False
            elif typed and _kind != "interface":
                s.add(whole, m["name"], "field", _value_end(s, at), False, m["name"], decorators=decorators)
    issues = s.issues()
    if checked:
        issues, found = checked
        for f in found:
            s.taken.add(f.name_at)
            if f.kind == "field" and not typed:
                continue
            decorators = [code[a:b] for a, b in f.decorators]
            start = f.start
            if f.kind == "function":
                outer, decorators = _decorated(s, re.compile(r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?$").search(s.code, 0, f.start).start() if s.code[: f.start].rstrip().endswith(("export", "default", "declare")) else f.start)
                if lang == "arkts" and decorators:
                    start = outer
            elif f.decorators and (lang == "arkts" or f.kind == "field"):
                start = f.decorators[0][0]
            head = f.name if f.kind == "field" else f.name + code[f.name_at + len(f.name) : f.head_end]
            s.symbols.append(Symbol(f.name, f.kind, start, f.stop, s.lines.of(start), s.lines.of(max(start, f.stop - 1)), f.exported, head, decorators=decorators))
    s.find_calls(r"\?\.|\.")
    if lang == "arkts":
        _arkui(s)
    return Parsed(s.symbols, s.imports, s.calls, issues)


def _line_end(s: _Source, at: int) -> int:
    end = s.code.find("\n", at)
    return len(s.code) if end < 0 else end


def _value_end(s: _Source, at: int) -> int:
    """End of an initialiser: the first semicolon or line break outside brackets."""
    depth = 0
    for i in range(at, len(s.code)):
        c = s.code[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return i
        elif depth == 0 and (c == ";" or (c == "\n" and not re.search(r"[=,:|&+\-?(]\s*$", s.code[max(0, i - 30) : i]) and not re.match(r"\s*[.?|&:]", s.code[i:]))):
            return i + (c == ";")
    return len(s.code)


def _declarators(s: _Source, m: re.Match, at: int, stop: int) -> int:
    """Add the variables after the first one of a statement whose first name ends at ``at``; returns the first one's end."""
    stop = max(stop, _value_end(s, at))
    depth, in_type, cuts = 0, False, []
    for i in range(at, stop):
        c = s.code[i]
        if depth == 0 and c in ":=,":
            in_type = c == ":" or (in_type and s.code[i : i + 2] == "=>")
        depth += (c in "([{" or (c == "<" and in_type)) - (c in ")]}" or (c == ">" and in_type and s.code[i - 1] != "="))
        if c == "," and depth == 0:
            cuts.append(i)
    for start, end in zip(cuts, [*cuts[1:], stop]):
        if name := re.compile(rf"\s*(?P<name>{_ID})\s*(?=[:=,;\n]|$)").match(s.code, start + 1, end):
            s.add(name, name["name"], "variable", end, bool(m["export"]), name["name"])
        else:  # a comma of another kind, as in type arguments: all is one variable
            return stop
    return cuts[0] if cuts else stop


def _decorated(s: _Source, at: int) -> tuple[int, list[str]]:
    """Start with the decorators before a declaration, and their texts."""
    head, found = s.code[:at], []
    while m := re.search(r"@[\w.]+\s*(\([^()]*\))?\s*(?:export\s+)?$", head):
        found.insert(0, s.raw[m.start() : m.end()].replace("export", "").strip())
        head = head[: m.start()]
    return (len(head) if found else at), found


def _es_bindings(what: str) -> list[dict]:
    out, what = [], what.strip()
    if m := re.search(r"\{([^}]*)\}", what):
        for part in filter(None, (p.strip() for p in m[1].split(","))):
            names = re.split(r"\s+as\s+", re.sub(r"^type\s+", "", part))
            out.append(binding(names[0], names[-1], "default" if names[0] == "default" else "named"))
        what = what.replace(m[0], "")
    if m := re.search(rf"\*\s*(?:as\s+({_ID}))?", what):
        out.insert(0, binding("*", m[1] or "*", "namespace" if m[1] else "glob"))
        what = what.replace(m[0], "")
    if m := re.match(rf"\s*({_ID})", what):
        out.insert(0, binding("default", m[1], "default"))
    return out


def _arkui(s: _Source) -> None:
    """Mark component calls in builder code; their modifier chains are no calls of their own.

    Builder code is the ``build`` of a struct and what has the decorator ``@Builder``; a callback within it that isn't an
    argument of a component with children is plain code.
    """
    kept = []
    structs = [x for x in s.symbols if x.signature.startswith("struct ")]
    inside = lambda x: any(o.start < x.start and x.stop <= o.stop for o in structs)
    builders = [x for x in s.symbols if x.kind in ("method", "function") and (x.name == "build" and inside(x) or any(re.match(r"@Builder\b", d) for d in x.decorators))]

    def builds(at: int) -> bool:
        around = [x for x in builders if x.start <= at < x.stop]
        if not around:
            return False
        low, box = s.code.find("{", max(x.start for x in around)), s.braces.enclosing(at)
        while box > low:
            head = s.code[max(low, box - 200) : box].rstrip()
            if re.search(r"=>$", head) or re.search(r"\bfunction\b[^;{}]*$", head):
                back, open_ = 0, box
                for open_ in range(box - 1, low, -1):  # the bracket that the callback stands in
                    back += (s.code[open_] in ")]}") - (s.code[open_] in "([{")
                    if back < 0:
                        break
                name = re.search(r"(\.?)\s*([A-Za-z_]\w*)$", s.code[:open_].rstrip())
                if not name or name[1] or not re.fullmatch(r"ForEach|LazyForEach|Repeat", name[2]):
                    return False
            box = s.braces.enclosing(box)
        return True

    for c in s.calls:
        line_start = s.code.rfind("\n", 0, c.start) + 1
        head = s.code[line_start : c.start]
        if c.qualifier is not None and (re.match(r"\s*\.$", head) or re.match(r"[A-Z]\w*\s*\(", c.qualifier) and builds(c.start)):
            continue
        if c.qualifier is None and c.name[:1].isupper() and re.match(r"\s*$", head) and builds(c.start):
            c.context = "arkui"
        kept.append(c)
    s.calls = kept


# -- Go ----------------------------------------------------------------------------------------------------------------
def go(code: str) -> Parsed:
    s = _Source(code, "go")
    upper = lambda n: n[:1].isupper()
    for m in re.finditer(r"(?m)^import\s*(?P<paren>\()?", s.code):
        end = closing(s.code, m.end() - 1) if m["paren"] else _line_end(s, m.end())
        for i in re.finditer(r"(?P<alias>[\w.]+\s+)?(?P<quote>[\"`])", s.code[m.end() : end]):
            spec = _string(s.raw, m.end() + i.start("quote"))
            if not spec or spec.startswith("\n"):
                continue
            alias = (i["alias"] or "").strip()
            b = [binding("*", "*", "glob")] if alias == "." else [] if alias == "_" else [binding(None, alias or spec.split("/")[-1], "package")]
            if not any(x["specifier"] == spec and x["line"] == s.lines.of(m.end() + i.start("quote")) for x in s.imports) and re.fullmatch(r"[\w./~+-]+", spec):
                s.imports.append(imported(spec, s.lines.of(m.end() + i.start("quote")), "import", b))
    for m in re.finditer(r"(?m)^func\s+(?:\((?P<recv>[^)]*)\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*(?=\()", s.code):
        close = closing(s.code, m.end())
        owner = ()
        if m["recv"]:
            kind = re.sub(r"\[.*", "", m["recv"].split()[-1].lstrip("*"))
            owner = (("class", kind),)
        s.add(m, m["name"], "method" if owner else "function", s.body_end(close + 1), upper(m["name"]), m["name"] + s.raw[m.end() : close + 1], owner=owner)
    one = re.compile(r"(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*=?\s*(?P<what>struct|interface)?\b")
    for t in re.finditer(r"(?m)^type\s*(?P<paren>\()?", s.code):
        at, end = t.end(), closing(s.code, t.end() - 1) if t["paren"] else len(s.code)
        while m := re.compile(r"[\s;]*").match(s.code, at, end):
            m = one.match(s.code, m.end(), end)
            if not m:
                break
            kind = {"struct": "class", "interface": "interface"}.get(m["what"], "type")
            stop = s.body_end(m.end()) if m["what"] else _line_end(s, m.end())
            sym = s.add(m, m["name"], kind, stop, upper(m["name"]), m["name"])
            if not t["paren"]:
                sym.start = t.start()
                break
            at = stop
    s.find_calls(r"\.")
    listed = [x for x in s.symbols if x.kind == "interface"]
    s.calls = [c for c in s.calls if not any(x.start <= c.start < x.stop for x in listed)]  # methods of interfaces look like calls
    return Parsed(s.symbols, s.imports, s.calls, s.issues())


# -- Rust --------------------------------------------------------------------------------------------------------------
def rust(code: str) -> Parsed:
    s = _Source(code, "rust")
    public = lambda m: bool(re.match(r"pub\s+", m["pub"] or ""))
    vis = r"(?P<pub>pub(?:\s*\([^)]*\))?\s+)?"
    impls: list[tuple[int, int, str]] = []
    for m in _each(r"\bimpl\b\s*(?:<[^{]*?>\s*)?(?P<head>[^{;]+)\{", s.code, "impl"):
        head = re.sub(r"\s+where\b.*", "", m["head"], flags=re.S)
        impls.append((m.end() - 1, s.braces.pairs.get(m.end() - 1, len(s.code)), " ".join(head.split())))
    for m in _each(rf"{vis}(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+(?:\"\s*\"\s+)?)*\bfn\s+(?P<name>\w+)\s*(?:<[^(]*>)?\s*(?=\()", s.code, "fn"):
        close, box = closing(s.code, m.end()), s.braces.enclosing(m.start("name"))
        owner = next((h for a, _, h in impls if a == box), None)
        in_trait = box >= 0 and "trait" in s.code and re.search(r"\btrait\s+\w+[^{};]*$", s.code[:box])
        stop = s.body_end(close + 1)
        s.add(m, m["name"], "method" if owner or in_trait else "function", stop, public(m), m["name"] + s.raw[m.end() : close + 1], owner=(("impl", owner),) if owner else ())
    for m in _each(rf"{vis}\b(?P<what>struct|enum|trait|union)\s+(?P<name>\w+)", s.code, "struct", "enum", "trait", "union"):
        kind = {"struct": "class", "union": "class", "enum": "enum", "trait": "interface"}[m["what"]]
        s.add(m, m["name"], kind, s.body_end(m.end()), public(m), m["name"])
    for m in _each(r"\b(?:pub(?:\s*\([^)]*\))?\s+)?use\s+(?P<path>[^;]+);", s.code, "use"):
        path = "".join(m["path"].split()) if " as " not in m["path"] else re.sub(r"\s*(::|[{},])\s*", r"\1", m["path"].strip())
        base = re.sub(r"\s+as\s+\w+$", "", re.sub(r"::(\{.*|\*)$", "", path))
        bs = []
        if path.endswith("*"):
            bs.append(binding("*", "*", "glob"))
        elif (k := path.find("{")) >= 0:
            for part in filter(None, path[k + 1 :].rstrip("}").split(",")):
                names = re.split(r"\s+as\s+", part.split("::")[-1])
                bs.append(binding(names[0], names[-1], "named") if names[0] != "*" else binding("*", "*", "glob"))
        else:
            names = re.split(r"\s+as\s+", path.split("::")[-1])
            bs.append(binding(names[0], names[-1], "named"))
        s.imports.append(imported(base.replace("::", "/"), s.lines.of(m.start()), "import", bs))
    s.find_calls(r"\.|::")
    listed = [x for x in s.symbols if x.kind == "enum"]
    s.calls = [c for c in s.calls if not any(x.start <= c.start < x.stop for x in listed)]  # variants with fields look like calls
    return Parsed(s.symbols, s.imports, s.calls, s.issues())


# -- Java --------------------------------------------------------------------------------------------------------------
def java(code: str) -> Parsed:
    s = _Source(code, "java")
    mods = r"(?P<mods>(?:(?:@\w[\w.]*(?:\([^()]*\))?|public|private|protected|static|final|abstract|synchronized|native|default|sealed|strictfp)\s+)*)"
    bodies: dict[int, str] = {}
    for m in re.finditer(r"\bimport\s+(?P<static>static\s+)?(?P<path>[\w.]+)(?P<all>\.\*)?\s*;", s.code):
        last = m["path"].split(".")[-1]
        if m["all"]:
            row = imported(m["path"].replace(".", "/"), s.lines.of(m.start()), "import", [binding("*", "*", "glob")])
        elif m["static"]:
            row = imported(m["path"].rsplit(".", 1)[0].replace(".", "/"), s.lines.of(m.start()), "import", [binding(last, last, "static")])
        else:
            row = imported(m["path"].replace(".", "/"), s.lines.of(m.start()), "import", [binding(last, last, "named")])
        s.imports.append(row)
    for m in re.finditer(rf"{mods}\b(?P<what>class|@?interface|enum|record)\s+(?P<name>{_ID})", s.code):
        open_ = s.code.find("{", m.end())
        if open_ < 0:
            continue
        kind = {"class": "class", "record": "class", "enum": "enum"}.get(m["what"], "interface")
        bodies[open_] = kind
        inside = bodies.get(s.braces.enclosing(m.start("name")))
        s.add(m, m["name"], kind, s.braces.pairs.get(open_, len(s.code) - 1) + 1, "public" in m["mods"].split() or inside == "interface", m["name"])
    for m in re.finditer(rf"{mods}(?:<[^<>()]*>\s*)?(?P<type>[\w.<>\[\],?&\s]*?[\w>\]]\s+)?(?P<name>{_ID})\s*(?=\()", s.code):
        box = s.braces.enclosing(m.start("name"))
        owner = bodies.get(box)
        close = closing(s.code, m.end())
        after = re.match(r"\s*(?:throws\s+[\w.,\s]+)?\s*[{;]", s.code[close + 1 :])
        name_of = next((x.name for x in s.symbols if x.start < box < x.stop and s.code.find("{", x.start) == box or box in bodies and s.braces.pairs.get(box, 0) + 1 == x.stop), None)
        if not owner or not after or m["name"] in s.not_calls or (not (m["type"] or "").strip() and m["name"] != name_of) or (m["type"] or "").split()[:1] in (["return"], ["new"], ["throw"]):
            continue
        if re.search(r"[=.(,]\s*$", s.code[: m.start("type") if m["type"] else m.start("name")]):
            continue
        s.add(m, m["name"], "method", s.body_end(close + 1), "public" in (m["mods"] + (m["type"] or "")).split() or owner == "interface", m["name"] + s.raw[m.end() : close + 1])
    s.find_calls(r"\.|::")
    return Parsed(s.symbols, s.imports, s.calls, s.issues())


def _without_template_heads(code: str) -> str:
    """code with the parameter lists of templates blanked, so that they aren't taken for declarations."""
    out = list(code)
    for m in _each(r"\btemplate\s*(?=<)", code, "template"):
        depth = 0
        for i in range(m.end(), len(code)):
            depth += (code[i] == "<") - (code[i] == ">" and code[i - 1] != "-")
            if code[i] in ";{}":
                break
            if depth == 0:
                out[m.start() : i + 1] = [c if c == "\n" else " " for c in code[m.start() : i + 1]]
                break
    return "".join(out)


# -- C and C++ ---------------------------------------------------------------------------------------------------------
def c_family(code: str, lang: str) -> Parsed:
    s = _Source(code, "cpp")
    for m in _each(r'(?m)^[ \t]*#[ \t]*include[ \t]*(?=")', s.code, "include"):
        s.imports.append(imported(_string(s.raw, m.end()), s.lines.of(m.start()), "include", []))
    whole = s.code
    if "#" in whole:
        s.code = re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", lambda m: re.sub(r"[^\n]", " ", m[0]), s.code)
    s.code = _without_template_heads(s.code)
    if s.code != whole:
        s.braces = Braces(s.code)
    boxes: dict[int, tuple[str, str]] = {}
    for m in _each(r"\b(?P<what>class|struct|union|enum(?:\s+class|\s+struct)?|namespace)\s+(?:alignas\([^)]*\)\s*)?(?P<name>[\w:]+)(?P<rest>[^;{}()=]*)\{", s.code, "class", "struct", "union", "enum", "namespace"):
        kind = {"class": "class", "struct": "class", "union": "class", "namespace": "module"}.get(m["what"], "enum")
        boxes[m.end() - 1] = (m["what"].split()[0], m["name"])
        stop = s.braces.pairs.get(m.end() - 1, len(s.code) - 1) + 1
        s.add(m, m["name"].split("::")[-1], kind, stop, True, m["name"])
    for m in _each(r'\b(?:extern\s*"\s*"|namespace)\s*\{', s.code, "extern", "namespace"):
        boxes[m.end() - 1] = ("namespace", "")
    for m in _each(r"\busing\s+(?P<name>\w+)\s*=", s.code, "using"):
        s.add(m, m["name"], "type", s.body_end(m.end()), True, m["name"])

    def exported(at: int, box: int, head: str) -> bool:
        if "static" in head and re.search(r"\bstatic\b", head) and (box < 0 or boxes.get(box, ("",))[0] == "namespace"):
            return False
        if box in boxes and boxes[box][0] in ("class", "struct", "union"):
            section = re.findall(r"\b(public|private|protected)\s*:(?!:)", s.code[box:at])
            return (section[-1] if section else "private" if boxes[box][0] == "class" else "public") == "public"
        return True

    for m in _each(r"(?:^|(?<=[;{}:\n]))\s*(?P<head>(?:(?:static|inline|extern|const|unsigned|signed|long|short|struct)\s+)*[\w:]+(?:<[^;{}()]*>)?[\s*&]*)\(\s*\*+\s*(?P<name>\w+)\s*(?=\()", s.code, "*"):
        inner, box = closing(s.code, m.end()), s.braces.enclosing(m.start("name"))
        outer = re.match(r"\s*\)\s*\(", s.code[inner + 1 :])  # a function that returns a pointer to a function
        if outer and (box < 0 or box in boxes) and m["head"].split()[-1] not in ("return", "else", "case"):
            last = closing(s.code, inner + outer.end())
            if re.match(r"\s*[{;]", s.code[last + 1 :]):
                s.add(m, m["name"], "function", s.body_end(last + 1), exported(m.start(), box, m["head"]), m["name"] + s.raw[m.end() : inner + 1])
    decl = r"(?:^|(?<=[;{}:\n]))\s*(?P<head>(?:template\s*<[^;{}]*?>\s*)?(?:(?:virtual|static|inline|constexpr|explicit|extern|friend|const|unsigned|signed|long|short|struct|typename|\[\[\w+\]\])\s+)*(?:[\w:]+(?:<[^;{}()]*>)?[\s*&]+(?:const\s*)?[*&\s]*)?)(?P<name>(?:\w+::)*operator(?:\s*\(\s*\)|\s*[^\s\w(]+|\s+(?:const\s+)?[\w:]+(?:<[^;{}()]*>)?[\s*&]*)|(?:\w+::)*~?\w+)\s*(?=\()"
    for m in _each(decl, s.code, "("):
        close, box = closing(s.code, m.end()), s.braces.enclosing(m.start("name"))
        if re.search(r"(?:^|::)operator\b", m["name"]):  # operators have no name of their own
            continue
        after = re.match(r"\s*(?:(?:const|noexcept|override|final|volatile|&&?|->\s*[\w:<>*&\s]+|=\s*(?:0|default|delete)|:\s*[^;{]*)\s*)*[{;]", s.code[close + 1 :])
        parts = m["name"].split("::")
        own = boxes.get(box)
        in_code = box >= 0 and own is None
        special = own and parts[-1].lstrip("~") == own[1].split("::")[-1]
        if not after or in_code or parts[-1] in s.not_calls or not (m["head"].strip() or special or len(parts) > 1 and parts[-1].lstrip("~") == parts[-2]):
            continue
        member = own is not None and own[0] in ("class", "struct", "union")
        s.taken |= {m.end("name") - len(parts[-1]), m.end("name") - len(parts[-1].lstrip("~"))}
        for i in re.finditer(r"[:,]\s*(\w+)\s*\(", after[0]):  # members that a constructor sets aren't called
            s.taken.add(close + 1 + i.start(1))
        s.add(m, parts[-1], "method" if member or len(parts) > 1 else "function", s.body_end(close + 1), exported(m.start(), box, m["head"]), parts[-1] + s.raw[m.end() : close + 1], owner=tuple(("owner", p) for p in parts[:-1]))
    made = {(x.name, x.line) for x in s.symbols if x.kind in ("function", "method")}
    regions = [(-1, 0, len(s.code)), *[(box, box + 1, s.braces.pairs.get(box, len(s.code))) for box, (what, _) in boxes.items() if what != "enum"]]
    for box, first, last in regions:
        member = box in boxes and boxes[box][0] != "namespace"
        for a, b in declarators.statements(s.code, s.braces.pairs, first, last):
            for d in declarators.declared(s.code, a, b):
                if (d.name, s.lines.of(d.start)) in made or d.name in s.not_calls:
                    continue
                kind = "type" if d.typedef else ("method" if member else "function") if d.function else "field" if member else "variable"
                s.symbols.append(Symbol(d.name, kind, d.start, d.stop, s.lines.of(d.start), s.lines.of(max(d.start, d.stop - 1)), d.typedef or exported(d.start, box, d.head), d.name))
                s.taken.add(d.at)
    s.find_calls(r"->|\.|::")
    return Parsed(s.symbols, s.imports, s.calls, s.issues())
