"""What every language kernel gives: symbols with scopes and ids, imports, calls, and a parse state."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import quote

CALLABLE = ("function", "method")


_PLAIN = re.compile(r"[A-Za-z0-9_.~-]*")


def encode(text: str) -> str:
    return text if _PLAIN.fullmatch(text) else quote(text, safe="-_.")


def flat(text: str, cap: int = 80) -> str:
    """One line of text, cut to cap UTF-16 units."""
    text = re.sub(r"\s+", " ", text).strip()
    if len(text) <= cap // 2:
        return text
    wide = text.encode("utf-16-le")
    return text if len(wide) // 2 <= cap else wide[: 2 * (cap - 3)].decode("utf-16-le", "ignore") + "..."


@dataclass
class Symbol:
    name: str
    kind: str
    start: int
    stop: int
    line: int
    end_line: int
    exported: bool = False
    signature: str = ""
    owner: tuple[tuple[str, str], ...] = ()  # owners that aren't declared around it: a receiver, an impl, a qualifier
    scope_kind: str | None = None
    decorators: list[str] = field(default_factory=list)
    id: str = ""
    scope: list[dict] = field(default_factory=list)
    ordinal: int = 1


@dataclass
class Call:
    name: str
    start: int
    line: int
    qualifier: str | None = None
    context: str | None = None


@dataclass
class Parsed:
    symbols: list[Symbol]
    imports: list[dict]
    calls: list[Call]
    issues: list[tuple[str, int]]  # (kind, line)


#: Kinds that a declared owner of members outside it can have.
OWNERS = ("class", "interface", "trait", "module", "namespace", "impl")


def scope_kind(lang: str, kind: str) -> str:
    """A declaration's kind in the scopes and ids of what stands within it."""
    if kind == "interface":
        return "trait" if lang == "rust" else "interface"
    if kind == "module":
        return "namespace" if lang in ("c", "cpp") else "module"
    return kind if kind in ("class", "function", "method") else "owner"


def identify(file: str, symbols: list[Symbol], lang: str = "") -> None:
    """Scopes, ordinals and ids: an owner is the innermost declaration around a symbol, then the owners that it names.

    A named owner (a receiver, an impl, a qualifier) is the declaration of that name in the same scope, of its kind or, for
    the kind ``owner``, of any that has members; where there is none, it's an owner of its own. Ordinals count equal (kind,
    name) within one scope in source order, so they don't change with blank lines.
    """
    symbols.sort(key=lambda s: (s.start, -s.stop))
    around: list[Symbol | None] = []
    stack: list[Symbol] = []
    for s in symbols:
        while stack and not (stack[-1].start <= s.start and s.stop <= stack[-1].stop):
            stack.pop()
        around.append(stack[-1] if stack else None)
        stack.append(s)
    declared: dict[tuple, list[tuple[str, int]]] = {}
    early: dict[int, list[dict]] = {}  # scopes within declarations that name no owner: what names one may stand before it
    for s, outer in zip(symbols, around, strict=True):
        if not s.owner and (outer is None or id(outer) in early):
            scope, kind = early[id(outer)] if outer else [], scope_kind(lang, s.kind)
            same = declared.setdefault((repr(scope), s.name), [])
            same.append((kind, 1 + sum(k == kind for k, _ in same)))
            early[id(s)] = [*scope, {"kind": kind, "name": s.name, "ordinal": same[-1][1]}]
    seen: dict[tuple, int] = {}
    prefix = f"sym:v1:{encode(file)}#"
    for s, outer in zip(symbols, around, strict=True):
        scope = [*outer.scope, {"kind": outer.scope_kind, "name": outer.name, "ordinal": outer.ordinal}] if outer else []
        for kind, name in s.owner:
            known = [x for x in declared.get((repr(scope), name), ()) if x[0] in OWNERS and kind in ("owner", x[0])]
            own, ordinal = known[0] if known else (kind, 1)
            scope = [*scope, {"kind": own, "name": name, "ordinal": ordinal}]
        s.scope, s.scope_kind = scope, scope_kind(lang, s.kind)
        text = repr(scope) if scope else "[]"
        key = (text, s.scope_kind, s.name)
        s.ordinal = seen[key] = seen.get(key, 0) + 1
        if id(s) not in early:
            declared.setdefault((text, s.name), []).append((s.scope_kind, s.ordinal))
        s.id = prefix + "/".join(f"{p['kind']}:{encode(p['name'])}@{p['ordinal']}" for p in [*scope, {"kind": s.scope_kind, "name": s.name, "ordinal": s.ordinal}])


def rows(file: str, lang: str, parsed: Parsed, seq: int = 0) -> dict:
    """Rows of the index tables for one file."""
    identify(file, parsed.symbols, lang)
    symbols = []
    for k, s in enumerate(sorted(parsed.symbols, key=lambda s: (s.line, s.start))):
        own = s.id.split("#", 1)[1]
        symbols.append({
            "id": s.id, "name": s.name, "kind": s.kind, "file": file, "line": s.line, "end_line": s.end_line, "exported": s.exported, "signature": flat(s.signature), "scope": s.scope, "ordinal": s.ordinal,
            "decorators": s.decorators, "container_path": own.rsplit("/", 1)[0] if "/" in own else "", "self_path": own, "seq": k,
        })
    calls, seen = [], set()
    for c in sorted(parsed.calls, key=lambda c: (c.line, c.name, c.start)):
        around = [s for s in parsed.symbols if s.start <= c.start < s.stop]
        inner = max(around, key=lambda s: (s.start, -s.stop), default=None)
        named = max((s for s in around if s.kind in CALLABLE or s.kind == "variable"), key=lambda s: (s.start, -s.stop), default=None)
        key = (named.name if named else "", c.name, c.line)
        if key not in seen:
            seen.add(key)
            calls.append({"file": file, "seq": len(calls), "name": c.name, "line": c.line, "from_name": key[0], "from_id": inner.id if inner else None, "qualifier": c.qualifier, "context": c.context})
    imports = [{"file": file, "seq": k, **i} for k, i in enumerate(parsed.imports)]
    issues = sorted(parsed.issues, key=lambda x: x[1])
    status = "parsed" if not issues else "partial" if symbols or calls or imports else "failed"
    diagnostic = {
        "status": status, "error_count": sum(k == "error" for k, _ in issues), "missing_count": sum(k == "missing" for k, _ in issues), "issues": [{"kind": k, "line": n} for k, n in issues[:3]],
        "reason": "nothing could be read" if status == "failed" else None,
    }
    return {"symbols": symbols, "imports": imports, "calls": calls, "diagnostic": diagnostic}


def binding(imported: str | None, local: str, kind: str) -> dict:
    return {"imported": imported, "local": local, "kind": kind}


def imported(specifier: str, line: int, kind: str = "import", bindings: list[dict] | None = None) -> dict:
    return {"specifier": specifier, "line": line, "kind": kind, "bindings": bindings or []}
