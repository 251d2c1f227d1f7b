"""Bounded presentation of results: budgets, graphs and text. Works on rows that Spark has already cut to a fixed number."""

from __future__ import annotations

XRAY = {"nodes": 32, "edges": 48, "paths": 12, "changed": 12, "call_nodes": 24, "call_edges": 32, "imports": 8, "tests": 8, "unmapped": 8, "chars": 900, "bytes": 96_000}
REVIEW = {"changes": 24, "relations": 40, "tests": 20, "warnings": 12}
CHANGE_CHARS, XRAY_CHARS, XRAY_CUT = 12_000, 24_000, 23_800


def units(text: str) -> int:
    """Length in UTF-16 units, in which budgets are counted."""
    return len(text.encode("utf-16-le")) // 2


def cut_text(text: str, most: int) -> str:
    return text if units(text) <= most else text.encode("utf-16-le")[: 2 * most].decode("utf-16-le", "ignore")


def fit_lines(head: list[str], rows: list[str], tail: list[str], most: int) -> str:
    """All of head and tail and as many rows as fit, found by bisection, with a note of how many are left out."""

    def text(n: int) -> str:
        note = [f"... {len(rows) - n} more rows"] if n < len(rows) else []
        return "\n".join([*head, *rows[:n], *note, *tail])

    low, high = 0, len(rows)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if units(text(mid)) <= most else (low, mid - 1)
    return cut_text(text(low), most)


def render_map(rows: list[dict], most: int) -> str:
    lines: list[str] = []
    for r in rows:
        part = [f"{r['path']} ({r['score']:.2f})", *(f"  {s['kind']} {s['name']}:{s['line']}" for s in r["symbols"] or [])]
        if units("\n".join([*lines, *part])) > most:
            return "\n".join([*lines, "... truncated"])
        lines += part
    return "\n".join(lines)


def render_change(result: dict, most: int = CHANGE_CHARS) -> str:
    rows = [f"changed {c['change']} {c['kind']} {c['name']} {c['file']}:{c['line']}" for c in result["changed"]]
    rows += [f"caller {c['name']} {c['file']}:{c['line']} [{c['resolution']}]" for c in result["callers"]]
    rows += [f"impact {c['name']} {c['file']}:{c['line']} depth {c['depth']} [{c['resolution']}]" for c in result["impact"]]
    rows += [f"path {p['entry']} -> {p['changed']} ({p['depth']} hops) [{p['resolution']}]" for p in result["paths"]]
    rows += [f"imported by {d['file']} (of {d['changed_file']})" for d in result["dependents"]]
    rows += [f"test {t['file']}: {t['reason']} [{t['resolution']}]" for t in result["tests"]]
    rows += [f"outside symbols {u['file']}:{u['start']}-{u['stop']}" for u in result["unmapped"]]
    head = [f"{len(result['changed'])} changed symbols in {len(result['files'])} files"]
    tail = [f"truncated: {', '.join(k for k, v in result['truncated'].items() if v)}"] if any(result["truncated"].values()) else []
    return fit_lines(head, rows, tail + result["gaps"], most)


def xray(result: dict) -> dict:
    """A graph of bounded size for display: changed symbols, calls, imports and tests, with totals of what is left out."""
    nodes: dict[str, dict] = {}
    edges: list[dict] = []

    def node(key: str, kind: str, label: str) -> bool:
        if key in nodes:
            return True
        if len(nodes) >= XRAY["nodes"]:
            return False
        nodes[key] = {"id": key, "kind": kind, "label": cut_text(label, XRAY["chars"])}
        return True

    def edge(a: str, b: str, kind: str, label: str) -> None:
        if a in nodes and b in nodes and len(edges) < XRAY["edges"]:
            edges.append({"from": a, "to": b, "kind": kind, "label": label})

    for c in result["changed"][: XRAY["changed"]]:
        node(c["id"], "changed", f"{c['kind']} {c['name']}")
    for c in [*result["callers"], *result["impact"]][: XRAY["call_nodes"]]:
        if node(c["id"], "caller" if c["depth"] == 1 else "impact", c["name"]) and sum(e["kind"] == "calls" for e in edges) < XRAY["call_edges"]:
            edge(c["id"], c["via_target"], "calls", c["resolution"])
    for d in result["dependents"][: XRAY["imports"]]:
        if node(f"file:{d['file']}", "file", d["file"]) and node(f"file:{d['changed_file']}", "file", d["changed_file"]):
            edge(f"file:{d['file']}", f"file:{d['changed_file']}", "imports", "import-scoped")
    for t in result["tests"][: XRAY["tests"]]:
        node(f"test:{t['file']}", "test", t["file"])
    totals = {k: len(result[k]) for k in ("changed", "callers", "impact", "paths", "dependents", "tests", "unmapped")}
    return {"nodes": list(nodes.values()), "edges": edges, "paths": result["paths"][: XRAY["paths"]], "unmapped": result["unmapped"][: XRAY["unmapped"]], "gaps": result["gaps"][:20], "totals": totals}


def check_xray(graph: dict) -> dict:
    """The graph if it keeps its promises, else an error: unique ids, edges between nodes, bounds."""
    ids = [n["id"] for n in graph["nodes"]]
    if len(ids) != len(set(ids)) or len(ids) > XRAY["nodes"] or len(graph["edges"]) > XRAY["edges"]:
        raise ValueError("graph out of bounds")
    if any(e["from"] not in ids or e["to"] not in ids for e in graph["edges"]):
        raise ValueError("edge without node")
    return graph


def review(result: dict, budget: int) -> dict:
    """A brief within a budget: one test and one relation are reserved, then changes, relations and tests take turns."""
    pools = {
        "changes": [f"{c['change']} {c['kind']} {c['name']} ({c['file']}:{c['line']})" for c in result["changed"]][: REVIEW["changes"]],
        "relations": [f"{c['name']} reaches it at depth {c['depth']} [{c['resolution']}]" for c in [*result["callers"], *result["impact"]]][: REVIEW["relations"]],
        "tests": [f"{t['file']} ({t['reason']})" for t in result["tests"]][: REVIEW["tests"]],
        "warnings": sorted(set(result["gaps"]))[: REVIEW["warnings"]],
    }
    brief: dict[str, list[str]] = {k: [] for k in pools}
    text = lambda: "\n".join(f"{k}:\n" + "\n".join(f"- {x}" for x in v) for k, v in brief.items() if v)

    def take(kind: str) -> bool:
        if len(brief[kind]) >= len(pools[kind]):
            return False
        brief[kind].append(pools[kind][len(brief[kind])])
        if units(text()) <= budget:
            return True
        brief[kind].pop()
        return False

    for kind in ("tests", "relations", "changes"):
        take(kind)
    open_ = ["changes", "relations", "tests", "warnings"]
    while open_:
        open_ = [k for k in open_ if take(k)]
    return {"text": text(), "brief": brief, "left_out": {k: len(pools[k]) - len(v) for k, v in brief.items()}}


class Covered:
    """The lines of each file that a pack shows already, as disjoint ranges in order."""

    def __init__(self) -> None:
        self.of: dict[str, list[tuple[int, int]]] = {}

    def left(self, file: str, start: int, stop: int) -> list[tuple[int, int]]:
        """The parts of a range that aren't shown yet."""
        out, at = [], start
        for a, b in self.of.get(file, []):
            if b < at:
                continue
            if a > stop:
                break
            if a > at:
                out.append((at, a - 1))
            at = max(at, b + 1)
        return [*out, (at, stop)] if at <= stop else out

    def add(self, file: str, start: int, stop: int) -> None:
        merged: list[tuple[int, int]] = []
        for a, b in sorted([*self.of.get(file, []), (start, stop)]):
            if merged and a <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        self.of[file] = merged


def _cut_form(form: dict, covered: Covered) -> tuple[str, list[tuple[int, int]]] | None:
    """An excerpt's text without the lines that are shown already, and its ranges; None if nothing of it is left.

    form: ``head, file, start, lines``. Parts that don't follow each other are told apart by their line numbers.
    """
    start = form["start"]
    parts = covered.left(form["file"], start, start + len(form["lines"]) - 1)
    if not parts:
        return None
    whole = parts == [(start, start + len(form["lines"]) - 1)]
    out = [form["head"]] if form["head"] else []
    for a, b in parts:
        out += ([] if whole else [f"@@ {a}-{b}"]) + form["lines"][a - start : b - start + 1]
    return "\n".join(out), parts


def select_pack(candidates: list[dict], budget: int, max_files: int | None = None) -> list[dict]:
    """Items by priority, stable on ties, as many as fit; an item's shorter forms are tried before it is left out.

    candidates: ``priority, key, forms``, best first; one item for each key. A form is a text, or an excerpt (``head, file,
    start, lines``), which is cut by the lines that the pack shows already before its cost is told. An excerpt of which
    nothing is left gives way to the next form. Items of more than max_files files aren't taken.
    """
    chosen: list[dict] = []
    used, keys, covered = 0, set(), Covered()
    files: set[str] = set()
    for c in sorted(candidates, key=lambda c: -c["priority"]):
        file = c.get("file")
        if c["key"] in keys or (max_files is not None and file is not None and file not in files and len(files) >= max_files):
            continue
        for form in [*([c["text"]] if "text" in c else []), *c.get("forms", [])]:
            text, parts = (form, []) if isinstance(form, str) else _cut_form(form, covered) or (None, [])
            if text is None:
                continue
            cost = units(text) + 1
            if used + cost <= budget:
                chosen.append({"key": c["key"], "priority": c["priority"], "text": text})
                used += cost
                keys.add(c["key"])
                files |= {file} if file is not None else set()
                for a, b in parts:
                    covered.add(form["file"], a, b)
                break
    return chosen


def render_pack(items: list[dict], budget: int) -> str:
    return cut_text("\n".join(i["text"] for i in items), budget)
