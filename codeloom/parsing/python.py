"""Python source by the standard syntax tree."""

from __future__ import annotations

import ast
import re

from codeloom.parsing.model import Call, Parsed, Symbol, binding, imported


def relative(level: int, module: str | None) -> str:
    path = (module or "").replace(".", "/")
    return path if level == 0 else ("./" if level == 1 else "../" * (level - 1)) + path


def parse(code: str) -> Parsed:
    issues: list[tuple[str, int]] = []
    lines = code.split("\n")
    tree = None
    for _ in range(50):  # a line that doesn't parse is left out and the rest is read
        try:
            tree = ast.parse("\n".join(lines))
            break
        except (SyntaxError, ValueError) as e:
            at = min(max(1, getattr(e, "lineno", 1) or 1), len(lines))
            issues.append(("error", at))
            indent = re.match(r"\s*", lines[at - 1])[0]
            new = indent + "pass"
            if lines[at - 1].strip() == "pass":  # a kept place doesn't parse either: leave the line before or it out
                lines[at - 1] = ""
            else:
                lines[at - 1] = new
        except RecursionError:
            issues.append(("error", 1))
            break
    if tree is None:
        return Parsed([], [], [], issues or [("error", 1)])
    text = "\n".join(lines)
    offsets = [0]
    for x in lines:
        offsets.append(offsets[-1] + len(x.encode()) + 1)
    at = lambda n: offsets[n.lineno - 1] + n.col_offset
    end = lambda n: offsets[n.end_lineno - 1] + n.end_col_offset
    symbols: list[Symbol] = []
    imports: list[dict] = []
    calls: list[Call] = []

    def visit(node: ast.AST, parent: ast.AST) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            is_class = isinstance(node, ast.ClassDef)
            kind = "class" if is_class else "method" if isinstance(parent, ast.ClassDef) else "function"
            head = f"class {node.name}" if is_class else f"{node.name}({ast.unparse(node.args)})"
            symbols.append(Symbol(node.name, kind, at(node), end(node), node.lineno, node.end_lineno or node.lineno, isinstance(parent, ast.Module), head, scope_kind=kind, decorators=["@" + ast.unparse(d) for d in node.decorator_list]))
        elif isinstance(node, ast.Import):
            for a in node.names:
                imports.append(imported(a.name.replace(".", "/"), node.lineno, "import", [binding(None, a.asname or a.name.split(".")[0], "package")]))
        elif isinstance(node, ast.ImportFrom):
            bs = [binding("*", "*", "glob") if a.name == "*" else binding(a.name, a.asname or a.name, "named") for a in node.names]
            imports.append(imported(relative(node.level, node.module), node.lineno, "import", bs))
        elif isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                calls.append(Call(f.id, at(f), f.lineno))
            elif isinstance(f, ast.Attribute):
                calls.append(Call(f.attr, at(f), f.end_lineno or f.lineno, ast.get_source_segment(text, f.value) or ast.unparse(f.value)))
        for child in ast.iter_child_nodes(node):
            inner = node if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Module)) else parent
            visit(child, inner)

    try:
        visit(tree, tree)
    except RecursionError:
        issues.append(("error", 1))
    return Parsed(symbols, imports, calls, issues)
