"""Layered ignore files, as regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    negated: bool
    folder_only: bool


def translate(glob: str) -> str:
    """An ignore pattern without its marks as a regular expression for a path relative to its file."""
    anchored = "/" in glob.rstrip("/")[:-1] or glob.startswith("/")
    glob = glob.strip("/") if not glob.startswith("/") else glob[1:].rstrip("/")
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.+", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            body = "^" + body[1:] if body[0] in "!^" else body
            out, i = out + "[" + body.replace("\\", "\\\\") + "]", end + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return ("" if anchored else "(?:.*/)?") + out


def compile_rules(text: str) -> list[Rule]:
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        if line.strip("/"):
            rules.append(Rule(re.compile(translate(line) + r"\Z"), negated, line.endswith("/")))
    return rules


def verdict(layers: list[tuple[str, list[Rule]]], path: str, is_folder: bool) -> bool:
    """Whether a path is ignored; the last layer with a matching rule decides, within it the last rule."""
    for base, rules in reversed(layers):
        rel = path[len(base) + 1 :] if base else path
        for rule in reversed(rules):
            if (is_folder or not rule.folder_only) and rule.pattern.match(rel):
                return not rule.negated
    return False


def ignored(ignore_files: dict[str, str], path: str) -> bool:
    """Whether a file is ignored given ignore files by folder ('' is the root): an ignored parent is final."""
    layers = {base: compile_rules(text) for base, text in ignore_files.items()}
    parts = path.split("/")
    for k in range(1, len(parts) + 1):
        here = "/".join(parts[:k])
        folders = ["/".join(parts[:j]) for j in range(k)]
        if verdict([(b, layers[b]) for b in folders if b in layers], here, k < len(parts)):
            return True
    return False
