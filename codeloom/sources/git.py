"""What git knows about a working tree; commands take argument lists, never a shell."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

from codeloom.operators import diff


def find_repo_root(start: str, levels: int = 12) -> str | None:
    """The nearest folder at or above start that holds .git."""
    at = os.path.abspath(start)
    for _ in range(levels):
        if os.path.exists(os.path.join(at, ".git")):
            return at
        up = os.path.dirname(at)
        if up == at:
            return None
        at = up
    return None


def safe_ref(ref: str) -> str:
    if not ref or ref.startswith("-") or re.search(r"[\s\x00-\x1f~^:?*\[\\]|\.\.", ref.replace("~", "", 1).replace("^", "", 1)):
        raise ValueError(f"unsafe ref: {ref!r}")
    return ref


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, check=True, text=True, errors="replace").stdout


def resolve_ref(root: str, ref: str) -> str:
    return _git(root, "rev-parse", "--verify", f"{safe_ref(ref)}^{{commit}}").strip()


def file_at(root: str, ref: str, path: str) -> str | None:
    try:
        return _git(root, "show", f"{safe_ref(ref)}:{path}")
    except subprocess.CalledProcessError:
        return None


def working_tree_changes(spark: SparkSession, root: str, ref: str = "HEAD") -> DataFrame:
    """File changes of a working tree against a ref, with untracked files as added and equal contents as renames."""
    text = _git(root, "diff", "--find-renames", "--unified=0", "--no-color", "--no-ext-diff", safe_ref(ref))
    rows = list(diff.parse(text))
    new = [p for p in _git(root, "ls-files", "--others", "--exclude-standard", "-z").split("\0") if p]
    gone = [r[0] for r in rows if r[2] == "deleted"]
    content: dict[str, str] = {}
    for p in new:
        try:
            with open(os.path.join(root, p), encoding="utf-8", errors="replace") as f:
                content[p] = f.read()
        except OSError:
            continue
    d = spark.createDataFrame([(p, file_at(root, ref, p)) for p in gone], "path string, content string")
    a = spark.createDataFrame([(p, c) for p, c in content.items()], "path string, content string")
    pairs = [tuple(r) for r in diff.rename_pairs(d, a).collect()] if gone and content else []
    moved = {o for o, _ in pairs} | {n for _, n in pairs}
    names = ("old_start", "old_lines", "new_start", "new_lines")
    out = [(o, n, s, [dict(zip(names, h, strict=True)) for h in hunks]) for o, n, s, hunks in rows if o not in moved]
    out += [(o, n, "renamed", []) for o, n in pairs]
    out += [(None, p, "added", [dict(zip(names, (0, 0, 1, c.count("\n") + (not c.endswith("\n"))), strict=True))]) for p, c in content.items() if p not in moved]
    return spark.createDataFrame(out, diff.FILE_CHANGE)
