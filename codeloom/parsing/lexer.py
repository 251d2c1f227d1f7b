"""A tokenizer for brace languages: comments and strings are blanked, brackets are paired.

``scan`` gives the code with the same length and line breaks in which comments, strings, character and regular expression
literals are spaces, so declarations can be found by pattern without being fooled, and ``Braces`` pairs the brackets.
"""

from __future__ import annotations

import bisect
import re

_REGEX_BEFORE = re.compile(r"(?:^|[=(,:;!&|?{}\[+\-*%<>~^]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do))\s*$")


# What a comment or a literal begins with; in Rust also a raw string.
_OPENS, _OPENS_RUST = re.compile(r"[\"'`/]"), re.compile(r"[\"'`/]|b?r#*\"")
_RAW = re.compile(r'b?r(#*)"')
_CHARACTER = re.compile(r"'(?:\\(?:u\{[0-9A-Fa-f]+\}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|.)|[^'\\\n])'")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_NO_BREAK = re.compile(r"[^\n]")
_BRACE = re.compile(r"[{}]")
_BRACKETS = {pair: re.compile(f"[{re.escape(pair)}]") for pair in ("()", "[]", "{}")}


def scan(code: str, lang: str) -> str:
    """Code with comments and literals blanked (quotes stay, so call arguments keep their shape)."""
    out = list(code)
    i, n = 0, len(code)
    js = lang in ("typescript", "javascript", "arkts")
    opens = _OPENS_RUST if lang == "rust" else _OPENS

    def blank(a: int, b: int) -> None:
        out[a:b] = _NO_BREAK.sub(" ", code[a:b])

    while at := opens.search(code, i):
        i = at.start()
        c, two = code[i], code[i : i + 2]
        if two == "//":
            j = code.find("\n", i)
            j = n if j < 0 else j
            blank(i, j)
            i = j
        elif two == "/*":
            depth, j = 1, i + 2
            while j < n and depth:
                if code.startswith("*/", j):
                    depth, j = depth - 1, j + 2
                elif lang == "rust" and code.startswith("/*", j):
                    depth, j = depth + 1, j + 2
                else:
                    j += 1
            blank(i, j)
            i = j
        elif lang == "rust" and (m := _RAW.match(code, i)) and not re.match(r"\w", code[i - 1 : i] or " "):
            end = code.find('"' + m[1], m.end())
            j = n if end < 0 else end + 1 + len(m[1])
            blank(i, j)
            i = j
        elif c == '"' and lang == "java" and code.startswith('"""', i):
            end = code.find('"""', i + 3)
            j = n if end < 0 else end + 3
            blank(i + 1, j - 1)
            i = j
        elif c == "`" and (js or lang == "go"):
            j = _template(code, i) if js else (code.find("`", i + 1) + 1 or n)
            blank(i + 1, j - 1)
            i = j
        elif c == '"' or (c == "'" and lang not in ("rust", "go", "java", "c", "cpp")):
            j = i + 1
            while j < n and code[j] != c and (code[j] != "\n" or lang == "rust"):
                j += 2 if code[j] == "\\" else 1
            blank(i + 1, j)
            i = j + 1
        elif c == "'" and (m := _CHARACTER.match(code, i)):
            blank(i + 1, m.end() - 1)
            i = m.end()
        elif c == "/" and js and _REGEX_BEFORE.search(code[max(0, i - 20) : i]) and (m := _REGEX.match(code, i)):
            blank(i + 1, m.end())
            i = m.end()
        else:
            i += 1
    return "".join(out)


def _template(code: str, i: int) -> int:
    """End of a template literal; its ${...} parts are skipped with it."""
    j, n, depth = i + 1, len(code), 0
    while j < n:
        if code[j] == "\\":
            j += 2
            continue
        if depth == 0 and code[j] == "`":
            return j + 1
        if code.startswith("${", j):
            depth += 1
            j += 2
            continue
        if depth and code[j] == "{":
            depth += 1
        elif depth and code[j] == "}":
            depth -= 1
        elif depth and code[j] == "`":
            j = _template(code, j)
            continue
        j += 1
    return n


class Braces:
    """Pairs of {} in blanked code, and which pair encloses a position."""

    def __init__(self, code: str):
        self.pairs: dict[int, int] = {}
        self.unmatched = 0
        stack: list[int] = []
        for m in _BRACE.finditer(code):
            if m[0] == "{":
                stack.append(m.start())
            elif stack:
                self.pairs[stack.pop()] = m.start()
            else:
                self.unmatched += 1
        self.unmatched += len(stack)
        self.open_left = stack
        for i in stack:
            self.pairs[i] = len(code)
        self.starts = sorted(self.pairs)
        self.parent: dict[int, int] = {}
        path: list[int] = []
        for s in self.starts:
            while path and self.pairs[path[-1]] < s:
                path.pop()
            self.parent[s] = path[-1] if path else -1
            path.append(s)

    def enclosing(self, at: int) -> int:
        """Start of the innermost pair around a position, or -1."""
        k = bisect.bisect_left(self.starts, at) - 1
        s = self.starts[k] if k >= 0 else -1
        while s >= 0 and self.pairs[s] < at:
            s = self.parent[s]
        return s


def closing(code: str, at: int, pair: str = "()") -> int:
    """Position of the bracket that closes the one at a position in blanked code; the end if there is none."""
    depth = 0
    for m in _BRACKETS[pair].finditer(code, at):
        if m[0] == pair[0]:
            depth += 1
        else:
            depth -= 1
            if depth == 0:
                return m.start()
    return len(code) - 1


class Lines:
    """Line numbers (1-based) of positions."""

    def __init__(self, code: str):
        self.breaks = [m.start() for m in re.finditer("\n", code)]

    def of(self, at: int) -> int:
        return bisect.bisect_left(self.breaks, at) + 1
