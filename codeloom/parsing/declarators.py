"""Declarators of C and C++: the names that a declaration declares, by descent through pointers, arrays, functions and brackets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from codeloom.parsing.lexer import closing

_TOKEN = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*(?:\s*::\s*~?[A-Za-z_]\w*)*)|(?P<number>\d\w*)|(?P<op>\[\[|&&|.))", re.S)
_WORD = re.compile(r"[A-Za-z_]")
# Fixed values of the languages.
_NO_DECLARATION = set("return using class struct union enum namespace goto case delete throw else public private protected template friend extern static_assert if for while switch do operator asm default break continue".split())
_QUALIFIERS = set("const volatile restrict noexcept override final mutable __restrict".split())
_SPECIFIERS = set("static extern inline constexpr virtual explicit typedef register thread_local unsigned signed long short const volatile struct class union enum typename mutable".split())


@dataclass
class Declared:
    name: str
    at: int  # of the name
    start: int
    stop: int
    head: str  # the specifiers
    typedef: bool
    function: bool  # its chain has a function: a pointer to one, say


def statements(code: str, pairs: dict[int, int], start: int, end: int) -> Iterator[tuple[int, int]]:
    """The declarations of a region of blanked code, from their first character to their semicolon; function bodies end one."""
    a = i = start
    while i < end:
        c = code[i]
        if c == ";":
            yield a, i
            a = i + 1
        elif c == "{":
            head = code[a:i]
            typed = re.search(r"\b(?:struct|class|union|enum)\b[^()=;]*$", head) and not re.search(r"\b(?:namespace|template)\b", head)
            flat = head
            while flat != (flat := re.sub(r"\([^()]*\)|\[[^\[\]]*\]", " ", flat)):
                pass
            value = "operator" not in flat and not re.search(r"\b(?:namespace|extern)\b", head) and ("=" in flat or "(" not in head and re.search(r"[\w\]>]\s*$", head))
            i = min(pairs.get(i, end), end)
            if not (typed or value):
                a = i + 1
        elif c == ":" and re.fullmatch(r"\s*(?:public|private|protected)\s*", code[a:i]):
            a = i + 1
        elif c in "([":
            i = max(i, closing(code, i, c + {"(": ")", "[": "]"}[c]))
        i += 1


def _tokens(code: str, a: int, b: int) -> list[tuple[str, int, int]]:
    """(text, start, end); brackets of every kind are one token each, with their content."""
    out = []
    i = a
    while i < b and (m := _TOKEN.match(code, i, b)):
        text, i = m[m.lastgroup], m.end()
        at = i - len(text)
        if text in ("(", "[", "{", "[["):
            close = closing(code, at, text[0] + {"(": ")", "[": "]", "{": "}"}[text[0]])
            i = min(b, close + 1)
            text = {"[[": "attribute"}.get(text, text)
        elif text == "<" and out and _WORD.match(out[-1][0]):
            depth = 0
            for k in range(at, b):
                depth += (code[k] == "<") - (code[k] == ">" and code[k - 1] != "-")
                if code[k] in ";{}=" or depth == 0:
                    break
            if depth == 0:
                i = k + 1
                text = "<>"
        out.append((text, at, i))
    return out


def _inner(code: str, a: int, b: int) -> tuple[str, int] | None:
    """The name within a bracketed declarator, as in ``(*cb)`` or ``(*(*f)(int))``."""
    toks = _tokens(code, a + 1, b - 1)
    if not toks or (toks[0][0] not in ("*", "&", "&&", "(") and "::" not in code[a:b]):
        return None
    for text, at, end in toks:
        if text == "(":
            return _inner(code, at, end)
        if _WORD.match(text) and text not in _QUALIFIERS:
            return text.split("::")[-1].strip(), end - len(text.split("::")[-1].strip())
    return None


def declared(code: str, a: int, b: int) -> list[Declared]:
    """What the declaration between two positions declares as variables, fields or type names. Functions aren't among it."""
    toks = [t for t in _tokens(code, a, b) if t[0] != "attribute"]
    if not toks:
        return []
    start = toks[0][1]
    typedef = toks[0][0] == "typedef"
    words = [t[0] for t in toks]
    if words[0] in _NO_DECLARATION - {"struct", "union", "enum", "class", "extern"} or "operator" in words:
        return []
    k = 1 if typedef else 0
    typed = 0
    while k < len(toks):  # the type: names, template arguments, and the body of a struct
        text, nxt = words[k], words[k + 1] if k + 1 < len(toks) else ";"
        if text in ("struct", "class", "union", "enum"):
            k += 1
            while k < len(toks) and (words[k] in ("class", "struct", ":", "<>", ",") or _WORD.match(words[k]) and words[k] not in _SPECIFIERS and (typed == 0 or words[k - 1] in (":", ","))):
                typed += words[k] != ":"
                k += 1
                if k < len(toks) and words[k] == "{":
                    break
                if typed and (k >= len(toks) or words[k] not in (":", "<>", ",")):
                    break
            if k < len(toks) and words[k] == "{":
                k += 1
            typed = 1
            continue
        if text in _SPECIFIERS:
            typed += text in ("unsigned", "signed", "long", "short")
            k += 1
            continue
        if _WORD.match(text):
            if nxt == "<>":
                typed += 1
                k += 2
                continue
            if re.match(r"[A-Za-z_*&]", nxt) or (nxt == "(" and (k + 2 < len(toks) and words[k + 2] in ("(", "[") or typed == 0) and _inner(code, *toks[k + 1][1:])):
                typed += 1
                k += 1
                continue
        break
    if not typed:
        return []
    head = code[start : toks[k][1]] if k < len(toks) else ""
    out: list[Declared] = []
    begun = start
    while k < len(toks):
        while k < len(toks) and (words[k] in ("*", "&", "&&") or words[k] in _QUALIFIERS):
            k += 1
        if k >= len(toks):
            break
        found, bracketed = None, words[k] == "("
        if bracketed:
            found = _inner(code, *toks[k][1:])
        elif _WORD.match(words[k]):
            found = (words[k].split("::")[-1].strip(), toks[k][2] - len(words[k].split("::")[-1].strip()))
        if found is None:
            break
        k += 1
        function = bracketed and k < len(toks) and words[k] == "("
        if k < len(toks) and words[k] == "(" and not typedef and not out and not bracketed:
            return out  # a function, or a variable made by a constructor: told by their own rules
        while k < len(toks) and words[k] != ",":
            k += 1
        stop = toks[k][1] if k < len(toks) else b + 1
        out.append(Declared(*found, begun, stop, head, typedef, function))
        k += 1
        begun = toks[k][1] if k < len(toks) else b
    return out
