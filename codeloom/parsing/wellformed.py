"""Is a script text well formed, and where not: a recursive descent over tokens that recovers from errors.

``check`` gives the issues of a TypeScript, JavaScript or ArkTS text, ("error", line) where something stands that can't and
("missing", line) where something has to stand that doesn't, and its function declarations, members of classes and
methods of object literals. On an error the parser goes on behind the statement or member that it's in (panic mode), so one error isn't reported again and again.
Types are read loosely. Texts with markup elements aren't checked.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from codeloom.parsing.lexer import _template

_TOKEN = re.compile(
    r"(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<open>/\*)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)"
    r"|(?P<name>[#@]?(?:[^\W\d]|[$\\])(?:\w|[$‌‍])*)|(?P<punct>\.\.\.|=>|===|!==|==|!=|<=|&&=|\|\|=|\?\?=|\*\*=|<<=|\*\*|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@])",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
_MARKUP = re.compile(r"</[A-Za-z>]|/>\s*[;)\n,}<]")
# Fixed values of the languages.
_BEFORE_REGEX = set("return typeof case in of delete void throw new else do instanceof yield await".split())
_PREFIX = set("! ~ + - ++ -- typeof void delete await yield".split())
_BINARY = set("+ - * / % ** & | ^ && || ?? == != === !== < > <= << in instanceof = += -= *= /= %= **= &= |= ^= <<= &&= ||= ??= ,".split())
_MODIFIERS = set("public private protected static readonly override abstract async get set accessor declare export default".split())
_TYPE_PREFIX = set("keyof readonly unique infer typeof asserts new abstract".split())
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_STATEMENTS = set("import export function class interface enum const let var if for while do switch try return throw break continue namespace struct".split())


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    line: int
    fresh: bool  # first of its line


@dataclass
class Found:
    """A declaration; positions in the text. head ends behind the parameters."""

    kind: str
    name: str
    start: int
    name_at: int
    head_end: int
    stop: int
    exported: bool
    decorators: tuple[tuple[int, int], ...] = ()


class _Panic(Exception):
    pass


def tokens(code: str) -> tuple[list[Token], list[tuple[str, int]]]:
    out: list[Token] = []
    issues: list[tuple[str, int]] = []
    i, line, fresh = 0, 1, True
    while i < len(code):
        if code[i] == "`":
            end = _template(code, i)
            kind, text = "string", code[i:end]
            if end == len(code) and (len(text) < 2 or text[-1] != "`"):
                issues.append(("missing", line))
        elif code[i] == "/" and code[i + 1 : i + 2] not in ("/", "*") and (not out or (out[-1].kind == "punct" and out[-1].text not in (")", "]", "}")) or out[-1].text in _BEFORE_REGEX) and (m := _REGEX.match(code, i)):
            kind, text = "string", m[0]
        elif m := _TOKEN.match(code, i):
            kind, text = m.lastgroup, m[0]
            if kind == "open":
                issues.append(("missing", line))
                break
        else:
            issues.append(("error", line))
            kind, text = "space", code[i]
        if kind == "space":
            fresh = fresh or "\n" in text
        else:
            out.append(Token(kind, text, i, line, fresh))
            fresh = False
        if kind in ("space", "string"):  # the others don't hold line breaks
            line += text.count("\n")
        i += len(text)
    out.append(Token("end", "", len(code), line, True))
    return out, issues


class Parser:
    def __init__(self, code: str, lang: str):
        self.lang = lang
        self.tokens, self.issues = tokens(code)
        self.at_error = -1
        self.i = 0
        self.ternary = 0
        self.found: list[Found] = []
        self.exporting = False  # within an export statement, outside any block
        self.head_end = 0  # of the parameters read last
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for k, t in enumerate(self.tokens):
            if t.kind != "punct":
                continue
            if t.text in _PAIRS:
                stack.append(k)
            elif t.text in (")", "]", "}"):
                while stack and _PAIRS[self.tokens[stack[-1]].text] != t.text and any(_PAIRS[self.tokens[s].text] == t.text for s in stack):
                    stack.pop()
                if stack and _PAIRS[self.tokens[stack[-1]].text] == t.text:
                    self.close[stack.pop()] = k

    # -- tokens
    @property
    def t(self) -> Token:
        return self.tokens[self.i]

    def at(self, *texts: str) -> bool:
        t = self.tokens[self.i]
        return t.text in texts and t.kind in ("punct", "name")

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def take(self, *texts: str) -> bool:
        t = self.tokens[self.i]
        if t.text in texts and t.kind in ("punct", "name"):
            self.i += 1
            return True
        return False

    def issue(self, kind: str) -> None:
        if self.at_error != self.i:
            self.issues.append((kind, self.tokens[self.i - 1].line if kind == "missing" and self.i else self.t.line))
            self.at_error = self.i

    def need(self, text: str) -> None:
        if not self.take(text):
            self.issue("missing")
            raise _Panic

    def wrong(self) -> None:
        self.issue("missing" if self.t.kind == "end" else "error")
        raise _Panic

    def last_end(self) -> int:
        t = self.tokens[self.i - 1]
        return t.start + len(t.text)

    def recover(self, begun: int, stop: int) -> None:
        """Go on behind the statement or member that begins at a token, before stop at the latest."""
        self.i = max(self.i, begun)
        while self.i < stop and self.t.kind != "end":
            if self.at(";"):
                self.i += 1
                return
            if self.i > begun and self.t.fresh and (self.t.text in _STATEMENTS or self.at("}")):
                return
            if self.t.text in _PAIRS and self.t.kind == "punct" and self.i in self.close:
                self.i = self.close[self.i]
            self.i += 1

    # -- statements
    def program(self) -> None:
        while self.t.kind != "end":
            if self.at("}", ")", "]"):
                self.issue("error")
                self.i += 1
                continue
            self.guarded(self.statement, len(self.tokens) - 1)

    def guarded(self, what, stop: int) -> None:
        begun, exporting = self.i, self.exporting
        try:
            what()
        except _Panic:
            self.recover(begun, stop)
        self.exporting = exporting
        if self.i == begun:  # nothing that could be read
            self.issue("error")
            self.i += 1

    def block(self, what=None) -> None:
        opened, exporting = self.i, self.exporting
        self.need("{")
        stop = self.close.get(opened, len(self.tokens) - 1)
        self.exporting = False
        while self.i < stop:
            self.guarded(what or self.statement, stop)
        self.exporting = exporting
        self.i = max(self.i, stop) if opened in self.close else self.i
        if not self.take("}"):
            self.issue("missing")

    def ended(self) -> None:
        if not self.take(";") and not (self.t.fresh or self.at("}") or self.t.kind == "end"):
            self.wrong()

    def statement(self) -> None:
        t, nxt = self.t, self.ahead()
        word = t.text if t.kind == "name" else ""
        if self.at("{"):
            self.block()
        elif self.take(";"):
            pass
        elif word.startswith("@") or self.at("@"):
            self.decorator()
        elif word == "import" and nxt.text not in ("(", "."):
            self.i += 1
            self.module_part()
        elif word == "export":
            self.i += 1
            self.exporting = True
            if self.take("default") or self.take("="):
                if self.at("class", "abstract", "function", "async", "interface", "struct", "@") or self.t.text.startswith("@"):
                    return self.statement()
                self.expression()
                self.ended()
            elif self.at("*", "{") or (self.at("type", "as") and self.ahead().text in ("{", "*", "namespace")):
                self.module_part()
            else:
                self.statement()
        elif word in ("declare", "abstract", "async") and nxt.kind == "name" and not nxt.fresh:
            self.i += 1
            self.statement()
        elif word == "function":
            head = self.tokens[self.i - 1] if self.i and self.tokens[self.i - 1].text == "async" and not t.fresh else t
            name = self.ahead(2) if nxt.text == "*" else nxt
            made = len(self.found)
            self.function()
            if name.kind == "name":
                self.found.insert(made, Found("function", name.text, head.start, name.start, self.head_end, self.last_end(), self.exporting))
        elif word == "class" or (word == "struct" and self.lang == "arkts" and nxt.kind == "name"):
            self.class_()
        elif word in ("interface", "enum", "namespace", "module", "global") and (nxt.kind in ("name", "string") or nxt.text == "{") and not nxt.fresh:
            self.i += 1
            self.named_body(word)
        elif word == "type" and nxt.kind == "name" and not nxt.fresh:
            self.i += 2
            self.angle() if self.at("<") else None
            self.need("=")
            self.type_()
            self.ended()
        elif word in ("const", "let", "var", "using") and (nxt.kind == "name" or nxt.text in ("{", "[")):
            self.i += 1
            if word == "const" and self.at("enum"):
                return self.statement()
            self.variables()
            self.ended()
        elif word in ("if", "while", "with", "switch"):
            self.i += 1
            self.need("(")
            self.expression()
            self.need(")")
            if word == "switch":
                return self.block(self.case)
            self.statement()
            if word == "if" and self.take("else"):
                self.statement()
        elif word == "for":
            self.for_()
        elif word == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.need("(")
            self.expression()
            self.need(")")
            self.take(";")
        elif word == "try":
            self.i += 1
            self.block()
            if self.take("catch"):
                if self.take("("):
                    self.binding()
                    self.need(")")
                self.block()
            elif not self.at("finally"):
                self.wrong()
            if self.take("finally"):
                self.block()
        elif word in ("return", "throw", "break", "continue", "debugger"):
            self.i += 1
            if not (self.t.fresh or self.at(";", "}") or self.t.kind == "end"):
                self.expression()
            elif word == "throw":
                self.wrong()
            self.ended()
        elif t.kind == "name" and nxt.text == ":" and nxt.kind == "punct":
            self.i += 2
            self.statement()
        else:
            self.expression()
            self.ended()

    def module_part(self) -> None:
        """What follows import and export: names, then where from."""
        while not (self.at(";") or self.t.kind == "end"):
            if self.t.kind == "string":
                self.i += 1
                if self.at("with", "assert") and self.ahead().text == "{":
                    self.i = self.close.get(self.i + 1, self.i + 1) + 1
                break
            if self.at("{"):
                if self.i not in self.close:
                    self.wrong()
                self.i = self.close[self.i] + 1
            elif self.take("="):
                self.expression()
                break
            elif self.t.kind == "name" or self.at("*", ","):
                self.i += 1
            else:
                self.wrong()
            if self.t.fresh and not (self.at("from", "{", ",", "*", "as") or self.t.kind == "string" or self.tokens[self.i - 1].text in ("from", ",")):
                break
        self.ended()

    def named_body(self, word: str) -> None:
        while self.t.kind in ("name", "string") or self.at(".", ","):
            if self.at("extends"):
                self.i += 1
                self.type_()
                continue
            self.i += 1
            if self.at("<"):
                self.angle()
        if word in ("namespace", "module", "global"):
            if self.at("{"):
                return self.block()
            return self.ended()
        opened = self.i
        self.need("{")
        if opened not in self.close:
            self.issue("missing")
            raise _Panic
        if word == "enum":
            while self.i < self.close[opened]:
                if self.t.kind not in ("name", "string"):
                    self.wrong()
                self.i += 1
                if self.take("="):
                    self.assignment()
                if not self.take(",") and not self.at("}"):
                    self.wrong()
        self.i = self.close[opened] + 1

    def for_(self) -> None:
        self.i += 1
        self.take("await")
        self.need("(")
        if self.at("const", "let", "var") and self.ahead().text not in ("of", "in", "=") or self.at("const", "let", "var"):
            self.i += 1
            self.variables()
        elif not self.at(";"):
            self.expression()
        if self.take("of", "in"):
            self.expression()
        else:
            self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expression()
        self.need(")")
        self.statement()

    def case(self) -> None:
        if self.take("case"):
            self.expression()
            self.need(":")
        elif self.at("default") and self.ahead().text == ":":
            self.i += 2
        else:
            self.statement()

    def variables(self) -> None:
        while True:
            self.binding(init=True)
            if not self.take(","):
                return

    def binding(self, init: bool = False) -> None:
        if self.at("{", "["):
            self.primary()
        elif self.t.kind == "name":
            self.i += 1
        else:
            self.wrong()
        self.take("?") or self.take("!")
        if self.take(":"):
            self.type_()
        if self.take("="):
            self.assignment()

    def parameters(self) -> None:
        end = self.close.get(self.i)
        self.need("(")
        while not self.at(")"):
            while self.t.text.startswith("@") and self.t.kind == "name":
                self.decorator()
            while self.t.kind == "name" and self.t.text in _MODIFIERS and (self.ahead().kind == "name" or self.ahead().text in ("{", "[")):
                self.i += 1
            self.take("...")
            self.binding()
            if not self.take(","):
                break
        self.need(")")
        self.head_end = self.tokens[end].start + 1 if end is not None else self.last_end()

    def function(self) -> None:
        self.i += 1
        self.take("*")
        if self.t.kind == "name":
            self.i += 1
        self.rest_of_function()

    def rest_of_function(self) -> None:
        if self.at("<"):
            self.angle()
        self.parameters()
        head_end = self.head_end
        if self.take(":"):
            self.type_()
        if self.at("{"):
            self.block()
        else:
            self.ended()
        self.head_end = head_end

    def decorator(self) -> None:
        self.i += 1
        if self.tokens[self.i - 1].text == "@" and self.t.kind == "name":
            self.i += 1
        while True:
            if self.take("."):
                self.i += 1
            elif self.at("("):
                self.arguments()
            else:
                return

    def class_(self) -> None:
        self.i += 1
        while not self.at("{"):
            if self.at("<"):
                self.angle()
            elif self.at("(") and self.i in self.close:
                self.i = self.close[self.i] + 1
            elif self.t.kind == "name" or self.at(".", ","):
                self.i += 1
            else:
                self.wrong()
        self.block(self.member)

    def member(self) -> None:
        if self.take(";"):
            return
        decorators = []
        while self.t.kind == "name" and self.t.text.startswith("@") or self.at("@"):
            at = self.t.start
            self.decorator()
            decorators.append((at, self.last_end()))
        if self.at("static") and self.ahead().text == "{":
            self.i += 1
            return self.block()
        start = self.t.start
        while self.t.kind == "name" and self.t.text in _MODIFIERS and self.ahead().text not in ("(", "=", ";", ":", "?", "!", "}", "<", ",") and not (self.ahead().fresh and self.t.text in ("get", "set", "static")):
            self.i += 1
        self.take("*")
        name, made = self.t, len(self.found)
        self.property_name()
        self.take("?") or self.take("!")
        kind = "method" if self.at("(", "<") else "field"
        if kind == "method":
            self.rest_of_function()
        else:
            if self.take(":"):
                self.type_()
            if self.take("="):
                self.assignment()
            self.ended()
        if name.kind == "name":
            self.found.insert(made, Found(kind, name.text, start, name.start, self.head_end, self.last_end(), False, tuple(decorators)))

    def property_name(self) -> None:
        if self.at("[") and self.i in self.close:
            self.i = self.close[self.i] + 1
        elif self.t.kind in ("name", "string", "number"):
            self.i += 1
        else:
            self.wrong()

    # -- expressions
    def expression(self) -> None:
        self.assignment()
        while self.take(","):
            self.assignment()

    def assignment(self) -> None:
        self.operand()
        while True:
            t = self.t
            if t.kind == "end" or self.at(",", ")", "]", "}", ";", ":"):
                return
            if t.fresh and not (t.kind == "punct" and (t.text in _BINARY or t.text in "?") and t.text != "++") and not self.at("instanceof", "in", "as"):
                return
            if self.at("=>"):
                self.i += 1
                self.block() if self.at("{") else self.assignment()
                return
            if self.take("?"):
                self.ternary += 1
                self.assignment()
                self.ternary -= 1
                self.need(":")
                self.assignment()
                return
            if self.at("as", "satisfies"):
                self.i += 1
                self.type_()
                continue
            if self.at(">"):
                self.i += 1
                while self.at(">", "=") and self.t.start == self.tokens[self.i - 1].start + 1 or self.at("==", "===") and self.t.start == self.tokens[self.i - 1].start + 1:
                    self.i += 1
                self.operand()
                continue
            if t.kind in ("punct", "name") and t.text in _BINARY:
                self.i += 1
                self.operand()
                continue
            if self.at("of"):
                return
            self.wrong()

    def operand(self) -> None:
        while (self.t.kind in ("punct", "name")) and self.t.text in _PREFIX:
            yields = self.t.text in ("yield", "await")
            self.i += 1
            if yields:
                self.take("*")
                if self.t.fresh or self.at(")", "]", "}", ",", ";", ":") or self.t.kind == "end":
                    return
        if self.take("new"):
            if self.take("."):
                self.i += 1
            else:
                self.operand()
            return
        self.primary()
        self.postfix()

    def postfix(self) -> None:
        while True:
            t = self.t
            if self.at(".", "?."):
                self.i += 1
                if self.at("(", "["):
                    continue
                if self.t.kind != "name":
                    self.wrong()
                self.i += 1
            elif self.at("("):
                self.arguments()
                if self.lang == "arkts" and self.at("{") and not self.t.fresh:
                    self.block()
            elif self.at("["):
                self.i += 1
                self.expression()
                self.need("]")
            elif t.kind == "string" and t.text[0] == "`":
                self.i += 1
            elif self.at("++", "--") and not t.fresh:
                self.i += 1
            elif self.at("!") and not t.fresh and self.ahead().text != "=":
                self.i += 1
            elif self.at("<") and self.tried(lambda: (self.angle(), self.at("(") or self.t.text[:1] == "`" or self.wrong())):
                pass
            else:
                return

    def tried(self, what) -> bool:
        begun, n, error, made, exporting = self.i, len(self.issues), self.at_error, len(self.found), self.exporting
        try:
            what()
            return True
        except _Panic:
            self.i, self.at_error, self.exporting = begun, error, exporting
            del self.issues[n:], self.found[made:]
            return False

    def arguments(self) -> None:
        self.need("(")
        self.listed(")")

    def listed(self, end: str) -> None:
        while not self.at(end):
            if end == "]" and self.take(","):
                continue
            self.take("...")
            self.assignment()
            if self.at(":") or self.at("?"):  # parameters of an arrow function that were taken for a list
                self.take("?")
                self.take(":")
                self.type_()
                if self.take("="):
                    self.assignment()
            if not self.take(","):
                break
        self.need(end)

    def primary(self) -> None:
        t = self.t
        if t.kind in ("string", "number"):
            self.i += 1
        elif self.at("("):
            close = self.close.get(self.i)
            after = self.tokens[close + 1] if close is not None else None
            if after is not None and after.text == "=>" and after.kind == "punct":
                return self.parameters()
            if after is not None and after.text == ":" and self.tried(self.arrow_head):
                return None
            self.i += 1
            self.expression()
            self.need(")")
        elif self.at("["):
            self.i += 1
            self.listed("]")
        elif self.at("{"):
            self.object_()
        elif self.at("function"):
            self.function()
        elif self.at("async") and self.ahead().text == "function" and not self.ahead().fresh:
            self.i += 1
            self.function()
        elif self.at("async") and not self.ahead().fresh and (self.ahead().text in ("(", "<") or self.ahead().kind == "name" and self.ahead(2).text == "=>"):
            if self.ahead().kind == "name" or self.ahead().text == "<" or self.tokens[self.close.get(self.i + 1, self.i) + 1].text in ("=>", ":"):
                self.i += 1
                return self.primary()
            self.i += 1
        elif self.at("class"):
            self.class_()
        elif self.at("<"):
            self.angle()
            self.operand()
        elif self.lang == "arkts" and self.at(".") and t.fresh:
            pass
        elif t.kind == "name" and not (t.text in _STATEMENTS - {"import", "namespace", "struct", "let"}):
            self.i += 1
        else:
            self.wrong()

    def arrow_head(self) -> None:
        self.parameters()
        self.need(":")
        self.type_()
        if not self.at("=>"):
            self.wrong()

    def object_(self) -> None:
        opened = self.i
        self.i += 1
        while not self.at("}"):
            if self.take("..."):
                self.assignment()
            else:
                self.object_member()
            if not self.take(","):
                break
        if opened in self.close:
            self.need("}")
        else:
            self.issue("missing")
            raise _Panic

    def object_member(self) -> None:
        start = self.t.start
        while self.at("async", "get", "set", "static") and self.ahead().text not in ("(", ",", ":", "}", "=", "<"):
            self.i += 1
        self.take("*")
        name, made = self.t, len(self.found)
        self.property_name()
        if self.at("(", "<"):
            if self.at("<"):
                self.angle()
            self.parameters()
            head_end = self.head_end
            if self.take(":"):
                self.type_()
            self.block()
            if name.kind == "name":
                self.found.insert(made, Found("method", name.text, start, name.start, head_end, self.last_end(), self.exporting))
        elif self.take(":"):
            self.assignment()
        elif self.take("="):
            self.assignment()

    # -- types
    def angle(self) -> None:
        self.need("<")
        while not self.at(">"):
            self.take("const")
            self.type_()
            if self.take("="):
                self.type_()
            if not self.take(","):
                break
        self.need(">")

    def type_(self) -> None:
        self.take("|") or self.take("&")
        while True:
            self.type_operand()
            if self.at("|", "&"):
                self.i += 1
                continue
            if self.at("is") and not self.t.fresh:
                self.i += 1
                continue
            if self.at("extends") and not self.t.fresh or self.at("extends") and self.ahead(-1).text == ")":
                self.i += 1
                self.type_()
                if self.take("?"):
                    self.type_()
                    self.need(":")
                    self.type_()
            return

    def type_operand(self) -> None:
        while self.t.kind == "name" and self.t.text in _TYPE_PREFIX and (self.ahead().kind in ("name", "string") or self.ahead().text in ("(", "{", "[", "<")) and not self.ahead().fresh:
            self.i += 1
        t = self.t
        if self.at("(", "{", "["):
            if self.i not in self.close:
                self.i = len(self.tokens) - 1
                self.wrong()
            round_ = self.at("(")
            self.i = self.close[self.i] + 1
            if round_ and self.take("=>"):
                return self.type_()
        elif self.at("<"):
            self.angle()
            return self.type_operand()
        elif self.take("-"):
            self.i += 1
        elif t.kind in ("string", "number"):
            self.i += 1
        elif t.kind == "name":
            self.i += 1
        else:
            self.wrong()
        while True:
            if self.take("."):
                self.i += 1
            elif self.at("[") and not self.t.fresh and self.i in self.close:
                self.i = self.close[self.i] + 1
            elif self.at("<") and not self.t.fresh:
                self.angle()
            elif self.at("(") and self.tokens[self.i - 1].text == "import" and self.i in self.close:
                self.i = self.close[self.i] + 1
            else:
                return


def check(code: str, lang: str) -> tuple[list[tuple[str, int]], list[Found]] | None:
    """Issues in order of line, and declarations; None for texts with markup, or nested too deeply to be read."""
    if _MARKUP.search(code):
        return None
    parser = Parser(code, lang)
    try:
        parser.program()
    except RecursionError:
        return None
    return sorted(parser.issues, key=lambda x: x[1]), parser.found
