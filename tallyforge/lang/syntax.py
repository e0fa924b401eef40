"""Lexer and parser: text to a tree of ``Node``."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class SyntaxProblem(Exception):
    """A program that does not parse."""


@dataclass
class Node:
    kind: str
    line: int = 0
    at: dict = field(default_factory=dict)

    def __getattr__(self, name):
        try:
            return self.__dict__["at"][name]
        except KeyError:
            raise AttributeError(name) from None


KEYWORDS = frozenset(
    "all and array break bytes case continue default do each else emit file for format function if include keyed map not of or proc proto result return some static submatch switch table type weight when while".split()
)
_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)
    |(?P<time>T"(?:[^"\\\n]|\\.)*"|\d+[tT]\b)|(?P<fingerprint>(?:0[xX][0-9a-fA-F]+|\d+)[pP]\b)|(?P<bytes>[BX]"(?:[^"\\\n]|\\.)*")
    |(?P<float>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)
    |(?P<int>0[xX][0-9a-fA-F]+|0[bB][01]+|\d+)(?![\w.])
    |(?P<string>"(?:[^"\\\n]|\\.)*"|`[^`]*`)|(?P<char>'(?:[^'\\\n]|\\.)')
    |(?P<name>[A-Za-z_]\w*)
    |(?P<op><-|:=|==|!=|<=|>=|<<|>>|\|\||&&|\+\+|--|\.\.\.|[-+*/%<>=!~&|^(){}\[\];:,.$?])""",
    re.X,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "a": "\a", "v": "\v", "0": "\0"}


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        return chr(int(c[1:], 16)) if len(c) > 1 else _ESCAPES.get(c, c)

    return re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", one, text, flags=re.S)


def tokens(text: str) -> list[tuple[str, object, int]]:
    found, at, line = [], 0, 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"line {line}: cannot read {text[at : at + 20]!r}")
        kind, raw = m.lastgroup, m[0]
        if kind == "name" and raw in KEYWORDS:
            kind = "key"
        value: object = raw
        if kind == "string":
            value = raw[1:-1] if raw[0] == "`" else unescape(raw[1:-1])
        elif kind == "int":
            value = int(raw, 8) if re.fullmatch(r"0[0-7]+", raw) else int(raw, 0)
        elif kind == "float":
            value = float(raw)
        elif kind == "char":
            kind, value = "int", ord(unescape(raw[1:-1]))
        elif kind == "fingerprint":
            value = int(raw[:-1], 0)
        elif kind == "bytes":
            value = bytes.fromhex(raw[2:-1]) if raw[0] == "X" else unescape(raw[2:-1]).encode()
        elif kind == "time":
            value = unescape(raw[2:-1]) if raw[0] == "T" else int(raw[:-1])
        if kind != "space":
            found.append((kind, value, line))
        line += raw.count("\n")
        at = m.end()
    return [*found, ("end", None, line)]


_OPS = [("or", "||"), ("and", "&&"), ("==", "!=", "<", "<=", ">", ">="), ("+", "-", "|", "^"), ("*", "/", "%", "<<", ">>", "&")]


class Parser:
    def __init__(self, text: str, include=None):
        self.tokens, self.i, self.include = tokens(text), 0, include

    def peek(self, *values, ahead: int = 0) -> bool:
        kind, value, _ = self.tokens[min(self.i + ahead, len(self.tokens) - 1)]
        return kind in ("op", "key") and value in values

    def kind(self, ahead: int = 0) -> str:
        return self.tokens[min(self.i + ahead, len(self.tokens) - 1)][0]

    def next(self):
        self.i += 1
        return self.tokens[self.i - 1]

    def take(self, *values) -> bool:
        if self.peek(*values):
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            self.fail(f"{value!r} expected")

    def fail(self, why: str):
        kind, value, line = self.tokens[self.i]
        raise SyntaxProblem(f"line {line}: {why}, found {value!r}")

    def name(self) -> str:
        if self.kind() != "name":
            self.fail("a name expected")
        return self.next()[1]

    def member(self) -> str:
        """A member's name, which may be a keyword."""
        return self.next()[1] if self.kind() == "key" else self.name()

    def node(self, kind: str, **at) -> Node:
        return Node(kind, self.tokens[max(0, self.i - 1)][2], at)

    def program(self) -> list[Node]:
        found = []
        while self.kind() != "end":
            found += self.top()
        return found

    def top(self) -> list[Node]:
        if self.take("include"):
            if self.kind() != "string":
                self.fail("a file name expected")
            name = self.next()[1]
            self.take(";")
            if not self.include:
                raise SyntaxProblem(f"nothing resolves include {name!r}")
            return Parser(self.include(name), self.include).program()
        if self.take("proto"):
            name = self.next()[1]
            self.take(";")
            return [self.node("proto", file=name)]
        return [self.statement()]

    def statement(self) -> Node:
        if self.take("{"):
            return self.block()
        if self.take(";"):
            return self.node("empty")
        if self.take("static"):
            return self.node("static", decl=self.declaration())
        if self.take("type"):
            name = self.name()
            self.need("=")
            t = self.type()
            self.need(";")
            return self.node("type", name=name, type=t)
        if self.take("emit"):
            table, index = self.name(), []
            while self.take("["):
                index.append(self.expr())
                self.need("]")
            self.need("<-")
            value = self.expr()
            weight = self.expr() if self.take("weight") else None
            self.need(";")
            return self.node("emit", table=table, index=index, value=value, weight=weight)
        if self.take("if"):
            self.need("(")
            test = self.expr()
            self.need(")")
            then = self.statement()
            return self.node("if", test=test, then=then, other=self.statement() if self.take("else") else None)
        if self.take("for"):
            self.need("(")
            first = self.simple() if not self.peek(";") else None
            self.need(";")
            test = self.expr() if not self.peek(";") else None
            self.need(";")
            step = self.simple() if not self.peek(")") else None
            self.need(")")
            return self.node("for", first=first, test=test, step=step, body=self.statement())
        if self.take("while"):
            self.need("(")
            test = self.expr()
            self.need(")")
            return self.node("while", test=test, body=self.statement())
        if self.take("do"):
            body = self.statement()
            self.need("while")
            self.need("(")
            test = self.expr()
            self.need(")")
            self.take(";")
            return self.node("do", test=test, body=body)
        if self.take("when"):
            self.need("(")
            names = []
            while self.kind() == "name" and self._quantified():
                vs = [self.name()]
                while self.take(","):
                    vs.append(self.name())
                self.need(":")
                kind = self.next()[1]
                t = self.type()
                self.need(";")
                names += [(v, kind, t) for v in vs]
            test = self.expr()
            self.need(")")
            return self.node("when", names=names, test=test, body=self.statement())
        if self.take("switch"):
            self.need("(")
            of = self.expr()
            self.need(")")
            self.need("{")
            cases, default = [], None
            while not self.take("}"):
                labels = []
                if self.take("default"):
                    self.need(":")
                else:
                    self.need("case")
                    labels.append(self.expr())
                    while self.take(","):
                        labels.append(self.expr())
                    self.need(":")
                body = []
                while not self.peek("case", "default", "}"):
                    body.append(self.statement())
                body = [b for b in body if b.kind != "break"]
                block = self.node("block", body=body)
                if labels:
                    cases.append((labels, block))
                else:
                    default = block
            if default is None:
                self.fail("default expected in switch")
            return self.node("switch", of=of, cases=cases, default=default)
        for word in ("break", "continue"):
            if self.take(word):
                self.take(";")
                return self.node(word)
        for word in ("return", "result"):
            if self.take(word):
                value = None if self.peek(";") else self.expr()
                self.need(";")
                return self.node(word, value=value)
        if self.kind() == "name" and (self.peek(":", ":=", ahead=1)):
            return self.declaration()
        found = self.simple()
        self.need(";")
        return found

    def _quantified(self) -> bool:
        i = self.i
        while self.tokens[i][0] == "name" and self.tokens[i + 1][1] == ",":
            i += 2
        return self.tokens[i][0] == "name" and self.tokens[i + 1][1] == ":" and self.tokens[i + 2][1] in ("each", "some", "all")

    def block(self) -> Node:
        body = []
        while not self.take("}"):
            if self.kind() == "end":
                self.fail("'}' expected")
            body.append(self.statement())
        return self.node("block", body=body)

    def declaration(self) -> Node:
        found = self.bare_declaration()
        if found.value is None or found.value.kind != "function":
            self.need(";")
        else:
            self.take(";")
        return found

    def bare_declaration(self) -> Node:
        name = self.name()
        t = value = None
        if self.take(":="):
            value = self.expr()
        else:
            self.need(":")
            if not self.peek("="):
                t = self.type()
            if self.take("="):
                value = self.expr()
            elif t is not None and t.kind == "function" and self.take("{"):
                value = self.node("function", type=t, body=self.block())
        return self.node("decl", name=name, type=t, value=value)

    def simple(self) -> Node:
        """A declaration, an assignment or an expression, without its semicolon."""
        if self.kind() == "name" and self.peek(":", ":=", ahead=1):
            return self.bare_declaration()
        left = self.expr()
        if self.take("="):
            return self.node("assign", target=left, value=self.expr())
        if self.peek("++", "--"):
            return self.node("step", target=left, op=self.next()[1])
        return self.node("expr", value=left)

    def type(self) -> Node:
        if self.take("array"):
            self.need("of")
            return self.node("array", of=self.component()[1])
        if self.take("map"):
            self.need("[")
            key = self.component()[1]
            self.need("]")
            self.need("of")
            return self.node("map", key=key, value=self.component()[1])
        if self.take("table"):
            name, params, index = self.name(), [], []
            if self.take("("):
                while not self.take(")"):
                    params.append(self.expr())
                    self.take(",")
            while self.take("["):
                index.append(self.component())
                self.need("]")
            self.need("of")
            value, weight, options = self.component(), None, {}
            if self.take("weight"):
                weight = self.component()
            while self.peek("file", "proc", "format"):
                word = self.next()[1]
                self.need("(")
                options[word] = self.expr()
                self.need(")")
            return self.node("table", name=name, params=params, index=index, value=value, weight=weight, options=options)
        if self.take("function"):
            self.need("(")
            params = []
            while not self.take(")"):
                params.append(self.component())
                self.take(",")
            return self.node("function", params=params, result=self.type() if self.take(":") else None)
        if self.take("{"):
            members = []
            while not self.take("}"):
                members.append(self.component())
                self.take(",")
            return self.node("tuple", members=members)
        if self.take("bytes"):
            return self.node("named", name="bytes")
        return self.node("named", name=self.name())

    def component(self) -> tuple[str | None, Node]:
        name = None
        if self.kind() in ("name", "key") and self.peek(":", ahead=1):
            name = self.member()
            self.i += 1
        return name, self.type()

    def expr(self, level: int = 0) -> Node:
        if level == len(_OPS):
            return self.unary()
        left = self.expr(level + 1)
        while self.peek(*_OPS[level]):
            op = {"||": "or", "&&": "and"}.get(o := self.next()[1], o)
            left = self.node("binary", op=op, left=left, right=self.expr(level + 1))
            if level == 2:
                break
        return left

    def unary(self) -> Node:
        if self.peek("+", "-", "~", "!", "not"):
            op = {"not": "!"}.get(o := self.next()[1], o)
            return self.node("unary", op=op, of=self.unary())
        return self.postfix(self.operand())

    def postfix(self, of: Node) -> Node:
        while True:
            if self.take("."):
                of = self.node("field", of=of, name=self.member())
            elif self.take("["):
                first = self.expr()
                if self.take(":"):
                    of = self.node("slice", of=of, first=first, last=self.expr())
                else:
                    of = self.node("index", of=of, index=first)
                self.need("]")
            elif self.take("("):
                args = []
                while not self.take(")"):
                    args.append(self.expr())
                    if not self.peek(")"):
                        self.need(",")
                of = self.node("call", of=of, args=args)
            else:
                return of

    def operand(self) -> Node:
        kind = self.kind()
        if kind in ("int", "float", "string", "bytes", "time", "fingerprint"):
            return self.node("literal", type=kind, value=self.next()[1])
        if self.take("("):
            found = self.expr()
            self.need(")")
            return found
        if self.take("$"):
            return self.node("length")
        if self.take("?"):
            self.need("{")
            return self.node("block_value", body=self.block())
        if self.peek("function"):
            t = self.type()
            self.need("{")
            return self.node("function", type=t, body=self.block())
        if self.take("{"):
            return self.composite()
        if self.take("bytes", "format"):
            return self.node("name", name=self.tokens[self.i - 1][1])
        if self.peek("array", "map"):  # a type as an argument
            return self.node("type_name", type=self.type())
        return self.node("name", name=self.name())

    def composite(self) -> Node:
        if self.take(":"):
            self.need("}")
            return self.node("map_of", pairs=[])
        items, pairs = [], []
        while not self.take("}"):
            first = self.expr()
            if self.take(":"):
                pairs.append((first, self.expr()))
            else:
                items.append(first)
            if not self.peek("}"):
                self.need(",")
        return self.node("map_of", pairs=pairs) if pairs else self.node("list_of", items=items)


def parse(text: str, include=None) -> list[Node]:
    return Parser(text, include).program()
