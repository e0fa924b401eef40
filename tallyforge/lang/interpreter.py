"""Row interpreter for programs that columns cannot express: loops that are left early or carry
values while they emit, ``while``, ``do``, recursion.

Each record's program runs in Python, in Arrow batches; its emits become rows (table, index, value,
weight) of text, which are typed again and go to the same aggregator plans as all others. What depends
on the record alone is a column before that: values of the program's outermost declarations, and calls,
a user's functions among them.
"""

from __future__ import annotations

import base64
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.program import EmitSite, result
from .syntax import Node, parse
from .types import BYTES, FLOAT, INT, SCALARS, Array, Map, Scalar, Table, Tuple, TypeProblem, Unsupported, from_spark, spark_type

MAX_STEPS = 10_000_000


class Undefined(Exception):
    """An undefined value was used; the record's program ends, as far as it has come."""


class _Leave(Exception):
    def __init__(self, kind: str, value=None):
        self.kind, self.value = kind, value


def _wrap(n):
    n &= (1 << 64) - 1
    return n - (1 << 64) if n >> 63 else n


def _int(x, base=None):
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, float):
        return None if math.isnan(x) else int(max(min(x, 2**63 - 1), -(2**63)))
    if isinstance(x, str):
        try:
            digits = x.lstrip("+-")
            return int(x, base) if base else int(x.replace("#", "0x", 1), 0) if digits.startswith(("0x", "0X", "#")) else int(x, 8 if re.fullmatch("0[0-7]+", digits) else 10)
        except ValueError:
            return None
    return x


def _float(x):
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def _string(x, base=None):
    if base:
        digits, n = "", abs(x)
        while n:
            digits, n = "0123456789abcdefghijklmnopqrstuvwxyz"[n % base] + digits, n // base
        return ("-" if x < 0 else "") + (digits or "0")
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, bytes):
        return x.decode("utf-8", "replace")
    return _double(x) if isinstance(x, float) else str(x)


def _double(x: float) -> str:
    """A float as the columns write it: from 0.001 to below 10,000,000 plainly, else with an exponent."""
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    _, digits, exponent = Decimal(repr(abs(x))).as_tuple()
    digits, sign = "".join(map(str, digits)).rstrip("0") or "0", "-" if math.copysign(1, x) < 0 else ""
    if x == 0:
        return f"{sign}0.0"
    exponent = Decimal(repr(abs(x))).adjusted()
    digits = digits.lstrip("0")
    if -3 <= exponent < 7:
        whole, rest = (digits[: exponent + 1].ljust(exponent + 1, "0"), digits[exponent + 1 :]) if exponent >= 0 else ("0", "0" * (-exponent - 1) + digits)
        return f"{sign}{whole}.{rest or '0'}"
    return f"{sign}{digits[0]}.{digits[1:] or '0'}E{exponent}"


def _round(f):
    """Rounding; what has no fraction, or is not finite, stays as it is."""
    return lambda x: float(f(x)) if abs(x) < 1 << 52 else float(x)


def _saw(s, *patterns, limit=1):
    out = []
    for _ in range(limit):
        before = s
        for p in patterns:
            m = re.search(p, s)
            if not m:
                return out
            out.append(m[0])
            s = s[m.end() :]
        if not s or s == before:
            break
    return out


def _real(f):
    """A function of a float; NaN outside its domain, and infinite where it grows too large."""

    def call(x):
        try:
            return f(float(x))
        except OverflowError:
            return math.copysign(math.inf, x)
        except ValueError:
            return math.nan

    return call


def _pow(a, b):
    a, b = float(a), float(b)
    sign = math.copysign(1.0, a) if b % 2 == 1 else 1.0
    try:
        return math.pow(a, b)
    except OverflowError:
        return sign * math.inf
    except ValueError:
        return sign * math.inf if a == 0 else math.nan


FUNCTIONS = {
    "len": len, "lowercase": str.lower, "uppercase": str.upper, "strfind": lambda p, s: s.find(p), "strrfind": lambda p, s: s.rfind(p),
    "strreplace": lambda s, a, b, every: s.replace(a, b) if every else s.replace(a, b, 1), "match": lambda p, s: bool(re.search(p, s)),
    "matchstrs": lambda p, s: [*((m := re.search(p, s)) and (m[0], *(g or "" for g in m.groups())) or ())],
    "saw": lambda s, *p: _saw(s, *p), "sawn": lambda n, s, *p: _saw(s, *p, limit=n), "sawzall": lambda s, *p: [x for x in _saw(s, *p, limit=len(s) + 1) if x],
    "bool": lambda x: x if isinstance(x, bool) else x[:1].lower() == "t", "int": _int, "float": _float, "string": _string, "time": _int, "fingerprint": _int,
    "bytes": lambda x: x.encode() if isinstance(x, str) else x, "abs": abs, "fabs": abs, "max": max, "min": min, "pow": _pow,
    "sqrt": _real(lambda x: math.sqrt(x) if x >= 0 else math.nan), "ln": _real(lambda x: math.log(x) if x > 0 else -math.inf if x == 0 else math.nan),
    "log10": _real(lambda x: math.log10(x) if x > 0 else -math.inf if x == 0 else math.nan), "exp": _real(math.exp), "sin": _real(math.sin), "cos": _real(math.cos), "tan": _real(math.tan),
    "floor": _real(_round(math.floor)), "ceil": _real(_round(math.ceil)), "round": _real(_round(lambda x: math.floor(x + 0.5))), "trunc": _real(_round(math.trunc)),
    "isnan": math.isnan, "isinf": math.isinf, "isfinite": math.isfinite, "haskey": lambda m, k: k in m, "keys": sorted, "lookup": lambda m, k, d: m.get(k, d), "sort": lambda a, *_: sorted(a),
    "format": lambda f, *a: re.sub(r"%([-+ 0#]*\d*(?:\.\d+)?)[kq]", r'"%\1s"', f) % a,
}
_CONSTANTS = {"true": True, "false": False, "PI": math.pi, "Inf": math.inf, "inf": math.inf, "NaN": math.nan, "nan": math.nan}


class Interpreter:
    """Runs a checked tree over one record at a time."""

    def __init__(self, tree: list[Node], tables: dict[str, Table]):
        self.tree, self.tables = tree, tables
        self.statics: dict | None = None

    def run(self, record, lifted: dict | None = None) -> list[tuple]:
        self.emits, self.steps, self.lengths = [], 0, []
        scopes = [{"input": record} | (lifted or {}), {}]
        try:
            for n in self.tree:
                self.do(n, scopes)
        except (Undefined, _Leave):
            pass
        return self.emits

    def do(self, n: Node, scopes: list[dict]) -> None:
        self.steps += 1
        if self.steps > MAX_STEPS:
            raise RuntimeError(f"a record's program took over {MAX_STEPS} steps")
        k = n.kind
        if k == "decl":
            if n.type is None or n.type.kind != "table":
                scopes[-1][n.name] = self._cast(n.type, self._value(n.value, scopes)) if n.value is not None else None
        elif k == "static":
            self.do(n.decl, scopes)
        elif k == "assign":
            self._assign(n.target, self._value(n.value, scopes), scopes)
        elif k == "step":
            self._assign(n.target, self.of(n.target, scopes) + (1 if n.op == "++" else -1), scopes)
        elif k == "expr":
            self._value(n.value, scopes)
        elif k == "block":
            scopes.append({})
            try:
                for s in n.body:
                    self.do(s, scopes)
            finally:
                scopes.pop()
        elif k == "if":
            if self.of(n.test, scopes):
                self.do(n.then, scopes)
            elif n.other is not None:
                self.do(n.other, scopes)
        elif k in ("while", "do", "for"):
            self._loop(n, scopes)
        elif k == "switch":
            of = self.of(n.of, scopes)
            for labels, body in n.cases:
                if any(self.of(x, scopes) == of for x in labels):
                    return self.do(body, scopes)
            self.do(n.default, scopes)
        elif k == "when":
            self._when(n, scopes)
        elif k in ("break", "continue", "return", "result"):
            raise _Leave("return" if k == "result" else k, self.of(n.value, scopes) if n.at.get("value") is not None else None)
        elif k == "emit":
            try:
                index = [self.of(i, scopes) for i in n.index]
                value = self.of(n.value, scopes)
                weight = self.of(n.weight, scopes) if n.weight is not None else None
            except Undefined:
                return
            members = value if isinstance(value, tuple) or isinstance(self.tables[n.table].value, Tuple) else [value]
            self.emits.append((n.table, [_string(i) for i in index], [_text(v) for v in members], None if weight is None else _string(weight)))

    def _loop(self, n: Node, scopes: list[dict]) -> None:
        scopes.append({})
        try:
            if n.kind == "for" and n.first is not None:
                self.do(n.first, scopes)
            first = n.kind == "do"
            while first or n.test is None or self.of(n.test, scopes):
                first = False
                try:
                    self.do(n.body, scopes)
                except _Leave as leave:
                    if leave.kind == "break":
                        break
                    if leave.kind != "continue":
                        raise
                if n.kind == "for" and n.step is not None:
                    self.do(n.step, scopes)
                self.steps += 1
                if self.steps > MAX_STEPS:
                    raise RuntimeError(f"a record's program took over {MAX_STEPS} steps")
        finally:
            scopes.pop()

    def _when(self, n: Node, scopes: list[dict]) -> None:
        def ranges(v):
            def search(x):
                if isinstance(x, (list, tuple)):
                    return next((f for f in map(search, x) if f is not None), None)
                if not isinstance(x, Node):
                    return None
                if x.kind == "index" and x.index.kind == "name" and x.index.name == v or x.kind == "slice" and any(b.kind == "name" and b.name == v for b in (x.first, x.last)):
                    return x.of
                return next((f for f in map(search, x.at.values()) if f is not None), None)

            of = self.of(search(n.test) or search(n.body), scopes)
            return list(of) if isinstance(of, dict) else range(len(of))

        scopes.append({})
        try:
            order = sorted(n.names, key=lambda x: x[1] != "each")

            def holds(left) -> bool:
                if not left:
                    try:
                        return bool(self.of(n.test, scopes))
                    except Undefined:
                        return False
                v, kind, _ = left[0]
                for x in ranges(v):
                    scopes[-1][v] = x
                    if holds(left[1:]) != (kind == "all"):
                        return kind == "some"
                return kind == "all"

            def each(left) -> None:
                if left and left[0][1] == "each":
                    for x in ranges(left[0][0]):
                        scopes[-1][left[0][0]] = x
                        each(left[1:])
                elif holds(left):
                    self.do(n.body, scopes)

            each(order)
        finally:
            scopes.pop()

    def _assign(self, target: Node, value, scopes: list[dict]) -> None:
        if target.kind == "index":
            self.of(target.of, scopes)[self.of(target.index, scopes)] = value
            return
        for scope in reversed(scopes):
            if target.name in scope:
                scope[target.name] = value
                return

    def _cast(self, t: Node | None, value):
        if t is None or t.kind != "named" or value is None:
            return tuple(value) if t is not None and t.kind == "tuple" and isinstance(value, list) else value
        same = {"int": int, "float": float, "string": str, "bool": bool}.get(t.name)
        if same is None or isinstance(value, same) and not (same is int and isinstance(value, bool)):
            return value
        return FUNCTIONS[t.name](value)

    def _value(self, n: Node, scopes):
        """A value that may be undefined."""
        try:
            return self.of(n, scopes)
        except Undefined:
            return None

    def of(self, n: Node, scopes):
        v = self._of(n, scopes)
        if v is None:
            raise Undefined
        return v

    def _of(self, n: Node, scopes):
        k = n.kind
        if k == "literal":
            return n.value
        if k == "name":
            for scope in reversed(scopes):
                if n.name in scope:
                    return scope[n.name]
            return _CONSTANTS.get(n.name)
        if k == "function":
            return n, scopes[:2]
        if k == "length":
            return len(self.lengths[-1])
        if k == "list_of":
            items = [self.of(i, scopes) for i in n.items]
            return items if len({type(i) for i in items}) < 2 else tuple(items)
        if k == "map_of":
            return {self.of(a, scopes): self.of(b, scopes) for a, b in n.pairs}
        if k == "unary":
            v = self.of(n.of, scopes)
            return {"!": lambda: not v, "-": lambda: -v, "+": lambda: v, "~": lambda: ~v}[n.op]()
        if k == "binary":
            return self._binary(n, scopes)
        if k == "field":
            return self.of(n.of, scopes).get(n.name)
        if k in ("index", "slice"):
            of = self.of(n.of, scopes)
            self.lengths.append(of)
            try:
                if k == "slice":
                    return of[max(0, self.of(n.first, scopes)) : max(0, self.of(n.last, scopes))]
                i = self.of(n.index, scopes)
            finally:
                self.lengths.pop()
            return of.get(i) if isinstance(of, dict) else of[i] if 0 <= i < len(of) else None
        if k == "block_value":
            return self._result(n.body, scopes)
        if k == "call":
            if n.of.kind == "name" and n.of.name == "def":
                return self._value(n.args[0], scopes) is not None
            f = self._of(n.of, scopes) if n.of.kind != "name" or any(n.of.name in s for s in scopes) else None
            args = [self.of(a, scopes) for a in n.args]
            if f is not None:
                node, outer = f
                inner = [*outer, {name: a for (name, _), a in zip(node.type.params, args)}]
                return self._result(node.body, inner)
            return FUNCTIONS[n.of.name](*args)
        raise TypeProblem(f"line {n.line}: {k} is not interpreted")

    def _result(self, body: Node, scopes):
        try:
            self.do(body, scopes)
        except _Leave as leave:
            if leave.kind == "return":
                return leave.value
            raise
        return None

    def _binary(self, n: Node, scopes):
        op = n.op
        if op in ("and", "or"):
            a = self.of(n.left, scopes)
            return self.of(n.right, scopes) if bool(a) == (op == "and") else a
        a, b = self.of(n.left, scopes), self.of(n.right, scopes)
        if op in ("/", "%"):
            if isinstance(a, int) and isinstance(b, int):
                if b == 0:
                    return None
                q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
                return q if op == "/" else a - b * q
            return None if b == 0 else a / b if op == "/" else math.fmod(a, b)
        v = {
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "|": lambda: a | b, "^": lambda: a ^ b, "&": lambda: a & b, "<<": lambda: a << (b & 63), ">>": lambda: a >> (b & 63),
            "==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b,
        }[op]()
        return _wrap(v) if isinstance(v, int) and not isinstance(v, bool) else v


def _text(v) -> str:
    return json.dumps(v) if isinstance(v, (list, dict, tuple)) else _string(v)


def _called(node, declared: set[str]) -> Iterator[str]:
    if isinstance(node, (list, tuple)):
        for x in node:
            yield from _called(x, declared)
    elif isinstance(node, Node):
        if node.kind == "call" and node.of.kind == "name" and node.of.name not in declared:
            yield node.of.name
        for x in node.at.values():
            yield from _called(x, declared)


def _names(node) -> Iterator[str]:
    if isinstance(node, (list, tuple)):
        for x in node:
            yield from _names(x)
    elif isinstance(node, Node):
        if node.kind == "decl":
            yield node.name
        if node.kind == "function" and node.at.get("params"):
            yield from (name for name, _ in node.params if name)
        for x in node.at.values():
            yield from _names(x)


#: Calls that stay where they are: they act, or differ each time.
_STAY = frozenset(("assert", "def", "rand", "nrand"))


def _carried(t) -> bool:
    """Whether values of a type can be handed over to the interpreter."""
    if isinstance(t, Array):
        return _carried(t.of)
    if isinstance(t, Map):
        return isinstance(t.key, Scalar) and t.key.name in ("string", "int") and _carried(t.value)
    return isinstance(t, Scalar) and t.name in ("int", "float", "string", "bool", "bytes", "time", "fingerprint")


def _arrived(v, t):
    """A value of a type, from JSON."""
    if v is None:
        return None
    if isinstance(t, Array):
        return [_arrived(x, t.of) for x in v]
    if isinstance(t, Map):
        return {int(k) if t.key == INT else k: _arrived(x, t.value) for k, x in v.items()}
    return float(v) if t == FLOAT else base64.b64decode(v) if t == BYTES else v


class _Lift:
    """Turns what depends on the record alone into columns of the compiler's frame, and into names in the tree."""

    def __init__(self, tree: list[Node], checker, path):
        from .compiler import assigned

        self.checker, self.path = checker, path
        self.changed, self.declared = assigned(tree), Counter(_names(tree))
        self.calls = checker.registry.names() | {"regex", "convert"}
        self.free, self.found = {"input"} - set(self.declared), []

    def fixed(self, n) -> bool:
        """Whether an expression depends on the record and on lifted values alone."""
        if isinstance(n, (list, tuple)):
            return all(map(self.fixed, n))
        if not isinstance(n, Node):
            return True
        if n.kind == "name":
            return n.name in self.free or not self.declared[n.name] and (n.name in self.checker.types or self.checker.registry.constant(n.name) is not None)
        if n.kind == "call":
            return n.of.kind == "name" and not self.declared[n.of.name] and n.of.name in self.calls - _STAY and self.fixed(n.args)
        return n.kind not in ("function", "block_value", "length") and all(map(self.fixed, n.at.values()))

    def name(self, v, line: int) -> Node:
        self.found.append(v)
        return Node("name", line, {"name": f"${len(self.found) - 1}"})

    def declaration(self, n: Node) -> bool:
        """An outermost declaration, by the compiler; false if it stays as it is."""
        from .compiler import V, mentions

        if n.value is None or n.value.kind == "function" or not self.fixed(n.value):
            return False
        if not mentions(n.value, "call") and (n.type is None or not mentions(n.value, "name")):
            return False
        try:
            self.checker.statement(n, self.checker.env, self.path)
        except Unsupported:
            return False
        v = self.checker.env[n.name]
        if self.declared[n.name] == 1 and n.name not in self.changed and isinstance(v, V):
            self.free.add(n.name)
        else:
            del self.checker.env[n.name]
        if not isinstance(v, V) or not _carried(v.type):
            return False
        n.at |= {"type": None, "value": self.name(v, n.line)}
        return True

    def calls_in(self, n):
        """The tree, with calls on lifted values, or that only columns know, replaced where that can be."""
        from .compiler import uses

        if isinstance(n, (list, tuple)):
            return type(n)(map(self.calls_in, n))
        if not isinstance(n, Node):
            return n
        if n.kind == "call" and n.of.kind == "name" and self.fixed(n) and (n.of.name not in FUNCTIONS or any(uses(n.args, x) for x in self.free)):
            v = self.path.frame.bind(self.checker.expr(n, self.checker.env, self.path))
            if _carried(v.type):
                return self.name(v, n.line)
        n.at = {k: self.calls_in(x) for k, x in n.at.items()}
        return n


def interpreted(text: str, df: DataFrame, registry, protos, include) -> dict[str, DataFrame]:
    """The results of a program, run record by record."""
    from .compiler import Compiler, Path

    tree = parse(text, include)
    checker = Compiler(df, registry, protos, include)
    path = Path(checker.top)
    lift = _Lift(tree, checker, path)
    for n in tree:
        if n.kind in ("type", "proto") or n.kind == "decl" and n.type is not None and n.type.kind == "table":
            checker.statement(n, checker.env, None)
        elif not (n.kind == "decl" and lift.declaration(n)):
            lift.calls_in(n)
    unknown = set(_called(tree, set(_names(tree)))) - set(FUNCTIONS) - {"def"}
    if unknown:
        raise TypeProblem(f"programs that run row by row cannot call {', '.join(sorted(unknown))} with values that the loops carry")
    tables = dict(checker.tables)
    emitted = {t for t in _emitted(tree)}
    missing = emitted - set(tables)
    if missing:
        raise TypeProblem(f"no table {', '.join(sorted(missing))}")
    plain = df.schema.fieldNames() == ["value"] and from_spark(df.schema["value"].dataType) in (SCALARS["string"], BYTES)
    types, lifted = [v.type for v in lift.found], "__lifted"
    if types:
        made = F.to_json(F.struct(*[v.col.alias(str(i)) for i, v in enumerate(lift.found)]), {"ignoreNullFields": "false"})
        df = path.frame.df.select(*[F.col(f"`{c}`") for c in df.columns], made.alias(lifted))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = Interpreter(tree, tables)
        for frame in frames:
            rows, values = [], frame.pop(lifted) if types else [None] * len(frame)
            for record, known in zip(frame["value"] if plain else frame.to_dict("records"), values):
                rows += machine.run(record, known and {f"${i}": _arrived(v, t) for (i, t), v in zip(enumerate(types), json.loads(known).values())})
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(("table", "index", "members", "weight"), columns)})

    rows = df.mapInPandas(run, "table string, index array<string>, members array<string>, weight string")
    made = {}
    for name in sorted(emitted):
        spec, t = checker.specs[name], tables[name]
        types = t.value.types if isinstance(t.value, Tuple) else (t.value,)
        values = [_typed(F.col("members")[i], x) for i, x in enumerate(types)]
        index = [_typed(F.col("index")[i], x) for i, (_, x) in enumerate(t.index)]
        weight = _typed(F.col("weight"), t.weight) if t.weight is not None else None
        made[name] = result(spec, [EmitSite(rows.where(F.col("table") == name), index, values, weight)])
    return made


def _typed(c, t):
    if isinstance(t, (Array, Map, Tuple)):
        return F.from_json(c, spark_type(t))
    if t in (INT, FLOAT) or isinstance(t, Scalar) and t.name in ("bool", "time", "fingerprint"):
        return c.try_cast(spark_type(t))
    return c.cast(spark_type(t))


def _emitted(node) -> Iterator[str]:
    if isinstance(node, (list, tuple)):
        for x in node:
            yield from _emitted(x)
    elif isinstance(node, Node):
        if node.kind == "emit":
            yield node.table
        for x in node.at.values():
            yield from _emitted(x)
