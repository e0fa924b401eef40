"""Checks a program and lowers it to DataFrames.

Variables are single-assignment columns; ``if`` and ``switch`` become guards and merged values;
counting loops and ``each`` become exploded frames; loops that carry values become folds over an
array; ``some`` and ``all`` become higher-order functions; functions are inlined. Every ``emit`` is
an emit site: a frame, a guard, and columns. What columns cannot express raises ``Unsupported``.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.builtin import BUILTIN
from ..functions.registry import Registry
from ..operators.aggregators import AGGREGATORS
from ..plans.program import EmitSite, TableSpec, result, staged
from .syntax import Node, parse
from .types import ANY, BOOL, BYTES, FINGERPRINT, FLOAT, INT, SCALARS, STRING, TIME, Array, Function, Map, Scalar, Table, Tuple, TypeProblem, Unsupported, arithmetic, assignable, comparable, from_spark, spark_type

_NONE = object()


@dataclass
class V:
    """A value: its type, its column, its Python value if it is constant, its members if written out."""

    type: object
    col: Column | None
    const: object = _NONE
    items: list | None = None


@dataclass
class Closure:
    node: Node
    env: dict


class Frame:
    """Rows on which columns are bound. ``pure``: inside a lambda, where values are put in place."""

    def __init__(self, df: DataFrame | None, names):
        self.df, self.names = df, names

    def bind(self, v: V) -> V:
        if self.df is None or v.const is not _NONE or v.col is None:
            return v
        name = f"__v{next(self.names)}"
        self.df = self.df.withColumn(name, v.col)
        return replace(v, col=F.col(name))


@dataclass
class Path:
    """Where a statement stands: its frame, the guard under which it runs, what has returned."""

    frame: Frame
    guard: Column | None = None
    stopped: Column | None = None
    value: V | None = None
    parent: Path | None = field(default=None, repr=False)

    def live(self) -> Column | None:
        if self.stopped is None:
            return self.guard
        on = ~self.stopped
        return on if self.guard is None else self.guard & on


def _and(a: Column | None, b: Column) -> Column:
    return b if a is None else a & b


def assigned(node) -> set[str]:
    """Names that a statement assigns or steps and does not declare itself."""
    if isinstance(node, (list, tuple)):
        return set().union(*map(assigned, node)) if node else set()
    if not isinstance(node, Node):
        return set()
    found = set().union(*[assigned(v) for v in node.at.values()]) if node.at else set()
    if node.kind in ("assign", "step"):
        target = node.target
        while target.kind in ("index", "field", "slice"):
            target = target.of
        found.add(target.name)
    if node.kind == "block":
        found -= {s.name for s in node.body if s.kind == "decl"}
    if node.kind == "for" and node.first is not None and node.first.kind == "decl":
        found.discard(node.first.name)
    return found


def mentions(node, *kinds: str) -> bool:
    if isinstance(node, (list, tuple)):
        return any(mentions(n, *kinds) for n in node)
    return isinstance(node, Node) and (node.kind in kinds or any(mentions(v, *kinds) for v in node.at.values()))


def uses(node, name: str) -> bool:
    if isinstance(node, (list, tuple)):
        return any(uses(n, name) for n in node)
    return isinstance(node, Node) and (node.kind == "name" and node.name == name or any(uses(v, name) for v in node.at.values()))


def _chain(n: Node, env: dict) -> tuple | None:
    """A variable, or a member of one, by its names."""
    if n.kind == "field":
        above = _chain(n.of, env)
        return above and (*above, n.name)
    return (n.name,) if n.kind == "name" and isinstance(env.get(n.name), V) else None


class Compiler:
    def __init__(self, df: DataFrame, registry: Registry = BUILTIN, protos: dict | None = None, include=None):
        self.registry, self.protos, self.include = registry, protos or {}, include
        self._names = iter(range(1 << 62))
        self.tables: dict[str, Table] = {}
        self.specs: dict[str, TableSpec] = {}
        self.sites: dict[str, list] = {}
        self.types: dict[str, object] = dict(SCALARS)
        self.lengths: list[V] = []
        self.depth = 0
        self.top = Frame(df, self._names)
        if df.schema.fieldNames() == ["value"] and from_spark(df.schema["value"].dataType) in (STRING, BYTES):
            self.input = V(from_spark(df.schema["value"].dataType), F.col("value"))
        else:
            fields = [V(from_spark(f.dataType), _as(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema.fields]
            kind = Tuple(tuple(f.name for f in df.schema.fields), tuple(f.type for f in fields))
            self.input = V(kind, F.struct(*[f.col.alias(n) for f, n in zip(fields, kind.names)]), items=fields)
        env: dict = {"input": self.input}
        for name in ("stdout", "stderr"):
            env[name] = self._table(name, Table(name, (), (), STRING, None))
        env["output"] = self._table("output", Table("output", (), (), BYTES, None))
        self.env = env

    # Types

    def type(self, n: Node):
        if n.kind == "named":
            if n.name not in self.types:
                raise TypeProblem(f"line {n.line}: no type {n.name}")
            return self.types[n.name]
        if n.kind == "array":
            return Array(self.type(n.of))
        if n.kind == "map":
            return Map(self.type(n.key), self.type(n.value))
        if n.kind == "tuple":
            return Tuple(tuple(name or f"_{i}" for i, (name, _) in enumerate(n.members)), tuple(self.type(t) for _, t in n.members))
        if n.kind == "function":
            return Function(tuple((name, self.type(t)) for name, t in n.params), self.type(n.result) if n.result else None)
        if n.kind == "table":
            return self._table_type(n)
        raise TypeProblem(f"line {n.line}: no type")

    def _table_type(self, n: Node) -> Table:
        if n.options:
            warnings.warn(f"line {n.line}: {', '.join(n.options)} of a table is read and not applied; sinks say where results go", stacklevel=2)
        how = AGGREGATORS.get(n.name)
        if how is None:
            raise TypeProblem(f"line {n.line}: no aggregator {n.name}")
        params = []
        for p in n.params:
            v = self.expr(p, {**self.env}, Path(Frame(None, self._names)))
            if v.const is _NONE:
                raise TypeProblem(f"line {n.line}: parameters of tables are constants")
            params.append(v.const)
        if not how.params <= len(params) <= how.params + how.optional:
            raise TypeProblem(f"line {n.line}: {n.name} takes {how.params} parameters")
        index = tuple((name, self.type(t)) for name, t in n.index)
        if any(not isinstance(t, Scalar) for _, t in index):
            raise TypeProblem(f"line {n.line}: an index is a scalar")
        name, value = n.value[0], self.type(n.value[1])
        members = value.types if isinstance(value, Tuple) else (value,)
        if how.of and (isinstance(value, Tuple) and not how.by_member or any(str(m) not in how.of for m in members)):
            raise TypeProblem(f"line {n.line}: no {n.name} of {value}")
        if (n.weight is None) != (how.weight is None):
            raise TypeProblem(f"line {n.line}: {n.name} {'needs' if how.weight else 'takes no'} weight")
        weight = self.type(n.weight[1]) if n.weight else None
        if weight is not None and not assignable(SCALARS[how.weight], weight):
            raise TypeProblem(f"line {n.line}: the weight of {n.name} is {how.weight}")
        return Table(n.name, tuple(params), index, value if name is None or isinstance(value, Tuple) else _Named(name, value), weight)

    def _table(self, name: str, t: Table) -> Table:
        value = t.value.type if isinstance(t.value, _Named) else t.value
        if isinstance(value, Tuple):
            values = [(n, spark_type(m)) for n, m in zip(value.names, value.types)]
        else:
            values = [(t.value.name if isinstance(t.value, _Named) else "value", spark_type(value))]
        index, taken = [], {v for v, _ in values}
        for i, (n, x) in enumerate(t.index):
            n = n if n and n not in taken else f"key{i}"
            taken.add(n)
            index.append((n, spark_type(x)))
        self.specs[name] = TableSpec(t.aggregator, t.params, index, values, spark_type(t.weight) if t.weight else None, t.weight is not None)
        self.tables[name] = t = replace(t, value=value)
        return t

    # Statements

    def program(self, text: str) -> None:
        path = Path(self.top)
        for n in parse(text, self.include):
            self.statement(n, self.env, path)

    def statement(self, n: Node, env: dict, path: Path) -> None:
        getattr(self, f"_do_{n.kind}")(n, env, path)

    def _do_empty(self, n, env, path):
        pass

    def _do_proto(self, n, env, path):
        if n.file not in self.protos:
            raise TypeProblem(f"line {n.line}: no proto {n.file}")
        self.types |= self.protos[n.file]

    def _do_type(self, n, env, path):
        self.types[n.name] = self.type(n.type)

    def _do_static(self, n, env, path):
        if n.decl.value is not None and uses(n.decl.value, "input"):
            raise TypeProblem(f"line {n.line}: a static value does not depend on input")
        self._do_decl(n.decl, env, path)

    def _do_decl(self, n, env, path):
        if n.name in self.types:
            raise TypeProblem(f"line {n.line}: {n.name} is a type")
        if n.name in env and env[n.name] is not self.env.get(n.name, _NONE) or n.name in self.env and env is self.env and n.name not in ("input",):
            raise TypeProblem(f"line {n.line}: {n.name} is declared already")
        t = self.type(n.type) if n.type is not None else None
        if isinstance(t, Table):
            env[n.name] = self._table(n.name, t)
            return
        if n.value is None and t is None:
            raise TypeProblem(f"line {n.line}: {n.name} needs a type or a value")
        if n.value is None:
            env[n.name] = V(t, F.lit(None).cast(spark_type(t)))
            return
        if n.value.kind == "function":
            closure = Closure(n.value, env)
            env[n.name] = closure
            return
        v = self.expr(n.value, env, path)
        if isinstance(v, Closure):
            env[n.name] = v
            return
        env[n.name] = path.frame.bind(self.coerce(v, t, n.line) if t is not None else v)

    def _do_assign(self, n, env, path):
        if n.target.kind == "index":
            return self._assign_index(n, env, path)
        old = self._variable(n.target, env)
        self._set(n.target.name, self.coerce(self.expr(n.value, env, path), old.type, n.line), env, path)

    def _assign_index(self, n, env, path):
        """A new array or map with one element replaced."""
        old = self._variable(n.target.of, env)
        key = self.expr(n.target.index, env, path)
        if isinstance(old.type, Map):
            value = self.coerce(self.expr(n.value, env, path), old.type.value, n.line)
            one = F.create_map(self.coerce(key, old.type.key, n.line).col, value.col)
            made = F.map_concat(F.map_filter(old.col, lambda k, _: k != key.col), one)
        elif isinstance(old.type, Array):
            value = self.coerce(self.expr(n.value, env, path), old.type.of, n.line)
            made = F.transform(old.col, lambda x, i: F.when(i == key.col, value.col).otherwise(x))
        else:
            raise TypeProblem(f"line {n.line}: {old.type} has no elements to assign")
        self._set(n.target.of.name, V(old.type, made), env, path)

    def _do_step(self, n, env, path):
        old = self._variable(n.target, env)
        if old.type != INT:
            raise TypeProblem(f"line {n.line}: {n.op} is for int")
        self._set(n.target.name, V(INT, old.col + (1 if n.op == "++" else -1)), env, path)

    def _variable(self, n: Node, env: dict) -> V:
        if n.kind != "name" or not isinstance(env.get(n.name), V):
            raise TypeProblem(f"line {n.line}: no variable to assign")
        return env[n.name]

    def _set(self, name: str, v: V, env: dict, path: Path) -> None:
        if path.stopped is not None:
            v = V(v.type, F.when(path.stopped, env[name].col).otherwise(v.col))
        env[name] = path.frame.bind(v)

    def _do_expr(self, n, env, path):
        v = self.expr(n.value, env, path)
        if n.value.kind == "call" and n.value.of.kind == "name" and n.value.of.name == "assert" and path.frame.df is not None:
            live = path.live()
            holds = v.col if live is None else F.when(live, v.col).otherwise(True)
            path.frame.df = path.frame.df.where(F.coalesce(holds, F.lit(True)))

    def _do_block(self, n, env, path):
        inner = dict(env)
        for s in n.body:
            self._scoped(s, inner, path, env)
        for name in env:
            env[name] = inner[name] if name not in self._declared(n) else env[name]

    def _declared(self, n: Node) -> set[str]:
        return {s.name for s in n.body if s.kind == "decl"} | {s.decl.name for s in n.body if s.kind == "static"}

    def _scoped(self, s: Node, inner: dict, path: Path, outer: dict) -> None:
        if s.kind == "decl" and s.name in outer and inner.get(s.name) is outer[s.name] and s.name not in self.types:
            inner.pop(s.name)  # an inner scope may use a name again
        self.statement(s, inner, path)

    def _branch(self, n: Node | None, env: dict, path: Path, test: Column) -> tuple[dict, Path]:
        inner, way = dict(env), replace(path, guard=_and(path.guard, test))
        if n is not None:
            self.statement(n if n.kind == "block" else Node("block", n.line, {"body": [n]}), inner, way)
        return inner, way

    def _do_if(self, n, env, path):
        test = self.expr(n.test, env, path)
        if test.type != BOOL:
            raise TypeProblem(f"line {n.line}: the condition of if is bool, not {test.type}")
        test = path.frame.bind(test)
        self._merge(env, path, test.col, n.then, n.other)

    def _merge(self, env: dict, path: Path, test: Column, then: Node, other: Node | None) -> None:
        yes, way = self._branch(then, env, path, test)
        path.stopped, path.value = way.stopped, way.value
        no, way = self._branch(other, env, path, ~test)
        path.stopped, path.value = way.stopped, way.value
        for name, old in env.items():
            if isinstance(old, V) and (yes[name] is not old or no[name] is not old):
                env[name] = path.frame.bind(V(old.type, F.when(test, yes[name].col).when(~test, no[name].col).otherwise(old.col)))

    def _do_switch(self, n, env, path):
        of = path.frame.bind(self.expr(n.of, env, path))
        nodes = n.default
        for labels, body in reversed(n.cases):
            tests = [Node("binary", n.line, {"op": "==", "left": Node("bound", n.line, {"v": of}), "right": x}) for x in labels]
            test = tests[0]
            for t in tests[1:]:
                test = Node("binary", n.line, {"op": "or", "left": test, "right": t})
            nodes = Node("if", n.line, {"test": test, "then": body, "other": nodes})
        self.statement(nodes, env, path)

    def _do_return(self, n, env, path):
        here = path.live()
        here = F.lit(True) if here is None else F.coalesce(here, F.lit(False))
        if n.value is not None:
            v = self.expr(n.value, env, path)
            if path.value is None:
                path.value = V(v.type, F.when(here, v.col))
            else:
                t = path.value.type
                path.value = V(t, F.when(here, self.coerce(v, t, n.line).col).otherwise(path.value.col))
        path.stopped = here if path.stopped is None else path.stopped | here

    _do_result = _do_return

    def _do_continue(self, n, env, path):
        here = path.live()
        here = F.lit(True) if here is None else F.coalesce(here, F.lit(False))
        path.stopped = here if path.stopped is None else path.stopped | here

    def _do_break(self, n, env, path):
        raise Unsupported("break")

    def _do_while(self, n, env, path):
        raise Unsupported("while")

    _do_do = _do_while

    def _do_for(self, n, env, path):
        name, steps = self._counts(n, env, path)
        carried = assigned(n.body) - {name}
        if mentions(n.body, "break") or name in assigned(n.body):
            raise Unsupported("a loop that is left or changes its variable")
        if carried & {k for k, v in env.items() if isinstance(v, V)}:
            if mentions(n.body, "emit", "return", "result"):
                raise Unsupported("a loop that carries values and emits")
            return self._fold(n, name, steps, sorted(c for c in carried if isinstance(env.get(c), V)), env, path)
        inner, child = self._exploded(env, path, {name: (INT, steps, self._elements(n, name, env))})
        self.statement(n.body, inner, child)

    def _elements(self, n: Node, name: str, env: dict) -> Node | None:
        """The array that a loop runs over from its first element to its last, if it does just that."""
        limit, start = n.test.right, n.first.value
        whole = n.test.op == "<" and n.step.kind == "step" and n.step.op == "++" and start.kind == "literal" and start.value == 0
        if whole and limit.kind == "call" and limit.of.kind == "name" and limit.of.name == "len" and "len" not in env and len(limit.args) == 1:
            return limit.args[0]
        return None

    def _counts(self, n: Node, env: dict, path: Path) -> tuple[str, Column]:
        """The variable of a counting loop and the array of its values."""
        first, test, step = n.first, n.test, n.step
        if first is None or test is None or step is None or first.kind not in ("decl", "assign") or test.kind != "binary":
            raise Unsupported("a loop that does not count")
        name = first.name if first.kind == "decl" else first.target.name
        by = None
        if step.kind == "step" and step.target.kind == "name" and step.target.name == name:
            by = 1 if step.op == "++" else -1
        elif step.kind == "assign" and step.target.kind == "name" and step.target.name == name and step.value.kind == "binary" and step.value.left.kind == "name" and step.value.left.name == name:
            k = self.expr(step.value.right, env, path)
            if k.const is not _NONE and step.value.op in "+-":
                by = k.const if step.value.op == "+" else -k.const
        if not by or not isinstance(by, int) or test.left.kind != "name" or test.left.name != name or test.op not in (("<", "<=") if by > 0 else (">", ">=")) or uses(test.right, name):
            raise Unsupported("a loop that does not count")
        start = self.coerce(self.expr(first.value, env, path), INT, n.line).col
        limit = self.coerce(self.expr(test.right, env, path), INT, n.line).col
        last = limit - (1 if by > 0 else -1) if test.op in ("<", ">") else limit
        some = start <= last if by > 0 else start >= last
        return name, F.when(some, F.sequence(start.cast("long"), last.cast("long"), F.lit(by).cast("long")))

    def _exploded(self, env: dict, path: Path, names: dict) -> tuple[dict, Path]:
        """A frame with a row for each value of the arrays, of the rows that get here.

        ``names``: type, values, and the node of the array whose indices they all are, if there is
        one: then its elements come along, and no row needs the whole array.
        """
        if path.frame.df is None:
            raise Unsupported("rows from inside a value")
        df, live = path.frame.df, path.live()
        if live is not None:
            df = df.where(live)
        child, inner = Frame(df, self._names), dict(env)
        for name, (t, values, of) in names.items():
            key = _chain(of, inner) if of is not None else None
            array = self.expr(of, inner, Path(child)) if key else None
            if array is not None and isinstance(array.type, Array):
                at, element = f"__v{next(self._names)}", f"__v{next(self._names)}"
                child.df = child.df.select("*", F.posexplode(array.col).alias(at, element))
                inner[name] = V(INT, F.col(at).cast("long"))
                inner["[]", key, name] = inner[key[0]], inner[name], V(array.type.of, F.col(element))
            else:
                column = f"__v{next(self._names)}"
                child.df = child.df.withColumn(column, F.explode(values))
                inner[name] = V(t, F.col(column))
        return inner, Path(child)

    def _fold(self, n: Node, name: str, steps: Column, carried: list[str], env: dict, path: Path) -> None:
        kinds = {c: spark_type(env[c].type) for c in carried}
        start = F.struct(*[env[c].col.cast(kinds[c]).alias(c) for c in carried])

        def turn(state: Column, i: Column) -> Column:
            inner = dict(env) | {c: V(env[c].type, state[c]) for c in carried} | {name: V(INT, i)}
            way = Path(Frame(None, self._names))
            self.statement(n.body if n.body.kind == "block" else Node("block", n.line, {"body": [n.body]}), inner, way)
            return F.struct(*[inner[c].col.cast(kinds[c]).alias(c) for c in carried])

        done = path.frame.bind(V(ANY, F.aggregate(F.coalesce(steps, F.array().cast("array<bigint>")), start, turn)))
        for c in carried:
            self._set(c, V(env[c].type, done.col[c]), env, path)

    def _do_when(self, n, env, path):
        ranges = {v: self._range(v, n, env, path) for v, _, _ in n.names}
        each = {v: (*ranges[v], self._ranged(v, n)) for v, kind, _ in n.names if kind == "each"}
        inner, child = self._exploded(env, path, each) if each else (dict(env), replace(path))
        rest = [(v, kind) for v, kind, _ in n.names if kind != "each"]

        def holds(left: list, scope: dict) -> Column:
            if not left:
                test = self.expr(n.test, scope, Path(Frame(None, self._names)))
                if test.type != BOOL:
                    raise TypeProblem(f"line {n.line}: the condition of when is bool")
                return test.col
            (v, kind), t_values = left[0], ranges[left[0][0]]
            how = F.exists if kind == "some" else F.forall
            return how(t_values[1], lambda x: holds(left[1:], scope | {v: V(t_values[0], x)}))

        guard = holds(rest, inner)
        for i, (v, kind) in enumerate(rest):
            t, values = ranges[v]
            if kind == "some":
                left, scope = rest[i + 1 :], dict(inner)
                found = F.filter(values, lambda x: holds(left, scope | {v: V(t, x)}))
                inner[v] = child.frame.bind(V(t, F.get(found, 0)))
            else:
                inner[v] = V(t, F.lit(None).cast(spark_type(t)))
        if each:
            child.frame.df = child.frame.df.where(guard)
            self.statement(n.body, inner, child)
            if assigned(n.body) & {k for k, x in env.items() if isinstance(x, V)}:
                raise Unsupported("when each that carries values")
            return
        guard = child.frame.bind(V(BOOL, guard)).col
        scope = dict(inner)
        way = replace(path, guard=_and(path.guard, guard))
        self.statement(n.body if n.body.kind == "block" else Node("block", n.line, {"body": [n.body]}), scope, way)
        for name, old in env.items():
            if isinstance(old, V) and scope.get(name) is not old:
                env[name] = path.frame.bind(V(old.type, F.when(guard, scope[name].col).otherwise(old.col)))

    def _range(self, v: str, n: Node, env: dict, path: Path) -> tuple:
        """The values of a quantified variable: the indices of what it indexes."""
        values = self.expr(self._ranged(v, n), env, path)
        if isinstance(values.type, Map):
            return values.type.key, F.map_keys(values.col)
        size = self.registry.find("len", [values.type]).build(values.col)
        return INT, F.when(size > 0, F.sequence(F.lit(0).cast("long"), size - 1)).otherwise(F.array().cast("array<bigint>"))

    def _ranged(self, v: str, n: Node) -> Node:
        """What a quantified variable indexes."""

        def search(x):
            if isinstance(x, (list, tuple)):
                return next((f for f in map(search, x) if f is not None), None)
            if not isinstance(x, Node):
                return None
            if x.kind == "index" and x.index.kind == "name" and x.index.name == v or x.kind == "slice" and any(b.kind == "name" and b.name == v for b in (x.first, x.last)):
                return x.of
            return next((f for f in map(search, x.at.values()) if f is not None), None)

        of = search(n.test) or search(n.body)
        if of is None:
            raise TypeProblem(f"line {n.line}: nothing says what {v} ranges over")
        return of

    def _do_emit(self, n, env, path):
        t = env.get(n.table)
        if not isinstance(t, Table):
            raise TypeProblem(f"line {n.line}: no table {n.table}")
        if len(n.index) != len(t.index):
            raise TypeProblem(f"line {n.line}: {n.table} has {len(t.index)} indices")
        if path.frame.df is None:
            raise Unsupported("emit inside a value")
        index = [self._assignable(self.expr(i, env, path), x, n.line) for i, (_, x) in zip(n.index, t.index)]
        value = self.expr(n.value, env, path)
        if isinstance(t.value, Tuple):
            if value.items is not None:
                if len(value.items) != len(t.value.types):
                    raise TypeProblem(f"line {n.line}: {n.table} has {len(t.value.types)} members")
                values = [self._assignable(v, x, n.line) for v, x in zip(value.items, t.value.types)]
            else:
                whole = self._assignable(value, t.value, n.line)
                names = value.type.names if isinstance(value.type, Tuple) else t.value.names
                values = [V(x, whole.col[m]) for m, x in zip(names, t.value.types)]
        else:
            values = [self._assignable(value, t.value, n.line)]
        if (n.weight is None) != (t.weight is None):
            raise TypeProblem(f"line {n.line}: {n.table} {'needs' if t.weight else 'takes no'} weight")
        weight = self._assignable(self.expr(n.weight, env, path), t.weight, n.line).col if n.weight is not None else None
        live = path.live()
        self.sites.setdefault(n.table, []).append((path.frame, [i.col for i in index], [v.col for v in values], weight, live))

    def _assignable(self, v: V, t, line: int) -> V:
        if not assignable(t, v.type):
            raise TypeProblem(f"line {line}: {v.type} where {t} is due")
        return self.coerce(v, t, line)

    # Values

    def coerce(self, v: V, t, line: int) -> V:
        """``v`` as a ``t``: assigned if it can be, converted by the function named after the type if there is one."""
        if v.type == t or t == ANY:
            return v
        if isinstance(t, Tuple) and v.items is not None and len(v.items) == len(t.types):
            items = [self.coerce(i, x, line) for i, x in zip(v.items, t.types)]
            return V(t, F.struct(*[i.col.alias(n) for i, n in zip(items, t.names)]), items=items)
        if isinstance(t, Array) and v.items is not None:
            items = [self.coerce(i, t.of, line) for i in v.items]
            return V(t, F.array(*[i.col for i in items]).cast(spark_type(t)), items=items)
        if assignable(t, v.type):
            const = float(v.const) if t == FLOAT and v.const is not _NONE else v.const
            return V(t, v.col.cast(spark_type(t)), const)
        if isinstance(t, Scalar):
            try:
                return self._apply(t.name, [v], line)
            except TypeProblem:
                pass
        raise TypeProblem(f"line {line}: {v.type} where {t} is due")

    def expr(self, n: Node, env: dict, path: Path) -> V:
        return getattr(self, f"_of_{n.kind}")(n, env, path)

    def _of_bound(self, n, env, path):
        return n.v

    def _of_literal(self, n, env, path):
        t, value = SCALARS[n.type], n.value
        if t == TIME and isinstance(value, str):
            return self._apply("time", [V(STRING, F.lit(value), value)], n.line)
        if t in (INT, TIME, FINGERPRINT):
            value = value - (1 << 64) if value >= 1 << 63 else value
            return V(t, F.lit(value).cast("long"), value)
        return V(t, F.lit(bytearray(value) if t == BYTES else value), value)

    def _of_name(self, n, env, path):
        if n.name in env:
            v = env[n.name]
            if isinstance(v, Table):
                raise TypeProblem(f"line {n.line}: {n.name} is a table")
            return v
        found = self.registry.constant(n.name)
        if found:
            return V(found[0], F.lit(found[1]), found[1])
        raise TypeProblem(f"line {n.line}: no {n.name}")

    def _of_function(self, n, env, path):
        return Closure(n, env)

    def _of_length(self, n, env, path):
        if not self.lengths:
            raise TypeProblem(f"line {n.line}: $ stands in an index only")
        of = self.lengths[-1]
        return V(INT, self.registry.find("len", [of.type]).build(of.col))

    def _of_list_of(self, n, env, path):
        items = [self.expr(i, env, path) for i in n.items]
        if not items:
            return V(Array(ANY), F.array().cast("array<string>"), items=items)
        if all(assignable(items[0].type, i.type) for i in items):
            t = items[0].type
            return V(Array(t), F.array(*[i.col.cast(spark_type(t)) for i in items]), items=items)
        names = tuple(f"_{i}" for i in range(len(items)))
        return V(Tuple(names, tuple(i.type for i in items)), F.struct(*[i.col.alias(m) for m, i in zip(names, items)]), items=items)

    def _of_map_of(self, n, env, path):
        if not n.pairs:
            return V(Map(ANY, ANY), F.create_map().cast("map<string,string>"))
        pairs = [(self.expr(k, env, path), self.expr(v, env, path)) for k, v in n.pairs]
        kt, vt = pairs[0][0].type, pairs[0][1].type
        if not all(assignable(kt, k.type) and assignable(vt, v.type) for k, v in pairs):
            raise TypeProblem(f"line {n.line}: keys and values of a map have one type each")
        kc, vc = spark_type(kt), spark_type(vt)
        # the last of equal keys counts
        last = {k.const if k.const is not _NONE else id(k): (k, v) for k, v in pairs}
        return V(Map(kt, vt), F.create_map(*[c for k, v in last.values() for c in (k.col.cast(kc), v.col.cast(vc))]))

    def _of_unary(self, n, env, path):
        v = self.expr(n.of, env, path)
        if n.op == "!":
            if v.type != BOOL:
                raise TypeProblem(f"line {n.line}: not is for bool")
            return V(BOOL, ~v.col)
        if v.type not in ((INT,) if n.op == "~" else (INT, FLOAT)):
            raise TypeProblem(f"line {n.line}: no {n.op} of {v.type}")
        if n.op == "~":
            return V(INT, F.bitwise_not(v.col))
        if n.op == "+":
            return v
        return V(v.type, -v.col, _NONE if v.const is _NONE else -v.const)

    def _of_binary(self, n, env, path):
        a, b, op = self.expr(n.left, env, path), self.expr(n.right, env, path), n.op
        if op in ("and", "or"):
            if a.type != BOOL or b.type != BOOL:
                raise TypeProblem(f"line {n.line}: {op} is for bool")
            return V(BOOL, a.col & b.col if op == "and" else a.col | b.col)
        if op in ("==", "!=", "<", "<=", ">", ">="):
            if not comparable(a.type, b.type):
                raise TypeProblem(f"line {n.line}: {a.type} and {b.type} do not compare")
            x, y = a.col, b.col
            return V(BOOL, {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op])
        if op == "+" and (a.type, b.type) in ((STRING, STRING), (BYTES, BYTES)):
            return V(a.type, F.concat(a.col, b.col))
        if op == "+" and isinstance(a.type, Array) and assignable(a.type, b.type):
            return V(a.type, F.concat(a.col, b.col.cast(spark_type(a.type))))
        if op in ("&", "|", "^", "<<", ">>"):
            if a.type not in (INT, FINGERPRINT) or b.type not in (INT, FINGERPRINT):
                raise TypeProblem(f"line {n.line}: {op} is for int")
            if op in ("<<", ">>"):
                return V(a.type, F.call_function("shiftleft" if op == "<<" else "shiftright", a.col, b.col.cast("int")))
            return V(a.type, {"&": a.col.bitwiseAND, "|": a.col.bitwiseOR, "^": a.col.bitwiseXOR}[op](b.col))
        t = arithmetic(a.type, b.type)
        x, y = (a.col.cast("double"), b.col.cast("double")) if t == FLOAT else (a.col, b.col)
        const = _NONE
        if op in "+-*" and a.const is not _NONE and b.const is not _NONE:
            const = {"+": lambda: a.const + b.const, "-": lambda: a.const - b.const, "*": lambda: a.const * b.const}[op]()
        if op == "/":
            col = F.try_divide(x, y) if t == FLOAT else F.call_function("div", x, F.when((y != 0) & ~((y == -1) & (x == -(1 << 63))), y))
        elif op == "%":
            col = F.try_mod(x, y)
        else:
            col = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
        return V(t, col, const)

    def _of_field(self, n, env, path):
        of = self.expr(n.of, env, path)
        if not isinstance(of.type, Tuple) or n.name not in of.type.names:
            raise TypeProblem(f"line {n.line}: no member {n.name} of {of.type}")
        i = of.type.names.index(n.name)
        return of.items[i] if of.items is not None else V(of.type.types[i], of.col.getField(n.name))

    def _indexed(self, n: Node, of: V, env: dict, path: Path) -> V:
        self.lengths.append(of)
        try:
            return self.expr(n, env, path)
        finally:
            self.lengths.pop()

    def _of_index(self, n, env, path):
        if n.index.kind == "name" and (key := _chain(n.of, env)) and ("[]", key, n.index.name) in env:
            base, at, element = env["[]", key, n.index.name]
            if env[key[0]] is base and env[n.index.name] is at:
                return element
        of = self.expr(n.of, env, path)
        i = self._indexed(n.index, of, env, path)
        if isinstance(of.type, Map):
            if not assignable(of.type.key, i.type):
                raise TypeProblem(f"line {n.line}: {i.type} is no key of {of.type}")
            return V(of.type.value, F.call_function("try_element_at", of.col, i.col.cast(spark_type(of.type.key))))
        if i.type != INT:
            raise TypeProblem(f"line {n.line}: an index is int, not {i.type}")
        if isinstance(of.type, Array):
            return V(of.type.of, F.get(of.col, i.col.cast("int")))
        if of.type in (STRING, BYTES):
            size = F.octet_length(of.col) if of.type == BYTES else F.length(of.col)
            return V(of.type, F.when((i.col >= 0) & (i.col < size), F.substring(of.col, (i.col + 1).cast("int"), F.lit(1))))
        raise TypeProblem(f"line {n.line}: {of.type} has no elements")

    def _of_slice(self, n, env, path):
        of = self.expr(n.of, env, path)
        a, b = self._indexed(n.first, of, env, path), self._indexed(n.last, of, env, path)
        if a.type != INT or b.type != INT:
            raise TypeProblem(f"line {n.line}: the ends of a slice are int")
        first, size = F.greatest(a.col, F.lit(0)), F.greatest(b.col - F.greatest(a.col, F.lit(0)), F.lit(0))
        if isinstance(of.type, Array):
            return V(of.type, F.slice(of.col, (first + 1).cast("int"), size.cast("int")))
        if of.type in (STRING, BYTES):
            return V(of.type, F.substring(of.col, (first + 1).cast("int"), size.cast("int")))
        raise TypeProblem(f"line {n.line}: {of.type} has no elements")

    def _of_block_value(self, n, env, path):
        return self._value_of(n.body, dict(env), path, None, n.line)

    def _of_call(self, n, env, path):
        if n.of.kind == "name" and not isinstance(env.get(n.of.name), Closure):
            name = n.of.name
            if name == "regex":
                return self._regex(n, env, path)
            if name == "convert" and n.args and n.args[0].kind == "name":
                return self._apply(n.args[0].name, [self.expr(a, env, path) for a in n.args[1:]], n.line)
            return self._apply(name, [self.expr(a, env, path) for a in n.args], n.line)
        f = self.expr(n.of, env, path)
        if not isinstance(f, Closure):
            raise TypeProblem(f"line {n.line}: no function to call")
        t = self.type(f.node.type)
        if len(n.args) != len(t.params):
            raise TypeProblem(f"line {n.line}: the function takes {len(t.params)} arguments")
        inner = dict(f.env)
        for a, (name, x) in zip(n.args, t.params):
            v = self.expr(a, env, path)
            inner[name] = v if isinstance(v, Closure) else path.frame.bind(self._assignable(v, x, n.line))
        return self._value_of(f.node.body, inner, path, t.result, n.line)

    def _value_of(self, body: Node, env: dict, path: Path, t, line: int) -> V:
        """The value that a block returns, its statements inlined."""
        self.depth += 1
        if self.depth > 40:
            raise Unsupported("recursion")
        try:
            way = Path(path.frame)
            for s in body.body:
                if s.kind == "decl":
                    env.pop(s.name, None)
                self.statement(s, env, way)
        finally:
            self.depth -= 1
        if way.value is None:
            if t is not None:
                raise TypeProblem(f"line {line}: nothing is returned")
            return V(BOOL, F.lit(None).cast("boolean"))
        return path.frame.bind(self.coerce(way.value, t, line) if t is not None else way.value)

    def _apply(self, name: str, args: list[V], line: int) -> V:
        if any(isinstance(a, Closure) for a in args):
            raise TypeProblem(f"line {line}: {name} takes no functions")
        try:
            how = self.registry.find(name, [a.type for a in args])
        except TypeProblem as problem:
            raise TypeProblem(f"line {line}: {problem}") from None
        columns = []
        for i, a in enumerate(args):
            p = how.params[min(i, len(how.params) - 1)]
            if how.literal and a.const is not _NONE and i == 0:
                columns.append(a.const)
            elif p == FLOAT and a.type == INT:
                columns.append(a.col.cast("double"))
            elif name == "lookup" and i and isinstance(args[0].type, Map):
                columns.append(a.col.cast(spark_type(args[0].type.key if i == 1 else args[0].type.value)))
            else:
                columns.append(a.col)
        t = how.result([a.type for a in args]) if callable(how.result) else how.result
        return V(t, how.build(*columns))

    def _regex(self, n: Node, env: dict, path: Path) -> V:
        """The pattern of a type's texts: regex(int), regex(int, 16), …"""
        base = self.expr(n.args[1], env, path).const if len(n.args) > 1 else None
        arg = n.args[0]
        if arg.kind != "name" or arg.name not in self.types:
            raise TypeProblem(f"line {n.line}: regex takes a type")
        t = self.types[arg.name]
        pattern = PATTERNS.get((str(t), base))
        if pattern is None:
            raise TypeProblem(f"line {n.line}: no pattern for {t}")
        return V(STRING, F.lit(pattern), pattern)

    def results(self, emits: str | None = None) -> dict[str, DataFrame]:
        """Each table that something is emitted to."""
        sites = {name: [EmitSite(f.df, i, v, w, g) for f, i, v, w, g in some] for name, some in self.sites.items()}
        if emits and sites:
            return staged(self.specs, sites, emits)
        return {name: result(self.specs[name], some) for name, some in sites.items()}


#: The patterns of the language's literals, by type and base.
PATTERNS = {
    ("int", 16): r"(0x)?[A-Fa-f0-9]+h?",
    ("int", 10): r"[+-]?[0-9]+",
    ("int", 8): r"0[0-7]+",
    ("int", None): r"[+-]?[0-9]+",
    ("string", None): r"\S+",
    ("time", None): r"[0-9]+",
    ("fingerprint", None): r"[0-9]+",
    ("float", None): r"[-+]?[0-9]*\.?[0-9]+(e[-+]?[0-9]+)?",
}


@dataclass(frozen=True)
class _Named:
    name: str
    type: object


def _as(c: Column, t) -> Column:
    """A source column as the language has it: whole numbers as longs, times as microseconds."""
    name = t.typeName()
    if name in ("byte", "short", "integer"):
        return c.cast("long")
    if name == "float" or name == "decimal":
        return c.cast("double")
    if name == "timestamp_ntz":
        return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), c).cast("timestamp"))
    if name == "timestamp":
        return F.unix_micros(c)
    if name == "date":
        return F.unix_date(c).cast("long") * 86_400_000_000
    return c


def compile_program(text: str, df: DataFrame, registry: Registry = BUILTIN, protos: dict | None = None, include=None, emits: str | None = None) -> dict[str, DataFrame]:
    """The result of each table of a program over the records of ``df``.

    ``df``: lines in a string column ``value``, or any rows, whose columns are the members of input.
    The emits of a table over the same rows are one pass over them. ``emits``, a shared folder that
    does not exist yet: all tables' emits are written there first, so the input is read once for all
    tables, and each table reads its own emits.
    """
    compiler = Compiler(df, registry, protos, include)
    try:
        compiler.program(text)
    except Unsupported:
        from .interpreter import interpreted

        return interpreted(text, df, registry, protos, include)
    return compiler.results(emits)
