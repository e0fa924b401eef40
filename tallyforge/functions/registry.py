"""Registry of functions: a name's overloads, each building a Column from Columns.

Undefined values are NULL: what fails for a record (a conversion, a lookup, an index) gives NULL
and never stops the job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..lang.types import ANY, TypeProblem, Varargs, assignable


@dataclass(frozen=True)
class Overload:
    params: tuple
    result: object  # a type, or a function of the arguments' types
    build: Callable
    literal: bool = False  # build gets Python values where arguments are constants


class Registry:
    def __init__(self, parent: Registry | None = None):
        self.parent = parent
        self.overloads: dict[str, list[Overload]] = {}
        self.constants: dict[str, tuple] = {}

    def add(self, name: str, params: list, result, build: Callable, literal: bool = False) -> None:
        self.overloads.setdefault(name, []).append(Overload(tuple(params), result, build, literal))

    def function(self, name: str, params: list, returns):
        """Decorator that registers a user's function from Columns to a Column (or a pandas UDF)."""

        def register(f):
            self.add(name, params, returns, f)
            return f

        return register

    def all(self, name: str) -> list[Overload]:
        return self.overloads.get(name, []) + (self.parent.all(name) if self.parent else [])

    def constant(self, name: str):
        return self.constants.get(name) or (self.parent.constant(name) if self.parent else None)

    def names(self) -> set[str]:
        return set(self.overloads) | (self.parent.names() if self.parent else set())

    def find(self, name: str, args: list) -> Overload:
        """Exact overloads first, then any that accepts the arguments, variadic ones last."""
        found = self.all(name)
        if not found:
            raise TypeProblem(f"no function {name}")
        fixed = [o for o in found if len(o.params) == len(args) and not any(isinstance(p, Varargs) for p in o.params)]
        for o in fixed:
            if all(p == a and p != ANY for p, a in zip(o.params, args)):
                return o
        for o in fixed:
            if all(map(_accepts, o.params, args)):
                return o
        for o in found:
            if o.params and isinstance(o.params[-1], Varargs):
                n = len(o.params) - 1
                if len(args) >= n and all(map(_accepts, o.params[:n], args)) and all(_accepts(o.params[-1].of, a) for a in args[n:]):
                    return o
        raise TypeProblem(f"no {name}({', '.join(map(str, args))})")


def _accepts(param, arg) -> bool:
    return param(arg) if callable(param) else assignable(param, arg)
