"""Types of the text language and their Spark types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


class TypeProblem(Exception):
    """A program that breaks a typing rule."""


class Unsupported(Exception):
    """A program that columns cannot express; the row interpreter takes it."""


@dataclass(frozen=True)
class Scalar:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Array:
    of: object

    def __str__(self) -> str:
        return f"array of {self.of}"


@dataclass(frozen=True)
class Map:
    key: object
    value: object

    def __str__(self) -> str:
        return f"map[{self.key}] of {self.value}"


@dataclass(frozen=True)
class Tuple:
    names: tuple[str, ...]
    types: tuple

    def __str__(self) -> str:
        return "{ " + ", ".join(f"{n}: {t}" for n, t in zip(self.names, self.types)) + " }"


@dataclass(frozen=True)
class Table:
    aggregator: str
    params: tuple
    index: tuple  # (name, type)
    value: object
    weight: object | None


@dataclass(frozen=True)
class Function:
    params: tuple  # (name, type)
    result: object | None


@dataclass(frozen=True)
class Varargs:
    of: object


ANY, BOOL, INT, FLOAT, STRING, BYTES, TIME, FINGERPRINT = map(Scalar, "any bool int float string bytes time fingerprint".split())
SCALARS = {t.name: t for t in (ANY, BOOL, INT, FLOAT, STRING, BYTES, TIME, FINGERPRINT)}
_SPARK = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(), "time": T.LongType(), "fingerprint": T.LongType(), "any": T.StringType()}


def spark_type(t) -> T.DataType:
    if isinstance(t, Scalar):
        return _SPARK[t.name]
    if isinstance(t, Array):
        return T.ArrayType(spark_type(t.of))
    if isinstance(t, Map):
        return T.MapType(spark_type(t.key), spark_type(t.value))
    if isinstance(t, Tuple):
        return T.StructType([T.StructField(n, spark_type(x)) for n, x in zip(t.names, t.types)])
    raise TypeProblem(f"{t} has no values")


def from_spark(t: T.DataType):
    """The language's type of a column, for records that are rows rather than lines."""
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TIME
    if isinstance(t, T.BinaryType):
        return BYTES
    if isinstance(t, T.ArrayType):
        return Array(from_spark(t.elementType))
    if isinstance(t, T.MapType):
        return Map(from_spark(t.keyType), from_spark(t.valueType))
    if isinstance(t, T.StructType):
        return Tuple(tuple(f.name for f in t.fields), tuple(from_spark(f.dataType) for f in t.fields))
    return STRING


def assignable(to, source) -> bool:
    if to == source or ANY in (to, source):
        return True
    if to == FLOAT and source == INT:
        return True
    if isinstance(to, Array) and isinstance(source, Array):
        return source.of is None or assignable(to.of, source.of)
    if isinstance(to, Map) and isinstance(source, Map):
        return source.key is None or (assignable(to.key, source.key) and assignable(to.value, source.value))
    if isinstance(to, Tuple) and isinstance(source, Tuple):
        return len(to.types) == len(source.types) and all(map(assignable, to.types, source.types))
    if isinstance(to, (Array, Map)) and isinstance(source, Tuple):
        return not source.types or isinstance(to, Array) and all(assignable(to.of, t) for t in source.types)
    if isinstance(to, Tuple) and isinstance(source, Array):
        return source.of is not None and all(assignable(t, source.of) for t in to.types)
    return False


def arithmetic(left, right):
    """The type of ``left op right`` for numbers and times."""
    pair = {left, right}
    if pair == {INT}:
        return INT
    if pair <= {INT, FLOAT}:
        return FLOAT
    if pair <= {INT, TIME}:
        return TIME
    raise TypeProblem(f"no arithmetic on {left} and {right}")


def comparable(left, right) -> bool:
    return left == right or {left, right} <= {INT, FLOAT} or {left, right} <= {INT, TIME} or {left, right} <= {INT, FINGERPRINT} or assignable(left, right) or assignable(right, left)
