"""Results as text lines, files, streams and log records."""

from __future__ import annotations

import logging
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that an aggregator adds beside its values.
_WEIGHTS, _HIDDEN = ("weight",), ("rank",)


def _shown(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    c = F.col(f"`{name}`")
    if kind == "array":
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("null"))), ", "), F.lit("]"))
    return F.coalesce(c.cast("string"), F.lit(""))


def rendered(df: DataFrame, name: str, index: list[str] = (), aggregator: str = "") -> DataFrame:
    """Lines ``name[key] = value``, with `` weight w``, and ``{ a, b }`` for tuples, in a column ``line``."""
    if aggregator in ("text", "stdout", "stderr", "output"):
        return df.select(F.concat(*[_shown(df, c) for c in df.columns]).alias("line"))
    values = [c for c in df.columns if c not in index and c not in _HIDDEN and c not in _WEIGHTS]
    key = F.concat(*[F.concat(F.lit("["), _shown(df, i), F.lit("]")) for i in index]) if index else F.lit("[]")
    if aggregator == "top":
        shown = F.concat(*[x for c in values for x in (_shown(df, c), F.lit(", "))], F.lit("0"))
    elif len(values) > 1:
        shown = F.concat(F.lit("{ "), F.concat_ws(", ", *[_shown(df, c) for c in values]), F.lit(" }"))
    else:
        shown = _shown(df, values[0])
    weight = F.concat(F.lit(" weight "), _shown(df, "weight")) if "weight" in df.columns else F.lit("")
    return df.select(key.alias("__key"), *([F.col("rank").alias("__rank")] if "rank" in df.columns else []), F.concat(F.lit(name), key, F.lit(" = "), shown, weight).alias("line"))


def ordered(lines: DataFrame) -> DataFrame:
    """Lines in the order of their keys, as a job's output has them."""
    keys = [c for c in ("__key", "__rank") if c in lines.columns]
    return lines.orderBy(*keys, "line").select("line") if keys else lines.select("line")


def write_text(df: DataFrame, path: str, name: str, index: list[str] = (), aggregator: str = "", mode: str = "errorifexists") -> None:
    ordered(rendered(df, name, index, aggregator)).write.mode(mode).text(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).format(kind).partitionBy(*partition_by).save(path)


def to_stream(df: DataFrame, stream=None, end: str = "\n") -> None:
    """Lines to a Python stream, partition by partition."""
    for row in df.toLocalIterator():
        print(row[0] if not isinstance(row[0], (bytes, bytearray)) else bytes(row[0]).decode("utf-8", "replace"), end=end, file=stream or sys.stdout)


def to_log(df: DataFrame, name: str = "tallyforge") -> None:
    """A log table's rows to Python's logging, at their levels."""
    log = logging.getLogger(name)
    for row in df.toLocalIterator():
        log.log(logging.getLevelName({"warn": "WARNING", "fatal": "CRITICAL"}.get(row["level"], row["level"].upper())), row[1])
