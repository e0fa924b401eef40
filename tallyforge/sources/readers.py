"""Records from files: lines, rows with a schema, whole files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """One record per line, in the column ``value``."""
    return spark.read.text(list(paths))


def rows(spark: SparkSession, paths: str | Iterable[str], kind: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Rows whose columns are the members of input; kind: parquet, orc, json, csv, avro, …"""
    reader = spark.read.format(kind).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load([paths] if isinstance(paths, str) else list(paths))


def files(spark: SparkSession, *paths: str) -> DataFrame:
    """One record per file: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").load(list(paths))


def database(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A table of a database; partitionColumn, lowerBound, upperBound and numPartitions read it in parts."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def load_bytes(path: str, most: int = 64 << 20) -> bytes:
    """A small file's content, for values that do not depend on the record."""
    found = SparkSession.getActiveSession().read.format("binaryFile").load(path).select("length", "content").limit(2)
    sizes = [r[0] for r in found.select("length").collect()]
    if len(sizes) != 1 or sizes[0] > most:
        raise ValueError(f"{path}: one file of at most {most} bytes is loaded")
    return bytes(found.first()["content"])

