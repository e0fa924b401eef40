"""The fluent API: tables, emits, and their results.

    Program(df).table("t", "top", 3, index=["k"], value=["v"]).emit("t", index=[...], value=..., when=...).run()["t"]
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.aggregators import AGGREGATORS, AggregatorProblem, Emits


@dataclass
class TableSpec:
    """A table: its aggregator and parameters, and the names and types of its columns."""

    aggregator: str
    params: tuple = ()
    index: list[tuple[str, T.DataType | None]] = field(default_factory=list)
    values: list[tuple[str, T.DataType | None]] = field(default_factory=lambda: [("value", None)])
    weight: T.DataType | None = None
    weighted: bool = False
    exact: bool = True


@dataclass
class EmitSite:
    """Rows emitted from ``df``: where ``when`` holds, and index and values are defined."""

    df: DataFrame
    index: list[Column]
    values: list[Column]
    weight: Column | None = None
    when: Column | None = None


def _typed(c: Column, t: T.DataType | None) -> Column:
    return c if t is None else c.try_cast(t)


def result(spec: TableSpec, sites: list[EmitSite]) -> DataFrame:
    """The table's result. A site's rows with an undefined index or value are not emitted."""
    how = AGGREGATORS.get(spec.aggregator)
    if how is None:
        raise AggregatorProblem(f"no aggregator {spec.aggregator}")
    if not how.params <= len(spec.params) <= how.params + how.optional:
        raise AggregatorProblem(f"{spec.aggregator} takes {how.params} parameters")
    if not sites:
        raise AggregatorProblem("nothing is emitted to the table")
    df = reduce(lambda a, b: a.unionByName(b), [emitted(spec, some) for some in _by_frame(sites)])
    return how.plan(Emits(df, [n for n, _ in spec.index], [n for n, _ in spec.values], "weight" if spec.weighted else None, tuple(spec.params), spec.exact))


def _by_frame(sites: list[EmitSite]) -> list[list[EmitSite]]:
    """Sites over the same rows, together."""
    found: dict[int, list[EmitSite]] = {}
    for site in sites:
        found.setdefault(id(site.df), []).append(site)
    return list(found.values())


def _columns(spec: TableSpec, site: EmitSite) -> list[Column]:
    columns = [_typed(c, t).alias(n) for c, (n, t) in zip(site.index + site.values, spec.index + spec.values)]
    if spec.weighted:
        columns.append(_typed(site.weight if site.weight is not None else F.lit(None), spec.weight).alias("weight"))
    return columns


def emitted(spec: TableSpec, sites: list[EmitSite]) -> DataFrame:
    """The rows that sites over the same rows emit, in one pass; a lone site's guard can be pushed to the scan."""
    defined = [n for n, _ in spec.index + spec.values]
    if len(sites) == 1 or any(t is None for _, t in spec.index + spec.values):
        parts = [(s.df if s.when is None else s.df.where(s.when)).select(*_columns(spec, s)) for s in sites]
        df = reduce(lambda a, b: a.unionByName(b), parts)
    else:
        rows = [F.struct(*_columns(spec, s)) if s.when is None else F.when(s.when, F.struct(*_columns(spec, s))) for s in sites]
        df = sites[0].df.select(F.explode(F.array(*rows)).alias("__row")).where("__row is not null").select("__row.*")
    return df.where(reduce(lambda a, b: a & b, [F.col(f"`{n}`").isNotNull() for n in defined]))


def staged(specs: dict[str, TableSpec], sites: dict[str, list[EmitSite]], path: str) -> dict[str, DataFrame]:
    """The results of several tables, with their inputs read once: all emits are written under ``path``, by table."""
    spark = next(iter(sites.values()))[0].df.sparkSession
    all_ = [(name, site) for name, some in sites.items() for site in some]
    tags = {name: f"t{i}" for i, name in enumerate(sites)}
    kinds = {}
    for name, some in sites.items():
        fields = some[0].df.select(*_columns(specs[name], some[0])).schema
        kinds[name] = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    parts = []
    for group in _by_frame([site for _, site in all_]):
        rows = []
        for name, site in all_:
            if any(site is s for s in group):
                row = F.struct(F.lit(tags[name]).alias("__table"), *[(F.struct(*_columns(specs[n], site)) if n == name else F.lit(None)).cast(kinds[n]).alias(tags[n]) for n in sites])
                rows.append(row if site.when is None else F.when(site.when, row))
        parts.append(group[0].df.select(F.explode(F.array(*rows)).alias("__row")).where("__row is not null").select("__row.*"))
    reduce(lambda a, b: a.unionByName(b), parts).write.partitionBy("__table").parquet(path)
    written = spark.read.schema(T.StructType([T.StructField(tags[n], kinds[n]) for n in sites] + [T.StructField("__table", T.StringType())])).parquet(path)
    made = {}
    for name, spec in specs.items():
        if name in sites:
            df = written.where(F.col("__table") == tags[name]).select(f"{tags[name]}.*")
            names = [n for n, _ in spec.index + spec.values]
            n = len(spec.index)
            plain = replace(spec, index=[(c, None) for c in names[:n]], values=[(c, None) for c in names[n:]])
            made[name] = result(plain, [EmitSite(df, [F.col(f"`{c}`") for c in names[:n]], [F.col(f"`{c}`") for c in names[n:]], F.col("weight") if spec.weighted else None)])
    return made


class Program:
    def __init__(self, df: DataFrame):
        self.df = df
        self.specs: dict[str, TableSpec] = {}
        self.sites: dict[str, list[EmitSite]] = {}

    def let(self, **columns: Column) -> Program:
        """Name values for later emits."""
        self.df = self.df.withColumns(columns)
        return self

    def table(self, name: str, aggregator: str, *params, index: list[str] = (), value: list[str] | str = "value", weighted: bool = False, exact: bool = True) -> Program:
        values = [value] if isinstance(value, str) else list(value)
        self.specs[name] = TableSpec(aggregator, params, [(i, None) for i in index], [(v, None) for v in values], None, weighted, exact)
        return self

    def emit(self, name: str, value, index: list = (), weight=None, when: Column | None = None) -> Program:
        column = lambda c: F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)
        values = list(value) if isinstance(value, (list, tuple)) else [value]
        self.sites.setdefault(name, []).append(EmitSite(self.df, [column(i) for i in index], [column(v) for v in values], None if weight is None else column(weight), when))
        return self

    def explode(self, name: str, array: Column, position: str | None = None) -> Program:
        """Go on with a row per element."""
        if position:
            self.df = self.df.select("*", F.posexplode(array).alias(position, name))
        else:
            self.df = self.df.withColumn(name, F.explode(array))
        return self

    def run(self, emits: str | None = None) -> dict[str, DataFrame]:
        """Each table's result; with ``emits``, a folder that does not exist yet, the input is read once for all."""
        if emits:
            return staged(self.specs, {n: self.sites[n] for n in self.specs if n in self.sites}, emits)
        return {name: result(spec, self.sites.get(name, [])) for name, spec in self.specs.items()}
