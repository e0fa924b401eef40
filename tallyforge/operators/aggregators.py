"""Aggregators: a table's emitted rows to its result.

An aggregator plans over a DataFrame of emits with the columns of ``Emits``. Every plan keeps
partial aggregation before the shuffle; none gathers a group without a bound of its own, and none
needs all rows, or all values, in one task: running sums go by ranges of values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class AggregatorProblem(Exception):
    """A table that its aggregator cannot have."""


@dataclass
class Emits:
    """Emitted rows: index columns, one column per member of the value, and the weight if there is one."""

    df: DataFrame
    index: list[str]
    values: list[str]
    weight: str | None = None
    params: tuple = ()
    exact: bool = True

    @property
    def value(self) -> str:
        if len(self.values) != 1:
            raise AggregatorProblem("this aggregator takes single values")
        return self.values[0]


@dataclass(frozen=True)
class Aggregator:
    name: str
    plan: Callable[[Emits], DataFrame]
    params: int = 0  # how many parameters it must have
    optional: int = 0
    weight: str | None = None  # the weight's type; None: it takes none
    weight_optional: bool = False
    of: tuple[str, ...] = ()  # types of single values it takes; empty: any
    by_member: bool = False  # a tuple is aggregated member by member


AGGREGATORS: dict[str, Aggregator] = {}


def aggregator(name: str, **how):
    """Decorator that registers an aggregator; also for users' own."""

    def register(plan):
        AGGREGATORS[name] = Aggregator(name, plan, **how)
        return plan

    return register


def grouped(df: DataFrame, index: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates by index; without an index, a row only if anything was emitted."""
    if index:
        return df.groupBy(*index).agg(*aggregates)
    one = df.groupBy(F.lit(0).alias("__all")).agg(*aggregates)
    return one.drop("__all")


def first_rows(df: DataFrame, index: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each index by ``order``, with their rank: limits before the shuffle."""
    if index:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*index).orderBy(*order))).where(F.col("rank") <= n)
    top = df.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def running_sums(df: DataFrame, index: list[str], value: str, weight: str, until: str, total: str) -> DataFrame:
    """Sums of ``weight`` up to each value within its index, and over the whole index.

    ``df`` has a row per index and value. Rows are dealt by ranges of (index, value), so a single
    large index takes many tasks; only one sum per index and range meets elsewhere.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *index, value).withColumn("__part", F.spark_partition_id())
    sums = dealt.groupBy(*index, "__part").agg(F.sum(weight).alias("__sum"))
    keys = [F.col(c) for c in index] or [F.lit(0)]
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).withColumn(total, F.sum("__sum").over(Window.partitionBy(*keys)))
    names = {c: f"__key{i}" for i, c in enumerate([*index, "__part"])}
    starts = starts.select(*[F.col(c).alias(a) for c, a in names.items()], "__before", total)
    same = F.lit(True)
    for c, a in names.items():
        same &= F.col(c).eqNullSafe(F.col(a))
    within = Window.partitionBy(*index, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = dealt.withColumn("__within", F.sum(weight).over(within)).join(starts, same)
    return joined.withColumn(until, F.col("__before") + F.col("__within")).drop("__part", "__within", "__before", *names.values())


def counted(e: Emits, weight: Column | None = None) -> DataFrame:
    """One row per index and value with its multiplicity ``__n``."""
    return e.df.groupBy(*e.index, e.value).agg(F.sum(F.lit(1) if weight is None else weight).cast("long").alias("__n"))


@aggregator("sum", of=("int", "float"), by_member=True)
def _sum(e: Emits) -> DataFrame:
    """Sum of each member; integers wrap as longs do only with ANSI mode off, and else are NULL on overflow."""
    return grouped(e.df, e.index, *[F.try_sum(v).alias(v) for v in e.values])


@aggregator("mean", of=("int", "float"), by_member=True)
def _mean(e: Emits) -> DataFrame:
    return grouped(e.df, e.index, *[F.avg(v).alias(v) for v in e.values])


def _extreme(e: Emits, largest: bool) -> DataFrame:
    """The n rows with the largest (smallest) weight; ties by the value as a string."""
    w = F.col(e.weight)
    text = [F.col(v).cast("string") for v in e.values]
    return first_rows(e.df.where(w.isNotNull()), e.index, [w.desc() if largest else w.asc(), *text], e.params[0]).select(*e.index, "rank", *e.values, e.weight)


@aggregator("maximum", params=1, weight="float")
def _maximum(e: Emits) -> DataFrame:
    return _extreme(e, True)


@aggregator("minimum", params=1, weight="float")
def _minimum(e: Emits) -> DataFrame:
    return _extreme(e, False)


@aggregator("top", params=1, weight="int", weight_optional=True)
def _top(e: Emits) -> DataFrame:
    """The n values with the largest summed weight (1 each without weights); ties by the value as a string."""
    w = F.coalesce(F.col(e.weight).cast("long"), F.lit(1)) if e.weight else F.lit(1)
    sums = e.df.groupBy(*e.index, *e.values).agg(F.sum(w).cast("long").alias("count"))
    text = [F.col(v).cast("string") for v in e.values]
    return first_rows(sums, e.index, [F.desc("count"), *text], e.params[0]).select(*e.index, "rank", *e.values, "count")


@aggregator("unique", optional=1)
def _unique(e: Emits) -> DataFrame:
    """How many distinct values; exact, or by HyperLogLog++ if asked for."""
    if not e.exact:
        return grouped(e.df, e.index, F.approx_count_distinct(F.struct(*e.values)).cast("long").alias("unique"))
    return grouped(e.df.select(*e.index, *e.values).distinct(), e.index, F.count(F.lit(1)).alias("unique"))


@aggregator("distinct", optional=1)
def _distinct(e: Emits) -> DataFrame:
    return e.df.select(*e.index, *e.values).distinct()


@aggregator("quantile", params=1, of=("int", "float"))
def _quantile(e: Emits) -> DataFrame:
    """n - 1 slots: slot k holds the smallest value at which the running count reaches k steps of total / (n - 1); a slot that a value jumps over is NULL."""
    n = e.params[0]
    if n < 2:
        raise AggregatorProblem("quantile needs 2 or more")
    sums = running_sums(counted(e), e.index, e.value, "__n", "__until", "__total")
    slot = F.floor(F.col("__until") / (F.col("__total") / F.lit(float(n - 1)))).cast("int")
    # the largest value's running count is the total, whose slot rounding must not lose
    slot = F.when(F.col("__until") == F.col("__total"), n - 1).otherwise(slot)
    firsts = sums.withColumn("__slot", slot).where("__slot >= 1").groupBy(*e.index, "__slot").agg(F.min(e.value).alias("__v"))
    slots = F.map_from_entries(F.collect_list(F.struct("__slot", "__v")))  # n - 1 at most
    made = grouped(firsts, e.index, slots.alias("__m"))
    return made.select(*e.index, F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.call_function("try_element_at", F.col("__m"), i)).alias(e.value))


@aggregator("histogram", params=3, of=("int", "float"))
def _histogram(e: Emits) -> DataFrame:
    """Counts of b equal buckets from min to below max; what lies outside is not counted."""
    low, high, b = e.params
    v = F.col(e.value).cast("double")
    inside = e.df.where((v >= low) & (v < high)).withColumn("__b", F.least(F.floor((v - low) / ((high - low) / float(b))), F.lit(b - 1)).cast("int"))
    counts = inside.groupBy(*e.index, "__b").agg(F.count(F.lit(1)).alias("__n"))
    made = grouped(counts, e.index, F.map_from_entries(F.collect_list(F.struct("__b", "__n"))).alias("__m"))  # b at most
    return made.select(*e.index, F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.coalesce(F.call_function("try_element_at", F.col("__m"), i), F.lit(0))).alias(e.value))


@aggregator("collection")
def _collection(e: Emits) -> DataFrame:
    return e.df.select(*e.index, *e.values)


@aggregator("text")
def _text(e: Emits) -> DataFrame:
    return e.df.select(*e.values)


for _name in ("stdout", "stderr", "output"):
    aggregator(_name)(_text)


@aggregator("set", params=1)
def _set(e: Emits) -> DataFrame:
    """All distinct values of an index that has at most n of them, and nothing of others."""
    n = e.params[0]
    distinct = e.df.select(*e.index, *e.values).distinct()
    few = first_rows(distinct, e.index, [F.col(v) for v in e.values], n + 1)
    held = grouped(few, e.index, F.collect_list(F.struct(*e.values)).alias("__vs")).where(F.size("__vs") <= n)  # n + 1 at most
    return held.select(*e.index, F.inline("__vs"))


#: The levels a log table knows, and what they are logged as.
LEVELS = {"trace": "debug", "debug": "debug", "info": "info", "warn": "warn", "error": "error", "fatal": "fatal"}


@aggregator("log", weight="string")
def _log(e: Emits) -> DataFrame:
    """Values with their level; unknown levels are left out."""
    level = F.lower(F.col(e.weight))
    known = F.lit(None).cast("string")
    for a, b in LEVELS.items():
        known = F.when(level == a, b).otherwise(known)
    return e.df.select(known.alias("level"), *e.values).where(F.col("level").isNotNull())


GROUP, COUNTER = "Counters", "Unnamed counter"


@aggregator("mrcounter", of=("int",))
def _counter(e: Emits) -> DataFrame:
    """Sums by group and counter: no index, the defaults; one, the counter; more, the group and the rest joined."""
    texts = [F.col(c).cast("string") for c in e.index]
    group, name = (F.lit(GROUP), F.lit(COUNTER)) if not texts else (F.lit(GROUP), texts[0]) if len(texts) == 1 else (texts[0], F.concat(*texts[1:]))
    return e.df.groupBy(group.alias("group"), name.alias("counter")).agg(F.try_sum(e.value).alias(e.value))


def _drawn(e: Emits) -> Column:
    """MD5 of an emitted row's values and weight as text."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in [*e.values, *([e.weight] if e.weight else [])]]))


@aggregator("sample", params=1)
def _sample(e: Emits) -> DataFrame:
    """n emitted rows of each index, chosen by a hash: the same ones in every run."""
    return first_rows(e.df, e.index, [_drawn(e), *[F.col(v) for v in e.values]], e.params[0]).select(*e.index, *e.values)


@aggregator("weightedsample", params=1, weight="float")
def _weighted_sample(e: Emits) -> DataFrame:
    """n rows of each index, likelier by weight (exponential keys over a hash)."""
    u = (F.conv(F.substring(_drawn(e), 1, 13), 16, 10).cast("double") + 1) / float((1 << 52) + 1)
    w = F.col(e.weight)
    return first_rows(e.df.where(w > 0), e.index, [F.ln(u) / w * -1, *[F.col(v) for v in e.values]], e.params[0]).select(*e.index, *e.values, e.weight)
