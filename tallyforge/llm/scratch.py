"""Lineage cuts and ranks that several operators share.

A lineage cut is a Parquet table under the folder named by ``spark.checkpoint.dir``,
which the driver and all executors share, so it outlives any executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder; one of our own only for a local master without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="tallyforge-")
            atexit.register(__import__("shutil").rmtree, _own[app], ignore_errors=True)
        base = _own[app]
    return f"{base.rstrip('/')}/tallyforge"


class Cut:
    """A written table: ``df`` reads it, ``drop()`` deletes it once nothing reads it any more."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def union(self, others: list[Cut]) -> DataFrame:
        """This table and others alike, in one scan."""
        return self.spark.read.schema(self.df.schema).parquet(self.path, *[o.path for o in others])

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A side of at most so many rows of a few numbers is broadcast.
FEW, SALTS = 1 << 20, 16


def looked_up(rows: DataFrame, found: DataFrame, key: str, of: str, how: str = "inner", few: int = FEW) -> DataFrame:
    """``rows`` with the row of ``found`` whose ``of`` is their ``key``: one at most, of a few numbers.

    Few are broadcast; else both sides are dealt by the key and a salt, so a key that a large part
    of the rows has takes many tasks.
    """
    cut = Cut(found, "found")
    if cut.df.count() <= few:
        return rows.join(F.broadcast(cut.df), F.col(key) == F.col(of), how)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    copies = cut.df.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, (F.col(key) == F.col(of)) & (F.col("__salt") == F.col("__copy")), how).drop("__salt", "__copy")


def ranked(df: DataFrame, order: list[Column], rank: str, name: str) -> tuple[DataFrame, Cut]:
    """Number rows 1..n by ``order`` without a task that sees them all.

    Rows are dealt by range, counted by partition, and numbered within it; what meets in one
    place is one count per partition. Give it narrow rows: it writes them once.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = Cut(df.repartitionByRange(parts, *order).withColumn("__pid", F.spark_partition_id()), name)
    counts = cut.df.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("__pid").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__pid").orderBy(*order))
    joined = cut.df.withColumn("__in", within).join(F.broadcast(starts), F.col("__pid") == F.col("__at"))
    return joined.withColumn(rank, F.col("__start") + F.col("__in")).drop("__pid", "__at", "__in", "__start"), cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
