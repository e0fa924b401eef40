"""Tables over streams: the same emits, kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aggregators whose state is bounded per index.
STREAMED = {
    "sum": lambda vs: [F.sum(v).alias(v) for v in vs],
    "mean": lambda vs: [F.avg(v).alias(v) for v in vs],
    "unique": lambda vs: [F.approx_count_distinct(F.struct(*vs)).cast("long").alias("unique")],
}


def streamed(stream: DataFrame, aggregator: str, index: dict[str, Column], values: dict[str, Column], when: Column | None = None, time: str | None = None, window: str | None = None, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """A streaming table; with ``time`` and ``window``, one per window, closed ``late`` after it.

    Late rows beyond that are dropped, as the watermark says; without a window the state of every
    index stays.
    """
    if aggregator not in STREAMED:
        raise ValueError(f"{aggregator} is not kept over streams; use per_batch")
    df = stream if when is None else stream.where(when)
    keys = []
    if time and window:
        df = df.withWatermark(time, late)
        keys = [F.window(time, window, slide) if slide else F.window(time, window)]
    kept = df.select(*[c.alias(n) for n, c in (index | values).items()], *([time] if time else []))
    kept = kept.where(" and ".join(f"`{n}` is not null" for n in index | values))
    return kept.groupBy(*keys, *index).agg(*STREAMED[aggregator](list(values)))


def per_batch(stream: DataFrame, program, sink, checkpoint: str):
    """Run ``program(batch) -> {table: DataFrame}`` on every micro-batch and give each result to ``sink(name, df, batch_id)``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        for name, df in program(batch).items():
            sink(name, df, batch_id)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
