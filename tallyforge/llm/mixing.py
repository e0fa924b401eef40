"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Sources in code point order (null last) take the weights in turn and share the words of all
documents in proportion; a target stops at ``cap`` times its source's words and the excess goes
to the others by weight. A source takes whole epochs of all its documents, and the rest of its
target as those documents whose hash lies under a threshold. Thresholds come from histograms of
words by source and hash bucket: the bucket in which the budget ends is refined by the next bits
of the hash until it holds a single hash. Larger budgets have larger thresholds, so selections
are nested; nothing is sorted and reruns agree, for the hash is that of the document's id, its text
and its number among the rows of its source with that id and text. Such repeated rows are found by
counting 64-bit hashes; only they are numbered, by their counts in each partition and their places
there, so no task sees all of them.

Defined results: null text or text without words has size 0 and takes 0; a null source is a
source of its own; a null id hashes as the empty string; rows that repeat an id, or an id and a
text, have hashes of their own, and of rows alike in both as many are taken as have hashes under the
threshold; an empty table gives an empty result; further columns are ignored by ``mix`` and kept by
``apply``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .scratch import Cut, ranked, table

WORDS = r"[^\x20\x09-\x0D]+"
BITS, STEP = 60, 12


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


#: So many hashes of repeated rows are broadcast at most.
BROADCAST_REPEATS = 1 << 20


def key_of(doc_id: Column, text: Column) -> Column:
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))


def hash_of(key: Column, nth: Column) -> Column:
    """60 bits of MD5."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), nth.cast("string"))), 1, 15), 16, 10).cast("long")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (source, __key and any others) with __nth, their number among those of one source and key."""
    hashed = rows.withColumn("__hash", F.xxhash64("source", "__key"))
    cut = Cut(hashed.groupBy("__hash").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("__hash").alias("__again")), "mix-repeats")
    n = cut.df.count()
    if not n:
        cut.drop()
        return hashed.drop("__hash").withColumn("__nth", F.lit(1).cast("long"))
    again = F.broadcast(cut.df) if n <= BROADCAST_REPEATS else cut.df
    is_again = F.col("__hash") == F.col("__again")
    once = hashed.join(again, is_again, "left_anti").withColumn("__nth", F.lit(1).cast("long"))
    more = Cut(hashed.join(again, is_again, "left_semi").withColumn("__part", F.spark_partition_id()), "mix-repeated").df
    counts = more.groupBy("source", "__key", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("source", "__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("source").alias("__s"), F.col("__key").alias("__k"), F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("source", "__key", "__part").orderBy("__hash"))
    joined = more.withColumn("__in", place).join(starts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__key") == F.col("__k")) & (F.col("__part") == F.col("__p")))
    return once.unionByName(joined.withColumn("__nth", F.col("__start") + F.col("__in")).select(*once.columns)).drop("__hash")


@dataclass
class MixPlan:
    """Per source: words, target, epochs, and the hash threshold of one epoch more."""

    thresholds: DataFrame
    sized: DataFrame

    def _copies(self, h: Column) -> Column:
        more = (h < F.col("__below")) | ((h == F.col("__below")) & F.col("__with"))
        return F.col("__epochs") + F.when(more, 1).otherwise(0)

    def mix(self) -> DataFrame:
        """One row per document: doc_id, size, source_size, target, taken."""
        joined = self.sized.join(self.thresholds, F.col("source").eqNullSafe(F.col("__source")))
        return joined.select("doc_id", "size", F.col("__words").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * self._copies(F.col("h"))).cast("long").alias("taken"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """The documents of the mix, each as often as it is taken; the columns of ``docs``."""
        rows = numbered(docs.withColumn("__key", key_of(docs["doc_id"], docs["text"])))
        joined = rows.join(self.thresholds, F.col("source").eqNullSafe(F.col("__source")))
        copies = self._copies(hash_of(F.col("__key"), F.col("__nth"))).cast("int")
        taken = joined.withColumn("__copies", copies).where("__copies > 0")
        return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[f"`{c}`" for c in docs.columns])


def plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> MixPlan:
    """Fit targets and thresholds to all of ``docs`` (doc_id, text, source)."""
    measured = Cut(docs.select("doc_id", "source", size_of(docs["text"]).alias("size"), key_of(docs["doc_id"], docs["text"]).alias("__key")), "mix-measured")
    hashed = numbered(measured.df).select("doc_id", "source", "size", hash_of(F.col("__key"), F.col("__nth")).alias("h"))
    sized = Cut(hashed, "mix-sizes").df
    measured.drop()
    sums = Cut(sized.groupBy("source").agg(F.sum("size").cast("long").alias("words")), "mix-sources")
    order, dealt = ranked(sums.df, [F.col("source").isNull(), F.col("source")], "rank", "mix-ranks")
    cycle = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    sources = Cut(order.select("source", "words", cycle.cast("long").alias("w")), "mix-weights").df
    sums.drop()
    dealt.drop()
    targets = sources.withColumn("target", F.least(F.lit(float(cap)) * F.col("words"), F.col("w") * F.lit(_level(sources, cap))))
    epochs = F.when(F.col("words") == 0, 0).when(F.col("target") >= cap * F.col("words"), cap).otherwise(F.floor(F.col("target") / F.col("words")))
    budgets = targets.withColumn("epochs", epochs.cast("long")).withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("words")))
    return MixPlan(_thresholds(sized, Cut(budgets, "mix-budgets").df), sized)


def _level(sources: DataFrame, cap: int) -> float:
    """Words per unit of weight of the sources that stay under their cap: a few scalars per round, however many sources."""
    level, capped = 0.0, -1
    total = sources.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    while True:
        at = F.lit(float(cap)) * F.col("words") <= F.col("w") * F.lit(level)
        held, n, free = sources.agg(F.coalesce(F.sum(F.when(at, cap * F.col("words"))), F.lit(0)), F.count(F.when(at, 1)), F.coalesce(F.sum(F.when(~at, F.col("w"))), F.lit(0))).first()
        if n == capped or not free:
            return level
        level, capped = (total - held) / free, n


def _thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """Refine the boundary bucket of each source by STEP bits at a time.

    A source whose words end before its budget does has no boundary and takes nothing more than
    its epochs, which can only be if the budget is 0 or the source is empty.
    """
    edge = budgets.select(F.col("source").alias("__source"), F.col("words").alias("__words"), F.col("target").alias("__target"), F.col("epochs").alias("__epochs"), F.col("budget").alias("__budget"), F.lit(0).cast("long").alias("__bucket"), F.lit(0).cast("long").alias("__before"), F.lit(0).cast("long").alias("__sum"))
    kept = None
    for shift in range(BITS - STEP, -1, -STEP):
        held = F.shiftright(F.col("h"), shift + STEP)
        rows = sized.join(edge.where("__budget > 0"), F.col("source").eqNullSafe(F.col("__source")) & (held == F.col("__bucket")))
        hist = rows.groupBy("__source", F.shiftright(F.col("h"), shift).alias("__b")).agg(F.sum("size").alias("__s"), F.first("__before").alias("__from"), F.first("__budget").alias("__f"))
        run = F.sum("__s").over(Window.partitionBy("__source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
        steps = hist.withColumn("__until", F.col("__from") + F.coalesce(run, F.lit(0)))
        ends = steps.where(F.col("__until") + F.col("__s") > F.col("__f")).groupBy("__source").agg(F.min(F.struct("__b", "__until", "__s")).alias("__e"))
        ends = ends.select(F.col("__source").alias("__key"), "__e")
        edge = edge.join(ends, F.col("__source").eqNullSafe(F.col("__key")), "left").select("__source", "__words", "__target", "__epochs", "__budget", F.coalesce(F.col("__e.__b"), F.shiftleft(F.col("__bucket"), STEP)).alias("__bucket"), F.coalesce(F.col("__e.__until"), F.col("__before")).alias("__before"), F.coalesce(F.col("__e.__s"), F.lit(0)).alias("__sum"))
        cut = Cut(edge, "mix-edges")
        edge = cut.df
        if kept:
            kept.drop()
        kept = cut
    nearer = F.col("__before") + F.col("__sum") - F.col("__budget") < F.col("__budget") - F.col("__before")
    return edge.select("__source", "__words", "__target", "__epochs", F.when((F.col("__budget") > 0) & (F.col("__sum") > 0), F.col("__bucket")).otherwise(-1).alias("__below"), nearer.alias("__with"))


def op9_mixing(spark, sf_dir):
    return plan(table(spark, sf_dir, "documents")).mix()


SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
                  ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, '')) || ':' || row_number() over (partition by doc_id, source, coalesce(text, ''))), 1, 15))::bigint h from documents),
s as (select source, sum(size)::bigint words, [5, 2, 1][((row_number() over (order by source is null, source)) - 1) % 3 + 1]::bigint w from d group by source),
r as (select *, sum(words) over ()::bigint total, coalesce(sum(3 * words) over (order by words::double / w, source rows between unbounded preceding and 1 preceding), 0)::bigint held,
             sum(w) over (order by words::double / w, source rows between current row and unbounded following)::bigint free from s),
l as (select max((total - held)::double / free::double) lam from r),
t as (select source, words, least(3.0::double * words, w * lam) target from s, l),
b as (select *, case when words = 0 then 0 when target >= 3 * words then 3 else floor(target / words)::bigint end epochs from t),
f as (select *, greatest(0.0::double, target - epochs * words) budget from b),
g as (select source, h, sum(size)::bigint gs from d group by source, h),
c as (select g.*, f.budget, coalesce(sum(gs) over (partition by g.source order by h rows between unbounded preceding and 1 preceding), 0)::bigint until from g join f on g.source is not distinct from f.source),
e as (select source, min({'h': h, 'until': until, 'gs': gs}) e from c where budget > 0 and until + gs > budget group by source)
select d.doc_id, d.size, f.words source_size, f.target,
       (d.size * (f.epochs + case when e.e is null then 0 when d.h < e.e.h or (d.h = e.e.h and e.e.until + e.e.gs - f.budget < f.budget - e.e.until) then 1 else 0 end))::bigint taken
from d join f on d.source is not distinct from f.source left join e on d.source is not distinct from e.source
"""
