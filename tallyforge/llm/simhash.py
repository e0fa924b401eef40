"""SimHash near-duplicates found by meet-in-the-middle ball hashing.

A document's fingerprint has a bit set if over half of its shingle hashes have it set. Two
fingerprints within ``2 * half`` bits share a variant that lies within ``half`` bits of both, so
every distinct fingerprint emits its ball of variants, the variants are shuffled, and those that
meet are linked. All members of one ball lie within ``2 * half`` bits of each other, so a link of
each to the smallest loses no connection: a ball of b members gives b - 1 links and not b * b.
Links are verified by popcount. Components are labelled by rounds of hooking and shortcutting
over the links; a fingerprint has a bounded number of links, whatever the number of its copies, and
what a large component's members have in common, its root, is broadcast or joined under a salt.

Defined results: null text, and text without words, has fingerprint 0, linked like any other;
fewer words than a shingle form one shingle; rows that repeat an id come out once each, in the
same component; a null doc_id is kept and never names a component unless all its ids are null;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Cut, looked_up, table

SEED = 42
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles hashed at a time, which bounds the memory of a long text.
CHUNK = 1 << 16
#: So many ids, of 8 bytes, are broadcast at most.
BROADCAST_IDS = 1 << 20


def shingle_hashes(text: str | None, width: int = 3) -> Iterator[np.ndarray]:
    """Arrays of the hashes of a text's shingles, repeats included."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        yield np.array([digest(joined, SEED)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    for at in range(0, len(first), CHUNK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK])], np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint_of(text: Column, width: int = 3) -> Column:
    """The fingerprint as a signed long, in Arrow batches."""

    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return udf(text)


def ball(fp: Column, half: int) -> Column:
    """All values within ``half`` bits of a fingerprint."""
    masks = [0]
    for k in range(1, half + 1):
        masks += [sum(1 << i for i in some) for some in combinations(range(64), k)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: fp.bitwiseXOR(m))


def links(distinct: DataFrame, half: int = 1) -> DataFrame:
    """Verified links (a, b), a < b, that connect what lies within ``2 * half`` bits."""
    # dealt out first, as a few files of fingerprints make many variants, and then by variant, as almost
    # no two variants of a task are equal and grouping them there only sorts
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = distinct.select("fp").repartition(parts, "fp").select("fp", F.explode(ball(F.col("fp"), half)).alias("variant"))
    met = variants.repartition("variant").groupBy("variant").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    pairs = met.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2 * half)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b): the smallest node each one is connected to.

    Each round hooks a node's root to the smallest root next to it, and then follows roots twice,
    so rounds grow with the logarithm of a component's width. Labels are written each round.
    """
    both = Cut(edges.select("a", "b").union(edges.select("b", "a")), "links")
    cut = Cut(both.df.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "roots")
    for _ in range(max_rounds):
        roots = cut.df
        near = both.df.join(roots, F.col("b") == F.col("node")).groupBy(F.col("a").alias("at")).agg(F.min("root").alias("m"))
        seen = Cut(roots.join(near, F.col("node") == F.col("at")).select("node", "root", "m"), "seen")
        hook = seen.df.groupBy(F.col("root").alias("top")).agg(F.min("m").alias("h")).where("h < top")
        own = seen.df.select("node", F.least("root", "m").alias("r"))
        hooked = looked_up(own, hook, "r", "top", "left").select("node", F.least("r", F.coalesce("h", "r")).alias("root"))
        step = Cut(hooked, "roots")
        seen.drop()
        # the roots of roots; nodes share roots, so these are looked up and not joined
        tops = step.df.select(F.col("root").alias("n2")).distinct()
        jump = tops.join(step.df, F.col("n2") == F.col("node")).select("n2", F.col("root").alias("r2"))
        new = Cut(looked_up(step.df, jump, "root", "n2", "left").select("node", F.least("root", F.coalesce("r2", "root")).alias("root")), "roots")
        step.drop()
        old = roots.select(F.col("node").alias("n0"), F.col("root").alias("r0"))
        done = new.df.join(old, (F.col("node") == F.col("n0")) & (F.col("root") != F.col("r0")), "left_semi").isEmpty()
        cut.drop()
        cut = new
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    both.drop()
    return cut.df


def _rooted(docs: DataFrame, half: int, width: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, fp), and each fingerprint's component (of, component_id, root)."""
    cut = Cut(docs.select("doc_id", fingerprint_of(docs["text"], width).alias("fp")), "fingerprints")
    distinct = Cut(cut.df.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct").df
    roots = components(links(distinct, half))
    rooted = Cut(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "root"), "rooted").df
    least = rooted.where("root is not null").groupBy(F.col("root").alias("top")).agg(F.min("first").alias("component_id"))
    linked = looked_up(rooted.where("root is not null"), least, "root", "top").select(F.col("fp").alias("of"), "component_id", "root")
    alone = rooted.where("root is null").select(F.col("fp").alias("of"), F.col("first").alias("component_id"), F.col("fp").alias("root"))
    return cut.df, Cut(linked.unionByName(alone), "named").df


def near_duplicates(docs: DataFrame, half: int = 1, width: int = 3) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id."""
    rows, named = _rooted(docs, half, width)
    return rows.join(named, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, half: int = 1, width: int = 3) -> DataFrame:
    """The documents without near-duplicates: of each component one row stays, and of each id one row.

    Rows are judged by their own texts: that with the smallest id stays, but an id whose rows lie in
    several components only where a component has no other row, and before those one without an
    id. An id that several components have to take leaves the row with the smallest hash of its text.
    """
    rows, named = _rooted(docs, half, width)
    pairs = rows.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n")).join(named, F.col("fp") == F.col("of")).select("doc_id", "fp", "n", "root")
    pairs = Cut(pairs, "pairs").df
    multi = pairs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("__id")
    kind = F.when(F.col("doc_id").isNull(), 1).when(F.col("__id").isNotNull(), 2).otherwise(0)
    pairs = pairs.join(Cut(multi, "multi").df, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "fp", "n", "root", kind.alias("kind"))
    pairs = Cut(pairs, "pairs").df
    # only groups of several have to choose
    first = pairs.groupBy(F.col("root").alias("top")).agg(F.min(F.struct("kind", "doc_id", "fp")).alias("first"), F.count(F.lit(1)).alias("__of")).where("__of > 1").drop("__of")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("fp") == F.col("first.fp"))
    judged = looked_up(pairs, first, "root", "top", "left").select("doc_id", "fp", "n", F.when(F.col("top").isNull(), True).otherwise(is_first).alias("stays"))
    judged = Cut(judged, "stays").df
    ids = Cut(judged.groupBy(F.col("doc_id").alias("__id")).agg(F.max("stays").alias("any"), F.sum("n").alias("n")), "ids").df
    gone = Cut(ids.where("not any and __id is not null").select("__id"), "gone").df
    if gone.count() <= BROADCAST_IDS:  # then no text is shuffled
        gone = F.broadcast(gone)
    kept = docs.join(gone, docs["doc_id"] == F.col("__id"), "left_anti")
    # ids of several rows of which some stay, and rows without an id, are told apart by their fingerprints
    odd = Cut(ids.where("__id is null or any and n > 1").select("__id"), "odd").df
    n_odd = odd.count()
    if not n_odd:
        return kept
    if n_odd <= BROADCAST_IDS:
        odd = F.broadcast(odd)
    is_odd = docs["doc_id"].eqNullSafe(F.col("__id"))
    stay = judged.where("stays").select(F.col("doc_id").alias("__id"), F.col("fp").alias("__of"))
    several = kept.join(odd, is_odd, "left_semi").withColumn("__fp", fingerprint_of(F.col("text"), width))
    several = several.join(stay, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__of")), "left_semi")
    one = several.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("__fp"))).agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("__row")).select("__row.*")
    return kept.join(odd, is_odd, "left_anti").unionByName(one)


def op10_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
