"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A listed URL is a host and the start of a path; it fits its host and all subdomains. A page's
host's parents, as many labels long as listed hosts are, go to a filter of listed hosts, and those
that pass, with the path's starts, as long as listed paths are, to a filter of listed URLs. What
passes that is joined with the list by the whole key, which removes false positives; the longest
rule wins.

A filter is a table of 512-bit blocks, built in Spark by block, and never larger than ``max_bytes``:
a longer list makes more false positives, which cost time and not results. Beside them the driver
holds only which lengths occur in the list. Pages that the filters reject are not shuffled. The
others are judged once per URL, and get their verdicts by a broadcast if those are under
BROADCAST_BYTES, else by a join on the URL, in which Spark splits a URL that many pages have.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and the
verdict of unlisted URLs (``default``); an empty path starts with no rule's ``/``; rows that
repeat come out as often; an empty table gives an empty result; an empty list gives ``default``;
further columns are ignored; the list's repeated keys count once (the smallest verdict wins).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Cut, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS, PROBES, BROADCAST_BYTES = 8, 8, 32 << 20
#: The list of the contract: rule, verdict.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """The list from (host and path, verdict) pairs."""
    rows = [(r, r.partition("/")[0], "/" + r.partition("/")[2], v) for r, v in rules]
    return spark.createDataFrame(rows, "rule string, host string, path string, verdict string")


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def _masks(h: Column) -> list[Column]:
    """The words of a key's block mask: PROBES positions of 9 bits each, two to a hash."""
    second = F.xxhash64(h, F.lit(1))
    spots = [F.shiftrightunsigned(h if i < 4 else second, 9 * (i % 4)).bitwiseAND(511) for i in range(PROBES)]
    masks = []
    for w in range(WORDS):
        word = F.lit(0).cast("long")
        for spot in spots:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(63).cast("int"))
            word = word.bitwiseOR(F.when(F.shiftright(spot, 6) == w, bit).otherwise(F.lit(0).cast("long")))
        masks.append(word)
    return masks


@dataclass
class Bloom:
    """Blocks of 8 64-bit words; a key's block comes from the upper bits of its hash."""

    blocks: np.ndarray

    @classmethod
    def of(cls, keys: DataFrame, key: str, max_bytes: int = 32 << 20, bits_per_key: int = 16) -> Bloom:
        n = keys.count()
        most = max_bytes // (8 * WORDS)
        n_blocks = int(min(most, max(1, -(-n * bits_per_key // (64 * WORDS)))))
        h = F.xxhash64(F.col(key))
        block = F.pmod(F.shiftrightunsigned(h, 36), F.lit(n_blocks))
        hashed = keys.select(block.cast("int").alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(h))])
        made = hashed.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
        blocks = np.zeros((n_blocks, WORDS), np.uint64)
        for row in made.toLocalIterator():  # n_blocks rows at most
            blocks[row[0]] = np.array(row[1:], np.int64).view(np.uint64)
        return cls(blocks)

    def may_hold(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        first, second = first.view(np.uint64), second.view(np.uint64)
        block = ((first >> np.uint64(36)) % np.uint64(len(self.blocks))).astype(np.int64)
        hit = np.ones(len(first), bool)
        for i in range(PROBES):
            spot = ((first if i < 4 else second) >> np.uint64(9 * (i % 4))) & np.uint64(511)
            word = self.blocks[block, (spot >> np.uint64(6)).astype(np.int64)]
            hit &= (word >> (spot & np.uint64(63))) & np.uint64(1) == 1
        return hit


def parents(host: Column, labels: list[int]) -> Column:
    """A host's ends, as many labels long as ``labels`` says; none of an empty host."""
    parts = F.split(host, r"\.")
    some = F.filter(F.array(*map(F.lit, labels)), lambda n: (n <= F.size(parts)) & (host != ""))
    return F.array_distinct(F.transform(some, lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")))


def _hashes(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of keys, as Spark makes them."""
    first = [xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass"), 42) for k in keys]
    second = [xxhash.xxh64_intdigest(b"\1\0\0\0", xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42)) for h in first]
    return np.array(first, np.uint64).view(np.int64), np.array(second, np.uint64).view(np.int64)


def possible(host: Column, path: Column, labels: list[int], lengths: list[int], hosts, keys) -> Column:
    """The listed keys that a URL may fit, by the broadcast filters of hosts and of keys."""

    @F.pandas_udf("array<string>")
    def passing(parents: pd.Series, first: pd.Series, second: pd.Series, paths: pd.Series) -> pd.Series:
        rows, made, found = np.repeat(np.arange(len(parents)), [len(p) for p in parents]), [], [[] for _ in parents]
        if not len(rows):
            return pd.Series(found, dtype=object)
        hit = hosts.value.may_hold(np.concatenate(first.to_list()).astype(np.int64), np.concatenate(second.to_list()).astype(np.int64))
        all_ = np.concatenate(parents.to_list())
        for i in np.flatnonzero(hit):
            path = paths.iloc[rows[i]]
            made += [(rows[i], all_[i] + path[:n]) for n in lengths if n <= len(path)]
        if made:
            for at in np.flatnonzero(keys.value.may_hold(*_hashes([k for _, k in made]))):
                found[made[at][0]].append(made[at][1])
        return pd.Series(found, dtype=object)

    ends = parents(host, labels)
    return passing(ends, F.transform(ends, lambda k: F.xxhash64(k)), F.transform(ends, lambda k: F.xxhash64(F.xxhash64(k), F.lit(1))), path)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    keyed = rules.select(_key(F.col("host"), F.col("path")).alias("key"), "rule", "verdict", "host", "path")
    best = keyed.groupBy("key").agg(F.min(F.struct("verdict", "rule")).alias("v"), F.first("host").alias("of"), F.first("path").alias("under"))
    listed = Cut(best.select("key", "v.rule", "v.verdict", "of", "under"), "rules").df
    # distinct lengths: at most as many as a URL is long
    labels = sorted(r[0] for r in listed.select(F.size(F.split("of", r"\."))).distinct().collect())
    lengths = sorted(r[0] for r in listed.select(F.length("under")).distinct().collect())
    judged = pages.select("page_id", "url", host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    nothing = [F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")]
    if not labels:
        return judged.select("page_id", "host", "path", *nothing)
    hosts = spark.sparkContext.broadcast(Bloom.of(listed.select("of").distinct(), "of"))
    keys = spark.sparkContext.broadcast(Bloom.of(listed, "key"))
    known = judged.withColumn("possible", possible(F.col("host"), F.col("path"), labels, lengths, hosts, keys))
    hit = F.size("possible") > 0
    urls = known.where(hit).select("url", "possible").groupBy("url").agg(F.first("possible").alias("possible"))
    exact = urls.select("url", F.explode("possible").alias("candidate")).join(listed, F.col("candidate") == F.col("key"))
    found = exact.groupBy(F.col("url").alias("for")).agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("rule"))).alias("b"))
    found = Cut(found.select("for", "b.rule", F.col("b.verdict").alias("found")), "verdicts").df
    size = found.agg(F.coalesce(F.sum(F.length("for") + F.length("rule") + 50), F.lit(0))).first()[0]
    joined = known.where(hit).join(F.broadcast(found) if size <= BROADCAST_BYTES else found, F.col("url") == F.col("for"), "left")
    joined = joined.select("page_id", "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict"))
    return joined.unionByName(known.where(~hit).select("page_id", "host", "path", *nothing))


def op1_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), rules_table(spark, RULES))


SQL = r"""
with p as (select page_id, case when url is null or instr(url, '://') = 0 then '' else substr(url, instr(url, '://') + 3) end rest from pages),
q as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') path from p),
r as (select * from (values ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
                            ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')) r(rule, rhost, rpath, verdict)),
j as (select q.*, (select {'rule': max_by(r.rule, length(r.rule)), 'verdict': max_by(r.verdict, length(r.rule))} from r
                   where (q.host = r.rhost or ends_with(q.host, '.' || r.rhost)) and starts_with(q.path, r.rpath)) b from q)
select page_id, host, path, b.rule rule, coalesce(b.verdict, 'allow') verdict from j
"""
