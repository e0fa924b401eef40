"""Document fingerprints as invertible Bloom lookup sketches (DataFrame functions only).

A document's paragraphs are its lines; a line counts as slices of as many characters as the
document's length class says, 160 for documents of 960 characters or more and 80, 40, 20, 10, 5 or
2 for shorter ones, so that a document of a single line has several. Classes below the largest
count the slices of the next class too, so documents of neighbouring classes share slices. The sketch of the set of
their digests has three subtables; a digest goes to one cell of each, and a cell holds a count, the
exclusive or of its digests, and that of their checks.

A published sketch, fingerprint or edited_fingerprint, is sized by the number of its own digests,
and is the smallest of the sizes tried, each four times the last, from which peeling lists all of
its digests. It depends on the text alone. Likeness is a function of two published sketches: the
smaller is brought to the larger's size (its digests, listed, are placed anew), cells subtract, and
cells that hold a single digest are peeled, a subtable at a time, until none is left: what was
peeled are the digests in which the versions differ, and with the counts in both sketches they give
the shared digests as a share of all. A document and its edited text are subtracted at the larger of
their published sizes. A document and the next one, which as a rule have nothing in common, are
subtracted at once at the size that their counts ask for. Where cells remain, the pair is tried
again, four times as large, whatever that size, and with one more sweep; pairs that no attempt
peels are compared by grouping their digests one by one, so every pair gets its result.

All of this is grouping by document and cell in the partitions that the join of a document with
its successor leaves, so text is shuffled once and cells never. The order of documents is found
by range ranks of their ids, not by a window over all.

Defined results: null text is the empty text, which has no paragraphs; two sketches without
paragraphs have likeness 1; rows that repeat an id with another text follow each other by the
text's hash, rows that repeat id and text are one document that comes out as often as it occurs;
null ids come last; a single document is its own successor; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Cut, ranked, table

SLICE, HALVINGS, SLICES, SWEEPS = 160, 6, 6, 2
#: A retry sweeps once more than the attempt before it, so many times more at most.
MORE_SWEEPS = 3
#: So many sizes of a published sketch are tried at most; the chance that one fails falls with its size.
MOST_SIZES = 12
#: Planes of cells: two pairs, two published sketches; what was peeled of a pair; sizes of sets; the edited text's hash.
PAIR_EDITED, PAIR_NEXT, OWN, EDITED, PEELED, SIZES, SHA = 0, 1, 2, 3, 4, 8, 9
#: The keys of so many pairs, 32 bytes each, are broadcast at most.
BROADCAST_PAIRS = 1 << 19


def pieces(text: Column) -> Column:
    """A text's lines in slices of its length class, and of the next one: at least SLICES of them where it can be."""
    wanted = F.ceil(F.log2(F.lit(float(SLICES * SLICE)) / F.greatest(F.lit(1), F.char_length(text))))
    k = F.greatest(F.lit(0), F.least(F.lit(HALVINGS), wanted)).cast("int")
    cut = lambda k: F.regexp_extract_all(text, F.concat(F.lit("[^\n]{1,"), F.call_function("shiftright", F.lit(SLICE), k), F.lit("}")), F.lit(0))
    return F.concat(cut(k), F.when(k > 0, cut(k - 1)).otherwise(F.array().cast("array<string>")))


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    return F.array_distinct(F.transform(pieces(text), lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(7)), 32)


def _place(key: Column, sub: Column, cells: Column) -> Column:
    """The cell of a key in a subtable of ``cells``, a power of two; halving ``cells`` folds cells together.

    The lowest 20 bits are a field of one hash, those above come from a hash of the subtable's own.
    """
    h = F.xxhash64(key, F.lit(1))
    field = F.when(sub == 0, h).when(sub == 1, F.shiftrightunsigned(h, 20)).otherwise(F.shiftrightunsigned(h, 40))
    above = F.shiftleft(F.xxhash64(key, F.lit(2), sub.cast("int")), 20)
    wide = F.when(cells > 1 << 20, field.bitwiseAND((1 << 20) - 1).bitwiseOR(above)).otherwise(field)
    return sub.cast("long") * cells + wide.bitwiseAND(cells - 1)


def _cells_for(n: Column, attempt: int) -> Column:
    """Cells of a subtable for up to ``n`` differing digests: 3 subtables hold 3 to 6 cells a digest, and 96 at least."""
    wanted = F.greatest(F.lit(32.0), 1.0 * n)
    return F.pow(F.lit(2.0), F.ceil(F.log2(wanted)) + 2 * attempt).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    """k1, k2: the id and a hash of the text, neither null."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(text, docs["doc_id"].isNull()).alias("k2"), text.alias("text"), docs["doc_id"].alias("doc_id"))


def successors(docs: DataFrame) -> DataFrame:
    """Each distinct document with its successor in descending order of ids: k1, k2, doc_id, n_chars, times, s1, s2."""
    found = _keyed(docs).select("k1", "k2", "doc_id", F.char_length("text").cast("long").alias("n_chars"))
    once = found.groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("times"))
    order, dealt = ranked(once, [F.col("doc_id").isNull(), F.col("k1").desc(), F.col("k2")], "rank", "sketch-order")
    cut = Cut(order, "sketch-ranks")
    dealt.drop()
    rows, n = cut.df, cut.df.count()
    follows = rows.select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), (F.pmod(F.col("rank") - 2, F.lit(max(1, n))) + 1).alias("of"))
    pairs = Cut(rows.join(follows, F.col("rank") == F.col("of")).drop("rank", "of"), "sketch-successors").df
    cut.drop()
    return pairs


def _versions(docs: DataFrame, pairs: DataFrame, once: bool, some: bool) -> DataFrame:
    """The digests of each document (a), its edited text (e) and its successor (x): k1, k2, a, e, x, sha, and what the rows need to come out: n_chars, times, no_id."""
    keyed = _keyed(docs).select("k1", "k2", "text")
    if some:  # only the texts of the pairs that are left
        wanted = pairs.select(F.col("k1").alias("w1"), F.col("k2").alias("w2")).union(pairs.select("s1", "s2")).distinct()
        if pairs.count() <= BROADCAST_PAIRS:
            wanted = F.broadcast(wanted)
        keyed = keyed.join(wanted, (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")), "left_semi")
    if not once:
        keyed = keyed.dropDuplicates(["k1", "k2"])
    facts = ["n_chars", "times", "no_id"]
    needs = pairs.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.floor(F.col("n_chars") / 3).cast("int").alias("need"), "s1", "s2", "n_chars", "times", F.col("doc_id").isNull().cast("long").alias("no_id"))
    heads = keyed.join(needs, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2"))).select("o1", "o2", "need", *facts, F.left("text", F.col("need")).alias("head"), digests(F.col("text")).alias("x"))
    both = keyed.join(heads, (F.col("k1") == F.col("o1")) & (F.col("k2") == F.col("o2")))
    edited = F.concat(F.left("text", F.char_length("text") - F.col("need")), F.col("head"))
    made = both.select("k1", "k2", *facts, edited.alias("edited"), digests(F.col("text")).alias("a"), "x")
    return made.select("k1", "k2", *facts, "a", digests(F.col("edited")).alias("e"), "x", F.sha2(F.col("edited"), 256).alias("sha"))


def _planes(versions: DataFrame, attempt: int, exact: bool) -> DataFrame:
    """The cells of the published sketches and of both pairs' differences: k1, k2, p, cells, cell, cnt, key, chk and, of published ones, ocnt, okey, ochk.

    Sketches are made at all sizes at which they are published or compared, and then subtracted cell
    by cell. If ``exact``, the pairs' digests are grouped one by one, and come out as if peeled.
    """
    na, ne, nx = F.size("a"), F.size("e"), F.size("x")
    log = lambda n: F.round(F.log2(_cells_for(n, attempt))).cast("int")
    sized = versions.withColumns({"na": na, "ne": ne, "nx": nx, "la": log(na), "le": log(ne), "l1": log(na + nx)})
    sized = sized.withColumn("shape", F.col("la") + 64 * F.col("le") + 4096 * F.greatest("la", "le") + 262144 * F.col("l1"))
    tagged = lambda t, c: F.transform(F.col(c), lambda k: F.struct(F.lit(t).alias("t"), k.alias("key")))
    sha = [F.conv(F.substring("sha", 16 * i + 1, 16), 16, -10) for i in range(4)]
    plain = [F.struct(F.lit(t).alias("t"), v.cast("long").alias("key")) for t, v in zip((10, 11, 12, 13, 14, 15, 20, 21, 22, 23), (*map(F.col, ("na", "ne", "nx", "n_chars", "times", "no_id")), *sha))]
    entries = sized.select("k1", "k2", "shape", F.explode(F.concat(*[tagged(t, c) for t, c in enumerate("aex")], F.array(*plain))).alias("i")).select("k1", "k2", "shape", "i.t", "i.key")

    # sizes, as powers of two: of the document's sketch, its edited text's, and both pairs'
    field = lambda i: F.shiftright("shape", 6 * i).bitwiseAND(63)
    power = lambda log: F.call_function("shiftleft", F.lit(1).cast("long"), log.cast("int"))
    la, le, l0, l1 = map(field, range(4))
    some = lambda test, numbers: F.when(test, F.array(*map(F.lit, numbers))).otherwise(F.array().cast("array<int>"))
    t, own, at0, at1, never = F.col("t"), (0, 1, 2), (3, 4, 5), (6, 7, 8), F.lit(False)
    # which sketches an entry goes to: 3 * size + subtable; 9 and 10 are the pairs digest by digest
    if exact:
        spots = F.when(t == 0, F.array(*map(F.lit, (*own, 9, 10)))).when(t == 1, F.array(*map(F.lit, (*own, 9)))).when(t == 2, F.array(F.lit(10)))
    else:
        spots = F.when(t == 0, F.concat(some(~never, own), some(l0 != la, at0), some((l1 != la) & (l1 != l0), at1))).when(t == 1, F.concat(some(~never, own), some(l0 != le, at0))).when(t == 2, F.array(*map(F.lit, at1)))
    spread = entries.withColumn("to", F.explode(spots.otherwise(F.array(F.lit(-1)))))
    to, key = F.col("to"), F.col("key")
    size = F.when(to < 3, F.when(t == 0, la).otherwise(le)).when(to < 6, l0).otherwise(l1)
    cells = F.when(to < 0, F.when(t < 20, -SIZES).otherwise(-SHA)).when(to >= 9, 8 - to).otherwise(power(size)).cast("long")
    spread = spread.withColumn("cells", cells)
    cell = F.when(to < 0, (t % 10).cast("long")).when(to >= 9, key).otherwise(_place(key, to % 3, F.col("cells")))
    spread = spread.select("k1", "k2", "shape", "cells", cell.alias("cell"), F.when(to < 0, 0).otherwise(t).alias("t"), "key", _check(key).alias("chk"))
    sums = []
    for i, c in enumerate("aex"):
        mine = lambda v, i=i: F.when(F.col("t") == i, v)
        sums += [F.coalesce(F.sum(mine(F.lit(1).cast("long"))), F.lit(0)).alias(f"n{c}"), F.coalesce(F.bit_xor(mine(F.col("key"))), F.lit(0)).alias(f"k{c}"), F.coalesce(F.bit_xor(mine(F.col("chk"))), F.lit(0)).alias(f"c{c}")]
    sketches = spread.groupBy("k1", "k2", "shape", "cells", "cell").agg(*sums)

    # which planes a cell goes to; what it holds of each is a difference of counts and digests
    at = lambda log, p: F.when(F.col("cells") == power(log), p)
    pairs = [F.when(F.col("cells") == -1 - p, p + PEELED) for p in (PAIR_EDITED, PAIR_NEXT)] if exact else [at(l0, PAIR_EDITED), at(l1, PAIR_NEXT)]
    planes = F.array(at(la, OWN), at(le, EDITED), *pairs, *[F.when(F.col("cells") == -p, p) for p in (SIZES, SHA)])
    made = sketches.withColumn("p", F.explode(planes)).where("p is not null")
    p, zero = F.col("p"), F.lit(0).cast("long")
    left, right = p != EDITED, F.when(p % PEELED == PAIR_EDITED, "e").when(p % PEELED == PAIR_NEXT, "x").when(p == EDITED, "e")
    right = F.when(p >= SIZES, F.lit("")).otherwise(F.coalesce(right, F.lit("")))
    values = []
    for name, c in (("cnt", "n"), ("key", "k"), ("chk", "c")):
        less = F.when(right == "e", F.col(f"{c}e")).when(right == "x", F.col(f"{c}x")).otherwise(zero)
        more = F.when(left, F.col(f"{c}a")).otherwise(zero)
        values.append((F.when(left, more - less).otherwise(less) if c == "n" else more.bitwiseXOR(less)).alias(name))
    made = made.select("k1", "k2", "p", "cells", "cell", *values)
    if exact:
        digest = F.col("p").isin(PAIR_EDITED + PEELED, PAIR_NEXT + PEELED)
        made = made.select("k1", "k2", "p", "cells", "cell", "cnt", *[F.when(digest, zero).otherwise(F.col(c)).alias(c) for c in ("key", "chk")]).where(~digest | (F.col("cnt") != 0))
    published = F.col("p").isin(OWN, EDITED)
    return made.select("*", *[F.when(published, F.col(c)).otherwise(zero).alias(f"o{c}") for c in ("cnt", "key", "chk")]).where(_holds())


def _holds() -> Column:
    """Whether a cell holds anything, or held anything when it was published."""
    return (F.col("p") >= SIZES) | (F.col("cnt") != 0) | (F.col("key") != 0) | (F.col("chk") != 0) | (F.col("ocnt") != 0)


def _peeled(rows: DataFrame, sweeps: int) -> DataFrame:
    """Peel all sketches, one subtable after the other, in which a digest has one cell only."""
    p, to, zero = F.col("p"), F.col("to"), F.lit(0).cast("long")
    pure = (p <= EDITED) & (F.abs("cnt") == 1) & (_check(F.col("key")) == F.col("chk"))
    # a pure cell goes to its digest's cell in each subtable, any other cell stays (3)
    spots, there = F.array(*map(F.lit, range(3))), F.floor(F.col("cell") / F.col("cells"))
    place = _place(F.col("key"), to, F.col("cells")).cast("long")
    columns = {}
    for sub in range(3):
        # of a published sketch only what it was is kept, of a pair what was peeled
        own, gone = to == sub, (to == sub) & (p >= OWN)
        columns[sub] = [
            "k1", "k2", F.when(own & (p < OWN), p + PEELED).otherwise(p).cast("int").alias("p"), "cells",
            F.when((to == 3) | gone, F.col("cell")).when(own, F.col("key")).otherwise(place).alias("cell"),
            F.when(gone, zero).when((to == 3) | own, F.col("cnt")).otherwise(-F.col("cnt")).alias("cnt"),
            *[F.when((to == 3) | ~own, F.col(c)).otherwise(zero).alias(c) for c in ("key", "chk")],
            *[F.when((to == 3) | own, F.col(c)).otherwise(zero).alias(c) for c in ("ocnt", "okey", "ochk")],
        ]
    sums = [F.sum(c).alias(c) if c in ("cnt", "ocnt") else F.bit_xor(c).alias(c) for c in ("cnt", "key", "chk", "ocnt", "okey", "ochk")]
    holds = _holds()
    goes = [F.explode(F.when(pure & (there == sub), spots).otherwise(F.array(F.lit(3)))).alias("to") for sub in range(3)]
    for sub in [0, 1, 2] * sweeps:
        rows = rows.select("*", goes[sub]).select(*columns[sub]).groupBy("k1", "k2", "p", "cells", "cell").agg(*sums).where(holds)
    return rows


def _hex(c: Column, digits: int) -> Column:
    return F.lower(F.lpad(F.hex(c), digits, "0"))


FOUND = {OWN: ["fingerprint"], EDITED: ["edited_fingerprint"], PAIR_EDITED: ["near_edited", "removed", "added"], PAIR_NEXT: ["near_next"]}


def _compared(docs: DataFrame, pairs: DataFrame, once: bool, attempt: int, exact: bool) -> DataFrame:
    """One row per pair, g1 and g2, with what this attempt found; what it did not is null.

    A sketch as text: cells of a subtable, and after a colon its filled cells in order, each its
    place, count, and digests with checks, in hexadecimal.
    """
    rows = _planes(_versions(docs, pairs, once, attempt > 0), attempt, exact)
    rows = _peeled(rows, SWEEPS + min(attempt, MORE_SWEEPS))
    p, cell, cnt, last = F.col("p"), F.col("cell"), F.col("cnt"), attempt + 1 >= MOST_SIZES
    shown = F.concat(_hex(cell, 8), F.lit("-"), F.lower(F.hex("ocnt")), F.lit("-"), _hex(F.col("okey"), 16), _hex(F.col("ochk"), 8))
    rows = rows.withColumn("shown", F.when(p.isin(OWN, EDITED), shown).when(p == SHA, F.concat(cell.cast("string"), _hex(F.col("key"), 16))))
    count = lambda test: F.count(F.when(test, 1))
    aggregates = [F.array_sort(F.collect_list(F.when(p == SHA, F.col("shown")))).alias("sha")]
    aggregates += [F.max(F.when((p == SIZES) & (cell == i), F.col("key"))).alias(n) for i, n in enumerate(("size0", "size1", "size2", "n_chars", "times", "no_id"))]
    for plane in FOUND:
        aggregates.append(count((p == plane) & ((cnt != 0) | (F.col("key") != 0) | (F.col("chk") != 0))).alias(f"stuck{plane}"))
        if plane >= OWN:
            aggregates += [F.array_sort(F.collect_list(F.when(p == plane, F.col("shown")))).alias(f"text{plane}"), F.max(F.when(p == plane, F.col("cells"))).alias(f"cells{plane}")]
        else:
            aggregates += [count((p == plane + PEELED) & (cnt > 0)).alias(f"own{plane}"), count((p == plane + PEELED) & (cnt < 0)).alias(f"other{plane}")]
    aggregates += [F.array_sort(F.collect_list(F.when((p == PAIR_EDITED + PEELED) & test, cell))).alias(n) for n, test in (("gone", cnt > 0), ("come", cnt < 0))]
    made = rows.groupBy("k1", "k2").agg(*aggregates)
    values = {"removed": F.col("gone"), "added": F.col("come")}
    for plane, name, other in ((PAIR_EDITED, "near_edited", 1), (PAIR_NEXT, "near_next", 2)):
        # shared digests as a share of all, from what was peeled and the sizes of both sets
        shared = F.col("size0") - F.col(f"own{plane}")
        values[name] = F.when(F.col("size0") + F.col(f"size{other}") == 0, 1.0).otherwise(shared / (F.col("size0") + F.col(f"other{plane}")))
    for plane, name in ((OWN, "fingerprint"), (EDITED, "edited_fingerprint")):
        values[name] = F.concat(F.lower(F.hex(F.coalesce(f"cells{plane}", F.lit(0)))), F.lit(":"), F.array_join(f"text{plane}", "."))
    columns = [(values[n] if last and plane >= OWN else F.when(F.col(f"stuck{plane}") == 0, values[n])).alias(n) for plane, names in FOUND.items() for n in names]
    sha = F.array_join(F.transform("sha", lambda x: F.substring(x, 2, 16)), "")
    return made.select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), F.when(F.col("no_id") == 0, F.col("k1")).alias("doc_id"), "n_chars", "times", F.lit(attempt).alias("attempt"), sha.alias("edited_sha256"), *columns)


def fingerprints(docs: DataFrame, attempts: int = 9) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the digests that the edit removed and added.

    Pairs are peeled in ``attempts`` attempts and then compared digest by digest.
    """
    pairs = successors(docs)
    once = not pairs.where("times > 1").limit(1).count()
    same = (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2"))
    parts = [names[0] for names in FOUND.values()]
    todo, tried = pairs, []
    for attempt in range(MOST_SIZES):
        made = _compared(docs, todo, once, attempt, attempt >= attempts)
        # both sketches of a row in one column, as equal cells that lie together compress
        cut = Cut(made.select("*", F.array("fingerprint", "edited_fingerprint").alias("shown")).drop("fingerprint", "edited_fingerprint"), "sketches")
        got = cut.df.select("*", F.col("shown")[0].alias("fingerprint"), F.col("shown")[1].alias("edited_fingerprint")).drop("shown")
        tried.append(got)
        if attempt == 0:
            open_ = got.select("g1", "g2", *[F.col(c).isNotNull().alias(f"has_{c}") for c in parts])
        else:
            so_far = todo.select("k1", "k2", *[f"has_{c}" for c in parts])
            open_ = got.join(so_far, same).select("g1", "g2", *[(F.col(c).isNotNull() | F.col(f"has_{c}")).alias(f"has_{c}") for c in parts])
        left = Cut(open_.where(" or ".join(f"not has_{c}" for c in parts)), "sketch-open").df
        if left.isEmpty():
            break
        todo = Cut(pairs.join(left, same).drop("g1", "g2"), "sketch-retry").df
    found = tried[0]
    if len(tried) > 1:
        whole = " and ".join(f"{c} is not null" for c in parts)
        names = [n for some in FOUND.values() for n in some]
        several = tried[0].where(f"not ({whole})")
        for more in tried[1:]:
            several = several.union(more)
        facts = [F.first(c).alias(c) for c in ("doc_id", "n_chars", "times")]
        first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("attempt"))).alias(c)
        merged = several.groupBy("g1", "g2").agg(*facts, F.min("attempt").alias("attempt"), *[first(c) for c in ("edited_sha256", *names)])
        found = tried[0].where(whole).unionByName(merged)
    # nothing is joined here: the strings would be shuffled
    named = found
    if not once:
        named = named.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return named.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "removed", "added")


def op8_sketch(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))
