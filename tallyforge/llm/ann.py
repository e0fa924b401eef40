"""Nearest neighbours by additive quantisation, none lost.

Full-dimensional codebooks are fitted on the driver to a bounded, documented sample (SAMPLE
vectors, and at most SAMPLE_BYTES): by k-means on residuals, then by least squares against codes.
Every distinct vector is encoded by beam search and stored with its codes, the squared norm of its
reconstruction, and the length of what that leaves of it. A search adds up tables of inner products
of a query with each code word, takes the nearest DEPTH share of each block of rows, and ranks those
again on the original vectors in double precision. Then it ranks every other row whose score by
tables and whose length of what is left allow it to reach the last of the best: no neighbour is
lost, and where codes cannot tell rows apart, more rows are ranked.

Equal vectors are indexed once with as many of their smallest ids as can be asked for, so a vector
that many rows repeat costs one row. Queries are taken in bounded chunks, one broadcast at a time,
each chunk's results being written before the next; the index is read in place, and what is shuffled
is each partition's best rows per query.

Defined results: vectors that are null, zero, or hold null or non-finite components, those whose
dimension is not the most frequent one, and rows without an id take no part; a row that repeats an
id and a vector counts once, an id with several vectors is searched for with each; a query without
candidates gives no rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Cut, table

BOOKS, WORDS, BEAM, SAMPLE, SAMPLE_BYTES = 24, 64, 8, 20_000, 32 << 20
#: The share of a block's rows that is ranked again first, and the least number of them.
DEPTH, LEAST_DEPTH, BLOCK, QUERY_BYTES = 0.04, 200, 16_384, 32 << 20


@dataclass
class Codebooks:
    """Code words: books x words x dimensions."""

    words: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n x books, uint8) and squared norms of the sums of their words, by beam search."""
        books, k, d = self.words.shape
        codes, norms = np.zeros((len(x), books), np.uint8), np.zeros(len(x), np.float32)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024].astype(np.float32)
            n = len(part)
            rest, error, paths = part[:, None, :], (part**2).sum(1)[:, None], np.zeros((n, 1, 0), np.uint8)
            for m in range(books):
                words = self.words[m]
                # |r - c|^2 = |r|^2 - 2 r.c + |c|^2 for each kept sum and word
                cost = error[:, :, None] - 2 * (rest.reshape(-1, d) @ words.T).reshape(n, -1, k) + (words**2).sum(1)
                flat = cost.reshape(n, -1)
                keep = min(beam if m < books - 1 else 1, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                rows = np.arange(n)[:, None]
                error, was, word = flat[rows, best], best // k, best % k
                rest = rest[rows, was] - words[word]
                paths = np.concatenate([paths[rows, was], word[:, :, None].astype(np.uint8)], axis=2)
            codes[at : at + n] = paths[:, 0]
            norms[at : at + n] = ((part - rest[:, 0]) ** 2).sum(1)
        return codes, norms

    @classmethod
    def fit(cls, x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = 7) -> Codebooks:
        rng, x = np.random.default_rng(seed), x.astype(np.float32)
        words = max(1, min(words, len(x)))
        made, rest = [], x.copy()
        for _ in range(books):
            centres = rest[rng.choice(len(rest), words, replace=False)].copy()
            for _ in range(6):
                near = np.argmin((centres**2).sum(1) - 2 * rest @ centres.T, axis=1)
                sums = (near[None, :] == np.arange(words)[:, None]).astype(np.float32) @ rest
                counts = np.bincount(near, minlength=words)[:, None]
                centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres).astype(np.float32)
            near = np.argmin((centres**2).sum(1) - 2 * rest @ centres.T, axis=1)
            rest -= centres[near]
            made.append(centres)
        self = cls(np.stack(made))
        for _ in range(rounds if len(x) > words else 0):
            codes, _ = self.encode(x)
            at = codes.astype(np.int64) + np.arange(books) * words
            gram, right = np.zeros((books * words,) * 2), np.zeros((books * words, x.shape[1]))
            for part in range(0, len(x), 4096):
                uses = np.zeros((len(at[part : part + 4096]), books * words), np.float32)
                uses[np.arange(len(uses))[:, None], at[part : part + 4096]] = 1
                gram += uses.T @ uses
                right += uses.T @ x[part : part + 4096]
            gram[np.diag_indices(len(gram))] += 1e-2
            self = cls(np.linalg.solve(gram, right).reshape(books, words, -1).astype(np.float32))
        return self

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """The sums of the words of codes, in double precision."""
        made = np.zeros((len(codes), self.words.shape[2]))
        for m, words in enumerate(self.words):
            made += words[codes[:, m]]
        return made

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products: queries x books x words."""
        books, k, d = self.words.shape
        return (queries.astype(np.float32) @ self.words.reshape(-1, d).T).reshape(len(queries), books, k)


class Best:
    """The best rows so far of each query: score, row id, the row's ids."""

    def __init__(self, n: int, top: int):
        self.score, self.row = np.full((n, top), -np.inf), np.full((n, top), np.iinfo(np.int64).max)

    def merge(self, q: slice, score: np.ndarray, row: np.ndarray) -> None:
        top = self.score.shape[1]
        score, row = np.concatenate([self.score[q], score], 1), np.concatenate([self.row[q], row], 1)
        order = np.lexsort((row, -score), axis=1)[:, :top]
        self.score[q], self.row[q] = np.take_along_axis(score, order, 1), np.take_along_axis(row, order, 1)


def search_block(books: Codebooks, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray, rests: np.ndarray, vectors: np.ndarray, ids: np.ndarray, best: Best, measure: str, step: int = 256) -> None:
    """Score a block by tables, rank the nearest share again exactly, then all others that can still reach the best, and merge them into ``best``."""
    depth = min(len(ids), max(LEAST_DEPTH, best.score.shape[1] + 1, int(DEPTH * len(ids))))
    columns = np.ascontiguousarray(codes.T).astype(np.intp)
    squares = (vectors**2).sum(1)
    # what single precision can err by in a sum of table entries, for a query of length 1
    longest = np.sqrt((books.words.astype(np.float64) ** 2).sum(2).max(1)).sum()
    err, tiny = (vectors.shape[1] + len(columns) + 4) * float(np.finfo(np.float32).eps) * longest, 1e-37 * (1 + longest)

    def scores(dots: np.ndarray, square: np.ndarray, of: np.ndarray) -> np.ndarray:
        return -np.sqrt(np.maximum(0, square - 2 * dots + of)) if measure == "l2" else dots

    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        square = (q**2).sum(1)[:, None]
        tables = books.tables(q)
        rough = np.take(tables[:, 0], columns[0], axis=1)
        for m in range(1, len(columns)):
            rough += np.take(tables[:, m], columns[m], axis=1)
        if measure == "l2":
            rough = 2 * rough - norms
        near = np.argpartition(-rough, depth - 1, axis=1)[:, :depth] if depth < len(ids) else np.broadcast_to(np.arange(len(ids)), rough.shape)
        exact = np.stack([vectors[near[i]] @ q[i] for i in range(len(q))])
        best.merge(slice(at, at + len(q)), scores(exact, square, squares[near]), ids[near])
        if depth == len(ids):
            continue
        # no row scores more than this: its code's score and the length of what its code leaves
        length = np.sqrt(square)
        if measure == "l2":
            most = rests - np.sqrt(np.maximum(0, square - rough - err * (2 * length + longest) - tiny)) + 1e-7 * (length + longest + rests)
        else:
            most = rough + length * (rests * (1 + 1e-9) + err) + tiny
        open_ = ~(most < best.score[at : at + len(q), -1:]) | ~np.isfinite(rough)
        np.put_along_axis(open_, near, False, axis=1)
        count = open_.sum(1)
        many = np.flatnonzero(count > len(ids) // 16)  # one product of matrices costs less than picking rows
        whole = dict(zip(many.tolist(), q[many] @ vectors.T)) if len(many) else {}
        for i in np.flatnonzero(count):
            rows = np.flatnonzero(open_[i])
            found = scores(whole[i][rows] if i in whole else vectors[rows] @ q[i], square[i], squares[rows])
            reach = ~(found < best.score[at + i, -1])
            if reach.any():
                found, rows = found[reach], rows[reach]
                if len(found) > best.score.shape[1]:  # with all that tie with the last
                    reach = found >= np.partition(found, -best.score.shape[1])[-best.score.shape[1]]
                    found, rows = found[reach], rows[reach]
                best.merge(slice(at + i, at + i + 1), found[None], ids[rows][None])


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def _floats(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, is_query: Column, top: int = 20, measure: str = "ip") -> DataFrame:
    """One row per query and neighbour: query_id, rank, vec_id, score. ``vectors``: vec_id, embedding."""
    spark = vectors.sparkSession
    valid = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("v"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    d = sizes[0][0]
    hashed = valid.where(F.size("v") == d).withColumn("h", F.xxhash64("v"))
    least = F.dense_rank().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    few = hashed.withColumn("nth", least).where(F.col("nth") <= top + 1)
    distinct = Cut(few.groupBy("h", "v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("row"), "h", "v", "ids"), "vectors")
    n = distinct.df.count()
    bound = max(256, min(SAMPLE, SAMPLE_BYTES // (8 * d)))
    sampled = distinct.df.orderBy(F.xxhash64("row"), "row").limit(bound).select("v").toArrow()
    books = spark.sparkContext.broadcast(Codebooks.fit(_floats(sampled["v"])))
    index = _index(distinct.df, books, n)
    asked = Cut(hashed.where("asks").join(distinct.df.select(F.col("h").alias("h2"), F.col("v").alias("v2"), "row"), (F.col("h") == F.col("h2")) & (F.col("v") == F.col("v2"))).select("vec_id", "row").distinct(), "queries").df
    chosen = Cut(distinct.df.join(asked.select(F.col("row").alias("asked")).distinct(), F.col("row") == F.col("asked"), "left_semi").select("row", "v"), "query-vectors").df
    parts = []
    for chunk in _chunks(chosen, d):
        queries = spark.sparkContext.broadcast(chunk)
        parts.append(Cut(_search_chunk(index, books, queries, top, measure), "near"))
        queries.unpersist()
    if not parts:
        return spark.createDataFrame([], schema)
    found = parts[0].union(parts[1:])
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "row"))
    best = Cut(found.withColumn("place", place).where(F.col("place") <= top + 1).select("q", "row", "score"), "found").df
    for part in parts:
        part.drop()
    with_ids = best.join(distinct.df.select(F.col("row").alias("r"), "ids"), F.col("row") == F.col("r"))
    lists = with_ids.groupBy("q").agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("id"))))).alias("near"))
    own = asked.withColumnRenamed("vec_id", "query_id").join(lists, F.col("row") == F.col("q"))
    others = F.slice(F.array_sort(F.filter("near", lambda x: x["id"] != F.col("query_id"))), 1, top)
    return own.select("query_id", F.posexplode(others)).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.id").alias("vec_id"), (0 - F.col("col.far")).alias("score"))


def _index(distinct: DataFrame, books, n: int) -> DataFrame:
    """Every distinct vector with its codes, dealt into partitions of about a block."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _floats(batch.column("v"))
                codes, _ = books.value.encode(x)
                sums = books.value.sums(codes)
                norms, rests = (sums**2).sum(1).astype(np.float32), np.sqrt(((x - sums) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("v"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float32()), pa.array(rests)], ["row", "v", "codes", "norm", "rest"])

    parts = max(1, -(-n // BLOCK), min(8, -(-n // 512)))
    schema = f"row long, v {distinct.schema['v'].dataType.simpleString()}, codes binary, norm float, rest double"
    return Cut(distinct.select("row", "v").repartition(parts, "row").mapInArrow(encoded, schema), "index").df


def _chunks(chosen: DataFrame, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The query vectors in chunks of at most QUERY_BYTES."""
    n = chosen.count()
    if not n:
        return
    chunks = -(-n * 8 * d // QUERY_BYTES)
    for c in range(chunks):
        arrow = chosen.where(F.pmod(F.xxhash64("row"), F.lit(chunks)) == c).toArrow()
        if arrow.num_rows:
            yield arrow["row"].to_numpy(), _floats(arrow["v"])


def _search_chunk(index: DataFrame, books, queries, top: int, measure: str) -> DataFrame:
    """The best rows of each of the broadcast ``queries`` (rows, vectors), by partition of the index."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_rows, q_vectors = queries.value
        best, held, n = Best(len(q_rows), top + 1), [], 0

        def flush() -> None:
            arrow = pa.Table.from_batches(held)
            codes = np.frombuffer(b"".join(arrow["codes"].to_pylist()), np.uint8).reshape(arrow.num_rows, -1)
            search_block(books.value, q_vectors, codes, arrow["norm"].to_numpy(), arrow["rest"].to_numpy(), _floats(arrow["v"]), arrow["row"].to_numpy(), best, measure)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                flush()
                held, n = [], 0
        if n:
            flush()
        for at in range(0, len(q_rows), 1024):
            score, row = best.score[at : at + 1024], best.row[at : at + 1024]
            hit = np.isfinite(score)
            q = np.broadcast_to(q_rows[at : at + 1024, None], score.shape)
            yield pa.RecordBatch.from_arrays([pa.array(q[hit]), pa.array(row[hit]), pa.array(score[hit])], ["q", "row", "score"])

    return index.mapInArrow(searched, "q long, row long, score double")


def op7_ann(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors["vec_id"] % 20 == 0)
