"""Labelled rows to learn from, and the split by id that keeps some out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents are learned from, those with the smallest hashes.
MAX_LABELLED = 20_000


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, most: int = MAX_LABELLED) -> DataFrame:
    """(text, y) of at most ``most`` labelled documents outside the held-out remainder.

    Labels that are null are no labels; an id labelled twice is learned with its larger label, and
    an id that several rows bear with one of its texts, that of the smallest hash (null texts last).
    The ids are bounded by ``most`` and so may be broadcast; rows of one id are reduced to one
    before they are shuffled, so no text is shuffled but those that are learned from.
    """
    learn = labels.where(labels[label].isNotNull() & labels["doc_id"].isNotNull() & (remainder(labels["doc_id"], mod) != held))
    some = learn.groupBy(F.col("doc_id").alias("__id")).agg((F.max(label) > 0).cast("int").alias("__y"))
    some = some.orderBy(F.xxhash64("__id"), "__id").limit(most)
    rows = docs.join(F.broadcast(some), docs["doc_id"] == F.col("__id")).select("__id", "__y", docs["text"].alias("__text"))
    one = F.min(F.struct(F.col("__text").isNull(), F.xxhash64("__text"), F.col("__text").alias("text"))).alias("__one")
    return rows.groupBy("__id", "__y").agg(one).select(F.col("__one.text").alias("text"), F.col("__y").alias("y"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the first column is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
