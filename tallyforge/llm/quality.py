"""Quality: histogram gradient-boosted trees over document statistics.

Statistics are computed once per document. Trees are grown on the driver over binned statistics
of at most MAX_LABELLED labelled documents, then flattened into arrays that numpy walks for all
documents and trees of a batch at once.

Defined results: null and empty texts have the statistics of an empty text; without labels of both
kinds every score is the share of label 1 (0.5 without labels); rows that repeat score alike; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import remainder, sample
from .scratch import table

THRESHOLD = 0.3
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STATISTICS = (
    "chars", "words", "word_length", "distinct_words", "top_word", "same_as_last", "lines", "line_words", "distinct_lines", "long_words", "short_words", "edge_signs",
    "upper", "digits", "letters", "not_ascii", "sentence_ends", "commas", "bars", "exclaims", "other_signs", "starts_upper", "pairs_distinct",
)
_BYTES = np.zeros((256, 9))
for _i, _chosen in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "abcdefghijklmnopqrstuvwxyz", None, ".?", ",;:", "|", "!", "#$%&*+<=>@\\^_`~{}[]/")):
    _BYTES[[*range(128, 256)] if _chosen is None else [*map(ord, _chosen)], _i] = 1


def statistics(text: str | None) -> list[float]:
    text = text or ""
    words, lines = text.split(), text.split("\n")
    n, n_lines = max(1, len(words)), max(1, len(lines))
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    shares = (np.bincount(raw, minlength=256) @ _BYTES) / max(1, len(raw))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    top = max(counts.values(), default=0)
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    edge = sum(w[-1] in SIGNS for w in words)
    return [
        len(text), len(words), lengths.sum() / n, len(counts) / n, top / n, same / n, len(lines), n / n_lines, len(set(lines)) / n_lines, (lengths > 12).sum() / n, (lengths < 3).sum() / n, edge / n,
        *shares, sum(w[0].isupper() for w in words) / n, pairs / n,
    ]


@dataclass
class Trees:
    """All trees in flat arrays; a leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        if len(self.roots):
            rows = np.arange(len(x))[:, None]
            at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total = total + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Trees:
    """Boost ``trees`` trees on the logistic loss over histograms of at most ``bins`` quantile bins."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    bias = float(np.log(share / (1 - share)))
    empty = Trees(*(np.zeros(0, t) for t in (int, float, int, int, float, int)), depth, bias)
    if not len(y) or y.min() == y.max():
        return empty
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(k)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(k)], 1)
    offsets = np.arange(k) * (bins + 1)
    flat = binned + offsets
    logit = np.full(n, bias)
    nodes: list[list] = []
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
        work = [(roots[-1], np.arange(n), 0)]
        while work:
            node, rows, level = work.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = None
            if level < depth and len(rows) >= 2 * least:
                size = k * (bins + 1)
                keys = flat[rows].ravel()
                hg = np.bincount(keys, np.repeat(g[rows], k), size).reshape(k, -1).cumsum(1)
                hh = np.bincount(keys, np.repeat(h[rows], k), size).reshape(k, -1).cumsum(1)
                hn = np.bincount(keys, minlength=size).reshape(k, -1).cumsum(1)
                gain = hg**2 / (hh + ridge) + (gs - hg) ** 2 / (hs - hh + ridge) - gs**2 / (hs + ridge)
                gain[(hn < least) | (len(rows) - hn < least)] = 0
                j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[j, b] > 1e-6 and b < len(cuts[j]):
                    best = j, b
            if best is None:
                nodes[node][4] = -rate * gs / (hs + ridge)
                logit[rows] += nodes[node][4]
                continue
            j, b = best
            nodes[node][:4] = [j, cuts[j][b], len(nodes), len(nodes) + 1]
            under = binned[rows, j] <= b
            for part in (rows[under], rows[~under]):
                work.append((len(nodes), part, level + 1))
                nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
    columns = list(zip(*nodes))
    return Trees(*(np.array(c, t) for c, t in zip(columns, (int, float, int, int, float))), np.array(roots), depth, bias)


def _matrix(texts: Iterable[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, len(STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> Trees:
    def measured(frames):
        for frame in frames:
            x = _matrix(frame["text"])
            yield pd.DataFrame(x, columns=list(STATISTICS)).assign(y=frame["y"].to_numpy())

    schema = ", ".join(f"{s} double" for s in STATISTICS) + ", y int"
    data = sample(docs, labels, "quality", mod, held).mapInPandas(measured, schema).toPandas()  # MAX_LABELLED rows of numbers
    data = data.sort_values(list(data.columns))  # else the order in which tasks end would decide ties
    return grow(data[list(STATISTICS)].to_numpy(float), data["y"].to_numpy(float))


def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    trees = fit(docs, table(spark, sf_dir, "labels"))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(trees.score(_matrix(texts)), dtype="float64")

    scored = docs.select("doc_id", (remainder(docs["doc_id"], 5) == 0).alias("held_out"), score(docs["text"]).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
