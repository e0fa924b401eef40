"""Language identification by rank-order profiles.

A profile lists the most frequent n-grams (1 to 3 letters, with a blank at word edges) by rank.
A document's profile is compared with each language's by out-of-place distance: the sum of rank
differences, with a fixed penalty for n-grams the language's profile lacks. Language profiles
count the n-grams of all learned documents, added up by partition before they are shuffled.

N-grams are packed into integers and counted by sorting, a text at a time, in numpy; an n-gram that
begins with a blank counts together with the same letters without it. A text is counted in pieces of
PIECE characters, and n-grams over a cut as any others.

Defined results: a text that is null or has no letter is ``und`` with score 0; a document as far
from two languages goes to the first by name; without learned languages all is ``und``; rows that
repeat are judged alike; an empty table gives an empty result; further columns are ignored, and
kept by ``keep_known``. The score is 1 less the distance as a share of the largest distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .labelled import remainder
from .scratch import table

UNKNOWN, TOP, PIECE = "und", 300, 1 << 20
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _pieces(text: str) -> Iterator[np.ndarray]:
    """Code points of the lower-cased text, everything but letters made a single blank (0).

    Each piece begins with the last two code points of the one before it, which belong to n-grams
    that end in it; the first begins, and the last ends, with a blank.
    """
    text, last = text.lower(), np.zeros(1, np.int64)
    for at in range(0, len(text) or 1, PIECE):
        codes = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(_is_letter()[codes], codes, 0).astype(np.int64)
        codes = np.concatenate([last, codes, [0]] if at + PIECE >= len(text) else [last, codes])
        codes = codes[(codes > 0) | np.concatenate([[True], codes[:-1] > 0])]
        yield codes
        last = codes[-2:]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as integers of 21 bits a letter, and their counts."""
    total: tuple[np.ndarray, np.ndarray] | None = None
    before = 1  # code points of a piece that are counted already, but for the blank at the start
    for c in _pieces(text or ""):
        two = (c[:-1] << 21) | c[1:]
        three = (two[:-1] << 21) | c[2:]
        # blanks on their own and between words are no n-grams
        one, pairs, triples = c[before:], two[before - 1 :], three[max(0, before - 2) :]
        firsts, middles = c[before - 1 : -1], c[max(1, before - 1) : -1]
        all_ = np.concatenate([one[one > 0], pairs[(firsts > 0) | (one > 0)], triples[middles > 0]])
        before = min(2, len(c))
        keys, counts = np.unique(all_, return_counts=True)
        if total is not None:
            keys, inverse = np.unique(np.concatenate([total[0], keys]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([total[1], counts]), len(keys)).astype(np.int64)
        total = keys, counts
    return total or (np.zeros(0, np.int64), np.zeros(0, np.int64))


def top(keys: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams by falling count, ties by rising key."""
    if len(keys) > 4 * most:
        some = counts >= np.partition(counts, len(counts) - most)[len(counts) - most]
        keys, counts = keys[some], counts[some]
    return keys[np.lexsort((keys, -counts))[:most]]


@dataclass
class Profiles:
    """Per language, the n-grams in the order of their keys with their ranks."""

    names: list[str]
    keys: list[np.ndarray]
    ranks: list[np.ndarray]
    most: int = TOP

    def judge(self, text: str | None) -> tuple[str, float]:
        own = top(*grams(text), self.most)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        place = np.arange(len(own))
        distances = []
        for keys, ranks in zip(self.keys, self.ranks):
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            distances.append(np.where(keys[at] == own, np.abs(ranks[at] - place), self.most).sum())
        best = int(np.argmin(distances))
        return self.names[best], float(1 - distances[best] / (self.most * len(own)))

    def column(self, text: Column) -> Column:
        """Struct (lang_pred, score)."""
        profiles = self

        @F.pandas_udf("lang_pred string, score double")
        def judge(texts: pd.Series) -> pd.DataFrame:
            found = [profiles.judge(t) for t in texts]
            return pd.DataFrame({"lang_pred": pd.Series([f[0] for f in found], dtype=object), "score": pd.Series([f[1] for f in found], dtype="float64")})

        return judge(text)


def fit(docs: DataFrame, mod: int = 4, held: int = 2, most: int = TOP) -> Profiles:
    """Profiles of the languages of all documents outside the held-out remainder."""
    learn = docs.where(docs["lang"].isNotNull() & (remainder(docs["doc_id"], mod) != held)).select(docs["lang"].alias("lang"), docs["text"].alias("text"))

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, parts: list) -> None:
            keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            held[lang] = keys, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

        for frame in frames:
            for at in range(0, len(frame), 500):
                for lang, texts in frame.iloc[at : at + 500].groupby("lang")["text"]:
                    add(lang, [*([held[lang]] if lang in held else []), *map(grams, texts)])
            if sum(len(k) for k, _ in held.values()) > 1 << 20:
                yield from out(held)
                held = {}
        yield from out(held)

    def out(held) -> Iterator[pd.DataFrame]:
        for lang, (keys, counts) in held.items():
            yield pd.DataFrame({"lang": pd.Series([lang] * len(keys), dtype=object), "gram": keys, "n": counts})

    sums = learn.mapInPandas(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked = sums.withColumn("rank", rank).where(F.col("rank") <= most).orderBy("lang", "rank").toPandas()  # ``most`` rows a language
    profiles = Profiles([], [], [], most)
    for lang, rows in ranked.groupby("lang"):
        order = np.argsort(rows["gram"].to_numpy())
        profiles.names.append(lang)
        profiles.keys.append(rows["gram"].to_numpy()[order])
        profiles.ranks.append(rows["rank"].to_numpy()[order] - 1)
    return profiles


def op2_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", (remainder(docs["doc_id"], 4) == 2).alias("held_out"), fit(docs).column(docs["text"]).alias("j"))
    return found.select("doc_id", "held_out", "j.lang_pred", "j.score")


def keep_known(docs: DataFrame, profiles: Profiles, least: float = 0.0) -> DataFrame:
    """The documents whose language is known, with a score over ``least``; the columns of ``docs``."""
    found = profiles.column(docs["text"])
    return docs.withColumn("__judged", found).where((F.col("__judged.lang_pred") != UNKNOWN) & (F.col("__judged.score") > least)).select(*[docs[c] for c in docs.columns])
