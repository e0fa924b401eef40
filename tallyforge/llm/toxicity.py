"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, decomposes compatibility forms, maps look-alike letters to Latin, drops
invisible characters, strips signs from the edges of words, and reads digits and signs inside
words as letters. Terms are whole words of up to 256 letters, or starts of words, those of 3 to 32
letters and of 64, 128 and 256; a longer word counts by its starts. Their weights are the log of how much oftener, per word, toxic documents
use them, learned from labelled documents. Hits inside an
exception phrase (given, or learned as a pair of words that clean documents use) do not count. The
score is a logistic function of the weight of all hits, of that weight per word and of the
heaviest hit, fitted on the same documents.

Learning reads at most MAX_LABELLED labelled documents and keeps at most MAX_TERMS terms.

Defined results: null and empty texts score like texts without hits; without labels of both kinds
every score is the share of label 1 (0 without labels); rows that repeat score alike; an empty
table gives an empty result; further columns are ignored, and kept by ``keep_clean``.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import logistic, remainder, sample
from .scratch import Cut, table

THRESHOLD, MAX_TERMS, MIN_SUPPORT, MIN_ODDS, STEM, EVERY, LONGEST = 0.3, 2000, 8, 2.5, 3, 32, 256
REMEMBERED = 1 << 16
#: So many candidate terms are broadcast at most; more are joined.
BROADCAST_TERMS = 1 << 19
#: A term counts at most so often in one document, lest a long document make a term.
PER_DOCUMENT = 5
#: Harmless phrases around words that insult elsewhere.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown")

# Look-alikes of Latin letters in Cyrillic and Greek, in the order of the letters.
_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
#: Digits and signs read as letters inside words; l and i fall together, as 1 may stand for either.
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
_GONE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_TABLE = {c: " " for c in (*range(0x21), *map(ord, "\"#%&'()*+,-./:;<=>?[\\]^_`{}~\x7f\x85\xa0"))} | {ord(a): b for a, b in (_ALIKE | _LEET).items()} | _GONE
_EDGES = re.compile(r"[^\w\s]+(?!\S)|(?<!\S)[^\w\s@$]+")


def fold(text: str) -> str:
    """Folded words with one or more spaces between and around them."""
    text = text.lower()
    if not text.isascii() and max(text) > "ɏ":
        text = unicodedata.normalize("NFKC", text).translate(_GONE)
    return f" {_EDGES.sub(' ', text).translate(_TABLE)} "


@dataclass
class Lexicon:
    """Terms (folded, with their edges' spaces) and weights; folded exception phrases; weights of the score."""

    terms: dict[str, float]
    phrases: list[str]
    bias: float = 0.0
    weights: tuple[float, ...] = (1.0, 1.0, 0.0)
    _machine: ahocorasick.Automaton | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                self._machine.add_word(term, (len(term), weight))
            for phrase in self.phrases:
                self._machine.add_word(phrase, (len(phrase), None))
            self._machine.make_automaton()
        return self._machine

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the hits outside exception phrases."""
        if not self.terms:
            return []
        found = [(end + 1 - n, end + 1, w) for end, (n, w) in self.machine().iter(folded)]
        spans = sorted((a, b) for a, b, w in found if w is None)
        if not spans:
            return found
        starts, ends = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
        # a phrase holds a hit if, of the phrases that begin no later, one ends no sooner
        return [h for h in found if h[2] is not None and not ((i := bisect_right(starts, h[0])) and ends[i - 1] >= h[1])]

    def features(self, text: str | None) -> tuple[float, float, float]:
        """The logarithms of the hits' weight, and of their weight per thousand words; the heaviest hit."""
        folded = fold(text or "")
        weights = [w for _, _, w in self.hits(folded)]
        weight = sum(weights)
        return math.log1p(weight), math.log1p(1000 * weight / max(1, len(folded.split()))) if weight else 0.0, max(weights, default=0.0)

    def score(self, texts: Iterator[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ np.array(self.weights), -30, 30)))

    def column(self, text: Column) -> Column:
        lexicon = self

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            return pd.Series(lexicon.score(texts), dtype="float64")

        return score(text)


def _starts(word: str) -> Iterator[str]:
    """The starts of a word that can be terms, the shortest first."""
    for i in range(STEM, min(len(word), EVERY + 1)):
        yield f" {word[:i]}"
    i = 2 * EVERY
    while i < len(word) and i <= LONGEST:
        yield f" {word[:i]}"
        i *= 2


class _Terms(dict):
    """The terms that a word makes, remembered for REMEMBERED words of at most EVERY letters.

    ``among``: only these terms, which hold every start of a start that they hold.
    """

    def __init__(self, among: frozenset[str] | None = None):
        self.among = among

    def __missing__(self, word: str) -> list[str]:
        made = []
        if len(word) > 2:
            whole = f" {word} "
            if len(word) <= LONGEST and (self.among is None or whole in self.among):
                made.append(whole)
            for start in _starts(word):
                if self.among is not None and start not in self.among:
                    break  # nor is a longer one
                made.append(start)
        if len(word) <= EVERY and len(self) < REMEMBERED:
            self[word] = made
        return made

    def counts(self, text: str) -> dict[str, int]:
        """Words and starts of words, with their counts; the empty string counts the words."""
        words = Counter(fold(text).split())
        found: dict[str, int] = {}
        for w, n in words.items():
            for term in self[w]:
                found[term] = found.get(term, 0) + n
        found = {t: min(n, PER_DOCUMENT) for t, n in found.items()}
        found[""] = sum(words.values())
        return found


def _phrases(lexicon: Lexicon, text: str) -> dict[str, int]:
    """Pairs of words, of up to LONGEST letters, that hold a hit."""
    words = fold(text).split()
    hit = {w for w in set(words) if lexicon.hits(f" {w} ")}
    if any(len(w) > LONGEST for w in words):
        return dict.fromkeys((f" {a} {b} " for a, b in zip(words, words[1:]) if (a in hit or b in hit) and max(len(a), len(b)) <= LONGEST), 1)
    return dict.fromkeys((f" {a} {b} " for a, b in zip(words, words[1:]) if a in hit or b in hit), 1)


def _counts(labelled: DataFrame, keys) -> DataFrame:
    """Each key's documents and uses by label (docs1, n1, docs0, n0), counted by partition first.

    ``keys`` makes, in each task, the function from a text to its keys with their counts.
    """

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, seen = keys(), [Counter() for _ in range(4)]
        for frame in frames:
            for text, y in zip(frame["text"], frame["y"]):
                found = of(text or "")
                seen[2 - 2 * y].update(found.keys())
                seen[3 - 2 * y].update(found)
            if len(seen[0]) + len(seen[2]) > 500_000:
                yield out(seen)
                seen = [Counter() for _ in range(4)]
        yield out(seen)

    def out(seen: list[Counter]) -> pd.DataFrame:
        every = list(seen[0].keys() | seen[2].keys())
        return pd.DataFrame({"key": pd.Series(every, dtype=object)} | {c: [s[k] for k in every] for c, s in zip(("docs1", "n1", "docs0", "n0"), seen)})

    found = labelled.mapInPandas(counted, "key string, docs1 long, n1 long, docs0 long, n0 long")
    return found.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("docs1", "n1", "docs0", "n0")])


def fit(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    spark = docs.sparkSession
    sampled = Cut(sample(docs, labels, "toxic", mod, held), "toxic-sample")
    labelled = sampled.df
    n = dict(labelled.groupBy("y").count().collect())
    pos, neg = n.get(1, 0), n.get(0, 0)
    given = [f" {' '.join(fold(e).split())} " for e in exceptions]
    if not pos or not neg:
        share = (pos + 1e-9) / (pos + neg + 2e-9) if pos + neg else 1e-9
        sampled.drop()
        return Lexicon({}, given, float(np.log(share / (1 - share))), (0.0, 0.0, 0.0))
    # toxic documents say what can be a term, and then only that is counted in the others
    toxic = Cut(_counts(labelled.where("y = 1"), lambda: _Terms().counts).where(f"key = '' or docs1 >= {MIN_SUPPORT}"), "toxic-terms")
    among = None
    if toxic.df.count() <= BROADCAST_TERMS:
        among = spark.sparkContext.broadcast(frozenset(r[0] for r in toxic.df.select("key").toLocalIterator()))
    others = _counts(labelled.where("y = 0"), lambda: _Terms(among and among.value).counts)
    others = others.select(F.col("key").alias("of"), F.col("docs0").alias("docs"), F.col("n0").alias("n"))
    both = toxic.df.join(others, F.col("key") == F.col("of"), "left")
    counted = Cut(both.select("key", "docs1", "n1", F.coalesce("docs", "docs0").alias("docs0"), F.coalesce("n", "n0").alias("n0")), "toxic-counts")
    counts = counted.df
    _, _, words1, _, words0 = counts.where("key = ''").select("key", "docs1", "n1", "docs0", "n0").first()
    odds = F.log((F.col("n1") + 0.5) / (words1 + 1.0)) - F.log((F.col("n0") + 0.5) / (words0 + 1.0))
    found = counts.where("key <> ''").select("key", "docs1", odds.alias("odds")).where(F.col("odds") >= MIN_ODDS)
    best = found.orderBy(F.desc(F.col("odds") * F.col("docs1")), F.length("key").desc(), "key").limit(MAX_TERMS)
    terms: dict[str, float] = {}
    for key, _, weight in best.collect():  # MAX_TERMS rows at most
        if not any(key.startswith(t) or t.startswith(key) for t in terms):
            terms[key] = float(weight)
    lexicon = Lexicon(terms, given)
    clean = _counts(labelled, lambda: lambda t: _phrases(lexicon, t)).where("docs0 >= 5 and docs0 >= 0.95 * (docs0 + docs1)").orderBy(F.desc("docs0"), "key").limit(MAX_TERMS)
    lexicon = Lexicon(terms, given + [r[0] for r in clean.collect()])

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array([lexicon.features(t) for t in frame["text"]]).reshape(-1, 3)
            yield pd.DataFrame(x, columns=list("abc")).assign(y=frame["y"].to_numpy())

    data = labelled.mapInPandas(features, "a double, b double, c double, y int").toPandas()  # MAX_LABELLED rows of numbers
    data = data.sort_values(list(data.columns))
    for cut in (sampled, toxic, counted):
        cut.drop()
    bias, *weights = logistic(np.column_stack([np.ones(len(data)), data[["a", "b", "c"]]]), data["y"].to_numpy(float))
    return Lexicon(lexicon.terms, lexicon.phrases, float(bias), tuple(map(float, weights)))


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lexicon = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (remainder(docs["doc_id"], 4) == 2).alias("held_out"), lexicon.column(docs["text"]).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The documents whose score lies under the threshold; the columns of ``docs``."""
    return docs.where(lexicon.column(docs["text"]) < THRESHOLD)
