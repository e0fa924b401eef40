"""Sum-of-squares online packing of tokenised documents into windows.

A document is cut into full windows as long as it fills one; the rest goes to the fill level at
which the sum of squares of the counts of open windows by level grows least (ties: the fullest),
found in an array of those counts. When a partition ends, and whenever too many windows are open,
open windows are filled up from the emptiest ones by cutting; what is left at the end is cut into
windows whose lengths are powers of two, which need no padding.

Each partition packs on its own, so no text is shuffled and memory is bounded by the windows that
are open. Sequence ids hold the partition's number in their upper half: a task that runs again
gives the same rows as long as its input partition holds the same rows in the same order, as
scans of files do.

Defined results: null text is the empty text, whose only id is the closing one; rows that repeat
an id are packed one by one; a null doc_id stays null; an empty table gives no rows; further
columns are ignored; special tokens written out in a text are read as the tokenizer reads them.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .scratch import table

CAPACITY, CLOSING, LONG = 4096, 2, 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Fixed value: the pattern by which the tokenizer splits words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile("[!-~¡-ɏ]+")
_END = b"\xff"


def _byte_of() -> dict[str, int]:
    """The usual printable alphabet of byte-level vocabularies: printable Latin-1 stands for itself, other bytes for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Words(dict):
    """Ids by word; a word that is not here comes from the older generation, or is made."""

    __slots__ = ("fresh", "old")

    def __init__(self, fresh, old: dict[str, bytes]):
        self.fresh, self.old = fresh, old

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.fresh(word)
        if len(word) <= LONG:
            self[word] = ids
        return ids


class WordTokens:
    """Ids of texts as little-endian bytes, remembering words.

    White space always parts tokens, so a text's ids are those of its words. New words of plain
    Latin letters and signs go straight to a byte-pair merger over the same vocabulary, in which a
    byte that UTF-8 never uses marks the end of a word; all other words go to the tokenizer itself.
    Two generations of at most ``limit`` words bound the memory; words over LONG characters are
    made anew each time, lest they fill it.
    """

    def __init__(self, path: str, limit: int = 150_000):
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        byte = _byte_of()
        with open(path) as f:
            vocab = json.load(f)["model"]["vocab"]
        ranks = {}
        for token, i in vocab.items():
            end = token.endswith("</w>")
            letters = token[:-4] if end else token
            if all(c in byte for c in letters):
                ranks[bytes(byte[c] for c in letters) + _END * end] = i
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {b: i for b, i in ranks.items() if self.tokenizer.id_to_token(i) not in special}
        self._merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._split = regex.compile(SPLIT)
        self._renew({})

    def _renew(self, old: dict[str, bytes]) -> None:
        self._words = _Words(self._fresh, old)
        self._get = self._words.__getitem__

    def _fresh(self, word: str) -> bytes:
        if not word:
            return b""
        if not _PLAIN.fullmatch(word) or "<|" in word or "İ" in word:
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        word = word.lower()
        pieces = [word] if word.isalpha() else self._split.findall(word)
        return b"".join([array("I", self._merge(p.encode() + _END)).tobytes() for p in pieces])

    def ids(self, text: str, slice_chars: int = 1 << 22) -> bytes:
        out, at = [], 0
        while at < len(text):
            end = len(text) if at + slice_chars >= len(text) else text.find(" ", at + slice_chars)
            end = len(text) if end < 0 else end
            out.append(b"".join(map(self._get, text[at:end].replace("\n", " ").split(" "))))
            at = end
            if len(self._words) > self.limit:
                self._renew(dict(self._words))  # a plain copy, which does not keep its own elders
        return b"".join(out)


class Packer:
    """Online packing; ``rows`` gathers (doc, start, length, crc32, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, max_open: int = 4096, first: int = 0):
        self.capacity, self.max_open, self.next = capacity, max_open, first
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0
        self.rows: list[tuple] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        n, at = len(ids) // 4, 0
        while n - at >= self.capacity:
            self._close([(doc, at, self.capacity, ids[4 * at : 4 * (at + self.capacity)], n)])
            at += self.capacity
        if at < n:
            self._place((doc, at, n - at, ids[4 * at :], n))

    def level_for(self, size: int) -> int:
        """The level to put ``size`` ids on; 0 opens a window."""
        counts, top = self.counts, self.capacity - size
        cost = 2 * counts[size : top + size + 1] + 1
        cost[top] = 0  # a full window is no longer counted
        levels = np.flatnonzero(counts[1 : top + 1]) + 1
        if not len(levels):
            return 0
        grow = cost[levels] - 2 * counts[levels] + 1
        best = len(levels) - 1 - int(np.argmin(grow[::-1]))
        return int(levels[best]) if grow[best] <= cost[0] else 0

    def _place(self, piece: tuple) -> None:
        level, size = self.level_for(piece[2]), piece[2]
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.capacity:
            return self._close(window)
        self.counts[level + size] += 1
        self.open.setdefault(level + size, []).append(window)
        self.n_open += 1
        if self.n_open > self.max_open:
            self.settle(last=False)

    def _close(self, window: list[tuple]) -> None:
        offset = 0
        for doc, start, length, ids, n in window:
            self.rows.append((doc, start, length, zlib.crc32(ids), n, self.next, offset))
            offset += length
        self.next += 1

    def settle(self, last: bool = True) -> None:
        """Fill open windows, the fullest first, by cutting from the emptiest."""
        todo = [(level, w) for level in sorted(self.open) for w in self.open[level]]
        self.open, self.n_open = {}, 0
        self.counts[:] = 0
        if last:
            for level, w in todo:
                if level & (level - 1) == 0:
                    self._close(w)
            todo = [(level, w) for level, w in todo if level & (level - 1)]
        low, high = 0, len(todo) - 1
        while low < high:
            level, window = todo[high]
            gap = self.capacity - level
            while gap and low < high:
                size, donor = todo[low]
                doc, start, length, ids, n = donor.pop()
                cut = min(gap, length)
                window.append((doc, start + length - cut, cut, ids[4 * (length - cut) :], n))
                if cut < length:
                    donor.append((doc, start, length - cut, ids[: 4 * (length - cut)], n))
                gap, todo[low] = gap - cut, (size - cut, donor)
                low += not donor
            if gap:
                todo[high] = (self.capacity - gap, window)
                break
            self._close(window)
            high -= 1
        if low <= high and todo:
            level, window = todo[high]
            if last:
                self._powers(level, window)
            else:
                self.open, self.n_open = {level: [window]}, 1
                self.counts[level] = 1

    def _powers(self, level: int, window: list[tuple]) -> None:
        pieces = window[::-1]
        for size in (1 << b for b in range(self.capacity.bit_length() - 1, -1, -1) if level >> b & 1):
            part = []
            while size:
                doc, start, length, ids, n = pieces.pop()
                cut = min(size, length)
                part.append((doc, start, cut, ids[: 4 * cut], n))
                if cut < length:
                    pieces.append((doc, start + cut, length - cut, ids[4 * cut :], n))
                size -= cut
            self._close(part)


_tokens: dict[str, WordTokens] = {}


def tokens_for(vocab: str) -> WordTokens:
    """The words a process remembers; found by name, so that tasks of one process share them."""
    if vocab not in _tokens:
        _tokens[vocab] = WordTokens(vocab)
    return _tokens[vocab]


def pack(docs: DataFrame, vocab: str, capacity: int = CAPACITY, closing: int = CLOSING) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text); ``vocab``: the tokenizer's file, there on every machine."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = tokens_for(vocab), closing.to_bytes(4, "little")
        packer = Packer(capacity, first=TaskContext.get().partitionId() << 32)

        def rows() -> pa.RecordBatch:
            columns = zip(*packer.rows) if packer.rows else [[]] * len(names)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc, tokens.ids(text.as_py() or "") + end)
            yield rows()
        packer.settle()
        yield rows()

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(packed, SCHEMA)


def default_vocab() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), default_vocab())
