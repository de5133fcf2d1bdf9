"""Harmonic packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Known, groups_of
from .common import text_or_empty

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CAPACITY, END_ID = 4096, 2
#: Sequence ids: the task's partition above, a count within the task below.
PER_TASK = 1 << 34
#: Texts tokenised at once, in characters.
AT_ONCE = 1 << 19
#: New words given to the library as one text, and what stands between them there.
AT_ONCE_WORDS, SEPARATOR = 1024, "\x02"

SPACE_BYTE, WORD_BYTE, MARK_BYTE, GLUE_BYTE = range(4)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: White space; ASCII letters and digits; ASCII marks but the apostrophe of contractions; all else.
_KIND = np.full(256, GLUE_BYTE, np.uint8)
_KIND[:128] = [SPACE_BYTE if c in (32, *range(9, 14)) else WORD_BYTE if chr(c).isalnum() else GLUE_BYTE if chr(c) == "'" or c < 32 or c == 127 else MARK_BYTE for c in range(128)]


class WordIds:
    """Token ids of whole texts, by a table of words.

    The tokenizer lower-cases, drops white space, splits there, and splits between ASCII letters or digits and ASCII marks (but for the apostrophe of
    contractions). A text's ids are therefore its parts' ids in a row. A part is given to the library when it is first met, and kept by its bytes.
    Texts that may hold special strings, which the library treats as it does by default, are split at white space only.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.known = Known()
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)  # part i has ids[first[i]:first[i + 1]]

    def _places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        at, fresh, anew = self.known.places(data, starts, ends)
        if anew:
            self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        if len(fresh):
            raw = data.tobytes()
            words = [raw[s:e].decode("utf-8") for s, e in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)]
            made = [self._made(words[i : i + AT_ONCE_WORDS]) for i in range(0, len(words), AT_ONCE_WORDS)]
            self.first = np.r_[self.first, self.first[-1] + np.cumsum(np.concatenate([n for n, _ in made]))]
            self.ids = np.concatenate([self.ids, *(ids for _, ids in made)])
        return at

    def _made(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, their ids in a row), by the library.

        It reads one text in which a separator follows each word, with white space around it. If it gives the separator's id as often as there are words,
        then no word has that id, and what lies between two of them is a word's ids. Otherwise it reads each word by itself.
        """
        if len(self.separator) == 1:
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(f"{w} {SEPARATOR} " for w in words)], add_special_tokens=False)[0].ids, np.uint32)
            after = ids == self.separator[0]
            if after.sum() == len(words):
                return np.diff(np.flatnonzero(after), prepend=-1) - 1, ids[~after]
        each = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([len(x) for x in each], np.int64), np.fromiter(chain.from_iterable(each), np.uint32)

    def _encode(self, texts: list[str], marks: bool) -> list[np.ndarray]:
        encoded = [t.encode("utf-8") for t in texts]
        data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
        data = _LOWER[data] if marks else data
        kind = _KIND[data]
        inside = kind != SPACE_BYTE
        border = np.ones(len(data), bool)
        border[1:] = inside[1:] != inside[:-1]
        if marks:
            border[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] != GLUE_BYTE) & (kind[:-1] != GLUE_BYTE)
        edges = np.flatnonzero(border)
        ends = np.r_[edges[1:], len(data)]
        real = inside[edges]
        starts, ends = edges[real], ends[real]
        at = self._places(data, starts, ends)
        n = self.first[at + 1] - self.first[at]
        before = np.r_[0, np.cumsum(n)]
        flat = self.ids[np.repeat(self.first[at] - before[:-1], n) + np.arange(before[-1])]
        upto = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in encoded]))
        bounds = np.r_[0, before[upto]].tolist()
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        special = [i for i, t in enumerate(texts) if "<|" in t]
        plain = [i for i, t in enumerate(texts) if "<|" not in t]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for at, marks in ((plain, True), (special, False)):
            for i, got in zip(at, self._encode([texts[i] for i in at], marks) if at else [], strict=True):
                out[i] = got
        return out


def cuts(tokens: int, capacity: int = CAPACITY, grain: int = 64) -> list[int]:
    """Lengths of the pieces of a document: whole sequences, then halves, quarters ... down to grain, then what is left.

    Those lengths are exact fractions of the capacity, so bins of their reciprocal classes fill up completely.
    """
    out = [capacity] * (tokens // capacity)
    left, part = tokens % capacity, capacity // 2
    while part >= grain:
        if left >= part:
            out.append(part)
            left -= part
        part //= 2
    return out + [left] * (left > 0)


class Packer:
    """Bins of one task. Class k holds the pieces of length in (capacity / (k + 1), capacity / k], and a bin of it k pieces."""

    def __init__(self, base: int, capacity: int = CAPACITY):
        self.base, self.capacity, self.made = base, capacity, 0
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def put(self, piece: tuple) -> None:
        """piece: (doc_id, ids, start, length, doc_tokens)."""
        k = self.capacity // piece[3]
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) == k:
            self._close(self.open.pop(k))

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, ids, start, length, n in pieces:
            self.rows.append((doc, start, length, crc32(ids), n, self.base + self.made, offset))
            offset += length
        self.made += 1

    def finish(self) -> None:
        """What is left in the open bins, fewer than capacity tokens each, is laid end to end and cut at the capacity; the last sequence is cut into
        powers of two, which need no padding."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total = sum(p[3] for p in rest)
        room = [self.capacity] * (total // self.capacity) + [1 << b for b in range(self.capacity.bit_length(), -1, -1) if (total % self.capacity) >> b & 1]
        bin_, left = [], room.pop(0) if room else 0
        for doc, ids, start, length, n in rest:
            while length:
                take = min(length, left)
                bin_.append((doc, ids[: 4 * take], start, take, n))
                ids, start, length, left = ids[4 * take :], start + take, length - take, left - take
                if not left:
                    self._close(bin_)
                    bin_, left = [], room.pop(0) if room else 0


_encoders: dict[str, WordIds] = {}


def _pack(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = WordIds(tokenizer)
        context = TaskContext.get()
        packer = Packer((context.partitionId() if context else 0) * PER_TASK, capacity)
        names = [x.split()[0] for x in PIECE.split(", ")]

        def drained() -> pd.DataFrame:
            rows, packer.rows = packer.rows, []
            return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

        for batch in batches:
            ids, texts = batch["doc_id"].astype("Int64").astype(object).tolist(), batch["text"].tolist()
            for a, b in groups_of(texts, AT_ONCE):
                for doc, got in zip(ids[a:b], _encoders[tokenizer].encode(texts[a:b]), strict=True):
                    raw, at, n = got.tobytes() + end_id.to_bytes(4, "little"), 0, len(got) + 1
                    doc = None if doc is pd.NA else doc
                    for length in cuts(n, capacity):
                        packer.put((doc, raw[4 * at : 4 * (at + length)], at, length, n))
                        at += length
                yield drained()
        packer.finish()
        yield drained()

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each task tokenises its documents and fills its own bins, so nothing is shuffled and no key can be hot. It holds the pieces of its open bins, under a
    capacity of ids in each of at most 70 classes. Bins of whole sequences, halves, quarters ... are filled to the capacity; a bin of class k holds k
    rests, so of rests just over capacity / (k + 1) some is padding (81 of 50 tokens fill 4050 of 4096). At most 12 sequences per task, the last ones, are
    powers of two long. Ties can't arise: pieces are laid in the order in which they are read.
    tokenizer: path of the tokenizers file, readable on every worker.

    A null text is empty: the document is its end id alone. Null ids and repeated rows are packed like any row. Empty table: no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(_pack(tokenizer, capacity, end_id), PIECE)
