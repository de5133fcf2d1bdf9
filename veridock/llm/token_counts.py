"""Exact byte-level BPE token counts by a compiled finite-state transducer."""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Known, groups_of
from .common import text_or_empty

END = "<|endoftext|>"
#: Character classes. Letters that take part in contractions ('s 't 'm 'd, 're 've 'll) have classes of their own.
LETTER, STMD, R, V, L, E, NUMBER, OTHER, APOSTROPHE, BLANK, SPACE, STOP = range(12)
#: States: what the transducer has read since the last certain token boundary.
S0, IN_LETTERS, IN_NUMBERS, IN_OTHER, BLANK1, SPACE1, BLANKS, SPACES, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, CLOSED = range(13)
#: A transition's output: a token begins at this character, at the one before it, or both.
HERE, BEFORE = 1, 2
CHUNK = 256


def _step(state: int, kind: int) -> tuple[int, int]:
    """One transition of the pre-tokenizer: (next state, output)."""
    letter = kind <= E
    if kind == STOP:  # at the end of a text, a run of white space is one token
        return S0, HERE
    opens = {NUMBER: IN_NUMBERS, OTHER: IN_OTHER, APOSTROPHE: IN_OTHER} | dict.fromkeys(range(NUMBER), IN_LETTERS)
    if kind in (BLANK, SPACE):
        if state in (BLANK1, SPACE1, BLANKS, SPACES):
            return (BLANKS if kind == BLANK else SPACES), 0
        return (BLANK1 if kind == BLANK else SPACE1), HERE
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if kind == {QUOTE_R: E, QUOTE_V: E, QUOTE_L: L}[state]:
            return CLOSED, 0
        if letter:  # the apostrophe stands alone, the letters after it are a word
            return IN_LETTERS, BEFORE
        return (QUOTE if kind == APOSTROPHE else opens[kind]), BEFORE | HERE
    if state == QUOTE:
        if kind == STMD:
            return CLOSED, 0
        if kind in (R, V, L):
            return {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[kind], 0
        if kind in (OTHER, APOSTROPHE):
            return IN_OTHER, 0
        return opens[kind], HERE
    if state == BLANK1:  # a single blank joins what follows
        return opens[kind], 0
    if state == BLANKS:
        return opens[kind], BEFORE
    if state == SPACES:
        return (QUOTE if kind == APOSTROPHE else opens[kind]), BEFORE | HERE
    if state == SPACE1:
        return (QUOTE if kind == APOSTROPHE else opens[kind]), HERE
    if (state, True) in ((IN_LETTERS, letter), (IN_NUMBERS, kind == NUMBER), (IN_OTHER, kind in (OTHER, APOSTROPHE))):
        return state, 0
    return (QUOTE if kind == APOSTROPHE else opens[kind]), HERE


@lru_cache(4)
def classes(path: str) -> np.ndarray:
    """Class of every code point as the library's own pre-tokenizer has it: joined to a mark, a letter or a digit, a character of that class makes one
    token with it. Blocks of one class are settled at once, others are halved; what joins none of the three is white space."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    kinds = np.full(0x110000, OTHER, np.uint8)
    blocks = [(a, a + 256) for a in (*range(0, 0xD800, 256), *range(0xE000, 0x110000, 256))]  # surrogates are in no text
    while blocks:
        a, b = blocks.pop()
        own = "".join(map(chr, range(a, b)))
        kind = next((k for x, k in (("!", OTHER), ("a", LETTER), ("1", NUMBER)) if len(split(x + own)) == 1), SPACE if b - a == 1 else None)
        if kind is None:
            blocks += [(a, (a + b) // 2), ((a + b) // 2, b)]
        else:
            kinds[a:b] = kind
    for letters, kind in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E), ("'", APOSTROPHE), (" ", BLANK)):
        kinds[[ord(x) for x in letters]] = kind
    return kinds


@lru_cache(1)
def compiled() -> tuple[np.ndarray, np.ndarray]:
    """(next state by class and state, output by class and state)."""
    steps = [[_step(s, k) for s in range(13)] for k in range(12)]
    return np.array([[x[0] for x in row] for row in steps], np.uint8), np.array([[x[1] for x in row] for row in steps], np.uint8)


def boundaries(kinds: np.ndarray) -> np.ndarray:
    """Where tokens begin in a sequence of classes, each text of which is followed by STOP.

    The sequence is cut into chunks of equal length. All chunks are read at once, each from every state, which gives each chunk's map
    from states to states; the maps compose in a prefix scan, whose values at the chunks' borders are their first states; a second reading from
    those states writes the outputs.
    """
    step, out = compiled()
    rows = -(-len(kinds) // CHUNK)
    padded = np.full(rows * CHUNK, STOP, np.uint8)
    padded[: len(kinds)] = kinds
    grid = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)
    maps = np.tile(np.arange(13, dtype=np.uint8), (rows, 1))
    flat = step.ravel()
    for column in grid:
        maps = flat[column[:, None] * np.intp(13) + maps]
    reach = 1
    while reach < rows:  # inclusive scan: maps[i] becomes the map of chunks 0..i
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].copy(), axis=1)
        reach *= 2
    state = np.empty(rows, np.uint8)
    state[0] = S0
    state[1:] = maps[:-1, S0]
    marks, flat_out = np.empty_like(grid), out.ravel()
    for j, column in enumerate(grid):
        at = column * np.intp(13) + state
        marks[j] = flat_out[at]
        state = flat[at]
    marks = marks.T.ravel()[: len(kinds)]
    begins = (marks & HERE).astype(bool)
    begins[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return begins


class Counter:
    """Token counts of whole texts. Pre-tokens are edges of the transducer, annotated with the number of tokens they emit; an edge is
    compiled (by the library, on that pre-token alone) when it is first met, and kept by its bytes."""

    def __init__(self, path: str, kinds: np.ndarray | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.kinds = Tokenizer.from_file(path), classes(path) if kinds is None else kinds
        self.known, self.emits = Known(), np.zeros(0, np.int64)

    def _emitted(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        at, fresh, anew = self.known.places(data, starts, ends)
        if anew:
            self.emits = np.zeros(0, np.int64)
        if len(fresh):
            raw, made = data.tobytes(), [self.emits]
            edges = [raw[s:e].decode("utf-8") for s, e in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)]
            for i in range(0, len(edges), 4096):
                made.append(np.array([len(x.ids) for x in self.tokenizer.encode_batch_fast(edges[i : i + 4096], add_special_tokens=False)], np.int64))
            self.emits = np.concatenate(made)
        return self.emits[at]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. The special string is one token, and texts are read apart on either side of it."""
        total = np.zeros(len(texts), np.int64)
        pieces, owner = [], []
        for i, t in enumerate(texts):
            if END in t:
                parts = t.split(END)
                total[i] += len(parts) - 1
                pieces += parts
                owner += [i] * len(parts)
            else:
                pieces.append(t)
                owner.append(i)
        owner = np.array(owner, np.int64)
        for a, b in groups_of(pieces, 1 << 19):
            raw = "\0".join(pieces[a:b]).encode("utf-8") + b"\0"
            data = np.frombuffer(raw, np.uint8)
            chars = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
            kinds = self.kinds[chars]
            ends_of = np.cumsum([len(p) + 1 for p in pieces[a:b]]) - 1
            kinds[ends_of] = STOP
            begins = boundaries(kinds)
            begins[ends_of] = True
            begins[np.r_[0, ends_of[:-1] + 1]] = True
            at_char = np.flatnonzero(begins)
            lead = np.flatnonzero((data & 0xC0) != 0x80)  # byte at which each character begins
            at = lead[at_char]
            stop = kinds[at_char] == STOP
            n = np.zeros(len(at), np.int64)
            starts, ends = at, np.r_[at[1:], len(data)]
            n[~stop] = self._emitted(data, starts[~stop], ends[~stop])
            text = np.searchsorted(ends_of, at_char)
            np.add.at(total, owner[a:b], np.bincount(text, n, b - a).astype(np.int64))
        return total


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), one row per row of docs.

    tokenizer: path of a byte-level BPE file for the tokenizers library, readable on every worker. Nothing is shuffled; the memory of a task is bounded by its
    table of edges and its longest text. A null text is empty and has no tokens. Repeated rows and null ids keep their rows.
    """

    packed = zlib.compress(classes(tokenizer).tobytes())  # read off the library once, on the driver

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        if tokenizer not in _counters:
            _counters[tokenizer] = Counter(tokenizer, np.frombuffer(zlib.decompress(packed), np.uint8))
        return pd.Series(_counters[tokenizer].counts(texts.tolist()))

    text = text_or_empty()
    own = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), run(text).alias("n_tokens"))
    return own.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
