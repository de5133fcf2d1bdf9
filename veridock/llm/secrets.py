"""Secret scans: base patterns, and a linear-chain conditional random field that tags every token of a text."""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import groups_of, mixed
from .common import cut, text_or_empty

#: Fixed values of the contract, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")
SCAN = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
#: A text may hold a base span only if this matches (in the engine, to draw the sample).
MAY_HAVE = r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"

Span = tuple[int, int, int]  # start, place of its kind in KINDS, end


def base_spans(text: str) -> list[Span]:
    """All matches of the base patterns; offsets are code points, ends exclusive."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def secret_parts(text: str) -> list[tuple[int, int]]:
    """Where the base patterns find the secret itself, without keyword and sign; merged where they overlap."""
    own = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    own += [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 16] + [m.span() for m in LONG_HEX.finditer(text)]
    out: list[tuple[int, int]] = []
    for s, e in sorted(own):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def described(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


O, B, I = range(3)
#: Bytes between tokens: white space, quotes, brackets and the marks that assign or list.
_BREAK = np.isin(np.arange(256), [ord(c) for c in " \t\n\v\f\r\"'`=:,;()<>[]{}|\\"] + [0])
_BYTES = np.arange(256)
_DIGIT, _UPPER, _LOWER = ((_BYTES >= ord(a)) & (_BYTES <= ord(z)) for a, z in ("09", "AZ", "az"))
_HEX = _DIGIT | (_BYTES >= ord("a")) & (_BYTES <= ord("f"))
_KIND = np.where(_DIGIT, 1, np.where(_UPPER, 2, np.where(_LOWER, 3, np.where(_BYTES >= 128, 4, 5)))).astype(np.uint8)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Classes of the byte before a token.
_BEFORE = np.select([np.isin(_BYTES, [10, 13]), _BYTES == 32, np.isin(_BYTES, [34, 39, 96]), _BYTES == ord("="), _BYTES == ord(":")], [0, 1, 2, 3, 4], 5).astype(np.uint8)
#: Sizes of the features' tables, in order: 16 of shape, word before, word after, 3 of the file.
NEIGHBOURS = 512
SIZES = (16, 9, 9, 9, 9, 9, 6, 6, 4, 4, 4, 4, 2, 6, 6, 16, NEIGHBOURS, NEIGHBOURS, 4, 2, 2)
OFFSETS = np.cumsum((0, *SIZES))
FEATURES = int(OFFSETS[-1])
#: Bytes of text whose tokens are looked at together.
PIECE = 1 << 20


#: Features whose weights are added up beforehand, one table for all their combinations, so that a token takes few lookups.
FUSED = ((0, 4), (1, 2, 3), (5, 6, 7), (8, 9, 10, 11), (12, 13, 14, 15), (16,), (17,), (18, 19, 20))


class Tokens(NamedTuple):
    start: np.ndarray  # first byte
    end: np.ndarray
    columns: list[np.ndarray]  # a value of each feature per token

    @property
    def feats(self) -> np.ndarray:
        """tokens x len(SIZES): rows of the weights."""
        return (np.stack(self.columns, axis=1) + OFFSETS[:-1]).astype(np.int32) if len(self.start) else np.zeros((0, len(SIZES)), np.int32)


def _word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """1 ... NEIGHBOURS - 1 from length and up to 16 leading bytes of each lower-cased token; 0 is no word."""
    at = start[:, None] + np.arange(16)
    own = np.where(at < end[:, None], _FOLD[data[np.minimum(at, len(data) - 1)]], 0).astype(np.uint8)
    halves = np.ascontiguousarray(own).view("<u8")
    return (1 + mixed(mixed(halves[:, 0]) ^ halves[:, 1] ^ (end - start).astype(np.uint64)) % np.uint64(NEIGHBOURS - 1)).astype(np.int64)


def _tenths(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """0 for none, then eighths of the whole, rounded up."""
    return -(-8 * part // np.maximum(whole, 1))


def tokens_of(data: np.ndarray, file: tuple[int, int, int], last: int = 0, following: int = 0) -> Tokens:
    """Tokens of bytes of one text with their features; last and following: hashes of the words around the bytes (0: none)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_BREAK[data]
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    if not len(start):
        return Tokens(start, end, [start] * len(SIZES))
    kind = _KIND[data]
    change = np.zeros(len(data), np.int32)
    change[1:] = kind[1:] != kind[:-1]
    run = lambda mask: np.r_[0, np.cumsum(mask, dtype=np.int32)]
    n = (end - start).astype(np.int32)
    count = {}
    for name, mask in (("digit", kind == 1), ("upper", kind == 2), ("lower", kind == 3), ("wide", kind == 4), ("mark", kind == 5), ("hex", _HEX[data])):
        sums = run(mask)
        count[name] = sums[end] - sums[start]
    changes = np.cumsum(change, dtype=np.int32)
    switches = changes[end - 1] - changes[start]
    # marks are rare, so they are counted where they are rather than summed up over all bytes
    spots = np.flatnonzero(kind == 5)
    owner = np.searchsorted(start, spots, side="right") - 1
    spots, owner = spots[owner >= 0], owner[owner >= 0]
    spots, owner = spots[spots < end[owner]], owner[spots < end[owner]]
    marks = {c: np.bincount(owner[data[spots] == ord(c)], minlength=len(start)) for c in ".-/@_"}
    words = _word_hash(data, start, end)
    before = np.r_[last, words[:-1]]
    after = np.r_[words[1:], following]
    first = np.minimum(kind[start], 5)
    columns = [
        np.minimum(n // 3, 15), _tenths(count["digit"], n), _tenths(count["upper"], n), _tenths(count["lower"], n), _tenths(count["wide"], n), _tenths(switches, n),
        np.minimum(count["digit"], 5), np.minimum(count["upper"], 5), np.minimum(marks["."], 3), np.minimum(marks["-"], 3), np.minimum(marks["/"], 3), np.minimum(count["mark"], 3),
        (count["hex"] == n).astype(int), first, _BEFORE[data[np.maximum(start - 1, 0)]] * (start > 0),
        8 * (marks["@"] > 0) + 4 * (marks["_"] > 0) + 2 * ((count["digit"] > 0) & (count["upper"] + count["lower"] > 0)) + (switches >= 6),
        before, after, *(np.full(len(n), x) for x in file),
    ]
    return Tokens(start, end, columns)


def file_features(data: bytes) -> tuple[int, int, int]:
    return min(3, len(data) // 2000), int(b"://" in data), int(b"{" in data)


def text_tokens(data: bytes) -> Iterator[tuple[int, Tokens]]:
    """(first byte, tokens) of pieces of a text, cut between tokens; the words on either side of a cut know each other."""
    of_file, whole = file_features(data), np.frombuffer(data, np.uint8)
    at, last = 0, 0
    while at < len(whole):
        end = min(len(whole), at + PIECE)
        while end < len(whole) and not _BREAK[whole[end - 1]]:
            end += 1
        # the word after the cut, for the last one's features
        more, follow = end, 0
        while more < len(whole) and _BREAK[whole[more]]:
            more += 1
        if more < len(whole):
            stop = more
            while stop < len(whole) and not _BREAK[whole[stop]]:
                stop += 1
            follow = int(_word_hash(whole, np.array([more]), np.array([stop]))[0])
        own = tokens_of(whole[at:end], of_file, last, follow)
        if len(own.start):
            last = int(_word_hash(whole[at:end], own.start[-1:], own.end[-1:])[0])
        yield at, own
        at = end


#: Tokens that are read at once, from each label; O is never followed by I.
CHUNK = 32
BARRED = -1e6


class Crf:
    """Labels O, B, I; weights of features for B and I (O has none, as only differences count) and of transitions. A text stands between two O."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((FEATURES, 2)) if emit is None else emit
        self.move = np.zeros((3, 3)) if move is None else move
        self._tables: list[np.ndarray] | None = None

    def potentials(self, feats: np.ndarray) -> np.ndarray:
        """tokens x labels."""
        out = np.zeros((len(feats), 3))
        for column in feats.T:
            out[:, 1:] += self.emit[column]
        return out

    def fused(self, own: Tokens) -> np.ndarray:
        """potentials() by one lookup for each group of FUSED, in single precision."""
        if self._tables is None:
            self._tables = []
            for group in FUSED:
                table = np.zeros((1, 2))
                for f in group:
                    table = (table[:, None] + self.emit[None, OFFSETS[f] : OFFSETS[f + 1]]).reshape(-1, 2)
                self._tables.append(table.astype(np.float32))
        out = np.zeros((len(own.start), 3), np.float32)
        for group, table in zip(FUSED, self._tables, strict=True):
            at = own.columns[group[0]]
            for f in group[1:]:
                at = at * SIZES[f] + own.columns[f]
            out[:, 1:] += table[at]
        return out

    @property
    def steps(self) -> np.ndarray:
        move = self.move.copy()
        move[O, I] = BARRED
        return move

    def forward(self, own: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best label before each token, for each of its own labels; best sums at the end). before: best sums of each label before the first.

        Chunks are read side by side, each from every label, which gives its matrix of best sums; the matrices compose in a prefix scan (their product takes
        maxima of sums), and a second reading from each chunk's true start leaves the pointers.
        """
        move, n = self.steps.astype(own.dtype), len(own)
        rows = -(-n // CHUNK)
        padded = np.zeros((rows * CHUNK, 3), own.dtype)
        padded[:n] = own
        grid = padded.reshape(rows, CHUNK, 3)
        full = rows - (n % CHUNK > 0)  # the last chunk's matrix isn't needed
        maps = np.full((full, 3, 3), BARRED, own.dtype)
        maps[:, range(3), range(3)] = 0.0
        for t in range(CHUNK):
            via = [maps[:, :, k, None] + move[k] for k in range(3)]
            maps = np.maximum(np.maximum(via[0], via[1]), via[2]) + grid[:full, t, None, :]
        reach = 1
        while reach < full:
            via = [maps[: full - reach, :, k, None] + maps[reach:, k, None, :] for k in range(3)]
            maps[reach:] = np.maximum(np.maximum(via[0], via[1]), via[2])
            reach *= 2
        sums = np.empty((rows, 3), own.dtype)
        sums[0] = before
        sums[1:] = (np.asarray(before, own.dtype)[None, :, None] + maps[: rows - 1]).max(axis=1)
        back, at_end = np.empty((rows, CHUNK, 3), np.uint8), sums
        for t in range(CHUNK):
            via = [sums[:, k, None] + move[k] for k in range(3)]
            most = np.maximum(via[0], via[1])
            back[:, t] = np.where(via[2] > most, 2, via[1] > via[0])
            sums = np.maximum(most, via[2]) + grid[:, t]
            if t == (n - 1) % CHUNK:
                at_end = sums
        return back.reshape(-1, 3)[:n], at_end[-1]

    @staticmethod
    def backward(back: np.ndarray, last: int) -> np.ndarray:
        """Labels of the tokens whose pointers are given, if the last has the label `last`; chunks go side by side as in forward()."""
        n = len(back)
        rows = -(-n // CHUNK)
        grid = np.empty((rows * CHUNK, 3), np.uint8)
        grid[: rows * CHUNK - n] = np.arange(3)  # what stands before the first token passes labels on
        grid[rows * CHUNK - n :] = back
        grid = grid.reshape(rows, CHUNK, 3)
        maps = np.tile(np.arange(3, dtype=np.uint8), (rows, 1))  # label at a chunk's end -> label before the chunk
        for t in range(CHUNK - 1, -1, -1):
            maps = np.take_along_axis(grid[:, t], maps, axis=1)
        reach = 1
        while reach < rows:  # from the right: maps[i] becomes that of chunks i to the last
            maps[:-reach] = np.take_along_axis(maps[:-reach], maps[reach:].copy(), axis=1)
            reach *= 2
        label = np.empty(rows, np.intp)
        label[-1] = last
        label[:-1] = maps[1:, last]
        out = np.empty((rows, CHUNK), np.uint8)
        for t in range(CHUNK - 1, -1, -1):
            out[:, t] = label
            label = grid[np.arange(rows), t, label].astype(np.intp)
        return out.reshape(-1)[rows * CHUNK - n :]

    def tags(self, pieces: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of one text, the potentials of whose tokens come in pieces; sums are carried from piece to piece."""
        sums, backs = np.array([0.0, BARRED, BARRED]), []
        for own in pieces:
            back, sums = self.forward(own, sums) if len(own) else (np.zeros((0, 3), np.uint8), sums)
            sums = np.maximum(sums - sums.max(), BARRED)
            backs.append(back)
        last, out = int((sums + self.steps[:, O]).argmax()), []
        for back in reversed(backs):
            out.append(self.backward(back, last) if len(back) else np.zeros(0, np.uint8))
            if len(back):
                last = int(back[0][out[-1][0]])
        return out[::-1]

    def train(self, data: list[tuple[np.ndarray, np.ndarray]], rounds: int = 40, rate: float = 0.15, decay: float = 3e-4) -> Crf:
        """Fits to (features, labels) of whole sequences: gradient of the log-likelihood by forward and backward sums over all sequences side by side, with
        Adam's steps (Kingma and Ba, 2015), in a fixed order."""
        if not data:
            return self
        longest, many = max(len(f) for f, _ in data), len(data)
        feats = np.zeros((many, longest, len(SIZES)), np.int32)
        labels, there = np.zeros((many, longest), np.int64), np.zeros((many, longest), bool)
        for k, (f, y) in enumerate(data):
            feats[k, : len(f)], labels[k, : len(f)], there[k, : len(f)] = f, y, True
        flat = feats[there]
        seen = np.zeros((3, 3))
        path = np.c_[np.zeros(many, np.int64), labels, np.zeros(many, np.int64)]
        np.add.at(seen, (path[:, :-1][:, : longest][there], path[:, 1:][:, : longest][there]), 1)
        size = there.sum(axis=1)
        final = path[np.arange(many), size]
        np.add.at(seen, (final, np.zeros(many, np.int64)), 1)
        first = [np.zeros_like(self.emit), np.zeros_like(self.move)]
        second = [np.zeros_like(self.emit), np.zeros_like(self.move)]
        add = lambda x: np.logaddexp.reduce(x, axis=1)
        for step in range(1, rounds + 1):
            move = self.steps
            own = np.zeros((many, longest, 3))
            own[there] = self.potentials(flat)
            alpha, beta = np.zeros((many, longest, 3)), np.zeros((many, longest, 3))
            now = own[:, 0] + move[O]
            alpha[:, 0] = now
            for t in range(1, longest):
                now = np.where(there[:, t, None], add(now[:, :, None] + move) + own[:, t], now)
                alpha[:, t] = now
            whole = add(now + move[:, O])
            after = np.tile(move[:, O], (many, 1))
            for t in range(longest - 1, -1, -1):
                beta[:, t] = after
                if t:
                    after = np.where(there[:, t, None], np.logaddexp.reduce(move + (own[:, t] + after)[:, None, :], axis=2), after)
            at = np.exp(alpha + beta - whole[:, None, None])
            expected = np.zeros((3, 3))
            expected[O] += at[:, 0].sum(axis=0)
            for t in range(1, longest):
                pair = np.exp(alpha[:, t - 1, :, None] + move + (own[:, t] + beta[:, t])[:, None, :] - whole[:, None, None])
                expected += (pair * there[:, t, None, None]).sum(axis=0)
            expected[:, O] += np.exp(now + move[:, O] - whole[:, None]).sum(axis=0)
            miss = -at[there]
            miss[np.arange(len(miss)), labels[there]] += 1
            grads = [np.zeros_like(self.emit), (seen - expected) / many - decay * self.move]
            for column in flat.T:
                for k in (0, 1):
                    grads[0][:, k] += np.bincount(column, miss[:, 1 + k], FEATURES)
            grads[0] = grads[0] / many - decay * self.emit
            for w, g, m, v in zip((self.emit, self.move), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self


def labels_of(own: Tokens, parts: list[tuple[int, int]]) -> np.ndarray:
    """A token that overlaps a secret (places in bytes) is its beginning, or inside if the token before overlaps the same one."""
    out, last = np.zeros(len(own.start), np.int64), None
    for i, (s, e) in enumerate(zip(own.start.tolist(), own.end.tolist(), strict=True)):
        over = next((p for p in parts if p[0] < e and s < p[1]), None)
        out[i] = O if over is None else I if over == last else B
        last = over
    return out


_BASE64 = string.ascii_letters + string.digits
#: Alphabets that a secret is drawn from anew.
ALPHABETS = (_BASE64, _BASE64 + "-_", _BASE64 + "+/", "0123456789abcdef", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, _BASE64 + "!@#$%^&*?")


def drawn_secret(rng: random.Random) -> str:
    """16 to 64 characters of one alphabet, at times in parts as tokens of services have them; a letter and a digit at least."""
    letters = rng.choice(ALPHABETS)
    while True:
        own = "".join(rng.choice(letters) for _ in range(rng.choice((16, 20, 20, 24, 32, 40, 48, 64))))
        if any(c.isdigit() for c in own) and any(c.isalpha() for c in own):
            break
    shape = rng.random()
    if shape < 0.1:
        own = rng.choice(("sk", "pk", "gh", "xo", "key")) + rng.choice("_-") + own
    elif shape < 0.2:
        own = f"{own}.{''.join(rng.choice(_BASE64 + '-_') for _ in range(rng.randint(20, 60)))}"
    return own


def ordinary_token(rng: random.Random) -> str:
    """Something with digits or marks that is no secret: times, dates, numbers, addresses, names of files, versions, identifiers."""
    n = lambda a, b: rng.randint(a, b)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(n(3, 9)))
    day, clock = f"{n(1990, 2040)}-{n(1, 12):02}-{n(1, 28):02}", f"{n(0, 23):02}:{n(0, 59):02}:{n(0, 59):02}"
    return rng.choice((
        lambda: f"{day}T{clock}Z", lambda: f"{day}T{clock}.{n(0, 999):03}+0{n(0, 9)}:00", lambda: day, lambda: clock, lambda: f"{day} {clock}", lambda: day.replace("-", ""),
        lambda: str(n(10**3, 10**16)), lambda: f"{n(0, 999)}.{n(0, 99999)}", lambda: f"+{n(1, 99)} ({n(100, 999)}) {n(100, 999)}-{n(1000, 9999)}", lambda: f"{n(1, 255)}.{n(0, 255)}.{n(0, 255)}.{n(0, 255)}",
        lambda: f"{word()}.{word()}{n(1, 99)}@{word()}.{rng.choice(('com', 'org', 'example'))}", lambda: f"https://www.{word()}.{rng.choice(('com', 'org'))}/{word()}/{word()}-{n(1, 9999)}.html", lambda: f"/{word()}/{word()}/{word()}_{n(1, 99)}.txt",
        lambda: f"v{n(0, 20)}.{n(0, 20)}.{n(0, 99)}", lambda: f"{word()}_{word()}_{n(1, 999)}", lambda: "".join(word().title() for _ in range(3)), lambda: f"{word()}-{word()}-{word()}-{word()}", lambda: f"{word().upper()}-{n(1, 99999)}",
        lambda: f"{word()}{word()}{word()}{word()}", lambda: f"{n(0, 2**32):08x}"[:7], lambda: f"{n(1, 999)},{n(100, 999)},{n(100, 999)}", lambda: f"{word().upper()}_{word().upper()}_{word().upper()}", lambda: f"{n(1, 99)}%", lambda: f"{word()}{n(10, 9999)}",
    ))()


def lessons(text: str, rng: random.Random) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(snippet, secrets in it) to learn from, of one document: stretches around its own secrets, the same with the keyword left out (so that shape and
    neighbours carry the label) and with the secret drawn anew, and stretches from evenly drawn places as they are, with an ordinary token, and with a secret."""
    own = secret_parts(text)
    around = 90
    for s, e in rng.sample(own, min(2, len(own))):
        left, right = text[max(0, s - around) : s], text[e : e + around]
        bare = re.sub(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?$""", "", left)
        if any(p[0] < e + around and s - around < p[1] for p in own if p != (s, e)):
            continue
        for before, secret in ((left, text[s:e]), (bare, text[s:e]), (left, drawn_secret(rng)), (bare, drawn_secret(rng))):
            yield before + secret + right, [(len(before), len(before) + len(secret))]
    for kind in range(3):
        at = rng.randrange(max(1, len(text) - around))
        at = text.find(" ", at, at + around) + 1 or at
        left, right = text[max(0, at - around) : at], text[at : at + around]
        if any(p[0] < at + around and at - around < p[1] for p in own):
            continue
        if kind == 0:
            yield left + right, []
        elif kind == 1:
            yield f"{left} {ordinary_token(rng)} {right}", []
        else:
            secret, opening = drawn_secret(rng), rng.choice((" ", ' "', " = ", ": ", "="))
            yield f"{left}{opening}{secret} {right}", [(len(left) + len(opening), len(left) + len(opening) + len(secret))]


def _lessons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            for k, (snippet, parts) in enumerate(lessons(text, random.Random(int(doc)))):
                data = snippet.encode("utf-8", "replace")
                own = tokens_of(np.frombuffer(data, np.uint8), file_features(text.encode("utf-8", "replace")))
                in_bytes = [(len(snippet[:s].encode("utf-8", "replace")), len(snippet[:e].encode("utf-8", "replace"))) for s, e in parts]
                rows.append((int(doc), k, own.feats.astype("<i4").tobytes(), labels_of(own, in_bytes).astype("<i8").tobytes()))
        yield pd.DataFrame(rows, columns=["doc_id", "k", "feats", "labels"])


#: Bound of what the field is trained on: documents with a base span, and others (smallest hashes of their ids); at most 11 snippets of some 200 characters each.
TRAIN_DOCS = 400


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Crf:
    """Fits the field to silver labels: the base spans of a bounded sample of whole documents, see lessons()."""
    draw, text = F.xxhash64("doc_id"), text_or_empty()
    own = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    marked = own.select("doc_id", F.col("text").rlike(MAY_HAVE).alias("has"), (F.length("text") > 0).alias("any")).where("any")
    marked = cut(marked.groupBy("doc_id").agg(F.max("has").alias("has")))
    few = lambda has: marked.where(F.col("has") == has).orderBy(draw, "doc_id").limit(train_docs).select("doc_id")
    picked = cut(few(True).unionAll(few(False)))
    one = own.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    found = one.mapInPandas(_lessons, "doc_id long, k int, feats binary, labels binary").orderBy("doc_id", "k").collect()
    data = [(np.frombuffer(r["feats"], "<i4").reshape(-1, len(SIZES)), np.frombuffer(r["labels"], "<i8")) for r in found]
    return Crf().train([x for x in data if len(x[0])])


def field_spans(model: Crf, data: bytes) -> list[tuple[int, int]]:
    """Places in bytes of what the field takes for secrets in one text."""
    cuts, potentials = [], []
    for at, own in text_tokens(data):
        cuts.append((at + own.start.astype(np.int64), at + own.end.astype(np.int64)))
        potentials.append(model.fused(own))
    return joined_spans(cuts, model.tags(potentials))


def joined_spans(cuts: list[tuple[np.ndarray, np.ndarray]], tags: list[np.ndarray]) -> list[tuple[int, int]]:
    """From the beginning of each token tagged B to the end of the last of the I after it."""
    if not any(t.any() for t in tags):
        return []
    start, end, tag = (np.concatenate(x) for x in ([c[0] for c in cuts], [c[1] for c in cuts], tags))
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(tag).tolist():
        if tag[i] == I and out:
            out[-1] = (out[-1][0], int(end[i]))
        else:
            out.append((int(start[i]), int(end[i])))
    return out


def many_spans(model: Crf, encoded: list[bytes]) -> list[list[tuple[int, int]]]:
    """field_spans() of many short texts, read as one: between two texts stands a token that can only be O."""
    own = [tokens_of(np.frombuffer(d, np.uint8), file_features(d)) for d in encoded]
    sizes = np.array([len(t.start) for t in own])
    potentials = np.concatenate([model.fused(t) for t in own])
    at = np.repeat(np.arange(len(own)), sizes) + np.arange(sizes.sum())
    spaced = np.tile(np.array([0.0, BARRED, BARRED], np.float32), (sizes.sum() + len(own), 1))
    spaced[at] = potentials
    tags = np.split(model.tags([spaced])[0][at], np.cumsum(sizes)[:-1])
    return [joined_spans([(t.start, t.end)], [x]) for t, x in zip(own, tags, strict=True)]


def in_points(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places in bytes as places in code points. A full stop that ends a span isn't part of it."""
    if not spans:
        return []
    points = np.r_[0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)]
    spans = [(s, s + len(data[s:e].rstrip(b"."))) for s, e in spans]
    return [(int(points[s]), int(points[e])) for s, e in spans if s < e]


def scan_texts(texts: list[str], model: Crf) -> list[tuple[list[Span], list[Span]]]:
    """Per text (base spans, all spans). What the field tags is listed as its own kind, also where a base pattern has found it too."""
    out: list[tuple[list[Span], list[Span]]] = []
    for a, b in groups_of(texts, PIECE // 2):
        encoded = [t.encode("utf-8", "replace") for t in texts[a:b]]
        more = many_spans(model, encoded) if b - a > 1 else [field_spans(model, encoded[0])]
        for t, data, own in zip(texts[a:b], encoded, more, strict=True):
            base = base_spans(t)
            out.append((base, sorted(base + [(s, 3, e) for s, e in in_points(data, own)])))
    return out


def secret_scan(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per row of docs, over whole texts.

    Nothing is shuffled beyond the bounded training sample. A null or empty text has no spans (base_sha256 is that of the
    empty string). Null ids and repeated rows keep their rows. Empty table: empty result. A text is read in pieces of 1 MB, with the
    best sums carried from one to the next, so a long text takes a few bytes of memory per token.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = scan_texts(batch["text"].tolist(), shared.value)
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64")})
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name] = [sum(x[1] == k for x in base) for base, _ in found]
            out["base_sha256"] = [hashlib.sha256(described(base).encode()).hexdigest() for base, _ in found]
            out["spans"] = [described(spans) for _, spans in found]
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(run, SCAN)
