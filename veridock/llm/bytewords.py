"""Vectorised splitting and hashing of byte strings, for the operators that look at every word of every text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: An odd multiplier of polynomial hashes modulo 2**64 and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at a time, and the length of the tables of powers that are kept.
BLOCK = 1 << 16
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2**64."""
    if n > BLOCK + 1 or base not in _powers:
        steps = np.full(max(n, BLOCK + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n > BLOCK + 1:
            return have
        _powers[base] = have
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of each 64-bit value (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for each of sorted spans, from running sums over blocks of bytes.

    Two spans can share a hash, and such pairs are easy to make, so it serves only where that changes no result that has to be exact.
    """
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        low = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, low + BLOCK, side="right")))
        own = data[low : ends[b - 1]]
        running = np.zeros(len(own) + 1, dtype=np.uint64)
        np.cumsum((own.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(own)), out=running[1:])
        out[a:b] = mixed((running[ends[a:b] - low] - running[starts[a:b] - low]) * powers(INVERSE, len(own) + 1)[starts[a:b] - low])
        a = b
    return out


def groups_of(texts: Sequence, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about limit bytes (or characters) each; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


class Table:
    """Hash table from 64-bit keys to rows of small integers or floats, looked up and filled by whole arrays."""

    def __init__(self, dtype, bits: int = 16):
        self.dtype, self.bits, self.n = dtype, bits, 0
        self.keys, self.values, self.used = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, dtype), np.zeros(1 << bits, bool)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot of each key, whether it is there)."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        hit = self.keys[slot] == keys
        open_ = np.flatnonzero(~hit & self.used[slot])
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            s = slot[open_]
            hit[open_] = self.keys[s] == keys[open_]
            open_ = open_[~hit[open_] & self.used[s]]
        return slot, hit & self.used[slot]

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not there yet."""
        while 2 * (self.n + len(keys)) > 1 << self.bits:
            old = self.used.copy(), self.keys, self.values
            self.__init__(self.dtype, self.bits + 1)
            self.add(old[1][old[0]], old[2][old[0]])
        self.n += len(keys)
        left = np.arange(len(keys))
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = ~self.used[slot[left]]
            take = left[free]
            _, first = np.unique(slot[take], return_index=True)
            take = take[first]
            self.used[slot[take]], self.keys[slot[take]], self.values[slot[take]] = True, keys[take], values[take]
            done = np.zeros(len(keys), bool)
            done[take] = True
            left = left[~done[left]]
            slot[left] = np.where(self.used[slot[left]], (slot[left] + 1) & ((1 << self.bits) - 1), slot[left])


#: The lowest k bytes of a word of eight; bytes of a string that are compared eight at a time.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
BY_EIGHT = 64


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on, but for the last seven places."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))


class Known:
    """Numbers distinct byte strings as they are first met. Hashes find a string's place, and its bytes are compared with what is kept there, so strings
    that share a hash stay apart. Beyond `most` strings or `most_bytes` bytes it begins anew."""

    def __init__(self, most: int = 500_000, most_bytes: int = 12 << 20):
        self.most, self.most_bytes = most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.table, self.n, self.used = Table(np.int32), 0, 0
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.arena = np.zeros(1 << 20, np.uint8)

    def _keep(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of new strings."""
        size = ends - starts
        while self.n + len(size) > len(self.size):
            self.begin, self.size = np.r_[self.begin, np.zeros_like(self.begin)], np.r_[self.size, np.zeros_like(self.size)]
        while self.used + size.sum() + BY_EIGHT > len(self.arena):
            self.arena = np.r_[self.arena, np.zeros_like(self.arena)]
        places = np.arange(self.n, self.n + len(size))
        self.begin[places], self.size[places] = self.used + np.cumsum(size) - size, size
        self.arena[self.used : self.used + size.sum()] = data[_within(starts, size)]
        self.n, self.used = self.n + len(size), self.used + int(size.sum())
        return places

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """(place of each of sorted spans that aren't empty, indices of spans that got new places, in the order of those, whether it began anew)."""
        keys, size, anew = span_hashes(data, starts, ends), ends - starts, False
        slot, hit = self.table.find(keys)
        fresh = np.zeros(0, np.int64)
        if not hit.all():
            left = np.flatnonzero(~hit)
            _, first = np.unique(keys[left], return_index=True)
            fresh = left[first]
            if self.n + len(fresh) > self.most or self.used + size[fresh].sum() > self.most_bytes:
                self.clear()
                anew, fresh = True, np.unique(keys, return_index=True)[1]
            self.table.add(keys[fresh], self._keep(data, starts[fresh], ends[fresh]).astype(np.int32))
            slot, _ = self.table.find(keys)
        at = self.table.values[slot].astype(np.int64)
        other = self.size[at] != size
        same, met = np.flatnonzero(~other), 0
        own, kept = _eights(np.r_[data, np.zeros(BY_EIGHT, np.uint8)]), _eights(self.arena)
        while len(same) and met < BY_EIGHT:
            place, part = at[same], _LOWEST[np.minimum(size[same] - met, 8)]
            differs = (own[starts[same] + met] ^ kept[self.begin[place] + met]) & part != 0
            other[same[differs]] = True
            met += 8
            same = same[~differs & (size[same] > met)]
        if len(same):
            differs = data[_within(starts[same], size[same])] != self.arena[_within(self.begin[at[same]], size[same])]
            if differs.any():
                other[same] |= np.logical_or.reduceat(differs, np.cumsum(size[same]) - size[same])
        if other.any():  # strings that share another one's hash have places that no hash leads to
            odd = np.flatnonzero(other)
            at[odd] = self._keep(data, starts[odd], ends[odd])
            fresh = np.r_[fresh, odd]
        return at, fresh, anew


def _within(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """starts[i] .. starts[i] + size[i] - 1 for each i, in a row."""
    return np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
