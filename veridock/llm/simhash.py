"""SimHash near-duplicates: byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_checked, text_or_empty
from .components import connected_components

SEED, MAX_BITS, BYTES = 42, 3, 8


def fingerprint(text: str, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash: bit set if it is set in over half of the shingles' XXH64 values; no words: 0."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64, count=n).astype(">u8").view(np.uint8).reshape(n, 8)
    ones = reduce(np.add, (np.unpackbits(hashes[i : i + 32768], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, n, 32768)))
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(shingle: int):
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return run


def _local_components(x: np.ndarray, bits: int) -> np.ndarray:
    """For each of distinct values, the index of the first member of its component under Hamming distance <= bits.

    Blocks of rows are compared with all values and only labels are kept, so memory is linear and no pairs are made.
    """
    label = np.arange(len(x))
    step = max(1, (1 << 21) // len(x))
    while True:
        new = label.copy()
        for i in range(0, len(x), step):
            near = np.bitwise_count(x[i : i + step, None] ^ x[None, :]) <= bits
            new[i : i + step] = np.where(near, label[None, :], len(x)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _probed_components(x: np.ndarray, bits: int) -> np.ndarray:
    """The same by looking up every value at Hamming distance <= bits of each, linear in their number.

    Used for very long posting lists. The values share all but three bytes (up to collisions of the key), so only bits in
    which any of them differ are flipped.
    """
    spread = np.bitwise_or.reduce(x ^ x[0])
    places = [np.uint64(1 << b) for b in range(64) if int(spread) >> b & 1]
    flips = [reduce(np.bitwise_or, c) for k in range(1, bits + 1) for c in combinations(places, k)]
    order = np.argsort(x)
    sorted_x, label = x[order], np.arange(len(x))
    while True:
        new = label.copy()
        for f in flips:
            at = np.minimum(np.searchsorted(sorted_x, x ^ f), len(x) - 1)
            hit = sorted_x[at] == (x ^ f)
            new[hit] = np.minimum(new[hit], label[order[at[hit]]])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


#: Longest posting list whose members are compared with each other; the members of longer ones look their neighbours up.
PAIRWISE_UP_TO = 8_000


def _stars(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.unique(values)
    label = (_local_components if len(x) <= PAIRWISE_UP_TO else _probed_components)(x, bits)
    far = label != np.arange(len(x))
    return x[far], x[label[far]]


def _near(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Count filter, then distance: pairs whose tally of equal positional bytes reaches the guaranteed minimum are verified bit by bit."""
    tally = (x.view(np.uint8).reshape(-1, BYTES) == y.view(np.uint8).reshape(-1, BYTES)).sum(axis=1)
    out = tally >= BYTES - bits
    out[out] = np.bitwise_count(x[out] ^ y[out]) <= bits
    return out


def _postings(bits: int):
    """Reads (key, fp) sorted by key; emits, for each posting list, links from members to the first of their component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail_key, tail = None, []

        def long_list(parts):
            v = np.concatenate(parts)
            return _stars(v, bits) if len(v) > 1 else (v[:0], v[:0])

        for batch in batches:
            key, fp = batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
            if not len(key):
                continue
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
            out = []
            if key[0] == tail_key:
                tail.append(fp[: ends[0]])
                starts, ends = starts[1:], ends[1:]
            if len(starts):
                if tail:
                    out.append(long_list(tail))
                tail_key, tail = key[starts[-1]], [fp[starts[-1] :]]
                starts, ends = starts[:-1], ends[:-1]
            n = ends - starts
            two = starts[n == 2]
            near = _near(fp[two], fp[two + 1], bits)
            out.append((fp[two[near]], fp[two[near] + 1]))
            out += [_stars(fp[s:e], bits) for s, e in zip(starts[n > 2], ends[n > 2], strict=True)]
            a, b = (np.concatenate([o[i] for o in out]).view(np.int64) for i in (0, 1))
            yield pd.DataFrame({"a": a, "b": b})
        if tail:
            a, b = long_list(tail)
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def fingerprint_links(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(a, b) links between distinct fingerprints fp (long) that connect exactly those within `bits` bits, directly or over others.

    Two fingerprints that differ in at most b bits share at least 8 - b of their 8 positional bytes. A posting list
    per choice of 8 - b byte positions and their values thus holds a pair exactly if the pair's tally of shared
    positional bytes reaches that minimum; the tally needs no row per pair. Inside a list the distance is verified.
    Lists of single bytes (N / 256 long) would make N * N / 64 tallies and aren't kept: 2.8e7 for the 42,400 texts of a 0.1 GB input, 1e9 for 0.5 GB,
    4e12 for 30 GB. As fingerprints are distinct, a list of five fixed bytes has at most 2 ** 24 of them, 128 MB, whatever the input.
    """
    masks = [sum(255 << (8 * p) for p in c) for c in combinations(range(BYTES), BYTES - bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    index = prints.select("fp", F.explode(keys).alias("key"))
    return index.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInPandas(_postings(bits), "a long, b long").distinct()


def near_groups(docs: DataFrame, shingle: int = 3, bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), one row per row of docs.

    Works on distinct fingerprints, so exact copies cost nothing beyond a map-side combined minimum. A null or
    empty text has fingerprint zero and links like any other. A null doc_id counts as the largest (component_id is
    null only if the component has no other). Repeated rows each keep their row. Empty table: empty result.
    """
    rows = cut(docs.select("doc_id", _fingerprints(shingle)(text_or_empty()).alias("fp")))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = cut(fingerprint_links(prints.select("fp"), bits))
    member = cut(connected_components(links))
    n = member.count()
    named = join_checked(prints, member.withColumnRenamed("node", "fp"), "fp", "inner", n)
    reach = named.groupBy("component").agg(F.min("least").alias("first"))
    linked = cut(named.select("fp", "component").join(reach, "component").select("fp", "first"))
    label = cut(join_checked(prints, linked, "fp", "left", n).select("fp", F.coalesce("first", "least").alias("component_id")))
    out = join_checked(rows, label, "fp", "inner", label.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
