"""Removal of repeated passages by a sparse suffix array in range-partitioned buckets.

A hash only ever says where to look: which suffixes are candidates, where they are dealt to. What is removed is settled by the bytes themselves, in the
sorted suffixes of a bucket, or, for the windows of very common leads, by 128-bit BLAKE2b digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import BASE, groups_of, mixed, powers
from .common import cut, release, text_or_empty

#: Length of a repeat; bytes of a suffix that count as its leading tokens; what may lie to the left of an anchor inside a repeat.
SPAN, LEAD = 100, 32
LEFT = SPAN - LEAD
CONTEXT = LEFT + SPAN
NO_ID = np.iinfo(np.int64).max

#: Bytes of packed records that a task gathers before it passes them on.
FLUSH = 16 << 20
#: Leads met more often than this may be hot. Every task knows the MOST_HOT most frequent of them, or as many as there are parts if that is more, so
#: a lead that is not known has no more suffixes than an average part.
HOT_FLOOR, MOST_HOT = 4_000, 500_000
#: Leads sampled for the splitters, per bucket and in all. Beyond that, a range between two splitters is dealt out further by a hash of the lead.
SAMPLE_PER_BUCKET, MOST_SAMPLED = 32, 200_000
#: Bytes of text per part, and per task of a shuffle.
PART_BYTES, TASK_BYTES = 1 << 24, 1 << 25
#: A packed table of per-document positions is broadcast only up to so many bytes and rows; beyond, texts are shuffled.
BROADCAST_BYTES, BROADCAST_DOCS = 1 << 20, 20_000

ANCHOR = np.dtype([("key", "u8"), ("doc", "i8"), ("pos", "u4"), ("n", "u4")])
SUFFIX = np.dtype([("doc", "i8"), ("pos", "u4"), ("left", "u1"), ("right", "u1"), ("bytes", "u1", (CONTEXT,))])
WINDOW = np.dtype([("key", "u8"), ("more", "u8"), ("doc", "i8"), ("start", "u4")])
PLACE = np.dtype([("doc", "i8"), ("start", "u4"), ("end", "u4")])
PARTS = "kind int, part int, blob binary"


def kgram_hashes(data: np.ndarray, k: int = LEAD) -> np.ndarray:
    """Hash of data[i:i + k] for every i; k is a power of two. Equal strings have equal hashes, the reverse is not relied upon."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    h, base, width = data.astype(np.uint64) + np.uint64(1), BASE, 1
    while width < k:
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base & (1 << 64) - 1, 2 * width
    return mixed(h)


def anchors(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash of the lead, all bytes, first byte of each text) of the suffixes that are looked at.

    Of the 69 suffixes that begin inside a window of 100 bytes and have their lead in it, the one whose lead has the smallest hash (the leftmost of
    equals) is an anchor. That depends on the window's bytes alone, so equal windows have their anchors at equal places.
    """
    data = np.frombuffer(b"".join(encoded), np.uint8)
    sizes = np.array([len(e) for e in encoded], np.int64)
    first = np.cumsum(sizes) - sizes
    key = kgram_hashes(data, LEAD)
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none, none, key[:0], data, first
    least = (key >> np.uint64(32) << np.uint64(32)) | np.arange(len(key), dtype=np.uint64)
    width = 1
    while 2 * width <= LEFT + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = LEFT + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    inside = np.ones(len(least) + 1, np.int8)  # windows that end in their own text
    ends = first + sizes
    turn = np.zeros(len(least) + 1, np.int64)
    np.add.at(turn, np.clip(ends - SPAN + 1, first, len(least)), 1)
    np.add.at(turn, np.clip(ends, 0, len(least)), -1)
    inside = np.cumsum(turn)[:-1] == 0
    at = np.unique((least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64))
    text = np.searchsorted(ends, at, side="right")
    return text, at - first[text], key[at], data, first


def packed(kind: int, part: np.ndarray, records: np.ndarray) -> pd.DataFrame:
    """One row per part: its records as bytes."""
    order = np.argsort(part, kind="stable")
    part, records = part[order], records[order]
    cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)] if len(part) else np.zeros(1, int)
    return pd.DataFrame({"kind": np.full(len(cuts) - 1, kind, np.int32), "part": part[cuts[:-1]].astype(np.int32), "blob": [records[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})


class Outbox:
    """Records on their way to parts, by kind; passed on in blobs once there are so many bytes of a kind."""

    def __init__(self, flush: int = FLUSH):
        self.flush = flush
        self.waiting: dict[int, list] = {}
        self.bytes: dict[int, int] = {}

    def put(self, kind: int, part: np.ndarray, records: np.ndarray) -> Iterator[pd.DataFrame]:
        if len(records):
            self.waiting.setdefault(kind, []).append((part, records))
            self.bytes[kind] = self.bytes.get(kind, 0) + records.nbytes
            if self.bytes[kind] >= self.flush:
                yield self._send(kind)

    def _send(self, kind: int) -> pd.DataFrame:
        got = self.waiting.pop(kind)
        self.bytes[kind] = 0
        return packed(kind, np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))

    def rest(self) -> Iterator[pd.DataFrame]:
        for kind in list(self.waiting):
            yield self._send(kind)


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(key) % np.uint64(parts)).astype(np.int64)


def doc_part(doc: np.ndarray, parts: int) -> np.ndarray:
    return part_of(np.ascontiguousarray(doc).view(np.uint64), parts)


def by_part(rows: DataFrame, tasks: int, work: Callable[[int, list[bytes]], Iterator[pd.DataFrame]], schema: str, done: Callable[[], Iterator[pd.DataFrame]] | None = None) -> DataFrame:
    """Brings the blobs of each (kind, part) together in so many tasks and calls work on them, one part at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, blobs = None, []
        for batch in batches:
            for kind, part, blob in zip(batch["kind"], batch["part"], batch["blob"], strict=True):
                if (kind, part) != now:
                    if blobs:
                        yield from work(now[0], blobs)
                    now, blobs = (kind, part), []
                blobs.append(blob)
        if blobs:
            yield from work(now[0], blobs)
        if done:
            yield from done()

    return rows.repartition(tasks, "kind", "part").sortWithinPartitions("kind", "part").mapInPandas(run, schema)


def joined(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _encoded(batches: Iterator[pd.DataFrame], *more: str) -> Iterator[tuple]:
    """Groups of documents: ids, UTF-8 texts, further columns."""
    for batch in batches:
        texts = batch["text"].tolist()
        docs = batch["doc"].to_numpy(np.int64)
        for a, b in groups_of(texts, 1 << 20):
            yield docs[a:b], [t.encode("utf-8") for t in texts[a:b]], *(batch[c].iloc[a:b].tolist() for c in more)


CANDIDATES, REPRESENTATIVES = 0, 1


def _find(parts: int):
    """Map side of the first pass. Leads met twice in what a task has gathered are repeated, as it knows; one of each lead goes to the others."""

    def send(waiting: list[np.ndarray], out: Outbox) -> Iterator[pd.DataFrame]:
        rec = np.concatenate(waiting)
        rec = rec[np.argsort(rec["key"], kind="stable")]
        _, first, n = np.unique(rec["key"], return_index=True, return_counts=True)
        many = np.repeat(n > 1, n)
        places = np.zeros(many.sum(), PLACE)
        places["doc"], places["start"] = rec["doc"][many], rec["pos"][many]
        yield from out.put(CANDIDATES, doc_part(places["doc"], parts), places)
        one = rec[first]
        one["n"] = n
        yield from out.put(REPRESENTATIVES, part_of(one["key"], parts), one)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, out = [], Outbox()
        for docs, encoded in _encoded(batches):
            text, pos, key, _, _ = anchors(encoded)
            rec = np.zeros(len(pos), ANCHOR)
            rec["key"], rec["doc"], rec["pos"] = key, docs[text], pos
            waiting.append(rec)
            if sum(w.nbytes for w in waiting) >= FLUSH:
                yield from send(waiting, out)
                waiting = []
        if waiting:
            yield from send(waiting, out)
        yield from out.rest()

    return run


FOUND = "kind int, part int, blob binary, lead long, total long"


def _repeated(parts: int, hot_floor: int):
    """Reduce side of the first pass: anchors whose lead others have too, and leads that may be hot."""
    out = Outbox()

    def full(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(lead=0, total=0)

    def work(kind: int, blobs: list[bytes]) -> Iterator[pd.DataFrame]:
        if kind == CANDIDATES:
            places = joined(blobs, PLACE)
            yield from full(out.put(CANDIDATES, doc_part(places["doc"], parts), places))
            return
        rec = joined(blobs, ANCHOR)
        names, number, n = np.unique(rec["key"], return_inverse=True, return_counts=True)
        total = np.bincount(number, rec["n"], len(names)).astype(np.int64)
        new = (n[number] > 1) & (rec["n"] == 1)  # those with n > 1 are known
        places = np.zeros(new.sum(), PLACE)
        places["doc"], places["start"] = rec["doc"][new], rec["pos"][new]
        yield from full(out.put(CANDIDATES, doc_part(places["doc"], parts), places))
        hot = np.flatnonzero(total > hot_floor)
        if len(hot):
            yield pd.DataFrame({"kind": 2, "part": 0, "blob": None, "lead": names[hot].view(np.int64), "total": total[hot]})

    return work, lambda: full(out.rest())


def _per_document(kind_: int, blobs: list[bytes]) -> Iterator[pd.DataFrame]:
    """(doc, places): merged intervals of each document, as pairs of 32-bit numbers."""
    rec = joined(blobs, PLACE)
    rec = rec[np.lexsort((rec["start"], rec["doc"]))]
    doc, start, end = rec["doc"], rec["start"].astype(np.int64), rec["end"].astype(np.int64)
    fresh = np.r_[True, doc[1:] != doc[:-1]]
    owner = np.cumsum(fresh) - 1
    reach = np.maximum.accumulate(end + owner * (1 << 33)) - owner * (1 << 33)  # furthest end so far in the document
    head = fresh.copy()
    head[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(head)
    last = np.r_[at[1:], len(rec)] - 1
    pairs = np.c_[start[at], reach[last]].astype(np.uint32)
    cuts = np.r_[np.flatnonzero(fresh[at]), len(at)]
    yield pd.DataFrame({"doc": doc[at[cuts[:-1]]], "places": [pairs[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})


def _points(kind_: int, blobs: list[bytes]) -> Iterator[pd.DataFrame]:
    """(doc, places): the distinct starts of each document."""
    rec = np.unique(joined(blobs, PLACE)[["doc", "start"]])
    cuts = np.r_[0, np.flatnonzero(rec["doc"][1:] != rec["doc"][:-1]) + 1, len(rec)]
    starts = np.ascontiguousarray(rec["start"])
    yield pd.DataFrame({"doc": rec["doc"][cuts[:-1]], "places": [starts[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})


def shared_prefixes(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bytes that each string of that order shares with the one before it) of rows of bytes of one width.

    Multikey quicksort with eight bytes as a character, on all groups at once: the strings are sorted by their first character, and only those that are
    still tied go on to the next.
    """
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    chars = padded.view(">u8").astype(np.uint64)
    order = np.argsort(chars[:, 0], kind="stable")
    head = np.r_[True, chars[order[1:], 0] != chars[order[:-1], 0]] if n else np.zeros(0, bool)
    for j in range(1, chars.shape[1]):
        tied = ~head
        tied[:-1] |= ~head[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group, own = np.cumsum(head)[at], order[at]
        order[at] = own = own[np.lexsort((chars[own, j], group))]
        head[at[1:]] |= (group[1:] != group[:-1]) | (chars[own[1:], j] != chars[own[:-1], j])
    shared = np.zeros(n, np.int64)
    differs = strings[order[1:]] != strings[order[:-1]]
    shared[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    return order, shared


def window_digests(ctx: np.ndarray, row: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of the BLAKE2b digest of the 100 bytes that begin `shift` bytes to the left of the anchor of each row."""
    raw, begin = np.ascontiguousarray(ctx).tobytes(), row * CONTEXT + LEFT - shift
    return np.frombuffer(b"".join([hashlib.blake2b(raw[a : a + SPAN], digest_size=16).digest() for a in begin.tolist()]), np.uint64).reshape(-1, 2)


def lead_hashes(ctx: np.ndarray) -> np.ndarray:
    own = (ctx[:, LEFT : LEFT + LEAD].astype(np.uint64) + np.uint64(1)) * powers(BASE, LEAD)
    return mixed(own.sum(axis=1, dtype=np.uint64))


def lead_words(ctx: np.ndarray) -> np.ndarray:
    """The leading bytes as strings that sort like them (no byte of UTF-8 is 255, so trailing zeros can be told apart)."""
    return np.ascontiguousarray(ctx[:, LEFT : LEFT + LEAD] + np.uint8(1)).view(f"S{LEAD}").ravel()


SUFFIXES, WINDOWS, COVERED = 3, 4, 5


def contexts(docs: np.ndarray, encoded: list[bytes], places: list[bytes]) -> np.ndarray:
    """The suffix records at the given places of each text."""
    sizes = np.array([len(e) for e in encoded], np.int64)
    first = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(encoded), np.uint8)
    pos = [np.frombuffer(p, np.uint32).astype(np.int64) for p in places]
    owner = np.repeat(np.arange(len(docs)), [len(p) for p in pos])
    pos = np.concatenate(pos) if len(pos) else np.zeros(0, np.int64)
    fits = pos + LEAD <= sizes[owner]  # rows that share an id may differ in length
    pos, owner = pos[fits], owner[fits]
    rec = np.zeros(len(pos), SUFFIX)
    rec["doc"], rec["pos"] = docs[owner], pos
    rec["left"], rec["right"] = np.minimum(pos, LEFT), np.minimum(sizes[owner] - pos, SPAN)
    shift = np.arange(-LEFT, SPAN)
    there = (shift >= -rec["left"][:, None].astype(np.int64)) & (shift < rec["right"][:, None])
    at = np.clip((first[owner] + pos)[:, None] + shift, 0, max(0, len(data) - 1))
    rec["bytes"] = np.where(there, data[at], 0) if len(rec) else 0
    return rec


def _suffixes(parts: int, splitters, hot):
    """Map side of the second pass. Equal contexts in a task are settled there; one of each goes to the bucket of its lead, or, if the lead is
    hot, as one record per window to the part of the window's hash."""

    def covered(rec: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rec), PLACE)
        out["doc"], out["start"], out["end"] = rec["doc"], rec["pos"] - rec["left"], rec["pos"].astype(np.int64) + rec["right"]
        return out[out["end"].astype(np.int64) - out["start"] >= SPAN]

    def send(waiting: list[np.ndarray], out: Outbox) -> Iterator[pd.DataFrame]:
        rec = np.concatenate(waiting)
        rec = rec[np.lexsort((rec["pos"], rec["doc"]))]
        whole = np.zeros(len(rec), np.uint64)
        for a in range(0, len(rec), 1 << 15):
            own = (rec["bytes"][a : a + (1 << 15)].astype(np.uint64) + np.uint64(1)) * powers(BASE, CONTEXT)
            whole[a : a + (1 << 15)] = mixed(own.sum(axis=1, dtype=np.uint64))
        _, one, number = np.unique(whole, return_index=True, return_inverse=True)  # the first, as the sort is by document and position
        first = one[number]
        equal = np.ones(len(rec), bool)  # to the first of that hash, byte for byte
        for a in range(0, len(rec), 1 << 15):
            x, y = rec[a : a + (1 << 15)], rec[first[a : a + (1 << 15)]]
            equal[a : a + (1 << 15)] = (x["bytes"] == y["bytes"]).all(axis=1) & (x["left"] == y["left"]) & (x["right"] == y["right"])
        # at the same place of rows that share an id, neither is earlier
        done = covered(rec[equal & ((rec["doc"] != rec["doc"][first]) | (rec["pos"] != rec["pos"][first]))])
        yield from out.put(COVERED, doc_part(done["doc"], parts), done)
        rec = rec[~equal | (first == np.arange(len(rec)))]
        lead = lead_hashes(rec["bytes"])
        warm = np.isin(lead, hot.value)
        cool = rec[~warm]
        within = np.searchsorted(splitters.value, lead_words(cool["bytes"]), side="right")
        deals = max(1, parts // (len(splitters.value) + 1))
        yield from out.put(SUFFIXES, within * deals + part_of(lead[~warm], deals), cool)
        for a in range(0, int(warm.sum()), 1 << 13):
            part = rec[warm][a : a + (1 << 13)]
            shift = np.arange(LEFT + 1)
            row, o = np.nonzero((shift <= part["left"][:, None]) & (SPAN - shift <= part["right"][:, None]))
            win = np.zeros(len(row), WINDOW)
            win["key"], win["more"] = window_digests(part["bytes"], row, o).T
            win["doc"], win["start"] = part["doc"][row], part["pos"][row] - o
            again, once = _later(win)
            done = np.zeros(len(again), PLACE)
            done["doc"], done["start"], done["end"] = again["doc"], again["start"], again["start"].astype(np.int64) + SPAN
            yield from out.put(COVERED, doc_part(done["doc"], parts), done)
            yield from out.put(WINDOWS, part_of(once["key"], parts), once)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, out = [], Outbox()
        for docs, encoded, places in _encoded(batches, "places"):
            waiting.append(contexts(docs, encoded, places))
            if sum(w.nbytes for w in waiting) >= 2 * FLUSH:
                yield from send(waiting, out)
                waiting = []
        if waiting:
            yield from send(waiting, out)
        yield from out.rest()

    return run


def _later(win: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows with an earlier equal, first ones); equal are windows of equal digests."""
    win = win[np.lexsort((win["start"], win["doc"], win["more"], win["key"]))]
    head = np.ones(len(win), bool)
    head[1:] = (win["key"][1:] != win["key"][:-1]) | (win["more"][1:] != win["more"][:-1])
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    return win[(win["doc"] != win["doc"][first]) | (win["start"] != win["start"][first])], win[head]


def repeats(rec: np.ndarray) -> np.ndarray:
    """Covered places of the suffixes of a bucket: for each, from the leftmost to the rightmost window that an earlier suffix of the bucket has too.

    The suffixes are sorted from the anchor to the right and, by what precedes them, from the anchor to the left, with the bytes that neighbours share. A window that
    begins o bytes to the left of the anchor is the same in two records if they share o bytes to the left and 100 - o to the right, that is if no smaller
    number stands between them in either order. A window's anchor is inside it, so the windows of one anchor overlap.
    """
    rec = rec[np.lexsort((rec["pos"], rec["doc"]))]
    number, least = [], []
    for side in (rec["bytes"][:, LEFT:], rec["bytes"][:, LEFT - 1 :: -1]):
        order, shared = shared_prefixes(side)
        number.append((order, shared))
        most = np.zeros(len(rec), np.int64)
        most[order] = np.maximum(shared, np.r_[shared[1:], 0])
        least.append(most)
    might = least[0] + least[1] >= SPAN  # with its best neighbour on either side
    low, high = np.full(len(rec), LEFT + 1), np.full(len(rec), -1)
    group = [np.zeros(len(rec), np.int64), np.zeros(len(rec), np.int64)]
    for o in range(LEFT + 1):
        ok = np.flatnonzero(might & (rec["left"] >= o) & (rec["right"] >= SPAN - o))
        if len(ok) < 2:
            continue
        for g, (order, shared), length in zip(group, number, (SPAN - o, o), strict=True):
            g[order] = np.cumsum(shared < length)
        _, one, at = np.unique(group[0][ok] * np.int64(len(rec) + 1) + group[1][ok], return_index=True, return_inverse=True)
        first = ok[one[at]]
        hit = ok[(rec["doc"][ok] != rec["doc"][first]) | (rec["pos"][ok] != rec["pos"][first])]
        low[hit], high[hit] = np.minimum(low[hit], o), o
    hit = np.flatnonzero(high >= 0)
    out = np.zeros(len(hit), PLACE)
    out["doc"], out["start"], out["end"] = rec["doc"][hit], rec["pos"][hit] - high[hit], rec["pos"][hit] + SPAN - low[hit]
    return out


def _buckets(parts: int):
    out = Outbox()

    def work(kind: int, blobs: list[bytes]) -> Iterator[pd.DataFrame]:
        if kind == COVERED:
            done = joined(blobs, PLACE)
        elif kind == SUFFIXES:
            rec = joined(blobs, SUFFIX)
            names, number, n = np.unique(lead_hashes(rec["bytes"]), return_inverse=True, return_counts=True)
            rec = rec[n[number] > 1]
            order = np.argsort(number[n[number] > 1], kind="stable")
            rec, ends = rec[order], np.cumsum(n[n > 1])
            done, a = [np.zeros(0, PLACE)], 0
            while a < len(rec):  # whole leads, about 2**15 records at once
                b = int(ends[min(np.searchsorted(ends, a + (1 << 15)), len(ends) - 1)])
                done.append(repeats(rec[a:b]))
                a = b
            done = np.concatenate(done)
        else:
            again, _ = _later(joined(blobs, WINDOW))
            done = np.zeros(len(again), PLACE)
            done["doc"], done["start"], done["end"] = again["doc"], again["start"], again["start"].astype(np.int64) + SPAN
        yield from out.put(COVERED, doc_part(done["doc"], parts), done)

    return work, out.rest


def _attach(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    size = places.agg(F.count("*").alias("n"), F.sum(F.octet_length("places") + 48).alias("b")).first()
    small = size["n"] <= BROADCAST_DOCS and (size["b"] or 0) <= BROADCAST_BYTES
    return docs.join(F.broadcast(places) if small else places, "doc", how)


def _sampled_leads(share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for docs, encoded, places in _encoded(batches, "places"):
            rec = contexts(docs, encoded, places)
            pick = mixed(np.ascontiguousarray(rec["doc"]).view(np.uint64) * np.uint64(1 << 20) + rec["pos"]) >> np.uint64(11) < np.uint64(share * (1 << 53))
            yield pd.DataFrame({"lead": [x.tobytes() for x in rec["bytes"][pick][:, LEFT : LEFT + LEAD]]})

    return run


def covered_places(docs: DataFrame, hot_floor: int = HOT_FLOOR) -> DataFrame:
    """(doc, places): merged byte intervals of each document of docs(doc, text) that a repeat covers.

    Pass 1 finds the anchors whose leads are met twice. Pass 2 sends their suffixes, with what lies left of them, to buckets: ranges of the
    leading bytes between sampled splitters. Equal leads fall on one side of a splitter, so suffixes on either side of a boundary share less than a lead
    and no window: there is nothing to compare across. Leads that are met very often are taken apart into windows, which meet by their digests.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1024, size // PART_BYTES)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    work, done = _repeated(parts, hot_floor)
    found = cut(by_part(docs.mapInPandas(_find(parts), PARTS), tasks, work, FOUND, done))
    release(spark)
    hot = found.where("kind = 2").orderBy(F.desc("total"), "lead").limit(max(MOST_HOT, parts)).select("lead").toPandas()["lead"].to_numpy(np.int64).view(np.uint64)
    places = cut(by_part(found.where("kind <> 2").select("kind", "part", "blob"), tasks, _points, "doc long, places binary"))
    del found
    release(spark)
    marked = _attach(docs, places, "inner")
    n = (places.agg(F.sum(F.octet_length("places"))).first()[0] or 0) // 4
    # the sample only balances the buckets: of many places, those of a sixteenth of the documents are looked at
    thin = 16 if n > 16 * MOST_SAMPLED else 1
    share = min(1.0, thin * min(SAMPLE_PER_BUCKET * parts, MOST_SAMPLED) / max(1, n))
    few = marked.where(F.pmod(F.xxhash64("doc"), F.lit(thin)) == 0)
    leads = few.mapInPandas(_sampled_leads(share), "lead binary").limit(2 * MOST_SAMPLED).toPandas()["lead"]
    sample = np.sort((np.frombuffer(b"".join(leads), np.uint8) + np.uint8(1)).view(f"S{LEAD}"))
    splitters = sample[:: max(1, len(sample) // parts)] if len(sample) else sample
    del few
    release(spark)  # the texts that the sample shuffled, all of them if there are few places
    work, done = _buckets(parts)
    sent = marked.mapInPandas(_suffixes(parts, spark.sparkContext.broadcast(splitters), spark.sparkContext.broadcast(np.sort(hot))), PARTS)
    settled = by_part(sent, tasks, work, PARTS, done)
    return cut(by_part(settled, tasks, _per_document, "doc long, places binary"))


def removal(data: bytes, places: bytes | None) -> tuple[int, int, str]:
    """(bytes removed, runs, SHA-256 of what stays)."""
    pairs = np.frombuffer(places or b"", np.uint32).reshape(-1, 2).tolist()
    kept, at, gone, spans = hashlib.sha256(), 0, 0, 0
    for a, b in pairs:
        b = min(b, len(data))
        if a < b:
            kept.update(data[at:a])
            at, gone, spans = b, gone + b - a, spans + 1
    kept.update(data[at:])
    return gone, spans, kept.hexdigest()


def suffix_dedup(docs: DataFrame, hot_floor: int = HOT_FLOOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of docs.

    A byte goes if it lies in 100 bytes that also begin earlier, in a document with a smaller id or at a smaller place of the same one. Whole texts are read, as UTF-8;
    strings never cross documents. Windows are told apart by their bytes, those of very common leads by 128 bits of BLAKE2b.

    A null text is empty. A null id counts as the largest. Rows that share an id are one document as far as order goes: at the same place none
    is earlier, so exact repeats of a row leave each other alone. Empty table: empty result.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("doc"), F.col("doc_id"), text_or_empty().alias("text"))
    places = covered_places(own.select("doc", "text"), hot_floor)
    release(docs.sparkSession)

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string")
    def run(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([removal(t.encode("utf-8"), p) for t, p in zip(texts, places, strict=True)], columns=["n_removed", "n_spans", "kept_sha256"])

    out = _attach(own, places, "left").withColumn("r", run("text", "places"))
    return out.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "r.n_removed", "r.n_spans", "r.kept_sha256")
