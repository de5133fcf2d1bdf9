"""The pipeline's near-dedup: pairs of documents whose five-word shingles have Jaccard similarity 0.8 or more, by SimHash.

At similarity 0.8 some 15 % of the bits of two SimHashes differ, so 64 bits with few differences find next to nothing. Fingerprints have 2048 bits here. Their
byte-position inverted index has a posting list per choice of two byte positions and their values; inside a list, a pair is a candidate if few of its first
128 bits differ. The similarity of candidates is counted on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import groups_of, mixed
from .common import BROADCAST_ROWS, WORD, cut, join_checked, keep_one, release, text_or_empty
from .components import connected_components
from .suffix_dedup import PARTS, Outbox, by_part, joined, part_of

SEED = 42

#: 64-bit words of a fingerprint, and the pairs of its byte positions that have posting lists. A pair of texts is missed if no such pair of bytes is equal.
WORDS, CHOICES = 32, 160
#: Texts that share a list are candidates if at most so many of their first 128 bits differ: at similarity 0.8, 19 with a deviation of 4; of unrelated texts, 64 with 6.
MOST_BITS = 40
#: Lists of so many choices are compared with their first member to begin with; of the others, only what these links leave apart.
FIRST_CHOICES = 32
#: Longer lists are taken apart from member to member instead of by distance in the list; bytes of postings per part and per task.
LONG, PART_BYTES, TASK_BYTES = 256, 8 << 20, 32 << 20

_TIMES = mixed(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_LANES = np.uint64(0x0101010101010101)
_draw = np.random.default_rng(SEED)
_POSITIONS = np.concatenate([_draw.permutation(8 * WORDS).reshape(-1, 2) for _ in range(-(-CHOICES // (4 * WORDS)))])[:CHOICES]
POSTING = np.dtype([("key", "u4"), ("sid", "i8"), ("low", "u8"), ("high", "u8")])


def shingles(text: str, shingle: int) -> np.ndarray:
    """Sorted distinct XXH64 values of each run of `shingle` lower-case words; a text of fewer words is one shingle."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64, max(1, len(words) - shingle + 1)))


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """A SimHash of 64 * WORDS bits per set that isn't empty: a bit is set if over half of the members' hashes have it."""
    size = np.array([len(s) for s in sets])
    flat, blocks = np.concatenate(sets), -(-size // 255)
    upto = np.cumsum(blocks) - blocks
    starts = np.repeat(np.cumsum(size) - size, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(upto, blocks))
    ones, out, lane = np.empty((len(sets), 8, 8), np.int64), np.empty((len(sets), WORDS), np.uint64), np.empty_like(flat)
    for w, times in enumerate(_TIMES):
        h = mixed(flat * times)
        for k in range(8):  # bit k of each byte, summed up over at most 255 members in the byte
            np.bitwise_and(np.right_shift(h, np.uint64(k), out=lane), _LANES, out=lane)
            each = np.add.reduceat(lane, starts).view(np.uint8).reshape(-1, 8)
            ones[:, :, k] = np.add.reduceat(each, upto, axis=0, dtype=np.int64)
        out[:, w] = np.packbits(2 * ones > size[:, None, None], axis=2, bitorder="little").reshape(-1, 8).view(np.uint64)[:, 0]
    return out


def _sketches(shingle: int):
    @F.pandas_udf("sid long, print binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        from xxhash import xxh64_intdigest

        texts, sids, prints = texts.tolist(), [], []
        for a, b in groups_of(texts, 1 << 18):
            have = [shingles(t, shingle) for t in texts[a:b]]
            sids += [xxh64_intdigest(h.tobytes(), SEED) for h in have]
            prints += [p.tobytes() for p in fingerprints(have)]
        return pd.DataFrame({"sid": np.array(sids, np.uint64).view(np.int64), "print": prints})

    return run


def _posted(parts: int):
    """The postings of (sid, print), on their way to the parts of their keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = Outbox(PART_BYTES)
        for batch in batches:
            for i in range(0, len(batch), 512):
                sid = batch["sid"].to_numpy()[i : i + 512]
                data = np.frombuffer(b"".join(batch["print"].iloc[i : i + 512]), np.uint8).reshape(len(sid), -1)
                rec = np.zeros((len(sid), CHOICES), POSTING)
                rec["key"] = np.arange(CHOICES, dtype=np.uint32) << 16 | data[:, _POSITIONS[:, 0]].astype(np.uint32) << 8 | data[:, _POSITIONS[:, 1]]
                rec["sid"], rec["low"], rec["high"] = sid[:, None], data[:, :8].copy().view(np.uint64), data[:, 8:16].copy().view(np.uint64)
                rec = rec.ravel()
                yield from out.put(0, part_of(rec["key"].astype(np.uint64), parts), rec)
        yield from out.rest()

    return run


def _apart(low: np.ndarray, high: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether more of the first 128 bits differ than candidates may have."""
    return np.bitwise_count(low[x] ^ low[y]).astype(np.int16) + np.bitwise_count(high[x] ^ high[y]) > MOST_BITS


def candidates(rec: np.ndarray, long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """(postings sorted by key, for each the index of the first one of its group): those of a list that few bits tell apart, directly or over others."""
    rec = rec[np.argsort(rec["key"], kind="stable")]
    low, high = np.ascontiguousarray(rec["low"]), np.ascontiguousarray(rec["high"])
    heads = np.flatnonzero(np.r_[True, rec["key"][1:] != rec["key"][:-1]])
    size = np.diff(np.r_[heads, len(rec)])
    label, end = np.arange(len(rec)), np.repeat(heads + size, size)
    x, y, at, step = [], [], np.flatnonzero(np.repeat(size <= long, size)), 1
    while len(at := at[at + step < end[at]]):
        near = at[~_apart(low, high, at, at + step)]
        x.append(near)
        y.append(near + step)
        step += 1
    for a, b in zip(heads[size > long], (heads + size)[size > long], strict=True):
        unmet = np.arange(a, b)
        while len(unmet):  # a group at a time: its members' neighbours among those that no group has yet
            first, front, unmet = unmet[0], unmet[:1], unmet[1:]
            while len(front) and len(unmet):
                some, front = front[:64], front[64:]
                met = ~_apart(low, high, some[:, None], unmet).all(axis=0)
                label[unmet[met]] = first
                front, unmet = np.r_[front, unmet[met]], unmet[~met]
    x, y = np.concatenate([*x, heads[:0]]), np.concatenate([*y, heads[:0]])
    while len(x):
        least = np.minimum(label[x], label[y])
        x, y, least = (z[label[x] != label[y]] for z in (x, y, least)) if (label[x] != label[y]).any() else (x[:0], y[:0], least[:0])
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while (label[label] != label).any():
            label = label[label]
    return rec, label


LISTED = "key long, a long, sid long, early boolean"


def _listed(kind: int, blobs: list[bytes]) -> Iterator[pd.DataFrame]:
    """The groups of two or more candidates of each posting list, as lists of their own; a is their first member, early if the choice is among the first."""
    rec, label = candidates(joined(blobs, POSTING))
    _, group, n = np.unique(label, return_inverse=True, return_counts=True)
    in_one = n[group] > 1
    rec, label, group = rec[in_one], label[in_one], group[in_one]
    if len(rec):
        first = np.full(len(n), np.iinfo(np.int64).max)
        np.minimum.at(first, group, rec["sid"])
        a = first[group]
        key = mixed(mixed(rec["key"].astype(np.uint64) + np.uint64(1)) + a.view(np.uint64))
        yield pd.DataFrame({"key": key.view(np.int64), "a": a, "sid": rec["sid"], "early": rec["key"] >> 16 < FIRST_CHOICES})


def _sets(shingle: int):
    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, shingle).view(np.int64) for t in texts])

    return run


def text_key(name: str = "text"):
    return F.substring(F.unhex(F.sha2(text_or_empty(name), 256)), 1, 16)


def _agree(x, y, similarity: float):
    """Whether the sets in two arrays reach the similarity."""
    shared = F.size(F.array_intersect(x, y))
    return shared >= F.lit(similarity - 1e-12) * (F.size(x) + F.size(y) - shared)


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of set ids that reach the similarity, by the whole sets."""
    # the member's set first, so that a set with many members meets rows that are large enough for adaptive execution to split
    both = pairs.join(sets.select(F.col("sid").alias("b"), F.col("have").alias("y")), "b").join(sets.select(F.col("sid").alias("a"), F.col("have").alias("x")), "a")
    return cut(both.where(_agree("x", "y", similarity)).select("a", "b"))


#: Up to so many members, what is left of a list is compared by rows of pairs; of longer lists, blocks of so many members or bytes of sets.
SHORT, BLOCK_ROWS, BLOCK_BYTES = 16, 1024, 16 << 20
#: Comparisons in a block that take as long as that of a pair which is a row and brings both sets along.
PAIR_COST = 64


def _cross(similarity: float):
    """Links (a, b) between the probes and the members of one block pair; of the links between two components one is enough."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        probe, member = rows[rows["probe"]], rows[~rows["probe"]]
        if not len(probe) or not len(member):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        size = member["have"].map(len).to_numpy()
        flat, own = np.concatenate(member["have"].to_list()), np.repeat(np.arange(len(member)), size)
        order = np.argsort(flat, kind="stable")
        flat, own = flat[order], own[order]
        comp, sid = member["c"].to_numpy(), member["sid"].to_numpy()
        out = set()
        for s, c, have in zip(probe["sid"], probe["c"], probe["have"], strict=True):
            low, high = np.searchsorted(flat, have, "left"), np.searchsorted(flat, have, "right")
            n = high - low
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shared = np.bincount(own[at], minlength=len(member))
            near = np.flatnonzero((shared >= (similarity - 1e-12) * (size + len(have) - shared)) & (comp != c))
            _, one = np.unique(comp[near], return_index=True)
            out |= {(int(s), int(x)) for x in sid[near[one]]}
        return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    return run


def _left(links: DataFrame, shared: DataFrame, broadcast_rows: int, short: int) -> DataFrame:
    """shared(key, sid) with the component c of each set, of the lists in several components; n members, and home, the largest component.

    Components may be too small, as two rounds are enough to tell most members of a list apart from those that are linked.

    Lists may have most members in common. Those with members of one component (of a list's components, top, the one that is the largest anywhere) become
    one list, whose home it is, where that takes no more comparisons; a pair that becomes a row, as in a list of up to `short`, counts as PAIR_COST of them.
    The one list has that whole component, a row per member however many lists a member was in, and of its lists the members of other components.
    """
    member = connected_components(links, most_rounds=2)
    roots = member.select(F.col("component").alias("node")).distinct().join(member.select("node"), "node", "left_anti")
    member = cut(member.unionAll(roots.select("node", F.col("node").alias("component"))))
    named = join_checked(shared, member.withColumnRenamed("node", "sid"), "sid", "left", member.count(), broadcast_rows)
    named = cut(named.select("key", "sid", F.coalesce("component", "sid").alias("c")))
    weight = cut(member.groupBy(F.col("component").alias("c")).agg(F.count("*").alias("weight")))
    each = join_checked(named.groupBy("key", "c").agg(F.count("*").alias("m")), weight, "c", "left", weight.count(), broadcast_rows)
    best = lambda *by: F.max_by("c", F.struct(*by, "c"))
    torn = each.groupBy("key").agg(F.count("*").alias("parts"), F.sum("m").alias("n"), F.max("m").alias("most"), best("m").alias("home"), best(F.coalesce("weight", F.lit(1))).alias("top"), F.max("weight").alias("size"))
    cost = F.col("n") * (F.col("n") - F.col("most")) * F.when(F.col("n") <= short, PAIR_COST).otherwise(1)
    torn = cut(torn.where("parts > 1").select("key", "n", "home", "top", "size", cost.alias("cost")))
    lists = torn.count()
    far = join_checked(named, torn.select("key", "top"), "key", "inner", lists, broadcast_rows).where("c <> top")  # a condition of the join: other rows are not made
    far = cut(far.select("top", "sid", "c").distinct())
    union = torn.groupBy("top").agg(F.sum("cost").alias("cost"), F.count("*").alias("lists"), F.max("size").alias("size")).where("lists > 1")
    union = far.groupBy("top").agg(F.count("*").alias("far")).join(union, "top").withColumn("n", F.col("far") + F.coalesce("size", F.lit(1)))
    union = cut(union.where("n * far <= cost").select("top", "n", F.col("size").isNull().alias("alone")))
    unions = union.count()
    near = join_checked(member.select(F.col("component").alias("top"), F.col("node").alias("sid"), F.col("component").alias("c")), union, "top", "inner", unions, broadcast_rows)
    near = near.select("top", "sid", "c", "n").unionAll(union.where("alone").select("top", F.col("top").alias("sid"), F.col("top").alias("c"), "n"))
    as_one = join_checked(far, union.drop("alone"), "top", "inner", unions, broadcast_rows).select("top", "sid", "c", "n").unionAll(near)
    alone = cut(join_checked(torn, union, "top", "left_anti", unions, broadcast_rows).select("key", "n", "home"))
    own = join_checked(named, alone, "key", "inner", alone.count(), broadcast_rows)
    return cut(own.select("key", "sid", "c", "n", "home").unionAll(as_one.select(F.col("top").alias("key"), "sid", "c", "n", F.col("top").alias("home"))))


def near_sets(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, broadcast_rows: int = BROADCAST_ROWS, short: int = SHORT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, k (hash of the text), g (component), one row per row of docs that has words.

    Rows are in one component if pairs of the similarity or more link them, directly or over others. Candidates that share a posting list are in a list:

    1. in the lists of the first choices, all members are compared with the first;
    2. if members of a short list, of any choice, are in several components then, all pairs across components are compared;
    3. of a longer list, the members outside its largest component are compared with all members of other components, in blocks that are bounded
       in rows and bytes: the members are dealt out over blocks by hash, the others ("probes") go to each block, in blocks of their own.

    So only pairs that are linked anyway go uncompared, no pair of a long list becomes a row unless it is a link, and a list whose members are linked
    costs a row per member, however long it is.
    """
    spark = docs.sparkSession
    rows = docs.where(text_or_empty().rlike(WORD)).select("doc_id", text_key().alias("k"), _sketches(shingle)(text_or_empty()).alias("s"))
    rows = cut(rows.select("doc_id", "k", "s.sid", "s.print"))
    size = rows.count() * CHOICES * POSTING.itemsize
    parts, tasks = max(1024, size // PART_BYTES), max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    posted = rows.select("sid", "print").dropDuplicates(["sid"]).mapInPandas(_posted(parts), PARTS)
    shared = cut(by_part(posted, tasks, _listed, LISTED))
    del posted
    release(spark)
    pairs = cut(shared.where("early AND a <> sid").select("a", F.col("sid").alias("b")).distinct())
    ids = shared.select("sid").distinct()
    wanted = cut(rows.join(ids, "sid", "left_semi").groupBy("sid").agg(F.min("k").alias("k")))
    own = join_checked(docs.select(text_or_empty().alias("t"), text_key().alias("k")), wanted, "k", "inner", wanted.count(), 5 * broadcast_rows)
    sets = cut(own.select("sid", _sets(shingle)("t").alias("have")).dropDuplicates(["sid"]))
    release(spark)
    links = _similar(pairs, sets, similarity)
    left = _left(links, shared.select("key", "sid"), broadcast_rows, short)
    few, many = left.where(F.col("n") <= short), left.where(F.col("n") > short)
    if not few.isEmpty():
        rest = few.select("key", F.col("sid").alias("a"), "c").join(few.select("key", F.col("sid").alias("b"), F.col("c").alias("d")), "key").where("a < b AND c <> d")
        links = cut(links.unionAll(_similar(cut(rest.select("a", "b").distinct()), sets, similarity)))
    if not many.isEmpty():
        sized = sets.select("sid", (8 * F.size("have")).cast("long").alias("bytes"))
        left = cut(many.select("key", "sid", "c", (F.col("c") != F.col("home")).alias("far")).join(sized, "sid"))
        blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / F.lit(block_rows)), F.ceil(size / F.lit(BLOCK_BYTES))).cast("int")
        load = cut(left.groupBy("key").agg(blocks(F.count("*"), F.sum("bytes")).alias("over"), blocks(F.sum(F.col("far").cast("int")), F.sum(F.when(F.col("far"), F.col("bytes")).otherwise(0))).alias("by")))
        left = join_checked(left, load, "key", "inner", load.count(), broadcast_rows)
        # members in block i, copied for each block j of probes; a probe in block j, copied for each block i of members
        place = lambda n: F.pmod(F.xxhash64("sid"), n).cast("int")
        ways = F.array(F.lit(False), F.lit(True))
        dealt = left.select("key", "sid", "c", "over", "by", "far", F.explode(ways).alias("probe")).where("far OR NOT probe")
        dealt = dealt.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("probe"), F.col("over")).otherwise(F.col("by")) - 1)))
        i, j = F.when(F.col("probe"), F.col("copy")).otherwise(place(F.col("over"))), F.when(F.col("probe"), place(F.col("by"))).otherwise(F.col("copy"))
        dealt = cut(dealt.select("key", i.alias("i"), j.alias("j"), "probe", "sid", "c"))
        found = dealt.join(sets, "sid").groupBy("key", "i", "j").applyInPandas(_cross(similarity), "a long, b long")
        links = cut(links.unionAll(found.distinct()))
        release(spark)
    member = cut(connected_components(links))
    release(spark)
    out = join_checked(rows.select("doc_id", "k", "sid"), member.withColumnRenamed("node", "sid"), "sid", "left", member.count(), broadcast_rows)
    return out.select("doc_id", "k", F.coalesce("component", "sid").alias("g"))


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with one row of each component of near_sets: the one with the smallest id, where null counts as the largest. All columns stay.

    Rows without words (null, empty, or nothing but white space of the contracts) are left as they are: they have no shingles to be near by.
    """
    return keep_one(docs, text_key(), near_sets(docs, shingle, similarity, broadcast_rows), broadcast_rows)
