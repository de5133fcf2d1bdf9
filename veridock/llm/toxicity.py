"""Toxicity by class-conditional Kneser-Ney language models with a shared backoff."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Table, groups_of, mixed, span_hashes
from .common import cut, text_or_empty, whole_row

#: Absolute discounts, by count n: max(SMALL, SPREAD * sqrt(n)), so that counts which differ by chance alone are left to the shared backoff.
SMALL_BIGRAM, SMALL_WORD, SPREAD = 0.75, 3.0, 2.0
#: Mass that both classes leave to the shared backoff; weight of the uniform distribution in it; strength (in words) of backing off from a context.
#: The mass bounds what chance says: a word counted just over NOTHING in one class and not in the other must stay far below STRONG (at 0.02 it is over it).
SHARED, UNIFORM, STRENGTH = 0.2, 0.01, 1e5
#: Words that speak for a class by more than STRONG (nats) are also summed up by themselves.
STRONG = 2.0
#: Bounds of the labelled samples (rows): per class for the counts, in all for the calibration.
FIT_ROWS, CALIBRATION_ROWS = 5_000, 5_000
#: Context of a text's first word.
START = np.uint64(0x5851F42D4C957F2D)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
BIGRAM = "ctx long, word long, key long, n long"


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, number of words of each text). Words are runs of ASCII letters, digits and other non-ASCII characters."""
    encoded = [t.encode("utf-8", "replace") for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)]
    inside = _IN_WORD[data].astype(np.int8)
    turn = np.diff(inside, prepend=np.int8(0))
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    per_text = np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in encoded])), prepend=0)
    return span_hashes(data, starts, ends), per_text


def bigrams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, key of both, number of words of each text)."""
    words, n = words_of(texts)
    ctx = np.r_[START, words[:-1]] if len(words) else words
    first = (np.cumsum(n) - n)[n > 0]
    ctx[first] = START
    return ctx, words, mixed(ctx * np.uint64(0x2545F4914F6CDD1D) + words), n


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch["text"].tolist()
        for a, b in groups_of(texts):
            ctx, word, key, _ = bigrams_of(texts[a:b])
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            yield pd.DataFrame({"ctx": ctx[first].view(np.int64), "word": word[first].view(np.int64), "key": key[first].view(np.int64), "n": n})


#: Distinct words that a task counts before it passes them on.
WORDS_AT_ONCE = 1 << 18


def _corpus(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, n) of the words of a task, summed up over what it has gathered."""
    words, n, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def summed() -> None:
        nonlocal words, n, waiting
        words, at = np.unique(np.concatenate([words, *(w for w, _ in waiting)]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n, *(c for _, c in waiting)]), len(words)).astype(np.int64)
        waiting = []

    for batch in batches:
        texts = batch["text"].tolist()
        for a, b in groups_of(texts):
            waiting.append(np.unique(words_of(texts[a:b])[0], return_counts=True))
            if sum(len(w) for w, _ in waiting) > WORDS_AT_ONCE:
                summed()
                if len(words) > WORDS_AT_ONCE:
                    yield pd.DataFrame({"word": words.view(np.int64), "n": n})
                    words, n = words[:0], n[:0]
    if waiting:
        summed()
    yield pd.DataFrame({"word": words.view(np.int64), "n": n})


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word occurs in all of docs, labelled or not; written to the shared folder."""
    return cut(docs.select(text_or_empty().alias("text")).mapInPandas(_corpus, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))


class Model(NamedTuple):
    """Tables of log-likelihood differences (toxic minus ordinary)."""

    bigrams: Table  # seen bigrams: whole difference
    words: Table  # column 0: as a context that is backed off from; column 1: as a backed-off word
    unknown: float  # of a word that was never seen: none, as both classes leave it to the shared backoff
    weights: np.ndarray  # calibration: intercept and weights of the features

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text, of the words' log-likelihood differences: the mean; of those that are STRONG, the sum over the length and over its root."""
        out = np.zeros((len(texts), 3))
        for a, b in groups_of(texts, 1 << 19):
            ctx, word, key, n = bigrams_of(texts[a:b])
            slot, seen = self.bigrams.find(key)
            diff = np.where(seen, self.bigrams.values[slot], 0).astype(np.float64)
            rest = np.flatnonzero(~seen)
            at, known = self.words.find(ctx[rest])
            diff[rest] += np.where(known, self.words.values[at, 0], 0)
            at, known = self.words.find(word[rest])
            diff[rest] += np.where(known, self.words.values[at, 1], self.unknown)
            own, length = np.repeat(np.arange(b - a), n), np.maximum(n, 1)
            strong = np.bincount(own, np.where(diff > STRONG, diff, 0), b - a)
            out[a:b] = np.c_[np.bincount(own, diff, b - a) / length, strong / length, strong / np.sqrt(length)]
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return logistic(self.weights, self.features(texts))


def logistic(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton's method on standardised features. With one class only, the intercept says so."""
    if not len(y):
        return np.r_[-1.0, np.zeros(x.shape[1])]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - ridge * len(y) * w
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * len(y) * np.eye(len(w)), grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[1:] / scale
    return np.r_[w[0] - slopes @ mean, slopes]


def _left(n: np.ndarray, least: float) -> np.ndarray:
    """Counts after the discount."""
    return np.maximum(n - np.maximum(least, SPREAD * np.sqrt(n)), 0)


#: A count up to this leaves nothing after the discount (SPREAD squared).
NOTHING = 4


def fit(bigrams: pd.DataFrame, words: pd.DataFrame, total_words: int, kinds: int) -> Model:
    """Model without calibration.

    bigrams: ctx, word, key, toxic, ordinary (counts by class), ctx_toxic, ctx_ordinary (words after that context); only those with a count over NOTHING in a class.
    words: word, toxic, ordinary (contexts that a word follows, by class), n (its occurrences in all documents); only those with more than NOTHING in a class,
    or in a bigram above. total_words, kinds: words and distinct words of all documents, over which the shared backoff is spread. All other bigrams are backed
    off from and all other words are shared, so their differences are zero.
    """
    names, order = np.unique(words["word"].to_numpy(dtype=np.int64).view(np.uint64), return_index=True)
    ctx, word, key = (bigrams[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("ctx", "word", "key"))
    if not len(names):
        return Model(Table(np.float32), Table(np.dtype((np.float32, 2))), 0.0, np.zeros(4))
    follows = [words[c].to_numpy(dtype=np.float64)[order] for c in ("toxic", "ordinary")]
    shared = words["n"].to_numpy(dtype=np.float64)[order] / max(1, total_words) * (1 - UNIFORM) + UNIFORM / (kinds + 1)
    contexts, first, number = np.unique(ctx, return_index=True, return_inverse=True)
    word_of = np.searchsorted(names, word)
    high, low, back = [], [], []
    for c, f in zip(("toxic", "ordinary"), follows, strict=True):
        own = _left(f, SMALL_WORD)
        base = (1 - SHARED) * own / own.sum() + SHARED * shared if own.any() else shared
        total = bigrams[f"ctx_{c}"].to_numpy(dtype=np.float64)[first]
        own = _left(bigrams[c].to_numpy(dtype=np.float64), SMALL_BIGRAM)
        leave = (total - np.bincount(number, own, len(contexts)) + STRENGTH) / (total + STRENGTH)
        high.append(np.log(own / (total[number] + STRENGTH) + leave[number] * base[word_of]))
        low.append(np.log(leave))
        back.append(np.log(base))
    every = np.unique(np.r_[names, contexts])
    diff = np.zeros((len(every), 2), np.float32)
    diff[np.searchsorted(every, contexts), 0] = low[0] - low[1]
    diff[np.searchsorted(every, names), 1] = back[0] - back[1]
    pairs, table = Table(np.float32), Table(np.dtype((np.float32, 2)))
    pairs.add(key, (high[0] - high[1]).astype(np.float32))
    table.add(every, diff)
    return Model(pairs, table, 0.0, np.zeros(4))


def fold(name: str = "doc_id"):
    """crc32 of the id as text, modulo 5. Rows of fold 0 are held out from all learning."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Learns from labelled rows outside fold 0: counts from folds 1-3, calibration from fold 4.

    The samples are the rows with the smallest hashes of their ids, at most fit_rows of each class and calibration_rows
    more; whole texts are used. The shared backoff counts every word of all of docs, labelled or not, in a table that grows with them. Counting is
    distributed; what reaches the driver and what is broadcast are bounded by those samples.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold()).where("fold <> 0")
    known = known.withColumn("draw", F.xxhash64("doc_id"))

    def drawn(rows: DataFrame, n: int) -> DataFrame:
        return rows.orderBy("draw", "doc_id").limit(n).select("doc_id", "toxic", (F.col("fold") == 4).alias("check"))

    picked = drawn(known.where("fold < 4 AND toxic = 1"), fit_rows).unionAll(drawn(known.where("fold < 4 AND toxic = 0"), fit_rows)).unionAll(drawn(known.where("fold = 4"), calibration_rows))
    sample = cut(docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(cut(picked)), "doc_id"))
    both = None
    for name, value in (("toxic", 1), ("ordinary", 0)):
        own = sample.where((F.col("toxic") == value) & ~F.col("check")).select("text").mapInPandas(_count, BIGRAM)
        own = own.withColumns({c: F.col("n") if c == name else F.lit(0).cast("long") for c in ("toxic", "ordinary")})
        both = own if both is None else both.unionAll(own)
    counted = both.groupBy("key").agg(F.min("ctx").alias("ctx"), F.min("word").alias("word"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    counted = cut(counted)
    strong = cut(counted.where((F.col("toxic") > NOTHING) | (F.col("ordinary") > NOTHING)))
    totals = counted.groupBy("ctx").agg(F.sum("toxic").alias("ctx_toxic"), F.sum("ordinary").alias("ctx_ordinary"))
    follows = cut(counted.groupBy("word").agg(F.count(F.when(F.col("toxic") > 0, 1)).alias("toxic"), F.count(F.when(F.col("ordinary") > 0, 1)).alias("ordinary")))
    met = strong.select("word").distinct().withColumn("met", F.lit(True))
    words = follows.join(met, "word", "left").where((F.col("toxic") > NOTHING) | (F.col("ordinary") > NOTHING) | F.col("met")).drop("met")
    everywhere = corpus_counts(docs)
    whole = everywhere.agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).first()
    words = everywhere.join(cut(words), "word").select("word", "toxic", "ordinary", "n")
    model = fit(strong.join(totals, "ctx").toPandas(), words.toPandas(), whole["total"] or 0, whole["kinds"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    seen = _features(sample.where("check").select("toxic", "text"), shared).toPandas()
    return model._replace(weights=calibrate(seen[["mean", "strong", "root"]].to_numpy(dtype=np.float64), seen["toxic"].to_numpy(dtype=np.float64)))


def _features(rows: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = shared.value.features(batch["text"].tolist())
            yield pd.DataFrame({"toxic": batch["toxic"], "mean": x[:, 0], "strong": x[:, 1], "root": x[:, 2]})

    return rows.mapInPandas(run, "toxic int, mean double, strong double, root double")


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of scores between 0 and 1. Only the text goes to the workers; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()))

    return docs.withColumn(name, run(text_or_empty()))


def toxicity(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; a null or empty text gets the score of no evidence.

    Labels that are null or neither 0 nor 1 are ignored, of repeated ones the largest counts. Without usable labels every text
    gets one score under 0.5. Null ids are held out; repeated rows keep their rows.
    """
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels, **bounds))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """docs without the documents whose score is 0.5 or more; all columns stay, whatever their names."""
    scored = with_score(docs.select(whole_row(docs), F.col("text")), train(docs, labels, **bounds))
    return scored.where("score < 0.5").select("row.*")
