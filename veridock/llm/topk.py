"""Exact top-k inner products by term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Queries per block: the only data that is broadcast, of this size at most.
QUERY_BLOCK = 4096
#: Candidate rows scored at once.
ROW_BLOCK = 2048


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, q array<long>): floor(scale * x) of each component as a double. Vectors that are null or hold null or
    non-finite components are left out."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    good = F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(good).select("vec_id", F.transform(x, lambda v: F.floor(v * float(scale))).alias("q"))


def _dense(rows) -> np.ndarray:
    rows = list(rows)
    width = max(map(len, rows), default=0)
    if rows and all(len(r) == width for r in rows):
        return np.stack(rows).astype(np.int64)
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of all queries against a block of rows. Term by term, the posting list of a component (its rows with a weight other than zero)
    is scattered, times the query's weight, into dense arrays of scores."""
    score = np.zeros((len(queries), len(rows)), dtype=np.int64)
    for t in range(min(queries.shape[1], rows.shape[1])):
        post = np.flatnonzero(rows[:, t])
        asks = np.flatnonzero(queries[:, t])
        if len(post) and len(asks):
            add = np.multiply.outer(queries[asks, t], rows[post, t])
            if len(post) == len(rows) and len(asks) == len(queries):
                score += add
            else:
                score[np.ix_(asks, post)] += add
    return score


def _search(block, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, queries = block.value
        top: tuple[np.ndarray, np.ndarray, np.ndarray] = tuple(np.empty(0, dtype=np.int64) for _ in range(3))
        for batch in batches:
            for at in range(0, len(batch), ROW_BLOCK):
                part = batch.iloc[at : at + ROW_BLOCK]
                cand = part["vec_id"].to_numpy(dtype=np.int64)
                score = accumulate(queries, _dense(part["q"]))
                own = ids[:, None] == cand[None, :]
                if own.any():
                    score[own] = np.iinfo(np.int64).min
                keep = np.ones_like(score, dtype=bool)
                if len(cand) > k:  # partition selection; all ties of the k-th score stay for now
                    keep = score >= np.partition(score, len(cand) - k, axis=1)[:, len(cand) - k, None]
                q, c = np.nonzero(keep & ~own)
                merged = [np.concatenate(x) for x in zip(top, (q, score[q, c], cand[c]), strict=True)]
                order = np.lexsort((merged[2], -merged[1], merged[0]))
                q = merged[0][order]
                first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
                rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else q
                top = tuple(x[order][rank < k] for x in merged)
        yield pd.DataFrame({"query_id": ids[top[0]], "vec_id": top[2], "score": top[1]})

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query, ties to the smaller vec_id.

    Queries are taken in blocks of a fixed size (broadcast: query_block vectors at most). Every task scores its rows against
    the block and keeps k per query; a ranking per query merges them, cut to k on the map side. Nothing is approximate.
    Both sides are tables (vec_id, q); rows with the query's own vec_id are no candidates. Rows without id take no part. Of queries that share an id the
    smallest vector counts; repeated candidate rows are candidates each. Vectors of different lengths are compared on their
    common components. No rows or no queries: empty result. Sums must fit into 64 bits.
    """
    spark = candidates.sparkSession
    asked = cut(queries.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("q").alias("q")).repartitionByRange("vec_id").withColumn("_part", F.spark_partition_id()).withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy("vec_id")) - 1))
    blocks = [(r["_part"], b) for r in asked.groupBy("_part").agg(F.max("_n").alias("m")).orderBy("_part").collect() for b in range(r["m"] // query_block + 1)]
    sizes = {(r["_part"], r["_b"]): r["count"] for r in asked.groupBy("_part", F.floor(F.col("_n") / query_block).cast("int").alias("_b")).count().collect()}
    groups: list[list[tuple[int, int]]] = []
    room = 0
    for b in blocks:  # small blocks of neighbouring partitions share a pass
        if not groups or sizes[b] > room:
            groups.append([])
            room = query_block
        groups[-1].append(b)
        room -= sizes[b]
    found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    own = candidates.where("vec_id IS NOT NULL").select("vec_id", "q")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    merged = None
    for group in groups:
        inside = F.struct("_part", F.floor(F.col("_n") / query_block).cast("int")).isin([F.struct(F.lit(p), F.lit(b)) for p, b in group]) if len(groups) > 1 else F.lit(True)
        rows = asked.where(inside).select("vec_id", "q").toPandas()
        block = spark.sparkContext.broadcast((rows["vec_id"].to_numpy(dtype=np.int64), _dense(rows["q"])))
        part = own.mapInPandas(_search(block, k), found.schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if len(groups) > 1:
            part = cut(part)
        merged = part if merged is None else merged.unionAll(part)
    if merged is None:
        merged = found.withColumn("rank", F.lit(1))
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
