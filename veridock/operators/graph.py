"""Entity graphs: build, degree, flow-pruned paths, personalised PageRank, similarity pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridock.operators.lineage import cut


def undirected(edges: DataFrame, order: str | None = None) -> DataFrame:
    """One row per pair (src < dst) of edges(src, dst, ...); with `order`, the attributes of the last row of a pair win. Loops go."""
    own = edges.where("src <> dst").withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    if order is None:
        return own.dropDuplicates(["src", "dst"])
    last = Window.partitionBy("src", "dst").orderBy(F.col(order).desc())
    return own.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def flow_paths(edges: DataFrame, seeds: DataFrame, decay: float = 0.7, threshold: float = 0.01, max_hops: int = 4) -> DataFrame:
    """Simple paths from each seed to other seeds: nodes, flow = (1 + sum of flows on the way) / edges.

    A step's flow is decay * resource / degree of the node left; steps under the threshold are pruned as soon as they are made.
    The hop limit is fixed, so the steps are unrolled joins in one plan. edges: distinct undirected pairs; seeds(node).
    """
    steps = both_ways(edges).join(degree(edges), F.col("src") == F.col("node")).select("src", "dst", "degree")
    front = seeds.select(F.array("node").alias("nodes"), F.col("node").alias("tip"), F.lit(1.0).alias("resource"), F.lit(1.0).alias("total"))
    found = None
    for hop in range(1, max_hops + 1):
        front = front.join(steps, F.col("tip") == F.col("src")).withColumn("flow", F.lit(decay) * F.col("resource") / F.col("degree"))
        front = front.where((F.col("flow") >= threshold) & ~F.array_contains("nodes", F.col("dst")))
        front = front.select(F.concat("nodes", F.array("dst")).alias("nodes"), F.col("dst").alias("tip"), F.col("flow").alias("resource"), (F.col("total") + F.col("flow")).alias("total"))
        hit = front.join(seeds.select(F.col("node").alias("tip")), "tip", "left_semi").select("nodes", (F.col("total") / hop).alias("flow"))
        found = hit if found is None else found.unionAll(hit)
    return found


def best_paths(paths: DataFrame, scores: DataFrame, k: int = 15) -> DataFrame:
    """Relevance = mean score of a path's ends; score = flow * relevance; the best path of each pair of ends; k best in all."""
    a, b = F.element_at("nodes", 1), F.element_at("nodes", -1)
    own = paths.withColumns({"a": F.least(a, b), "b": F.greatest(a, b)})
    left, right = (scores.select(F.col("node").alias(c), F.col("score").alias(f"s{c}")) for c in "ab")
    scored = own.join(left, "a").join(right, "b").withColumn("relevance", (F.col("sa") + F.col("sb")) / 2)
    scored = scored.withColumn("score", F.col("flow") * F.col("relevance"))
    first = Window.partitionBy("a", "b").orderBy(F.col("score").desc(), F.size("nodes"), F.array_join("nodes", ">"))
    return scored.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "sa", "sb").orderBy(F.col("score").desc(), "a", "b").limit(k)


def pagerank(edges: DataFrame, reset: DataFrame, alpha: float = 0.85, rounds: int = 20, every: int = 5) -> DataFrame:
    """(node, rank): personalised PageRank on distinct undirected pairs after a fixed number of rounds.

    reset(node, mass) sums to 1; mass of nodes without edges flows back to the reset. Lineage is cut every few rounds where a checkpoint folder is set.
    """
    spark = edges.sparkSession
    steps = both_ways(edges).join(degree(edges), F.col("src") == F.col("node")).select("src", "dst", "degree")
    nodes = both_ways(edges).select(F.col("src").alias("node")).unionAll(reset.select("node")).distinct()
    base = nodes.join(reset, "node", "left").select("node", F.coalesce("mass", F.lit(0.0)).alias("mass"))
    rank = base.select("node", F.col("mass").alias("rank"))
    for i in range(rounds):
        sent = rank.join(steps, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        spread = sent.agg(F.coalesce(F.sum("got"), F.lit(0.0)).alias("moved"))
        rank = base.join(sent, "node", "left").join(F.broadcast(spread)).select("node", "mass", F.coalesce("got", F.lit(0.0)).alias("got"), "moved")
        rank = rank.select("node", (alpha * F.col("got") + (alpha * (1 - F.col("moved")) + 1 - alpha) * F.col("mass")).alias("rank"))
        if (i + 1) % every == 0 and spark.sparkContext.getCheckpointDir():
            rank = rank.checkpoint()
    return rank


#: Steps (edges both ways) up to which a graph is iterated in memory.
IN_MEMORY = 2_000_000


def _small_pagerank(steps: pd.DataFrame, mass: pd.DataFrame, like: DataFrame, alpha: float, tol: float, max_iter: int) -> DataFrame:
    schema = f"node {like.schema['node'].dataType.simpleString()}, rank double"
    names, at = np.unique(np.concatenate([steps["src"].to_numpy(), steps["dst"].to_numpy(), mass["node"].to_numpy()]), return_inverse=True)
    src, dst, own = at[: len(steps)], at[len(steps) : 2 * len(steps)], at[2 * len(steps) :]
    n, degree = len(names), np.bincount(src, minlength=len(names))
    seed, rank = np.bincount(own, mass["mass"].to_numpy(dtype=float), n) if n else np.zeros(0), np.full(n, 1.0 / max(n, 1))
    for _ in range(max_iter):
        got = np.bincount(dst, (rank / np.maximum(degree, 1))[src], n)
        old, rank = rank, alpha * got + (alpha * rank[degree == 0].sum() + 1 - alpha) * seed
        if np.abs(rank - old).sum() < tol * n:
            return like.sparkSession.createDataFrame(list(zip(names.tolist(), rank.tolist(), strict=True)), schema)
    return like.sparkSession.createDataFrame([], schema)


def converged_pagerank(edges: DataFrame, reset: DataFrame, alpha: float = 0.85, tol: float = 1e-6, max_iter: int = 100, in_memory: int = IN_MEMORY) -> DataFrame:
    """(node, rank): pagerank() as far as the reference's tolerance: rounds stop when the sum of changes is under tol * nodes.

    No rows if max_iter rounds don't reach that. Graphs of up to IN_MEMORY steps, by count, are iterated in the driver's memory (some 40 bytes a step); beyond, each
    round is a join that is cut, and its change comes to the driver.
    """
    steps = both_ways(edges)
    if (most := steps.limit(in_memory + 1).count()) <= in_memory and reset.limit(in_memory + 1).count() <= in_memory:
        return _small_pagerank(steps.toPandas() if most else pd.DataFrame({"src": [], "dst": []}), reset.toPandas(), reset, alpha, tol, max_iter)
    steps = cut(both_ways(edges).join(degree(edges), F.col("src") == F.col("node")).select("src", "dst", "degree"))
    nodes = steps.select(F.col("src").alias("node")).unionAll(reset.select("node")).distinct()
    loose = nodes.join(steps.select(F.col("src").alias("node")).distinct().withColumn("tied", F.lit(True)), "node", "left").select("node", F.col("tied").isNull().alias("loose"))
    base = cut(loose.join(reset, "node", "left").select("node", F.coalesce("mass", F.lit(0.0)).alias("mass"), "loose"))
    n = base.count()
    rank = base.select("node", F.lit(1.0 / max(n, 1)).alias("rank"))
    lost = rank.join(base, "node").agg(F.sum(F.when(F.col("loose"), F.col("rank")).otherwise(0.0))).first()[0] or 0.0
    for _ in range(max_iter):
        sent = rank.join(steps, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        new = base.join(sent, "node", "left").select("node", "loose", (alpha * F.coalesce("got", F.lit(0.0)) + (alpha * lost + 1 - alpha) * F.col("mass")).alias("rank"))
        new = cut(new.join(rank.withColumnRenamed("rank", "old"), "node"))
        change, lost = new.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), F.sum(F.when(F.col("loose"), F.col("rank")).otherwise(0.0))).first()
        rank = new.select("node", "rank")
        if (change or 0.0) < tol * n:
            return rank
    return rank.limit(0)


#: Rows of one side of a product, a block of 64 numbers each takes 4 MB; rows of a side that are multiplied at once.
SIDE, TILE = 16384, 256


def blocks_of(vectors: DataFrame, side: int = SIDE) -> DataFrame:
    """vectors(id, v) as (block, ids, v): up to about `side` rows each, by a hash, with their numbers in one flat array. Rows without id or vector go."""
    own = vectors.where("id IS NOT NULL AND v IS NOT NULL")
    n = max(1, -(-own.count() // side))
    gathered = own.groupBy(F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    return gathered.select("block", F.transform("rows", lambda r: r["id"]).alias("ids"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("v"))


def _met(left: DataFrame, right: DataFrame, n: int) -> GroupedData:
    """Blocks by the pair (x, y) that they belong to. A group is at most two rows, and Python has one group at a time, however many pairs a task has."""
    cols = [F.col("side"), F.col("ids"), F.col("v")]
    both = left.withColumn("side", F.lit(0)).select("x", "y", *cols).unionAll(right.withColumn("side", F.lit(1)).select("x", "y", *cols))
    return both.repartition(max(1, min(n, 4000)), "x", "y").groupBy("x", "y")


def _sides(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A group's two sides as (ids, matrix), in the order of the ids."""
    got = {}
    for batch in batches:
        for side, ids, v in zip(batch.column("side").to_pylist(), batch.column("ids"), batch.column("v"), strict=True):
            names = ids.values.to_numpy(zero_copy_only=False)
            order = np.argsort(names, kind="stable")
            got[side] = names[order], v.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(names), -1)[order]
    return got


def _last(blocks: DataFrame) -> int:
    """The largest block number; -1 if there are no blocks."""
    n = blocks.agg(F.max("block")).first()[0]
    return -1 if n is None else n


def _every_pair(asked: DataFrame, held: DataFrame) -> GroupedData | None:
    n, m = _last(asked), _last(held)
    if min(n, m) < 0:
        return None
    left = asked.withColumnRenamed("block", "x").withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(m))))
    right = held.withColumnRenamed("block", "y").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(n))))
    return _met(left, right, (n + 1) * (m + 1))


def similar_pairs(vectors: DataFrame, threshold: float, side: int = SIDE) -> DataFrame:
    """(a, b, similarity) of all pairs a < b whose dot product reaches the threshold, by blocked matrix products.

    vectors(id long, v array). Blocks of `side` rows are gathered once and go to every pair of blocks that they are in, so N * N / side vectors are moved. A task
    holds two blocks and the products of TILE rows with a block.
    """
    blocks = cut(blocks_of(vectors, side))
    n = _last(blocks)
    schema = "a long, b long, similarity double"
    if n < 0:
        return vectors.sparkSession.createDataFrame([], schema)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(batches)
        if len(sides) < 2:
            return
        (a, v), (b, w) = sides[0], sides[1]
        same = len(a) == len(b) and bool((a == b).all())  # blocks share no rows unless they are one
        for at in range(0, len(a), TILE):
            sims = v[at : at + TILE] @ w.T
            i, j = np.nonzero(sims >= threshold)
            own = a[at : at + TILE][i]
            keep = own < b[j] if same else own != b[j]
            i, j, own = i[keep], j[keep], own[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own, b[j])), pa.array(np.maximum(own, b[j])), pa.array(sims[i, j])], names=["a", "b", "similarity"])

    left = blocks.withColumnRenamed("block", "x").withColumn("y", F.explode(F.sequence("x", F.lit(n))))
    right = blocks.withColumnRenamed("block", "y").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("y"))))
    return _met(left, right, (n + 1) * (n + 2) // 2).applyInArrow(product, schema)


def _scaled(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm == 0, 1, norm)


def dense_top_k(rows: DataFrame, queries: DataFrame, k: int, digits: int = 6, side: int = SIDE, unit: bool = True) -> DataFrame:
    """(query, id, score, rank): for each of queries(id, v) the k rows(id, v) of highest cosine (or dot product, if not unit), ties to the smaller id. A zero vector
    has cosine 0.

    Both are gathered into blocks, and every pair of blocks meets. What leaves a pair is the k best of each query, so no pair of vectors becomes a row, and nothing
    is broadcast; TILE queries are multiplied with a block at once. Scores are rounded to `digits` before they are ranked.
    """
    met, schema = _every_pair(cut(blocks_of(queries, side)), cut(blocks_of(rows, side))), "query long, id long, score double"

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(batches)
        if len(sides) < 2:
            return
        (names, q), (ids, v) = [(i, _scaled(x) if unit else x) for i, x in (sides[0], sides[1])]
        for at in range(0, len(names), TILE):
            sims = np.round(q[at : at + TILE] @ v.T, digits)
            if k < len(ids):
                i, j = np.nonzero(sims >= np.partition(sims, len(ids) - k, axis=1)[:, [len(ids) - k]])
            else:
                i, j = (x.ravel() for x in np.indices(sims.shape))
            score = sims[i, j]
            order = np.lexsort((-score, i))  # stable, and ids are in order: ties to the smaller id
            i, j, score = i[order], j[order], score[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            yield pa.RecordBatch.from_arrays([pa.array(names[at : at + TILE][i[keep]]), pa.array(ids[j[keep]]), pa.array(score[keep])], names=["query", "id", "score"])

    found = met.applyInArrow(best, schema) if met else rows.sparkSession.createDataFrame([], schema)
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_scores(rows: DataFrame, queries: DataFrame, digits: int = 6, side: int = SIDE) -> DataFrame:
    """(query, id, score): of each of rows(id, v) the highest dot product, rounded, with the vectors that a query has; queries(id, v) has a row per vector.

    As in dense_top_k, blocks meet; a pair leaves a row per query and id, whatever the number of a query's vectors.
    """
    met, schema = _every_pair(cut(blocks_of(queries.distinct(), side)), cut(blocks_of(rows, side))), "query long, id long, score double"
    if not met:
        return rows.sparkSession.createDataFrame([], schema)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(batches)
        if len(sides) < 2:
            return
        (names, q), (ids, v) = sides[0], sides[1]

        def told(own: np.ndarray, top: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(own, len(ids))), pa.array(np.tile(ids, len(own))), pa.array(top.ravel())], names=["query", "id", "score"])

        last, most = None, None  # the query that a tile may end in, and its scores so far
        for at in range(0, len(names), TILE):
            own, start = np.unique(names[at : at + TILE], return_index=True)
            top = np.maximum.reduceat(np.round(q[at : at + TILE] @ v.T, digits), start, axis=0)
            if last is not None and own[0] == last:
                top[0] = np.maximum(top[0], most)
            elif last is not None:
                yield told(np.array([last]), most)
            if len(own) > 1:
                yield told(own[:-1], top[:-1])
            last, most = own[-1], top[-1]
        if last is not None:
            yield told(np.array([last]), most)

    found = met.applyInArrow(best, schema)
    return found.groupBy("query", "id").agg(F.max("score").alias("score"))


def flatten_triples(extracted: DataFrame) -> DataFrame:
    """(chunk_id, subject, relation, object) of extracted(chunk_id, triples array of arrays of three); others are left out."""
    each = extracted.select("chunk_id", F.explode("triples").alias("x")).where(F.size("x") == 3)
    return each.select("chunk_id", *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(("subject", "relation", "object"))])
