"""Retrieval modes over entity graphs and their steps, each for many queries at once, and the catalogue of modes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridock.operators.graph import undirected
from veridock.operators.selection import ids_to_rows, merge_dedup, top_per_group

PASSAGE_WEIGHT, SUB_QUERIES, PER_HOP, ANSWER_SIZE, CONCEPTS, PRIMARY = 0.05, 3, 5, 8, 40, 20
SEPARATOR = "<SEP>"


def distinct_concepts(scores: DataFrame, query: str, node: str, key: Column, score: str, n: int = CONCEPTS) -> DataFrame:
    """Per query: each node's best score over the keywords, the best node of each concept, the n best concepts (ties to the smaller node).

    scores: one row per query, keyword and node.
    """
    best = scores.groupBy(query, node).agg(F.max(score).alias(score)).withColumn("concept", key)
    first = Window.partitionBy(query, "concept").orderBy(F.col(score).desc(), node)
    alone = best.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return top_per_group(alone, [query], [F.col(score).desc(), F.col(node)], n)


def rescaled(df: DataFrame, group: list[str], score: str, floor: float = 0.1) -> DataFrame:
    """Scores of each group stretched to [floor, 1]; equal scores are all 1."""
    w = Window.partitionBy(*group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(score, F.when(high == low, 1.0).otherwise(floor + (1 - floor) * (F.col(score) - low) / (high - low)))


def entity_graph(relations: DataFrame, context: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Undirected pairs (src, dst, kind) of three kinds of edges(src, dst). A pair of several kinds has the last of them; loops and empty ends go."""
    kinds = [("relation", relations), ("context", context), ("synonym", synonyms)]
    all_ = reduce(DataFrame.unionAll, [e.select("src", "dst", F.lit(k).alias("kind"), F.lit(i).alias("_o")) for i, (k, e) in enumerate(kinds)])
    return undirected(all_.where("src <> '' AND dst <> ''"), "_o").drop("_o")


def reset_mass(triples: DataFrame, passages: DataFrame, nodes: DataFrame, weight: float = PASSAGE_WEIGHT) -> DataFrame:
    """(node, mass) summing to 1: both phrases of triples(subject, object, score) get its score, passages(node, similarity) a small share of theirs.

    Negative scores are nothing, as are nodes that the graph's nodes(node) lack. No mass at all: no rows.
    """
    score = F.greatest(F.col("score"), F.lit(0.0))
    phrase = triples.select(F.explode(F.array("subject", "object")).alias("node"), score.alias("mass"))
    own = passages.select("node", (weight * F.greatest(F.col("similarity"), F.lit(0.0))).alias("mass"))
    mass = phrase.unionAll(own).join(nodes.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.sum("mass").alias("mass"))
    total = mass.agg(F.sum("mass").alias("total"))  # one row
    return mass.join(F.broadcast(total)).where("total > 0").select("node", (F.col("mass") / F.col("total")).alias("mass"))


def ranked_passages(rank: DataFrame, prefix: str, n: int = PRIMARY) -> DataFrame:
    """The n passages (nodes with the prefix) of highest rank(node, rank), ties to the smaller name."""
    own = rank.where(F.col("node").startswith(prefix)).orderBy(F.col("rank").desc(), "node").limit(n)
    return own.withColumn("node", F.substring("node", len(prefix) + 1, 1_000_000))


def traverse(entities: DataFrame, relations: DataFrame, edges: DataFrame, query: str, n: int = PRIMARY) -> DataFrame:
    """Chunks behind an entity and relation search: per query, n chunks, those of the best scored first.

    entities(query, node, score) are the local hits; the edges they touch and relations(query, src, dst, score), the global hits, follow.
    edges(src, dst, sources) with the ids of the chunks behind them.
    """
    hits = _touching(entities, edges, query).select(query, "score", "sources").unionByName(relations.join(edges, ["src", "dst"]).select(query, "score", "sources"))
    chunk = hits.select(query, "score", F.explode(F.split("sources", SEPARATOR)).alias("chunk_id")).where("chunk_id <> ''")
    best = chunk.groupBy(query, "chunk_id").agg(F.max("score").alias("score"))
    return top_per_group(best, [query], [F.col("score").desc(), F.col("chunk_id")], n)


def _touching(entities: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """Edges at each hit entity, by two equi-joins rather than one on either end."""
    ends = [entities.join(edges.withColumnRenamed(end, "node"), "node").select(query, "score", "sources") for end in ("src", "dst")]
    return ends[0].unionByName(ends[1])


def path_chunks(paths: DataFrame, nodes: DataFrame, edges: DataFrame, n: int = PRIMARY) -> DataFrame:
    """(chunk_id, place) of the first n distinct chunks along paths(path_no, nodes): each node's chunks, then those of the edge after it.

    nodes(node, sources) and edges(src < dst, sources) hold chunk ids with `<SEP>` between them.
    """
    at = paths.select("path_no", F.posexplode("nodes").alias("i", "node"), "nodes")
    own = at.join(nodes, "node").select("path_no", (2 * F.col("i")).alias("i"), "sources")
    step = at.where(F.col("i") + 1 < F.size("nodes")).withColumn("next", F.get("nodes", F.col("i") + 1))
    step = step.select("path_no", (2 * F.col("i") + 1).alias("i"), F.least("node", "next").alias("src"), F.greatest("node", "next").alias("dst")).join(edges, ["src", "dst"]).select("path_no", "i", "sources")
    each = own.unionAll(step).select("path_no", "i", F.posexplode(F.split("sources", SEPARATOR)).alias("j", "chunk_id")).where("chunk_id <> ''")
    first = each.groupBy("chunk_id").agg(F.min(F.struct("path_no", "i", "j")).alias("_at")).orderBy("_at").limit(n)
    return first.select("chunk_id", F.row_number().over(Window.orderBy("_at")).alias("place"))  # n rows


def described(items: DataFrame, local: DataFrame, key: str, chars: int = 220) -> DataFrame:
    """items(key, description) with the translated text of local(key, text) where there is one, else the first of their own; cut to `chars`."""
    own = F.substring_index("description", SEPARATOR, 1)
    return items.join(local, key, "left").withColumn("shown", F.substring(F.coalesce(F.nullif("text", F.lit("")), own), 1, chars)).drop("text")


def iterate(hits: DataFrame, query: str, key: str, scorer: Column, n: int = ANSWER_SIZE, hops: int = SUB_QUERIES, per_hop: int = PER_HOP) -> DataFrame:
    """Pools the first hits of each sub-query and ranks the pool against the whole question.

    hits(query, hop, key, rank, ...): ranked results of sub-queries 1, 2, ... scorer: score of a row for the original question.
    """
    pool = hits.where((F.col("hop") <= hops) & (F.col("rank") <= per_hop)).withColumn("_pos", F.col("hop") * (per_hop + 1) + F.col("rank")).drop("rank")
    return top_per_group(merge_dedup([pool], key, "_pos", [query]).withColumn("score", scorer), [query], [F.col("score").desc(), F.col("place")], n).drop("_pos")


#: Names of the modes and what they do; bodies are plain functions that compose DataFrames.
MODES: dict[str, tuple[str, Callable[..., DataFrame]]] = {}
DEFAULT_MODE = "baseline"


def mode(name: str, description: str):
    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        MODES[name] = (description, f)
        return f

    return register


def get_mode(name: str) -> Callable[..., DataFrame]:
    """The mode's function; an unknown name is an error."""
    if name not in MODES:
        raise KeyError(f"no mode {name!r}; known: {', '.join(sorted(MODES))}")
    return MODES[name][1]


def resolve_mode(*choices: str | None) -> str:
    """The first choice that is a known mode, else the default."""
    return next((c for c in choices if c in MODES), DEFAULT_MODE)


@mode("baseline", "hybrid candidates, ranked anew")
def baseline(hybrid: DataFrame, query: str, scorer: Column, n: int = 5) -> DataFrame:
    return top_per_group(hybrid.withColumn("score", scorer), [query], [F.col("score").desc(), F.col("rank")], n, "place")


@mode("iterative", "several hops, one pool")
def iterative(hits: DataFrame, query: str, key: str, scorer: Column, **bounds) -> DataFrame:
    return iterate(hits, query, key, scorer, **bounds)


@mode("graph", "entities and relations of a knowledge graph")
def graph_search(entities: DataFrame, relations: DataFrame, edges: DataFrame, query: str, n: int = PRIMARY) -> DataFrame:
    return traverse(entities, relations, edges, query, n)


@mode("pathrag", "chunks along flow-pruned paths")
def path_search(paths: DataFrame, nodes: DataFrame, edges: DataFrame, rows: DataFrame, n: int = PRIMARY) -> DataFrame:
    return ids_to_rows(path_chunks(paths, nodes, edges, n), rows, "chunk_id", "place")


@mode("hipporag", "passages by personalised PageRank")
def passage_search(rank: DataFrame, prefix: str, n: int = PRIMARY) -> DataFrame:
    return ranked_passages(rank, prefix, n)
