"""What links a question to an entity graph: keywords, triples, descriptions of items, and the concept map that paths become. Models are pluggable columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridock.functions.labels import clean_list
from veridock.functions.text import collapse
from veridock.operators.graph import dense_top_k

SEPARATOR, TRIPLES, AT_ONCE = "<SEP>", 5, 40


def extracted_triples(chunks: DataFrame, extract: Callable[[Column], Column]) -> DataFrame:
    """(chunk_id, triples) of chunks(chunk_id, text); extract gives an array of arrays of three, and null, a failure, is no triples."""
    none = F.array().cast("array<array<string>>")
    return chunks.select("chunk_id", F.coalesce(extract(F.col("text")), none).alias("triples"))


def keywords(question: Column, extracted: Column) -> Column:
    """The keywords that a model found; the question itself where it failed or found none."""
    own = clean_list(extracted)
    return F.when(F.size(own) > 0, own).otherwise(F.array(question))


def linked_triples(queries: DataFrame, triples: DataFrame, k: int = TRIPLES) -> DataFrame:
    """(query, triple, score, rank): the k triples(triple, v) nearest to each of queries(query, v) by dot product, ties to the smaller triple."""
    found = dense_top_k(triples.select(F.col("triple").alias("id"), "v"), queries.select(F.col("query").alias("id"), "v"), k, unit=False)
    return found.select("query", F.col("id").alias("triple"), "score", "rank")


def recognised(linked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Linked triples that the judge of verdicts(query, keep array<int>) keeps, by their place from 0. Places out of range say nothing; where the judge
    failed (no row, or null) all stay."""
    both = linked.join(verdicts, "query", "left")
    return both.where(F.col("keep").isNull() | F.array_contains("keep", F.col("rank") - 1)).drop("keep")


def item_key(src: Column, dst: Column | None = None) -> Column:
    """A node's name, or an edge's ends in order."""
    return src if dst is None else F.concat_ws("|", F.least(src, dst), F.greatest(src, dst))


def items_by_chunk(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(chunk_id, items): the keys of the nodes(node, sources) and edges(src, dst, sources) that each chunk is a source of, sorted."""
    every = nodes.select(item_key(F.col("node")).alias("item"), "sources").unionAll(edges.select(item_key(F.col("src"), F.col("dst")), "sources"))
    each = every.select("item", F.explode(F.split("sources", SEPARATOR)).alias("chunk_id")).where("chunk_id <> ''").distinct()
    return each.groupBy("chunk_id").agg(F.array_sort(F.collect_list("item")).alias("items"))


def description_batches(items: DataFrame, n: int = AT_ONCE) -> DataFrame:
    """(chunk_id, batch, items): what is described in one call, n items of a chunk at most."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("items") - 1, F.lit(0)), F.lit(n))
    return items.where(F.size("items") > 0).select("chunk_id", F.posexplode(F.transform(starts, lambda s: F.slice("items", s + 1, F.lit(n)))).alias("batch", "items"))


def first_descriptions(records: DataFrame) -> DataFrame:
    """(item, text) of records(chunk_id, descriptions map): of an item's descriptions that of the first chunk by id, however the records were written."""
    each = records.select("chunk_id", F.explode("descriptions").alias("item", "text"))
    return each.groupBy("item").agg(F.min_by("text", "chunk_id").alias("text"))


def shown_description(local: Column, original: Column, chars: int = 220) -> Column:
    """The local description where there is one, else the first of the original ones; on one line, cut to `chars`."""
    own = F.when(F.coalesce(local, F.lit("")) != "", local).otherwise(F.substring_index(F.coalesce(original, F.lit("")), SEPARATOR, 1))
    return F.substring(collapse(own), 1, chars)


def concept_map(paths: DataFrame, items: DataFrame, query: str) -> DataFrame:
    """(query, map): paths(query, nodes, score) as text, the best one last, each node and edge with its description in items(item, shown). Scores aren't told."""
    own = paths.withColumn("_no", F.row_number().over(Window.partitionBy(query).orderBy("score", F.array_join("nodes", ">"))))
    at = own.select(query, "_no", "nodes", F.posexplode("nodes").alias("i", "node"))
    after = F.get("nodes", F.col("i") + 1)
    node = at.select(query, "_no", (2 * F.col("i")).alias("j"), F.col("node").alias("item"), F.col("node").alias("name"))
    edge = at.where(after.isNotNull()).select(query, "_no", (2 * F.col("i") + 1).alias("j"), item_key(F.col("node"), after).alias("item"), F.lit(None).cast("string").alias("name"))
    known = node.unionAll(edge).join(items, "item", "left")
    told = F.coalesce("shown", F.lit(""))
    part = F.when(F.col("name").isNull(), F.concat(F.lit("  --["), told, F.lit("]-->"))).when(told != "", F.concat_ws(": ", "name", told)).otherwise(F.col("name"))
    line = known.groupBy(query, "_no").agg(F.concat(F.lit("- "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", part.alias("t")))), lambda x: x["t"]), "\n  ")).alias("line"))
    return line.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "line"))), lambda x: x["line"]), "\n").alias("map"))


def path_trace(paths: DataFrame) -> DataFrame:
    """(path, score, flow, relevance) to look into a ranking, four digits each; the best first where it is ordered by score."""
    return paths.select(F.array_join("nodes", " -> ").alias("path"), *[F.round(c, 4).alias(c) for c in ("score", "flow", "relevance")])
