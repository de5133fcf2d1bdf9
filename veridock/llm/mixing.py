"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, WORD, cut, global_rank, join_checked, text_or_empty, whole_row

MAX_EPOCHS = 3


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = MAX_EPOCHS) -> tuple[DataFrame, float]:
    """(source, sid, weight, source_size, source_rows, target) and the virtual time at which the budget is spent.

    The budget is the sum of all sizes. A source's target is its weight times that virtual time, but at most
    epochs times its size; the time is found by sharing the excess anew until no source is above. Each round is
    one aggregate over the table of sources.
    """
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    ranked = global_rank(stats, [F.col("source").asc_nulls_last()], "sid")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = cut(ranked.withColumn("weight", F.element_at(cycle, (F.col("sid") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(epochs)))
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    time, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * time
        got = table.agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        if got["n"] == capped or not got["w"]:
            break
        capped, time = got["n"], (total - (got["cap"] or 0.0)) / got["w"]
    return table.withColumn("target", F.least("cap", F.col("weight") * time)), time


#: A document in service when the budget is spent is queued in so many fragments, so that a source ends within one of them of its share.
FRAGMENTS = 256


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 42, epochs: int = MAX_EPOCHS, size=None, text: str = "text") -> DataFrame:
    """Copies of documents with their virtual finish times: doc_id, hash (of the text), source, source_size, target, size, ordinal (place in its
    shuffled source), epoch, finish, taken.

    A source's documents are shuffled by a hash of their ids; a copy finishes when all that its source has queued up to it is served, at
    (words queued) / weight. All copies are range-sorted by finish time, ties by source and place, and the queue is cut off where the words served
    reach the budget: what is before is taken, what comes after is not, and what the cut falls into is taken in part. source_targets gives the time of the cut beforehand to within a document
    of each source; a copy that is in service then is queued in FRAGMENTS parts, each with its own finish time.
    Every document has at least its row of epoch 0, with taken = 0 if the mix leaves it out.

    Running sums take two levels, buckets of about max(256, sqrt(rows of the source)) rows and a prefix over buckets, so a source
    that holds a third of all rows is spread over all tasks; only thin rows, no texts, are moved. In the global order, one sum per
    partition comes to the driver, and only the partition that the cut falls into is summed up row by row.

    A null text has size 0; a null source is a source of its own, ordered last. Repeated rows count each. Rows tied in
    id and hash are told apart by size, and are interchangeable beyond that. Empty table: empty result.
    """
    size = F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long") if size is None else size
    sized = cut(docs.select("doc_id", "source", size.alias("size"), F.xxhash64(text_or_empty(text)).alias("hash")))
    table, time = source_targets(sized, weights, epochs)
    table = cut(table.withColumn("buckets", F.ceil(F.col("source_rows") / F.greatest(F.lit(256.0), F.sqrt("source_rows")))))
    n = table.count()
    known = join_checked(sized, table.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "inner", n).drop("_source")
    draw = F.xxhash64("doc_id", F.lit(seed))
    known = known.withColumn("draw", draw).withColumn("bucket", F.pmod(F.col("draw"), F.col("buckets")))
    ahead = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = known.groupBy("sid", "bucket").agg(F.sum("size").alias("s"), F.count("*").alias("c"))
    base = sums.select("sid", "bucket", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("base_size"), F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("base_rows"))
    inside = Window.partitionBy("sid", "bucket").orderBy("draw", F.col("doc_id").asc_nulls_last(), "size", "hash")
    placed = known.withColumns({"own_rows": F.row_number().over(inside), "own_size": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))}).join(base, ["sid", "bucket"])
    placed = placed.withColumns({"ordinal": F.col("base_rows") + F.col("own_rows"), "before": F.col("base_size") + F.col("own_size") - F.col("size")})
    copies = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    start = F.col("epoch") * F.col("source_size") + F.col("before")
    copies = copies.withColumns({"start": start, "finish": (start + F.col("size")) / F.col("weight")})
    in_service = (F.col("start") <= F.lit(time) * F.col("weight")) & (F.col("finish") >= time) & (F.col("size") > 1)
    step = F.when(in_service, F.greatest(F.lit(1), F.ceil(F.col("size") / FRAGMENTS))).otherwise(F.greatest(F.lit(1), F.col("size"))).cast("long")
    queue = copies.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("size") - 1), step)))
    queue = queue.withColumn("words", F.least(step, F.col("size") - F.col("at"))).withColumn("done", (F.col("start") + F.col("at") + F.col("words")) / F.col("weight"))
    order = [F.col("done"), F.col("sid"), F.col("epoch"), F.col("ordinal"), F.col("at")]
    queue = queue.select("sid", "doc_id", "hash", "source", "source_size", "target", "size", "ordinal", "epoch", "finish", "at", "words", "done")
    queue = cut(queue.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    served = {r["part"]: r["w"] for r in queue.groupBy("part").agg(F.sum("words").alias("w")).collect()}
    budget, at = sum(r["s"] or 0 for r in table.agg(F.sum("source_size").alias("s")).collect()), -1
    for at in sorted(served):  # the partition that the cut falls into; what is left is spent there
        if budget <= served[at]:
            break
        budget -= served[at]
    sofar = F.sum("words").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    within = queue.where(F.col("part") == at).withColumn("taken", F.greatest(F.lit(0), F.least("words", F.lit(budget) - sofar)).cast("long"))
    outside = queue.where(F.col("part") != at).withColumn("taken", F.when(F.col("part") < at, F.col("words")).otherwise(0).cast("long"))
    key = ["doc_id", "hash", "source", "source_size", "target", "size", "sid", "ordinal", "epoch", "finish"]
    return outside.unionByName(within).where("taken > 0 OR epoch = 0").groupBy(*key).agg(F.sum("taken").alias("taken")).drop("sid")


def mix_totals(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of docs."""
    own = mix(docs, **options).groupBy("source", "ordinal", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken"))
    return own.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """docs as the mix takes them: whole documents, each as often as it is taken, all columns kept, range-sorted by virtual finish time (copies that
    finish together by id, then text).

    The copy that the cut falls into stays if at least half of it is taken, so a source's words differ from
    its target by about half of one document at most. Documents without words stay once, as they take nothing. Rows that share both id and
    text are repeated together, as often as the most taken of them. Names of other columns are free.
    """
    kept = mix(docs, **options).where((F.col("size") == 0) & (F.col("epoch") == 0) | (F.col("size") > 0) & (2 * F.col("taken") >= F.col("size")))
    times = kept.groupBy("doc_id", "hash", "ordinal").agg(F.sort_array(F.collect_list("finish")).alias("at"))  # at most `epochs` of a row
    times = cut(times.groupBy(F.col("doc_id").alias("id"), F.col("hash").alias("key")).agg(F.max_by("at", F.struct(F.size("at"), F.col("ordinal"))).alias("at")))
    own = docs.select(whole_row(docs), F.xxhash64(text_or_empty()).alias("h"))
    out = join_checked(own, times, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("key")), "inner", times.count(), 5 * broadcast_rows)
    order = ["at", "id", "key"]
    return out.select("row", "id", "key", F.explode("at").alias("at")).repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")
