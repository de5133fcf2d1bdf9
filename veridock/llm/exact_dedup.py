"""Exact dedup: 128-bit content hash, smallest stable id kept, bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, cut, join_checked, keep_one, text_or_empty


def normalised(name: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(name), SPACE, " ")


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def exact_groups(docs: DataFrame, hash_of=content_hash, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space becomes one space; a null text is empty.
    Only ids and digests are shuffled for all rows. Texts of hashes that occur twice are then compared
    byte for byte by the smallest and the largest text of each hash, which combine on the map side, so a
    group of any size never meets in one task. A hash whose two texts differ is grouped anew by the whole text.

    Nulls: a null doc_id counts as the largest id (it stays only if all ids of its group are null).
    Repeated rows (same id, same text) are members of one group; each of them has kept = true if it bears
    the kept id. An empty table gives an empty result; other columns are not read.
    """
    texts = docs.select("doc_id", normalised().alias("norm")).withColumn("h", hash_of(F.col("norm")))
    rows = cut(texts.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256")))
    groups = cut(rows.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"))
    n = groups.count()
    shared = join_checked(texts, groups.select("h"), "h", "left_semi", n, broadcast_rows)
    collided = cut(shared.groupBy("h").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where("lo <> hi").select("h"))
    out = join_checked(rows, groups, "h", "left", n, broadcast_rows)
    out = out.withColumns({"keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    if (n_collided := collided.count()):
        members = join_checked(texts, collided, "h", "left_semi", n_collided, broadcast_rows)
        apart = cut(members.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
        again = members.join(apart, ["h", "norm"]).withColumn("text_sha256", F.sha2("norm", 256))
        out = join_checked(out, collided, "h", "left_anti", n_collided, broadcast_rows).unionByName(again.select(*out.columns))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, hash_of=content_hash, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with one row of each text: the one with the smallest id, where null counts as the largest. All columns stay.

    Rows are told apart by id and text, so repeated rows and rows without id lose their copies too, and an id that two
    texts share loses none of them.
    """
    groups = exact_groups(docs, hash_of, broadcast_rows)
    digest = F.unhex(F.col("text_sha256"))
    key = F.unhex(F.sha2(normalised(), 256))
    return keep_one(docs, key, groups.select("doc_id", digest.alias("k"), digest.alias("g")), broadcast_rows)
