"""What follows glyph extraction: noise lines, running heads, regions, tables, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridock.functions.text import collapse


def head_key(text: Column) -> Column:
    return F.lower(collapse(F.regexp_replace(text, r"\d+", "")))


def running_heads(lines: DataFrame) -> DataFrame:
    """(doc_id, key) of lines(doc_id, page, line_no, text) among the first or last two of enough pages."""
    up, down = (Window.partitionBy("doc_id", "page").orderBy(o) for o in (F.col("line_no"), F.col("line_no").desc()))
    edge = lines.withColumns({"_u": F.row_number().over(up), "_d": F.row_number().over(down)}).where("_u <= 2 OR _d <= 2")
    seen = edge.select("doc_id", "page", head_key(F.col("text")).alias("key")).distinct().groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    return seen.join(pages, "doc_id").where((F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") / 2))) & (F.length("key") > 12)).select("doc_id", "key")


def is_noise(text: Column) -> Column:
    """Page numbers, lines of citation numbers alone, leaders of a table of contents."""
    t = F.trim(text)
    return t.rlike(r"^\d{1,4}$") | t.rlike(r"^[\[\]\d,;\s-]+$") | t.rlike(r"\.{4,}\s*\d+$")


def outside_regions(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """lines(page, x0, top) that lie in no region(page, x0, top, x1, bottom) of their page."""
    r = regions.select(F.col("page").alias("_p"), F.col("x0").alias("_x0"), F.col("top").alias("_t"), F.col("x1").alias("_x1"), F.col("bottom").alias("_b"))
    inside = (F.col("page") == F.col("_p")) & (F.col("x0") >= F.col("_x0")) & (F.col("x0") <= F.col("_x1")) & (F.col("top") >= F.col("_t")) & (F.col("top") <= F.col("_b"))
    return lines.join(r, inside, "left_anti")


def fill_down(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Empty cells take the last label above; figures and grades are labels of nothing."""
    v = F.col(value)
    carry = F.when(v != "", F.when(v.rlike(r"^[\d.,%\s]+$") | v.rlike(r"^[ABC]-?I{1,3}$"), "").otherwise(v))
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("filled", F.when(v == "", F.coalesce(F.last(carry, ignorenulls=True).over(w), F.lit(""))).otherwise(v))


def kept_share(before: DataFrame, after: DataFrame) -> DataFrame:
    """Share of a multiset of tokens(token) that another one holds too."""
    a = before.groupBy("token").agg(F.count("*").alias("n"))
    b = after.groupBy("token").agg(F.count("*").alias("kept"))
    return a.join(b, "token", "left").agg((F.sum(F.least("n", F.coalesce("kept", F.lit(0)))) / F.sum("n")).alias("share"))


def paragraphs(lines: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Lines joined until one ends a sentence: a new group begins after each such line."""
    w = Window.partitionBy(group).orderBy(order)
    ended = F.coalesce(F.lag(F.when(F.col(text).rlike(r"[.:?!]\s*$"), 1).otherwise(0)).over(w), F.lit(0))
    own = lines.withColumn("_e", ended).withColumn("paragraph", F.sum("_e").over(w))
    return own.groupBy(group, "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias("text"))


def assess_pages(pages: DataFrame, most: int = 12, least_chars: int = 200) -> DataFrame:
    """(doc_id, status) of page texts(doc_id, page, text): scanned, broken_cmap or native_ok, from the first pages."""
    first = pages.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))).where(F.col("_n") <= most)
    got = first.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(F.regexp_count("text", F.lit(r"\(cid:\d+\)"))).alias("cids"))
    status = F.when(F.col("chars") < least_chars * F.col("n") / 4, "scanned").when(F.col("cids") > 0.001 * F.col("chars"), "broken_cmap").otherwise("native_ok")
    return got.select("doc_id", status.alias("status"))
