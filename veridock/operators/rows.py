"""Small operators on rows of any table: groups, firsts, fills, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridock.functions.text import collapse

#: How an affirmative reply begins.
YES = ("s", "sí", "si", "y", "ye", "1", "tr", "ok")


def shared_openings(rows: DataFrame, text: str, key: str, chars: int = 120) -> DataFrame:
    """(opening, n, first_id) of openings that several rows have, in normal form."""
    own = rows.groupBy(F.substring(collapse(F.col(text)), 1, chars).alias("opening")).agg(F.count("*").alias("n"), F.min(key).alias("first_id"))
    return own.where("n > 1")


def longest_form(rows: DataFrame, group: str, surface: str, order: str) -> DataFrame:
    """(group, label): the longest surface form of each group, measured as it is written, without white space at its ends; of equally long ones the first."""
    best = F.max_by(F.struct(F.trim(surface).alias("label"), F.col(order).alias("at")), F.struct(F.length(surface), -F.col(order)))
    return rows.groupBy(group).agg(best.alias("b")).select(group, "b.label", "b.at")


def ordered_distinct(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, values): the distinct values of each group in the order in which they first come."""
    first = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.min(order).alias("_at"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias("values"))


def size_stats(rows: DataFrame, group: str, size: str) -> DataFrame:
    """(group, least, middle, mean, most, n)."""
    return rows.groupBy(group).agg(F.min(size).alias("least"), F.median(size).alias("middle"), F.avg(size).alias("mean"), F.max(size).alias("most"), F.count("*").alias("n"))


def filled_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Columns that are null, or that the rows lack, take their default; values that are there win."""
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
    return rows


def with_previous(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Column `previous`: the value of the row before in its group."""
    return rows.withColumn("previous", F.lag(value).over(Window.partitionBy(group).orderBy(*order)))


def numbered(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Columns `n`, the row's number in its group, and `upto`, the values up to it, comma-joined."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"n": F.count("*").over(w), "upto": F.array_join(F.collect_list(value).over(w), ",")})


def group_ordered(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, values): each group's values in order."""
    return rows.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("values"))


def members_of(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is known."""
    return rows.join(known.select(key).distinct(), key, "left_semi")


def missing_from(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct keys of rows that are not known."""
    return rows.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def united(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Distinct keys of either."""
    return first.select(key).unionAll(second.select(key)).distinct()


def group_means(rows: DataFrame, labels: DataFrame, key: str, group: str, values: list[str]) -> DataFrame:
    """Means of the values per group, which labels(key, group) gives; rows it doesn't know are a group of their own (null)."""
    return rows.join(labels.select(key, group), key, "left").groupBy(group).agg(*[F.avg(c).alias(c) for c in values])


def affirmative(reply: Column) -> Column:
    """Whether a reply begins like a yes."""
    two = F.substring(F.lower(F.trim(F.coalesce(reply, F.lit("")))), 1, 2)
    return F.when(two == "", False).otherwise(two.isin(*YES))


def figures_of(text: Column) -> Column:
    """Distinct numbers in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))))
