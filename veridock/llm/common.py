"""What the corpus operators share: lineage cuts, size-checked broadcasts, global ranks."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from py4j.clientserver import DEFAULT_WORKER_SLEEP_TIME
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A side of a join is broadcast only if it has been counted and has at most so many (narrow) rows.
BROADCAST_ROWS = 100_000

#: White space and words of the contracts.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs in one process (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veridock-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system layer, so any store that Spark can write works."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: later reads survive the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to any more: what was shuffled before a cut needn't stay on disk.

    The JVM learns of frames that Python let go from a thread of py4j that may sleep so long; collected earlier, it would keep their shuffles.
    """
    gc.collect()
    time.sleep(DEFAULT_WORKER_SLEEP_TIME + 0.3)
    for _ in range(2):  # the second pass frees what the first one's finalisers let go
        spark._jvm.System.gc()
        time.sleep(0.3)


def join_checked(left: DataFrame, right: DataFrame, on, how: str, right_rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a narrow, already counted right side: broadcast within the limit, else a shuffled join.

    The right side should come straight from cut(), so that both children of the shuffled join are
    exchanges and adaptive execution may split a hot key of the left side.
    """
    return left.join(F.broadcast(right) if right_rows <= limit else right, on, how)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct `row`, so that no column of the operator can clash with one of docs; select("row.*") gives them back."""
    return F.struct(*[quoted(c) for c in docs.columns]).alias("row")


def keep_one(docs: DataFrame, key: Column, members: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id (null counts as the largest), then the smallest key.

    key is a hash of the row's text; members(doc_id, k, g) gives the group g of each doc_id and key k. Rows that are equal
    in both are told apart by their other columns, of which the smallest stay (any, if a map is among them). Rows that no
    member names stay too. Names of other columns are free.
    """
    each = cut(members.groupBy("doc_id", "k", "g").agg(F.count("*").alias("n")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("first")
    groups = cut(each.groupBy("g").agg(first, F.sum("n").alias("total")).where("total > 1").select("g", "first"))
    marks = join_checked(each, groups, "g", "inner", groups.count())
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("k") == F.col("first.k"))
    marks = cut(marks.withColumn("tied", is_first).where("NOT tied OR n > 1").select(F.col("doc_id").alias("id"), F.col("k").alias("key"), "tied"))
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("k") == F.col("key"))
    out = join_checked(docs.select(whole_row(docs), key.alias("k")), marks, same, "left", marks.count(), 5 * broadcast_rows)
    kept = out.where("tied IS NULL").select("row.*")
    if marks.where("tied").isEmpty():
        return kept
    one = F.any_value("row") if "map<" in docs.schema.simpleString() else F.min("row")
    return kept.unionByName(out.where("tied").groupBy("id", "key").agg(one.alias("row")).select("row.*"))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows numbered from 0 in a total order, without one task seeing them all.

    A range shuffle sorts across partitions; only one count per partition meets on the driver.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}
    base, before = [], 0
    for p in sorted(sizes):
        base.append((p, before))
        before += sizes[p]
    offsets = df.sparkSession.createDataFrame(base or [(0, 0)], "_part int, _base long")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.join(F.broadcast(offsets), "_part").withColumn(name, local + F.col("_base")).drop("_part", "_base")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def struct_of(schema: str) -> T.StructType:
    return T._parse_datatype_string(schema)
