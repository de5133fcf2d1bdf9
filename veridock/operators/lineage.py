"""Lineage cuts that survive lost executors, and places in a total order without one task that sees all rows."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder of spark.checkpoint.dir; in one process (tests) a folder of its own will do where that is unset."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veridock-"))
    return df.checkpoint()


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Rows numbered from 1 in a total order: a range shuffle sorts across partitions, and one count per partition comes to the driver."""
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    ahead, before = {}, 0
    for r in sorted(parts.groupBy("_part").count().collect()):
        ahead[r["_part"]], before = before, before + r["count"]
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in ahead.items() for x in pair]), F.col("_part").cast("long")) if ahead else F.lit(0)
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn(name, local + offset).drop("_part")
