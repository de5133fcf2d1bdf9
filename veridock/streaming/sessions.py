"""Per-session state, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATE = "session_id string, turn long, question string, previous string, facts map<string,string>"


def session_facts(turns: DataFrame) -> DataFrame:
    """turns(session_id, turn, question, attr, value, reset) with the previous question and `facts`: per attribute the last value since the last
    reset (a turn's own reset comes before its fact). What stream_facts() gives for a stream, row for row.
    """
    w = Window.partitionBy("session_id").orderBy("turn")
    own = turns.withColumns({"patient": F.sum(F.coalesce(F.col("reset"), F.lit(False)).cast("int")).over(w), "previous": F.lag("question").over(w)})
    p = Window.partitionBy("session_id", "patient").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    known = F.collect_list(F.when(F.coalesce("attr", F.lit("")) != "", F.struct("attr", "value"))).over(p)
    # of each attribute the last entry: taken from the right, the first one met
    last = F.aggregate(F.reverse(known), F.create_map().cast("map<string,string>"), lambda m, x: F.when(F.map_contains_key(m, x["attr"]), m).otherwise(F.map_concat(F.map_from_arrays(F.array(x["attr"]), F.array(x["value"])), m)))
    return own.withColumn("facts", last).drop("patient")


def _merge(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    previous, facts = state.get if state.exists else (None, {})
    for frame in frames:
        rows = []
        for r in frame.sort_values("turn").itertuples():
            facts = ({} if r.reset else dict(facts)) | ({r.attr: r.value} if r.attr else {})
            rows.append((key[0], r.turn, r.question, previous, facts))
            previous = r.question
        yield pd.DataFrame(rows, columns=["session_id", "turn", "question", "previous", "facts"])
    state.update((previous, facts))


def stream_facts(turns: DataFrame) -> DataFrame:
    """The same for a stream, with state per session; turns of a micro-batch are taken in order."""
    return turns.groupBy("session_id").applyInPandasWithState(_merge, STATE, "previous string, facts map<string,string>", "append", "NoTimeout")


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type, with a watermark; works on a stream or a table."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
