"""Run outcomes and their figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome(technical: Column, judge_error: Column, answered: Column, valid: Column, sufficient: Column) -> Column:
    """technical_error, validation_error, not_validated, answered or insufficient, by precedence; null flags are false."""
    no = lambda c: F.coalesce(c, F.lit(False))
    return F.when(no(technical), "technical_error").when(no(judge_error), "validation_error").when(~no(answered), "technical_error").when(~no(valid), "not_validated").otherwise(F.when(no(sufficient), "answered").otherwise("insufficient"))


def next_step(error: Column, valid: Column, attempts: Column, most: int = 2) -> Column:
    return F.when(error, "fallback").when(valid, "evidence").when(attempts >= most, "fallback").otherwise("refocus")


def by_tier(records: DataFrame, tier: str, result: str, latency: str) -> DataFrame:
    return records.groupBy(tier).agg(F.count("*").alias("n"), F.avg((F.col(result) == "answered").cast("double")).alias("answered_rate"), F.avg(latency).alias("mean_latency"), F.median(latency).alias("median_latency"), F.max(latency).alias("max_latency"))


OUTCOMES = ("answered", "insufficient", "not_validated", "validation_error", "technical_error")


def outcome_report(records: DataFrame) -> DataFrame:
    """(outcome, n, share) of records(outcome), those that never came about too."""
    spark = records.sparkSession
    n = records.groupBy("outcome").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(o,) for o in OUTCOMES], "outcome string").join(n, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))
    total = records.agg(F.count("*").alias("total"))  # one row
    return every.join(F.broadcast(total)).select("outcome", "n", (F.col("n") / F.nullif("total", F.lit(0))).alias("share"))


def retry_report(records: DataFrame) -> DataFrame:
    """(retried, rescued, refocused): runs of records(outcome, attempts, refocused) with more than one attempt, the share that ended answered, those that looked for evidence anew."""
    own = records.where("attempts > 1")
    return own.agg(F.count("*").alias("retried"), F.avg((F.col("outcome") == "answered").cast("double")).alias("rescued"), F.count_if("refocused").alias("refocused"))


def run_record(states: DataFrame) -> DataFrame:
    """The evaluation record of final states(question, tier, outcome, answer, attempts, refocused, reason, failed_step, technical_detail, latency); only a rejected answer is kept as such."""
    kept = F.when(F.col("outcome") == "not_validated", F.col("answer"))
    return states.select("question", "tier", "outcome", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("refocused", F.lit(False)).alias("refocused"), kept.alias("rejected_answer"), F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("failed_step", F.lit("")).alias("failed_step"), F.coalesce("technical_detail", F.lit("")).alias("technical_detail"), F.round("latency", 2).alias("latency"))


def product_runs(cases: DataFrame, states: DataFrame) -> DataFrame:
    """Records of cases(case_id, question, tier), each in a session of its own that declines every pause; a case without a final state has broken down."""
    both = cases.join(states, "case_id", "left")
    return both.withColumns({"session_id": F.concat(F.lit("case-"), F.col("case_id").cast("string")), "pauses_declined": F.coalesce("pauses", F.lit(0)), "outcome": F.coalesce("outcome", F.lit("technical_error"))})


def retrieval_dataset(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(case_id, question, reference, contexts) of cases with a reference, the texts of retrieved(case_id, rank, text) in order; none retrieved: an empty list."""
    texts = retrieved.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("contexts"))
    own = cases.where(F.length(F.trim(F.coalesce("reference", F.lit("")))) > 0).join(texts, "case_id", "left")
    return own.select("case_id", "question", "reference", F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"))
