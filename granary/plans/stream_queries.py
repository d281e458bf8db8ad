"""Queries that run a stream over a whole table to its end and return the state it leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.plans.document_queries import FEEDBACK
from granary.plans.evaluation_queries import KEY, LATEST
from granary.streaming import logs


def stream_latest_attempt(spark, d):
    at = logs.scratch(spark)
    last = logs.latest_state(logs.file_stream(spark, f"{d}/bakeoff_results.parquet"), KEY, [F.col("finished_at"), F.col("attempt")], f"{at}/state", f"{at}/checkpoint")
    return spark.read.parquet(last).select(*KEY, "attempt", "status", "finish_reason", "output_tokens")


def stream_feedback_daily(spark, d):
    at = logs.scratch(spark)
    logs.daily_partitions(logs.file_stream(spark, f"{d}/events.parquet"), "ts", f"{at}/days", f"{at}/checkpoint")
    rows = spark.read.option("basePath", f"{at}/days").parquet(f"{at}/days").withColumn("day", F.col("day").cast("string"))
    return rows.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


QUERIES = {"stream_latest_attempt": stream_latest_attempt, "stream_feedback_daily": stream_feedback_daily}
ORACLES = {"stream_latest_attempt": LATEST, "stream_feedback_daily": FEEDBACK}
