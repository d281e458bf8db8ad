"""Aggregates over evaluation logs and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import CONTROL, word_count


def run_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts, token sum and spread, minutes, medians and peak memory of each group; null where nothing succeeded."""
    ok = F.col("status") == "ok"
    when_ok = lambda c: F.when(ok, F.col(c))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("task_id").alias("tasks"),
        F.sum(ok.cast("long")).alias("n_ok"),
        F.sum((F.col("status") == "error").cast("long")).alias("n_error"),
        F.sum((ok & (F.col("finish_reason") == "length")).cast("long")).alias("cut"),
        F.sum(when_ok("output_tokens")).alias("tokens"),
        F.median(when_ok("output_tokens")).alias("median_tokens"),
        F.min(when_ok("output_tokens")).alias("least_tokens"),
        F.max(when_ok("output_tokens")).alias("most_tokens"),
        F.round(F.sum(when_ok("latency_seconds")) / 60, 3).alias("minutes"),
        F.median(when_ok("latency_seconds")).alias("median_latency"),
        F.median(when_ok("tokens_per_second")).alias("median_speed"),
        F.max("peak_unified_memory_gb").alias("peak_memory"),
    )


def control_tokens(response: Column) -> tuple[Column, Column]:
    """Number of control tokens in a response, and the distinct ones in order, blank between."""
    found = F.regexp_extract_all(response, F.lit(CONTROL), 0)
    return F.coalesce(F.size(found), F.lit(0)), F.array_join(F.array_sort(F.array_distinct(found)), " ")


def tokenization(df: DataFrame, text: str, tokens: Column) -> DataFrame:
    """words, chars, tokens and their ratios, 0 where there is nothing to divide by."""
    out = df.withColumn("words", word_count(F.col(text)).cast("long")).withColumn("chars", F.length(text).cast("long")).withColumn("tokens", tokens.cast("long"))
    ratio = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    return out.withColumn("tokens_per_word", ratio("tokens", "words")).withColumn("tokens_per_char", ratio("tokens", "chars"))


def ratio_by_group(df: DataFrame, group: str) -> DataFrame:
    """(group, texts, words, tokens, tokens_per_word) of each group and of all together, named all."""
    sums = df.groupingSets([[group], []], group).agg(F.grouping(group).alias("g"), F.count("*").alias("texts"), F.sum("words").alias("words"), F.sum("tokens").alias("tokens"))
    name = F.when(F.col("g") == 1, "all").otherwise(F.coalesce(F.col(group), F.lit("none")))
    return sums.select(name.alias(group), "texts", "words", "tokens", F.round(F.when(F.col("words") == 0, 0.0).otherwise(F.col("tokens") / F.col("words")), 6).alias("tokens_per_word"))
