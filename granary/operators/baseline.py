"""Drafts with their critics' assessments into split training rows: one plan of joins, gates, duplicates, groups and fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import keyed as K
from granary.operators.components import connected_components, star_edges
from granary.operators.order import ordered_fill
from granary.session import written

#: What a critic may recommend.
RECOMMENDATIONS = ("accept", "repair", "reject")
MESSAGES = "array<struct<role:string,content:string>>"


def assessment_error() -> Column:
    """Why an assessment (recommendation, scores, failure_tags, brief_notes, revised) does not count; null for a sound one."""
    tags, scores = F.col("failure_tags"), F.col("scores")
    high = F.forall(F.map_values(scores), lambda v: F.coalesce(v >= 4, F.lit(False)))
    repaired = F.coalesce(F.size(F.from_json("revised", MESSAGES)), F.lit(-1)) >= 2
    return (
        F.when(~F.coalesce(F.col("recommendation").isin(*RECOMMENDATIONS), F.lit(False)), "recommendation")
        .when(scores.isNull() | (F.size(scores) < 1), "scores")
        .when(tags.isNull(), "failure_tags")
        .when(F.col("brief_notes").isNull(), "brief_notes")
        .when((F.col("recommendation") == "accept") & ((F.size(tags) > 0) | ~high), "accept gate")
        .when((F.col("recommendation") == "repair") & ~repaired, "repair gate")
    )


def selected(drafts: DataFrame, jobs: DataFrame, assessments: DataFrame, repaired: bool) -> DataFrame:
    """Drafts (id, messages, ...) that their critic accepts, in repaired mode also those it repaired, with its messages.

    Adds review_status, original_hash (of the messages that a repair took the place of) and conversation_hash.
    """
    sound = assessments.filter(assessment_error().isNull()).filter(F.col("recommendation").isin("accept", *(["repair"] if repaired else [])))
    rows = drafts.join(jobs.join(sound.select("job_id", "recommendation", "revised"), "job_id").drop("job_id"), "id")
    fixed = F.col("recommendation") == "repair"
    old = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    out = rows.withColumn("original_hash", F.when(fixed, F.sha2(T.canonical_messages(F.col("messages")), 256)))
    out = out.withColumn("messages", F.when(fixed, F.from_json("revised", MESSAGES)).otherwise(old)).withColumn("review_status", F.when(fixed, "critic-repaired").otherwise("critic-accepted"))
    return out.withColumn("conversation_hash", F.sha2(T.canonical_messages(F.col("messages")), 256)).drop("recommendation", "revised")


def with_duplicates(rows: DataFrame) -> DataFrame:
    """The rows with duplicate_of: the smallest id with the same conversation; null for that id itself and without messages."""
    return K.keep_first(rows, F.col("conversation_hash"), "id")


def message_keys(messages: Column) -> Column:
    """array<struct<field, key>>: hashes of the normal forms of each user and each assistant message that has words."""
    said = F.filter(messages, lambda m: m["role"].isin("user", "assistant") & (F.coalesce(T.leakage_text(m["content"]), F.lit("")) != ""))
    return F.transform(said, lambda m: F.struct(m["role"].alias("field"), F.sha2(T.leakage_text(m["content"]), 256).alias("key")))


def group_keys(rows: DataFrame, keyed: DataFrame, said: str = "said") -> DataFrame:
    """(id, field, key): known grouping keys, and the message keys of a column."""
    return keyed.unionByName(rows.select("id", F.inline(said)))


def split_groups(rows: DataFrame, keys: DataFrame, share: float, seed: str) -> DataFrame:
    """The rows with group_id, the smallest id that they are connected to, and split: whole groups fill the training share."""
    found = connected_components(star_edges(keys, "id", ["field", "key"])).select(F.col("node").alias("id"), "component")
    grouped = written(rows.join(found, "id", "left").withColumn("group_id", F.coalesce("component", "id")).drop("component"))
    sides = ordered_fill(grouped.groupBy("group_id").agg(F.count("*").alias("n")), share, seed).select("group_id", F.concat(F.lit("experimental-"), "split").alias("split"))
    return grouped.drop("split").join(sides, "group_id")
