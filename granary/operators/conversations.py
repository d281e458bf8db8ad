"""Operators over conversations: checks of turns, histories, prompt and completion rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.text import is_blank

#: Caps of a conversation's messages and of all of them together, in characters.
MESSAGE_CAP, TOTAL_CAP = 12_000, 36_000


def message_errors(messages: Column) -> Column:
    """array<string> of what is wrong with a message list; empty for a sound one.

    A missing list, one of fewer than two and one of odd length end the check; then each message needs the role of its
    place, user first, and content.
    """
    n = F.size(messages)
    each = F.transform(
        messages,
        lambda m, k: F.array_compact(F.array(
            F.when(F.coalesce(m["role"], F.lit("")) != F.when(k % 2 == 0, "user").otherwise("assistant"), F.concat(F.lit("role at "), k.cast("string"))),
            F.when(is_blank(m["content"]), F.concat(F.lit("content at "), k.cast("string"))),
        )),
    )
    return (
        F.when(messages.isNull(), F.array(F.lit("no messages")))
        .when(n < 2, F.array(F.lit("fewer than two")))
        .when(n % 2 == 1, F.array(F.lit("odd count")))
        .otherwise(F.flatten(each))
    )


def exploded(df: DataFrame, *keys: str, messages: str = "messages") -> DataFrame:
    """(keys, pos, role, content): one row per message, from 0."""
    flat = df.select(*keys, F.posexplode(messages).alias("pos", "m"))
    return flat.select(*keys, F.col("pos").cast("long").alias("pos"), F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def rendered(messages: Column) -> Column:
    """role: content, one line per message."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")


def prompt_completions(df: DataFrame, *keys: str, messages: str = "messages") -> DataFrame:
    """(keys, pos, prompt, completion): one row per assistant turn, with all messages before it, rendered."""
    flat = df.select(*keys, F.col(messages).alias("__m"), F.posexplode(messages).alias("pos", "m")).filter("m.role = 'assistant'")
    before = F.slice(F.col("__m"), F.lit(1), F.col("pos"))
    return flat.select(*keys, F.col("pos").cast("long").alias("pos"), rendered(before).alias("prompt"), F.col("m.content").alias("completion"))


def last_messages(messages: Column, keep: int) -> Column:
    """The last `keep` messages, without an assistant's at their start."""
    n = F.size(messages)
    cut = F.slice(messages, F.greatest(F.lit(1), n - (keep - 1)), F.lit(keep))
    return F.when(F.get(cut, F.lit(0)).getField("role") == "assistant", F.slice(cut, F.lit(2), F.lit(keep))).otherwise(cut)


def last_turns(messages: Column, turns: int) -> Column:
    """The first message and the last 2 * turns of the others."""
    n = F.size(messages)
    return F.concat(F.slice(messages, 1, 1), F.slice(messages, F.greatest(F.lit(2), n - 2 * turns + 1), F.lit(2 * turns)))


def repeated_roles(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of exploded messages whose role is that of the message before."""
    w = Window.partitionBy(*keys).orderBy("pos")
    return rows.withColumn("previous", F.lag("role").over(w)).filter(F.col("role") == F.col("previous"))


def running_length(rows: DataFrame, *keys: str, cap: int = TOTAL_CAP, message_cap: int = MESSAGE_CAP) -> DataFrame:
    """Exploded messages with chars, running (characters so far) and over (a cap is passed)."""
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    chars = F.coalesce(F.length("content"), F.lit(0)).cast("long")
    out = rows.withColumn("chars", chars).withColumn("running", F.sum("chars").over(w))
    return out.withColumn("over", (F.col("running") > cap) | (F.col("chars") > message_cap))


def previous_user(rows: DataFrame, *keys: str) -> DataFrame:
    """Assistant messages with the last user message before them."""
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(w)
    return rows.withColumn("prompt", asked).filter("role = 'assistant'")
