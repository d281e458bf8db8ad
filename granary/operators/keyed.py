"""Joins and look-ups by key behind integrity gates, and first or last row by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.session import written


class GateError(ValueError):
    """A check of keys failed; the message shows a few of the keys."""


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of the keys that occur more than once or are missing."""
    missing = F.col(keys[0]).isNull()
    for k in keys[1:]:
        missing = missing | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | missing)


def key_mismatch(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of the keys that only one side has."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    both = a.join(b, key, "full_outer")
    return both.filter(F.col("l").isNull() | F.col("r").isNull()).select(key, F.when(F.col("r").isNull(), "left only").otherwise("right only").alias("side"))


def unmatched(df: DataFrame, other: DataFrame, on: Column | str | list[str]) -> DataFrame:
    """Rows of df that no row of other matches."""
    return df.join(other, on, "left_anti")


def gate(bad: DataFrame, what: str, show: int = 5) -> None:
    """Raise if the frame of offending rows has any; the message shows at most a few of them."""
    rows = bad.limit(show).collect()
    if rows:
        raise GateError(f"{what}: " + ", ".join(str(tuple(r)) for r in rows))


def first_by(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """The first (or last) row of each key by an aggregate that is combined before its shuffle; null orders sort first."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("__row")).select(*keys, *[F.col("__row").getField(c).alias(c) for c in rest])


#: Keys up to which a written table of repeated keys is broadcast.
SMALL = 300_000


def first_delivery(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """As first_by, where few keys are repeated: those are found by the key alone, and only their rows move."""
    again = written(df.groupBy(key).agg(F.count("*").alias("__n")).filter("__n > 1").select(key))
    again = F.broadcast(again) if again.count() <= SMALL else again
    return df.join(again, key, "left_anti").unionByName(first_by(df.join(again, key, "left_semi"), [key], order).select(df.columns))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: an append log read as a table of its latest state."""
    return first_by(df, keys, order, last=True)


def keep_first(df: DataFrame, content: Column, key: str) -> DataFrame:
    """Each row with duplicate_of: the smallest key with the same content, null for that row itself and null content.

    Only contents that several rows have are joined back, by a broadcast where they are few; rows without content take
    no part in the join, so that they meet in no task.
    """
    tagged = df.withColumn("__c", content)
    held = tagged.filter(F.col("__c").isNotNull())
    several = written(held.groupBy("__c").agg(F.min(key).alias("__first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n"))
    several = F.broadcast(several) if several.count() <= SMALL else several
    found = held.join(several, "__c", "left").withColumn("duplicate_of", F.when(F.col(key) != F.col("__first"), F.col("__first"))).drop("__first")
    out = found.unionByName(tagged.filter(F.col("__c").isNull()).withColumn("duplicate_of", F.lit(None).cast(df.schema[key].dataType)))
    return out.drop("__c")
