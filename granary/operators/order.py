"""Positions in a whole ordered table without a task that sorts it all: ordinals, shards, shuffles and ordered fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.session import written


def with_ordinal(df: DataFrame, *order: Column | str, name: str = "ordinal") -> DataFrame:
    """Each row with its place, from 0, in the order of the given expressions, which should tell all rows apart.

    Rows are range-partitioned and sorted in their partitions; the partitions' sizes, one number each, give the offsets.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    kept = written(ranged)
    counts = kept.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count("*").alias("__n")).orderBy("__part").collect()
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    base = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part long, __base long")) if offsets else None
    if base is None:
        return kept.withColumn(name, F.lit(0).cast("long")).drop("__at")
    place = (F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__base")).cast("long")
    return kept.withColumn("__part", F.shiftright("__at", 33)).join(base, "__part").withColumn(name, place).drop("__at", "__part", "__base")


def first_share(df: DataFrame, share: float, *order: Column | str, name: str = "split", inside: str = "train", outside: str = "validation") -> DataFrame:
    """The first int(n * share) rows of the order on one side, the others on the other."""
    placed = with_ordinal(df, *order)
    quota = int(placed.count() * share)
    return placed.withColumn(name, F.when(F.col("ordinal") < quota, inside).otherwise(outside))


def round_robin(df: DataFrame, shards: int, *order: Column | str) -> DataFrame:
    """Row k of the order in shard k modulo the number of shards."""
    return with_ordinal(df, *order).withColumn("shard", F.pmod("ordinal", F.lit(shards)))


def salted_order(key: Column, seed: str) -> Column:
    """A value whose order is a seeded shuffle of the keys."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def ordered_fill(groups: DataFrame, share: float, seed: str, key: str = "group_id", size: str = "n", most_rounds: int = 2_000) -> DataFrame:
    """Each group with split train or validation: in salted order a group goes to train if it fits what is left of the quota.

    A group too large is passed over and later, smaller ones may still fit. Each round takes all groups up to the first
    that does not fit; it is found by totals of 4096 hash ranges and a running total inside one of them, so neither a
    task nor the driver holds all groups. A round's groups are one range of the order, so the result is a few conditions.
    A fill that does not end in most_rounds rounds is an error, never a partial result.
    """
    g = written(groups.withColumn("__h", salted_order(F.col(key), seed)).withColumn("__bucket", F.substring("__h", 1, 3)))
    left = int((g.agg(F.sum(size)).head()[0] or 0) * share)
    after, taken = "", []
    for _ in range(most_rounds):
        rest = g.filter((F.col("__h") > after) & (F.col(size) <= left))
        totals = rest.groupBy("__bucket").agg(F.sum(size).alias("s")).orderBy("__bucket").collect()
        if not totals:
            break
        sum_, stop = 0, None
        for b, s in totals:
            if sum_ + s > left:
                stop = b
                break
            sum_ += s
        if stop is None:
            taken.append((after, "~", left))
            break
        running = rest.filter(F.col("__bucket") == stop).withColumn("r", F.sum(size).over(Window.partitionBy("__bucket").orderBy("__h")))
        over = running.filter(F.col("r") > left - sum_).agg(F.min("__h")).head()[0]
        inside = running.filter(F.col("__h") < over).agg(F.coalesce(F.sum(size), F.lit(0))).head()[0]
        taken.append((after, over, left))
        left -= sum_ + inside
        after = over
    else:
        raise RuntimeError(f"the fill did not end in {most_rounds} rounds")
    chosen = F.lit(False)
    for lo, hi, cap in taken:
        chosen = chosen | ((F.col("__h") > lo) & (F.col("__h") < hi) & (F.col(size) <= cap))
    return g.withColumn("split", F.when(chosen, "train").otherwise("validation")).drop("__h", "__bucket")
