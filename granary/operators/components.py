"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.session import durable

#: A node counts as hot from this many links; with the share below, at most 1 / HOT_SHARE nodes are hot.
HOT_LINKS = 10_000
HOT_SHARE = 0.001


def _with_group_value(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Each row with an aggregate of its group, without a task that holds a hot group.

    The aggregate is combined before its shuffle. Groups of more than max(HOT_LINKS, HOT_SHARE * rows) rows are
    at most 1 / HOT_SHARE many, so those come back by a broadcast of bounded size; the others by a shuffle join.
    """
    stats = durable(rows.groupBy(*keys).agg(value.alias(name), F.count("*").alias("__n")))
    total = stats.agg(F.coalesce(F.sum("__n"), F.lit(0))).head()[0]
    hot = stats.filter(F.col("__n") > max(HOT_LINKS, int(total * HOT_SHARE)))
    if hot.isEmpty():
        return rows.join(stats.drop("__n"), keys)
    cold = stats.filter(F.col("__n") <= max(HOT_LINKS, int(total * HOT_SHARE)))
    tagged = rows.join(F.broadcast(hot.drop("__n")), keys, "left")
    there = tagged.filter(F.col(name).isNotNull())
    rest = tagged.filter(F.col(name).isNull()).drop(name)
    return there.unionByName(rest.join(cold.drop("__n"), keys))


def star_edges(members: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """Edges (u, v), u > v, from each member of a key group to the smallest member of that group.

    A group of n members gives n - 1 edges, never all pairs. Members that are null link nothing.
    """
    rows = members.filter(F.col(node).isNotNull()).select(F.col(node).alias("u"), *keys).distinct()
    with_min = _with_group_value(rows, keys, F.min("u"), "v")
    return with_min.filter(F.col("u") > F.col("v")).select("u", "v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node of an edge table (u, v).

    Nodes may be of any ordered type. Null ends and self links are ignored; repeated and reversed links are one. An
    empty table gives no rows. Each round links every larger neighbour of a node to the smallest neighbour (large
    star), then the smaller ones (small star), and ends when a round changes nothing; rounds grow with the logarithm
    of the nodes. Hot nodes are joined through a broadcast of bounded size.
    """
    ends = edges.select(F.col("u"), F.col("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    current = durable(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _fingerprint(current)
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _with_group_value(both, ["u"], F.min("v"), "m").select("u", "v", F.least("u", "m").alias("m"))
        large = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = durable(large)
        low = _with_group_value(large, ["u"], F.min("v"), "m")
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        current = durable(small.filter("u <> v").distinct())
        now = _fingerprint(current)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
