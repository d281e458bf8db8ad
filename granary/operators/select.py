"""Selections by lists and prefixes, set comparisons, expected against actual, and small shaping helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.keyed import GateError


def requested(spark: SparkSession, ids: list[str], name: str = "id") -> DataFrame:
    """(name, place) of a request list, in its order; a repeated id is an error."""
    if len(set(ids)) != len(ids):
        raise GateError(f"repeated: {', '.join(sorted({i for i in ids if ids.count(i) > 1}))}")
    return spark.createDataFrame(list(zip(ids, range(len(ids)))), f"{name} string, place int")


def pick(df: DataFrame, ids: list[str], key: str = "id", gate: bool = True) -> DataFrame:
    """The rows of the requested keys with their place in the request; with gate an unknown key is an error."""
    wanted = requested(df.sparkSession, ids, key)
    if gate and (bad := [r[0] for r in wanted.join(df.select(key), key, "left_anti").limit(5).collect()]):
        raise GateError(f"unknown: {', '.join(bad)}")
    return df.join(F.broadcast(wanted), key)


def without_prefixes(df: DataFrame, key: str, prefixes: list[str], gate: bool = True) -> DataFrame:
    """The rows whose key starts with none of the prefixes; with gate a prefix that matches nothing is an error."""
    hits = [F.col(key).startswith(p) for p in prefixes]
    if gate and prefixes:
        met = df.agg(*[F.max(h.cast("int")).alias(f"p{k}") for k, h in enumerate(hits)]).head()
        if bad := [p for k, p in enumerate(prefixes) if not met[k]]:
            raise GateError(f"prefixes without a match: {', '.join(bad)}")
    out = df
    for h in hits:
        out = out.filter(~F.coalesce(h, F.lit(False)))
    return out


def same_set(left: DataFrame, right: DataFrame) -> bool:
    """Whether two frames of the same columns hold the same rows, repetition aside."""
    return left.subtract(right).isEmpty() and right.subtract(left).isEmpty()


def expected_against_actual(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """(key, expected, actual) of the keys whose values differ or that one side lacks."""
    e, a = expected.select(key, F.col(value).alias("expected")), actual.select(key, F.col(value).alias("actual"))
    return e.join(a, key, "full_outer").filter(~F.col("expected").eqNullSafe(F.col("actual")))


def take_first(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of the order; fewer are an error."""
    out = df.orderBy(*order).limit(n)
    if (have := out.count()) < n:
        raise GateError(f"{have} rows where {n} were asked for")
    return out


def listed(c: Column, sep: str = r"\s*,\s*") -> Column:
    """A list of a value that is one string or several in one: blank parts drop; null is an empty list."""
    return F.filter(F.split(F.coalesce(F.trim(c), F.lit("")), sep), lambda x: x != "")


def tagged_values(tags: Column, prefix: str) -> Column:
    """Sorted distinct values of the tags with a prefix such as license: , without it."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(tags, lambda t: t.startswith(prefix)), lambda t: F.substr(t, F.lit(len(prefix) + 1)))))


def kept_metrics(metrics: Column, names: list[str]) -> Column:
    """A map of metrics cut to the named ones that are there."""
    return F.map_filter(metrics, lambda k, v: k.isin(*names) & v.isNotNull())
