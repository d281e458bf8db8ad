"""Rows built from rows by kind: a registry of builders, each of which makes none, one or many rows of one row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.keyed import GateError


def built(df: DataFrame, kind: str, builders: dict[str, Callable[[DataFrame], DataFrame]], gate: bool = True) -> DataFrame:
    """What the builder of each row's kind makes of it; with gate a kind without a builder is an error.

    Builders are plans over all rows of their kind and must give the same columns. Null kinds are built by none.
    """
    if gate:
        unknown = df.filter(F.col(kind).isNotNull() & ~F.col(kind).isin(*builders)).select(kind).distinct().limit(5).collect()
        if unknown:
            raise GateError(f"no builder for {', '.join(r[0] for r in unknown)}")
    return reduce(DataFrame.unionByName, [build(df.filter(F.col(kind) == name)) for name, build in builders.items()])


def with_defaults(df: DataFrame, defaults: dict[str, object], extra: dict[str, object] | None = None) -> DataFrame:
    """The rows with default values where a field is null or not there; what extra says takes the place of both."""
    extra = extra or {}
    columns = {c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items() if c not in extra}
    return df.withColumns(columns | {c: F.lit(v) for c, v in extra.items()})
