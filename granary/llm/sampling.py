"""Bounded training samples that are the same for the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

_RANGE = 1 << 31


def bounded_sample(rows: DataFrame, table_rows: int, n: int) -> list[Row]:
    """The n rows that come first in the order of a hash of their content; repeated rows count once.

    Only rows whose hash falls into a share of its range that should hold 4 * n rows are sorted, judged by the number of
    rows of the table they come from: so at most a small multiple of n rows moves, however large the table is.
    """
    share = min(1.0, 4.0 * n / max(1, table_rows))
    h = F.pmod(F.xxhash64(*rows.columns), F.lit(_RANGE))
    kept = rows.withColumn("__h", h).filter(F.col("__h") < int(share * _RANGE))
    return kept.distinct().orderBy("__h", *rows.columns).limit(n).drop("__h").collect()
