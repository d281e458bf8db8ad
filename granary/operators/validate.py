"""Checks of rows as columns of errors: presence, types and values of fields, on variants so that null and missing differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import is_blank


def missing_fields(doc: Column, required: list[str]) -> Column:
    """array<string>: the required keys that an object does not have; a key with a null value is there."""
    have = F.json_object_keys(F.to_json(doc))
    return F.array_except(F.array(*[F.lit(r) for r in required]), F.coalesce(have, F.array().cast("array<string>")))


def kind_of(doc: Column, field: str) -> Column:
    """The type of a field: STRING, BIGINT, VOID and so on; null where the key is missing."""
    return F.schema_of_variant(F.try_variant_get(doc, f"$.{field}", "variant"))


def field_error(doc: Column, field: str, allowed: list[str] | None = None) -> Column:
    """Why a field is no filled string, or not one of the allowed; null for a sound or missing one."""
    kind, value = kind_of(doc, field), F.try_variant_get(doc, f"$.{field}", "string")
    out = F.when(kind.isNull(), F.lit(None).cast("string")).when(kind != "STRING", f"{field} is no string").when(is_blank(value), f"{field} is blank")
    if allowed:
        out = out.when(~value.isin(*allowed), f"{field} is not one of {', '.join(sorted(allowed))}")
    return out


def checked(df: DataFrame, doc: str, required: list[str], allowed: dict[str, list[str]] | None = None, key: str | None = None) -> DataFrame:
    """The rows with errors (array<string>): missing keys first, then each field in turn, then a repeated key.

    A key is repeated where an earlier line (file, line_no) has it; the first keeps it.
    """
    from pyspark.sql.window import Window

    d = F.col(doc)
    names = F.transform(missing_fields(d, required), lambda n: F.concat(F.lit("missing "), n))
    fields = [field_error(d, f, (allowed or {}).get(f)) for f in required]
    errors = F.concat(names, F.array_compact(F.array(*fields)))
    out = df.withColumn("errors", errors)
    if key:
        out = out.withColumn("__key", F.try_variant_get(d, f"$.{key}", "string"))
        again = F.row_number().over(Window.partitionBy("__key").orderBy("file", "line_no")) > 1
        out = out.withColumn("errors", F.when(F.col("__key").isNotNull() & again, F.concat("errors", F.array(F.lit(f"repeated {key}")))).otherwise(F.col("errors"))).drop("__key")
    return out
