"""Sinks: ordered JSONL, review sheets and shards, append logs, guarded manifests and Markdown reports."""

from __future__ import annotations

import html
import json
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import html_escape, one_line, table_cell
from granary.operators.order import with_ordinal


class ManifestError(ValueError):
    """A manifest is there already and says something else."""


def write_jsonl(df: DataFrame, path: str, *order: Column | str) -> None:
    """JSON lines in the given order across the part files, each file a range of the order; nulls are written."""
    keys = order or [F.lit(0)]
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Rows added to an append log; the latest row of a key is found on reading."""
    df.write.mode("append").json(path)


def write_review_sheet(df: DataFrame, path: str, columns: list[str], blank: list[str]) -> None:
    """A TSV for reviewers: line breaks escaped, and blank columns to be filled in."""
    cells = [one_line(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns]
    df.select(*cells, *[F.lit("").alias(c) for c in blank]).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_shards(df: DataFrame, path: str, shards: int, *order: Column | str) -> None:
    """Rows dealt in order over shard folders; shards of an earlier run are replaced; one shard gives none."""
    if shards > 1:
        with_ordinal(df, *order).withColumn("shard", F.pmod("ordinal", F.lit(shards))).drop("ordinal").write.mode("overwrite").partitionBy("shard").json(path)


def write_blind_pack(pack: DataFrame, key: DataFrame, sheet_path: str, key_path: str) -> None:
    """A sheet that names no candidate, and apart from it the key from labels to candidates."""
    pack.write.mode("overwrite").option("header", True).option("escape", '"').csv(sheet_path)
    key.write.mode("overwrite").json(key_path)


def guard_manifest(spark: SparkSession, path: str, manifest: dict, fixed: list[str]) -> bool:
    """Write a manifest, or check that the one there agrees in the fixed fields; True where it was written now."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(where):
        old = json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))
        if bad := [k for k in fixed if old.get(k) != manifest.get(k)]:
            raise ManifestError(f"the manifest there differs in {', '.join(bad)}")
        return False
    out = fs.create(where, False)
    out.write(bytearray((json.dumps(manifest, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()))
    out.close()
    return True


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A report table of an aggregate, which is small by its nature; more than `most` rows are an error, none is left out."""
    rows = df.select(*[table_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in df.columns]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(r) + " |" for r in rows]) + "\n"


def report(title: str, sections: dict[str, DataFrame | str], most: int = 200) -> str:
    """A Markdown report: a title, and under each heading a text or the table of an aggregate."""
    parts = [f"# {title}"]
    for heading, body in sections.items():
        parts.append(f"## {heading}\n\n" + (body if isinstance(body, str) else markdown_table(body, most)).rstrip())
    return "\n\n".join(parts) + "\n"


def side_by_side(df: DataFrame, key: str, left: str, right: str, title: str, most: int = 2_000) -> str:
    """An HTML page of two texts for each key, all of it escaped; more than `most` rows are an error."""
    rows = df.select(*[html_escape(F.coalesce(F.col(c).cast("string"), F.lit("(missing)"))).alias(n) for c, n in ((key, "k"), (left, "l"), (right, "r"))]).orderBy("k").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a page of more than {most} rows")
    body = "".join(f"<tr><th>{r['k']}</th><td><pre>{r['l']}</pre></td><td><pre>{r['r']}</pre></td></tr>" for r in rows)
    name = html.escape(title)
    return f"<!doctype html><meta charset=utf-8><title>{name}</title><h1>{name}</h1><table><tr><th></th><th>{html.escape(left)}</th><th>{html.escape(right)}</th></tr>{body}</table>\n"


def write_archive(paths: dict[str, str], target: str) -> None:
    """A deflated archive on the driver of small local files by member name, in the order given and with one fixed time."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for name, path in paths.items():
            member = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            member.compress_type = zipfile.ZIP_DEFLATED
            with open(path, "rb") as f:
                out.writestr(member, f.read())


def batch_index(batches: DataFrame, key: str = "batch", shard: str = "shard") -> DataFrame:
    """(batch, rows, shards) of a table of rows with their batch and shard."""
    return batches.groupBy(key).agg(F.count("*").alias("rows"), F.count_distinct(shard).alias("shards"))


def stage_batches(batches: DataFrame, path: str, key: str = "batch", shard: str = "shard") -> str:
    """Rows written anew by batch and shard; returns the reviewers' instructions, which list each batch and its shards."""
    batches.write.mode("overwrite").partitionBy(key, shard).json(path)
    rows = batch_index(batches, key, shard).orderBy(key).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("instructions for more than 10000 batches")
    lines = [f"- `{key}={r[key]}`: {r['rows']} rows in {r['shards']} shards" for r in rows]
    return "# Batches to review\n\n" + "\n".join(lines) + "\n"
