"""Line-based sources with line numbers: JSONL, TSV, Markdown tables, prompt files, JSON specs and file inventories."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.text import is_blank, strip


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, value) of every line, numbered from 1 in its file, also where a file is read in several splits.

    A line's number is its place in its split plus the lines of the splits before it; one number per split is joined
    back, so the whole is never sorted in one task.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return raw.join(offsets, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("line_no"), "value")


def read_jsonl(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (file, line_no, doc as a variant) and rejects (file, line_no, error, value); blank lines are skipped.

    A line must be a JSON object; of repeated keys the last counts (spark.sql.variant.allowDuplicateKeys). A missing key
    and a null value stay apart in the variant.
    """
    rows = lines(spark, path).filter(~is_blank(F.col("value"))).withColumn("doc", F.try_parse_json("value"))
    kind = F.schema_of_variant("doc")
    error = F.when(F.col("doc").isNull(), "no JSON").when(~kind.startswith("OBJECT"), "no object")
    tagged = rows.withColumn("error", error)
    return tagged.filter("error is null").select("file", "line_no", "doc"), tagged.filter("error is not null").select("file", "line_no", "error", "value")


def read_tsv(spark: SparkSession, path: str | list[str], required: list[str], filled: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of a TSV with a header, cells stripped, and rejects that lack a value in one of the filled columns.

    A header without one of the required columns is an error. Cells stay strings.
    """
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    if missing := [c for c in required if c not in raw.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rows = raw.select(*[strip(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    bad = F.lit(False)
    for c in filled or []:
        bad = bad | (F.coalesce(F.col(c), F.lit("")) == "")
    return rows.filter(~bad), rows.filter(bad)


def read_markdown_table(spark: SparkSession, path: str, header: list[str], names: list[str], first: str = "") -> DataFrame:
    """(file, line_no, names) of the rows of a Markdown table with exactly the given header; rules and other lines drop.

    With first, only rows whose first cell starts with it are read, as task ids start with T.
    """
    rows = lines(spark, path).filter(F.ltrim("value").startswith("|"))
    inner = F.regexp_replace(strip(F.col("value")), r"^\||\|$", "")
    cells = F.transform(F.split(inner, r"\|"), strip)
    rows = rows.withColumn("cells", cells).filter(F.size("cells") == len(header))
    rows = rows.filter(~F.forall("cells", lambda c: c.rlike("^:?-*:?$")))
    if rows.filter(F.col("cells") == F.array(*[F.lit(h) for h in header])).isEmpty():
        raise ValueError("the table has no such header")
    rows = rows.filter((F.col("cells") != F.array(*[F.lit(h) for h in header])) & F.get("cells", F.lit(0)).startswith(first))
    return rows.select("file", "line_no", *[F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)])


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, prompt) of a plain prompt file, or of the first user turn of each line of a JSONL file."""
    if path.endswith(".jsonl"):
        rows, _ = read_jsonl(spark, path)
        messages = F.from_json(F.try_variant_get("doc", "$.messages", "string"), "array<struct<role:string,content:string>>")
        first = F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0)).getField("content")
        rows = rows.select("file", "line_no", strip(first).alias("prompt"))
    else:
        rows = lines(spark, path).select("file", "line_no", strip(F.col("value")).alias("prompt"))
    return rows.filter(F.coalesce("prompt", F.lit("")) != "")


def read_specs(spark: SparkSession, path: str, field: str, schema: str, required: list[str] | None = None, counts: list[str] | None = None) -> DataFrame:
    """One row per entry of an array field of a JSON document.

    An entry without a required value, or with a count that is neither null nor positive, is an error.
    """
    doc = spark.read.option("multiLine", True).schema(f"{field} array<struct<{schema}>>").json(path)
    rows = doc.select(F.explode(field).alias("e")).select("e.*")
    checks = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", f"no {c}") for c in required or []] + [F.when(F.col(c) <= 0, f"{c} is not positive") for c in counts or []]
    if checks and (bad := rows.withColumn("why", F.concat_ws(", ", *checks)).filter("why <> ''").limit(5).collect()):
        raise ValueError("; ".join(r["why"] for r in bad))
    return rows


def read_profile(spark: SparkSession, path: str, kinds: int | None = None) -> dict:
    """A generation profile, one small YAML or JSON document: target_total must be the sum of target_counts, of which there are `kinds`.

    YAML needs the yaml package, which is looked for only then.
    """
    said = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml package") from e
        profile = yaml.safe_load(said)
    else:
        profile = json.loads(said)
    targets = profile.get("target_counts") if isinstance(profile, dict) else None
    if not isinstance(targets, dict) or not all(isinstance(n, int) and n > 0 for n in targets.values()):
        raise ValueError("target_counts must map kinds to positive counts")
    if kinds is not None and len(targets) != kinds:
        raise ValueError(f"target_counts has {len(targets)} kinds, not {kinds}")
    if sum(targets.values()) != profile.get("target_total"):
        raise ValueError("target_total is not the sum of target_counts")
    return profile


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256, rows) of the files below a folder; rows counts the filled lines of JSONL files only.

    Bytes are hashed a file at a time, in whole files of up to 2 GB; lines are counted by a split text scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    known = files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    text = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("at"), "value")
    counted = text.filter(F.col("at").endswith(".jsonl") & ~is_blank(F.col("value"))).groupBy("at").agg(F.count("*").alias("n"))
    # the two readers spell the same place with one slash after the scheme and with three
    place = lambda c: F.regexp_replace(c, "^file:/+", "/")
    both = known.withColumn("p", place(F.col("file"))).join(counted.select(place(F.url_decode("at")).alias("p"), "n"), "p", "left").drop("p")
    return both.select("file", "bytes", "sha256", F.when(F.col("file").endswith(".jsonl"), F.coalesce("n", F.lit(0))).alias("rows"))
