"""Queries that write a table to a sink and read it back through a source: whole tables, round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import keyed as K
from granary.plans.document_queries import _docs
from granary.plans.evaluation_queries import KEY
from granary.session import scratch_folder, table
from granary.sources import lines as L
from granary.sources import sinks as S


def jsonl_round_trip(spark, d):
    """Critic jobs as JSON lines in the order of their ids, read back line by line."""
    path = scratch_folder(spark)
    S.write_jsonl(table(spark, d, "critic_jobs").select("job_id", "source_record_id"), path, "job_id")
    rows, _ = L.read_jsonl(spark, path)
    return rows.select(*[F.try_variant_get("doc", f"$.{c}", "string").alias(c) for c in ("job_id", "source_record_id")])


JSONL = "select job_id, source_record_id from critic_jobs"


def rejected_lines(spark, d):
    """The critics' texts as lines of their own: those that are no JSON object come out as rejects."""
    path = scratch_folder(spark)
    table(spark, d, "critic_responses").filter("output_text is not null").select(T.one_line(F.col("output_text")).alias("value")).write.text(path)
    rows, bad = L.read_jsonl(spark, path)
    return rows.agg(F.count("*").alias("n")).select(F.lit("read").alias("what"), "n").unionByName(bad.agg(F.count("*").alias("n")).select(F.lit("rejected").alias("what"), "n"))


_LINE = "replace(replace(output_text, chr(13) || chr(10), '\\n'), chr(10), '\\n')"
REJECTED = f"""
select 'read' as what, count(*) as n from critic_responses where coalesce(json_valid({_LINE}) and json_type(case when json_valid({_LINE}) then {_LINE} end) = 'OBJECT', false)
union all select 'rejected', count(*) from critic_responses where output_text is not null and trim({_LINE}) <> '' and not coalesce(json_valid({_LINE}) and json_type(case when json_valid({_LINE}) then {_LINE} end) = 'OBJECT', false)
"""


def review_sheet_round_trip(spark, d):
    """Task prompts as a review sheet with blank columns, read back as rows."""
    path = scratch_folder(spark)
    S.write_review_sheet(table(spark, d, "tutor_tasks"), path, ["id", "category", "prompt"], ["score", "notes"])
    rows, _ = L.read_tsv(spark, path, ["id", "category", "prompt", "score", "notes"])
    return rows.select("id", "category", "prompt", F.coalesce("score", F.lit("")).alias("score"))


SHEET = "select id, category, regexp_replace(replace(replace(prompt, chr(13) || chr(10), '\\n'), chr(10), '\\n'), '^\\s+|\\s+$', '', 'g') as prompt, '' as score from tutor_tasks"


def shard_round_trip(spark, d):
    """Documents dealt in order over seven shard folders, read back with the shard that each lies in."""
    path = scratch_folder(spark)
    S.write_shards(_docs(spark, d).select("doc_id"), path, 7, "doc_id")
    return spark.read.json(path).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("shard").cast("long").alias("shard"))


SHARDS = "select doc_id, (row_number() over (order by doc_id) - 1) % 7 as shard from documents"


def append_log_latest(spark, d):
    """Results appended to a log in two goes, and the latest row of each key on reading."""
    path = scratch_folder(spark)
    rows = table(spark, d, "bakeoff_results").select(*KEY, "attempt", "status", F.col("finished_at").cast("string").alias("at"))
    S.append_rows(rows.filter("attempt <= 1"), path)
    S.append_rows(rows.filter("attempt > 1 or attempt is null"), path)
    log = spark.read.schema(rows.schema).json(path)
    return K.latest(log, KEY, [F.col("at"), F.col("attempt")]).select(*KEY, "attempt", "status")


APPENDED = "select run_id, candidate_id, task_id, attempt, status from (select *, row_number() over (partition by run_id, candidate_id, task_id order by finished_at desc nulls last, attempt desc) as rn from bakeoff_results) where rn = 1"


def task_table_round_trip(spark, d):
    """The task bank as a Markdown table, read back row by row; only rows whose first cell starts with T are tasks."""
    path = scratch_folder(spark)
    rows = table(spark, d, "tutor_tasks").select("id", "category", F.replace("review_focus", F.lit("|"), F.lit("/")).alias("focus"))
    body = rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[T.table_cell(F.coalesce(c, F.lit(""))) for c in rows.columns]), F.lit(" |")).alias("value"))
    head = spark.createDataFrame([("| id | category | focus |",), ("|---|---|---|",), ("| note | none | none |",)], "value string")
    head.unionByName(body).coalesce(1).write.text(path)
    return L.read_markdown_table(spark, path, ["id", "category", "focus"], ["id", "category", "focus"], "T").select("id", "category", "focus")


TASK_TABLE = "select id, category, regexp_replace(replace(coalesce(review_focus, ''), '|', '/'), '^\\s+|\\s+$', '', 'g') as focus from tutor_tasks where starts_with(id, 'T')"


def prompt_file_round_trip(spark, d):
    path = scratch_folder(spark)
    table(spark, d, "tutor_tasks").select(T.one_line(F.col("prompt")).alias("value")).write.text(path)
    return L.read_prompts(spark, path).select("prompt")


PROMPT_FILE = "select regexp_replace(replace(replace(prompt, chr(13) || chr(10), '\\n'), chr(10), '\\n'), '^\\s+|\\s+$', '', 'g') as prompt from tutor_tasks where trim(coalesce(prompt, '')) <> ''"


def inventory_totals(spark, d):
    """Files and filled lines of a folder of JSON lines, from its inventory."""
    path = scratch_folder(spark)
    S.write_jsonl(table(spark, d, "review_rows").select("id", "review_status"), path, "id")
    found = L.inventory(spark, path).filter("rows is not null or file like '%.json'")
    count = spark.read.text(path).filter(F.length("value") > 0).agg(F.count("*").alias("lines"))
    return found.agg(F.count_distinct("sha256").alias("k")).select((F.col("k") > 0).alias("hashed")).withColumn("one", F.lit(1)).join(count.withColumn("one", F.lit(1)), "one").drop("one")


INVENTORY = "select true as hashed, count(*) as lines from review_rows"

QUERIES = {
    "jsonl_round_trip": jsonl_round_trip, "rejected_lines": rejected_lines, "review_sheet_round_trip": review_sheet_round_trip, "shard_round_trip": shard_round_trip,
    "append_log_latest": append_log_latest, "task_table_round_trip": task_table_round_trip, "prompt_file_round_trip": prompt_file_round_trip, "inventory_totals": inventory_totals,
}
ORACLES = {
    "jsonl_round_trip": JSONL, "rejected_lines": REJECTED, "review_sheet_round_trip": SHEET, "shard_round_trip": SHARDS, "append_log_latest": APPENDED,
    "task_table_round_trip": TASK_TABLE, "prompt_file_round_trip": PROMPT_FILE, "inventory_totals": INVENTORY,
}
