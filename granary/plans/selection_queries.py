"""Queries of selections, set comparisons, parsing and shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import select as S
from granary.plans.conversation_queries import FLAT, ONE, messages, one_record
from granary.plans.evaluation_queries import KEY, LAST, latest_rows
from granary.session import table


def parsed_turns(spark, d):
    """Conversations written out as marked-up text, some with a label inside a line, and read back as turns."""
    lines = messages(spark, d).filter("role in ('user', 'assistant')").select("id", "pos", F.concat(F.upper("role"), F.lit(":\n"), F.coalesce("content", F.lit("")), F.when(F.col("pos") % 3 == 0, F.lit("\nUSER: is a label only alone")).otherwise("")).alias("line"))
    text = lines.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    turn = F.posexplode(T.turns(F.col("text"))).alias("turn", "m")
    return text.select("id", turn).select("id", F.col("turn").cast("long").alias("turn"), F.col("m.role").alias("role"), F.col("m.content").alias("content"))


PARSED_TURNS = rf"""
select id, row_number() over (partition by id order by pos) - 1 as turn, role, c as content from (
  select id, pos, role, regexp_replace(coalesce(content, '') || case when pos % 3 = 0 then chr(10) || 'USER: is a label only alone' else '' end, '^\s+|\s+$', '', 'g') as c from {FLAT} where role in ('user', 'assistant')) where c <> ''
"""


def selected_candidates(spark, d):
    rows = latest_rows(spark, d).filter("status = 'ok'").groupBy("candidate_id").agg(F.count("*").alias("n"))
    return S.pick(rows, ["cand-03", "cand-01", "cand-99"], "candidate_id", gate=False).select("candidate_id", F.col("place").cast("long").alias("place"), "n")


SELECTED = f"""
select l.candidate_id, p.place, count(*) as n from {LAST} l join (values ('cand-03', 0), ('cand-01', 1), ('cand-99', 2)) p(candidate_id, place) on p.candidate_id = l.candidate_id where status = 'ok' group by 1, 2
"""


def prefix_exclusion(spark, d):
    rows = S.without_prefixes(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", ["ECO", "SM"], gate=False)
    return rows.groupBy("p_type").agg(F.count("*").alias("n"))


PREFIXES = "select p_type, count(*) as n from part where not starts_with(p_type, 'ECO') and not starts_with(p_type, 'SM') group by 1"


def split_count_mismatch(spark, d):
    """Counts of records by split against those that hold messages: what a manifest check would report."""
    one = one_record(spark, d).withColumn("split", F.coalesce(F.lower(T.strip(F.col("split"))), F.lit("none")))
    have, filled = one.groupBy("split").agg(F.count("*").alias("n")), one.filter("messages is not null").groupBy("split").agg(F.count("*").alias("n"))
    return S.expected_against_actual(have, filled, "split", "n")


SPLIT_MISMATCH = f"""
select split, e as expected, a as actual from (select coalesce(lower(trim(split)), 'none') as split, count(*) as e, nullif(sum(case when messages is not null then 1 else 0 end), 0) as a from {ONE} where rn = 1 group by 1) where e is distinct from a
"""


def first_tasks_per_category(spark, d):
    rows = table(spark, d, "tutor_tasks").filter("split = 'benchmark-only'").select("id", "category", "prompt")
    return S.take_first(rows, 10, "id").select("id", "category")


FIRST_TASKS = "select id, category from tutor_tasks where split = 'benchmark-only' order by id limit 10"


def review_focus_values(spark, d):
    rows = table(spark, d, "tutor_tasks").select("category", F.explode(S.listed(F.col("review_focus"))).alias("focus"))
    return rows.groupBy("focus").agg(F.count("*").alias("n"), F.count_distinct("category").alias("categories"))


FOCUS = "select f as focus, count(*) as n, count(distinct category) as categories from (select category, trim(unnest(string_split(review_focus, ','))) as f from tutor_tasks) where f <> '' group by 1"


def record_tags(spark, d):
    """Tags such as source:x and type:y of each source, taken apart again."""
    rows = one_record(spark, d).select("source", F.explode(F.array(F.concat(F.lit("type:"), "task_type"), F.concat(F.lit("family:"), "task_family"))).alias("tag"))
    tags = rows.filter("tag is not null").groupBy("source").agg(F.collect_set("tag").alias("tags"))
    return tags.select("source", F.array_join(S.tagged_values(F.col("tags"), "type:"), ",").alias("types"), F.size(S.tagged_values(F.col("tags"), "family:")).cast("long").alias("families"))


RECORD_TAGS = f"select source, string_agg(distinct task_type, ',' order by task_type) as types, count(distinct task_family) as families from {ONE} where rn = 1 group by 1"


def kept_metrics(spark, d):
    m = F.create_map(F.lit("tokens"), F.col("output_tokens").cast("double"), F.lit("seconds"), F.col("latency_seconds"), F.lit("memory"), F.col("peak_unified_memory_gb"))
    return latest_rows(spark, d).select(*KEY, F.array_join(F.array_sort(F.map_keys(S.kept_metrics(m, ["tokens", "memory"]))), ",").alias("metrics"))


KEPT = f"select run_id, candidate_id, task_id, concat_ws(',', case when peak_unified_memory_gb is not null then 'memory' end, case when output_tokens is not null then 'tokens' end) as metrics from {LAST}"


def id_parts(spark, d):
    n = F.regexp_extract("id", r"(\d+)$", 1)
    rows = one_record(spark, d).select("id", n.cast("long").alias("number"), T.batch_code(F.concat(F.lit("batch-"), F.pmod(n.cast("long"), F.lit(1000)).cast("string"))).alias("batch"))
    return rows.withColumn("revision", T.is_revision(F.sha1("id")))


ID_PARTS = f"select id, n as number, 'b' || lpad(cast(n % 1000 as varchar), 3, '0') as batch, true as revision from (select id, cast(regexp_extract(id, '(\\d+)$', 1) as bigint) as n from {ONE} where rn = 1)"


def json_kinds(spark, d):
    """Types of the fields of the critics' JSON, as the variants have them; null for a missing field."""
    doc = F.try_parse_json(F.regexp_extract("output_text", r"(?s)\{.*\}", 0))
    rows = table(spark, d, "critic_responses").select(doc.alias("doc")).filter("doc is not null")
    kind = lambda p: F.schema_of_variant(F.try_variant_get("doc", p, "variant"))
    return rows.groupBy(kind("$.recommendation").alias("recommendation"), F.substring_index(kind("$.scores"), "<", 1).alias("scores"), F.substring_index(kind("$.revised_messages"), "<", 1).alias("revised")).agg(F.count("*").alias("n"))


_KIND = "case json_type(doc, '$.{f}') when 'VARCHAR' then 'STRING' when 'OBJECT' then 'OBJECT' when 'ARRAY' then 'ARRAY' when 'UBIGINT' then 'BIGINT' when 'BIGINT' then 'BIGINT' when 'NULL' then 'VOID' when 'BOOLEAN' then 'BOOLEAN' else json_type(doc, '$.{f}') end"
JSON_KINDS = f"select {_KIND.format(f='recommendation')} as recommendation, {_KIND.format(f='scores')} as scores, {_KIND.format(f='revised_messages')} as revised, count(*) as n from (select case when json_valid(t) then t end as doc from (select regexp_extract(output_text, '(?s)\\{{.*\\}}', 0) as t from critic_responses)) where doc is not null group by 1, 2, 3"


def truncated_notes(spark, d):
    return table(spark, d, "review_rows").select("id", "reviewed_at", F.substring(T.one_line(F.col("reviewer_notes")), 1, 12).alias("note"), T.iso_utc(F.col("reviewed_at")).alias("at"))


TRUNCATED = "select id, reviewed_at, substr(replace(replace(reviewer_notes, chr(13) || chr(10), '\\n'), chr(10), '\\n'), 1, 12) as note, strftime(reviewed_at, '%Y-%m-%dT%H:%M:%SZ') as at from review_rows"


def request_shape(spark, d):
    rows = table(spark, d, "chat_requests").groupBy(F.coalesce("mode", F.lit("none")).alias("mode"), F.coalesce("level", F.lit("none")).alias("level"))
    return rows.agg(F.count_distinct("request_id").alias("requests"), F.sum(F.when(F.get("messages", F.size("messages") - 1).getField("role") != "user", 1).otherwise(0)).alias("not_asking"))


REQUEST_SHAPE = "select coalesce(mode, 'none') as mode, coalesce(level, 'none') as level, count(distinct request_id) as requests, cast(sum(case when messages[len(messages)].role <> 'user' then 1 else 0 end) as bigint) as not_asking from chat_requests group by 1, 2"

QUERIES = {
    "parsed_turns": parsed_turns, "selected_candidates": selected_candidates, "prefix_exclusion": prefix_exclusion, "split_count_mismatch": split_count_mismatch,
    "first_tasks": first_tasks_per_category, "review_focus_values": review_focus_values, "record_tags": record_tags, "kept_metrics": kept_metrics,
    "id_parts": id_parts, "json_field_kinds": json_kinds, "truncated_notes": truncated_notes, "request_shape": request_shape,
}
ORACLES = {
    "parsed_turns": PARSED_TURNS, "selected_candidates": SELECTED, "prefix_exclusion": PREFIXES, "split_count_mismatch": SPLIT_MISMATCH,
    "first_tasks": FIRST_TASKS, "review_focus_values": FOCUS, "record_tags": RECORD_TAGS, "kept_metrics": KEPT, "id_parts": ID_PARTS,
    "json_field_kinds": JSON_KINDS, "truncated_notes": TRUNCATED, "request_shape": REQUEST_SHAPE,
}
