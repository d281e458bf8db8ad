"""Queries over evaluation logs and task tables: latest attempts, summaries, flags, blind review packs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions import text as T
from granary.operators import keyed as K
from granary.operators import metrics as M
from granary.operators.order import salted_order
from granary.session import table

KEY = ["run_id", "candidate_id", "task_id"]
LAST = "(select * from (select *, row_number() over (partition by run_id, candidate_id, task_id order by finished_at desc nulls last, attempt desc) as rn from bakeoff_results) where rn = 1)"


def latest_rows(spark, d):
    return K.latest(table(spark, d, "bakeoff_results"), KEY, [F.col("finished_at"), F.col("attempt")])


def latest_attempt(spark, d):
    return latest_rows(spark, d).select(*KEY, "attempt", "status", "finish_reason", "output_tokens")


LATEST = f"select run_id, candidate_id, task_id, attempt, status, finish_reason, output_tokens from {LAST}"


def pending_tasks(spark, d):
    """Tasks of each run and candidate met in the log whose latest attempt did not succeed, or that were never tried.

    Counted from what was tried and the number of tasks, so the pairs of all runs and tasks are never made.
    """
    tasks = table(spark, d, "tutor_tasks").filter("split = 'benchmark-only'").select(F.col("id").alias("task_id"))
    total = tasks.count()
    last = latest_rows(spark, d).select(*KEY, "status")
    held = last.join(tasks.withColumn("held", F.lit(True)), "task_id", "left")
    tried = held.groupBy("run_id", "candidate_id").agg(
        F.sum((F.coalesce("held", F.lit(False)) & (F.col("status") == "ok")).cast("long")).alias("done"),
        F.sum((F.coalesce("held", F.lit(False)) & (F.col("status") != "ok")).cast("long")).alias("failed"),
    )
    return tried.select("run_id", "candidate_id", (F.lit(total) - F.col("done")).cast("long").alias("pending"), "failed").filter("pending > 0")


PENDING = f"""
select p.run_id, p.candidate_id, count(*) as pending, cast(sum(case when l.status is not null then 1 else 0 end) as bigint) as failed
from (select distinct run_id, candidate_id from bakeoff_results) p cross join (select id as task_id from tutor_tasks where split = 'benchmark-only') t
left join {LAST} l on l.run_id = p.run_id and l.candidate_id = p.candidate_id and l.task_id = t.task_id where coalesce(l.status, '') <> 'ok' group by 1, 2
"""


def run_summary(spark, d):
    return M.run_summary(latest_rows(spark, d), "run_id", "candidate_id")


RUN_SUMMARY = f"""
select run_id, candidate_id, count(*) as n_rows, count(distinct task_id) as tasks, cast(sum(case when status = 'ok' then 1 else 0 end) as bigint) as n_ok,
  cast(sum(case when status = 'error' then 1 else 0 end) as bigint) as n_error, cast(sum(case when status = 'ok' and finish_reason = 'length' then 1 else 0 end) as bigint) as cut,
  cast(sum(output_tokens) filter (status = 'ok') as bigint) as tokens, median(output_tokens) filter (status = 'ok') as median_tokens, min(output_tokens) filter (status = 'ok') as least_tokens,
  max(output_tokens) filter (status = 'ok') as most_tokens, round(sum(latency_seconds) filter (status = 'ok') / 60, 3) as minutes, median(latency_seconds) filter (status = 'ok') as median_latency,
  median(tokens_per_second) filter (status = 'ok') as median_speed, max(peak_unified_memory_gb) as peak_memory from {LAST} group by 1, 2
"""


def status_counts(spark, d):
    return latest_rows(spark, d).groupBy("run_id", "status", F.coalesce("finish_reason", F.lit("none")).alias("finish_reason")).agg(F.count("*").alias("n"))


STATUS = f"select run_id, status, coalesce(finish_reason, 'none') as finish_reason, count(*) as n from {LAST} group by 1, 2, 3"


def response_flags(spark, d):
    n, _ = M.control_tokens(F.col("response"))
    flags = F.concat_ws(",", F.when(F.col("status") == "error", "error"), F.when(F.col("finish_reason") == "length", "cut"), F.when(n > 0, "control"), F.when(F.col("output_tokens") >= 600, "long"))
    return latest_rows(spark, d).select(*KEY, flags.alias("flags")).filter("flags <> ''")


_CONTROL = "<[|]?(audio|image|video)[|]?>"
FLAGS = f"""
select * from (select run_id, candidate_id, task_id, concat_ws(',', case when status = 'error' then 'error' end, case when finish_reason = 'length' then 'cut' end,
  case when regexp_matches(response, '{_CONTROL}') then 'control' end, case when output_tokens >= 600 then 'long' end) as flags from {LAST}) where flags <> ''
"""


def control_token_scan(spark, d):
    n, kinds = M.control_tokens(F.col("response"))
    return latest_rows(spark, d).select(*KEY, n.cast("long").alias("n_control"), kinds.alias("control")).filter("n_control > 0")


CONTROL_SCAN = f"""
select run_id, candidate_id, task_id, len(f) as n_control, array_to_string(list_sort(list_distinct(f)), ' ') as control
from (select *, regexp_extract_all(response, '{_CONTROL}') as f from {LAST}) where len(f) > 0
"""


def missing_pairs(spark, d):
    tasks = table(spark, d, "tutor_tasks").select(F.col("id").alias("task_id"))
    rows = table(spark, d, "bakeoff_results").select("candidate_id", "task_id").distinct()
    seen = rows.groupBy("candidate_id").agg(F.count("*").alias("seen"))
    known = rows.join(tasks, "task_id", "left_semi").groupBy("candidate_id").agg(F.count("*").alias("known"))
    total = tasks.distinct().count()
    return seen.join(known, "candidate_id", "left").select("candidate_id", (F.lit(total) - F.coalesce("known", F.lit(0))).alias("missing")).filter("missing > 0")


MISSING = """
select c.candidate_id, count(*) as missing from (select distinct candidate_id from bakeoff_results) c cross join (select distinct id from tutor_tasks) t
where not exists (select 1 from bakeoff_results b where b.candidate_id = c.candidate_id and b.task_id = t.id) group by 1
"""


def blind_review_pack(spark, d):
    """Per task the candidates' latest answers in a seeded order, under labels that tell nothing of the candidate."""
    rows = latest_rows(spark, d).filter("run_id is not null")
    shown = F.when(F.col("status") == "ok", F.coalesce("response", F.lit(""))).otherwise(F.concat(F.lit("[error] "), F.coalesce("error", F.lit("unknown"))))
    order = Window.partitionBy("run_id", "task_id").orderBy(salted_order(F.concat_ws("/", "run_id", "task_id", "candidate_id"), "blind"))
    return rows.withColumn("label", F.concat(F.lit("answer "), F.row_number().over(order).cast("string"))).select("run_id", "task_id", "label", shown.alias("response"))


BLIND = f"""
select run_id, task_id, 'answer ' || row_number() over (partition by run_id, task_id order by sha256('blind:' || run_id || '/' || task_id || '/' || candidate_id)) as label,
  case when status = 'ok' then coalesce(response, '') else '[error] ' || coalesce(error, 'unknown') end as response from {LAST}
"""


def before_after_compare(spark, d):
    """Each task's answer in a candidate's first run beside the one in its last run."""
    rows = latest_rows(spark, d).select(*KEY, "response")
    ends = rows.groupBy("candidate_id").agg(F.min("run_id").alias("first"), F.max("run_id").alias("last"))
    both = rows.join(ends, "candidate_id")
    before = both.filter("run_id = first").select("candidate_id", "task_id", F.col("response").alias("before"))
    after = both.filter("run_id = last").select("candidate_id", "task_id", F.col("response").alias("after"))
    return before.join(after, ["candidate_id", "task_id"], "left").select("candidate_id", "task_id", F.coalesce("before", F.lit("(missing)")).alias("before"), F.coalesce("after", F.lit("(missing)")).alias("after"))


BEFORE_AFTER = f"""
with l as (select * from {LAST}), e as (select candidate_id, min(run_id) as f, max(run_id) as z from l group by 1)
select b.candidate_id, b.task_id, coalesce(b.response, '(missing)') as before, coalesce(a.response, '(missing)') as after from l b join e on e.candidate_id = b.candidate_id and b.run_id = e.f
left join l a on a.candidate_id = b.candidate_id and a.run_id = e.z and a.task_id = b.task_id
"""


def visible_responses(spark, d):
    return latest_rows(spark, d).filter("response is not null").select(*KEY, T.visible_response(F.col("response")).alias("visible"), F.length(T.thought(F.col("response"))).cast("long").alias("thought_chars"))


VISIBLE = rf"""
select run_id, candidate_id, task_id, regexp_replace(regexp_replace(regexp_replace(response, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*$', '', 'g'), '^\s+|\s+$', '', 'g') as visible,
  coalesce(length(array_to_string(list_transform(regexp_extract_all(response, '(?s)<think>(.*?)(?:</think>|$)', 1), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10))), 0) as thought_chars
from {LAST} where response is not null
"""


def heldout_tasks(spark, d):
    return table(spark, d, "tutor_tasks").filter("split = 'benchmark-only'").groupBy("category").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


HELDOUT = "select category, count(*) as n, min(id) as first_id from tutor_tasks where split = 'benchmark-only' group by 1"


def quiz_slices(spark, d):
    """For each category's first five prompts, the numbered list of the first n of them, n = 1 to 5."""
    w = Window.partitionBy("category").orderBy("id")
    first = table(spark, d, "tutor_tasks").withColumn("k", F.row_number().over(w)).filter("k <= 5")
    lists = first.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("k", "prompt"))).alias("q"))
    each = lists.select("category", "q", F.explode(F.sequence(F.lit(1), F.size("q"))).alias("n"))
    lines = F.transform(F.slice("q", F.lit(1), F.col("n")), lambda x: F.concat(x["k"].cast("string"), F.lit(". "), x["prompt"]))
    return each.select("category", F.col("n").cast("long").alias("n"), F.array_join(lines, "\n").alias("quiz"))


QUIZ = """
with f as (select category, prompt, row_number() over (partition by category order by id) as k from tutor_tasks)
select a.category, a.k as n, string_agg(b.k || '. ' || b.prompt, chr(10) order by b.k) as quiz from f a join f b on a.category = b.category and b.k <= a.k where a.k <= 5 group by 1, 2
"""

QUERIES = {
    "latest_attempt": latest_attempt, "pending_tasks": pending_tasks, "run_summary": run_summary, "status_counts": status_counts,
    "response_flags": response_flags, "control_token_scan": control_token_scan, "missing_pairs": missing_pairs, "blind_review_pack": blind_review_pack,
    "before_after_compare": before_after_compare, "visible_responses": visible_responses, "heldout_tasks": heldout_tasks, "quiz_slices": quiz_slices,
}
ORACLES = {
    "latest_attempt": LATEST, "pending_tasks": PENDING, "run_summary": RUN_SUMMARY, "status_counts": STATUS, "response_flags": FLAGS,
    "control_token_scan": CONTROL_SCAN, "missing_pairs": MISSING, "blind_review_pack": BLIND, "before_after_compare": BEFORE_AFTER,
    "visible_responses": VISIBLE, "heldout_tasks": HELDOUT, "quiz_slices": QUIZ,
}
