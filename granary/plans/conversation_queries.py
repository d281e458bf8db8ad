"""Queries over conversations: messages, checks, histories, prompt and completion rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import conversations as C
from granary.operators.keyed import first_delivery
from granary.session import table

# One record is the first delivery of an id.
ONE = "(select id, split, source, task_type, task_family, messages, reviewer_notes, row_number() over (partition by id order by ingested_at nulls first, coalesce(split, ''), coalesce(reviewer_notes, '')) as rn from sft_records where id is not null)"
FLAT = f"(select id, split, task_type, i - 1 as pos, messages[i].role as role, messages[i].content as content from (select *, unnest(generate_series(1, len(messages))) as i from {ONE} where rn = 1))"


def one_record(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sft_records").filter("id is not null").select("id", "split", "source", "task_type", "task_family", "messages", "reviewer_notes", "ingested_at")
    return first_delivery(rows, "id", [F.col("ingested_at"), F.coalesce("split", F.lit("")), F.coalesce("reviewer_notes", F.lit(""))])


def messages(spark, d):
    return C.exploded(one_record(spark, d), "id")


MESSAGES = f"select id, pos, role, content from {FLAT}"


def conversation_validation(spark, d):
    found = one_record(spark, d).select("id", C.message_errors(F.col("messages")).alias("e"))
    return found.select("id", F.size("e").cast("long").alias("n_errors"), F.array_join("e", "; ").alias("errors"))


_BLANK = "regexp_replace(coalesce(content, ''), '^\\s+|\\s+$', '', 'g') = ''"
CONVERSATION_VALIDATION = f"""
with m as (select id, string_agg(e, '; ' order by pos, k) as errors, count(*) as n from (
  select id, pos, 1 as k, 'role at ' || pos as e from {FLAT} where coalesce(role, '') <> case when pos % 2 = 0 then 'user' else 'assistant' end
  union all select id, pos, 2, 'content at ' || pos from {FLAT} where {_BLANK}) group by id)
select o.id, case when o.messages is null or len(o.messages) < 2 or len(o.messages) % 2 = 1 then 1 else coalesce(m.n, 0) end as n_errors,
  case when o.messages is null then 'no messages' when len(o.messages) < 2 then 'fewer than two' when len(o.messages) % 2 = 1 then 'odd count' else coalesce(m.errors, '') end as errors
from {ONE} o left join m using (id) where o.rn = 1
"""


def invalid_conversations_report(spark, d):
    found = one_record(spark, d).select("split", F.explode(C.message_errors(F.col("messages"))).alias("e"))
    return found.groupBy(F.regexp_replace("e", r" at \d+$", "").alias("error")).agg(F.count("*").alias("n"))


INVALID_REPORT = f"""
select error, count(*) as n from (
  select 'no messages' as error from {ONE} where rn = 1 and messages is null
  union all select 'fewer than two' from {ONE} where rn = 1 and len(messages) < 2
  union all select 'odd count' from {ONE} where rn = 1 and len(messages) >= 2 and len(messages) % 2 = 1
  union all select 'role' from {FLAT} f where coalesce(role, '') <> case when pos % 2 = 0 then 'user' else 'assistant' end and id in (select id from {ONE} where rn = 1 and len(messages) >= 2 and len(messages) % 2 = 0)
  union all select 'content' from {FLAT} f where {_BLANK} and id in (select id from {ONE} where rn = 1 and len(messages) >= 2 and len(messages) % 2 = 0)
) group by error
"""


def prompt_completion_rows(spark, d):
    return C.prompt_completions(one_record(spark, d), "id")


PROMPT_COMPLETION = f"""
with f as (select id, pos, role, content from {FLAT}),
h as (select id, pos, role, content, string_agg(coalesce(role, '') || ': ' || coalesce(content, ''), chr(10)) over (partition by id order by pos rows between unbounded preceding and 1 preceding) as prompt from f)
select id, pos, coalesce(prompt, '') as prompt, content as completion from h where role = 'assistant'
"""


def supervised_turn_counts(spark, d):
    turns = F.size(F.filter("messages", lambda m: m["role"] == "assistant"))
    split = F.lower(T.strip(F.col("split")))
    return one_record(spark, d).groupBy(F.coalesce(split, F.lit("none")).alias("split")).agg(F.count("*").alias("records"), F.sum(F.when(F.col("messages").isNotNull(), turns).otherwise(0)).alias("turns"))


SUPERVISED_TURNS = f"""
select coalesce(lower(trim(split)), 'none') as split, count(*) as records,
  cast(sum(case when messages is null then 0 else len(list_filter(messages, lambda m: m.role = 'assistant')) end) as bigint) as turns from {ONE} where rn = 1 group by 1
"""


def role_alternation_lag(spark, d):
    return C.repeated_roles(messages(spark, d), "id").select("id", "pos", "role")


ROLE_LAG = f"select id, pos, role from (select id, pos, role, lag(role) over (partition by id order by pos) as p from {FLAT}) where role = p"


def _requests(spark, d):
    rows = table(spark, d, "chat_requests").filter("request_id is not null")
    return first_delivery(rows, "request_id", [F.col("received_at")])


REQ = "(select *, row_number() over (partition by request_id order by received_at nulls first) as rn from chat_requests where request_id is not null)"
RFLAT = f"(select request_id, i - 1 as pos, messages[i].role as role, messages[i].content as content from (select request_id, messages, unnest(generate_series(1, len(messages))) as i from {REQ} where rn = 1))"


def history_char_budget(spark, d):
    rows = C.running_length(C.exploded(_requests(spark, d), "request_id"), "request_id", cap=1_000, message_cap=400)
    return rows.select("request_id", "pos", "chars", "running", "over")


HISTORY_BUDGET = f"""
select request_id, pos, chars, cast(sum(chars) over w as bigint) as running, sum(chars) over w > 1000 or chars > 400 as over
from (select request_id, pos, cast(coalesce(length(content), 0) as bigint) as chars from {RFLAT}) window w as (partition by request_id order by pos)
"""


def history_trim_last_n(spark, d):
    kept = C.last_messages(F.col("messages"), 5)
    return _requests(spark, d).filter("messages is not null").select("request_id", F.size(kept).cast("long").alias("kept"), C.rendered(kept).alias("history"))


HISTORY_TRIM = f"""
with n as (select request_id, pos, role, content, count(*) over (partition by request_id) as n from {RFLAT}),
c as (select *, row_number() over (partition by request_id order by pos) as k from n where pos >= n - 5),
t as (select * from c where not (k = 1 and role = 'assistant'))
select request_id, count(*) as kept, string_agg(coalesce(role, '') || ': ' || coalesce(content, ''), chr(10) order by pos) as history from t group by request_id
"""


def history_trim_turns(spark, d):
    kept = C.last_turns(F.col("messages"), 1)
    return one_record(spark, d).filter("size(messages) > 0").select("id", F.size(kept).cast("long").alias("kept"), C.rendered(kept).alias("history"))


HISTORY_TURNS = f"""
with n as (select id, pos, role, content, count(*) over (partition by id) as n from {FLAT})
select id, count(*) as kept, string_agg(coalesce(role, '') || ': ' || coalesce(content, ''), chr(10) order by pos) as history from n where pos = 0 or pos >= n - 2 group by id
"""


def previous_user_prompt(spark, d):
    return C.previous_user(messages(spark, d), "id").select("id", "pos", "prompt", "content")


PREVIOUS_USER = f"""
select id, pos, prompt, content from (select id, pos, role, content,
  last_value(case when role = 'user' then content end ignore nulls) over (partition by id order by pos rows between unbounded preceding and 1 preceding) as prompt from {FLAT}) where role = 'assistant'
"""


def first_user_prompts(spark, d):
    first = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0)).getField("content")
    return one_record(spark, d).select("id", T.strip(first).alias("prompt")).filter(F.coalesce("prompt", F.lit("")) != "")


FIRST_USER = f"""
select id, prompt from (select id, regexp_replace(content, '^\\s+|\\s+$', '', 'g') as prompt, row_number() over (partition by id order by pos) as k from {FLAT} where role = 'user') where k = 1 and coalesce(prompt, '') <> ''
"""


def canonical_hashes(spark, d):
    return one_record(spark, d).filter("messages is not null").select("id", F.sha2(C.rendered(F.col("messages")), 256).alias("content_hash"))


CANONICAL_HASHES = f"select id, sha256(string_agg(coalesce(role, '') || ': ' || coalesce(content, ''), chr(10) order by pos)) as content_hash from {FLAT} group by id"


def canonical_json_length(spark, d):
    return one_record(spark, d).filter("messages is not null").select("id", F.sha2(T.canonical_messages(F.col("messages")), 256).alias("json_hash"))


def json_text(messages: str) -> str:
    """SQL for messages as compact JSON with keys in order."""
    part = lambda f: f"coalesce(cast(to_json(m.{f}) as varchar), 'null')"
    return f"'[' || array_to_string(list_transform({messages}, lambda m: '{{\"content\":' || {part('content')} || ',\"role\":' || {part('role')} || '}}'), ',') || ']'"


JSON_HASHES = f"select id, sha256({json_text('messages')}) as json_hash from {ONE} where rn = 1 and messages is not null"


def conversation_prompt_overlap(spark, d):
    said = C.exploded(one_record(spark, d), "id").filter("role = 'user'").select("id", T.leakage_text(F.col("content")).alias("k")).filter("k <> ''")
    asked = table(spark, d, "tutor_tasks").select(F.col("id").alias("task_id"), T.leakage_text(F.col("prompt")).alias("k")).filter("k <> ''")
    return said.join(asked, "k").select("id", "task_id").distinct()


_LEAK = "trim(regexp_replace(replace(lower({c}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
PROMPT_OVERLAP = f"""
select distinct f.id, t.id as task_id from {FLAT} f join tutor_tasks t on {_LEAK.format(c='f.content')} = {_LEAK.format(c='t.prompt')}
where f.role = 'user' and {_LEAK.format(c='f.content')} <> ''
"""


def system_prompt_assembly(spark, d):
    modes = spark.createDataFrame([("learn", "Teach step by step."), ("translate", "Give a translation first."), ("converse", "Keep the talk going.")], "mode string, said string")
    levels = spark.createDataFrame([("beginner", "Use short sentences."), ("intermediate", "Add one detail."), ("advanced", "Explain nuances.")], "level string, depth string")
    rows = _requests(spark, d).select("request_id", "mode", "level")
    both = rows.join(F.broadcast(modes), "mode", "left").join(F.broadcast(levels), "level", "left")
    return both.select("request_id", F.concat_ws(" ", F.lit("You are a tutor."), "said", "depth").alias("system_prompt"))


SYSTEM_PROMPT = f"""
select request_id, concat_ws(' ', 'You are a tutor.', case mode when 'learn' then 'Teach step by step.' when 'translate' then 'Give a translation first.' when 'converse' then 'Keep the talk going.' end,
  case level when 'beginner' then 'Use short sentences.' when 'intermediate' then 'Add one detail.' when 'advanced' then 'Explain nuances.' end) as system_prompt from {REQ} where rn = 1
"""


def full_prompts(spark, d):
    head = F.array(F.struct(F.lit("system").alias("role"), F.lit("You are a tutor.").alias("content")))
    history = F.filter("messages", lambda m: m["role"] != "system")
    shape = F.transform(history, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return _requests(spark, d).filter("messages is not null").select("request_id", C.rendered(F.concat(head, shape)).alias("prompt"))


FULL_PROMPTS = f"""
select r.request_id, 'system: You are a tutor.' || coalesce(chr(10) || h.t, '') as prompt from {REQ} r left join (
  select request_id, string_agg(coalesce(role, '') || ': ' || coalesce(content, ''), chr(10) order by pos) as t from {RFLAT} where role <> 'system' group by request_id) h using (request_id)
where r.rn = 1 and r.messages is not null
"""

QUERIES = {
    "conversation_messages": messages, "conversation_validation": conversation_validation, "invalid_conversations_report": invalid_conversations_report,
    "prompt_completion_pairs": prompt_completion_rows, "supervised_turn_counts": supervised_turn_counts, "role_alternation_lag": role_alternation_lag,
    "history_char_budget": history_char_budget, "history_trim_last_n": history_trim_last_n, "history_trim_turns": history_trim_turns,
    "previous_user_prompt": previous_user_prompt, "first_user_prompts": first_user_prompts, "canonical_hashes": canonical_hashes,
    "canonical_json_hashes": canonical_json_length, "conversation_prompt_overlap": conversation_prompt_overlap,
    "system_prompt_assembly": system_prompt_assembly, "full_prompts": full_prompts,
}
ORACLES = {
    "conversation_messages": MESSAGES, "conversation_validation": CONVERSATION_VALIDATION, "invalid_conversations_report": INVALID_REPORT,
    "prompt_completion_pairs": PROMPT_COMPLETION, "supervised_turn_counts": SUPERVISED_TURNS, "role_alternation_lag": ROLE_LAG,
    "history_char_budget": HISTORY_BUDGET, "history_trim_last_n": HISTORY_TRIM, "history_trim_turns": HISTORY_TURNS,
    "previous_user_prompt": PREVIOUS_USER, "first_user_prompts": FIRST_USER, "canonical_hashes": CANONICAL_HASHES, "canonical_json_hashes": JSON_HASHES,
    "conversation_prompt_overlap": PROMPT_OVERLAP, "system_prompt_assembly": SYSTEM_PROMPT, "full_prompts": FULL_PROMPTS,
}
