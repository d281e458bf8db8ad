"""Queries of whole curation plans: selected and split drafts, row checks, collisions between batches, input gates, pairs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions import text as T
from granary.operators import baseline as B
from granary.operators import conversations as C
from granary.operators import keyed as K
from granary.operators.builders import built, with_defaults
from granary.operators.order import salted_order, with_ordinal
from granary.plans.conversation_queries import _BLANK, FLAT, ONE, json_text, one_record
from granary.plans.document_queries import GROUPING_KEYS, _keyed
from granary.plans.evaluation_queries import KEY, LAST, latest_rows
from granary.plans.review_queries import ASSESS, JOBS, assessments, last_jobs
from granary.session import table, written

SHARE, SEED = 0.9, "baseline"


def drafts(spark, d):
    """One delivery of each record with its grouping keys."""
    columns = ["id", "split", "task_family", "messages", *GROUPING_KEYS, "reviewer_notes", "ingested_at"]
    rows = table(spark, d, "sft_records").filter("id is not null").select(*columns)
    return K.first_delivery(rows, "id", [F.col("ingested_at"), F.coalesce("split", F.lit("")), F.coalesce("reviewer_notes", F.lit(""))]).drop("reviewer_notes", "ingested_at")


def baseline_rows(spark, d, repaired):
    return B.with_duplicates(B.selected(drafts(spark, d), last_jobs(spark, d), assessments(spark, d), repaired))


def _selection(spark, d, repaired):
    return baseline_rows(spark, d, repaired).select("id", "review_status", "conversation_hash", "original_hash", "duplicate_of")


def baseline_accepted(spark, d):
    return _selection(spark, d, False)


def baseline_repaired(spark, d):
    return _selection(spark, d, True)


_GATE = """case when coalesce(recommendation, '') not in ('accept', 'repair', 'reject') then 'recommendation'
  when coalesce(json_type(doc, '$.scores'), '') <> 'OBJECT' or len(json_keys(doc, '$.scores')) = 0 then 'scores'
  when coalesce(json_type(doc, '$.failure_tags'), '') <> 'ARRAY' then 'failure_tags' when json_extract_string(doc, '$.brief_notes') is null then 'brief_notes'
  when recommendation = 'accept' and (json_array_length(doc, '$.failure_tags') > 0 or len(list_filter(json_keys(doc, '$.scores'), lambda k: not coalesce(try_cast(json_extract_string(doc, '$.scores.' || k) as int) >= 4, false))) > 0) then 'accept gate'
  when recommendation = 'repair' and coalesce(json_array_length(doc, '$.revised_messages'), 0) < 2 then 'repair gate' end"""


def _baseline_sql(chosen: str) -> str:
    return f"""
with s as (select o.id, a.recommendation = 'repair' as fixed, o.messages as old, cast(json_extract(a.doc, '$.revised_messages') as struct(role varchar, content varchar)[]) as new
  from {ONE} o join {JOBS} j on j.id = o.id join (select *, {_GATE} as error from {ASSESS}) a using (job_id) where o.rn = 1 and a.error is null and a.recommendation in ({chosen})),
h as (select id, fixed, case when fixed then sha256({json_text('old')}) end as original_hash, sha256(case when fixed then {json_text('new')} else {json_text('old')} end) as conversation_hash from s)
select id, case when fixed then 'critic-repaired' else 'critic-accepted' end as review_status, conversation_hash, original_hash, nullif(min(id) over (partition by coalesce(conversation_hash, id)), id) as duplicate_of from h
"""


BASELINE_ACCEPTED, BASELINE_REPAIRED = _baseline_sql("'accept'"), _baseline_sql("'accept', 'repair'")


def _slim(spark, d, repaired):
    """The selected drafts with hashes in the messages' place, written: conversations move once, and no further."""
    rows = B.selected(drafts(spark, d), last_jobs(spark, d), assessments(spark, d), repaired)
    return written(rows.select("id", "review_status", "task_family", "conversation_hash", *GROUPING_KEYS, B.message_keys(F.col("messages")).alias("said")))


def _split(slim):
    rows = B.with_duplicates(slim).filter("duplicate_of is null")
    return B.split_groups(rows.select("id", "review_status", "task_family"), B.group_keys(rows, _keyed(rows)), SHARE, SEED)


def baseline_records(spark, d, repaired=True):
    """The whole plan: (id, review_status, task_family, group_id, split) of selected drafts, duplicates dropped, whole groups split."""
    return _split(_slim(spark, d, repaired)).select("id", "review_status", "task_family", "group_id", "split")


def baseline_report(spark, d):
    """(metric, n): drafts, recommendations, selected rows, dropped duplicates, groups, rows of each split."""
    slim = _slim(spark, d, True)
    rows = written(_split(slim))
    of = lambda name, df: df.select(F.lit(name).alias("metric"), F.col("n"))
    one = lambda name, df: of(name, df.agg(F.count("*").alias("n")))
    by = lambda df, c: df.groupBy(F.coalesce(c, F.lit("none")).alias("metric")).agg(F.count("*").alias("n"))
    out = one("drafts", one_record(spark, d)).unionByName(by(assessments(spark, d), "recommendation")).unionByName(by(rows, "split"))
    out = out.unionByName(one("selected", rows)).unionByName(one("groups", rows.select("group_id").distinct()))
    return out.unionByName(one("dropped duplicates", B.with_duplicates(slim).filter("duplicate_of is not null")))


def assessment_gates(spark, d):
    return assessments(spark, d).select("job_id", B.assessment_error().alias("error")).filter("error is not null")


ASSESSMENT_GATES = f"select job_id, error from (select job_id, {_GATE} as error from {ASSESS}) where error is not null"


def drafts_without_assessment(spark, d):
    assessed = last_jobs(spark, d).join(assessments(spark, d).select("job_id"), "job_id").select("id")
    return K.unmatched(one_record(spark, d).select("id"), assessed, "id")


WITHOUT_ASSESSMENT = f"select id from {ONE} o where rn = 1 and not exists (select 1 from {JOBS} j join {ASSESS} a using (job_id) where j.id = o.id)"

#: What the fields of a training row may say.
ALLOWED = {
    "task_type": (
        "greeting", "translation-en-rw", "translation-rw-en", "grammar-explanation", "sentence-correction", "vocabulary", "quiz-generation",
        "dialogue", "uncertainty", "culture-register", "reading-comprehension", "sentence-generation", "pronunciation", "code-switching",
    ),
    "split": ("draft", "train", "validation", "experimental-train", "experimental-validation", "benchmark-only"),
    "source_status": ("approved", "team-authored", "manual", "reference-only", "blocked", "investigate", "model-generated"),
    "review_status": ("needs-review", "approved", "needs-fix", "rejected", "not-sure", "critic-accepted", "critic-repaired"),
    "language_mix": ("kinyarwanda", "english", "kinyarwanda+english"),
}
ID = "^[a-z0-9]+(-[a-z0-9]+)*$"
_ROW = ("ingested_at", "split", "reviewer_notes", "source_status", "review_status", "language_mix")


def sft_validation(spark, d):
    """(id, ingested_at, errors) of the deliveries that break the row schema, errors in the order id, fields, source, notes, messages.

    Only ids that are well formed count as met before; the first delivery of an id passes.
    """
    rows = table(spark, d, "sft_records")
    good = F.coalesce(F.col("id").rlike(ID), F.lit(False))
    order = [F.col("ingested_at"), *[F.coalesce(c, F.lit("")) for c in _ROW[1:]]]
    again = F.row_number().over(Window.partitionBy("id").orderBy(*order)) > 1
    first = F.when(F.coalesce("id", F.lit("")) == "", "id is blank").when(~good, "id is malformed").when(again, "id is repeated")
    fields = [F.when(F.col(c).isNull(), f"{c} is no string").when(~F.col(c).isin(*values), f"{c} is not allowed") for c, values in ALLOWED.items()]
    rest = [F.when(T.is_blank(F.col("source")), "source is blank"), F.when(F.col("reviewer_notes").isNull(), "reviewer_notes is no string")]
    errors = F.concat(F.array_compact(F.array(first, *fields, *rest)), C.message_errors(F.col("messages")))
    return rows.select("id", "ingested_at", F.array_join(errors, "; ").alias("errors")).filter("errors <> ''")


_FIELDS = ", ".join(f"case when {c} is null then '{c} is no string' when {c} not in ({', '.join(repr(v) for v in values)}) then '{c} is not allowed' end" for c, values in ALLOWED.items())
_ORDER = "ingested_at nulls first, " + ", ".join(f"coalesce({c}, '')" for c in _ROW[1:])
SFT_VALIDATION = f"""
with r as (select *, row_number() over () as k, row_number() over (partition by id order by {_ORDER}) as rn from sft_records),
f as (select k, i - 1 as pos, messages[i].role as role, messages[i].content as content from (select k, messages, unnest(generate_series(1, len(messages))) as i from r where len(messages) >= 2 and len(messages) % 2 = 0)),
m as (select k, string_agg(e, '; ' order by pos, n) as e from (
  select k, pos, 1 as n, 'role at ' || pos as e from f where coalesce(role, '') <> case when pos % 2 = 0 then 'user' else 'assistant' end
  union all select k, pos, 2, 'content at ' || pos from f where {_BLANK}) group by k)
select id, ingested_at, errors from (select id, ingested_at, concat_ws('; ',
  case when coalesce(id, '') = '' then 'id is blank' when not regexp_matches(id, '{ID}') then 'id is malformed' when rn > 1 then 'id is repeated' end, {_FIELDS},
  case when regexp_replace(coalesce(source, ''), '^\\s+|\\s+$', '', 'g') = '' then 'source is blank' end, case when reviewer_notes is null then 'reviewer_notes is no string' end,
  case when messages is null then 'no messages' when len(messages) < 2 then 'fewer than two' when len(messages) % 2 = 1 then 'odd count' else m.e end) as errors from r left join m using (k)) where errors <> ''
"""


def _conversation_keys(rows):
    """(id, split, prompt, answer): the two messages of a record in normal form; empty texts for any other number of messages."""
    two = F.size("messages") == 2
    said = lambda k: F.when(two, F.coalesce(T.draft_text(F.get("messages", F.lit(k)).getField("content")), F.lit(""))).otherwise("")
    return rows.select("id", F.coalesce(F.lower(T.strip(F.col("split"))), F.lit("none")).alias("split"), said(0).alias("prompt"), said(1).alias("answer"))


def _draft_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace(replace(lower(coalesce({c}, '')), 'ß', 'ss'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


_CONV = f"""(select id, coalesce(lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g')), 'none') as split, case when len(messages) = 2 then {_draft_sql('messages[1].content')} else '' end as prompt,
  case when len(messages) = 2 then {_draft_sql('messages[2].content')} else '' end as answer from {ONE} where rn = 1)"""


def conversation_keys(spark, d):
    return _conversation_keys(one_record(spark, d)).select("id", F.sha2(F.concat_ws("\n", "prompt", "answer"), 256).alias("conversation_key"))


CONVERSATION_KEYS = f"select id, sha256(prompt || chr(10) || answer) as conversation_key from {_CONV}"


def batch_collisions(spark, d):
    """Conversations of drafts that are in an earlier split already."""
    keys = _conversation_keys(one_record(spark, d))
    new, old = keys.filter("split = 'draft'").select("prompt", "answer"), keys.filter("split <> 'draft'").select("prompt", "answer")
    return new.intersect(old)


BATCH_COLLISIONS = f"select prompt, answer from {_CONV} where split = 'draft' intersect select prompt, answer from {_CONV} where split <> 'draft'"


def batch_duplicates(spark, d):
    """(kind, key, n): ids delivered more than once, and conversations that several records hold."""
    ids = table(spark, d, "sft_records").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("id").alias("kind"), F.col("id").alias("key"), "n")
    said = _conversation_keys(one_record(spark, d)).groupBy("prompt", "answer").agg(F.count("*").alias("n")).filter("n > 1")
    return ids.unionByName(said.select(F.lit("conversation").alias("kind"), F.sha2(F.concat_ws("\n", "prompt", "answer"), 256).alias("key"), "n"))


BATCH_DUPLICATES = f"""
select 'id' as kind, id as key, count(*) as n from sft_records group by id having count(*) > 1
union all select 'conversation', sha256(prompt || chr(10) || answer), count(*) from {_CONV} group by prompt, answer having count(*) > 1
"""


def training_inputs(spark, d):
    """(source, kept, dropped, outcome): each source as one input, given up as a whole for a broken or a benchmark-only row."""
    split = F.coalesce(F.lower(T.strip(F.col("split"))), F.lit("none"))
    rows = one_record(spark, d).select(F.coalesce("source", F.lit("none")).alias("source"), split.alias("split"), (F.size(C.message_errors(F.col("messages"))) > 0).alias("bad"))
    use = F.col("split").isin("train", "experimental-train")
    sums = rows.groupBy("source").agg(F.sum(use.cast("long")).alias("kept"), F.sum((~use).cast("long")).alias("dropped"), F.max("bad").alias("bad"), F.max(F.col("split") == "benchmark-only").alias("test"))
    outcome = F.when(F.col("bad"), "broken rows").when(F.col("test"), "benchmark-only rows").when(F.col("kept") == 0, "nothing left").otherwise("kept")
    return sums.select("source", "kept", "dropped", outcome.alias("outcome"))


_BAD = f"(o.messages is null or len(o.messages) < 2 or len(o.messages) % 2 = 1 or o.id in (select id from {FLAT} where coalesce(role, '') <> case when pos % 2 = 0 then 'user' else 'assistant' end or {_BLANK}))"
TRAINING_INPUTS = f"""
select source, cast(sum(u) as bigint) as kept, cast(sum(1 - u) as bigint) as dropped, case when max(bad) = 1 then 'broken rows' when max(test) = 1 then 'benchmark-only rows' when sum(u) = 0 then 'nothing left' else 'kept' end as outcome
from (select coalesce(source, 'none') as source, case when s in ('train', 'experimental-train') then 1 else 0 end as u, case when s = 'benchmark-only' then 1 else 0 end as test, bad
  from (select source, coalesce(lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g')), 'none') as s, case when {_BAD} then 1 else 0 end as bad from {ONE} o where rn = 1)) group by source
"""


def _lacking(seen, tasks, keys):
    """(keys, task_id) of the tasks that a group of seen rows lacks: only those pairs are made, not all."""
    every = tasks.agg(F.array_sort(F.collect_set("task_id")).alias("every")).withColumn("one", F.lit(1))
    held = seen.groupBy(*keys).agg(F.collect_set("done").alias("done")).withColumn("one", F.lit(1))
    return held.join(F.broadcast(every), "one").select(*keys, F.explode(F.array_except("every", "done")).alias("task_id"))


def missing_result_pairs(spark, d):
    tasks = table(spark, d, "tutor_tasks").select(F.col("id").alias("task_id"))
    return _lacking(table(spark, d, "bakeoff_results").select("candidate_id", F.col("task_id").alias("done")), tasks, ["candidate_id"])


MISSING_PAIRS = "select c.candidate_id, t.id as task_id from (select distinct candidate_id from bakeoff_results) c cross join (select distinct id from tutor_tasks) t where not exists (select 1 from bakeoff_results b where b.candidate_id = c.candidate_id and b.task_id = t.id)"


def pending_result_pairs(spark, d):
    """(run_id, candidate_id, task_id): benchmark tasks whose latest attempt did not succeed, or that were never tried."""
    tasks = table(spark, d, "tutor_tasks").filter("split = 'benchmark-only'").select(F.col("id").alias("task_id"))
    seen = latest_rows(spark, d).select("run_id", "candidate_id", F.when(F.col("status") == "ok", F.col("task_id")).alias("done"))
    return _lacking(seen, tasks, ["run_id", "candidate_id"])


PENDING_PAIRS = f"""
select p.run_id, p.candidate_id, t.task_id from (select distinct run_id, candidate_id from bakeoff_results) p cross join (select id as task_id from tutor_tasks where split = 'benchmark-only') t
left join {LAST} l on l.run_id = p.run_id and l.candidate_id = p.candidate_id and l.task_id = t.task_id where coalesce(l.status, '') <> 'ok'
"""


def blind_pack_ids(spark, d):
    """(blind_id, model_label, run_id, task_id): one label for a candidate, and running ids in the order of runs, tasks and a seeded shuffle."""
    rows = latest_rows(spark, d).select(*KEY)
    names = rows.select("candidate_id").distinct()
    labels = with_ordinal(names.withColumn("h", salted_order(F.col("candidate_id"), "label")), "h").select("candidate_id", F.format_string("Model %02d", F.col("ordinal") + 1).alias("model_label"))
    shuffled = rows.withColumn("h", salted_order(F.concat_ws("/", *KEY), "pack"))
    placed = with_ordinal(shuffled, "run_id", "task_id", "h").join(F.broadcast(labels) if labels.count() <= K.SMALL else labels, "candidate_id")
    return placed.select(F.format_string("B%03d", F.col("ordinal") + 1).alias("blind_id"), "model_label", "run_id", "task_id")


BLIND_IDS = f"""
with l as (select * from {LAST}), n as (select candidate_id, printf('Model %02d', row_number() over (order by sha256('label:' || candidate_id))) as model_label from (select distinct candidate_id from l))
select printf('B%03d', row_number() over (order by run_id, task_id, sha256('pack:' || run_id || '/' || candidate_id || '/' || task_id))) as blind_id, model_label, run_id, task_id from l join n using (candidate_id)
"""


def result_base_records(spark, d):
    """(candidate_id, task_id, category, key): the record that each result of a candidate and a benchmark task starts from."""
    tasks = table(spark, d, "tutor_tasks").filter("split = 'benchmark-only'").select("id", "category")
    every = tasks.agg(F.array_sort(F.collect_list(F.struct("id", "category"))).alias("every")).withColumn("one", F.lit(1))
    names = table(spark, d, "bakeoff_results").select("candidate_id").distinct().withColumn("one", F.lit(1))
    both = names.join(F.broadcast(every), "one").select("candidate_id", F.explode("every").alias("t"))
    return both.select("candidate_id", F.col("t.id").alias("task_id"), F.col("t.category").alias("category"), T.stable_id(T.slug(F.col("candidate_id")), T.slug(F.col("t.id"))).alias("key"))


_SLUG = "regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
BASE_RECORDS = f"select candidate_id, t.id as task_id, category, {_SLUG.format(c='candidate_id')} || '-' || {_SLUG.format(c='t.id')} as key from (select distinct candidate_id from bakeoff_results) c cross join (select id, category from tutor_tasks where split = 'benchmark-only') t"


def rounded_medians(spark, d):
    """Medians rounded to four places, halves to even."""
    return latest_rows(spark, d).groupBy("candidate_id").agg(F.bround(F.median("latency_seconds"), 4).alias("latency"), F.bround(F.median("tokens_per_second"), 4).alias("speed"))


ROUNDED = f"select candidate_id, round_even(median(latency_seconds), 4) as latency, round_even(median(tokens_per_second), 4) as speed from {LAST} group by 1"


def profile_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", T.is_profile_key(F.col("p_type")).alias("as_is"), T.is_profile_key(T.slug(F.col("p_type"))).alias("as_slug"))


PROFILE_KEYS = f"select p_partkey, regexp_full_match(p_type, '[a-z0-9-]+') as as_is, regexp_full_match({_SLUG.format(c='p_type')}, '[a-z0-9-]+') as as_slug from part"


def built_drafts(spark, d):
    """Drafts that each kind of document is built into: one of a glossary, two of a lesson, none of others; defaults filled in."""
    docs = table(spark, d, "documents").select("doc_id", "doc_kind", "lang")
    one = lambda df, n: df.select("doc_id", "lang", F.lit(n).alias("variant"))
    rows = built(docs, "doc_kind", {"glossary": lambda df: one(df, 1), "lesson": lambda df: one(df, 1).unionByName(one(df, 2))}, gate=False)
    return with_defaults(rows, {"lang": "und", "split": "draft"}, {"source": "documents"}).select("doc_id", "variant", "lang", "split", "source")


BUILT = "select doc_id, v as variant, coalesce(lang, 'und') as lang, 'draft' as split, 'documents' as source from documents join (values ('glossary', 1), ('lesson', 1), ('lesson', 2)) k(kind, v) on kind = doc_kind"

QUERIES = {
    "baseline_accepted": baseline_accepted, "baseline_repaired": baseline_repaired, "baseline_records": baseline_records, "baseline_report": baseline_report,
    "assessment_gates": assessment_gates, "drafts_without_assessment": drafts_without_assessment, "sft_validation": sft_validation,
    "conversation_keys": conversation_keys, "batch_collisions": batch_collisions, "batch_duplicates": batch_duplicates, "training_inputs": training_inputs,
    "missing_result_pairs": missing_result_pairs, "pending_result_pairs": pending_result_pairs, "blind_pack_ids": blind_pack_ids,
    "result_base_records": result_base_records, "rounded_medians": rounded_medians, "profile_keys": profile_keys, "built_drafts": built_drafts,
}
ORACLES = {
    "baseline_accepted": BASELINE_ACCEPTED, "baseline_repaired": BASELINE_REPAIRED, "assessment_gates": ASSESSMENT_GATES,
    "drafts_without_assessment": WITHOUT_ASSESSMENT, "sft_validation": SFT_VALIDATION, "conversation_keys": CONVERSATION_KEYS,
    "batch_collisions": BATCH_COLLISIONS, "batch_duplicates": BATCH_DUPLICATES, "training_inputs": TRAINING_INPUTS, "missing_result_pairs": MISSING_PAIRS,
    "pending_result_pairs": PENDING_PAIRS, "blind_pack_ids": BLIND_IDS, "result_base_records": BASE_RECORDS, "rounded_medians": ROUNDED,
    "profile_keys": PROFILE_KEYS, "built_drafts": BUILT,
}
