"""Queries over drafts, critic jobs and responses, and reviews: keyed joins, gates, decisions and promotions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as P

from granary.functions import text as T
from granary.operators import keyed as K
from granary.plans.conversation_queries import ONE, one_record
from granary.session import table

SCORES = P.MapType(P.StringType(), P.IntegerType())


def assessments(spark, d):
    """The last usable response of each job: its JSON, also when wrapped in other text, as columns."""
    raw = table(spark, d, "critic_responses").filter("job_id is not null").select("job_id", "error", "response_id", "output_text", "received_at")
    doc = F.try_parse_json(F.regexp_extract("output_text", r"(?s)\{.*\}", 0))
    rows = raw.withColumn("doc", doc).filter(F.col("doc").isNotNull() & T.is_blank(F.col("error")))
    got = lambda path, kind: F.try_variant_get("doc", path, kind)
    flat = rows.select("job_id", "response_id", "received_at", got("$.recommendation", "string").alias("recommendation"), F.from_json(got("$.scores", "string"), SCORES).alias("scores"), F.from_json(got("$.failure_tags", "string"), "array<string>").alias("failure_tags"), got("$.brief_notes", "string").alias("brief_notes"), got("$.revised_messages", "string").alias("revised"))
    # a map has no order, which an aggregate over rows asks for: it travels as JSON
    packed = flat.withColumn("scores", F.to_json("scores"))
    one = K.latest(packed, ["job_id"], [F.col("received_at"), F.col("response_id")])
    return one.withColumn("scores", F.from_json("scores", SCORES))


_DOC = "regexp_extract(output_text, '(?s)\\{.*\\}', 0)"
ASSESS = f"""(select job_id, response_id, recommendation, doc from (
  select job_id, response_id, json_extract_string(doc, '$.recommendation') as recommendation, doc, row_number() over (partition by job_id order by received_at desc nulls last, response_id desc nulls last) as rn
  from (select job_id, response_id, received_at, error, case when json_valid({_DOC}) then {_DOC} end as doc from critic_responses where job_id is not null)
  where doc is not null and trim(coalesce(error, '')) = '') where rn = 1)"""


def last_jobs(spark, d):
    """(id, job_id): the last job of each record; a later one takes the place of an earlier one."""
    jobs = table(spark, d, "critic_jobs").filter("job_id is not null and source_record_id is not null").select(F.col("source_record_id").alias("id"), "job_id", "queued_at")
    return K.latest(jobs, ["id"], [F.col("queued_at"), F.col("job_id")]).select("id", "job_id")


JOBS = "(select id, job_id from (select source_record_id as id, job_id, row_number() over (partition by source_record_id order by queued_at desc nulls last, job_id desc) as k from critic_jobs where job_id is not null and source_record_id is not null) where k = 1)"


def critic_join_selection(spark, d):
    """Drafts with their critic's decision: reject drops, repair is marked, a record without a job stays out."""
    jobs = last_jobs(spark, d)
    chosen = jobs.join(assessments(spark, d), "job_id").filter(F.col("recommendation").isin("accept", "repair"))
    return one_record(spark, d).join(chosen, "id").select("id", "job_id", "task_type", "recommendation", F.size("failure_tags").cast("long").alias("n_tags"))


CRITIC_SELECTION = f"""
select o.id, j.job_id, o.task_type, a.recommendation, json_array_length(a.doc, '$.failure_tags') as n_tags
from {ONE} o join {JOBS} j on j.id = o.id join {ASSESS} a using (job_id)
where o.rn = 1 and a.recommendation in ('accept', 'repair')
"""


def recommendation_counts(spark, d):
    return assessments(spark, d).groupBy(F.coalesce("recommendation", F.lit("none")).alias("recommendation")).agg(F.count("*").alias("n"))


RECOMMENDATIONS = f"select coalesce(recommendation, 'none') as recommendation, count(*) as n from {ASSESS} group by 1"


def unusable_responses(spark, d):
    raw = table(spark, d, "critic_responses")
    text = F.regexp_extract(F.coalesce("output_text", F.lit("")), r"(?s)\{.*\}", 0)
    why = F.when(~T.is_blank(F.col("error")), "error").when(text == "", "no json").when(F.try_parse_json(text).isNull(), "broken json")
    return raw.select("response_id", why.alias("reason")).filter("reason is not null")


UNUSABLE = """
select response_id, reason from (select response_id, case when trim(coalesce(error, '')) <> '' then 'error' when t = '' then 'no json' when not json_valid(t) then 'broken json' end as reason
from (select response_id, error, regexp_extract(coalesce(output_text, ''), '(?s)\\{.*\\}', 0) as t from critic_responses)) where reason is not null
"""


def score_gate(spark, d):
    """Assessments whose scores are all at least 4."""
    return assessments(spark, d).filter("scores is not null and size(scores) > 0").select("job_id", F.forall(F.map_values("scores"), lambda v: F.coalesce(v >= 4, F.lit(False))).alias("passes"), F.size("scores").cast("long").alias("n_scores"))


SCORE_GATE = f"""
select job_id, bool_and(coalesce(try_cast(json_extract_string(doc, '$.scores.' || k) as int) >= 4, false)) as passes, count(*) as n_scores
from (select job_id, doc, unnest(json_keys(doc, '$.scores')) as k from {ASSESS}) group by job_id
"""


def key_set_mismatch(spark, d):
    return K.key_mismatch(table(spark, d, "critic_jobs").select("job_id"), table(spark, d, "critic_responses").select("job_id"), "job_id")


KEY_MISMATCH = """
select job_id, case when b is null then 'left only' else 'right only' end as side from (select distinct job_id, 1 as a from critic_jobs) full outer join (select distinct job_id, 1 as b from critic_responses) using (job_id) where a is null or b is null
"""


def unknown_job_records(spark, d):
    jobs = table(spark, d, "critic_jobs").select("job_id", F.col("source_record_id").alias("id"))
    return K.unmatched(jobs, table(spark, d, "sft_records").select("id"), "id").select("job_id", "id")


UNKNOWN_JOBS = "select job_id, source_record_id as id from critic_jobs j where not exists (select 1 from sft_records s where s.id = j.source_record_id)"


def unreviewed_records(spark, d):
    return K.unmatched(one_record(spark, d).select("id"), table(spark, d, "review_rows").select("id"), "id")


UNREVIEWED = f"select id from {ONE} o where rn = 1 and not exists (select 1 from review_rows r where r.id = o.id)"


def unknown_reviews(spark, d):
    """Reviews of ids that no record has; blank ids are reported apart by duplicate_review_keys."""
    rows = table(spark, d, "review_rows").select(F.nullif(T.strip(F.col("id")), F.lit("")).alias("id"), "reviewed_at").filter("id is not null")
    return K.unmatched(rows, table(spark, d, "sft_records").select("id"), "id")


UNKNOWN_REVIEWS = "select id, reviewed_at from (select nullif(regexp_replace(id, '^\\s+|\\s+$', '', 'g'), '') as id, reviewed_at from review_rows) r where id is not null and not exists (select 1 from sft_records s where s.id = r.id)"


def duplicate_review_keys(spark, d):
    return K.duplicate_keys(table(spark, d, "review_rows").select(F.nullif(T.strip(F.col("id")), F.lit("")).alias("id")), "id")


DUPLICATE_REVIEWS = "select id, count(*) as n from (select nullif(trim(id), '') as id from review_rows) group by id having count(*) > 1 or id is null"


def review_scores(spark, d):
    rows = table(spark, d, "review_rows")
    names = ("correctness_1_5", "naturalness_1_5", "helpfulness_1_5")
    whole = [T.try_int(F.col(c)) for c in names]
    bad = F.concat_ws("; ", *[F.when(v.isNull(), F.lit(f"{c} is no whole number")).when((v < 1) | (v > 5), F.lit(f"{c} out of range")) for c, v in zip(names, whole)])
    return rows.select("id", "reviewed_at", *[v.alias(c[:-4]) for c, v in zip(names, whole)], bad.alias("errors"))


def _score_sql(c: str) -> str:
    v = f"case when regexp_matches({c}, '^\\s*[+-]?\\d{{1,9}}\\s*$') then cast(trim({c}) as int) end"
    return v


_NAMES = ("correctness_1_5", "naturalness_1_5", "helpfulness_1_5")
REVIEW_SCORES = (
    "select id, reviewed_at, "
    + ", ".join(f"{_score_sql(c)} as {c[:-4]}" for c in _NAMES)
    + ", concat_ws('; ', "
    + ", ".join(f"case when ({_score_sql(c)}) is null then '{c} is no whole number' when ({_score_sql(c)}) not between 1 and 5 then '{c} out of range' end" for c in _NAMES)
    + ") as errors from review_rows"
)


def review_tags(spark, d):
    """One row per review and tag, whatever separates the tags."""
    tags = F.explode(F.split(F.lower("failure_tags"), r"[,;|/]+"))
    rows = table(spark, d, "review_rows").select("id", "reviewed_at", tags.alias("tag")).withColumn("tag", T.strip(F.col("tag"))).filter("tag <> ''")
    return rows.groupBy("tag").agg(F.count("*").alias("n"))


REVIEW_TAGS = "select tag, count(*) as n from (select trim(unnest(regexp_split_to_array(lower(failure_tags), '[,;|/]+'))) as tag from review_rows) where tag <> '' group by tag"


_NOTES = (("correctness", "correctness_1_5"), ("naturalness", "naturalness_1_5"), ("helpfulness", "helpfulness_1_5"), ("failure_tags", "failure_tags"), ("reviewer", "reviewer"), ("notes", "r_notes"))


def approved_promotion(spark, d):
    """Records with an approved review that names its reviewer, has no tags and scores of 4 or 5, with the notes rebuilt."""
    rows = table(spark, d, "review_rows").filter("id is not null and review_status = 'approved'")
    last = K.latest(rows, ["id"], [F.col("reviewed_at"), F.coalesce("reviewer", F.lit("")), F.coalesce("reviewer_notes", F.lit(""))])
    high = [F.coalesce(T.try_int(F.col(c)).between(4, 5), F.lit(False)) for c in _NAMES]
    fit = last.filter(~T.is_blank(F.col("reviewer")) & T.is_blank(F.col("failure_tags")) & high[0] & high[1] & high[2]).withColumnRenamed("reviewer_notes", "r_notes")
    part = lambda k, c: F.when(~T.is_blank(F.col(c)), F.concat(F.lit(f"{k}="), T.strip(F.col(c))))
    notes = F.coalesce(F.nullif(F.concat_ws("; ", *[part(k, c) for k, c in _NOTES]), F.lit("")), F.lit("approved by reviewer"))
    return one_record(spark, d).select("id", "task_type").join(fit.select("id", notes.alias("notes")), "id")


def _trimmed(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"


_PARTS = ", ".join(f"case when {_trimmed(c)} <> '' then '{k}=' || {_trimmed(c)} end" for k, c in ((k, "r.reviewer_notes" if c == "r_notes" else c) for k, c in _NOTES))
_HIGH = " and ".join(f"coalesce(try_cast({_trimmed(c)} as int) between 4 and 5 and regexp_matches({_trimmed(c)}, '^[+-]?\\d+$'), false)" for c in _NAMES)
PROMOTION = f"""
select o.id, o.task_type, coalesce(nullif(concat_ws('; ', {_PARTS}), ''), 'approved by reviewer') as notes
from {ONE} o join (select *, row_number() over (partition by id order by reviewed_at desc nulls last, coalesce(reviewer, '') desc, coalesce(reviewer_notes, '') desc) as k from review_rows where id is not null and review_status = 'approved') r on r.id = o.id and r.k = 1
where o.rn = 1 and {_trimmed('reviewer')} <> '' and {_trimmed('failure_tags')} = '' and {_HIGH}
"""


#: The critic's priorities, and what a reviewer's flag may say.
PRIORITIES = {"accept": "critic accepted", "repair": "repair first"}
REVISION_FLAGS = ("accept revision", "apply revision", "revision", "use revision", "use suggested revision")
WITHHOLD_FLAGS = ("needs fix", "not sure", "reject", "rejected", "skip")


def reviewed_decision(priority, flag, revision, accept_disputed: bool = False):
    """original, revision or withheld, or the error of a review: which text of a conversation its reviewer approved."""
    said, first = F.lower(T.strip(F.coalesce(flag, F.lit("")))), F.lower(T.strip(F.coalesce(priority, F.lit(""))))
    disputed = F.lit(not accept_disputed) & (first == "repair first")
    return (
        F.when(~first.isin(*PRIORITIES.values()), F.concat(F.lit("error: unknown priority "), first))
        .when(said == "keep", F.when(disputed, "withheld").otherwise("original"))
        .when(said.isin(*REVISION_FLAGS), F.when(T.is_blank(revision), "error: no revision").otherwise("revision"))
        .when(said.isin(*WITHHOLD_FLAGS) | (said == ""), "withheld")
        .otherwise(F.concat(F.lit("error: unknown flag "), said))
    )


#: The task type of each family stem; other families are an error.
FAMILY_TYPES = {
    "dialogue": "dialogue", "sentence-correction": "sentence-correction", "translation-en-rw": "translation-en-rw", "grammar-explanation": "grammar-explanation",
    "pronunciation": "pronunciation", "reading-comprehension": "reading-comprehension", "vocabulary": "vocabulary", "culture-register": "culture-register",
    "code-switching": "culture-register", "sentence-generation": "sentence-generation", "uncertainty": "uncertainty",
}


def reviewed_rows(spark, d):
    """(id, recommendation, review_status, decision, task_type) of reviews of records that have a critic's decision.

    An approved review keeps the record, or its revision where the notes speak of a fix; other words stand as flags.
    """
    rows = table(spark, d, "review_rows").filter("id is not null").select("id", "review_status", "reviewer_notes")
    critic = last_jobs(spark, d).join(assessments(spark, d), "job_id").select("id", "recommendation", "revised")
    fix = (F.col("recommendation") == "repair") & F.coalesce(F.col("reviewer_notes").like("%fix%"), F.lit(False))
    flag = F.when(F.col("review_status") == "approved", F.when(fix, "use revision").otherwise("keep")).otherwise(F.replace("review_status", F.lit("-"), F.lit(" ")))
    priority = F.when(F.col("recommendation") == "accept", PRIORITIES["accept"]).when(F.col("recommendation") == "repair", PRIORITIES["repair"]).otherwise(F.col("recommendation"))
    stem = F.regexp_replace("task_family", "-(?:basic|usage|multi)$", "")
    types = F.create_map(*[F.lit(x) for pair in FAMILY_TYPES.items() for x in pair])
    kind = one_record(spark, d).select("id", F.coalesce(types[stem], F.lit("error: unknown family")).alias("task_type"))
    return rows.join(critic, "id").join(kind, "id").select("id", "recommendation", "review_status", reviewed_decision(priority, flag, F.col("revised")).alias("decision"), "task_type")


def reviewer_decisions(spark, d):
    return reviewed_rows(spark, d).groupBy("recommendation", "review_status", "decision").agg(F.count("*").alias("n"))


def converted_reviews(spark, d):
    """Counts of reviewed rows by what becomes of them: approved text and its task type, withheld, or an error."""
    bad = F.col("decision").startswith("error") | F.col("decision").isin("original", "revision") & F.col("task_type").startswith("error")
    outcome = F.when(bad, F.when(F.col("decision").startswith("error"), F.col("decision")).otherwise(F.col("task_type"))).otherwise(F.col("decision"))
    kind = F.when(outcome.isin("original", "revision"), F.col("task_type"))
    return reviewed_rows(spark, d).select(outcome.alias("outcome"), kind.alias("task_type")).groupBy("outcome", "task_type").agg(F.count("*").alias("n"))


_FAMILY = "case regexp_replace(o.task_family, '-(basic|usage|multi)$', '') " + " ".join(f"when '{k}' then '{v}'" for k, v in FAMILY_TYPES.items()) + " else 'error: unknown family' end"
REVIEWED = f"""(
select id, recommendation, review_status, case
  when p not in ('critic accepted', 'repair first') then 'error: unknown priority ' || p
  when f = 'keep' then case when p = 'repair first' then 'withheld' else 'original' end
  when f = 'use revision' then case when coalesce(revised, '') = '' then 'error: no revision' else 'revision' end
  when f in ('needs fix', 'not sure', 'reject', 'rejected', 'skip', '') then 'withheld' else 'error: unknown flag ' || f end as decision, task_type
from (select r.id, a.recommendation, r.review_status, json_extract_string(a.doc, '$.revised_messages') as revised, {_FAMILY} as task_type,
    coalesce(case a.recommendation when 'accept' then 'critic accepted' when 'repair' then 'repair first' else lower(a.recommendation) end, '') as p,
    case when r.review_status = 'approved' then case when a.recommendation = 'repair' and coalesce(r.reviewer_notes, '') like '%fix%' then 'use revision' else 'keep' end else lower(replace(coalesce(r.review_status, ''), '-', ' ')) end as f
  from review_rows r join {JOBS} j on j.id = r.id join {ASSESS} a using (job_id) join {ONE} o on o.id = r.id and o.rn = 1))"""
DECISIONS = f"select recommendation, review_status, decision, count(*) as n from {REVIEWED} group by 1, 2, 3"
CONVERTED = f"""
select outcome, case when outcome in ('original', 'revision') then task_type end as task_type, count(*) as n
from (select case when decision in ('original', 'revision') and task_type like 'error%' then task_type else decision end as outcome, task_type from {REVIEWED}) group by 1, 2
"""


def id_pattern_validation(spark, d):
    """Reviews in order of time: bad ids, and well-formed ids met before."""
    from pyspark.sql.window import Window

    rows = table(spark, d, "review_rows").select("id", "reviewed_at", "reviewer_notes")
    good = T.is_record_id(F.col("id"))
    k = F.row_number().over(Window.partitionBy("id").orderBy("reviewed_at", F.coalesce("reviewer_notes", F.lit(""))))
    return rows.select("id", "reviewed_at", F.when(~good, "bad id").when(k > 1, "repeated id").alias("error")).filter("error is not null")


ID_PATTERN = """
select id, reviewed_at, error from (select id, reviewed_at, case when not coalesce(regexp_matches(id, '^[a-z0-9][a-z0-9-]{2,}$'), false) then 'bad id'
  when row_number() over (partition by id order by reviewed_at nulls first, coalesce(reviewer_notes, '')) > 1 then 'repeated id' end as error from review_rows) where error is not null
"""

QUERIES = {
    "critic_join_selection": critic_join_selection, "recommendation_counts": recommendation_counts, "unusable_responses": unusable_responses,
    "score_gate": score_gate, "key_set_mismatch": key_set_mismatch, "unknown_job_records": unknown_job_records, "unreviewed_records": unreviewed_records, "unknown_reviews": unknown_reviews,
    "duplicate_review_keys": duplicate_review_keys, "review_scores": review_scores, "review_tags": review_tags,
    "approved_promotion": approved_promotion, "reviewer_decision_matrix": reviewer_decisions, "converted_reviews": converted_reviews, "id_pattern_validation": id_pattern_validation,
}
ORACLES = {
    "critic_join_selection": CRITIC_SELECTION, "recommendation_counts": RECOMMENDATIONS, "unusable_responses": UNUSABLE, "score_gate": SCORE_GATE,
    "key_set_mismatch": KEY_MISMATCH, "unknown_job_records": UNKNOWN_JOBS, "unreviewed_records": UNREVIEWED, "unknown_reviews": UNKNOWN_REVIEWS, "duplicate_review_keys": DUPLICATE_REVIEWS,
    "review_scores": REVIEW_SCORES, "review_tags": REVIEW_TAGS, "approved_promotion": PROMOTION, "reviewer_decision_matrix": DECISIONS, "converted_reviews": CONVERTED,
    "id_pattern_validation": ID_PATTERN,
}
