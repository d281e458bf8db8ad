"""Queries of the training-data operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import grouped_splits, language, leakage, near_duplicates, packing, pair_defects, sentences, split_overlap
from granary.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects.broken_pairs(table(spark, d, "sft_records"))


def p1_pair_tags(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects.tagged_pairs(table(spark, d, "sft_records"))


def p1_defect_counts(spark: SparkSession, d: str) -> DataFrame:
    found = pair_defects.tagged_pairs(table(spark, d, "sft_records"))
    return found.groupBy(F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("pairs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_labels(table(spark, d, "chat_requests"))


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.request_segments(table(spark, d, "chat_requests")).drop("language")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, d, "sft_records"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, d, "sft_records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_pairs(table(spark, d, "sft_records"), table(spark, d, "tutor_tasks"))


def p4_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlaps(table(spark, d, "sft_records"), table(spark, d, "tutor_tasks"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_report(table(spark, d, "sft_records"), table(spark, d, "tutor_tasks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return grouped_splits.torn_groups(table(spark, d, "sft_records"))


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    return grouped_splits.assign_splits(grouped_splits.record_components(table(spark, d, "sft_records")))


def p6_windows(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p6_instruction_windows(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_instructions(table(spark, d, "sft_records"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack_documents(table(spark, d, "documents")), packing.Limits())


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are placed whole, and windows that break a limit."""
    limits = packing.Limits()
    rows = packing.pack_documents(table(spark, d, "documents"), limits)
    by = rows.groupBy("window_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("s"), F.sum("loss_tokens").alias("l"))
    over = by.agg(*[F.sum((F.col(c) > most).cast("long")).alias(n) for c, most, n in (("t", limits.tokens, "over_tokens"), ("s", limits.segments, "over_segments"), ("l", limits.loss_tokens, "over_loss"))])
    docs = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("piece_no").alias("last"), F.max(F.col("start_token") + F.col("tokens")).alias("end"), F.sum("tokens").alias("t"))
    whole = docs.agg(F.count("*").alias("placed"), F.sum(((F.col("n") != F.col("last") + 1) | (F.col("end") != F.col("t"))).cast("long")).alias("torn"))
    return whole.withColumn("one", F.lit(1)).join(over.withColumn("one", F.lit(1)), "one").drop("one")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "heldout_items")).select("doc_id", "item_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "heldout_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("most_words"), F.sum((F.col("question_share") >= 0.8).cast("long")).alias("with_question"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_pair_tags, p1_defect_counts, p2_found, p2_segments, p3_found, p3_groups, p4_found, p4_overlaps, p4_report,
        p5_found, p5_splits, p6_windows, p6_instruction_windows, p6_fill, p6_invariants, p7_found, p7_report, p8_found,
    )
}

#: Components by a recursive walk over shared keys: small tables only, and so for the one query whose rule is plain.
_KEYS = " union all ".join(
    f"select distinct id, {n} as field, regexp_replace(lower({k}), '[^\\p{{L}}\\p{{N}}]+', '', 'g') as k from sft_records where id is not null and {k} is not null" for n, k in enumerate(grouped_splits.KEYS)
)
_UNKNOWN = ", ".join(f"'{v}'" for v in grouped_splits.NOT_KNOWN)
P5_FOUND_SQL = f"""
with recursive keys as (select * from ({_KEYS}) where k not in ({_UNKNOWN})),
stars as (select id, min(id) over (partition by field, k) as hub from keys),
edges as (select distinct id as a, hub as b from stars where id <> hub union select distinct hub, id from stars where id <> hub),
walk(root, id) as (
  select distinct a, a from edges
  union
  select walk.root, edges.b from walk join edges on edges.a = walk.id
),
groups as (select id, min(root) as group_id from walk group by id),
classes as (
  select distinct id, case lower(trim(split)) when 'train' then 1 when 'experimental-train' then 1 when 'validation' then 2
    when 'experimental-validation' then 2 when 'benchmark-only' then 3 end as c from sft_records where id is not null
),
torn as (select group_id from groups join classes using (id) where c is not null group by group_id having count(distinct c) > 1)
select group_id, id from groups where group_id in (select group_id from torn)
"""

#: Brute force over all pairs of texts that share a word: the words of each text with the number of their occurrence.
_ONCE = "(select id, lower(trim(split)) as split, messages from (select *, row_number() over (partition by id order by ingested_at nulls last) as k from sft_records where id is not null) where k = 1)"
_SAID = "unnest(regexp_extract_all(lower(nfc_normalize(regexp_replace(m.content, '\\p{Cf}+', '', 'g'))), '[\\p{L}\\p{N}]+'))"
_TOKENS = f"""
texts as (select id, split, unnest(messages) as m from {_ONCE}),
words as (select id, split, {_SAID} as w from texts where m.role in ('user', 'assistant')),
tokens as (select id, split, w, row_number() over (partition by id, w) as k from words),
sizes as (select id, count(*) as n from tokens group by id)"""
P3_FOUND_SQL = f"""
with {_TOKENS},
pairs as (select a.id as id_a, b.id as id_b, count(*) as s from tokens a join tokens b on a.w = b.w and a.k = b.k and a.id < b.id group by 1, 2)
select id_a, id_b from pairs join sizes x on x.id = id_a join sizes y on y.id = id_b where s >= 0.7 * (x.n + y.n - s) - 1e-9
"""
P4_FOUND_SQL = f"""
with {_TOKENS},
pairs as (select a.id as x, b.id as y, count(*) as s from tokens a join tokens b on a.w = b.w and a.k = b.k where a.split in ('train', 'experimental-train') and b.split in ('validation', 'experimental-validation', 'benchmark-only') group by 1, 2),
lines as (select id, row_number() over () as line, m from texts where m.role = 'user' and split in ('train', 'experimental-train')),
lw as (select id, line, {_SAID} as w from lines),
lt as (select id, line, w, row_number() over (partition by line, w) as k, count(*) over (partition by line) as n from lw),
asked as (select id as task, struct_pack(content := prompt) as m from tutor_tasks where lower(trim(split)) = 'benchmark-only'),
aw as (select task, {_SAID} as w from asked),
at_ as (select task, w, row_number() over (partition by task, w) as k, count(*) over (partition by task) as n from aw),
prompts as (select task as x, id as y, line, count(*) as s, any_value(at_.n) as a, any_value(lt.n) as b from at_ join lt on at_.w = lt.w and at_.k = lt.k group by 1, 2, 3),
found as (select x, y from pairs join sizes p on p.id = x join sizes q on q.id = y where s >= 0.7 * (p.n + q.n - s) - 1e-9 union select x, y from prompts where s >= 0.7 * (a + b - s) - 1e-9)
select distinct least(x, y) as key_a, greatest(x, y) as key_b from found
"""

P6_INVARIANTS_SQL = "select count(*) as placed, cast(0 as bigint) as torn, cast(0 as bigint) as over_tokens, cast(0 as bigint) as over_segments, cast(0 as bigint) as over_loss from documents where length(text) > 0"

ORACLES: dict[str, str] = {"p6_invariants": P6_INVARIANTS_SQL, "p3_found": P3_FOUND_SQL, "p4_found": P4_FOUND_SQL, "p5_found": P5_FOUND_SQL}
