"""Queries over documents and carriers: normal forms, duplicates, splits, shards, statistics, templates, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions import text as T
from granary.operators import keyed as K
from granary.operators import metrics as M
from granary.operators import order as O
from granary.operators.components import connected_components, star_edges
from granary.session import table

NORM = "trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}_]+', ' ', 'g'))"


def _docs(spark, d):
    return table(spark, d, "documents")


def normalized_text_hash(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(T.leakage_text(F.col("text")), 256).alias("text_hash"))


NORMALIZED = f"select doc_id, sha256({NORM}) as text_hash from documents"


def draft_text_hash(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(T.draft_text(F.col("text")), 256).alias("text_hash"))


DRAFT_TEXT = "select doc_id, sha256(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) as text_hash from documents"


def exact_duplicate_groups(spark, d):
    rows = _docs(spark, d).select("doc_id", F.sha2(T.leakage_text(F.col("text")), 256).alias("text_hash"))
    return rows.groupBy("text_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("n > 1 and text_hash is not null")


DUPLICATES = f"select sha256({NORM}) as text_hash, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from documents where text is not null group by 1 having count(*) > 1"


def dedup_keep_first(spark, d):
    rows = K.keep_first(_docs(spark, d).select("doc_id", "text", "source"), F.sha2(T.leakage_text(F.col("text")), 256), "doc_id")
    return rows.filter("duplicate_of is null").select("doc_id", "source")


DEDUP = f"select doc_id, source from (select doc_id, source, text, row_number() over (partition by sha256({NORM}) order by doc_id) as k from documents) where k = 1 or text is null"


def dropped_duplicates_map(spark, d):
    rows = K.keep_first(_docs(spark, d).select("doc_id", "text"), F.sha2(T.leakage_text(F.col("text")), 256), "doc_id")
    return rows.filter("duplicate_of is not null").select("doc_id", "duplicate_of")


DROPPED = f"select doc_id, f as duplicate_of from (select doc_id, first_value(doc_id) over (partition by sha256({NORM}) order by doc_id) as f from documents where text is not null) where doc_id <> f"


#: What a grouping key says when it is not known, after case and all but letters and digits are removed.
NOT_KNOWN = (
    "", "na", "none", "null", "nil", "nan", "unknown", "notknown", "unk", "tbd", "tba", "tbc", "undefined", "und",
    "unspecified", "notspecified", "missing", "notavailable", "notapplicable", "empty", "blank", "pending", "nodata",
    "notgiven", "notset", "unset", "untitled", "inconnu", "ntakizwi", "haijulikani", "ntibizwi",
)
GROUPING_KEYS = ("content_key", "source_group_id", "source_document_id")


def _keyed(rows):
    """(id, field, key) of the known grouping keys, whatever their spelling."""
    said = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    named = F.array(*[F.struct(F.lit(k).alias("field"), said(F.col(k)).alias("key")) for k in GROUPING_KEYS])
    return rows.select("id", F.inline(named)).filter(F.col("key").isNotNull() & ~F.col("key").isin(*NOT_KNOWN))


def connected_records(spark, d):
    """(id, group_id) of the ids that share a known grouping key with another, directly or through others."""
    rows = table(spark, d, "sft_records").filter("id is not null")
    return connected_components(star_edges(_keyed(rows), "id", ["field", "key"])).select(F.col("node").alias("id"), F.col("component").alias("group_id"))


_UNKNOWN = ", ".join(f"'{v}'" for v in NOT_KNOWN)
_KEYS = "(" + " union ".join(f"select id, {n} as field, regexp_replace(lower({k}), '[^\\p{{L}}\\p{{N}}]+', '', 'g') as k from sft_records where id is not null and {k} is not null" for n, k in enumerate(GROUPING_KEYS)) + ")"
CONNECTED = f"""
with recursive s as (select id, min(id) over (partition by field, k) as hub from {_KEYS} where k not in ({_UNKNOWN})),
e as (select distinct id as a, hub as b from s where id <> hub union select distinct hub, id from s where id <> hub),
w(root, id) as (select distinct a, a from e union select w.root, e.b from w join e on e.a = w.id)
select id, min(root) as group_id from w group by id
"""


def component_count(spark, d):
    """Connected groups, the ids in them, and the largest of them."""
    sizes = connected_records(spark, d).groupBy("group_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("ids"), F.max("n").alias("largest"))


COMPONENT_COUNT = f"select count(*) as groups, cast(coalesce(sum(n), 0) as bigint) as ids, max(n) as largest from (select group_id, count(*) as n from ({CONNECTED}) group by 1)"


def connected_records_any_key(spark, d):
    """(id, group_id) of every id: the smallest id of those it shares any grouping key with, directly or through others.

    Keys are the known values of the three fields, whatever their spelling, and the normal forms of each user and each
    assistant message. No record is left out: one that shares nothing is its own group.
    """
    rows = table(spark, d, "sft_records").filter("id is not null")
    texts = rows.select("id", F.inline(F.transform("messages", lambda m: F.struct(m["role"].alias("field"), T.leakage_text(m["content"]).alias("key")))))
    texts = texts.filter("field in ('user', 'assistant') and key <> ''").withColumn("key", F.sha2("key", 256))
    found = connected_components(star_edges(_keyed(rows).unionByName(texts), "id", ["field", "key"]))
    ids = rows.select("id").distinct().join(found.select(F.col("node").alias("id"), "component"), "id", "left")
    return ids.select("id", F.coalesce("component", "id").alias("group_id"))


def grouped_split(spark, d):
    groups = _docs(spark, d).groupBy(F.coalesce("source", F.lit("none")).alias("group_id")).agg(F.count("*").alias("n"))
    return O.ordered_fill(groups, 0.9, "split").select("group_id", "n", "split")


GROUPED_SPLIT = """
with recursive g as (select coalesce(source, 'none') as group_id, count(*) as n from documents group by 1),
o as (select *, row_number() over (order by sha256('split:' || group_id)) as k from g),
q as (select cast(floor(sum(n) * 0.9) as bigint) as quota from g),
f(k, group_id, n, used, taken) as (
  select k, group_id, n, case when n <= quota then n else 0 end, n <= quota from o, q where k = 1
  union all select o.k, o.group_id, o.n, f.used + case when f.used + o.n <= quota then o.n else 0 end, f.used + o.n <= quota from f join o on o.k = f.k + 1, q)
select group_id, n, case when taken then 'train' else 'validation' end as split from f
"""


def hash_bucket_split(spark, d):
    rows = _docs(spark, d).select("doc_id", T.hash_fraction(F.col("doc_id").cast("string")).alias("share"))
    return rows.select("doc_id", F.when(F.col("share") < 0.9, "train").otherwise("validation").alias("split"))


HASH_SPLIT = "select doc_id, case when cast('0x' || substr(sha1(cast(doc_id as varchar)), 1, 8) as bigint) / 4294967295.0 < 0.9 then 'train' else 'validation' end as split from documents"


def positional_split(spark, d):
    return O.first_share(_docs(spark, d).filter("source_status = 'approved'").select("doc_id"), 0.9, "doc_id").select("doc_id", "split")


POSITIONAL = "select doc_id, case when row_number() over (order by doc_id) <= cast(floor(count(*) over () * 0.9) as bigint) then 'train' else 'validation' end as split from documents where source_status = 'approved'"


def round_robin_shards(spark, d):
    return O.round_robin(_docs(spark, d).select("doc_id"), 7, "doc_id").select("doc_id", F.col("shard").cast("long").alias("shard"))


ROUND_ROBIN = "select doc_id, (row_number() over (order by doc_id) - 1) % 7 as shard from documents"


def seeded_hash_shuffle(spark, d):
    rows = O.with_ordinal(_docs(spark, d).select("doc_id").withColumn("h", O.salted_order(F.col("doc_id"), "shuffle")), "h", "doc_id")
    return rows.select("doc_id", F.concat(F.lit("draft-"), F.lpad((F.col("ordinal") + 1).cast("string"), 6, "0")).alias("draft_id"))


SHUFFLE = "select doc_id, 'draft-' || lpad(cast(row_number() over (order by sha256('shuffle:' || doc_id), doc_id) as varchar), 6, '0') as draft_id from documents"


def _tokenized(spark, d):
    return M.tokenization(_docs(spark, d).select("doc_id", "lang", "text").filter("text is not null"), "text", F.size(F.regexp_extract_all(F.col("text"), F.lit(r"\p{L}{1,4}|\p{N}|[^\s\p{L}\p{N}]"), 0)))


TOKENIZED = "(select doc_id, lang, text, len(regexp_extract_all(text, '\\p{L}+(?:[''’-]\\p{L}+)*')) as words, length(text) as chars, len(regexp_extract_all(text, '\\p{L}{1,4}|\\p{N}|[^\\s\\p{L}\\p{N}]')) as tokens from documents where text is not null)"


def word_stats(spark, d):
    return _tokenized(spark, d).select("doc_id", "words", "chars", "tokens", F.round("tokens_per_word", 6).alias("tokens_per_word"), F.round("tokens_per_char", 6).alias("tokens_per_char"))


WORD_STATS = f"select doc_id, words, chars, tokens, round(case when words = 0 then 0 else tokens / words end, 6) as tokens_per_word, round(case when chars = 0 then 0 else tokens / chars end, 6) as tokens_per_char from {TOKENIZED}"


def corpus_ratio_by_lang(spark, d):
    return M.ratio_by_group(_tokenized(spark, d), "lang")


RATIO = f"""
select case when grouping(lang) = 1 then 'all' else coalesce(lang, 'none') end as lang, count(*) as texts, cast(sum(words) as bigint) as words, cast(sum(tokens) as bigint) as tokens,
  round(case when sum(words) = 0 then 0 else sum(tokens) / sum(words) end, 6) as tokens_per_word from {TOKENIZED} group by grouping sets ((lang), ())
"""


def most_fragmented(spark, d):
    rows = _tokenized(spark, d).groupBy(F.coalesce("lang", F.lit("none")).alias("lang"))
    return rows.agg(F.max_by("doc_id", F.struct("tokens_per_word", F.negative("doc_id"))).alias("doc_id"), F.round(F.max("tokens_per_word"), 6).alias("tokens_per_word"))


FRAGMENTED = f"""
select lang, doc_id, round(r, 6) as tokens_per_word from (select *, row_number() over (partition by lang order by r desc, doc_id) as k
from (select coalesce(lang, 'none') as lang, doc_id, case when words = 0 then 0 else tokens / words end as r from {TOKENIZED})) where k = 1
"""


def category_counts_vs_target(spark, d):
    targets = spark.createDataFrame([("prose", 400), ("lesson", 300), ("dialogue", 200), ("table", 50)], "doc_kind string, target long")
    have = _docs(spark, d).groupBy("doc_kind").agg(F.count("*").alias("n"))
    both = have.join(F.broadcast(targets), "doc_kind", "full_outer")
    return both.select("doc_kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("target", F.lit(0)).alias("target"), (F.coalesce("n", F.lit(0)) - F.coalesce("target", F.lit(0))).alias("over"))


TARGETS = """
select coalesce(h.doc_kind, t.doc_kind) as doc_kind, coalesce(n, 0) as n, coalesce(target, 0) as target, coalesce(n, 0) - coalesce(target, 0) as over
from (select doc_kind, count(*) as n from documents group by 1) h full outer join (values ('prose', 400), ('lesson', 300), ('dialogue', 200), ('table', 50)) t(doc_kind, target) on h.doc_kind = t.doc_kind
"""


def size_class_manifest(spark, d):
    rows = _docs(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.array_join(F.array_sort(F.collect_set("source_status")), ",").alias("statuses"))
    return rows.withColumn("size_class", F.when(F.col("n") < 50, "small").when(F.col("n") < 1000, "medium").otherwise("large"))


SIZE_CLASS = """
select source, count(*) as n, cast(sum(n_chars) as bigint) as chars, coalesce(string_agg(distinct source_status, ',' order by source_status), '') as statuses,
  case when count(*) < 50 then 'small' when count(*) < 1000 then 'medium' else 'large' end as size_class from documents group by 1
"""


def source_first_pass(spark, d):
    status = F.when(F.col("source_status").isNull(), "blocked").when(F.col("source_status") == "investigate", "blocked pending").otherwise("investigate")
    return _docs(spark, d).groupBy("source", status.alias("first_pass")).agg(F.count("*").alias("n"))


FIRST_PASS = "select source, case when source_status is null then 'blocked' when source_status = 'investigate' then 'blocked pending' else 'investigate' end as first_pass, count(*) as n from documents group by 1, 2"


def template_variants(spark, d):
    forms = ("What is a %s?", "Describe the %s.", "Where would you use a %s?")
    variants = F.array(*[F.struct(F.lit(k).alias("variant"), F.replace(F.lit(form), F.lit("%s"), F.col("p_name")).alias("prompt")) for k, form in enumerate(forms, 1)])
    return table(spark, d, "part").select("p_partkey", F.inline(variants))


TEMPLATES = "select p_partkey, variant, replace(form, '%s', p_name) as prompt from part cross join (values (1, 'What is a %s?'), (2, 'Describe the %s.'), (3, 'Where would you use a %s?')) t(variant, form)"


def slug_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", T.stable_id(T.slug(F.col("p_brand")), T.slug(F.col("p_name")), F.col("p_size").cast("string")).alias("part_id"))


SLUGS = "select p_partkey, concat_ws('-', regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), cast(p_size as varchar)) as part_id from part"


def escaped_cells(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(T.table_cell(F.col("text")), 256).alias("cell"), F.sha2(T.html_escape(F.col("text")), 256).alias("html"))


ESCAPED = "select doc_id, sha256(replace(replace(replace(text, '|', '\\|'), chr(13) || chr(10), '\\n'), chr(10), '\\n')) as cell, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) as html from documents"


def events_props_json(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


PROPS = "select event_type, count(k) as n, cast(sum(k) as bigint) as total, max(k) as most from (select event_type, try_cast(json_extract_string(props, '$.k') as bigint) as k from events) group by 1"


def feedback_daily(spark, d):
    rows = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


FEEDBACK = "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, count(distinct user_id) as users from events group by 1, 2"


def last_two_per_group(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return _docs(spark, d).withColumn("k", F.row_number().over(w)).filter("k <= 2").select("source", F.col("k").cast("long").alias("k"), "doc_id", "n_chars")


TOP_TWO = "select source, k, doc_id, n_chars from (select source, doc_id, n_chars, row_number() over (partition by source order by n_chars desc, doc_id) as k from documents) where k <= 2"

QUERIES = {
    "normalized_text_hash": normalized_text_hash, "draft_text_hash": draft_text_hash, "exact_duplicate_groups": exact_duplicate_groups,
    "dedup_keep_first": dedup_keep_first, "dropped_duplicates_map": dropped_duplicates_map, "connected_records": connected_records,
    "connected_records_any_key": connected_records_any_key, "component_count": component_count,
    "grouped_split": grouped_split, "hash_bucket_split": hash_bucket_split, "positional_split": positional_split, "round_robin_shards": round_robin_shards,
    "seeded_hash_shuffle": seeded_hash_shuffle, "word_stats": word_stats, "corpus_ratio_by_lang_with_all": corpus_ratio_by_lang,
    "most_fragmented_example": most_fragmented, "category_counts_vs_target": category_counts_vs_target, "size_class_manifest": size_class_manifest,
    "source_first_pass": source_first_pass, "template_variants": template_variants, "slug_ids": slug_ids, "escaped_cells": escaped_cells,
    "events_props_json": events_props_json, "feedback_daily": feedback_daily, "longest_two_per_source": last_two_per_group,
}
ORACLES = {
    "normalized_text_hash": NORMALIZED, "draft_text_hash": DRAFT_TEXT, "exact_duplicate_groups": DUPLICATES, "dedup_keep_first": DEDUP,
    "dropped_duplicates_map": DROPPED, "connected_records": CONNECTED, "component_count": COMPONENT_COUNT, "grouped_split": GROUPED_SPLIT, "hash_bucket_split": HASH_SPLIT,
    "positional_split": POSITIONAL, "round_robin_shards": ROUND_ROBIN, "seeded_hash_shuffle": SHUFFLE, "word_stats": WORD_STATS,
    "corpus_ratio_by_lang_with_all": RATIO, "most_fragmented_example": FRAGMENTED, "category_counts_vs_target": TARGETS,
    "size_class_manifest": SIZE_CLASS, "source_first_pass": FIRST_PASS, "template_variants": TEMPLATES, "slug_ids": SLUGS,
    "escaped_cells": ESCAPED, "events_props_json": PROPS, "feedback_daily": FEEDBACK, "longest_two_per_source": TOP_TWO,
}
