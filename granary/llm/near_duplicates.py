"""Problem 3: near-duplicate records with small edits, by token-combination prefixes.

Exact copies are one class, of which the smallest id is the representative. Representatives are indexed by the rare tokens
and the pairs of frequent tokens of one class in their extended prefixes (granary.llm.prefixes); those that share one, at
sizes for which it lies in both prefixes, and whose sketches allow the similarity, are verified word by word. Nothing is
sampled and no posting is capped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.prefixes import INDEX, SKETCH, Order, WordHashes, buckets_of, index_batch, meeting_pairs, token_hashes
from granary.llm.similar import RECORD, SIMILARITY, TOGETHER, record_words, small_or_shuffled, verified
from granary.operators.components import connected_components
from granary.session import written

#: Members of a class of exact copies up to which all pairs are written; beyond, each copy is linked to the smallest id.
COPIES = 64


def class_table(records: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Members (id, rep, copies) of the classes of several copies, the representatives' word table, and token counts.

    The representative of a class is its smallest id.
    """
    table, counts = record_words(records)
    texts = table.filter(F.col("kind") == RECORD)
    groups = texts.groupBy("h1", "h2").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    # Only the classes of several copies need a join, and their keys alone; the others are their own representatives.
    several = written(groups.filter("copies > 1"))
    inside = written(texts.select("key", "rid", "h1", "h2").join(small_or_shuffled(several), ["h1", "h2"]).select(F.col("key").alias("id"), "rid", "rep", "copies"))
    reps = texts.join(small_or_shuffled(written(inside.filter("id <> rep").select("rid"))), "rid", "left_anti")
    return inside.drop("rid"), reps, counts


def prefix_index(texts: DataFrame, order: Order, t: float = SIMILARITY) -> DataFrame:
    """The index (bucket, rows) of the texts of a word table."""
    held, buckets = texts.sparkSession.sparkContext.broadcast(order), buckets_of(texts)

    def run(batches):
        order, hashes = held.value, WordHashes()
        for b in (b.slice(k, TOGETHER) for b in batches for k in range(0, b.num_rows, TOGETHER)):
            h, size = token_hashes([said.split("\n") for said in b.column("said").to_pylist()], hashes)
            yield index_batch(b, *order.rows(h, size, t), np.zeros(b.num_rows, np.int64), t, buckets)

    return texts.select("rid", "said", "n", *SKETCH).mapInArrow(run, INDEX)


def candidate_pairs(reps: DataFrame, counts: np.ndarray, t: float = SIMILARITY) -> DataFrame:
    """(a, b): rids of representatives that share a combination and may be similar."""
    return written(meeting_pairs(prefix_index(reps, Order(counts), t), t).distinct())


def class_links(records: DataFrame, t: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members of the classes of copies, (a, b, similarity) of the similar representatives, and the representatives."""
    inside, reps, counts = class_table(records)
    found = written(verified(candidate_pairs(reps, counts, t), reps, ["key"], t))
    return inside, found.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"), "similarity"), reps


def near_duplicate_pairs(records: DataFrame, t: float = SIMILARITY, copies: int = COPIES) -> DataFrame:
    """(id_a, id_b), id_a < id_b: ids whose records have a similarity of at least t.

    Exact copies of up to `copies` members are written as all pairs; in a larger class every member is paired with the
    class's smallest id, and links to other classes run through that id, so no link between different texts is lost and
    a hot class gives no quadratic result. Null messages and texts without words are similar to nothing; repeated
    deliveries are one record; an empty table gives no rows.
    """
    inside, pairs, _ = class_links(records, t)
    small = inside.filter(F.col("copies") <= copies)
    same = small.alias("x").join(small.alias("y"), (F.col("x.rep") == F.col("y.rep")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
    star = inside.filter((F.col("copies") > copies) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
    ends = small.select(F.col("rep"), "id")
    left = pairs.join(ends.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a", "left").select(F.coalesce("x", "a").alias("x"), "b")
    both = left.join(ends.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b", "left").select("x", F.coalesce("y", "b").alias("y"))
    across = both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return same.unionByName(star).unionByName(across)


def near_duplicate_groups(records: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """(id, class_id, group_id, links) of every id with words: its class of copies, its group, its links to other texts."""
    inside, pairs, reps = class_links(records, t)
    found = connected_components(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    links = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    every = reps.select(F.col("key").alias("id"), F.col("key").alias("rep")).unionByName(inside.filter("id <> rep").select("id", "rep"))
    tagged = every.join(found.select(F.col("node").alias("rep"), F.col("component").alias("group_id")), "rep", "left").join(links, "rep", "left")
    return tagged.select("id", F.col("rep").alias("class_id"), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
