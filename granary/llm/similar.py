"""Words, sketches and exact similarity of records, shared by the near-duplicate and the cross-split operators.

The similarity of two texts is shared words / all words, both counted with repetition. With the n-th occurrence of a
word as its own token, it is the Jaccard similarity of two sets.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.frames import emit
from granary.functions.words import words
from granary.llm.prefixes import BUCKETS, LONGS, SKETCH, WordHashes, bucket_of, sketches, token_hashes
from granary.session import enough_tasks, written

#: Similarity from which two records are near-duplicates (given by the data's statement of the problem).
SIMILARITY = 0.7
ROLES = ("user", "assistant")
#: Texts that are hashed together.
TOGETHER = 2_000


def similarity(a: list[str], b: list[str]) -> float:
    """Shared words over all words, both with repetition; 0 where both are empty."""
    ca, cb = Counter(a), Counter(b)
    shared = sum(min(n, cb[w]) for w, n in ca.items() if w in cb)
    every = len(a) + len(b) - shared
    return shared / every if every else 0.0


_TABLE = "key string, kind int, said string, n int, h1 long, h2 long, " + ", ".join(f"{s} long" for s in SKETCH)
RECORD, MESSAGE, COUNT = 0, 1, 2
_NAMES = ["key", "kind", "said", "n", "h1", "h2", *SKETCH]


def _word_rows(rows: DataFrame, extra: list[str], messages_of: str | None = None) -> DataFrame:
    """For each row (key, roles, contents, extra) the words of its user and assistant messages, kind RECORD.

    Where the column messages_of is true, each user message is a text of its own besides, kind MESSAGE. Words are parted
    by line ends. Each task adds what it counted of the tokens of records by bucket (h1 the bucket, h2 the count), kind
    COUNT: at most BUCKETS rows.
    """
    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in extra)

    def run(batches):
        hashes, counts, types = WordHashes(), np.zeros(BUCKETS, np.int64), None

        def made(keys, kind, texts, at, batch):
            h, size = token_hashes(texts, hashes)
            s, h1, h2 = sketches(h, size)
            kind = np.array(kind, np.int32)
            counts[:] += np.bincount(bucket_of(h[np.repeat(kind == RECORD, size)]), minlength=BUCKETS)
            own = [pa.array(keys, pa.string()), pa.array(kind), pa.array(["\n".join(ws) for ws in texts], pa.string()), pa.array(size, pa.int32()), pa.array(h1), pa.array(h2), *[pa.array(s[:, k]) for k in range(LONGS)]]
            take = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays(own + [batch.column(c).take(take) for c in extra], names=_NAMES + extra)

        for batch in batches:
            types = [batch.schema.field(c).type for c in extra]
            for b in (batch.slice(k, TOGETHER) for k in range(0, batch.num_rows, TOGETHER)):
                keys, kind, texts, at = [], [], [], []
                own = b.column(messages_of).to_pylist() if messages_of else None
                for n, (key, roles, contents) in enumerate(zip(b.column("key").to_pylist(), b.column("roles").to_pylist(), b.column("contents").to_pylist())):
                    every: list[str] = []
                    for role, c in zip(roles or (), contents or ()):
                        if role in ROLES and c and (ws := words(c)):
                            every += ws
                            if own and own[n] and role == "user":
                                keys.append(key)
                                kind.append(MESSAGE)
                                texts.append(ws)
                                at.append(n)
                    if every:
                        keys.append(key)
                        kind.append(RECORD)
                        texts.append(every)
                        at.append(n)
                if texts:
                    yield made(keys, kind, texts, at, b)
        held = np.flatnonzero(counts)
        if len(held):
            k = len(held)
            zeros = pa.array(np.zeros(k, np.int64))
            own = [pa.nulls(k, pa.string()), pa.array(np.full(k, COUNT, np.int32)), pa.nulls(k, pa.string()), pa.array(np.zeros(k, np.int32)), pa.array(held), pa.array(counts[held]), *[zeros] * LONGS]
            yield pa.RecordBatch.from_arrays(own + [pa.nulls(k, x) for x in types], names=_NAMES + extra)

    return rows.mapInArrow(run, _TABLE + kinds)


def bucket_counts(table: DataFrame) -> np.ndarray:
    """Tokens of each bucket over all records of a word table: BUCKETS numbers, whatever the size of the table."""
    found = table.filter(F.col("kind") == COUNT).groupBy("h1").agg(F.sum("h2").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found.column("h1").to_numpy()] = found.column("n").to_numpy()
    return counts


def record_words(records: DataFrame, extra: dict[str, Column] | None = None, messages_of: Column | None = None) -> tuple[DataFrame, np.ndarray]:
    """The word table of a record table, one delivery of each id, and the counts of its tokens by bucket.

    The table has rid (unique), the columns of _word_rows, and extra. Words are made before anything is shuffled;
    deliveries are told apart by their keys alone, and only the few rows of later deliveries are taken out by a join.
    Texts without words are left out: nothing is similar to them.
    """
    extra = extra or {}
    rows = records.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("key"),
        F.transform("messages", lambda m: m["role"]).alias("roles"),
        F.transform("messages", lambda m: m["content"]).alias("contents"),
        F.col("ingested_at").alias("at"),
        *[c.alias(name) for name, c in extra.items()],
        *([messages_of.alias("own")] if messages_of is not None else []),
    )
    rows = enough_tasks(rows).withColumn("uid", F.monotonically_increasing_id())
    made = _word_rows(rows, ["uid", "at", *extra], "own" if messages_of is not None else None)
    table = written(made.withColumn("rid", F.monotonically_increasing_id()))
    one = table.filter(F.col("kind") == RECORD).select("key", "uid", "at")
    first = one.groupBy("key").agg(F.min_by("uid", F.struct(F.col("at").isNull(), "at", "uid")).alias("uid"), F.count("*").alias("c"))
    again = one.join(first.filter("c > 1").select("key", F.col("uid").alias("first")), "key").filter("uid <> first").select("uid")
    once = table.filter(F.col("kind") != COUNT).join(small_or_shuffled(written(again)), "uid", "left_anti").drop("uid", "at")
    return once, bucket_counts(table)


#: Rows of a written key table up to which it is broadcast.
SMALL = 300_000


def small_or_shuffled(keys: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast if it has at most SMALL rows and else to meet the other side in a shuffle."""
    return F.broadcast(keys) if keys.count() <= SMALL else keys


def plain_words(rows: DataFrame, extra: list[str]) -> DataFrame:
    """The word table of rows (key, roles, contents, extra) as they are; its rids are negative."""
    made = written(_word_rows(rows, extra).withColumn("rid", F.lit(-1) - F.monotonically_increasing_id()))
    return made.filter(F.col("kind") != COUNT)


def met_by(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of a table by rid that some pair (a, b) of a written table names: mostly a small part, and texts are large."""
    ends = written(pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct())
    return table.join(small_or_shuffled(ends), "rid", "left_semi")


def verified(pairs: DataFrame, table: DataFrame, keep: list[str], t: float = SIMILARITY, shares: Callable | None = None) -> DataFrame:
    """The pairs (a, b, and more) of rids whose exact similarity is at least t, with it and the kept columns of both texts.

    A column c of the table comes back as c_a and c_b; with shares, what it says of the words of both as share_a, share_b.
    """
    more = [c for c in pairs.columns if c not in ("a", "b")]
    met = met_by(pairs, table.select("rid", "said", *keep))
    side = lambda x: met.select(F.col("rid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("said", *keep)])
    both = pairs.join(side("a"), "a").join(side("b"), "b").drop("a", "b")
    kept = [c for c in both.columns if c not in ("said_a", "said_b")]

    def run(batches):
        for b in batches:
            s = [similarity(x.split("\n"), y.split("\n")) for x, y in zip(b["said_a"], b["said_b"])]
            b = b.assign(similarity=pd.Series(s, index=b.index, dtype="float64"))
            b = b[b["similarity"] >= t - 1e-12]
            out = b[[*kept, "similarity"]]
            if shares:
                both_shares = [shares(x.split("\n"), y.split("\n")) for x, y in zip(b["said_a"], b["said_b"])]
                out = out.assign(**{f"share_{x}": pd.Series([p[k] for p in both_shares], index=b.index, dtype="float64") for k, x in enumerate("ab")})
            yield from emit(out)

    more_columns = ", similarity double" + (", share_a double, share_b double" if shares else "")
    return both.mapInPandas(run, ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in kept) + more_columns)
