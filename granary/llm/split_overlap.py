"""Problem 4: same or near-same records across splits, by content-defined chunks.

A rolling hash runs over the bytes of a record's normalised words, and a chunk ends after a word where it says so, so an
edit moves no cut beyond the hash's window. Chunk digests are joined across splits, and the lengths of all chunks that
two similar records share are summed into the fraction of each that the other holds. Chunks are put in one order, those
with a rare word first, and a text is indexed by its first chunks that cover more than 1 - MIN_OVERLAP of its words: two
texts that share MIN_OVERLAP of the larger one's words in chunks meet there, whatever chunks are common to many. Texts may
be similar and share fewer, with scattered edits or their words in another order; so each is indexed by its
token-combination prefix (granary.llm.prefixes) besides, which loses no pair. Exact copies are looked up and verified once.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.grouped_splits import split_class
from granary.llm.prefixes import INDEX, SKETCH, Order, WordHashes, bucket_of, buckets_of, index_batch, meeting_pairs, mix, token_hashes
from granary.llm.similar import MESSAGE, SIMILARITY, TOGETHER, plain_words, record_words, small_or_shuffled, verified
from granary.session import written

#: A cut falls after one word in CUT on average, no chunk has fewer than LEAST or more than MOST words.
CUT, LEAST, MOST = 3, 3, 16
#: Bytes of the rolling hash's window.
WINDOW = 8
#: Share of a record's words in shared chunks from which two records meet by chunks alone.
MIN_OVERLAP = 0.5
#: Bits that tell which signatures the tasks may have.
ASKED = 1 << 22
_BASE = 1_099_511_628_211
_SIG = np.uint64((1 << 48) - 1)


def rolling_hash(data: bytes) -> np.ndarray:
    """At each byte, a polynomial hash of the last WINDOW bytes."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    h = x.copy()
    for back in range(1, WINDOW):
        h[back:] += x[: len(x) - back] * np.uint64(pow(_BASE, back, 1 << 64))
    return mix(h, 21)


def _cuts(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(text, words) of each chunk, in order."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    # texts are parted by a whole window of line ends, so that none of a neighbour's bytes is in a window
    gap = "\n" * WINDOW
    data = (gap + gap.join(map("\n".join, texts)) + gap).encode()
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero((b[1:] == 10) & (b[:-1] != 10))
    falls = rolling_hash(data)[ends] % np.uint64(CUT) == 0
    last = np.cumsum(size) - 1
    falls[last[size > 0]] = True
    owners, sizes = [], []
    at = np.flatnonzero(falls)
    of = np.searchsorted(last, at)
    start, before = 0, -1
    for place, text in zip(at.tolist(), of.tolist()):
        if text != before:
            start, before = int(last[text] - size[text] + 1), text
        k = place + 1 - start
        while k > MOST:
            owners.append(text)
            sizes.append(MOST)
            start += MOST
            k -= MOST
        if k >= LEAST or k and place == last[text]:
            owners.append(text)
            sizes.append(k)
            start = place + 1
    return np.array(owners, np.int64), np.array(sizes, np.int64)


def text_chunks(texts: list[list[str]], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, digest, words, word hashes) of the chunks of many texts; the last is that of all words."""
    owner, size = _cuts(texts)
    get = hashes.__getitem__
    h = np.fromiter((x for ws in texts for x in map(get, ws)), np.uint64, int(size.sum()))
    if not len(h):
        return owner, np.zeros(0, np.int64), size, h
    start = np.cumsum(size) - size
    place = np.arange(len(h)) - np.repeat(start, size)
    odd = mix(np.arange(MOST + 1, dtype=np.uint64) + np.uint64(1), 31) | np.uint64(1)
    return owner, (mix(np.add.reduceat(h * odd[place], start), 32) & _SIG).astype(np.int64), size, h


def chunks(ws: list[str]) -> list[tuple[int, int]]:
    """(digest, words) of the content-defined chunks of a text, in order."""
    _, digests, sizes, _ = text_chunks([ws], WordHashes())
    return list(zip(digests.tolist(), sizes.tolist()))


def shared_fractions(a: list[str], b: list[str]) -> tuple[float, float]:
    """The share of each text's words that lies in chunks which the other has too; a repeated chunk counts as often as both have it."""
    shared = sum(size * n for (_, size), n in (Counter(chunks(a)) & Counter(chunks(b))).items())
    return shared / len(a), shared / len(b)


def chunk_rows(texts: list[list[str]], hashes: WordHashes, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(text, digest) of the chunks that each text is indexed by: those with the rarest words, until 1 - least is covered."""
    owner, digest, size, h = text_chunks(texts, hashes)
    if not len(owner):
        return owner, digest
    rarest = np.minimum.reduceat(counts[bucket_of(h)], np.cumsum(size) - size)
    by = np.lexsort((digest, rarest, owner))
    owner, digest, size = owner[by], digest[by], size[by]
    before = np.cumsum(size) - size
    first = np.ones(len(owner), bool)
    first[1:] = owner[1:] != owner[:-1]
    before -= np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(owner))))
    whole = np.bincount(owner, size)[owner]
    again = np.zeros(len(owner), bool)
    again[1:] = (owner[1:] == owner[:-1]) & (digest[1:] == digest[:-1])
    keep = (before <= (1 - least) * whole + 1e-9) & ~again
    return owner[keep], digest[keep]


def signatures(texts: list[list[str]], kind: np.ndarray, order: Order, hashes: WordHashes, t: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, signature, count before its last token) of the chunks and the token combinations that texts are indexed by."""
    at, digest = chunk_rows(texts, hashes, order.counts, least)
    owner, sig, w = order.rows(*token_hashes(texts, hashes), t)
    owner, sig, w = np.concatenate([at, owner]), np.concatenate([digest, sig]), np.concatenate([np.zeros(len(at), np.int64), w])
    return owner, sig ^ kind[owner], w


def asked_bits(tasks: DataFrame, order: Order, t: float, least: float) -> np.ndarray:
    """A bit for the hash of each signature of the given texts: ASKED bits, however many texts there are."""
    held = tasks.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        bits = np.zeros(ASKED >> 6, np.uint64)
        for b in batches:
            _, sig, _ = signatures([said.split("\n") for said in b.column("said").to_pylist()], b.column("kind").to_numpy().astype(np.int64), held.value, WordHashes(), t, least)
            at = _asked_at(sig)
            np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        word = np.flatnonzero(bits)
        if len(word):
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits[word].view(np.int64))], names=["word", "bits"])

    found = tasks.select("said", "kind").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(ASKED >> 6, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits


def _asked_at(sig: np.ndarray) -> np.ndarray:
    return (mix(sig.astype(np.uint64), 61) % np.uint64(ASKED)).astype(np.int64)


def overlap_index(table: DataFrame, order: Order, t: float = SIMILARITY, least: float = MIN_OVERLAP, asked: np.ndarray | None = None) -> DataFrame:
    """The index (bucket, rows) of the chunks and of the token combinations of texts; with asked, of those that it may hold.

    Texts of another kind have other signatures; side is 1 for evaluation texts.
    """
    held, buckets = table.sparkSession.sparkContext.broadcast((order, asked)), buckets_of(table)

    def run(batches):
        (order, asked), hashes = held.value, WordHashes()
        for b in (b.slice(k, TOGETHER) for b in batches for k in range(0, b.num_rows, TOGETHER)):
            owner, sig, w = signatures([said.split("\n") for said in b.column("said").to_pylist()], b.column("kind").to_numpy().astype(np.int64), order, hashes, t, least)
            if asked is not None:
                at = _asked_at(sig)
                has = np.flatnonzero(asked[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
                owner, sig, w = owner[has], sig[has], w[has]
            if len(sig):
                yield index_batch(b, owner, sig, w, b.column("side").to_numpy().astype(np.int64), t, buckets)

    side = (F.col("part") != "train").cast("int").alias("side")
    return table.select("rid", "said", "kind", "n", side, *SKETCH).mapInArrow(run, INDEX)


def _sides(records: DataFrame, tasks: DataFrame | None) -> tuple[DataFrame, np.ndarray]:
    """The word table of training and evaluation records (kind 0), of training user messages and tasks (kind 1), and token counts."""
    part = split_class(F.col("split"))
    own = F.lit(tasks is not None) & (part == "train")
    table, counts = record_words(records.withColumn("part", part).filter("part is not null"), {"part": F.col("part"), "source": F.col("source")}, own)
    if tasks is None:
        return table, counts
    held = tasks.filter((F.lower(F.trim("split")) == "benchmark-only") & F.col("id").isNotNull())
    rows = held.select(F.col("id").alias("key"), F.array(F.lit("user")).alias("roles"), F.array("prompt").alias("contents"), F.lit("benchmark-only task").alias("part"), F.lit(None).cast("string").alias("source"))
    return table.unionByName(plain_words(rows, ["part", "source"]).withColumn("kind", F.lit(MESSAGE))), counts


def text_classes(records: DataFrame, tasks: DataFrame | None = None, t: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Members (class, key, part, source) of the classes of copies of one side and kind that overlap, and the overlaps.

    The overlaps are (a, b, train_fraction, eval_fraction, similarity) of a training and an evaluation class.
    """
    table, counts = _sides(records, tasks)
    side = (F.col("part") != "train").cast("int")
    # one text of each class of copies; only the classes of several copies need a join, by their keys alone
    of = ["h1", "h2", "kind", "side"]
    keyed = table.select("rid", "h1", "h2", "kind", side.alias("side"))
    several = written(keyed.groupBy(*of).agg(F.min("rid").alias("class"), F.count("*").alias("c")).filter("c > 1").drop("c"))
    copies = written(keyed.join(small_or_shuffled(several), of).filter("rid <> class").select("rid", "class"))
    reps = table.join(small_or_shuffled(copies.select("rid")), "rid", "left_anti")
    order = Order(counts)
    rows = overlap_index(reps.filter("kind = 0"), order, t)
    if tasks is not None:
        # user messages are many and tasks few: only what a task may be indexed by too moves on
        asked = reps.filter("part <> 'train' and kind = 1")
        bits = asked_bits(asked, order, t, MIN_OVERLAP)
        rows = rows.unionByName(overlap_index(reps.filter("part = 'train' and kind = 1"), order, t, MIN_OVERLAP, bits)).unionByName(overlap_index(asked, order, t))
    found = written(verified(written(meeting_pairs(rows, t, sides=True).distinct()), reps, ["rid"], t, shared_fractions))
    links = found.select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b"), F.col("share_a").alias("train_fraction"), F.col("share_b").alias("eval_fraction"), "similarity")
    every = written(links.select(F.col("a").alias("class")).unionByName(links.select(F.col("b").alias("class"))).distinct())
    known = table.select("rid", "key", "part", "source")
    linked = copies.join(small_or_shuffled(every), "class", "left_semi")
    own = every.select(F.col("class").alias("rid"), "class").unionByName(linked.select("rid", "class"))
    members = written(known.join(small_or_shuffled(written(own)), "rid").drop("rid"))
    return members, links


def overlaps(records: DataFrame, tasks: DataFrame | None = None, t: float = SIMILARITY) -> DataFrame:
    """(train_key, eval_key, part, train_source, eval_source, train_fraction, eval_fraction, similarity) of overlapping texts.

    The fractions are the shares of each text's words in chunks that both hold, counted over whole texts; the similarity
    is exact. Texts without words overlap nothing; null and draft splits are on neither side; repeated deliveries are one
    record; tasks are compared with the user messages of training records. An empty table gives no rows.
    """
    members, links = text_classes(records, tasks, t)
    end = lambda x, name: members.select(F.col("class").alias(x), F.col("key").alias(f"{name}_key"), F.col("source").alias(f"{name}_source"), *([F.col("part")] if x == "b" else []))
    both = links.join(end("a", "train"), "a").join(end("b", "eval"), "b")
    return both.select("train_key", "eval_key", "part", "train_source", "eval_source", "train_fraction", "eval_fraction", "similarity")


def overlap_pairs(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """(key_a, key_b), smaller key first, of every overlap between training and evaluation."""
    return overlaps(records, tasks).select(F.least("train_key", "eval_key").alias("key_a"), F.greatest("train_key", "eval_key").alias("key_b")).distinct()


def overlap_report(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """(part, eval_source, train_source, pairs, eval_texts, exact) of the overlaps, by evaluation split and sources."""
    found = overlaps(records, tasks)
    return found.groupBy("part", "eval_source", "train_source").agg(F.count_distinct("train_key", "eval_key").alias("pairs"), F.count_distinct("eval_key").alias("eval_texts"), F.sum((F.col("similarity") >= 1.0).cast("long")).alias("exact"))
