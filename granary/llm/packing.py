"""Problem 6: filling fixed-capacity windows with texts, by vector bin packing with the dot-product heuristic.

Every text is a vector of tokens, segments (one) and loss-bearing tokens; a window has a limit on each. A window is
filled with the fitting text whose vector has the largest dot product with what is left of the window, weighted by the
mean demand of each dimension, until none fits. Only a text longer than a window is cut, into whole windows and a rest.
Texts are dealt into blocks of bounded size by a hash, so blocks are packed apart, each in one task.
"""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.frames import emit, plain
from granary.session import enough_tasks, written

#: A file of a public tokenizer, one base64 token and its rank in a line; must be at the same path on every executor, or
#: be sent there by SparkContext.addFile(), which is looked at if the path is not there.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the published splitting pattern of that kind of tokenizer.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts in a block: a bound on what one task packs.
BLOCK = 5_000


@dataclass(frozen=True)
class Limits:
    tokens: int = 2_048
    segments: int = 64
    loss_tokens: int = 2_048


_OPEN: dict[str, object] = {}


def encoding(path: str = TOKENIZER):
    """The tokenizer of a file, opened once in a process."""
    if path not in _OPEN:
        import tiktoken

        if not os.path.exists(path):
            path = SparkFiles.get(os.path.basename(path))
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _OPEN[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _OPEN[path]


def token_sizes(texts: DataFrame, key: str = "doc_id", tokenizer: str = TOKENIZER, with_runs: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, tokens, loss_tokens, and the kept columns) of texts with columns key, parts (array<struct<text, loss boolean>>).

    With with_runs, also runs: the tokens of each part in order, below zero where they bear no loss. Texts are counted
    where they are read.
    """
    kind = texts.schema[key].dataType.simpleString()
    kept = "".join(f", {c} {texts.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        enc = encoding(tokenizer)
        for b in batches:
            flat, owner, loss = [], [], []
            for n, parts in enumerate(b["parts"]):
                for p in parts if parts is not None else ():
                    if p["text"]:
                        flat.append(p["text"])
                        owner.append(n)
                        loss.append(bool(p["loss"]))
            sizes = [len(x) for x in enc.encode_ordinary_batch(flat, num_threads=1)]
            total, bearing = np.zeros(len(b), "int64"), np.zeros(len(b), "int64")
            np.add.at(total, owner, sizes)
            np.add.at(bearing, owner, [s if q else 0 for s, q in zip(sizes, loss)])
            out = pd.DataFrame({key: b[key], "tokens": total, "loss_tokens": bearing} | {c: b[c] for c in keep})
            if with_runs:
                runs: list[list[int]] = [[] for _ in range(len(b))]
                for n, s, q in zip(owner, sizes, loss):
                    runs[n].append(s if q else -s)
                out["runs"] = pd.Series(runs, index=b.index, dtype="object")
            yield from emit(out)

    return enough_tasks(texts.select(key, "parts", *keep)).mapInPandas(run, f"{key} {kind}, tokens long, loss_tokens long{kept}" + (", runs array<long>" if with_runs else ""))


def cut_runs(runs: list[int], limits: Limits) -> list[tuple[int, int]]:
    """(tokens, loss_tokens) of the pieces of a text, each as long as both limits allow; runs below zero bear no loss."""
    out, size, bearing = [], 0, 0
    for run in runs:
        left = abs(run)
        while left:
            room = min(left, limits.tokens - size, limits.loss_tokens - bearing if run > 0 else left)
            if not room:
                out.append((size, bearing))
                size = bearing = 0
                continue
            size, left = size + room, left - room
            bearing += room if run > 0 else 0
    return out + [(size, bearing)] if size else out


def run_pieces(sizes: DataFrame, key: str, limits: Limits) -> DataFrame:
    """(key, piece_no, start_token, tokens, loss_tokens) of texts with their runs: loss-bearing tokens counted in each piece."""

    def run(batches):
        for b in batches:
            rows = []
            for k, runs in zip(b[key], b["runs"]):
                start = 0
                for n, (size, bearing) in enumerate(cut_runs([int(x) for x in runs], limits)):
                    rows.append((k, n, start, size, bearing))
                    start += size
            yield from emit(pd.DataFrame(rows, columns=[key, "piece_no", "start_token", "tokens", "loss_tokens"]))

    return sizes.select(key, "runs").mapInPandas(run, f"{key} {sizes.schema[key].dataType.simpleString()}, piece_no long, start_token long, tokens long, loss_tokens long")


def pieces(sizes: DataFrame, key: str, limits: Limits) -> DataFrame:
    """(key, piece_no, start_token, tokens, loss_tokens): texts, those longer than a window cut into windows and a rest.

    The loss-bearing tokens of a cut text are spread over its pieces in proportion, rounded so that they add up: exact where
    all tokens bear loss or none; run_pieces() counts them for other texts. A text whose loss-bearing tokens alone exceed their limit is cut so that each piece keeps both limits.
    """
    share = F.ceil(F.greatest(F.col("tokens") / limits.tokens, F.col("loss_tokens") / limits.loss_tokens))
    by_loss = F.col("loss_tokens") / limits.loss_tokens > F.col("tokens") / limits.tokens
    size = F.when(by_loss, F.floor(F.col("tokens") / share)).otherwise(F.lit(limits.tokens)).cast("long")
    rows = sizes.filter("tokens > 0").withColumn("size", F.greatest(size, F.lit(1)))
    count = F.ceil(F.col("tokens") / F.col("size"))
    rows = rows.select(key, "tokens", "loss_tokens", "size", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))).alias("piece_no"))
    start = F.col("piece_no") * F.col("size")
    end = F.least(start + F.col("size"), F.col("tokens"))
    loss = F.floor(F.col("loss_tokens") * end / F.col("tokens")) - F.floor(F.col("loss_tokens") * start / F.col("tokens"))
    return rows.select(key, F.col("piece_no").cast("long").alias("piece_no"), start.cast("long").alias("start_token"), (end - start).cast("long").alias("tokens"), F.least(loss, F.lit(limits.loss_tokens)).cast("long").alias("loss_tokens"))


def fill(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> np.ndarray:
    """Window number of each text; texts of one size are alike, so each step looks at the distinct sizes only."""
    pair, of = np.unique(np.stack([tokens, loss], 1), axis=0, return_inverse=True)
    of = of.reshape(-1)
    order = np.argsort(of, kind="stable")
    first = np.searchsorted(of[order], np.arange(len(pair)))
    left = np.bincount(of, minlength=len(pair))
    cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    vec = np.column_stack([pair[:, 0], np.ones(len(pair)), pair[:, 1]]) / cap
    weight = vec.T @ left / max(1, left.sum())
    live = np.arange(len(pair))
    out = np.empty(len(tokens), np.int64)
    window = 0
    while len(live):
        rest = np.ones(3)
        while True:
            fits = (vec[live] <= rest + 1e-12).all(axis=1)
            if not fits.any():
                break
            can = live[fits]
            k = can[np.argmax(vec[can] @ (weight * rest))]
            left[k] -= 1
            out[order[first[k]]] = window
            first[k] += 1
            rest = rest - vec[k]
            if not left[k]:
                live = live[live != k]
                if not len(live):
                    break
        window += 1
    return out


def packed(items: DataFrame, key: str, limits: Limits, block: int = BLOCK) -> DataFrame:
    """(window_id, slot, key, piece_no, start_token, tokens, loss_tokens): every piece in one window within all limits.

    A piece that alone breaks a limit cannot occur after pieces(). Null keys are texts like others; an empty table
    gives no rows. The same rows give the same windows.
    """
    kind = items.schema[key].dataType.simpleString()
    items = written(items)
    blocks = max(1, -(-items.count() // block))
    dealt = items.withColumn("block", F.pmod(F.xxhash64(F.col(key), F.col("piece_no"), F.lit(17)), F.lit(blocks)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "piece_no"], kind="stable").reset_index(drop=True)
        at = fill(pdf["tokens"].to_numpy(), pdf["loss_tokens"].to_numpy(), limits)
        pdf["window_id"] = pdf["block"] * 4_294_967_296 + at
        pdf["slot"] = pdf.groupby("window_id").cumcount().astype("int64")
        return plain(pdf[["window_id", "slot", key, "piece_no", "start_token", "tokens", "loss_tokens"]])

    # a stated number of partitions: few bytes, but much work for each, so they must not be merged into a few tasks
    spark = items.sparkSession
    parts = min(blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))
    return dealt.repartition(parts, "block").groupBy("block").applyInPandas(run, f"window_id long, slot long, {key} {kind}, piece_no long, start_token long, tokens long, loss_tokens long")


def fill_report(windows: DataFrame, limits: Limits) -> DataFrame:
    """(windows, pieces, tokens, least_windows, fill): how full the windows are against the least number possible."""
    total = windows.agg(F.count_distinct("window_id").alias("windows"), F.count("*").alias("pieces"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("loss_tokens"), F.lit(0)).alias("loss"))
    least = F.greatest(F.ceil(F.col("tokens") / limits.tokens), F.ceil(F.col("pieces") / limits.segments), F.ceil(F.col("loss") / limits.loss_tokens))
    return total.select("windows", "pieces", "tokens", least.cast("long").alias("least_windows"), (F.col("tokens") / (F.nullif("windows", F.lit(0)) * limits.tokens)).alias("fill"))


def document_parts(documents: DataFrame) -> DataFrame:
    """(doc_id, parts) of documents: the whole text, all of it loss-bearing."""
    return documents.select("doc_id", F.array(F.struct(F.col("text"), F.lit(True).alias("loss"))).alias("parts"))


def instruction_parts(records: DataFrame, *more: Column | str) -> DataFrame:
    """(id, parts, and more) of records: one part for each message, of which the assistant's bear loss."""
    return records.select("id", *more, F.transform("messages", lambda m: F.struct(m["content"].alias("text"), F.coalesce(m["role"] == "assistant", F.lit(False)).alias("loss"))).alias("parts"))



def pack_documents(documents: DataFrame, limits: Limits | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """Windows of documents; a null or empty text takes no room and is in no window."""
    limits = limits or Limits()
    return packed(pieces(token_sizes(document_parts(documents), "doc_id", tokenizer), "doc_id", limits), "doc_id", limits)


def pack_instructions(records: DataFrame, limits: Limits | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """Windows of instruction records under limits on tokens, records and the assistant's tokens."""
    from granary.llm.pair_defects import of_first_delivery, repeated_deliveries

    limits = limits or Limits(2_048, 16, 1_280)
    # every delivery is counted where it is read; the few later ones go by their keys, so that no conversation moves
    rows = instruction_parts(records.filter(F.col("id").isNotNull()), F.col("ingested_at").alias("at"), F.xxhash64("messages").alias("h"))
    sizes = of_first_delivery(token_sizes(rows, "id", tokenizer, True, ("at", "h")), repeated_deliveries(records)).dropDuplicates(["id"])
    return packed(run_pieces(sizes, "id", limits), "id", limits)
