"""Prediction by partial matching over bytes: exact code lengths of a text under frozen statistics of each language.

A language's model is a context tree of byte contexts up to ORDER bytes. A byte is coded in the longest known context
that has seen it; each longer known context that has not seen it costs an escape (method C: distinct followers over
distinct followers plus occurrences). Statistics do not change while a text is scored, so the cost of every n-gram that
occurs in training can be computed once, for all languages together; scoring is then a few table look-ups per byte.
"""

from __future__ import annotations

import numpy as np

ORDER = 5
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_MUL = np.uint64(0x9E3779B97F4A7C15)


#: Marks that say nothing of the language at the ends of a text.
_EDGE = " \t\n.!?…:;,()[]-–—•*|\"'`“”«»"


def folded(text: str) -> bytes:
    """The bytes that are scored: without marks at the ends, case folded, runs of blanks as one, blanks at both ends."""
    return b" " + " ".join(text.strip(_EDGE).casefold().replace("’", "'").split()).encode() + b" "


class PpmModels:
    """Frozen context trees of several languages, as look-up tables by context length."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.langs = sorted(texts)
        self.order = order
        self.tables = []
        self.uniform = 8.0
        said = [np.frombuffer(b"\n".join(folded(t) for t in texts[lang]), np.uint8).astype(np.uint64) for lang in self.langs]
        known, low_rows = None, None
        for d in range(order + 1):
            trees = [_counts(x, d) for x in said]
            grams = np.unique(np.concatenate([t[0] for t in trees]))
            contexts = np.unique(grams >> np.uint64(8))
            rows, escapes = np.empty((len(grams), len(trees)), np.float32), np.zeros((len(contexts), len(trees)), np.float32)
            if d:  # the cost in the context that is a byte shorter: what follows is known there, as it is part of the gram
                low = low_rows[np.searchsorted(known, grams & np.uint64((1 << 8 * d) - 1))]
            for k, (keys, times, ctx, seen, kinds) in enumerate(trees):
                n, q = _look(ctx, contexts, seen), _look(ctx, contexts, kinds)
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape = np.where(n > 0, -np.log2(q / (n + q)), 0.0)
                    at = np.searchsorted(contexts, grams >> np.uint64(8))
                    met = _look(keys, grams, times)
                    below = low[:, k] if d else self.uniform
                    cost = np.where(met > 0, -np.log2(met / (n[at] + q[at])), escape[at] + below)
                rows[:, k], escapes[:, k] = cost, escape
            self.tables.append((_Table(grams, d + 1, rows), _Table(contexts, d, escapes)))
            known, low_rows = grams, rows.astype(np.float64)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text (as folded gives it) in each language."""
        if not texts:
            return np.zeros((0, len(self.langs)))
        out, part, size = [], [], 0
        for t in texts:  # some 100 kB at a time stay in the cache
            part.append(t)
            size += len(t)
            if size > 100_000:
                out.append(self._bits(part))
                part, size = [], 0
        if part:
            out.append(self._bits(part))
        return np.concatenate(out)

    def _bits(self, texts: list[bytes]) -> np.ndarray:
        n = self.order
        data = np.frombuffer(b"".join([b"\0" * n + t for t in texts]), np.uint8).astype(np.uint64)
        # the last n + 1 bytes at each place, those of the blank space before a text included
        last = data[n:].copy()
        for back in range(1, n + 1):
            last |= data[n - back : len(data) - back] << np.uint64(8 * back)
        cost, left = None, None
        for d in range(n, -1, -1):
            here = last if cost is None else last[left]
            key = (here & np.uint64((1 << 8 * (d + 1)) - 1)) | np.uint64((d + 1) << 8 * (d + 1))
            grams, escapes = self.tables[d]
            found, row = grams.look(key)
            rest = np.flatnonzero(~found)
            if cost is None:
                cost = grams.rows.take(row, axis=0)
                cost[rest] = 0
                left = rest
            else:
                at = np.flatnonzero(found)
                cost[left[at]] += grams.rows[row[at]]
                left = left[rest]
            if not len(left):
                break
            ctx = ((here[rest] >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)) | np.uint64(d << 8 * d)
            there, row = escapes.look(ctx)
            at = np.flatnonzero(there)
            cost[left[at]] += escapes.rows[row[at]]
        else:
            cost[left] += self.uniform
        ends = np.cumsum([len(t) + n for t in texts]) - n
        starts = ends - [len(t) for t in texts]
        cost = np.vstack([cost, np.zeros((1, cost.shape[1]), np.float32)])  # so that the last end is a place too
        return np.add.reduceat(cost, np.stack([starts, ends], 1).ravel(), axis=0)[::2]


class _Table:
    """Rows by byte string of one length, in an open table of 64-bit keys."""

    def __init__(self, grams: np.ndarray, length: int, rows: np.ndarray):
        self.rows = rows
        keys = grams | np.uint64(length << 8 * length)
        size = 1 << max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift = np.uint64(64 - int(np.log2(size)))
        self.mask = size - 1
        self.slots, self.row = np.full(size, _EMPTY), np.zeros(size, np.int32)
        with np.errstate(over="ignore"):
            place = ((keys * _MUL) >> self.shift).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            p = place[left]
            free = self.slots[p] == _EMPTY
            _, first = np.unique(p, return_index=True)
            take = np.zeros(len(left), bool)
            take[first] = True
            take &= free
            self.slots[p[take]], self.row[p[take]] = keys[left[take]], left[take]
            left = left[~take]
            place[left] = (place[left] + 1) & self.mask

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its row."""
        p = ((keys * _MUL) >> self.shift).astype(np.int64)
        s = self.slots[p]
        found = s == keys
        left = np.flatnonzero(~found & (s != _EMPTY))
        while len(left):
            p[left] = (p[left] + 1) & self.mask
            s = self.slots[p[left]]
            hit = s == keys[left]
            found[left[hit]] = True
            left = left[~hit & (s != _EMPTY)]
        return found, self.row[p]


def _counts(data: np.ndarray, d: int) -> tuple[np.ndarray, ...]:
    """Of the n-grams of d + 1 bytes: (grams, times, contexts, occurrences of each context, its distinct followers), all in order."""
    n = max(0, len(data) - d)
    grams = np.zeros(n, np.uint64)
    for j in range(d + 1):
        grams = grams << np.uint64(8) | data[j : j + n]
    keys, times = np.unique(grams, return_counts=True)
    ctx, first, kinds = np.unique(keys >> np.uint64(8), return_index=True, return_counts=True)
    return keys, times, ctx, np.add.reduceat(times, first) if len(first) else times, kinds


def _look(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 where it is not among the keys, which are in order."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0).astype(np.float64)
