"""Token-combination prefixes: the index by which similar token sets meet, shared by problems 3 and 4.

Tokens are put in one order, rarest first by the counts of hash buckets over all texts. Rare tokens index alone, the
others by the pairs of tokens of one class (k = 2); classes are by hash. The first token of a class counts nothing, every
other and every rare token counts one. Let two sets of n and m tokens be similar from o shared tokens on. The first of
them lacks at most n - o of its tokens in the other; cut to its shortest prefix that counts more than n - o, and the
other likewise, they must share a rare token or a pair of one class in both prefixes. How far a prefix reaches depends
on both sizes, so each row of the index carries the count before its last token, and two rows meet only where each lies
in the prefix that the other's size asks for: sorted by size, the partners of a row are one window of its posting list.

If neither set counts enough, in all its tokens, for its farthest partner, both are indexed by single tokens besides, in
plain prefixes. If one does, it ends first in the order and the other's whole set takes the prefix's place. So every pair
at or above the threshold meets, whatever the sizes. Classes double with the size, so that rows grow in proportion to a
text; a set near a step is indexed with the classes of both steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets whose counts give the order of tokens: a table of fixed size, however many tokens there are.
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: Count up to which a token is rare and indexes alone: the longest such list.
RARE = 1_000
#: Classes of sets of fewer than STEP tokens; twice as many from STEP on, and so forth with each doubling.
CLASSES, STEP = 30, 200
#: Bound of a pair's rarer token above which the posting list may be long: its rows are split by size as well.
HOT = 500_000
#: Size bands of hot lists: each is wider than the one below by this ratio.
BAND = 1.05
#: Longs of a sketch, and the set sizes above which it holds 256 and 512 bits instead of 128.
LONGS = 8
SKETCH = [f"s{k}" for k in range(1, LONGS + 1)]
WIDE, WIDEST = 90, 250

_U = np.uint64
_SIG = _U((1 << 48) - 1)


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of 64 bits of each hash."""
    x = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9) + _U(salt * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(29))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(32))


class WordHashes(dict):
    """The 64-bit hash of each word; kept for words met before, up to a bound."""

    most = 400_000

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = h
        return h


def token_hashes(texts: list[list[str]], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of many texts, one after the other, and the number of tokens of each.

    A token is a word with the number of its occurrence in its text, so that a text is a set.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    get = hashes.__getitem__
    h = np.fromiter((x for ws in texts for x in map(get, ws)), _U, int(size.sum()))
    if not len(h):
        return h, size
    owner = np.repeat(np.arange(len(size)), size)
    order = _sorted(owner, h, len(size))
    o, s = owner[order], h[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (o[1:] != o[:-1]) | (s[1:] != s[:-1])
    at = np.arange(len(s))
    again = at - np.maximum.accumulate(np.where(fresh, at, 0))
    k = np.flatnonzero(again)
    h[order[k]] = mix(s[k] + again[k].astype(_U) * _U(0xD6E8FEB86659FD93), 9)
    return h, size


def _sorted(owner: np.ndarray, value: np.ndarray, owners: int) -> np.ndarray:
    """Indexes in the order of owner, then of the 64-bit value."""
    bits = max(1, int(owners - 1).bit_length())
    short = (owner.astype(_U) << _U(64 - bits)) | (value >> _U(bits))
    order = np.argsort(short)
    tie = short[order[1:]] == short[order[:-1]]
    # cut values of the same text that are equal, but not whole: sorted exactly
    if (value[order[1:]][tie] != value[order[:-1]][tie]).any():
        return np.lexsort((value, owner))
    return order


def sketches(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(longs by text, h1, h2): the sketch of each token set, and two longs that tell the set. No set is empty.

    A sketch has 512 parity bits and never differs in more bits than the two sets differ in tokens. Its first two longs
    are the bits folded to 128, the next two what 256 bits need besides, the last four what 512 need; sets of up to WIDE
    and WIDEST tokens have zeros there.
    """
    k = len(size)
    owner = np.repeat(np.arange(k), size)
    parity = (np.bincount(owner * 512 + ((h >> _U(20)) & _U(511)).astype(np.int64), minlength=k * 512) & 1).astype(np.uint8)
    s = np.packbits(parity.reshape(k, 512), axis=1).view(_U).reshape(k, LONGS)
    g = s[:, :4] ^ s[:, 4:]
    out = np.empty((k, LONGS), _U)
    out[:, :2] = g[:, :2] ^ g[:, 2:]
    out[:, 2:4] = np.where(size[:, None] > WIDE, g[:, 2:], 0)
    out[:, 4:] = np.where(size[:, None] > WIDEST, s[:, 4:], 0)
    start = np.cumsum(size) - size
    return out.view(np.int64), np.bitwise_xor.reduceat(mix(h, 11), start).view(np.int64), np.bitwise_xor.reduceat(mix(h, 12), start).view(np.int64)


def bucket_of(h: np.ndarray) -> np.ndarray:
    """The bucket of each token hash."""
    return (h >> _U(64 - BUCKET_BITS)).astype(np.int64)


def lacking(n: np.ndarray, m: np.ndarray, t: float) -> np.ndarray:
    """Tokens of a set of n that one of m may lack at a similarity of t."""
    return n - np.ceil((n + m) * (t / (1 + t)) - 1e-9).astype(np.int64)


def farthest(n: np.ndarray, w: np.ndarray, t: float) -> np.ndarray:
    """The largest size of a partner for which a row with the count w lies in the prefix of a set of n."""
    return np.minimum(np.floor(n / t + 1e-6), np.floor((n - w) * ((1 + t) / t) - n + 1e-6)).astype(np.int64)


class Order:
    """The order of tokens by the counts of their buckets, and the rows that token sets are indexed by."""

    def __init__(self, counts: np.ndarray, classes: int = CLASSES, step: int = STEP, rare: int = RARE, hot: int = HOT):
        self.counts = counts
        self.rank = np.empty(BUCKETS, np.int64)
        self.rank[np.argsort(counts, kind="stable")] = np.arange(BUCKETS)
        self.classes, self.step, self.rare, self.hot = classes, step, rare, hot

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place of each token hash in the order, as a number of 64 bits that tells the token."""
        return (self.rank[bucket_of(h)].astype(_U) << _U(64 - BUCKET_BITS)) | (h & _U((1 << 64 - BUCKET_BITS) - 1))

    def rows(self, h: np.ndarray, size: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set number, signature, count before its last token) of the rows of each token set."""
        owner = np.repeat(np.arange(len(size)), size)
        place = self.places(h)
        order = _sorted(owner, place, len(size))
        h, place = h[order], place[order]
        first = np.cumsum(size) - size
        level = np.zeros(len(size), np.int64)
        big = size >= self.step
        level[big] = np.floor(np.log2(size[big] / self.step) + 1e-12).astype(np.int64) + 1
        bound = np.where(level > 0, (self.step * 2.0 ** (level - 1)).astype(np.int64), 0)
        least = np.ceil(t * size - 1e-9).astype(np.int64)
        out: list[tuple] = []
        for v in np.unique(level).tolist():
            own = np.flatnonzero(level == v)
            out += self._jobs(h, place, own, first[own], size[own], lacking(size[own], np.maximum(least[own], bound[own]), t), v)
            if v and len(below := own[least[own] < bound[own]]):
                out += self._jobs(h, place, below, first[below], size[below], lacking(size[below], least[below], t), v - 1)
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _jobs(self, h, place, sets, first, size, lack, level) -> list[tuple]:
        classes = self.classes << level
        # no prefix is longer: each class holds one token that counts nothing
        use = np.minimum(size, lack + classes + 1)
        start = np.cumsum(use) - use
        owner = np.repeat(np.arange(len(sets)), use)
        pos = np.arange(len(owner)) - np.repeat(start, use)
        take = np.repeat(first, use) + pos
        th, est = h[take], self.counts[bucket_of(h[take])]
        rare = est <= self.rare
        group = owner * classes + ((th >> _U(8)) % _U(classes)).astype(np.int64)
        pairs = np.flatnonzero(~rare)
        came = np.empty(len(sets) * classes, np.int64)
        came[group[pairs[::-1]]] = pairs[::-1]
        counts = np.ones(len(owner), np.int64)
        counts[pairs[came[group[pairs]] == pairs]] = 0
        before = np.cumsum(counts) - counts
        before -= np.repeat(before[start], use)
        keep = before <= np.repeat(lack, use)
        salt = 100 + 4 * level
        out = []
        at = np.flatnonzero(keep & rare)
        out.append((sets[owner[at]], mix(th[at], salt), before[at], est[at]))
        at = pairs[keep[pairs]]
        at = at[np.argsort(group[at], kind="stable")]
        _, f, many = np.unique(group[at], return_index=True, return_counts=True)
        for m in np.unique(many[many > 1]).tolist():
            idx = at[f[many == m][:, None] + np.arange(m)]
            i, j = np.triu_indices(m, 1)
            a, b = idx[:, i].ravel(), idx[:, j].ravel()
            out.append((sets[owner[a]], mix(th[a] * _U(0x9E3779B97F4A7C15) ^ mix(th[b], 3), salt + 1), before[b], np.minimum(est[a], est[b])))
        # sets that do not count enough for their farthest partner, in all their tokens
        total = np.add.reduceat(counts, start)
        few = np.repeat(total <= lack, use)
        at = np.flatnonzero(few & (pos <= np.repeat(lack, use)))
        out.append((sets[owner[at]], mix(th[at], salt + 2), pos[at], est[at]))
        return [(s, *self._split(s, sig, w, e)) for s, sig, w, e in out]

    def _split(self, s, sig, w, e):
        # bit 48 tells rows of hot lists
        return (sig & _SIG).astype(np.int64) | ((e > self.hot).astype(np.int64) << 48), w


def by_band(owner: np.ndarray, sig: np.ndarray, w: np.ndarray, n: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index rows with those of hot lists split by size: (index of the row, key, whether the row only looks for partners).

    A row is in the list of its own size band; if its window reaches beyond the band, it also looks into those above.
    """
    hot = np.flatnonzero(sig >> 48)
    every = np.arange(len(sig))
    if not len(hot):
        return every, sig, np.zeros(len(sig), bool)
    own = np.floor(np.log(np.maximum(n[hot], 1)) / np.log(BAND)).astype(np.int64)
    far = farthest(n[hot], w[hot], t)
    last = np.maximum(own, np.floor(np.log(np.maximum(far, 1)) / np.log(BAND)).astype(np.int64))
    more = last - own + 1
    idx = np.repeat(hot, more)
    step = np.arange(len(idx)) - np.repeat(np.cumsum(more) - more, more)
    key = (mix(sig[idx].astype(_U) + (np.repeat(own, more) + step).astype(_U) * _U(0xD6E8FEB86659FD93), 77) & _SIG).astype(np.int64)
    cold = every[(sig >> 48) == 0]
    return np.concatenate([cold, idx]), np.concatenate([sig[cold], key]), np.concatenate([np.zeros(len(cold), bool), step > 0])


#: A piece of the index: the rows of some texts in one bucket of signatures, as the bytes of packed arrays.
INDEX = "bucket int, rows binary"
#: Value of looks for a row that only looks for partners and is none itself.
LOOKS = 1


def buckets_of(df: DataFrame) -> int:
    """Buckets of an index: as many as the session has shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _small(x: np.ndarray) -> np.ndarray:
    """Numbers that are not negative in as few bytes as hold them."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as bytes: for each its type and length, then its values."""
    heads = b"".join(bytes([x.itemsize]) + len(x).to_bytes(4, "little") for x in arrays)
    return bytes([len(arrays)]) + heads + b"".join(x.tobytes() for x in arrays)


def _unpack(data: bytes) -> list[np.ndarray]:
    at, out = 1 + 5 * data[0], []
    for k in range(data[0]):
        width, n = data[1 + 5 * k], int.from_bytes(data[2 + 5 * k : 6 + 5 * k], "little")
        out.append(np.frombuffer(data, np.dtype(f"<u{width}"), n, at))
        at += width * n
    return out


def index_batch(batch: pa.RecordBatch, owner: np.ndarray, sig: np.ndarray, w: np.ndarray, side: np.ndarray, t: float, buckets: int) -> pa.RecordBatch:
    """The rows of the index for texts of a batch (rid, n, sketch), by bucket of their signature."""
    n = batch.column("n").to_numpy().astype(np.int64)
    rid = batch.column("rid").to_numpy()
    s = [batch.column(c).to_numpy().view(_U) for c in SKETCH]
    idx, key, looks = by_band(owner, sig, w, n[owner], t)
    own, count = owner[idx], w[idx]
    key = key.astype(_U) & _SIG
    bucket = (mix(key, 51) % _U(buckets)).astype(np.int64)
    by = np.argsort(own.astype(np.uint16), kind="stable")  # no batch has more texts than 16 bits tell
    by = by[np.argsort(bucket[by].astype(np.uint16) if buckets < 65_536 else bucket[by], kind="stable")]
    bucket, own, key, count, looks = bucket[by], own[by], key[by], count[by], looks[by]
    names, first = np.unique(bucket, return_index=True)
    low, high = (key & _U(0xFFFFFFFF)).astype(np.uint32), (key >> _U(32)).astype(np.uint16)
    out = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)]):
        o = own[a:b]
        at = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        texts = o[at]
        rows = np.diff(np.append(at, len(o)))
        m = n[texts]
        wide, widest = texts[m > WIDE], texts[m > WIDEST]
        arrays = [low[a:b], high[a:b], _small(count[a:b]), looks[a:b].astype(np.uint8) if looks[a:b].any() else np.zeros(0, np.uint8), _small(rows), rid[texts].view(_U), _small(m), side[texts].astype(np.uint8)]
        out.append(_pack(arrays + [s[0][texts], s[1][texts], s[2][wide], s[3][wide], *[s[k][widest] for k in range(4, 8)]]))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(out, pa.binary())], names=["bucket", "rows"])


def _unpacked(data: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(sig, w, looks, text) of the rows and (rid, n, side, sketch) of the texts of a piece of the index."""
    low, high, w, looks, rows, rid, n, side, *s = _unpack(data)
    n = n.astype(np.int64)
    full = []
    for k, x in enumerate(s):
        if k >= 2:
            y = np.zeros(len(n), _U)
            y[n > (WIDE if k < 4 else WIDEST)] = x
            x = y
        full.append(x)
    sig = low.astype(np.int64) | high.astype(np.int64) << 32
    return [sig, w.astype(np.int64), looks if len(looks) else np.zeros(len(sig), np.uint8), np.repeat(np.arange(len(n)), rows)], [rid.view(np.int64), n, side, *full]


#: Pairs compared at a time.
PAIRS = 200_000


def meet(pieces: list[bytes], t: float, sides: bool):
    """Yields (a, b) arrays of the texts of one bucket that meet and may be similar; with sides, a of side 0 and b of side 1."""
    parts = [_unpacked(p) for p in pieces]
    texts = [np.concatenate(x) for x in zip(*[p[1] for p in parts])]
    shift = np.cumsum([0, *[len(p[1][0]) for p in parts]])
    sig, w, looks = (np.concatenate([p[0][k] for p in parts]) for k in range(3))
    text = np.concatenate([p[0][3] + x for p, x in zip(parts, shift)])
    rid, size, side, *s = texts
    n = size[text]
    by = np.argsort(sig << 15 | n) if n.max() < 1 << 15 else np.lexsort((n, sig))
    sig, w, looks, text, n = sig[by], w[by], looks[by], text[by], n[by]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = sig[1:] != sig[:-1]
    # a signature that no other row has meets nothing
    alone = fresh & np.append(fresh[1:], True)
    sig, w, looks, text, n, fresh = (x[~alone] for x in (sig, w, looks, text, n, fresh))
    if not len(sig):
        return
    far = farthest(n, w, t)
    group = np.cumsum(fresh) << 32
    key, top = group | n, group | np.clip(far, 0, (1 << 32) - 1)
    seeks, partner = np.flatnonzero(far >= n), np.flatnonzero(looks < LOOKS)
    if not sides:
        runs = [(seeks, partner, np.searchsorted(partner, seeks + 1), np.searchsorted(key[partner], top[seeks], "right"), False)]
    else:
        of, runs = side[text], []
        for mine, tie in ((0, "right"), (1, "left")):
            x, y = seeks[of[seeks] == mine], partner[of[partner] != mine]
            runs.append((x, y, np.searchsorted(key[y], key[x], tie), np.searchsorted(key[y], top[x], "right"), mine == 1))
    share = ((1 - t) / (1 + t) * n + 1e-6).astype(np.float32)
    four = [s[0] ^ s[2], s[1] ^ s[3], s[2], s[3]]
    words = {2: s[:2], 4: four, 8: [x ^ y for x, y in zip(four, s[4:])] + s[4:]}
    for x, y, lo, up, swap in runs:
        count = np.maximum(up - lo, 0)
        x, lo, count = x[count > 0], lo[count > 0], count[count > 0]
        # a partner is no smaller, so it has all the bits that a row looks at; its rows are read one after the other
        for least, most, use in ((0, WIDE, 2), (WIDE, WIDEST, 4), (WIDEST, 1 << 62, 8)):
            mine = np.flatnonzero((n[x] > least) & (n[x] <= most))
            if len(mine):
                sketch = [w[text] for w in words[use]]
                for a, b in _near(x[mine], y, lo[mine], count[mine], n, far, share, sketch):
                    a, b = rid[text[a]], rid[text[b]]
                    yield (b, a) if swap else (a, b)


def _near(x, y, lo, count, n, far, share, sketch):
    """Pairs of rows, each x with count rows of y from lo on, that sizes and sketches allow."""
    ends, at = np.cumsum(count), 0
    yfar, yshare, ys = far[y], share[y], [k[y] for k in sketch]
    while at < len(x):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        c, own = count[at:stop], x[at:stop]
        b = np.repeat(lo[at:stop] - (ends[at:stop] - c - done), c)
        b += np.arange(len(b))
        a = np.repeat(np.arange(len(own)), c)
        room = share[own][a] + yshare[b]
        bits = sum(np.bitwise_count(k[own][a] ^ m[b]) for k, m in zip(sketch[:4], ys))
        ok = np.flatnonzero((bits <= room) & (n[own][a] <= yfar[b]))
        if len(sketch) > 4 and len(ok):
            p, q = a[ok], b[ok]
            more = sum(np.bitwise_count(k[own][p] ^ m[q]).astype(np.uint16) for k, m in zip(sketch, ys))
            ok = ok[more <= room[ok]]
        if len(ok):
            yield own[a[ok]], y[b[ok]]
        at = stop


def meeting_pairs(index: DataFrame, t: float, sides: bool = False) -> DataFrame:
    """(a, b): rids whose index rows meet and may be similar, repeated where they meet in several buckets.

    Without sides a < b; with sides a is of side 0 and b of side 1.
    """

    def pairs(pieces):
        found = list(meet(pieces, t, sides))
        if found:
            a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            if not sides:
                a, b = np.minimum(a, b), np.maximum(a, b)
            by = np.lexsort((b, a))
            a, b = a[by], b[by]
            fresh = a != b
            fresh[1:] &= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(a[fresh]), pa.array(b[fresh])], names=["a", "b"])

    def run(batches):
        last, pieces = None, []
        for batch in batches:
            for bucket, rows in zip(batch.column("bucket").to_pylist(), batch.column("rows").to_pylist()):
                if bucket != last and pieces:
                    yield from pairs(pieces)
                    pieces = []
                last = bucket
                pieces.append(rows)
        if pieces:
            yield from pairs(pieces)

    return index.repartitionById(buckets_of(index), F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")
