"""A linear-chain conditional random field over sparse binary features, in numpy."""

from __future__ import annotations

import numpy as np


class Crf:
    """Weights by (feature, label) and (label, next label); features are strings met in training."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, len(labels)))
        self.t = np.zeros((len(labels), len(labels)))

    def encode(self, sequence: list[list[str]], grow: bool = False) -> list[np.ndarray]:
        index = self.index
        if grow:
            for feats in sequence:
                for f in feats:
                    index.setdefault(f, len(index))
        return [np.fromiter((index[f] for f in feats if f in index), int) for feats in sequence]

    def scores(self, encoded: list[np.ndarray]) -> np.ndarray:
        sizes = [len(ids) for ids in encoded]
        if min(sizes) == 0:
            return np.array([self.w[ids].sum(axis=0) for ids in encoded])
        return np.add.reduceat(self.w[np.concatenate(encoded)], np.cumsum([0, *sizes[:-1]]), axis=0)

    def fit(self, data: list[tuple[list[list[str]], list[str]]], epochs: int = 6, rate: float = 0.3, l2: float = 1e-5, seed: int = 7) -> Crf:
        """Maximum likelihood by adaptive gradient steps over the sequences in a fixed order of a seeded shuffle."""
        at = {label: k for k, label in enumerate(self.labels)}
        coded = [(self.encode(x, grow=True), np.array([at[v] for v in y])) for x, y in data]
        n, k = len(self.index), len(self.labels)
        self.w = np.zeros((n, k))
        gw, gt = np.full((n, k), 1e-3), np.full((k, k), 1e-3)
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for s in order.permutation(len(coded)):
                x, y = coded[s]
                if not len(y):
                    continue
                p, pair = self._marginals(self.scores(x))
                for j, ids in enumerate(x):
                    g = p[j].copy()
                    g[y[j]] -= 1
                    gw[ids] += g * g
                    self.w[ids] -= rate * (g + l2 * self.w[ids]) / np.sqrt(gw[ids])
                if len(y) > 1:
                    g = pair.copy()
                    np.add.at(g, (y[:-1], y[1:]), -1)
                    gt += g * g
                    self.t -= rate * g / np.sqrt(gt)
        return self

    def _marginals(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = s.shape
        a, b = np.empty((n, k)), np.zeros((n, k))
        a[0] = s[0]
        for j in range(1, n):
            a[j] = s[j] + _lse(a[j - 1][:, None] + self.t, 0)
        for j in range(n - 2, -1, -1):
            b[j] = _lse(self.t + (s[j + 1] + b[j + 1])[None, :], 1)
        z = _lse(a[-1], 0)
        pair = np.zeros((k, k))
        for j in range(n - 1):
            pair += np.exp(a[j][:, None] + self.t + (s[j + 1] + b[j + 1])[None, :] - z)
        return np.exp(a + b - z), pair

    def viterbi(self, s: np.ndarray) -> list[int]:
        """The best label sequence under the scores of each position."""
        rows, into, labels = s.tolist(), self.t.T.tolist(), range(len(self.labels))
        best, back = rows[0], []
        for row in rows[1:]:
            came, now = [], []
            for k in labels:
                reach = [x + y for x, y in zip(best, into[k])]
                top = max(reach)
                came.append(reach.index(top))
                now.append(top + row[k])
            back.append(came)
            best = now
        out = [best.index(max(best))]
        for came in reversed(back):
            out.append(came[out[-1]])
        return out[::-1]

    def decode(self, scores: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The best label sequence of each of many sequences, whose scores follow one another; those of one length together."""
        starts = np.cumsum(sizes) - sizes
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sizes)
        for n in np.unique(sizes[sizes > 0]).tolist():
            mine = np.flatnonzero(sizes == n)
            if len(mine) < 8:  # numpy pays where many go together
                for k in mine.tolist():
                    out[k] = np.array(self.viterbi(scores[starts[k] : starts[k] + n]))
                continue
            rows = scores[starts[mine][:, None] + np.arange(n)]
            best, back = rows[:, 0], []
            for j in range(1, n):
                reach = best[:, :, None] + self.t
                came = reach.argmax(axis=1)
                best = reach.max(axis=1) + rows[:, j]
                back.append(came)
            tags = np.empty((len(mine), n), np.int64)
            tags[:, -1] = best.argmax(axis=1)
            for j in range(n - 1, 0, -1):
                tags[:, j - 1] = back[j - 1][np.arange(len(mine)), tags[:, j]]
            for k, t in zip(mine.tolist(), tags):
                out[k] = t
        return out

    def tag(self, sequence: list[list[str]]) -> list[str]:
        return self.tag_all([sequence])[0]

    def tag_all(self, sequences: list[list[list[str]]]) -> list[list[str]]:
        """The labels of each sequence; the scores of all positions are found together."""
        index = self.index.get
        ids = [[k for f in feats if (k := index(f)) is not None] for sequence in sequences for feats in sequence]
        return self.tag_ids(ids, [len(sequence) for sequence in sequences])

    def tag_ids(self, ids: list[list[int]], sizes: list[int]) -> list[list[str]]:
        """The labels of each sequence of the given size, from the numbers of the features of each position."""
        if not ids:
            return [[] for _ in sizes]
        many = np.array([len(x) for x in ids])
        flat = np.fromiter((k for x in ids for k in x), np.int64, int(many.sum()))
        total = np.vstack([np.zeros((1, len(self.labels))), np.cumsum(self.w[flat], axis=0)])
        ends = np.cumsum(many)
        return [[self.labels[k] for k in t] for t in self.decode(total[ends] - total[ends - many], np.array(sizes))]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))
