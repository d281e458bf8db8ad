"""A linear chain of two labels, inside and end, whose training can be summed over any number of tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Places that one step of numpy takes together.
_TOGETHER = 1 << 18
#: Sums over tasks are whole multiples of this, so that they are the same in whatever order they are added.
UNIT = 2.0**-40


def _padded(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences of about one length together: their numbers, where their places stand, and which places are theirs."""
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    k = 0
    while k < len(order):
        n, last = k + 1, len(order)
        while n < last and (n + 1 - k) * sizes[order[n]] <= _TOGETHER and sizes[order[n]] <= 2 * sizes[order[k]]:
            n += 1
        part, k = order[k:n], n
        step = np.arange(sizes[part].max())
        yield part, starts[part][:, None] + np.minimum(step, sizes[part][:, None] - 1), step < sizes[part][:, None]


def marginals(d: np.ndarray, sizes: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place the chance of an end; for each sequence the expected pairs of labels and the log of all scores' sum."""
    p, pairs, z = np.zeros(len(d)), np.zeros((len(sizes), 2, 2)), np.zeros(len(sizes))
    for part, at, own in _padded(sizes):
        s, m = d[at].T, at.shape[1]
        a, b = np.zeros((m, 2, len(part))), np.zeros((m, 2, len(part)))
        a[0, 1] = s[0]
        for j in range(1, m):
            x, o = a[j - 1], own[:, j]
            a[j, 0] = np.where(o, np.logaddexp(x[0] + t[0, 0], x[1] + t[1, 0]), x[0])
            a[j, 1] = np.where(o, np.logaddexp(x[0] + t[0, 1], x[1] + t[1, 1]) + s[j], x[1])
        for j in range(m - 2, -1, -1):
            x, y, o = b[j + 1, 0], b[j + 1, 1] + s[j + 1], own[:, j + 1]
            b[j, 0] = np.where(o, np.logaddexp(t[0, 0] + x, t[0, 1] + y), 0)
            b[j, 1] = np.where(o, np.logaddexp(t[1, 0] + x, t[1, 1] + y), 0)
        z[part] = np.logaddexp(a[-1, 0], a[-1, 1])
        p[at[own]] = np.exp(a[:, 1] + b[:, 1] - z[part]).T[own]
        for x in (0, 1):
            for y in (0, 1):
                pairs[part, x, y] = (np.exp(a[:-1, x] + t[x, y] + y * s[1:] + b[1:, y] - z[part]) * own.T[1:]).sum(axis=0)
    return p, pairs, z


def best(d: np.ndarray, sizes: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The best labels of each sequence (Viterbi)."""
    out = np.zeros(len(d), np.int64)
    for part, at, own in _padded(sizes):
        s, m = d[at].T, at.shape[1]
        score, came = np.stack([np.zeros(len(part)), s[0]]), np.zeros((m, 2, len(part)), bool)
        for j in range(1, m):
            o = own[:, j]
            reach = score[:, None] + t[:, :, None]
            came[j] = reach[1] > reach[0]
            now = reach.max(axis=0)
            now[1] += s[j]
            score = np.where(o, now, score)
        tag = (score[1] > score[0]).astype(np.int64)
        tags = np.empty((m, len(part)), np.int64)
        for j in range(m - 1, -1, -1):
            tags[j] = tag
            if j:
                tag = np.where(own[:, j], came[j, tag, np.arange(len(part))], tag)
        out[at[own]] = tags.T[own]
    return out


def sums(slots: np.ndarray, tags: np.ndarray, sizes: np.ndarray, weights: np.ndarray, w: np.ndarray, t: np.ndarray) -> Iterator[tuple[int, int]]:
    """The loss and its slope over sequences: slots of the places (a row each), true labels, lengths and weights.

    As (number, sum in whole units): numbers from 0 are slots, -1 is the loss, -2 to -5 are the pairs of labels.
    """
    d = w[slots].sum(axis=1, dtype=np.float64)
    p, pairs, z = marginals(d, sizes, t)
    each = np.repeat(weights, sizes)
    slope = np.rint((p - tags) * each / UNIT).astype(np.int64)
    total = np.zeros(len(w), np.int64)
    np.add.at(total, slots.ravel(), np.repeat(slope, slots.shape[1]))
    for k in np.flatnonzero(total).tolist():
        yield k, int(total[k])
    first = np.ones(len(d), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    after = np.flatnonzero(first)
    of = np.repeat(np.arange(len(sizes)), sizes)
    np.add.at(pairs, (of[after], tags[after - 1], tags[after]), -1.0)
    true = np.zeros(len(sizes))
    np.add.at(true, of, d * tags)
    np.add.at(true, of[after], t[tags[after - 1], tags[after]])
    yield -1, int(np.rint((z - true) * weights / UNIT).astype(np.int64).sum())
    for k, x in enumerate(np.rint(pairs.reshape(-1, 4) * weights[:, None] / UNIT).astype(np.int64).sum(axis=0).tolist()):
        yield -2 - k, x


def minimize(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, kept: int = 6, enough: float = 1e-4) -> np.ndarray:
    """Where a smooth function is least, by limited-memory BFGS with halved steps; each value is asked for once."""
    f, g = value(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, by = -g, []
        for s, y, r in reversed(moves):
            by.append(r * (s @ q))
            q = q - by[-1] * y
        q = q * (1 / (moves[-1][2] * (moves[-1][1] @ moves[-1][1])) if moves else 1 / max(1.0, np.linalg.norm(g)))
        for (s, y, r), a in zip(moves, reversed(by)):
            q = q + (a - r * (y @ q)) * s
        step, slope = 1.0, float(g @ q)
        while True:
            new = x + step * q
            f2, g2 = value(new)
            if f2 <= f + 1e-4 * step * slope:
                break
            step /= 2
            if step < 1e-6:
                return x
        s, y = new - x, g2 - g
        if s @ y > 1e-12:
            moves = [*moves[1 - kept :], (s, y, 1 / float(s @ y))]
        done = f - f2 <= enough * max(1.0, abs(f2))
        x, f, g = new, f2, g2
        if done:
            break
    return x
