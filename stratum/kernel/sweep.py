"""Plane sweep over rectangles, vectorised: which pairs of two sets, or of one, overlap."""

from __future__ import annotations

import numpy as np

#: Candidate pairs that are tested at once.
CHUNK = 2_000_000


def _ranges(first: np.ndarray, last: np.ndarray):
    """(i, j) for all j from first[i] to last[i], not included, in chunks of bounded size."""
    n = np.maximum(last - first, 0)
    at = np.concatenate([[0], np.cumsum(n)])
    start = 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + CHUNK, side="right")) - 1)
        k = n[start:stop]
        i = np.repeat(np.arange(start, stop), k)
        yield i, np.arange(len(i)) - np.repeat(at[start:stop] - at[start], k) + first[i]
        start = stop


def pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of rows (x1, y1, x2, y2) whose closed rectangles meet; callers test further. Both sides are sorted by x1: a pair
    is met from the side that begins first, among those of the other that begin before it ends."""
    oa, ob = np.argsort(a[:, 0], kind="stable"), np.argsort(b[:, 0], kind="stable")
    sa, sb = a[oa], b[ob]
    out = []
    for i, j in _ranges(np.searchsorted(sb[:, 0], sa[:, 0], side="left"), np.searchsorted(sb[:, 0], sa[:, 2], side="right")):
        hit = (sa[i, 1] <= sb[j, 3]) & (sb[j, 1] <= sa[i, 3])
        out.append((oa[i[hit]], ob[j[hit]]))
    for j, i in _ranges(np.searchsorted(sa[:, 0], sb[:, 0], side="right"), np.searchsorted(sa[:, 0], sb[:, 2], side="right")):
        hit = (sa[i, 1] <= sb[j, 3]) & (sb[j, 1] <= sa[i, 3])
        out.append((oa[i[hit]], ob[j[hit]]))
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))


def self_pairs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`pairs` for one set with itself: each pair of different rows once, in the order of x1."""
    order = np.argsort(a[:, 0], kind="stable")
    s, out = a[order], []
    for i, j in _ranges(np.arange(len(s)) + 1, np.searchsorted(s[:, 0], s[:, 2], side="right")):
        hit = (s[i, 1] <= s[j, 3]) & (s[j, 1] <= s[i, 3])
        out.append((order[i[hit]], order[j[hit]]))
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
