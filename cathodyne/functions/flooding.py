"""Peaks and floods of one slice; numpy only."""

from __future__ import annotations

import numpy as np


def nearest_peaks(y: np.ndarray, x: np.ndarray, depth2: np.ndarray, region: np.ndarray, reach: int, least: int) -> np.ndarray:
    """For each cell, all sorted by row and column, the place of the peak that floods it first.

    Edges between neighbours are taken in order, the deepest first; one joins two parts unless both hold a peak.
    """
    wide = int(x.max() - x.min()) + 2 * reach + 3  # no step leaves its row
    keys = y * wide + x
    rank = np.empty(len(y), np.int64)
    rank[np.lexsort((x, y, -depth2))] = np.arange(len(y))

    def beside(dy: int, dx: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of cells of a region that far apart."""
        at = np.searchsorted(keys, keys + dy * wide + dx)
        there = np.minimum(at, len(keys) - 1)
        here = np.flatnonzero((keys[there] == keys + dy * wide + dx) & (region[there] == region))
        return here, there[here]

    peak = depth2 >= least
    for dy in range(reach + 1):
        for dx in range(-reach, reach + 1):
            if dy or dx > 0:
                a, b = beside(dy, dx)
                peak[np.where(rank[a] > rank[b], a, b)] = False
    first = np.full(region.max() + 1, len(y))
    np.minimum.at(first, region, rank)
    peak |= rank == first[region]
    (seeds,) = np.nonzero(peak)
    n_seeds = np.bincount(region[seeds], minlength=len(first))
    only = np.zeros(len(first), np.int64)
    only[region[seeds]] = seeds
    out = only[region]
    ends = [(*pair, np.full(len(pair[0]), down)) for down, pair in enumerate((beside(0, 1), beside(1, 0)))]
    a, b, down = map(np.concatenate, zip(*ends))
    several = n_seeds[region[a]] > 1
    a, b, down = a[several], b[several], down[several]
    order = np.lexsort((down, a, -np.minimum(depth2[a], depth2[b])))
    root, seeded = list(range(len(y))), peak.tolist()

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for p, q in zip(a[order].tolist(), b[order].tolist()):
        p, q = find(p), find(q)
        if p != q and not (seeded[p] and seeded[q]):
            if seeded[q]:
                p, q = q, p
            root[q] = p
    # A part's root is its peak, as a part without one always hooks on to one with.
    for k in np.flatnonzero(n_seeds[region] > 1).tolist():
        out[k] = find(k)
    return out
