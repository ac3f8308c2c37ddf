"""Which runs touch which; numpy only."""

from __future__ import annotations

import numpy as np

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def touching(a: Runs, b: Runs, down: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (in ``a``, in ``b``) of runs (y, x0, x1) where that of ``b`` lies ``down`` rows below and shares a column, or comes within ``reach``.

    Runs of ``b`` must be sorted by row and column and not overlap, so those that one run touches are neighbours.
    """
    if not len(a[0]) or not len(b[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = int(max(a[2].max(), b[2].max())) + 2 * reach + 2  # no run reaches into the next row
    place = lambda y, x: y.astype(np.int64) * wide + x + reach
    first = np.searchsorted(place(b[0], b[2]), place(a[0] + down, a[1] - reach), "left")
    behind = np.searchsorted(place(b[0], b[1]), place(a[0] + down, a[2] + reach), "right")
    n = np.maximum(behind - first, 0)
    of_a = np.repeat(np.arange(len(n)), n)
    return of_a, np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def smallest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches by the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
