"""Squared distances along columns; numpy only."""

from __future__ import annotations

import numpy as np


def lower_envelope(f: np.ndarray) -> np.ndarray:
    """For each column of the whole numbers ``f``, the least of (y - v)^2 + f[v] over its rows v, at every row y.

    Each row is a parabola; a column keeps those of its lower envelope on a stack, with the places
    where they take over. All columns move on together, row by row.
    """
    height, width = f.shape
    g = f + np.arange(height)[:, None] ** 2
    columns = np.arange(width)
    vertex, begins = np.zeros((height, width), np.int64), np.full((height + 1, width), np.inf)
    begins[0] = -np.inf
    top = np.zeros(width, np.int64)
    for q in range(1, height):
        active = columns
        at = np.empty(width)
        while len(active):
            v = vertex[top[active], active]
            at[active] = (g[q, active] - g[v, active]) / (2.0 * (q - v))
            active = active[at[active] <= begins[top[active], active]]
            top[active] -= 1
        top += 1
        vertex[top, columns] = q
        begins[top, columns] = at
        begins[top + 1, columns] = np.inf
    out, top = np.empty_like(f), np.zeros(width, np.int64)
    for q in range(height):
        active = columns
        while len(active):
            active = active[begins[top[active] + 1, active] < q]
            top[active] += 1
        v = vertex[top, columns]
        out[q] = (q - v) ** 2 + f[v, columns]
    return out
