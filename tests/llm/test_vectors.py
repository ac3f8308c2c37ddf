"""Operator 8 against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cathodyne.llm import vector_dedup
from cathodyne.llm.vector_dedup import _reachable, audit_recall, audited_vectors, connect, medoid, near_vectors, range_search, robust_prune


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, node int, vec string").repartition(3)


def vectors(seed=0, n=400, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, dim))
    return [(k, (centres[rng.integers(60)] + rng.choice([0.0, 0.05, 0.6]) * rng.normal(size=dim)).astype(np.float32).tolist(), int(rng.integers(3))) for k in range(n)]


def expected(rows, threshold=0.98):
    """Links, and the least id of what they connect."""
    good = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if good(v) else None for _, v, _ in rows]
    links = [[j for j in range(len(rows)) if j != i and a is not None and unit[j] is not None and len(a) == len(unit[j]) and rows[i][2] is not None and rows[i][2] == rows[j][2] and a @ unit[j] >= threshold] for i, a in enumerate(unit)]
    label = {}
    for i in range(len(rows)):
        todo = [i] if i not in label else []
        while todo:
            j = todo.pop()
            label[j] = i
            todo += [k for k in links[j] if k not in label]
    least = {}
    for i, c in label.items():
        if rows[i][0] is not None:
            least[c] = min(rows[i][0], least.get(c, rows[i][0]))
    return sorted((r[0] is None, r[0] or 0, len(links[i]), -1 if (c := least.get(label[i])) is None else c) for i, r in enumerate(rows))


def result(df):
    rows = df.collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in rows)
    return sorted((r.vec_id is None, r.vec_id or 0, r.n_links, -1 if r.component_id is None else r.component_id) for r in rows)


ODD = [
    (900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, [float("nan")] + [1.0] * 15, 1), (905, [float("inf")] + [1.0] * 15, 1),
    (906, [1.0] * 16, None), (907, [1.0] * 16, None), (908, [1.0] * 8, 2), (909, [2.0] * 8, 2), (910, [1e38] * 16, 2), (911, [1e-38] * 16, 2), (None, [1.0] * 16, 2),
]


def test_links_and_components(spark):
    rows = vectors() + ODD
    rows += [(951, *rows[3][1:]), (950, *rows[3][1:])]
    got = near_vectors(table(spark, rows))
    assert result(got) == expected(rows)
    assert audit_recall(table(spark, rows), got) == 1.0


def test_large_shards_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 40)
    rng = np.random.default_rng(7)
    base = rng.normal(size=16)
    rows = [(k, (base + 0.05 * rng.normal(size=16)).tolist(), 1) for k in range(160)] + [(k + 1000, v, c) for k, v, c in vectors(8, 60)]
    got, want = result(near_vectors(table(spark, rows))), expected(rows)
    assert [g[3] for g in got] == [w[3] for w in want]
    assert sum(g[2] for g in got) >= 0.99 * sum(w[2] for w in want) and all(g[2] <= w[2] for g, w in zip(got, want))


def test_graph_is_sparse_connected_and_searchable():
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(150, 8)), 10 + 0.01 * rng.normal(size=(50, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    start = medoid(x)
    edges = connect(x, robust_prune(x), start)
    assert _reachable(edges, start).all() and (edges >= 0).sum(1).mean() <= vector_dedup.DEGREE
    found = true = 0
    for q in range(len(x)):
        want = set(np.flatnonzero(x @ x[q] >= 0.95))
        got = set(range_search(x, edges, start, q, 0.95).tolist())
        assert got <= want
        found, true = found + len(got), true + len(want)
    assert found >= 0.99 * true


def test_repeated_rows_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1)]
    assert result(near_vectors(table(spark, rows))) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(5, [1.0, 2.0], 1)], [(5, [1.0, 2.0], 1), (4, [1.0, 2.0], 1)]])
def test_small_tables(spark, rows):
    assert result(near_vectors(table(spark, rows))) == expected(rows)
    assert table(spark, rows).where(F.lit(True)).count() == len(rows)


def test_a_dense_cloud_that_centroids_cut(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "SHARD", 150)
    rng = np.random.default_rng(21)
    centre = rng.normal(size=16)
    x = (centre / np.linalg.norm(centre) + 0.035 * rng.normal(size=(700, 16))).astype(np.float32)
    label = np.where(np.arange(len(x)) < 500, 1, 2)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    component = np.arange(len(x))
    while (step := np.where(linked, component[None, :], len(x)).min(1)).tolist() != component.tolist():
        component = step
    np.fill_diagonal(linked, False)
    assert 0.1 < linked.mean() < 0.5
    out = {r.vec_id: r for r in audited_vectors(table(spark, [(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, label))])).collect()}
    got = np.array([out[k].n_links for k in range(len(x))])
    assert (got <= linked.sum(1)).all() and got.sum() >= 0.98 * linked.sum()
    assert [out[k].component_id for k in range(len(x))] == component.tolist() and out[0].recall >= 0.98


def test_low_recall_turns_to_whole_labels(spark, monkeypatch):
    asked = []
    real = vector_dedup.near_vectors
    monkeypatch.setattr(vector_dedup, "near_vectors", lambda *a, whole, **k: asked.append(whole) or (real(*a, whole=True, **k) if whole else real(a[0], 0.999999)))
    rows = vectors(5, 300)
    out = audited_vectors(table(spark, rows))
    assert asked == [False, True] and result(out) == expected(rows) and out.first().recall == 1.0
