"""Operator 12 against plain numpy, in exact numbers where they are whole."""

import os
from fractions import Fraction

import numpy as np
import pytest

from cathodyne.llm.queries import QUERIES
from cathodyne.llm.whitening import eigenvectors, refine, whiten

DATA = "/root/testdata/sf0.001"


def plain(rows, most=16):
    """Result by vec_id: (n, deviation, whitened by component up to sign, explained)."""
    kept = [(k, [np.float32(c).item() for c in v]) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    xs = [tuple(int(np.floor(64 * c)) + 1_000_000 for c in v) for _, v in kept]
    fit = np.array(sorted(set(xs)), np.int64)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    trace = ((centred**2).sum() / n).item()
    out = []
    for (k, _), x in zip(kept, xs):
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums))
        out.append((k, n, deviation, (np.array(x) - sums / n) @ vectors / np.sqrt(values), values / trace))
    return out


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(k, v, 1, "x") for k, v in rows], f"vec_id long, embedding array<{kind}>, n int, x string").repartition(3)


def check(got, want):
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert sorted(by) == sorted({k for k, *_ in want})
    signs = None
    for k, n, deviation, whitened, explained in want:
        rows = sorted(by[k], key=lambda r: r.component)[: len(whitened)]
        mine = np.array([r.whitened for r in rows])
        if signs is None:
            signs = np.sign(mine * whitened)
        assert {(r.n, r.deviation) for r in rows} == {(n, deviation)}
        np.testing.assert_allclose(mine, whitened * signs, rtol=1e-7, atol=1e-7)
        np.testing.assert_allclose([r.explained for r in rows], explained, rtol=1e-9)
        assert all(0 <= r.identity_error <= 1e-9 for r in rows)


def test_against_numpy(spark):
    rng = np.random.default_rng(12)
    rows = [(k, (rng.normal(size=20) @ np.diag(np.linspace(0.3, 3, 20))).astype(np.float32).tolist()) for k in range(300)]
    rows += [(400, rows[0][1]), (401, rows[0][1])]
    odd = [(500, None), (501, [None] + [0.0] * 19), (502, [float("nan")] * 20), (503, [float("inf")] + [0.0] * 19), (504, []), (505, [1e30] + [0.0] * 19)]
    got = whiten(table(spark, rows + odd)).collect()
    assert len(got) == 16 * len(rows)
    check(got, plain(rows))


def test_refinement_gives_double_precision_and_tells_clusters_apart():
    rng = np.random.default_rng(13)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    values = np.concatenate([[5.0, 5.0 + 1e-9, 5.0 + 2e-9, 4.0, 4.0, 4.0], np.linspace(1, 3, 30), [1e-3] * 4])
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    got, x = eigenvectors(a)
    np.testing.assert_allclose(got, np.sort(values)[::-1], rtol=1e-13, atol=1e-14)
    np.testing.assert_allclose(x.T @ x, np.eye(40), atol=5e-15)
    assert np.abs(a @ x - x * got).max() < 2e-14
    rough = np.linalg.eigh(a.astype(np.float32))[1]
    assert np.abs(a @ rough - rough * got[::-1]).max() > 1e-8  # what refinement had to mend
    assert np.abs(refine(a, rough.astype(float))[1].T @ x).max(1).min() > 0.5


def test_exact_sums(spark):
    rows = [(k, [(-1) ** k * 3.0e6 + k, 0.5 * k]) for k in range(9)]
    got = whiten(table(spark, rows, "double")).collect()
    xs = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(x[j] for x in xs) for j in range(2)]
    want = {k: int(sum((Fraction(9 * x[j]) - sums[j]) ** 2 for j in range(2))) for k, x in enumerate(xs)}
    assert {r.vec_id: r.deviation for r in got} == want


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(k, [(-1) ** k * 1.0e8 * k, 1.0 * k]) for k in range(9)]
    got = {r.vec_id: r.deviation for r in whiten(table(spark, rows, "double")).collect()}
    assert got[8] is None and len(got) == 9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_without_spread_there_are_no_components(spark, rows):
    assert whiten(table(spark, rows)).isEmpty()


def test_few_vectors_lengths_and_null_ids(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 9.0]), (None, [2.0, 2.0, 9.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (4, [5.0, 1.0]), (4, [5.0, 1.0])]
    got = sorted((r.vec_id or 0, r.component, r.n, round(abs(r.whitened), 6)) for r in whiten(table(spark, rows)).collect())
    assert [g[:3] for g in got] == [(0, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 3), (3, 2, 3)] + [(4, 1, 3)] * 3 + [(4, 2, 3)] * 3
    assert all(g[3] == 1.0 for g in got[:3])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    check(QUERIES["op12_whiten"](spark, DATA).collect(), plain(rows))
