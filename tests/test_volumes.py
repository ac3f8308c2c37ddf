"""Volumes that arrive slice by slice against the same volumes at once."""

import numpy as np
import pytest

from cathodyne.functions.pixels import runs_of
from cathodyne.functions.touch import smallest_linked, touching
from cathodyne.operators.regions import frame_runs, label_runs, region_properties
from cathodyne.sources.frames import read_frames
from cathodyne.streaming.volumes import volume_regions, watch_volumes


def pgm(p):
    return b"P5\n%d %d\n255\n" % (p.shape[1], p.shape[0]) + p.astype("u1").tobytes()


def as_rows(df):
    return sorted(tuple(r) for r in df.select("image_id", "seed_z", "seed_y", "seed_x", "area", "z0", "z1", "y0", "y1", "x0", "x1", "centre_y", "centre_x", "mean_value", "fill").collect())


@pytest.mark.parametrize("reach", [0, 1])
def test_touching_runs(reach):
    rng = np.random.default_rng(1)
    masks = rng.random((2, 9, 14)) < 0.45
    a, b = (runs_of(m) for m in masks)
    for down in (0, 1):
        want = {(i, j) for i in range(len(a[0])) for j in range(len(b[0])) if b[0][j] == a[0][i] + down and a[1][i] <= b[2][j] + reach and b[1][j] <= a[2][i] + reach}
        assert set(zip(*(c.tolist() for c in touching(a, b, down, reach)))) == want
    none = tuple(np.zeros(0, int) for _ in range(3))
    assert len(touching(a, none, 1, reach)[0]) == len(touching(none, b, 1, reach)[0]) == 0
    assert smallest_linked(6, np.array([4, 1, 5]), np.array([1, 5, 2])).tolist() == [0, 1, 1, 3, 1, 1]


def test_slices_in_any_batches(spark, tmp_path):
    rng = np.random.default_rng(4)
    height = {"a": 21, "b": 8}
    files = {f"{v}_{z}.pgm": pgm(np.where(rng.random((height[v], 17)) < 0.3, rng.integers(1, 9, (height[v], 17)), 200)) for v, n in (("a", 6), ("b", 3)) for z in range(n)}
    ring = np.full((21, 17), 200)
    ring[3:18, 4:13] = 7
    files["u_0.pgm"], files["u_2.pgm"] = pgm(np.where((np.arange(21)[:, None] % 20 == 0) & np.ones((1, 17), bool), 7, 200)), pgm(np.full((21, 17), 200))
    files["u_1.pgm"] = pgm(ring)  # joins nothing of slice 0
    files["w_0.pgm"], files["w_1.pgm"] = pgm(np.where(np.isin(np.arange(17), (2, 14)) & np.ones((21, 1), bool), 7, 200)), pgm(np.full((21, 17), 7))  # two regions, joined by the slice behind
    files["broken_0.pgm"] = b"P5"
    whole = tmp_path / "whole"
    whole.mkdir()
    for name, content in files.items():
        (whole / name).write_bytes(content)
    want = as_rows(region_properties(label_runs(frame_runs(read_frames(spark, str(whole)), 100.0), volume=True)))
    assert any(r[5] < r[6] for r in want)

    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    source.mkdir()
    run = lambda: watch_volumes(spark, str(source), out, checkpoint, level=100.0, files_per_batch=7, rows=4).awaitTermination()
    order = rng.permutation(sorted(set(files) - {"w_1.pgm"})).tolist()
    for part in (order[:7], order[7:]):
        for name in part:
            (source / name).write_bytes(files[name])
        run()
    assert len([r for r in as_rows(volume_regions(spark, out)) if r[0] == "w"]) == 2
    (source / "w_1.pgm").write_bytes(files["w_1.pgm"])
    run()
    assert as_rows(volume_regions(spark, out)) == want
    (source / "w_01.pgm").write_bytes(files["w_0.pgm"])  # slice 1 of w again, with other cells
    run()
    assert as_rows(volume_regions(spark, out)) == want
