"""Depths, parts and trees of regions against plain versions on drawn frames."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from cathodyne.functions.envelope import lower_envelope
from cathodyne.operators import depth, fields, parting, regions
from cathodyne.operators.depth import cell_depths, region_depths
from cathodyne.operators.fields import above_neighbourhood, box_regions, box_sums, cells_above, dense, level_regions
from cathodyne.operators.outline import region_outlines
from cathodyne.operators.parting import flood, part_areas, part_regions, peaks
from cathodyne.operators.regions import cell_runs, label_runs
from cathodyne.operators.tracks import region_tracks
from cathodyne.operators.tree import level_runs, region_tree
from cathodyne.plans.queries import QUERIES

CELLS = "image_id string, z int, y int, x int, value double"


def smooth(rng, height, width, by=2):
    """Numbers that change slowly from cell to cell."""
    p = np.pad(rng.random((height, width)), by, mode="edge")
    return sum(p[a : a + height, b : b + width] for a in range(2 * by + 1) for b in range(2 * by + 1)) / (2 * by + 1) ** 2


def masks():
    rng = np.random.default_rng(1)
    out = {("a", 0): smooth(rng, 24, 31) > 0.5, ("a", 1): smooth(rng, 17, 9) > 0.47, ("b", 0): np.ones((7, 11), bool), ("c", 0): np.zeros((3, 3), bool)}
    dumbbell = np.zeros((11, 25), bool)
    dumbbell[1:10, 1:10] = dumbbell[2:9, 14:22] = dumbbell[5, 10:14] = True
    return out | {("d", 2): dumbbell, ("e", 0): np.array([[1]], bool)}


def labelled(spark, frames):
    rows = [(i, z, int(y), int(x), 1.0) for (i, z), m in frames.items() for y, x in zip(*np.nonzero(m))]
    return label_runs(cell_runs(spark.createDataFrame(rows, CELLS).repartition(3)))


def regions_of(mask):
    """The cells of each region by its first cell."""
    out, seen = {}, set()
    for start in zip(*np.nonzero(mask)):
        if start not in seen:
            todo, cells = [start], {start}
            while todo:
                y, x = todo.pop()
                for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= n[0] < mask.shape[0] and 0 <= n[1] < mask.shape[1] and mask[n] and n not in cells:
                        cells.add(n)
                        todo.append(n)
            seen |= cells
            out[tuple(map(int, start))] = {(int(a), int(b)) for a, b in cells}
    return out


def depths_of(mask):
    dark = np.argwhere(~np.pad(mask, 1)) - 1
    return {(int(y), int(x)): int(((dark - (y, x)) ** 2).sum(1).min()) for y, x in zip(*np.nonzero(mask))}


def peaks_of(cells, deep, reach, least):
    order = {c: (-deep[c], c) for c in cells}
    out = {min(cells, key=order.get)}
    return out | {c for c in cells if deep[c] >= least and all(order[c] <= order[o] for o in cells if abs(o[0] - c[0]) <= reach and abs(o[1] - c[1]) <= reach)}


def flooded(cells, deep, seeds):
    """A plain flood: a queue of edges, deepest first."""
    owner, queue = {s: s for s in seeds}, []

    def push(c):
        for n in ((c[0] + 1, c[1]), (c[0] - 1, c[1]), (c[0], c[1] + 1), (c[0], c[1] - 1)):
            if n in cells and n not in owner:
                heapq.heappush(queue, (-min(deep[c], deep[n]), *min(c, n), int(c[1] == n[1]), n, owner[c]))

    for s in seeds:
        push(s)
    while queue:
        *_, c, peak = heapq.heappop(queue)
        if c not in owner:
            owner[c] = peak
            push(c)
    return owner


def test_lower_envelope():
    rng = np.random.default_rng(2)
    for height, width in ((1, 1), (2, 5), (30, 7), (200, 3)):
        f = rng.integers(0, rng.choice([2, 50, 5000]), (height, width)) ** 2
        y = np.arange(height)
        want = (((y[:, None] - y[None, :]) ** 2)[:, :, None] + f[None]).min(1)
        assert (lower_envelope(f) == want).all()


@pytest.mark.parametrize("strip", [256, 5])
def test_depths(spark, monkeypatch, strip):
    monkeypatch.setattr(depth, "STRIP", strip)
    frames = masks()
    cells = cell_depths(labelled(spark, frames))
    got = {(r.image_id, r.z, r.y, r.x): (r.depth2, r.region.y, r.region.x0) for r in cells.collect()}
    want = {}
    best = set()
    for (i, z), m in frames.items():
        deep = depths_of(m)
        for seed, own in regions_of(m).items():
            want |= {(i, z, *c): (deep[c], *seed) for c in own}
            first = min(own, key=lambda c: (-deep[c], c))
            best.add((i, z, *seed, len(own), deep[first], z, *first))
    assert got == want
    assert {tuple(r) for r in region_depths(cells).collect()} == best


@pytest.mark.parametrize("reach, least", [(2, 2), (1, 1), (6, 4)])
def test_parts_equal_a_plain_flood(spark, reach, least):
    frames = masks()
    cells = cell_depths(labelled(spark, frames))
    seeds = peaks(cells, reach, least)
    want_seeds, want = set(), {}
    for (i, z), m in frames.items():
        deep = depths_of(m)
        for own in regions_of(m).values():
            own_seeds = peaks_of(own, deep, reach, least)
            want_seeds |= {(i, z, *s) for s in own_seeds}
            want |= {(i, z, *c): p for c, p in flooded(own, deep, own_seeds).items()}
    assert {(r.image_id, r.z, r.y, r.x) for r in seeds.collect()} == want_seeds and len(want_seeds) > 8
    parted = flood(cells, seeds)
    assert {(r.image_id, r.z, r.y, r.x): (r.peak.y, r.peak.x) for r in parted.collect()} == want
    sizes = {}
    for (i, z, *_), p in want.items():
        sizes[i, z, *p] = sizes.get((i, z, *p), 0) + 1
    got = {(r.image_id, r.z, r.peak_y, r.peak_x): r.area for r in part_areas(parted).collect()}
    assert got == sizes
    if reach == 6:
        assert sorted(n for (i, *_), n in got.items() if i == "d") == [56, 85]  # the bar is as deep everywhere, so ties by column give it to the left


def test_no_cells(spark):
    cells = cell_depths(labelled(spark, {("c", 0): np.zeros((3, 3), bool)}))
    assert cells.isEmpty() and region_depths(cells).isEmpty() and flood(cells, peaks(cells, 2)).isEmpty()


def plain_tree(levels, most):
    """Nodes as (first cell, area): (level, base, parent)."""
    sets = {}
    for t in range(1, most + 1):
        for seed, own in regions_of(levels >= t).items():
            sets.setdefault((seed, len(own)), []).append(t)
    nodes = {}
    for (seed, area), at in sets.items():
        base, parent = min(at), None
        if base > 1:
            parent = next((s, len(own)) for s, own in regions_of(levels >= base - 1).items() if seed in own)
        nodes[seed, area] = (max(at), base, parent)
    return nodes


@pytest.mark.parametrize("strip", [256, 3])
def test_tree(spark, monkeypatch, strip):
    monkeypatch.setattr(regions, "STRIP", strip)
    monkeypatch.setattr("cathodyne.operators.tree.STRIP", strip)
    rng = np.random.default_rng(6)
    frames = {"a": (smooth(rng, 15, 18, 1) * 9).astype(int), "b": (smooth(rng, 6, 5) * 6).astype(int), "c": np.zeros((2, 2), int), "d": np.full((3, 4), 20)}
    cells = spark.createDataFrame([(i, int(y), int(x), int(v)) for i, f in frames.items() for (y, x), v in np.ndenumerate(f)], "image_id string, y int, x int, level int")
    got = {(r.image_id, (r.seed_y, r.seed_x), r.area): r for r in region_tree(cells, 7).collect()}
    want = {(i, *k): v for i, f in frames.items() for k, v in plain_tree(f, 7).items()}
    assert set(got) == set(want) and len(want) > 20
    growth = {k: (v[2][1] - k[2]) / k[2] for k, v in want.items() if v[2]}
    for k, (level, base, parent) in want.items():
        r, children = got[k], [c for c, v in want.items() if v[2] and (c[0], *v[2]) == k]
        up = (k[0], *parent) if parent else None
        assert (r.level, r.base, r.n_children) == (level, base, len(children))
        assert (((r.parent_y, r.parent_x), r.parent_area) if r.parent_area else None) == parent and r.growth == growth.get(k)
        assert r.parent_level == (want[up][0] if up else None)
        calm = k in growth and growth[k] <= min([growth[c] for c in children] + [growth[up] for _ in "x" if up in growth], default=growth.get(k))
        assert r.stable == (calm and k[2] >= 2)


@pytest.mark.parametrize("radius", [0, 1, 4])
def test_box_sums(spark, radius):
    rng = np.random.default_rng(7)
    frame = rng.integers(0, 5, (6, 9)) * (rng.random((6, 9)) < 0.5)
    cells = spark.createDataFrame([("a", 0, int(y), int(x), int(v)) for (y, x), v in np.ndenumerate(frame) if v], "image_id string, z int, y int, x int, value long")
    whole = dense(cells, spark.createDataFrame([("a", 0), ("none", 3)], "image_id string, z int"), 6, 9)
    box = {(y, x): frame[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1] for y in range(6) for x in range(9)}
    got = box_sums(whole, radius).collect()
    assert {(r.y, r.x): (r.value, r.box) for r in got if r.image_id == "a"} == {k: (frame[k], b.sum()) for k, b in box.items()}
    assert {(r.value, r.box) for r in got if r.image_id == "none"} == {(0, 0)} and len(got) == 108
    above = {(r.image_id, r.y, r.x) for r in above_neighbourhood(whole, radius, 6, 9).collect()}
    assert above == {("a", *k) for k, b in box.items() if frame[k] > b.mean()}


def plain_tracks(frames):
    """Rows (image, z, first cell): (area, before, behind, event, ends, first of its track)."""
    own = {(i, z, seed): cells for (i, z), m in frames.items() for seed, cells in regions_of(m).items()}
    behind = {k: [n for n in own if n[0] == k[0] and n[1] == k[1] + 1 and own[n] & own[k]] for k in own}
    before = {k: [n for n in own if k in behind[n]] for k in own}
    out = {}
    for k in sorted(own):
        b, at = before[k], k
        while len(before[at]) == 1 and len(behind[before[at][0]]) == 1:
            at = before[at][0]
        event = "birth" if not b else "merge" if len(b) > 1 else "split" if len(behind[b[0]]) > 1 else "move"
        out[k] = (len(own[k]), len(b), len(behind[k]), event, not behind[k], at[1:])
    return out


@pytest.mark.parametrize("strip", [256, 4])
def test_tracks(spark, monkeypatch, strip):
    monkeypatch.setattr("cathodyne.operators.tracks.STRIP", strip)
    rng = np.random.default_rng(8)
    frames = {("a", z): smooth(rng, 14, 19) > 0.52 for z in range(5)} | {("b", z): np.eye(3, dtype=bool) for z in (0, 1, 3)}
    got = {(r.image_id, r.z, (r.seed_y, r.seed_x)): (r.area, r.n_before, r.n_behind, r.event, r.ends, (r.track_z, (r.track_y, r.track_x))) for r in region_tracks(labelled(spark, frames)).collect()}
    want = plain_tracks(frames)
    assert got == want and {w[3] for w in want.values()} == {"birth", "merge", "split", "move"}


def plain_outline(cells):
    """Edges of a region's cells that border on others, and its holes by floods of what is around and in it."""
    edges = sum((y + a, x + b) not in cells for y, x in cells for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))
    ys, xs = zip(*cells)
    left = {(y, x) for y in range(min(ys) - 1, max(ys) + 2) for x in range(min(xs) - 1, max(xs) + 2)} - cells
    floods = 0
    while left:
        todo, floods = [left.pop()], floods + 1
        while todo:
            y, x = todo.pop()
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
    return len(cells), edges, 2 - floods, floods - 1


@pytest.mark.parametrize("strip", [256, 4])
def test_outlines(spark, monkeypatch, strip):
    monkeypatch.setattr(regions, "STRIP", strip)
    monkeypatch.setattr("cathodyne.operators.outline.STRIP", strip)
    frames = masks() | {("f", 0): np.random.default_rng(9).random((20, 30)) < 0.7}
    got = {(r.image_id, r.z, (r.seed_y, r.seed_x)): (r.area, r.perimeter, r.euler, r.holes) for r in region_outlines(labelled(spark, frames)).collect()}
    want = {(i, z, seed): plain_outline(cells) for (i, z), m in frames.items() for seed, cells in regions_of(m).items()}
    assert got == want and max(w[3] for w in want.values()) > 3


def sparse(spark, frames):
    """The cells of frames that are not 0, in two rows each, and all cells."""
    some = [(i, z, int(y), int(x), part) for (i, z), f in frames.items() for (y, x), v in np.ndenumerate(f) if v for part in (1, int(v) - 1)]
    cells = spark.createDataFrame(some, "image_id string, z int, y int, x int, value long").repartition(3)
    summed = cells.groupBy("image_id", "z", "y", "x").agg(F.sum("value").alias("value"))
    return cells, dense(summed, spark.createDataFrame(list(frames), "image_id string, z int"), 17, 11)


def field_frames():
    rng = np.random.default_rng(10)
    return {(i, z): rng.integers(1, 6, (17, 11)) * (rng.random((17, 11)) < 0.5) for i, z in (("a", 0), ("a", 1), ("b", 5))}


@pytest.mark.parametrize("band, radius", [(64, 2), (5, 2), (3, 4), (4, 0)])
def test_fields_in_bands_equal_dense_ones(spark, monkeypatch, band, radius):
    for module in (fields, regions):
        monkeypatch.setattr(module, "BAND", band)
    cells, whole = sparse(spark, field_frames())
    columns = ["image_id", "z", "y", "x", "value", "box"]
    rows = lambda df, *names: sorted(map(tuple, df.select(*names).collect()))
    assert rows(cells_above(cells, radius, 17, 11), *columns) == rows(above_neighbourhood(whole, radius, 17, 11), *columns)
    least = 3 if radius == 0 else 4 * radius * radius + 20
    lit = box_sums(whole, radius).where(f"box >= {least}").selectExpr("image_id", "z", "y", "x", "double(box) value")
    want = {(r.image_id, r.z, *seed, len(own)) for (r, seed, own) in _regions_of_rows(lit.collect())}
    got = box_regions(cells, radius, 17, 11, least).selectExpr("*", "x1 - x0 + 1 n").groupBy("image_id", "region").sum("n").collect()
    assert {(r.image_id, r.region.z, r.region.y, r.region.x0, r["sum(n)"]) for r in got} == want and len(want) >= 3
    names = ["image_id", "z", "y", "x0", "x1", "region"]
    flat = cells.where("z = 5")
    levels = box_sums(whole.where("z = 5"), radius).selectExpr("image_id", "y", "x", "int(floor(box / 3)) level")
    assert rows(level_regions(flat, radius, 17, 11, 3, 6), *names) == rows(label_runs(level_runs(levels, 6)), *names)


def _regions_of_rows(rows):
    by = {}
    for r in rows:
        by.setdefault((r.image_id, r.z), (r, set()))[1].add((r.y, r.x))
    for r, cells in by.values():
        mask = np.zeros((40, 40), bool)
        mask[tuple(zip(*cells))] = True
        yield from ((r, seed, own) for seed, own in regions_of(mask).items())


@pytest.mark.parametrize("together", [1 << 18, 100, 0])
def test_parts_of_small_and_large_slices_are_the_same(spark, monkeypatch, together):
    monkeypatch.setattr(parting, "TOGETHER", together)
    frames = masks()
    cells = cell_depths(labelled(spark, frames))
    want = {}
    for (i, z), m in frames.items():
        deep = depths_of(m)
        for own in regions_of(m).values():
            want |= {(i, z, *c): p for c, p in flooded(own, deep, peaks_of(own, deep, 2, 2)).items()}
    assert {(r.image_id, r.z, r.y, r.x): (r.peak.y, r.peak.x) for r in part_regions(cells, 2, 2).collect()} == want


@pytest.mark.parametrize("diagonal, volume", [(False, False), (True, False), (True, True)])
def test_regions_go_on_through_bands(spark, monkeypatch, diagonal, volume):
    grid = np.random.default_rng(11).random((5, 23, 40)) < 0.45
    rows = spark.createDataFrame([("i", *map(int, c), 1.0) for c in np.argwhere(grid)], CELLS)
    want = sorted(map(tuple, label_runs(cell_runs(rows), diagonal, volume).collect()))
    monkeypatch.setattr(regions, "BAND", 4)
    monkeypatch.setattr(regions, "SLICES", 2)
    assert sorted(map(tuple, label_runs(cell_runs(rows), diagonal, volume).collect())) == want


def moved(spark):
    """Bytes that the session's stages have shuffled, spilled and written."""
    none, store = spark._jvm.java.util.ArrayList(), spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in map(stages.apply, range(stages.size())))


@pytest.mark.parametrize("name", ["raster_local", "raster_depths", "raster_outlines", "raster_parts", "raster_tree", "raster_tracks"])
def test_fields_travel_once(spark, name):
    before = moved(spark)
    QUERIES[name](spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save()
    assert moved(spark) - before < 80 * 60_000  # bytes for each item; a dense field alone has more
