import struct
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from cathodyne.functions.pixels import decode_grey, otsu, runs_of
from cathodyne.operators.regions import cell_runs, label_runs, region_properties, summarise
from cathodyne.plans.defects import find_defects
from cathodyne.sources.frames import read_frames
from cathodyne.streaming.ingest import watch


def pgm(p):
    return b"P5\n# made here\n%d %d\n%d\n" % (p.shape[1], p.shape[0], 65535 if p.itemsize == 2 else 255) + p.astype(">u2" if p.itemsize == 2 else "u1").tobytes()


def tiff(p, order="<"):
    raw = p.astype(order + "u2").tobytes() if p.itemsize == 2 else p.tobytes()
    entries = [(256, p.shape[1]), (257, p.shape[0]), (258, p.itemsize * 8), (259, 1), (273, 8), (277, 1), (278, p.shape[0]), (279, len(raw))]
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8 + len(raw))
    return head + raw + struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHII", t, 4, 1, v) for t, v in entries) + b"\0" * 4


def png(p, kinds):
    step, rows, up = p.itemsize, [], None
    data = p.astype(">u2").tobytes() if step == 2 else p.tobytes()
    width = p.shape[1] * step
    for y in range(p.shape[0]):
        line, kind = data[y * width : (y + 1) * width], kinds[y % len(kinds)]
        up = up or bytes(width)
        out = bytearray()
        for i, v in enumerate(line):
            a, b, c = (line[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
            guess = [0, a, b, (a + b) // 2, min((a, b, c), key=lambda x: abs(a + b - c - x))][kind]
            out.append((v - guess) & 255)
        rows.append(bytes([kind]) + out)
        up = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", p.shape[1], p.shape[0], step * 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
def test_decoders_keep_every_value(dtype):
    p = np.random.default_rng(0).integers(0, np.iinfo(dtype).max + 1, (9, 7)).astype(dtype)
    for content in (pgm(p), tiff(p), tiff(p, ">"), png(p, [0, 1, 2, 3, 4])):
        assert (decode_grey(content) == p).all()


def test_decoder_refuses_others():
    for content in (b"", b"P5\n3", b"\x89PNG\r\n\x1a\nxx", b"II*\0\xff\xff\xff\x7f", b"text", b"P5 4 4 255 \0"):
        assert decode_grey(content) is None


@pytest.mark.parametrize("content", [b"\x89PNG\r\n\x1a\n", b"P5 -1 4 255\n1234", b"P5 2 2 0\n1234", b"P5 2 2 70000\n12345678", b"P5 0 2 255\n", b"P5 99999999999999999999 9 255\n1", b"P5 4294967296 4294967296 255\n1"])
def test_broken_headers_are_refused(content):
    assert decode_grey(content) is None


def test_otsu_and_runs():
    p = np.array([[10, 10, 200, 200], [11, 200, 10, 200]])
    assert otsu(p) == 11
    assert otsu(np.zeros((0, 0))) == 0 and (np.full((2, 2), 7) <= otsu(np.full((2, 2), 7))).sum() == 0
    y, a, b = runs_of(p <= 11)
    assert list(zip(y, a, b)) == [(0, 0, 1), (1, 0, 0), (1, 2, 2)]


def flood(cells, diagonal, volume):
    steps = [(0, dy, dx) for dy, dx in product((-1, 0, 1), repeat=2) if (dy or dx) and (diagonal or not (dy and dx))] + [(1, 0, 0), (-1, 0, 0)] * volume
    left, out = set(cells), []
    while left:
        todo, region = [left.pop()], []
        while todo:
            c = todo.pop()
            region.append(c)
            for s in steps:
                n = tuple(i + j for i, j in zip(c, s))
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out.append(region)
    return out


@pytest.mark.parametrize(("diagonal", "volume"), [(False, False), (True, False), (False, True)])
def test_labels_match_flood_fill(spark, diagonal, volume):
    grid = np.random.default_rng(3).random((2, 8, 300)) < 0.4
    cells = [tuple(map(int, c)) for c in np.argwhere(grid)]
    rows = spark.createDataFrame([("i", *c, 1.0) for c in cells], "image_id string, z int, y int, x int, value double")
    got = region_properties(label_runs(cell_runs(rows), diagonal, volume)).collect()
    want = flood(cells, diagonal, volume)
    assert sorted((r.seed_z, r.seed_y, r.area, r.y0, r.y1, r.x0, r.x1) for r in got) == sorted(
        (min(c)[0], min(c)[1], len(c), min(y for _, y, _ in c), max(y for _, y, _ in c), min(x for *_, x in c), max(x for *_, x in c)) for c in want
    )


def test_defects_of_files(spark, tmp_path):
    frame = np.full((40, 60), 3000, np.uint16)
    frame[5:9, 5:9] = 300  # a pore
    frame[20, 10:50] = 200  # a crack
    frame[0, 59] = 100  # too small
    (tmp_path / "cell_3.pgm").write_bytes(pgm(frame))
    (tmp_path / "flat_1.tif").write_bytes(tiff(np.full((4, 4), 700, np.uint16)))
    (tmp_path / "broken.tif").write_bytes(b"II*\0")
    frames = read_frames(spark, str(tmp_path))
    assert {r.image_id: (r.z, r.height) for r in frames.collect()} == {"cell": (3, 40), "flat": (1, 4), "broken": (0, None)}
    defects = find_defects(frames)
    assert sorted((r.image_id, r.seed_z, r.defect, r.area, r.y0, r.x1) for r in defects.collect()) == [("cell", 3, "crack", 40, 20, 49), ("cell", 3, "pore", 16, 5, 8)]
    assert [tuple(r) for r in summarise(defects, "image_id").collect()] == [("cell", 2, 56, 40, 28.0)]


def test_streamed_files(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    frame = np.full((10, 10), 200, np.uint8)
    frame[2:5, 2:5] = 10
    for k in range(2):
        (source / f"a{k}_0.pgm").write_bytes(pgm(frame))
        watch(spark, str(source), out, str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(r.image_id for r in got.collect()) == ["a0", "a1"] and got.where(F.col("area") != 9).isEmpty()
