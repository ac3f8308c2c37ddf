"""Regions of images as relations: runs of pixels, links between runs, sums over regions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cathodyne.functions.pixels import otsu, runs_of
from cathodyne.functions.touch import smallest_linked, touching
from cathodyne.plans.components import connected_components
from cathodyne.sources.shared import keep

RUN_SCHEMA = "image_id string, z int, y int, x0 int, x1 int, value double"
#: Columns of an image that one join key covers.
STRIP = 256
#: Rows and slices of a band, which is linked in one task.
BAND, SLICES = 64, 16
#: Runs with the first run that they are connected with in their band.
PART_SCHEMA = f"{RUN_SCHEMA}, part_z int, part_y int, part_x0 int"
_RUN_NAMES, _PART_NAMES = ([c.split()[0] for c in schema.split(", ")] for schema in (RUN_SCHEMA, PART_SCHEMA))


def frame_runs(frames: DataFrame, level: float | None = None, dark: bool = True) -> DataFrame:
    """Runs (image_id, z, y, x0, x1, value) of dark, or bright, pixels of decoded frames; ``value`` sums the pixels.

    Without a ``level`` each frame is parted at its own Otsu level. Frames that were not decoded have no runs.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.itertuples():
                pixels = np.frombuffer(f.pixels, f"<u{int(f.bit_depth) // 8}").reshape(int(f.height), int(f.width))
                at = otsu(pixels) if level is None else level
                y, x0, x1 = runs_of(pixels <= at if dark else pixels > at)
                sums = np.pad(pixels.astype(float).cumsum(1), ((0, 0), (1, 0)))
                yield pd.DataFrame({"image_id": f.image_id, "z": f.z, "y": y, "x0": x0, "x1": x1, "value": sums[y, x1 + 1] - sums[y, x0]})

    return frames.where("pixels is not null").select("image_id", "z", "bit_depth", "height", "width", "pixels").mapInPandas(cut, RUN_SCHEMA)


def cell_runs(cells: DataFrame) -> DataFrame:
    """The same runs from one row per lit cell (image_id, z, y, x, value)."""
    row = Window.partitionBy("image_id", "z", "y").orderBy("x")
    runs = cells.withColumn("run", F.col("x") - F.row_number().over(row)).groupBy("image_id", "z", "y", "run")
    return runs.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.sum("value").alias("value")).drop("run")


def label_runs(runs: DataFrame, diagonal: bool = False, volume: bool = False) -> DataFrame:
    """``runs`` with ``region``, the run (z, y, x0) that comes first in the region.

    Runs of neighbouring rows touch if their columns overlap, ``diagonal`` ones also corner to corner;
    in a ``volume``, runs of neighbouring slices touch in the same row. Runs are linked within bands of ``BAND`` rows of ``SLICES``
    slices first, so no task holds an image; what bands hold apart is joined by ``join_bands``.
    """

    def of(runs: pa.Table) -> pa.Table:
        runs = runs.sort_by([("z", "ascending"), ("y", "ascending"), ("x0", "ascending")])
        z, y, x0, x1 = (runs.column(c).to_numpy().astype(np.int64) for c in ("z", "y", "x0", "x1"))
        first = first_runs(z, y, x0, x1, diagonal, volume)
        for c, values in (("part_z", z), ("part_y", y), ("part_x0", x0)):
            runs = runs.append_column(c, pa.array(values[first].astype(np.int32)))
        return runs.select(_PART_NAMES)

    here = runs.select("image_id", *[F.col(c).cast("int") for c in ("z", "y", "x0", "x1")], F.col("value").cast("double"))
    parts = here.groupBy("image_id", F.floor(F.col("z") / SLICES).alias("slices"), F.floor(F.col("y") / BAND).alias("band")).applyInArrow(of, PART_SCHEMA)
    return join_bands(parts, diagonal, volume)


def first_runs(z: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, diagonal: bool = False, volume: bool = False) -> np.ndarray:
    """For each run of a band, all sorted by slice, row and column, the place of the first it is connected with."""
    reach = 1 if diagonal else 0
    row = (z - z.min()) * (BAND + 1) + y - y.min() if len(z) else z  # an empty row keeps slices apart
    runs = (row, x0, x1)
    links = [touching(runs, runs, down, reach) for down in ([1, BAND + 1] if volume else [1])]
    return smallest_linked(len(row), *(np.concatenate(ends) for ends in zip(*links)))


def join_bands(parts: DataFrame, diagonal: bool = False, volume: bool = False) -> DataFrame:
    """Runs with their ``region``, from runs with the first run of what they are connected with in their band (``PART_SCHEMA``).

    Only runs on the border of a band meet those of the next, by image, slice, row and strip of columns, and labels spread
    over the graph of what they connect; a band that touches no other keeps its labels.
    """
    parts, reach = keep(parts, "parts"), 1 if diagonal else 0
    part = F.struct(F.col("part_z").alias("z"), F.col("part_y").alias("y"), F.col("part_x0").alias("x0"))
    named = parts.select(*_RUN_NAMES, part.alias("part"), F.xxhash64("image_id", "part_z", "part_y", "part_x0").alias("id"))
    strips = F.explode(F.sequence(F.floor(F.col("x0") / STRIP), F.floor((F.col("x1") + reach) / STRIP))).alias("strip")
    touch = (F.col("a0") <= F.col("b1") + reach) & (F.col("b0") <= F.col("a1") + reach)
    met = []
    for axis, size in [("y", BAND)] + [("z", SLICES)] * volume:
        last = named.where(F.pmod(axis, F.lit(size)) == size - 1).select("image_id", "z", "y", strips, F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("id").alias("a"), F.col("part").alias("a_part"))
        first = named.where(F.pmod(axis, F.lit(size)) == 0).withColumn(axis, F.col(axis) - 1)
        first = first.select("image_id", "z", "y", strips, F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("id").alias("b"), F.col("part").alias("b_part"))
        met.append(last.join(first, ["image_id", "z", "y", "strip"]).where(touch).select("image_id", "a", "a_part", "b", "b_part"))
    links = keep(reduce(DataFrame.unionByName, met).distinct(), "borders")
    if links.isEmpty():
        return named.select(*_RUN_NAMES, F.col("part").alias("region"))
    ends = links.select("image_id", F.col("a").alias("id"), F.col("a_part").alias("part")).unionByName(links.select("image_id", F.col("b").alias("id"), F.col("b_part").alias("part"))).distinct()
    joined = ends.join(connected_components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = joined.groupBy("image_id", "component").agg(F.min("part").alias("region"))
    regions = keep(joined.join(first, ["image_id", "component"]).select("id", "region"), "regions")
    return named.join(regions, "id", "left").select(*_RUN_NAMES, F.coalesce("region", "part").alias("region"))


def region_properties(labelled: DataFrame) -> DataFrame:
    """One row per region: size, box, centre, mean value, and how much of its box it fills."""
    n = F.col("x1") - F.col("x0") + 1
    out = labelled.groupBy("image_id", "region").agg(
        F.sum(n).alias("area"),
        F.min("z").alias("z0"), F.max("z").alias("z1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        F.sum(n * F.col("y")).alias("sum_y"), F.sum((F.col("x0") + F.col("x1")) * n / 2).alias("sum_x"), F.sum("value").alias("total"),
    )
    return region_shape(out)


def region_shape(sums: DataFrame) -> DataFrame:
    """Regions with what their sums tell of their shape."""
    box = (F.col("z1") - F.col("z0") + 1) * (F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1)
    return sums.select(
        "image_id", F.col("region.z").alias("seed_z"), F.col("region.y").alias("seed_y"), F.col("region.x0").alias("seed_x"),
        "area", "z0", "z1", "y0", "y1", "x0", "x1",
        (F.col("sum_y") / F.col("area")).alias("centre_y"), (F.col("sum_x") / F.col("area")).alias("centre_x"),
        (F.col("total") / F.col("area")).alias("mean_value"), (F.col("area") / box).alias("fill"),
    )


def classify(regions: DataFrame, classes: list[tuple[str, Column]], other: str = "other") -> DataFrame:
    """Adds ``defect``: the first class whose condition holds."""
    out = F.lit(other)
    for name, condition in reversed(classes):
        out = F.when(condition, name).otherwise(out)
    return regions.withColumn("defect", out)


def summarise(regions: DataFrame, *by: str) -> DataFrame:
    """Number, area and largest area of regions by the given columns."""
    return regions.groupBy(*by).agg(F.count("*").alias("n_regions"), F.sum("area").alias("total_area"), F.max("area").alias("largest_area"), F.avg("area").alias("mean_area"))
