"""How deep cells lie within their regions."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cathodyne.functions.envelope import lower_envelope

#: Columns of a frame that one task works on at a time.
STRIP = 256

_CELLS = pa.schema([("image_id", pa.string()), ("z", pa.int32()), ("y", pa.int32()), ("x", pa.int32()), ("depth2", pa.int64()), ("seed_z", pa.int32()), ("seed_y", pa.int32()), ("seed_x", pa.int32())])


def cell_depths(labelled: DataFrame) -> DataFrame:
    """Rows (image_id, z, y, x, depth2, region): the squared distance of each lit cell to the nearest cell of its slice that is not lit.

    ``labelled`` has runs with their regions. Cells outside the frame count as not lit. Distances are exact and separable: a run
    gives those along its row, and the lower envelope of parabolas down each column gives the rest. Frames are dealt
    out in strips of columns; a strip needs nothing of its neighbours, as its rows know their whole runs.
    """
    strips = F.explode(F.sequence(F.floor(F.col("x0") / STRIP), F.floor(F.col("x1") / STRIP)))
    seed = [F.col(f"region.{c}").alias(f"seed_{name}") for c, name in (("z", "z"), ("y", "y"), ("x0", "x"))]
    dealt = labelled.select("image_id", "z", "y", "x0", "x1", *seed, strips.alias("strip"))

    def of(key: tuple, runs: pa.Table) -> pa.Table:
        y, x0, x1 = (runs.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
        left = key[2].as_py() * STRIP
        a, b = np.maximum(x0, left), np.minimum(x1, left + STRIP - 1)
        top, lengths = y.min() - 1, b - a + 1
        run = np.repeat(np.arange(len(y)), lengths)
        x = a[run] + np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        f = np.zeros((y.max() - top + 2, b.max() - left + 1), np.int64)
        f[y[run] - top, x - left] = np.minimum(x - x0[run], x1[run] - x) + 1
        depth = lower_envelope(f * f)[y[run] - top, x - left]
        own = runs.take(pa.array(run))
        columns = {"image_id": own.column("image_id"), "z": own.column("z"), "y": own.column("y"), "x": pa.array(x.astype(np.int32)), "depth2": pa.array(depth)}
        return pa.table(columns | {f"seed_{c}": own.column(f"seed_{c}") for c in "zyx"}, schema=_CELLS)

    schema = "image_id string, z int, y int, x int, depth2 long, seed_z int, seed_y int, seed_x int"
    cells = dealt.groupBy("image_id", "z", "strip").applyInArrow(of, schema)
    return cells.select("image_id", "z", "y", "x", "depth2", F.struct(F.col("seed_z").alias("z"), F.col("seed_y").alias("y"), F.col("seed_x").alias("x0")).alias("region"))


def region_depths(cells: DataFrame) -> DataFrame:
    """One row per region: its size, and its deepest cell with the squared depth; of equally deep ones the first by slice, row and column."""
    first = F.struct((-F.col("depth2")).alias("less"), "z", "y", "x")
    out = cells.groupBy("image_id", "region").agg(F.count("*").alias("area"), F.min(first).alias("deep"))
    return out.select(
        "image_id", F.col("region.z").alias("seed_z"), F.col("region.y").alias("seed_y"), F.col("region.x0").alias("seed_x"), "area",
        (-F.col("deep.less")).alias("depth2"), F.col("deep.z").alias("deep_z"), F.col("deep.y").alias("deep_y"), F.col("deep.x").alias("deep_x"),
    )
