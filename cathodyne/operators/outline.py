"""Outlines of regions: edges, holes, Euler number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cathodyne.operators.regions import STRIP


def region_outlines(labelled: DataFrame) -> DataFrame:
    """One row per region of a slice: area, perimeter in cell edges (holes included), Euler number and holes.

    ``labelled`` has runs whose regions lie in one slice each and are connected side to side. The cells, their pairs side by
    side and their blocks of two by two are the corners, edges and faces of the region; a hole is dark and connected corner to
    corner. All three are counted on runs and on pairs of runs of neighbouring rows, which meet once, in the strip of columns where their overlap begins.
    """
    strips = F.explode(F.sequence(F.floor(F.col("x0") / STRIP), F.floor(F.col("x1") / STRIP)))
    here = labelled.select("image_id", "z", "region", "y", strips.alias("strip"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    there = labelled.select("image_id", "z", (F.col("y") - 1).alias("y"), strips.alias("strip"), F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    first, shared = F.greatest("a0", "b0"), F.least("a1", "b1") - F.greatest("a0", "b0") + 1
    met = here.join(there, ["image_id", "z", "y", "strip"]).where((shared > 0) & (F.floor(first / STRIP) == F.col("strip")))
    width, none = F.col("x1") - F.col("x0") + 1, F.lit(0)
    own = labelled.select("image_id", "z", "region", width.alias("cells"), (width - 1).alias("pairs"), none.alias("blocks"))
    rows = own.unionByName(met.select("image_id", "z", "region", none.alias("cells"), shared.alias("pairs"), (shared - 1).alias("blocks")))
    sums = rows.groupBy("image_id", "z", "region").agg(*[F.sum(c).alias(c) for c in ("cells", "pairs", "blocks")])
    euler = F.col("cells") - F.col("pairs") + F.col("blocks")
    return sums.select(
        "image_id", "z", F.col("region.y").alias("seed_y"), F.col("region.x0").alias("seed_x"), F.col("cells").alias("area"),
        (4 * F.col("cells") - 2 * F.col("pairs")).alias("perimeter"), euler.alias("euler"), (1 - euler).alias("holes"),
    )
