"""Parting of regions that touch: flooding from their deepest cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cathodyne.functions.flooding import nearest_peaks
from cathodyne.plans.components import flatten, follow
from cathodyne.sources.shared import discard, keep

#: Cells of a slice that is parted in one task.
TOGETHER = 1 << 18


def peaks(cells: DataFrame, reach: int, least: int = 1) -> DataFrame:
    """The cells of a region that are deeper than all others of it within ``reach`` rows and columns of their slice.

    ``cells`` are those of ``cell_depths``. Of equally deep cells the first by row and column is the
    deeper one. Cells below a squared depth of ``least`` are no peaks, but the deepest cell of each
    region in a slice always is one.
    """
    order = F.struct((-F.col("depth2")).alias("less"), "y", "x")
    region = ["image_id", "z", "region"]
    whole = cells.groupBy(*region).agg(F.min(order).alias("first"))
    deep = cells.where(F.col("depth2") >= least).withColumn("order", order)
    # The first within reach along the row, at every column it reaches; then the first of those down the column.
    spread = deep.select(*region, "y", F.explode(F.sequence(F.col("x") - reach, F.col("x") + reach)).alias("x"), "order")
    rows = spread.groupBy(*region, "y", "x").agg(F.min("order").alias("order"))
    column = Window.partitionBy(*region, "x").orderBy("y").rangeBetween(-reach, reach)
    near = rows.select(*region, "y", "x", F.min("order").over(column).alias("near"))
    local = near.where((F.col("near.y") == F.col("y")) & (F.col("near.x") == F.col("x"))).select(*region, "y", "x", (-F.col("near.less")).alias("depth2"))
    always = whole.select(*region, F.col("first.y").alias("y"), F.col("first.x").alias("x"), (-F.col("first.less")).alias("depth2"))
    return local.unionByName(always).distinct()


def flood(cells: DataFrame, seeds: DataFrame) -> DataFrame:
    """``cells`` with ``peak`` (y, x), the seed from which each is flooded first.

    Regions of a slice with a single seed are that seed's. In the others water rises from all seeds at once: of the edges
    between a flooded cell and a dry neighbour in its row or column, the deepest goes first, an edge being as
    deep as its shallower end; ties go by the row and column of the edge's first cell, edges along the row first. As no two edges
    are alike, the floods are the trees of one forest, and its edges are found in rounds: every part
    that holds no seed yet takes its first edge, parts that an edge joins become one, and each round at
    least halves their number. Cells are known by 63-bit hashes of their place: of a billion cells of
    such regions, about one pair in 18 such sets shares one.
    """
    region = ["image_id", "z", "region"]
    seeds = keep(seeds.select(*region, "y", "x"), "seeds")
    counts = seeds.groupBy(*region).agg(F.count("*").alias("n_seeds"), F.min(F.struct("y", "x")).alias("only"))
    many = keep(cells.join(counts, region), "flooded")
    alone = many.where("n_seeds = 1").select(*cells.columns, F.col("only").alias("peak"))
    # A seed's id is odd, any other is even.
    shared = many.where("n_seeds > 1").join(seeds.withColumn("seed", F.lit(1)), [*region, "y", "x"], "left")
    even = F.shiftleft(F.xxhash64("image_id", "z", "y", "x"), 1)
    shared = keep(shared.withColumn("id", even.bitwiseOR(F.coalesce("seed", F.lit(0)).cast("long"))).select(*cells.columns, "id"), "shared")

    # A cell's edges lead right and down; they meet by the cell they lead to.
    ahead = shared.select(*region, F.col("id").alias("a"), F.col("depth2").alias("a_depth"), F.col("y").alias("at_y"), F.col("x").alias("at_x"), F.explode(F.array(F.lit(0), F.lit(1))).alias("down"))
    ahead = ahead.withColumn("y", F.col("at_y") + F.col("down")).withColumn("x", F.col("at_x") + 1 - F.col("down"))
    there = shared.select(*region, "y", "x", F.col("id").alias("b"), F.col("depth2").alias("b_depth"))
    order = F.struct((-F.least("a_depth", "b_depth")).alias("less"), F.col("at_y").alias("y"), F.col("at_x").alias("x"), "down")
    edges = ahead.join(there, [*region, "y", "x"]).select("a", "b", order.alias("order"))
    placed = shared.join(_forest(edges), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = shared.where(_seeded("id")).select(F.col("id").alias("root"), F.struct("y", "x").alias("peak"))
    return alone.unionByName(placed.join(named, "root").select(*cells.columns, "peak"))


def part_regions(cells: DataFrame, reach: int, least: int = 1) -> DataFrame:
    """The kept ``cells`` with the ``peak`` of ``peaks`` from which ``flood`` reaches each.

    A slice of at most ``TOGETHER`` cells is parted in one task, by the same order of edges; larger ones go through the rounds of joins.
    """
    whole = ["image_id", "z"]
    large = keep(cells.groupBy(*whole).count().where(F.col("count") > TOGETHER).select(*whole), "large")
    some = not large.isEmpty()
    small = cells.join(large, whole, "left_anti") if some else cells
    flat = small.select("image_id", "z", "y", "x", "depth2", *[F.col(f"region.{c}").alias(f"region_{c}") for c in ("z", "y", "x0")])

    def of(cells: pa.Table) -> pa.Table:
        cells = cells.sort_by([("y", "ascending"), ("x", "ascending")])
        y, x, depth2 = (cells.column(c).to_numpy().astype(np.int64) for c in ("y", "x", "depth2"))
        names = np.stack([cells.column(f"region_{c}").to_numpy() for c in ("z", "y", "x0")], axis=1)
        peak = nearest_peaks(y, x, depth2, np.unique(names, axis=0, return_inverse=True)[1].ravel(), reach, least)
        return cells.append_column("peak_y", pa.array(y[peak].astype(np.int32))).append_column("peak_x", pa.array(x[peak].astype(np.int32)))

    schema = "image_id string, z int, y int, x int, depth2 long, region_z int, region_y int, region_x0 int, peak_y int, peak_x int"
    region, peak = F.struct(*[F.col(f"region_{c}").alias(c) for c in ("z", "y", "x0")]), F.struct(*[F.col(f"peak_{c}").alias(c) for c in "yx"])
    out = flat.groupBy(*whole).applyInArrow(of, schema).select("image_id", "z", "y", "x", "depth2", region.alias("region"), peak.alias("peak"))
    if some:
        rest = keep(cells.join(large, whole, "left_semi"), "large-cells")
        out = out.unionByName(flood(rest, peaks(rest, reach, least)).select(*out.columns))
    return out


def _seeded(id_col: str) -> Column:
    return F.col(id_col).bitwiseAND(F.lit(1)) == 1


def _forest(edges: DataFrame) -> DataFrame:
    """Rows (id, root) of all nodes but the seeds, which the odd ids are, by edges (a, b, order) of different order."""
    rounds: list[DataFrame] = []
    edges = keep(edges.where(~(_seeded("a") & _seeded("b"))), "edges")
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("id"), F.col("b").alias("root"), "order").unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("root"), "order"))
        best = ends.where(~_seeded("id")).groupBy("id").agg(F.min(F.struct("order", "root")).alias("best"))
        best = keep(best.select("id", "best.root"), "best")
        # Two parts without a seed that take the same edge would go round in a circle; the smaller stays.
        back = best.select(F.col("id").alias("root"), F.col("root").alias("back"))
        hooks = flatten(best.join(back, "root", "left").where("back is null or back != id or id > root").select("id", "root"))
        rounds.append(hooks)
        moved = edges
        for end in ("a", "b"):
            to = hooks.select(F.col("id").alias(end), F.col("root").alias("to"))
            moved = moved.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        moved = moved.where((F.col("a") != F.col("b")) & ~(_seeded("a") & _seeded("b")))
        rest = keep(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("order").alias("order")), "edges")
        discard(edges)
        edges = rest
    return follow(rounds) if rounds else edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


def part_areas(parted: DataFrame) -> DataFrame:
    """One row per part of a region: its peak, the squared depth there, its size, and how many parts the region has in that slice."""
    out = parted.groupBy("image_id", "z", "region", "peak").agg(F.count("*").alias("area"), F.max("depth2").alias("depth2"))
    parts = F.count("*").over(Window.partitionBy("image_id", "z", "region"))
    return out.select(
        "image_id", "z", F.col("region.y").alias("seed_y"), F.col("region.x0").alias("seed_x"),
        F.col("peak.y").alias("peak_y"), F.col("peak.x").alias("peak_x"), "depth2", "area", parts.alias("n_parts"),
    )
