"""The tree of regions over falling thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cathodyne.operators.regions import STRIP, cell_runs, label_runs
from cathodyne.sources.shared import keep


def level_runs(cells: DataFrame, levels: int) -> DataFrame:
    """Runs of the cells that reach each level from 1 to ``levels``, a slice ``z`` for each level of an image; ``value`` sums the cells."""
    reached = F.explode(F.sequence(F.lit(1), F.least(F.col("level"), F.lit(levels))))
    return cell_runs(cells.where("level >= 1").select("image_id", reached.alias("z"), "y", "x", F.lit(1.0).alias("value")))


def region_tree(cells: DataFrame, levels: int, min_area: int = 2) -> DataFrame:
    """Nodes of the tree of regions: connected sets of cells (image_id, y, x, level) that reach a level, and the sets that hold them.

    One row per different set of cells: ``level`` is the highest at which it is a region, ``base`` the lowest;
    a set is known by its first cell by row and column, and its area. ``parent_*`` tells the next larger set,
    null for those at level 1. ``growth`` is what the parent adds, as a share of the node's own area; a
    node of at least ``min_area`` cells is ``stable`` if it has a parent and grows no more than its parent and its children do.

    The regions of all levels are worked out at once as slices of their own, so the tree takes as many rounds
    as the largest region and not one per level, and its data are those of the cells times the levels
    they reach. A region lies in the one of the level below that holds its first cell.
    """
    return tree_of(label_runs(level_runs(cells, levels)), min_area)


def tree_of(labelled: DataFrame, min_area: int = 2) -> DataFrame:
    """The tree, from the runs of all levels with their regions, a slice ``z`` for each level."""
    labelled = keep(labelled, "levels")
    sets = keep(labelled.groupBy("image_id", "z", "region").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area")), "sets")
    seed = ["image_id", F.col("region.y").alias("seed_y"), F.col("region.x0").alias("seed_x")]
    nodes = sets.groupBy(*seed, "area").agg(F.max("z").alias("level"), F.min("z").alias("base"))
    nodes = keep(nodes, "nodes")
    # The run below that holds a node's first cell, by row and strip of columns.
    strips = F.explode(F.sequence(F.floor(F.col("x0") / STRIP), F.floor(F.col("x1") / STRIP)))
    runs = labelled.select("image_id", "z", "y", "x0", "x1", strips.alias("strip"), "region")
    below = nodes.where("base > 1").select("*", (F.col("base") - 1).alias("z"), F.col("seed_y").alias("y"), F.floor(F.col("seed_x") / STRIP).alias("strip"))
    found = below.join(runs, ["image_id", "z", "y", "strip"]).where("x0 <= seed_x and seed_x <= x1")
    key = ["image_id", "seed_y", "seed_x", "area"]
    found = found.select(*key, "z", "region").join(sets.withColumnRenamed("area", "parent_area"), ["image_id", "z", "region"])
    parents = found.select(*key, F.col("region.y").alias("parent_y"), F.col("region.x0").alias("parent_x"), "parent_area")
    tree = nodes.join(parents, key, "left").withColumn("growth", (F.col("parent_area") - F.col("area")) / F.col("area"))
    tree = keep(tree, "tree")
    above = tree.select("image_id", F.col("seed_y").alias("parent_y"), F.col("seed_x").alias("parent_x"), F.col("area").alias("parent_area"), F.col("level").alias("parent_level"), F.col("growth").alias("parent_growth"))
    children = tree.where("parent_area is not null").groupBy("image_id", F.col("parent_y").alias("seed_y"), F.col("parent_x").alias("seed_x"), F.col("parent_area").alias("area")).agg(F.min("growth").alias("child_growth"), F.count("*").alias("n_children"))
    out = tree.join(above, ["image_id", "parent_y", "parent_x", "parent_area"], "left").join(children, key, "left")
    calm = (F.col("growth") <= F.coalesce("parent_growth", "growth")) & (F.col("growth") <= F.coalesce("child_growth", "growth"))
    return out.select(
        "image_id", "level", "base", "seed_y", "seed_x", "area", "parent_level", "parent_y", "parent_x", "parent_area", "growth",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), (F.col("growth").isNotNull() & calm & (F.col("area") >= min_area)).alias("stable"),
    )
