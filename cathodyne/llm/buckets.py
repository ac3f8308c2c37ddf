"""Links within buckets of any size, as a row per member and not per pair."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cathodyne.llm.common import connected_components, keep

#: Members of a block, and the most they may weigh together.
UNIT_ROWS, UNIT_LOAD = 1000, 2_000_000
#: Pairs that are looked up at once.
STEP = 4096

_UNIT = ["bucket", "i", "j"]


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray, sure: Callable[[int, int], bool] | None = None) -> None:
    """Unites the pairs (a, b) in ``root``, which names the smallest of each set; ``sure`` is asked of those not yet together."""
    for at in range(0, len(a), STEP):
        p, q = a[at : at + STEP], b[at : at + STEP]
        apart = root[p] != root[q]
        for x, y in zip(p[apart].tolist(), q[apart].tolist()):
            r, s = root[x], root[y]
            if r != s and (sure is None or sure(x, y)):
                root[root == max(r, s)] = min(r, s)


def bucket_links(members: DataFrame, link: Callable[[pd.DataFrame, np.ndarray], None], payload: DataFrame | None = None, most_rows: int = UNIT_ROWS, most_load: int = UNIT_LOAD) -> DataFrame:
    """Links (a, b) that connect what ``link`` unites among the nodes of each bucket.

    ``members`` has rows (bucket, node, load); ``payload`` has what else ``link`` needs of each node.
    ``link`` gets the nodes of a unit and their roots, and unites those that belong together. A
    bucket is dealt out in blocks by hash, and each block is a unit. Where a bucket has several blocks, the
    members outside its largest connected set meet all blocks in units of two blocks. So every two
    members that are not connected otherwise meet, no unit outgrows two blocks, and a large set that
    is connected soon costs no more than its members.
    """
    blocks = F.greatest(F.ceil(F.count("*") / most_rows), F.ceil(F.sum("load") / most_load)).cast("int")
    sizes = keep(members.groupBy("bucket").agg(blocks.alias("blocks")), "sizes")
    block = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int").alias("block")
    dealt = members.join(sizes, "bucket").select("bucket", "node", "load", "blocks", block)
    found = keep(_linked(dealt.select("bucket", F.col("block").alias("i"), F.lit(-1).alias("j"), "node", F.col("node").alias("grp")), link, payload), "unit-links")
    if sizes.where("blocks > 1").isEmpty():
        return found
    joined = connected_components(found).withColumnRenamed("id", "node")
    within = keep(dealt.where("blocks > 1").join(joined, "node", "left").withColumn("grp", F.coalesce("component", "node")).drop("component"), "within")
    by_group = within.groupBy("bucket", "grp").agg(F.count("*").alias("n"), F.sum("load").alias("load"))
    size = F.struct("n", "load", "grp")
    rest = by_group.groupBy("bucket").agg(F.max(size).alias("main"), F.sum("n").alias("n"), F.sum("load").alias("load"))
    outside = F.greatest(F.ceil((F.col("n") - F.col("main.n")) / most_rows), F.ceil((F.col("load") - F.col("main.load")) / most_load)).cast("int")
    rest = rest.where("n > main.n").select("bucket", F.col("main.grp").alias("main"), outside.alias("outside"))
    both = within.join(rest, "bucket")
    others = both.where("grp != main").withColumn("i", F.pmod(F.xxhash64("node", F.lit("outside")), F.col("outside")).cast("int"))
    others = others.select("bucket", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "node", "grp")
    every = both.select("bucket", F.explode(F.sequence(F.lit(0), F.col("outside") - 1)).alias("i"), F.col("block").alias("j"), "node", "grp")
    return found.unionByName(keep(_linked(others.unionByName(every), link, payload), "unit-links"))


def _linked(units: DataFrame, link: Callable[[pd.DataFrame, np.ndarray], None], payload: DataFrame | None) -> DataFrame:
    def of(unit: pd.DataFrame) -> pd.DataFrame:
        unit = unit.drop_duplicates("node", ignore_index=True)
        groups, first, own = np.unique(unit["grp"], return_index=True, return_inverse=True)
        root = first[own]
        if len(groups) > 1:
            link(unit, root)
        nodes = unit["node"].to_numpy()
        new = groups[own] != unit["grp"].to_numpy()[root]
        return pd.DataFrame({"a": nodes[root[new]], "b": nodes[new]})

    parts = 4 * units.sparkSession.sparkContext.defaultParallelism
    rows = units if payload is None else units.join(payload, "node")
    # Dealt out by number and not by bytes, as units take long for their size.
    return rows.repartition(parts, *_UNIT).groupBy(*_UNIT).applyInPandas(of, "a long, b long")
