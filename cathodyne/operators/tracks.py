"""Regions of neighbouring slices: overlaps, events, tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cathodyne.operators.regions import STRIP
from cathodyne.plans.components import connected_components
from cathodyne.sources.shared import keep


def slice_overlaps(labelled: DataFrame) -> DataFrame:
    """Rows (image_id, z, region, next, overlap): regions of slice z and of the next one that share cells, and how many.

    ``labelled`` has runs whose regions lie in one slice each. Runs meet by image, slice, row and strip of columns.
    """
    strips = F.explode(F.sequence(F.floor(F.col("x0") / STRIP), F.floor(F.col("x1") / STRIP)))
    here = labelled.select("image_id", "z", "y", strips.alias("strip"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), "region")
    there = labelled.select("image_id", (F.col("z") - 1).alias("z"), "y", strips.alias("strip"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("region").alias("next"))
    # Each strip counts the cells that are its own.
    shared = F.least("a1", "b1", F.col("strip") * STRIP + STRIP - 1) - F.greatest("a0", "b0", F.col("strip") * STRIP) + 1
    met = here.join(there, ["image_id", "z", "y", "strip"]).select("image_id", "z", "region", "next", shared.alias("cells")).where("cells > 0")
    return met.groupBy("image_id", "z", "region", "next").agg(F.sum("cells").alias("overlap"))


def region_tracks(labelled: DataFrame) -> DataFrame:
    """One row per region of a slice: its size, how many regions before and behind it overlaps, its event and its track.

    The event is ``birth`` without a region before, ``merge`` of several, ``split`` where the one before goes on in several, and
    ``move`` where one region goes on as one; ``ends`` tells that none follows. A track is what moves connect, named by its first
    region by slice, row and column. Regions are known by 64-bit hashes of their first run: of a billion of them, about one
    pair in 37 such sets shares one.
    """
    name = lambda region: F.xxhash64("image_id", F.col(region))
    areas = labelled.groupBy("image_id", "z", "region").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    areas = keep(areas.withColumn("id", name("region")), "areas")
    pairs = keep(slice_overlaps(labelled).select(name("region").alias("a"), name("next").alias("b")), "overlaps")
    behind, before = pairs.groupBy("a").agg(F.count("*").alias("n_behind")), pairs.groupBy("b").agg(F.count("*").alias("n_before"))
    counted = keep(pairs.join(behind, "a").join(before, "b"), "counted")
    tracks = connected_components(counted.where("n_behind = 1 and n_before = 1")).withColumnRenamed("component", "track")
    of_next = counted.groupBy(F.col("b").alias("id")).agg(F.first("n_before").alias("n_before"), F.max("n_behind").alias("siblings"))
    out = areas.join(behind.withColumnRenamed("a", "id"), "id", "left").join(of_next, "id", "left").join(tracks, "id", "left")
    out = keep(out.withColumn("track", F.coalesce("track", "id")), "tracks")
    first = out.groupBy("image_id", "track").agg(F.min("region").alias("first"))
    event = F.when(F.col("n_before").isNull(), "birth").when(F.col("n_before") > 1, "merge").when(F.col("siblings") > 1, "split").otherwise("move")
    return out.join(first, ["image_id", "track"]).select(
        "image_id", "z", F.col("region.y").alias("seed_y"), F.col("region.x0").alias("seed_x"), "area",
        F.coalesce("n_before", F.lit(0)).cast("long").alias("n_before"), F.coalesce("n_behind", F.lit(0)).cast("long").alias("n_behind"), event.alias("event"), F.col("n_behind").isNull().alias("ends"),
        F.col("first.z").alias("track_z"), F.col("first.y").alias("track_y"), F.col("first.x0").alias("track_x"),
    )
