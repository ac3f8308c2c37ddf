"""Regions of volumes whose slices arrive one by one, in any order and in any batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cathodyne.functions.pixels import otsu, runs_of
from cathodyne.functions.touch import smallest_linked, touching
from cathodyne.operators.regions import region_shape
from cathodyne.plans.components import connected_components
from cathodyne.sources.frames import decode, with_slice
from cathodyne.streaming.ingest import FILE_SCHEMA

#: Rows of a slice that one key takes, and the folders by volume of the store.
ROWS, BUCKETS = 64, 64
STRIP_SCHEMA = "image_id string, z int, strip int, y array<int>, x0 array<int>, x1 array<int>, value array<double>"
PIECE_SCHEMA = "image_id string, z int, a_y int, a_x int, b_z int, b_y int, b_x int, area long, y0 int, y1 int, x0 int, x1 int, sum_y long, twice_x long, total double"
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def frame_strips(frames: DataFrame, level: float | None = None, dark: bool = True, rows: int = ROWS) -> DataFrame:
    """One row per strip of ``rows`` rows of each decoded frame, with its runs and those of the next strip's first row.

    Strips without runs have a row too: it tells that the slice has come.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.itertuples():
                pixels = np.frombuffer(f.pixels, f"<u{int(f.bit_depth) // 8}").reshape(int(f.height), int(f.width))
                at = otsu(pixels) if level is None else level
                y, x0, x1 = runs_of(pixels <= at if dark else pixels > at)
                sums = np.pad(pixels.astype(float).cumsum(1), ((0, 0), (1, 0)))
                value = sums[y, x1 + 1] - sums[y, x0]
                for strip in range(-(-int(f.height) // rows)):
                    own = slice(*np.searchsorted(y, [strip * rows, (strip + 1) * rows + 1]))
                    yield pd.DataFrame({"image_id": [f.image_id], "z": [f.z], "strip": [strip], "y": [y[own]], "x0": [x0[own]], "x1": [x1[own]], "value": [value[own]]})

    return frames.where("pixels is not null and z is not null").select("image_id", "z", "bit_depth", "height", "width", "pixels").mapInPandas(cut, STRIP_SCHEMA)


def run_strips(runs: DataFrame, height: int, rows: int = ROWS) -> DataFrame:
    """The same strips from runs in a table, all of whose frames have ``height`` rows; a frame without runs does not come."""
    strip = F.floor(F.col("y") / rows).cast("int")
    places = F.when((F.col("y") % rows == 0) & (F.col("y") > 0), F.array(strip - 1, strip)).otherwise(F.array(strip))
    own = runs.withColumn("strip", F.explode(places)).select("image_id", "z", "strip", F.struct("y", "x0", "x1", "value").alias("run"))
    markers = runs.select("image_id", "z").distinct().withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit((height - 1) // rows)))).withColumn("run", F.lit(None).cast(own.schema["run"].dataType))
    strips = own.unionByName(markers).groupBy("image_id", "z", "strip").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    return strips.select("image_id", F.col("z").cast("int").alias("z"), "strip", *[F.col(f"runs.{c}").cast(f"array<{t}>").alias(c) for c, t in (("y", "int"), ("x0", "int"), ("x1", "int"), ("value", "double"))])


class SliceLinker(StatefulProcessor):
    """Parts each strip of a slice into pieces, and links them to those of the slices before and behind.

    The state of a strip holds the runs of the slices that still wait for a neighbour, with their pieces. Once both
    have come, a slice leaves nothing but its number, so that it is not taken again. What is in memory is one strip of three slices.
    """

    def __init__(self, reach: int, rows: int = ROWS):
        self.reach, self.rows = reach, rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slices = handle.getMapState("slices", "z int", "runs binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        image, strip = key
        for batch in rows:
            for r in batch.itertuples():
                if not self.slices.containsKey((int(r.z),)):
                    yield self._take(image, int(strip), int(r.z), *(np.asarray(c) for c in (r.y, r.x0, r.x1, r.value)))

    def _take(self, image: str, strip: int, z: int, y, x0, x1, value) -> pd.DataFrame:
        runs = tuple(c.astype(np.int64) for c in (y, x0, x1))
        n = int(np.searchsorted(runs[0], (strip + 1) * self.rows))  # the rest is the next strip's first row
        a, b = touching(runs, runs, 1, self.reach)
        piece = smallest_linked(n, a[b < n], b[b < n])
        own = tuple(c[:n] for c in runs)
        py, px = own[0][piece], own[1][piece]
        # The first row of a strip is known to the strip above by its runs.
        border = np.flatnonzero((own[0] == strip * self.rows) & (piece != np.arange(n)) & (strip > 0))
        below = b >= n
        links = [(piece[border], np.full(len(border), z), own[0][border], own[1][border]), (piece[a[below]], np.full(below.sum(), z), runs[0][b[below]], runs[1][b[below]])]
        for other in (z - 1, z + 1):
            if self.slices.containsKey((other,)):
                theirs = np.frombuffer(self.slices.getValue((other,))[0], np.int64).reshape(5, -1)
                a, b = touching(own, tuple(theirs[:3]), 0, self.reach)
                links.append((piece[a], np.full(len(a), other), theirs[3][b], theirs[4][b]))
        self.slices.updateValue((z,), (np.stack([*own, py, px]).tobytes(),))
        for s in (z - 1, z, z + 1):
            if all(self.slices.containsKey((s + d,)) for d in (-1, 0, 1)):
                self.slices.updateValue((s,), (b"",))
        return pd.concat([self._pieces(image, z, own, piece, value[:n]), self._links(image, z, own, links)], ignore_index=True)

    @staticmethod
    def _pieces(image, z, own, piece, value) -> pd.DataFrame:
        width = own[2] - own[1] + 1
        each = pd.DataFrame({"piece": piece, "area": width, "y0": own[0], "y1": own[0], "x0": own[1], "x1": own[2], "sum_y": width * own[0], "twice_x": width * (own[1] + own[2]), "total": value})
        sums = each.groupby("piece", as_index=False).agg({"area": "sum", "y0": "min", "y1": "max", "x0": "min", "x1": "max", "sum_y": "sum", "twice_x": "sum", "total": "sum"})
        at = sums.pop("piece").to_numpy(np.int64)
        whole = {c: sums[c].astype("Int64") for c in sums.columns if c != "total"}
        none = pd.array([None] * len(at), "Int64")
        return pd.DataFrame({"image_id": image, "z": z, "a_y": own[0][at], "a_x": own[1][at], "b_z": none, "b_y": none, "b_x": none, **whole, "total": sums["total"].astype("Float64")}).reset_index(drop=True)

    @staticmethod
    def _links(image, z, own, links) -> pd.DataFrame:
        a, b_z, b_y, b_x = (np.concatenate(c).astype(np.int64) for c in zip(*links))
        ends = pd.DataFrame({"a": a, "b_z": b_z, "b_y": b_y, "b_x": b_x}).drop_duplicates()
        at = ends.pop("a").to_numpy()
        none = pd.array([None] * len(at), "Int64")
        rest = {c: none for c in ("area", "y0", "y1", "x0", "x1", "sum_y", "twice_x")}
        out = {c: ends[c].astype("Int64").array for c in ("b_z", "b_y", "b_x")}
        return pd.DataFrame({"image_id": image, "z": z, "a_y": own[0][at], "a_x": own[1][at], **out, **rest, "total": pd.array([None] * len(at), "Float64")})

    def close(self) -> None:
        pass


def _bucket(image: Column) -> Column:
    return F.pmod(F.xxhash64(image), F.lit(BUCKETS)).cast("int")


def _stored(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{PIECE_SCHEMA}, batch int, bucket int").parquet(f"{out}/pieces")


def _joined(rows: DataFrame) -> DataFrame:
    """Regions that pieces and links make up: image_id, region (first run), and sums."""
    a = F.xxhash64("image_id", "z", "a_y", "a_x")
    links = rows.where("b_z is not null").select(a.alias("a"), F.xxhash64("image_id", "b_z", "b_y", "b_x").alias("b"))
    labels = connected_components(links).withColumnRenamed("id", "piece")
    pieces = rows.where("b_z is null").withColumn("piece", a).join(labels, "piece", "left")
    return region_shape(
        pieces.groupBy("image_id", F.coalesce("component", "piece").alias("component")).agg(
            F.min(F.struct("z", F.col("a_y").alias("y"), F.col("a_x").alias("x0"))).alias("region"),
            F.sum("area").alias("area"), F.min("z").alias("z0"), F.max("z").alias("z1"),
            *[f(c).alias(c) for c, f in (("y0", F.min), ("y1", F.max), ("x0", F.min), ("x1", F.max), ("sum_y", F.sum), ("total", F.sum))],
            (F.sum("twice_x") / 2).alias("sum_x"),
        )
    )


def link_slices(strips: DataFrame, out: str, checkpoint: str, diagonal: bool = False, rows: int = ROWS, trigger: dict | None = None) -> StreamingQuery:
    """Follows a stream of strips (``STRIP_SCHEMA``) and keeps the regions of its volumes in folders below ``out``.

    Slices of a volume may come in any order, in one batch or in many; the regions are those of the whole volume as far as it
    has come, and a batch that joins two regions of earlier ones corrects them. A slice that comes again is not taken twice. Keys are
    strips of a volume, so a volume is dealt out over tasks. ``pieces`` gets what each batch found: parts of regions within a strip, with
    sums, and links between them. From these the regions of the volumes that the batch touched are joined anew and
    written to ``regions``, under the batch's number; ``volume_regions`` reads the last ones of each volume. A batch that is run again
    overwrites its own folders. Without a ``trigger`` the stream ends when it has taken all there is; ``{"processingTime": "1 minute"}`` goes on.
    The same ``rows`` and ``diagonal`` must be given whenever a checkpoint is taken up again.
    """
    spark = strips.sparkSession
    found = strips.groupBy("image_id", "strip").transformWithStateInPandas(SliceLinker(int(diagonal), rows), PIECE_SCHEMA, "append", "none")

    def batch(part: DataFrame, number: int) -> None:
        part.withColumn("bucket", _bucket(F.col("image_id"))).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/pieces/batch={number}")
        known = _stored(part.sparkSession, out).where(F.col("batch") <= number)
        new = known.where(F.col("batch") == number)
        buckets = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        touched = known.where(F.col("bucket").isin(buckets)).join(new.select("image_id").distinct(), "image_id", "left_semi")
        _joined(touched).write.mode("overwrite").parquet(f"{out}/regions/batch={number}")

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # map state needs it; the query takes the session's settings when it starts
    try:
        return found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def watch_volumes(spark: SparkSession, path: str, out: str, checkpoint: str, glob: str = "*", level: float | None = None, dark: bool = True, diagonal: bool = False, files_per_batch: int = 1000, rows: int = ROWS, trigger: dict | None = None) -> StreamingQuery:
    """``link_slices`` on the image files below ``path``, ``<volume>_<z>.<type>``. Files that cannot be decoded are left out."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(path)
    return link_slices(frame_strips(with_slice(decode(files)), level, dark, rows), out, checkpoint, diagonal, rows, trigger)


def volume_regions(spark: SparkSession, out: str) -> DataFrame:
    """The regions of all volumes as the last batch that touched each left them; columns as ``region_properties``."""
    all_batches = spark.read.parquet(f"{out}/regions")
    last = all_batches.groupBy("image_id").agg(F.max("batch").alias("batch"))
    return all_batches.join(last, ["image_id", "batch"]).drop("batch")
