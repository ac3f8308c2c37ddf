"""Defects of images as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cathodyne.plans.defects import find_defects
from cathodyne.sources.frames import decode, with_slice

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, path: str, out: str, checkpoint: str, glob: str = "*", **options) -> StreamingQuery:
    """Appends the defects of new image files below ``path`` to the Parquet table ``out``.

    Each file is seen once; a micro-batch that is run again overwrites its own folder. Frames are
    taken one by one; ``volumes.watch_volumes`` links the slices of a volume.
    """
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).load(path)

    def batch(part: DataFrame, number: int) -> None:
        find_defects(with_slice(decode(part)), **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
