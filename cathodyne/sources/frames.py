"""Image files as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cathodyne.functions.pixels import decode_grey

FRAME_SCHEMA = "path string, height int, width int, bit_depth int, pixels binary"


def decode(files: DataFrame) -> DataFrame:
    """Rows (path, height, width, bit_depth, pixels) of ``binaryFile`` rows; pixels are little-endian, row by row.

    A file that cannot be decoded keeps its row, with nulls. 16-bit values stay whole.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                p = decode_grey(bytes(content)) if content is not None else None
                rows.append((path, *(p.shape if p is not None else (None, None)), p.itemsize * 8 if p is not None else None, p.astype(p.dtype.newbyteorder("<")).tobytes() if p is not None else None))
            yield pd.DataFrame(rows, columns=["path", "height", "width", "bit_depth", "pixels"]).astype({c: "Int32" for c in ("height", "width", "bit_depth")})

    return files.select("path", "content").mapInPandas(read, FRAME_SCHEMA)


def read_frames(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Frames of the image files below ``path``; names say which slice of which volume a file is (``<volume>_<z>.<type>``)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return with_slice(decode(files))


def with_slice(frames: DataFrame) -> DataFrame:
    """Adds ``image_id`` (the volume, or the file's name) and ``z`` (the slice, 0 without one)."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    z = F.regexp_extract(name, r"_(\d{1,9})$", 1)
    return frames.withColumn("image_id", F.regexp_replace(name, r"_\d{1,9}$", "")).withColumn("z", F.when(z == "", 0).otherwise(z.try_cast("int")))
