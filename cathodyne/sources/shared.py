"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a temporary folder; a cluster session is
    refused, as its executors could not read what the driver's machine holds.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='cathodyne-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/cathodyne/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: a cut in the lineage that outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.kept_path = path
    return kept


def discard(kept: DataFrame) -> None:
    """Deletes the files of a table from ``keep`` once what was made of it is kept as well; leaves others alone."""
    if path := getattr(kept, "kept_path", None):
        spark = kept.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
