"""Rules that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cathodyne.plans.components import connected_components
from cathodyne.sources.shared import discard, keep, new_path, shared_dir

__all__ = ["WORD", "bucketed", "column_free_of", "connected_components", "discard", "keep", "let", "new_path", "shared_dir", "word_count"]

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def column_free_of(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever the case rules of the session."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bucketed(df: DataFrame, key: str, rows_together: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder that is dealt out by ``key``: joins on it shuffle the other side only.

    With ``rows_together`` a file has the rows of a key next to one another.
    """
    spark = df.sparkSession
    path = new_path(spark, "bucketed")
    name = path.rpartition("/")[2].replace("-", "_")
    writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    writer = writer.sortBy(key) if rows_together else writer
    writer.option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out.kept_path = path
    spark.sql(f"drop table {name}")  # the entry, not the files
    return out
