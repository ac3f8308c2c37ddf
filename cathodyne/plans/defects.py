"""The whole way from frames to defects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cathodyne.operators.regions import classify, frame_runs, label_runs, region_properties


def default_classes() -> list[tuple[str, Column]]:
    height, width = F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1
    longest, shortest = F.greatest(height, width), F.least(height, width)
    return [("crack", (longest >= 4 * shortest) | ((F.col("fill") < 0.25) & (longest >= 8))), ("pore", F.col("fill") >= 0.5)]


def defects_of(runs: DataFrame, min_area: int = 4, diagonal: bool = False, volume: bool = False, classes: list[tuple[str, Column]] | None = None) -> DataFrame:
    """Regions of at least ``min_area`` pixels that runs make up, measured and classified."""
    labelled = label_runs(runs, diagonal, volume)
    return classify(region_properties(labelled).where(F.col("area") >= min_area), default_classes() if classes is None else classes)


def find_defects(frames: DataFrame, level: float | None = None, dark: bool = True, min_area: int = 4, volume: bool = False, classes: list[tuple[str, Column]] | None = None) -> DataFrame:
    """Regions of at least ``min_area`` pixels in decoded frames, measured and classified."""
    return defects_of(frame_runs(frames, level, dark), min_area, volume=volume, classes=classes)
