"""Scores to activity: hysteresis, masks and rules on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arrays import nan_to


def hysteresis(frames: DataFrame, keys: list[str], index: str, score: str, onset: float, offset: float | None = None, initial: bool | None = None) -> DataFrame:
    """Adds ``on``: 1 above onset, 0 below offset, between them as before.

    Before the first clear frame it is ``initial``; by default whether the first
    score reaches the middle of the two thresholds.  NULL and NaN scores count as 0.
    """
    offset = onset if offset is None else offset
    s = nan_to(score)
    order = Window.partitionBy(*keys).orderBy(index)
    past = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    clear = F.when(s > onset, 1).when(s < offset, 0)
    start = F.first((s >= (onset + offset) / 2).cast("int")).over(past) if initial is None else F.lit(int(initial))
    return frames.withColumn("on", F.coalesce(F.last(clear, ignorenulls=True).over(past), start))


def clean_masks(active: DataFrame, frame_keys: list[str]) -> DataFrame:
    """Adds ``clean``: on, where no other class of the frame is on."""
    together = F.sum("on").over(Window.partitionBy(*frame_keys))
    return active.withColumn("clean", F.when(together < 2, F.col("on")).otherwise(0))


def used_masks(active: DataFrame, keys: list[str], min_frames: int) -> DataFrame:
    """Adds ``used``: the clean mask of a class that has over ``min_frames`` clean frames, else its whole mask."""
    enough = F.sum("clean").over(Window.partitionBy(*keys)) > min_frames
    return active.withColumn("used", F.when(enough, F.col("clean")).otherwise(F.col("on")))


def activity_totals(active: DataFrame, keys: list[str], mask: str = "on") -> DataFrame:
    """``keys, n_active``"""
    return active.groupBy(*keys).agg(F.sum(mask).alias("n_active"))


def drop_short_rows(totals: DataFrame, value: str, least: int) -> DataFrame:
    """The value is NULL where fewer than ``least`` elements are active."""
    return totals.withColumn(value, F.when(F.col("n_active") >= least, F.col(value)))


def mark_inactive(assigned: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Cluster -2 for classes without an active frame."""
    quiet = totals.where("n_active = 0").select(*keys, F.lit(True).alias("__quiet"))
    return assigned.join(quiet, keys, "left").withColumn("cluster", F.when(F.col("__quiet"), -2).otherwise(F.col("cluster"))).drop("__quiet")
