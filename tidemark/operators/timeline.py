"""Frames to intervals, and intervals to a timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import segments as S


def top_by_count(activations: DataFrame, counts: DataFrame, keys: list[str], frame: str = "frame", value: str = "value", most: int | None = None) -> DataFrame:
    """Adds ``active``: 1 for the ``n`` highest of a frame's clusters, ties to the lower cluster."""
    joined = activations.join(counts, [*keys, frame])
    rank = F.row_number().over(Window.partitionBy(*keys, frame).orderBy(F.col(value).desc(), F.col("cluster")))
    n = F.col("n") if most is None else F.least(F.col("n"), F.lit(most))
    return joined.withColumn("active", (rank <= n).cast("int"))


def runs(frames: DataFrame, keys: list[str], index: str, on: str, time: Column | str) -> DataFrame:
    """``keys, start, end`` of the runs of active frames.

    A run starts at its first frame's time and ends at that of the first frame after
    it; one that is open at the end closes at the last frame's time.
    """
    t = F.col(time) if isinstance(time, str) else time
    order = Window.partitionBy(*keys).orderBy(index)
    rows = frames.select(*keys, index, F.col(on).cast("int").alias("__on"), t.cast("double").alias("__t"))
    changed = F.col("__on") != F.coalesce(F.lag("__on").over(order), F.lit(0))
    marked = rows.withColumn("__new", changed).withColumn("__last", F.max("__t").over(Window.partitionBy(*keys)))
    edges = marked.where("__new")
    closed = edges.withColumn("__end", F.lead("__t").over(order))
    return closed.where("__on = 1").select(*keys, F.col("__t").alias("start"), F.coalesce("__end", "__last").alias("end"))


def close_gaps(intervals: DataFrame, keys: list[str], collar: float) -> DataFrame:
    """Merges intervals of one key whose gap is under the collar; intervals that
    overlap have no gap, so a collar of 0 merges nothing.

    One sort by key: the running maximum of the ends before marks where an island
    begins, their running sum names it.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.greatest(F.col("start") - F.col("__reach"), F.lit(0.0)) < collar, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    named = intervals.withColumn("__reach", reach).withColumn("__island", island)
    return named.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def drop_short(intervals: DataFrame, least: float) -> DataFrame:
    """Intervals of a duration of ``least`` or more."""
    return intervals.where(F.col("end") - F.col("start") >= least)


def timeline(intervals: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Intervals with their text, in the order of start, end and label within the keys."""
    s = S.segment("start", "end")
    return intervals.select(*keys, "start", "end", label, S.text(s).alias("text")).orderBy(*keys, "start", "end", label)


def tracks(intervals: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``keys, label, segments``: each label's intervals in order."""
    return intervals.groupBy(*keys, label).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("segments"))


def label_runs(rows: DataFrame, keys: list[str], index: str, label: str) -> DataFrame:
    """``keys, label, first, last, n`` of the runs of one label in order of the index."""
    order = Window.partitionBy(*keys).orderBy(index)
    changed = (~F.col(label).eqNullSafe(F.lag(label).over(order)) | F.lag(F.lit(1)).over(order).isNull()).cast("int")
    named = rows.select(*keys, index, label).withColumn("__new", changed)
    island = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return named.withColumn("__run", island).groupBy(*keys, label, "__run").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("n")).drop("__run")
