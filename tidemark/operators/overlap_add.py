"""Aggregation of overlapping chunks onto one frame grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Grid
from tidemark.functions import grid as G


def _weight(frames: int) -> Column:
    """The Hamming window over a chunk's frames."""
    return F.lit(0.54) - F.lit(0.46) * F.cos(F.lit(2 * math.pi) * F.col("frame_idx") / F.lit(frames - 1))


def overlap_add(
    long: DataFrame, keys: list[str], value: str, chunk: Grid, frame: Grid, frames: int, classes: list[str] | None = None, hamming: bool = False, skip_average: bool = False, missing: float | None = None, epsilon: float = 1e-12, out: str = "value"
) -> DataFrame:
    """``keys, frame, classes, value``: scores of all chunks that cover a frame, averaged or summed.

    long: ``keys, chunk_idx, frame_idx, classes..., value``.  Chunk c starts at the
    frame closest to its start.  NULL and NaN scores count for nothing; a frame
    without any other has ``missing``, if that is given, on the whole grid up to the
    frame closest to the end of the last chunk.  With ``hamming`` scores are weighted by their place in the chunk.
    """
    classes = classes or []
    begin = F.lit(chunk.start) + F.col("chunk_idx") * F.lit(chunk.step)
    at = (G.closest_frame(begin, frame) + F.col("frame_idx")).cast("bigint")
    score = F.when(F.isnan(F.col(value).cast("double")), None).otherwise(F.col(value).cast("double"))
    weight = _weight(frames) if hamming else F.lit(1.0)
    placed = long.select(*keys, at.alias("frame"), *classes, G.closest_frame(begin + F.lit(chunk.duration), frame).alias("__end"), (score * weight).alias("__s"), F.when(score.isNotNull(), weight).alias("__w"))
    total = placed.groupBy(*keys, "frame", *classes).agg(F.sum("__s").alias("__s"), F.sum("__w").alias("__w"))
    made = F.col("__s") if skip_average else F.col("__s") / F.greatest(F.col("__w"), F.lit(epsilon))
    result = total.select(*keys, "frame", *classes, made.alias(out))
    if missing is None:
        return result
    extent = placed.groupBy(*keys).agg(F.greatest(F.max("frame"), F.max("__end")).alias("__last"))
    grid = extent.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__last"))).alias("frame"))
    if classes:
        grid = grid.join(long.select(*keys, *classes).distinct(), keys)
    return grid.join(result, [*keys, "frame", *classes], "left").withColumn(out, F.coalesce(F.col(out), F.lit(missing)))


def class_sum(long: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, chunk_idx, frame_idx, n``: the sum over the classes of a frame."""
    return long.groupBy(*keys, "chunk_idx", "frame_idx").agg(F.sum(value).alias("n"))


def active_count(long: DataFrame, keys: list[str], value: str, chunk: Grid, frame: Grid, frames: int, trim: tuple[float, float] = (0.1, 0.1)) -> DataFrame:
    """``keys, frame, n``: how many classes are active in each frame, halves to even.

    Chunks lose their borders first; frame 0 is the first that is left.
    """
    from tidemark.operators.windowing import trim as cut

    left, right = trim
    inner = Grid(step=chunk.step, duration=chunk.duration * (1 - left - right), start=chunk.start + left * chunk.duration)
    kept = frames - math.floor(frames * left) - math.floor(frames * right)
    rows = class_sum(cut(long, frames, left, right), keys, value)
    at = Grid(step=frame.step, duration=frame.duration, start=inner.start)
    mean = overlap_add(rows, keys, "n", inner, at, kept, missing=0.0, out="__m")
    return mean.select(*keys, "frame", F.rint("__m").cast("int").alias("n"))


def max_pool(scores: DataFrame, assigned: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """``keys, chunk_idx, frame_idx, cluster, value``: the highest score of a chunk's
    classes that belong to one cluster; negative clusters are left out."""
    kept = assigned.where(F.col("cluster") >= 0).select(*keys, "chunk_idx", label, "cluster")
    return scores.join(kept, [*keys, "chunk_idx", label]).groupBy(*keys, "chunk_idx", "frame_idx", "cluster").agg(F.max(value).alias(value))
