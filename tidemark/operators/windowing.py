"""Chunks of sequences: grids, slides, crops and trims."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Grid
from tidemark.functions import grid as G


def chunk_grid(lengths: DataFrame, keys: list[str], n: str, window: int, step: int, rate: float = 1.0) -> DataFrame:
    """``keys, chunk_idx, start, end`` of the chunks of sequences of n elements."""
    many = G.chunk_count(n, window, step)
    rows = lengths.select(*keys, F.explode(F.sequence(F.lit(0), many - 1)).alias("chunk_idx"))
    start = F.col("chunk_idx") * F.lit(step / rate)
    return rows.select(*keys, "chunk_idx", start.alias("start"), (start + F.lit(window / rate)).alias("end"))


def slide(frames: DataFrame, keys: list[str], index: str, values: list[str], window: int, step: int) -> DataFrame:
    """Long rows ``keys, chunk_idx, frame_idx, values`` of overlapping chunks.

    An element is copied to each of its window / step chunks, so no range join is
    needed.  A chunk exists while the one before doesn't reach the sequence's end.
    """
    # the length comes from one small aggregate, joined on the keys
    lengths = frames.groupBy(*keys).agg((F.max(index) + 1).alias("__n"))
    last = F.floor(F.col(index) / step)
    first = F.greatest(F.lit(0), F.ceil((F.col(index) - (window - 1)) / step))
    joined = frames.join(lengths, keys)
    capped = F.least(last, G.chunk_count("__n", window, step).cast("bigint") - 1)
    rows = joined.where(first <= capped).select(*keys, F.col(index).alias("__i"), *values, F.explode(F.sequence(first, capped)).alias("chunk_idx"))
    return rows.select(*keys, F.col("chunk_idx").cast("int").alias("chunk_idx"), (F.col("__i") - F.col("chunk_idx") * step).cast("int").alias("frame_idx"), *values)


def chunk_arrays(long: DataFrame, keys: list[str], value: str, window: int) -> DataFrame:
    """``keys, chunk_idx, frames``: the chunk's values in order, zeros to the window's length."""
    got = F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", F.col(value).cast("double").alias("v")))), lambda x: x["v"])
    return long.groupBy(*keys, "chunk_idx").agg(got.alias("v")).select(*keys, "chunk_idx", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(window) - F.size("v"))).alias("frames"))


def block_chunks(blocks: DataFrame, key: str, block: str, samples: str, per_chunk: int, block_size: int) -> DataFrame:
    """Chunks of ``per_chunk`` blocks from rows of one block of samples each.

    A block is sent to the chunks that hold it by an equi-key; samples stay arrays.
    The chunk at the end may have fewer samples.
    """
    n = blocks.groupBy(key).agg(F.max(F.struct(block, F.size(samples).alias("size"))).alias("m")).select(key, (F.col("m")[block] * block_size + F.col("m")["size"]).alias("__n"))
    many = G.chunk_count("__n", per_chunk * block_size, block_size)
    sent = blocks.join(n, key).select(key, block, samples, F.explode(F.sequence(F.greatest(F.lit(0), F.col(block) - per_chunk + 1), F.least(F.col(block), many - 1))).alias("chunk_idx"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(block, samples))), lambda x: x[samples]))
    return sent.groupBy(key, "chunk_idx").agg(whole.alias("samples"))


def trim(long: DataFrame, frames: int, left: float, right: float) -> DataFrame:
    """Frames from floor(frames * left) to frames - floor(frames * right), renumbered."""
    first, end = math.floor(frames * left), frames - math.floor(frames * right)
    return long.where((F.col("frame_idx") >= first) & (F.col("frame_idx") < end)).withColumn("frame_idx", F.col("frame_idx") - first)


def crop(frames: DataFrame, index: str, start: str, end: str, grid: Grid) -> DataFrame:
    """Frames of a grid that the row's segment meets, loosely, renumbered from the first."""
    r = G.crop_range(start, end, grid)
    return frames.where(F.col(index).between(r["first"], r["last"])).withColumn(index, F.col(index) - r["first"])


def slide_support(support: DataFrame, keys: list[str], grid: Grid, align_last: bool = False) -> DataFrame:
    """Windows inside each support interval (``start, end``); with ``align_last`` one
    more that ends with it, where the others fall short.  Intervals shorter than the
    window give none."""
    d, s = F.lit(grid.duration), F.lit(grid.step)
    held = support.where(F.col("end") - F.col("start") >= d)
    most = F.floor((F.col("end") - F.col("start") - d) / s + F.lit(1e-9)).cast("int")
    last = F.col("start") + most * s
    regular = F.transform(F.sequence(F.lit(0), most), lambda i: F.col("start") + i * s)
    starts = F.when(last + d < F.col("end"), F.concat(regular, F.array(F.col("end") - d))).otherwise(regular) if align_last else regular
    return held.select(*keys, F.explode(starts).alias("__s")).select(*keys, F.col("__s").alias("start"), (F.col("__s") + d).alias("end"))


def fold(long: DataFrame, index: str, per: int, outer: str, inner: str) -> DataFrame:
    """A flat index to (outer, inner) with ``per`` inner positions."""
    return long.withColumn(outer, F.floor(F.col(index) / per)).withColumn(inner, F.col(index) % per).drop(index)


def unfold(long: DataFrame, outer: str, inner: str, per: int, index: str) -> DataFrame:
    """The inverse of ``fold``."""
    return long.withColumn(index, F.col(outer) * per + F.col(inner)).drop(outer, inner)


def batches(long: DataFrame, index: str, size: int = 32) -> DataFrame:
    """Adds ``batch_id``; the last batch may be short."""
    return long.withColumn("batch_id", F.floor(F.col(index) / size))
