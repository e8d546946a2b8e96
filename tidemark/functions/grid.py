"""Sliding-window arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import Grid


def _col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def window_at(i: Column | str, grid: Grid) -> Column:
    """struct(start, end) of position i."""
    start = F.lit(grid.start) + _col(i) * F.lit(grid.step)
    return F.struct(start.alias("start"), (start + F.lit(grid.duration)).alias("end"))


def window_or_null(i: Column | str, grid: Grid) -> Column:
    """``window_at``, NULL once the window starts at or after the grid's end."""
    if grid.end is None:
        return window_at(i, grid)
    return F.when(F.lit(grid.start) + _col(i) * F.lit(grid.step) < F.lit(grid.end), window_at(i, grid))


def frame_middle(i: Column | str, grid: Grid) -> Column:
    start = F.lit(grid.start) + _col(i) * F.lit(grid.step)
    return (start + (start + F.lit(grid.duration))) / 2


def closest_frame(t: Column | str, grid: Grid) -> Column:
    """Position whose middle is closest to t, halves to even, 0 at least."""
    return F.greatest(F.lit(0.0), F.rint((_col(t) - F.lit(grid.start) - F.lit(0.5 * grid.duration)) / F.lit(grid.step))).cast("bigint")


def segment_to_range(start: Column | str, end: Column | str, grid: Grid) -> Column:
    """struct(first, n): the closest frame to start, and steps to cover the segment."""
    length = F.greatest(_col(end) - _col(start), F.lit(0.0))
    return F.struct(closest_frame(start, grid).alias("first"), (F.floor(length / F.lit(grid.step)) + 1).alias("n"))


def range_to_segment(first: Column | str, n: Column | str, grid: Grid) -> Column:
    """struct(start, end) of n frames from first, each of a step around its middle;
    frame 0 reaches back to the grid's start."""
    start = F.lit(grid.start) + (_col(first) - 0.5) * F.lit(grid.step) + F.lit(0.5 * grid.duration)
    end = start + _col(n) * F.lit(grid.step)
    return F.struct(F.when(_col(first) == 0, F.lit(grid.start)).otherwise(start).alias("start"), end.alias("end"))


def samples_to_duration(n: Column | str, grid: Grid) -> Column:
    extent = range_to_segment(F.lit(0), n, grid)
    return extent["end"] - extent["start"]


def duration_to_samples(duration: Column | str, grid: Grid) -> Column:
    return segment_to_range(F.lit(0.0), duration, grid)["n"]


def samples(duration: Column | str, grid: Grid, mode: str = "strict") -> Column:
    """Frames that fit into a duration (strict), meet it (loose), or on average (center)."""
    d = _col(duration)
    if mode == "strict":
        return F.floor((d - F.lit(grid.duration)) / F.lit(grid.step)) + 1
    if mode == "loose":
        return F.floor((d + F.lit(grid.duration)) / F.lit(grid.step))
    if mode == "center":
        return F.rint(d / F.lit(grid.step)).cast("bigint")
    raise ValueError(f"unknown mode {mode}")


def grid_length(grid: Grid) -> Column:
    """Positions of a finite grid; an infinite one raises."""
    if grid.end is None:
        return F.raise_error(F.lit("infinite sliding window"))
    return F.ceil((F.lit(grid.end) - F.lit(grid.start)) / F.lit(grid.step)).cast("bigint")


def chunk_count(n: Column | str, window: int, step: int) -> Column:
    """Chunks of a sequence of n: one at least, the last may overhang."""
    return (F.ceil(F.greatest(_col(n) - window, F.lit(0)) / step) + 1).cast("int")


def crop_range(start: Column | str, end: Column | str, grid: Grid) -> Column:
    """struct(first, last): frames that a segment meets, loosely; last is included."""
    first = F.greatest(F.ceil((_col(start) - F.lit(grid.duration) - F.lit(grid.start)) / F.lit(grid.step)), F.lit(0))
    return F.struct(first.alias("first"), F.floor((_col(end) - F.lit(grid.start)) / F.lit(grid.step)).alias("last"))
