"""Interval algebra as Column expressions over pairs of start and end in seconds.

An interval is empty when it is no longer than ``PRECISION``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import PRECISION


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def segment(start: Column | str, end: Column | str) -> Column:
    return F.struct(_col(start).cast("double").alias("start"), _col(end).cast("double").alias("end"))


def is_empty(s: Column) -> Column:
    return s["end"] - s["start"] <= PRECISION


def duration(s: Column) -> Column:
    """0 for an empty interval."""
    return F.when(is_empty(s), F.lit(0.0)).otherwise(s["end"] - s["start"])


def middle(s: Column) -> Column:
    return (s["start"] + s["end"]) / 2


def contains(a: Column, b: Column) -> Column:
    """Whether b lies in a."""
    return (a["start"] <= b["start"]) & (a["end"] >= b["end"])


def overlaps(s: Column, t: Column | str) -> Column:
    """Whether the instant t lies in s."""
    return (s["start"] <= _col(t)) & (s["end"] >= _col(t))


def intersects(a: Column, b: Column) -> Column:
    """Whether two intervals share more than the precision, or start together."""
    first = (a["start"] < b["start"]) & (b["start"] < a["end"] - PRECISION)
    second = (a["start"] > b["start"]) & (a["start"] < b["end"] - PRECISION)
    return first | second | (a["start"] == b["start"])


def intersection(a: Column, b: Column) -> Column:
    return segment(F.greatest(a["start"], b["start"]), F.least(a["end"], b["end"]))


def union(a: Column, b: Column) -> Column:
    """The smallest interval over both; an empty one counts for nothing."""
    both = segment(F.least(a["start"], b["start"]), F.greatest(a["end"], b["end"]))
    return F.when(is_empty(a), b).when(is_empty(b), a).otherwise(both)


def gap(a: Column, b: Column) -> Column:
    """The interval between; an error where one is empty."""
    made = segment(F.least(a["end"], b["end"]), F.greatest(a["start"], b["start"]))
    return F.when(is_empty(a) | is_empty(b), F.raise_error(F.lit("the gap to an empty interval is not defined"))).otherwise(made)


def gap_length(a: Column, b: Column) -> Column:
    """Seconds between two intervals, 0 where they meet."""
    return F.greatest(F.greatest(a["start"], b["start"]) - F.least(a["end"], b["end"]), F.lit(0.0))


def rounded(s: Column, digits: int) -> Column:
    return segment(F.round(s["start"], digits), F.round(s["end"], digits))


def clock(t: Column | str) -> Column:
    """A sign or blank, then HH:MM:SS.mmm, cut to milliseconds."""
    micro = F.rint(F.abs(_col(t)) * 1_000_000).cast("bigint")
    second = F.expr("0") + F.floor(micro / 1_000_000)
    return F.format_string(
        "%s%02d:%02d:%02d.%03d",
        F.when(_col(t) < 0, "-").otherwise(" "),
        F.floor(second / 3600),
        F.floor(second / 60) % 60,
        second % 60,
        F.floor((micro % 1_000_000) / 1000),
    )


def text(s: Column) -> Column:
    return F.when(is_empty(s), F.lit("[]")).otherwise(F.concat(F.lit("["), clock(s["start"]), F.lit(" --> "), clock(s["end"]), F.lit("]")))


def result_line(start: Column | str, end: Column | str, label: Column | str) -> Column:
    """A line of the console output, two decimals."""
    return F.format_string("[%.2f -- %.2f] --> Speaker_%s", F.round(_col(start), 2), F.round(_col(end), 2), _col(label).cast("string"))


def to_json(s: Column) -> Column:
    return F.to_json(s)


def from_json(text_: Column | str) -> Column:
    return F.from_json(_col(text_), "start double, end double")
