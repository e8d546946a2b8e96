"""Joins of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: float, names: tuple[str, str, str, str]) -> DataFrame:
    """Pairs of rows of equal keys whose half-open intervals overlap.

    names: start and end columns of left and right, numbers.  Both sides are cut into
    buckets of ``width`` and joined by key and bucket, an equi-join; a pair is kept in
    the bucket where its overlap begins alone, so no pair comes twice.
    """
    a, b, c, d = names

    def bucketed(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
        return df.where(F.col(start) < F.col(end)).withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))

    joined = bucketed(left, a, b, "__bucket").join(bucketed(right, c, d, "__bucket"), [*keys, "__bucket"])
    met = joined.where((F.col(a) < F.col(d)) & (F.col(c) < F.col(b)))
    return met.where(F.floor(F.greatest(a, c) / width) == F.col("__bucket")).drop("__bucket")
