"""Tables as text, one row a line with a comma after each value, and comparing two such dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import arrays as A


def write_dump(df: DataFrame, order: list[str], vector: str, path: str) -> None:
    """Array rows in order, as text."""
    line = F.concat(F.array_join(F.transform(vector, lambda x: A.number_text(x.cast("double"))), ","), F.lit(","))
    df.orderBy(*order).select(line.alias("value")).write.mode("overwrite").text(path)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """``row, values``; rows keep the order of their lines within a file."""
    lines = spark.read.text(path).withColumn("row", F.monotonically_increasing_id())
    return lines.select("row", A.parse_row("value").alias("values"))


def compare(left: DataFrame, right: DataFrame, keys: list[str], value: str, rtol: float = 1e-3, atol: float = 1e-4) -> DataFrame:
    """``keys, a, b`` of the rows that differ; a row that one side lacks differs."""
    a = left.select(*keys, F.col(value).cast("double").alias("a"), F.lit(True).alias("__a"))
    b = right.select(*keys, F.col(value).cast("double").alias("b"), F.lit(True).alias("__b"))
    joined = a.join(b, keys, "full")
    both_missing = (F.col("a").isNull() | F.isnan("a")) & (F.col("b").isNull() | F.isnan("b"))
    close = both_missing | F.coalesce(F.abs(F.col("a") - F.col("b")) <= atol + rtol * F.abs("b"), F.lit(False))
    return joined.where(F.col("__a").isNull() | F.col("__b").isNull() | ~close).select(*keys, "a", "b")
