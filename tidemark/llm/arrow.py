"""Arrow kernels that add columns to documents, and kernels that give their memory back."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tidemark.llm import textops as T

HIDDEN = "__text"
BATCH_SETTING, BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20, 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches of 8 MB between the executor and Python where the session has Spark's
    default of 64 MB: both sides hold a batch of each task outside the heap."""
    if int(str(spark.conf.get(BATCH_SETTING)).rstrip("b") or 0) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def release() -> None:
    """Returns what the allocators keep of freed memory: a Python worker lives on for
    the tasks of later stages, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    # only glibc has it
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(kernel: Callable) -> Callable:
    """An Arrow kernel of a map that releases its memory at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            release()

    return run


def lean_group(kernel: Callable) -> Callable:
    """An Arrow kernel of a group that releases what it doesn't return."""

    def run(table: pa.Table) -> pa.Table:
        out = kernel(table)
        del table
        release()
        return out

    return run


def lean_batches(kernel: Callable) -> Callable:
    """The same for the kernel of a group that takes and returns batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        release()

    return run


def lean_pair(kernel: Callable) -> Callable:
    """The same for the kernel of two groups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = kernel(left, right)
        del left, right
        release()
        return out

    return run


def fresh(name: str) -> str:
    """A column name that no table has yet."""
    return f"__{name}_{uuid.uuid4().hex[:12]}"


def with_columns(docs: DataFrame, added: str, kernel: Callable[[pa.RecordBatch], list[pa.Array]], keep: list[str] | None = None, also: dict | None = None, rows: int = 1 << 30) -> DataFrame:
    """``docs`` with the columns of the DDL string ``added``, which ``kernel``
    makes from pieces of at most about 1 MB of text and ``rows`` rows.

    ``keep`` names the columns of docs that are returned (all by default; a
    column of a name in ``added`` is replaced).  The kernel sees the text as
    ``__text`` and the expressions of ``also`` under their names.
    """
    small_batches(docs.sparkSession)
    new = S.StructType.fromDDL(added)
    names = [c for c in dict.fromkeys(docs.columns if keep is None else keep) if c.lower() not in {f.name.lower() for f in new}]
    also = {HIDDEN: F.col("text").cast("string"), **(also or {})}
    kept = [docs.schema[c] for c in names]
    out = S.StructType(kept + list(new))
    slots = [f"__{k}" for k in range(len(names))]
    source = docs.select(*[F.col(f"`{c}`").alias(s) for c, s in zip(names, slots)], *[e.alias(c) for c, e in also.items()])
    types = S.StructType([S.StructField(s, f.dataType) for s, f in zip(slots, kept)] + list(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.chunks(batch, HIDDEN):
                for at in range(0, piece.num_rows, rows):
                    part = piece.slice(at, rows)
                    yield pa.RecordBatch.from_arrays([part.column(s) for s in slots] + kernel(part), names=slots + [f.name for f in new])

    made = source.mapInArrow(lean(run), types)
    return made.select(*[F.col(s).alias(f.name) for s, f in zip(slots, kept)], *[F.col(f.name) for f in out.fields[len(kept) :]])
