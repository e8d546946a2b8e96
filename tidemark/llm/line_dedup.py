"""Line dedup: the first occurrence of every line stays, the others go.

Two Bloom filters, of hashes seen once and seen twice, are built by segment of the
hash range.  Every task sends the sparse bits of its own pair of filters; merging
them moves a bit that two tasks have seen into the second filter.  The second
filter then picks the suspects: only they, a superset of the repeated lines, are
shuffled, compared as text and reduced to the first by (doc_id, line number).  The
second filter is broadcast while it is small, else asked where it lies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import cluster
from tidemark.llm import textops as T
from tidemark.llm.arrow import fresh, lean, lean_group, small_batches

U64 = np.uint64
SEGMENT = 20  # log2 of the bits of a segment
HASHES = 3
BITS_PER_LINE, BITS_PER_ID = 8, 16
FLUSH = 1 << 19


def lines(column: pa.Array, min_chars: int) -> tuple[np.ndarray, ...]:
    """Hash, document, number, first and last byte of every line that counts, and the bytes."""
    data, offsets = T.utf8(column)
    feed = data == 10
    starts, ends, at = T.runs(~feed, offsets)
    doc = T.owners(at)
    before = np.concatenate([[0], np.cumsum(feed)])
    number = before[starts] - before[offsets[:-1]][doc]
    solid = np.flatnonzero(~feed & (data != 32))
    i, j = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    some = np.flatnonzero(i <= j)
    starts, ends, doc, number = solid[i[some]], solid[j[some]] + 1, doc[some], number[some]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long_ = chars[ends] - chars[starts] >= min_chars
    starts, ends, doc, number = starts[long_], ends[long_], doc[long_], number[long_]
    return T.span_hash(data, starts, ends), doc, number, starts, ends, data


def places(h: np.ndarray, segments: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Segment of each hash, and its bits there."""
    segment = (((h >> U64(32)) * U64(segments)) >> U64(32)).astype(np.int64)
    m, mask = T.mix(h ^ U64(0x5851F42D4C957F2D)), U64((1 << SEGMENT) - 1)
    return segment, [((m >> U64(SEGMENT * k)) & mask).astype(np.int64) for k in range(HASHES)]


def _filters(segments: int, min_chars: int):
    """Texts to the sparse bits of a task's once and twice filters, by segment."""

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        segment, bits = places(h, segments)
        cuts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1], [True]]))
        rows = []
        for s, e in zip(cuts[:-1], cuts[1:]):
            own = np.stack([b[s:e] for b in bits], 1)
            once, times = np.unique(own, return_counts=True)
            again = np.union1d(once[times > 1], own[n[s:e] > 1])
            rows.append(T.pack(once.astype(np.uint32), again.astype(np.uint32)))
        return pa.RecordBatch.from_arrays([pa.array(segment[cuts[:-1]]), pa.array(rows, pa.binary())], names=["segment", "bits"])

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for piece in T.chunks(batch, "text"):
                h = lines(piece.column("text"), min_chars)[0]
                held.append(h)
                n += len(h)
                if n >= FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return filters


def _merge(table: pa.Table) -> pa.Table:
    """The twice filter of a segment; the merge takes the filters in any order."""
    once, twice = np.zeros(1 << SEGMENT, bool), np.zeros(1 << SEGMENT, bool)
    for x in table.column("bits"):
        seen, again = T.unpack(x.as_py())
        twice[seen[once[seen]]] = True
        twice[again] = True
        once[seen] = True
    return pa.table([pa.array([table.column("segment")[0].as_py()]), pa.array([zlib.compress(np.packbits(twice).tobytes(), 1)], pa.binary())], names=["segment", "bits"])


def twice_filter(source: DataFrame, count: int, min_chars: int) -> tuple[int, np.ndarray]:
    """Segments, and the bytes of the filter of hashes seen twice."""
    segments = max(1, -(-count * BITS_PER_LINE // (1 << SEGMENT)))
    found = source.mapInArrow(lean(_filters(segments, min_chars)), "segment bigint, bits binary").groupBy("segment").applyInArrow(lean_group(_merge), "segment bigint, bits binary")
    return segments, _collected(found, segments)


def inside(segments: int, bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a filter holds."""
    segment, at = places(h, segments)
    hit = np.ones(len(h), bool)
    for b in at:
        b = b + (segment << SEGMENT)
        hit &= (bits[b >> 3] >> (7 - (b & 7)).astype(np.uint8) & 1).astype(bool)
    return hit


def _collected(found: DataFrame, segments: int) -> np.ndarray:
    """The bytes of a filter from its compressed segments."""
    out = np.zeros((segments, 1 << (SEGMENT - 3)), np.uint8)
    for segment, bits in found.toLocalIterator():
        out[segment] = np.frombuffer(zlib.decompress(bytes(bits)), np.uint8)
    return out.reshape(-1)


def id_filter(ids: DataFrame, count: int) -> tuple[int, np.ndarray]:
    """Segments and bytes of a Bloom filter of a column of numbers."""
    segments = max(1, -(-count * BITS_PER_ID // (1 << SEGMENT)))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segment, at = places(T.mix(batch.column(0).to_numpy().view(U64)), segments)
            flat = np.unique(np.concatenate([segment << SEGMENT | b for b in at]))
            cuts = np.flatnonzero(np.concatenate([[True], flat[1:] >> SEGMENT != flat[:-1] >> SEGMENT, [True]])) if len(flat) else np.zeros(1, np.int64)
            rows = [T.pack((flat[s:e] & ((1 << SEGMENT) - 1)).astype(np.uint32)) for s, e in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(flat[cuts[:-1]] >> SEGMENT), pa.array(rows, pa.binary())], names=["segment", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        own = np.zeros(1 << SEGMENT, bool)
        for x in table.column("bits"):
            own[T.unpack(x.as_py())[0]] = True
        return pa.table([pa.array([table.column("segment")[0].as_py()]), pa.array([zlib.compress(np.packbits(own).tobytes(), 1)], pa.binary())], names=["segment", "bits"])

    return segments, _collected(ids.mapInArrow(lean(bits), "segment bigint, bits binary").groupBy("segment").applyInArrow(lean_group(merge), "segment bigint, bits binary"), segments)


def _contents(shared, min_chars: int):
    """Texts to the suspects among their lines: by the twice filter, or the numbers in the column ``wanted``."""

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.chunks(batch, "text"):
                h, doc, number, starts, ends, data = lines(piece.column("text"), min_chars)
                if shared is not None:
                    hit = inside(*shared.value, h)
                else:
                    wanted = piece.column("wanted")
                    owner = np.repeat(np.arange(piece.num_rows), np.diff(wanted.offsets.to_numpy()))
                    hit = np.isin(doc << 32 | number, owner << 32 | wanted.flatten().to_numpy().astype(np.int64))
                doc, number, starts, ends = doc[hit], number[hit], starts[hit], ends[hit]
                length = ends - starts
                text = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.py_buffer(data[T.ragged(starts, length)]))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(doc)), pa.array(number, pa.int32()), text], names=["doc_id", "line", "content"])

    return suspects


def _digests(parts: int, min_chars: int):
    """Texts to their lines' hashes with document and line number, packed by range of the hash."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        h, doc, number = (np.concatenate(x) for x in zip(*held))
        at = np.argsort(h)
        h, doc, number = h[at], doc[at], number[at]
        part = (((h >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array([T.pack(h[s:e], doc[s:e], number[s:e]) for s, e in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["segment", "bits"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for piece in T.chunks(batch, "text"):
                h, doc, number = lines(piece.column("text"), min_chars)[:3]
                held.append((h, piece.column("doc_id").to_numpy()[doc], number.astype(np.uint32)))
                n += len(h)
                if n >= FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return digests


def _probe(table: pa.Table) -> pa.Table:
    """Both filters of a range of hashes, built of its payloads one by one, then asked for the lines of each."""
    payloads = [x.as_py() for x in table.column("bits")]
    bits = 1 << (BITS_PER_LINE * sum(len(T.unpack(x)[0]) for x in payloads)).bit_length()
    once, twice = np.zeros(bits, bool), np.zeros(bits, bool)

    def spots(h: np.ndarray) -> list[np.ndarray]:
        m = T.mix(h ^ U64(0x5851F42D4C957F2D))
        return [((m ^ (m >> U64(21 * k)) * U64(2 * k + 1)) & U64(bits - 1)).astype(np.int64) for k in range(HASHES)]

    for x in payloads:
        h, n = np.unique(T.unpack(x)[0], return_counts=True)
        own, times = np.unique(np.concatenate(spots(h)), return_counts=True)
        twice[own[once[own] | (times > 1)]] = True
        for at in spots(h[n > 1]):
            twice[at] = True
        once[own] = True
    ids, numbers = [], []
    for x in payloads:
        h, doc, number = T.unpack(x)
        hit = np.logical_and.reduce([twice[at] for at in spots(h)]) if len(h) else np.zeros(0, bool)
        ids.append(doc[hit])
        numbers.append(number[hit])
    return pa.table([pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(numbers).astype(np.int32))], names=["doc_id", "line"])


def suspected(source: DataFrame, min_chars: int, filter_bytes: int) -> DataFrame:
    """``doc_id, line, content`` of every line that the twice filter holds.

    A twice filter of ``filter_bytes`` at most is broadcast.  A larger one stays in
    the partitions of its hash ranges: the lines' hashes go there, and the numbers
    of the suspects go back to their documents.
    """
    spark = source.sparkSession
    count = source.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    found = "doc_id bigint, line int, content string"
    if count * BITS_PER_LINE // 8 <= filter_bytes:
        shared = spark.sparkContext.broadcast(twice_filter(source.select("text"), count, min_chars))
        return source.mapInArrow(lean(_contents(shared, min_chars)), found)
    parts = cluster.partitions(spark)
    hits = source.mapInArrow(lean(_digests(parts, min_chars)), "segment bigint, bits binary").groupBy("segment").applyInArrow(lean_group(_probe), "doc_id bigint, line int")
    wanted = cluster.written(spark, hits.groupBy("doc_id").agg(F.collect_set("line").alias("wanted")), "wanted")
    return source.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(lean(_contents(None, min_chars)), found)


def repeated_lines(docs: DataFrame, min_chars: int = 10, filter_bytes: int = 64 << 20) -> DataFrame:
    """``doc_id, line`` (number from 0) of every occurrence of a line after its first."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = cluster.written(spark, suspected(source, min_chars, filter_bytes), "suspects")
    first = found.groupBy("content").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("content", "first")
    return found.join(first, "content").where(F.struct("doc_id", "line") != F.col("first")).select("doc_id", "line")


def _maybe(bloom):
    """Which doc_ids may lose lines; none is missed."""

    @F.pandas_udf("boolean")
    def maybe(ids: pd.Series) -> pd.Series:
        some = ids.notna().to_numpy()
        hit = np.zeros(len(ids), bool)
        hit[some] = inside(*bloom.value, T.mix(ids[some].to_numpy().astype(np.int64).view(U64)))
        return pd.Series(hit)

    return maybe


def line_dedup(docs: DataFrame, min_chars: int = 10, filter_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with every later occurrence of a line taken out of ``text``, and the
    column ``lines_removed`` (replaced where docs has one).

    Lines end at a line feed and are compared without the spaces around them;
    those of fewer than ``min_chars`` characters always stay.  Of equal lines the
    one of the smallest doc_id, then line number, stays, over all documents and
    within each; rows that share a doc_id count as one document and lose the same
    line numbers.  A text all of whose lines go becomes empty; NULL texts, and rows
    without a doc_id, stay as they are and count for nothing.  An empty table stays
    empty, texts are read whole, other columns pass unchanged.

    Documents that lose no line aren't shuffled: a Bloom filter of the ids of the
    others, where it takes no more than ``filter_bytes``, parts them before the join.
    """
    spark = docs.sparkSession
    id_, lost = fresh("id"), fresh("gone")
    gone = cluster.written(spark, repeated_lines(docs, min_chars, filter_bytes).groupBy(F.col("doc_id").alias(id_)).agg(F.sort_array(F.collect_set("line")).alias(lost)), "gone")
    columns = [c for c in docs.columns if c.lower() != "lines_removed"]
    own = docs.select(*[F.col(f"`{c}`") for c in columns])
    key = F.col("doc_id").cast("bigint")

    def cleaned(part: DataFrame) -> DataFrame:
        # merged at every size: the ids that lose lines grow with the corpus
        joined = part.join(gone.hint("merge"), key == F.col(id_), "left")
        kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(lost, i))
        text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
        return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in columns], F.when(F.col(lost).isNull(), 0).otherwise(F.size(lost)).alias("lines_removed"))

    many = gone.count()
    if many * BITS_PER_ID // 8 > filter_bytes:
        return cleaned(own)
    flag = fresh("maybe")
    flagged = own.withColumn(flag, _maybe(spark.sparkContext.broadcast(id_filter(gone.select(id_), many)))(key))
    untouched = flagged.where(~F.col(flag)).select(*[F.col(f"`{c}`") for c in columns], F.lit(0).alias("lines_removed"))
    return untouched.union(cleaned(flagged.where(flag).drop(flag)))
