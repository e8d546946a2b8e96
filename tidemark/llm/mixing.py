"""Mixing sources to target weights.

The tokens of each source, documents in order of doc_id, are packed into blocks of
fixed length.  Every output shard draws its counts of blocks by source from a
multinomial; the slots of a source are numbered through all shards, number k maps to
a block by a pseudorandom permutation of the source's block indexes (a new one each
time the source has been used up), and blocks join the slots by index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import cluster
from tidemark.llm import textops as T
from tidemark.llm.arrow import fresh, lean, lean_group, small_batches

U64 = np.uint64
RANGE = 4096  # documents are ordered within ranges of so many ids
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PIECE = pa.schema([("source", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("text", pa.string())])


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1: a Feistel network of four rounds,
    walked until it falls within the range."""
    half = max(1, -(-max(1, int(size - 1).bit_length()) // 2))
    mask = U64((1 << half) - 1)
    keys = T.mix(np.arange(4, dtype=U64) + U64(key & (2**64 - 1)))
    x, todo = index.astype(U64), np.arange(len(index))
    while len(todo):
        left, right = x[todo] >> U64(half), x[todo] & mask
        for k in keys:
            left, right = right, left ^ (T.mix(right ^ k) & mask)
        x[todo] = left << U64(half) | right
        todo = todo[x[todo] >= U64(size)]
    return x.astype(np.int64)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the tokens (words between white space), offsets by text, bytes and byte offsets."""
    data, offsets = T.utf8(column)
    starts, _, at = T.runs(~_SPACE[data], offsets)
    return starts, at, data, offsets


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in T.chunks(batch, "text"):
            yield pa.RecordBatch.from_arrays([piece.column("source"), piece.column("range"), pa.array(np.diff(_tokens(piece.column("text"))[1]))], names=["source", "range", "n"])


def _pieces(length: int):
    """Texts of one source and id range, with the place of their first token, to pieces of blocks."""

    def pieces(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        out, place = [], table.column("begin")[0].as_py()
        for batch in table.to_batches():
            for part in T.chunks(batch, "text"):
                starts, at, data, offsets = _tokens(part.column("text"))
                many = np.diff(at)
                begin = place + np.concatenate([[0], np.cumsum(many)])[:-1]
                place += int(many.sum())
                blocks = np.where(many > 0, (begin + many - 1) // length - begin // length + 1, 0)
                doc = np.repeat(np.arange(len(many)), blocks)
                nth = T.ragged(np.zeros(len(many), np.int64), blocks)
                block = begin[doc] // length + nth
                first = np.maximum(block * length, begin[doc])
                last = np.minimum((block + 1) * length, begin[doc] + many[doc])
                token = at[:-1][doc] + first - begin[doc]
                ends = np.append(starts, len(data))[at[:-1][doc] + last - begin[doc]]
                ends = np.where(last == begin[doc] + many[doc], offsets[1:][doc], ends)
                begins = starts[token] if len(token) else np.zeros(0, np.int64)
                size = ends - begins
                text = pa.StringArray.from_buffers(len(doc), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(data[T.ragged(begins, size)]))
                take = pa.array(doc)
                out.append(pa.RecordBatch.from_arrays([part.column("source").take(take), pa.array(block), pa.array(first), pa.array(last - first), part.column("doc_id").take(take), part.column("lang").take(take), text], schema=_PIECE))
        return pa.Table.from_batches(out, _PIECE)

    return pieces


def _begins(counts: DataFrame) -> DataFrame:
    """``source, range, n`` with ``begin``, the tokens of the source in earlier ranges.

    A prefix sum in two steps: ranges are sorted over all partitions, each sums its
    own, and the sums of whole partitions, a few rows for each, are summed by source.
    """
    spark = counts.sparkSession
    run, order = fresh("run"), fresh("before")
    ranged = counts.repartitionByRange(cluster.partitions(spark), "source", "range").withColumn(run, F.spark_partition_id())
    ranged = cluster.written(spark, ranged, "ranges")
    inner = Window.partitionBy("source", run).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("source").orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    earlier = ranged.groupBy("source", run).agg(F.sum("n").alias("n")).select("source", run, F.coalesce(F.sum("n").over(outer), F.lit(0)).alias(order))
    within = ranged.withColumn("begin", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    return cluster.written(spark, within.join(earlier, ["source", run]).select("source", "range", "n", (F.col("begin") + F.col(order)).alias("begin")), "places")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, block_tokens: int = 1024, shard_blocks: int = 4096, total_blocks: int | None = None, temperature: float = 2.0, seed: int = 11) -> DataFrame:
    """Blocks in the order of the mixture: ``shard, slot, source, block, epoch, n, doc_ids, lang, text``.

    ``weights`` gives the target share of each source; a source that it leaves out
    gets none.  By default a source weighs its number of tokens to the power
    1/temperature.  As many blocks are drawn as the sources hold, or
    ``total_blocks``; a source whose share exceeds its blocks is used again, each
    time in another order, and ``epoch`` counts that from 0.  A token is a word
    between white space; a block has ``block_tokens`` of them (``n``), the last of
    a source what is left; the documents' parts are joined by a line feed,
    ``doc_ids`` names them in order and ``lang`` is that of the first.

    Rows without a doc_id and texts that are NULL or have no token bring nothing; a
    NULL source counts as the source "".  Repeated rows are packed each time.  A
    weight for a source without tokens is left out; with nothing to draw the result
    is empty.  Texts are read whole, other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    source = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.floor(F.col("doc_id").cast("bigint") / RANGE).alias("range"),
        lang.alias("lang"),
        F.col("text").cast("string").alias("text"),
    )
    counts = source.select("source", "range", "text").mapInArrow(lean(_count), "source string, range bigint, n bigint").groupBy("source", "range").agg(F.sum("n").alias("n"))
    places = _begins(counts)

    totals = {r.source: r.n for r in places.groupBy("source").agg(F.sum("n").alias("n")).collect() if r.n}
    blocks = {s: -(-n // block_tokens) for s, n in totals.items()}
    share = {s: (weights.get(s, 0) if weights is not None else totals[s] ** (1 / temperature)) for s in sorted(totals)}
    names = [s for s in share if share[s] > 0]
    p = np.array([share[s] for s in names], np.float64)
    wanted = (sum(blocks.values()) if total_blocks is None else total_blocks) if names else 0
    shards = -(-wanted // shard_blocks)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                n = min(shard_blocks, wanted - shard * shard_blocks)
                got = np.random.default_rng([seed, shard]).multinomial(n, p / p.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), shard)), pa.array(range(len(got)), pa.int32()), pa.array(got)], names=["shard", "s", "n"])

    drawn = spark.range(shards).mapInArrow(draw, "shard bigint, s int, n bigint").where("n > 0")
    earlier = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("begin", F.coalesce(F.sum("n").over(earlier), F.lit(0)))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, s, n, begin in zip(*(batch.column(c).to_pylist() for c in ("shard", "s", "n", "begin"))):
                size = blocks[names[s]]
                k = begin + np.arange(n)
                block = np.empty(n, np.int64)
                for epoch in range(begin // size, (begin + n - 1) // size + 1):
                    own = k // size == epoch
                    block[own] = permuted(k[own] % size, size, (seed << 40) ^ (s << 20) ^ epoch)
                key = T.mix(T.mix(k.astype(U64) + U64(seed)) + U64(s))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array([names[s]] * n), pa.array(block), pa.array(k // size), pa.array(key.view(np.int64))], names=["shard", "source", "block", "epoch", "key"])

    chosen = drawn.mapInArrow(slots, "shard bigint, source string, block bigint, epoch bigint, key bigint")
    chosen = chosen.withColumn("slot", F.row_number().over(Window.partitionBy("shard").orderBy("key", "source", "epoch", "block")) - 1).drop("key")
    # one row for each block of the result: written, so that its size is known, and never broadcast
    chosen = cluster.written(spark, chosen, "slots").hint("merge")

    packed = (
        source.join(places.select("source", "range", "begin"), ["source", "range"])
        .select("source", "range", "begin", "doc_id", "lang", "text")
        .groupBy("source", "range")
        .applyInArrow(lean_group(_pieces(block_tokens)), "source string, block bigint, at bigint, n bigint, doc_id bigint, lang string, text string")
    )
    whole = packed.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("at", "doc_id", "lang", "text", "n"))).alias("p"))
    return chosen.join(whole, ["source", "block"]).select(
        "shard", "slot", "source", "block", "epoch",
        F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x.n).alias("n"),
        F.transform("p", lambda x: x.doc_id).alias("doc_ids"),
        F.col("p")[0].lang.alias("lang"),
        F.array_join(F.transform("p", lambda x: x.text), "\n").alias("text"),
    )
