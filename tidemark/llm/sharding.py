"""Sharding by Karmarkar-Karp differencing.

A partial partition is one sum for each shard.  Each indivisible group starts as one
with its bytes in one place; again and again the two of largest spread are combined,
the largest sum of one with the smallest of the other.  Groups are differenced in
the leaves of a tree, in parallel, and the partial partitions that these leave go up
it by the same rule.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import cluster
from tidemark.llm.arrow import fresh, lean_group, small_batches

LEAF, FAN = 1 << 12, 64


def differencing(partials: list[list[int]], shards: int) -> list[list[int]]:
    """For each partial partition (sums by slot) the shard of each of its slots."""
    heap = []
    for i, sums in enumerate(partials):
        order = sorted(range(shards), key=lambda s: (sums[s], s))
        heap.append((sums[order[0]] - sums[order[-1]], i, [sums[s] for s in order], [[(i, s)] for s in order]))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        merged = []
        for j in range(shards):
            p, q = x[j], y[shards - 1 - j]
            if len(p) < len(q):
                p, q = q, p
            p.extend(q)
            merged.append((a[j] + b[shards - 1 - j], j, p))
        merged.sort(key=lambda m: m[:2])
        heapq.heappush(heap, (merged[0][0] - merged[-1][0], n, [m[0] for m in merged], [m[2] for m in merged]))
        n += 1
    out = [[0] * shards for _ in partials]
    if heap:
        for shard, held in enumerate(heap[0][3]):
            for i, s in held:
                out[i][s] = shard
    return out


def _leaf(shards: int):
    """The groups of a leaf (key, bytes) with the slot of each in the leaf's partial partition."""

    def run(table: pa.Table) -> pa.Table:
        size = table.column("bytes").to_numpy()
        keys = np.array(table.column("key").to_pylist(), object)
        order = np.lexsort((keys.astype(str), -size)).tolist()
        slots = differencing([[int(size[i])] + [0] * (shards - 1) for i in order], shards)
        slot = np.zeros(len(size), np.int32)
        slot[order] = [s[0] for s in slots]
        return pa.table([table.column("node"), table.column("key"), table.column("bytes"), pa.array(slot)], names=["node", "key", "bytes", "slot"])

    return run


def _inner(shards: int):
    """Partial partitions (node, slot, bytes) of one parent to the slot of each in the parent's."""

    def run(table: pa.Table) -> pa.Table:
        node, slot, size = (table.column(c).to_numpy() for c in ("node", "slot", "bytes"))
        known, at = np.unique(node, return_inverse=True)
        sums = np.zeros((len(known), shards), np.int64)
        sums[at, slot] = size
        order = np.lexsort((known, sums.min(1) - sums.max(1)))
        new = np.zeros((len(known), shards), np.int32)
        new[order] = differencing(sums[order].tolist(), shards)
        return pa.table([table.column("parent"), table.column("node"), table.column("slot"), pa.array(new[at, slot]), table.column("bytes")], names=["parent", "node", "slot", "up", "bytes"])

    return run


def assign_groups(groups: DataFrame, shards: int, leaf_groups: int = LEAF, fan: int = FAN) -> DataFrame:
    """``key, bytes`` of unique keys to ``key, shard``.

    Differencing goes up a tree: the groups of each leaf, about ``leaf_groups`` by the
    hash of their key, become one partial partition, those of ``fan`` leaves become one,
    and so on to the root; no task holds more.  Groups that fit in one leaf are
    differenced as a whole.
    """
    spark = groups.sparkSession
    groups = cluster.written(spark, groups.select("key", F.col("bytes").cast("bigint").alias("bytes")), "groups")
    nodes = max(1, -(-groups.count() // leaf_groups))
    leaves = groups.withColumn("node", F.pmod(F.xxhash64("key"), F.lit(nodes)))
    placed = cluster.written(spark, leaves.groupBy("node").applyInArrow(lean_group(_leaf(shards)), "node bigint, key string, bytes bigint, slot int"), "slots")
    # the slot of each leaf's slot in its ancestor so far: one row for each leaf and slot
    sums = placed.groupBy("node", "slot").agg(F.sum("bytes").alias("bytes"))
    route = sums.select(F.col("node").alias("leaf"), F.col("slot").alias("leaf_slot"), "node", "slot")
    while nodes > 1:
        parents = sums.withColumn("parent", F.floor(F.col("node") / fan))
        step = "parent bigint, node bigint, slot int, up int, bytes bigint"
        level = cluster.written(spark, parents.groupBy("parent").applyInArrow(lean_group(_inner(shards)), step), "level")
        route = cluster.written(spark, route.join(level, ["node", "slot"]).select("leaf", "leaf_slot", F.col("parent").alias("node"), F.col("up").alias("slot")), "route")
        sums = level.groupBy(F.col("parent").alias("node"), F.col("up").alias("slot")).agg(F.sum("bytes").alias("bytes"))
        nodes = -(-nodes // fan)
    route = route.select(F.col("leaf").alias("node"), F.col("leaf_slot").alias("slot"), F.col("slot").alias("shard"))
    return placed.join(route, ["node", "slot"]).select("key", "shard")


def shard_by_groups(docs: DataFrame, group: list[str], shards: int, leaf_groups: int = LEAF) -> DataFrame:
    """``docs`` with ``bytes``, the UTF-8 bytes of its text, and ``shard`` from 0, the
    same for all rows of a group; columns of these names are replaced.

    Rows whose group columns are NULL form groups of their own, told apart from
    empty strings; a NULL text has no bytes.  Repeated rows count each time.
    Groups without bytes, ties and more shards than groups are all placed; the
    outcome depends on the group sizes and keys alone.  An empty table stays empty.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    small_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c.lower() not in ("bytes", "shard")]
    own, of = fresh("key"), fresh("of")
    key = F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"_{i}") for i, c in enumerate(group)]))
    sized = docs.select(*[F.col(f"`{c}`") for c in columns], F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("bytes"), key.alias(own))
    groups = sized.groupBy(F.col(own).alias("key")).agg(F.sum("bytes").alias("bytes"))
    placed = cluster.written(docs.sparkSession, assign_groups(groups, shards, leaf_groups), "shards").select(F.col("key").alias(of), "shard")
    return sized.join(placed, F.col(own) == F.col(of)).select(*[F.col(f"`{c}`") for c in columns], "bytes", "shard")
