"""Centroids, distances and nearest-centroid assignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import cluster
from tidemark.functions import arrays as A

BLOCK, BLOCKS = 1024, 32  # rows of a block at least, blocks of a group at most
TILE = 256, 512  # pairs whose distances are held at once
PRODUCT = 512, 4096  # the same for a product of matrices


def drop_missing(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is present, with no missing element."""
    return vectors.where(~A.has_nan(vector))


def downsample(vectors: DataFrame, keys: list[str], most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows, those of least hash; the same for the same rows."""
    return vectors.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(most)


def centroids(vectors: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``keys, centroid, n``: the mean of each group's vectors, by element.

    Elements are summed in the map tasks, so a group sends one row per element and
    task, whatever its size.
    """
    long = vectors.select(*keys, F.posexplode(vector).alias("__d", "__x"))
    mean = long.groupBy(*keys, "__d").agg(F.avg(F.col("__x").cast("double")).alias("__m"), F.count(F.lit(1)).alias("__n"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("__d", "__m"))), lambda s: s["__m"])
    return mean.groupBy(*keys).agg(whole.alias("centroid"), F.max("__n").alias("n"))


def _blocks(rows: DataFrame, keys: list[str], hashed: list[str]) -> DataFrame:
    """Adds ``__b``, the block of a row by hash, and ``__n``, the blocks of its group; rows without a key go."""
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    counted = rows.groupBy(*keys).agg(F.least(F.lit(BLOCKS), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("__n"))
    joined = rows.join(counted, keys) if keys else rows.crossJoin(counted)
    return joined.withColumn("__b", F.pmod(F.xxhash64(*hashed), "__n").cast("int"))


def _cells(blocked: DataFrame) -> DataFrame:
    """Each row once for every cell ``__p <= __q`` of two blocks that its block is part of."""
    other = blocked.withColumn("__c", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return other.withColumn("__p", F.least("__b", "__c")).withColumn("__q", F.greatest("__b", "__c")).drop("__c", "__n")


def _tasks(rows: DataFrame) -> int:
    """Cells are small and their pairs many, so their number of partitions doesn't follow their bytes."""
    return max(cluster.partitions(rows.sparkSession), 4 * rows.sparkSession.sparkContext.defaultParallelism)


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, filled up with zeros, and their lengths; -1 where one is NULL or has a NULL element."""
    column = pa.chunked_array(column.chunks, column.type).combine_chunks().cast(pa.list_(pa.float64()))
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, width = column.flatten(), int(size.max(initial=0))
    values = flat.to_numpy(zero_copy_only=False)
    length = np.where(column.is_null().to_numpy(zero_copy_only=False), -1, size)
    if flat.null_count:
        length[np.repeat(np.arange(len(size)), size)[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    if (size == width).all():
        return values.reshape(len(size), width), length
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = values
    return out, length


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, elements added in order."""
    total, gap = np.zeros((len(x), len(y))), np.empty((len(x), len(y)))
    for u, v in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)):
        np.subtract(u[:, None], v, out=gap)
        np.multiply(gap, gap, out=gap)
        total += gap
    return total


def _tiles(rows: int, columns: int, shape: tuple[int, int], upper: bool = False) -> Iterator[tuple[slice, slice]]:
    """Tiles of a matrix; ``upper``: without those below the diagonal."""
    for r in range(0, rows, shape[0]):
        for c in range(r if upper else 0, columns, shape[1]):
            yield slice(r, min(rows, r + shape[0])), slice(c, min(columns, c + shape[1]))


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Ranks of a sorted column, equal values alike."""
    column = column.combine_chunks()
    return np.cumsum(np.concatenate([[0], pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)]).astype(np.int64))


def _pairwise(keys: list[str]):
    """A cell's vectors to the pairs between its two blocks, tile by tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("__i").combine_chunks()
        ids, code, block = table.column("__i").combine_chunks(), _codes(table.column("__i")), table.column("__b").to_numpy()
        x, length = matrix(table.column("__v"))
        first, last = table.column("__p")[0].as_py(), table.column("__q")[0].as_py()
        sides = np.flatnonzero(block == first), np.flatnonzero(block == last)
        named = [table.column(k)[0] for k in keys]
        for r, c in _tiles(len(sides[0]), len(sides[1]), TILE, first == last):
            i, j = sides[0][r], sides[1][c]
            with np.errstate(invalid="ignore", over="ignore"):
                distance = np.sqrt(_squares(x[i], x[j]))
            ahead = code[i][:, None] < code[j]
            kept = ahead if first == last else ahead | (code[i][:, None] > code[j])
            row, column = np.nonzero(kept)
            turned = ~ahead[row, column]
            a, b = i[row], j[column]
            left, right = np.where(turned, b, a), np.where(turned, a, b)
            missing = (length[a] != length[b]) | (length[a] < 0)
            n = len(a)
            if n:
                yield pa.RecordBatch.from_arrays([*[pa.repeat(k, n) for k in named], ids.take(pa.array(left)), ids.take(pa.array(right)), pa.array(distance[row, column], mask=missing)], names=[*keys, "i", "j", "distance"])

    return run


def pairwise(vectors: DataFrame, keys: list[str], id_: str, vector: str) -> DataFrame:
    """``keys, i, j, distance`` of all pairs i < j of a group, Euclidean.

    A group is cut into at most BLOCKS blocks and each two of them are a task's, so
    that one large group is spread too and a row is sent BLOCKS times at most.
    """
    kinds = dict(vectors.dtypes)
    rows = vectors.where(F.col(id_).isNotNull()).select(*keys, F.col(id_).alias("__i"), F.col(vector).alias("__v"))
    cells = _cells(_blocks(rows, keys, ["__i"])).repartition(_tasks(vectors), *keys, "__p", "__q")
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " * bool(keys) + f"i {kinds[id_]}, j {kinds[id_]}, distance double"
    return cells.groupBy(*keys, "__p", "__q").applyInArrow(_pairwise(keys), schema)


def pairs(rows: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """``keys, i, j`` of all pairs i < j of a group; blocks are spread as in ``pairwise``, as arrays of ids."""
    named = rows.where(F.col(id_).isNotNull()).select(*keys, F.col(id_).alias("__i"))
    packed = _blocks(named, keys, ["__i"]).groupBy(*keys, "__b", "__n").agg(F.collect_list("__i").alias("__ids"))
    side = [F.first(F.when(F.col("__b") == F.col(c), F.col("__ids")), ignorenulls=True).alias(name) for c, name in (("__p", "__l"), ("__q", "__r"))]
    cells = _cells(packed).groupBy(*keys, "__p", "__q").agg(*side).repartition(_tasks(rows))
    # a cell of two blocks has none of one only where a hash has left a block empty
    each = cells.select(*keys, "__p", "__q", F.explode("__l").alias("__x"), "__r").select(*keys, "__p", "__q", "__x", F.explode("__r").alias("__y"))
    met = each.where((F.col("__x") < F.col("__y")) | (F.col("__p") < F.col("__q")) & (F.col("__x") > F.col("__y")))
    return met.select(*keys, F.least("__x", "__y").alias("i"), F.greatest("__x", "__y").alias("j"))


def cosine_matrix(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_vector: str, right_vector: str) -> DataFrame:
    """``left_id, right_id, distance`` of all pairs, cosine; one side is meant to be few centroids."""
    a = left.select(left_id, F.col(left_vector).alias("__a"))
    b = right.select(right_id, F.col(right_vector).alias("__b"))
    return a.crossJoin(b).select(left_id, right_id, A.cosine_distance("__a", "__b").alias("distance"))


def assign_nearest(vectors: DataFrame, centroid: DataFrame, id_: list[str], vector: str, keys: list[str] | None = None) -> DataFrame:
    """``keys, id, cluster, similarity``: the cluster whose centroid is nearest by
    cosine (similarity is 2 - distance), ties to the lower; a missing vector goes to 0.

    The few centroids of a key travel as one array to its vectors, so a vector is a
    single row throughout and the choice is made within it.
    """
    keys = keys or []
    packed = F.array_sort(F.collect_list(F.struct("cluster", "centroid"))).alias("__c")
    grouped = centroid.groupBy(*keys).agg(packed)
    joined = vectors.join(grouped, keys) if keys else vectors.crossJoin(grouped)
    v = F.col(vector)
    scored = F.transform("__c", lambda c: F.struct((2 - A.cosine_distance(v, c["centroid"])).alias("s"), (-c["cluster"]).alias("k")))
    best = F.array_max(F.filter(scored, lambda x: x["s"].isNotNull() & ~F.isnan(x["s"])))
    made = joined.select(*keys, *id_, F.when(~A.has_nan(vector), best).alias("__best"))
    return made.select(*keys, *id_, F.coalesce(-F.col("__best")["k"], F.lit(0)).cast("int").alias("cluster"), F.col("__best")["s"].alias("similarity"))


def small_to_large(assigned: DataFrame, vectors_: str, min_size: int, keys: list[str] | None = None) -> DataFrame:
    """Adds ``target``: the own cluster of rows in clusters of ``min_size`` or more; for
    others the large cluster of nearest centroid; 0 where no cluster is large."""
    keys = keys or []
    means = centroids(assigned, [*keys, "cluster"], vectors_)
    large = means.where(F.col("n") >= min_size)
    small = means.where(F.col("n") < min_size)
    nearest = assign_nearest(small.withColumnRenamed("cluster", "small").withColumnRenamed("centroid", "__v"), large, ["small"], "__v", keys)
    mapping = nearest.select(*keys, F.col("small").alias("cluster"), F.col("cluster").alias("target")).unionByName(large.select(*keys, "cluster", F.col("cluster").alias("target")))
    return assigned.join(mapping, [*keys, "cluster"], "left").withColumn("target", F.coalesce("target", F.lit(0)))


def renumber(labelled: DataFrame, label: str, keys: list[str] | None = None) -> DataFrame:
    """Labels to 0, 1, ... in ascending order, by key; the few distinct ones are ranked and joined back."""
    keys = keys or []
    distinct = labelled.select(*keys, label).distinct()
    order = Window.partitionBy(*(F.col(k) for k in keys)).orderBy(label) if keys else Window.orderBy(label)
    ranked = distinct.withColumn("__new", (F.row_number().over(order) - 1).cast("int"))
    return labelled.join(ranked, [*keys, label]).withColumn(label, F.col("__new")).drop("__new")


def cluster_sizes(labelled: DataFrame, label: str, keys: list[str] | None = None) -> DataFrame:
    return labelled.groupBy(*(keys or []), label).agg(F.count(F.lit(1)).alias("n"))


def _runs(code: np.ndarray) -> np.ndarray:
    """Starts of the runs of a sorted array, and its end."""
    return np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]])) if len(code) else np.zeros(1, np.int64)


def _least(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, best: np.ndarray, wanted: np.ndarray) -> None:
    """Lowers ``best`` to the least squared distances where ``wanted``; a and b, ascending, are the rows of best of x's and its columns of y's.

    A product of matrices finds where a least one may lie; those few are computed from differences.
    """
    square = [np.einsum("ij,ij->i", v, v) for v in (x, y)]
    x_long, y_long = np.column_stack([-2 * x, square[0], np.ones(len(x))]), np.column_stack([y, np.ones(len(y)), square[1]])
    for r, c in _tiles(len(x), len(y), PRODUCT):
        rows, columns = _runs(a[r]), _runs(b[c])
        here = np.ix_(a[r][rows[:-1]], b[c][columns[:-1]])
        if not wanted[here].any():
            continue
        product = x_long[r] @ y_long[c].T
        # far above the rounding of so many products
        slack = 8 * (x.shape[1] + 8) * 2.3e-16 * (square[0][r].max() + square[1][c].max())
        lines = np.stack([product[s:e].min(0) for s, e in zip(rows[:-1], rows[1:])])
        low = np.minimum.reduceat(lines, columns[:-1], axis=1)
        for u, v in np.argwhere((low - slack < best[here]) & wanted[here]):
            i, j = np.nonzero(product[rows[u] : rows[u + 1], columns[v] : columns[v + 1]] <= low[u, v] + 2 * slack)
            place = here[0][u, 0], here[1][0, v]
            for k in range(0, len(i), 1 << 14):
                left, right = x[r][rows[u] + i[k : k + (1 << 14)]], y[c][columns[v] + j[k : k + (1 << 14)]]
                total = np.zeros(len(left))
                for one, other in zip(left.T, right.T):
                    total += (one - other) * (one - other)
                best[place] = min(best[place], total.min())


def _least_of_labels(keys: list[str]):
    """A cell's vectors to the least distance of each two of its labels: NaN where all are, NULL where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("__l").combine_chunks()
        code, block, label = _codes(table.column("__l")), table.column("__b").to_numpy(), table.column("__l").combine_chunks()
        x, length = matrix(table.column("__v"))
        with np.errstate(invalid="ignore", over="ignore"):
            plain = np.isfinite((x * x).sum(1))
        first, last = table.column("__p")[0].as_py(), table.column("__q")[0].as_py()
        named = [table.column(k)[0] for k in keys]
        one, two = np.flatnonzero(block == first), np.flatnonzero(block == last)
        if not len(one) or not len(two):
            return
        ends, (others, column) = _runs(code[one]), np.unique(code[two], return_inverse=True)
        # the labels of one side in turns, so that no matrix of labels holds more than some millions
        for k in range(0, len(ends) - 1, step := max(1, (1 << 21) // len(others))):
            own = one[ends[k] : ends[min(k + step, len(ends) - 1)]]
            labels, row = np.unique(code[own], return_inverse=True)
            wanted = labels[:, None] < others if first == last else labels[:, None] != others
            best, met, real = np.full(wanted.shape, np.inf), np.zeros(wanted.shape, bool), np.zeros(wanted.shape, bool)
            for size in np.unique(length[own][length[own] >= 0]):
                i, j = np.flatnonzero(length[own] == size), np.flatnonzero(length[two] == size)
                met[np.ix_(np.unique(row[i]), np.unique(column[j]))] = True
                fine, good = plain[own[i]], plain[two[j]]
                if fine.any() and good.any():
                    _least(x[own[i[fine]]], x[two[j[good]]], row[i[fine]], column[j[good]], best, wanted)
                for some, rest in ((i[~fine], j), (i[fine], j[~good])):  # NaN, infinite or too long to square
                    for r, c in _tiles(len(some), len(rest), TILE):
                        with np.errstate(invalid="ignore", over="ignore"):
                            total = _squares(x[own[some[r]]], x[two[rest[c]]])
                        place = np.broadcast_arrays(row[some[r]][:, None], column[rest[c]])
                        np.fmin.at(best, tuple(place), total)
                        kept = ~np.isnan(total)
                        real[place[0][kept], place[1][kept]] = True
            u, v = np.nonzero(wanted)
            value = np.where((real | np.isfinite(best))[u, v], np.sqrt(best[u, v]), np.nan)
            at = np.searchsorted(code, labels)[u], np.searchsorted(code, others)[v]
            if len(u):
                yield pa.RecordBatch.from_arrays([*[pa.repeat(k, len(u)) for k in named], label.take(pa.array(np.minimum(*at))), label.take(pa.array(np.maximum(*at))), pa.array(value, mask=~met[u, v])], names=[*keys, "a", "b", "distance"])

    return run


def cluster_distances(vectors: DataFrame, keys: list[str], id_: str, vector: str, label: str) -> DataFrame:
    """``keys, a, b, distance``: the least distance between members of two clusters a < b.

    Every pair is looked at, as in ``pairwise`` by cells of two blocks, each of which gives a row for two labels.
    """
    kinds = dict(vectors.dtypes)
    rows = vectors.where(F.col(label).isNotNull()).select(*keys, F.col(label).alias("__l"), F.col(vector).alias("__v"), F.col(id_).alias("__i"))
    cells = _cells(_blocks(rows, keys, ["__i", "__v"]).drop("__i")).repartition(_tasks(vectors), *keys, "__p", "__q")
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " * bool(keys) + f"a {kinds[label]}, b {kinds[label]}, distance double"
    return cells.groupBy(*keys, "__p", "__q").applyInArrow(_least_of_labels(keys), schema).groupBy(*keys, "a", "b").agg(F.min("distance").alias("distance"))
