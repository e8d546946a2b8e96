"""Agglomerative clustering of one group's vectors, in numpy.

Up to DENSE vectors, and by distances that vectors alone don't give (complete, average,
weighted), the merges follow a full matrix of squared or plain distances with a
nearest-neighbour array per row; each merge updates one row by the Lance-Williams rule of
the method.  Beyond, centroids are kept in place of distances, or for single linkage a
spanning tree is grown, so memory grows with the vectors alone.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.cluster import partitions
from tidemark.operators import vectors

METHODS = ("single", "complete", "average", "weighted", "centroid", "median", "ward")
_SQUARED = ("centroid", "median", "ward")
DENSE = 512  # vectors up to which all distances are held
STRIP = 1 << 21  # distances that are held at once beyond


def _update(method: str, dx: np.ndarray, dy: np.ndarray, dxy: float, nx: int, ny: int, n: np.ndarray) -> np.ndarray:
    """Distances of all others to the merger of x and y."""
    if method == "single":
        return np.minimum(dx, dy)
    if method == "complete":
        return np.maximum(dx, dy)
    if method == "average":
        return (nx * dx + ny * dy) / (nx + ny)
    if method == "weighted":
        return (dx + dy) / 2
    if method == "centroid":
        return (nx * dx + ny * dy) / (nx + ny) - nx * ny * dxy / (nx + ny) ** 2
    if method == "median":
        return (dx + dy) / 2 - dxy / 4
    return ((nx + n) * dx + (ny + n) * dy - n * dxy) / (nx + ny + n)


def linkage(x: np.ndarray, method: str = "centroid") -> np.ndarray:
    """Merges as rows (left, right, distance, size); points are 0..n-1, merge k is n + k."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    n = len(x)
    if n < 2:
        return np.zeros((0, 4))
    x = np.asarray(x, np.float64)
    if n > DENSE and np.isfinite(x).all():
        if method == "single":
            return _tree(x)
        if method in _SQUARED:
            return _centres(x, method)
    square = (x * x).sum(1)
    d = np.maximum(square[:, None] + square[None] - 2 * x @ x.T, 0)
    if n <= 512:  # exact differences where they are cheap
        d = ((x[:, None] - x[None]) ** 2).sum(2)
    if method not in _SQUARED:
        d = np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    size, name = np.ones(n), np.arange(n)
    live = np.ones(n, bool)
    # nearest neighbour of higher index, ties to the lower index
    upper = np.where(np.tri(n, dtype=bool), np.inf, d)
    near = upper.argmin(1)
    least = upper[np.arange(n), near]
    del upper
    out = np.zeros((n - 1, 4))
    for k in range(n - 1):
        a = int(np.argmin(np.where(live, least, np.inf)))
        b = int(near[a])
        height = d[a, b]
        low, high = sorted((name[a], name[b]))
        out[k] = low, high, np.sqrt(max(height, 0)) if method in _SQUARED else height, size[a] + size[b]
        others = np.flatnonzero(live)
        others = others[(others != a) & (others != b)]
        new = _update(method, d[a, others], d[b, others], height, size[a], size[b], size[others])
        live[a] = False
        least[a] = np.inf
        d[a, :] = d[:, a] = np.inf
        d[b, others] = d[others, b] = new
        size[b] += size[a]
        name[b] = n + k
        # rows whose nearest is gone or whose distance to b has changed
        for i in others[(others < b) & ((near[others] == a) | (near[others] == b) | (new < least[others]) | ((new == least[others]) & (b < near[others])))].tolist() + others[(others > b) & (near[others] == a)].tolist() + [b]:
            row = d[i, i + 1 :]
            if len(row) and np.isfinite(row).any():
                near[i] = i + 1 + int(row.argmin())
                least[i] = d[i, near[i]]
            else:
                least[i] = np.inf
    return out


def _tree(x: np.ndarray) -> np.ndarray:
    """Merges of single linkage: the edges of a least spanning tree in order of length."""
    n = len(x)
    square = np.einsum("ij,ij->i", x, x)
    rest, points, norms = np.arange(1, n), x[1:].copy(), square[1:].copy()
    near, least = np.zeros(n - 1, np.int64), np.full(n - 1, np.inf)
    ends, at, many = np.empty((n - 1, 2), np.int64), 0, n - 1
    live = np.ones(n - 1, bool)
    for k in range(n - 1):
        d = points @ (-2 * x[at])
        d += norms
        d += square[at]
        closer = (d < least) & live
        least[closer], near[closer] = d[closer], at
        i = int(least.argmin())
        at = int(rest[i])
        ends[k] = near[i], at
        live[i], least[i], many = False, np.inf, many - 1
        if many < 0.8 * len(rest) and len(rest) > 64:
            rest, points, norms, near, least = (v[live] for v in (rest, points, norms, near, least))
            live = np.ones(many, bool)
    length = np.sqrt(((x[ends[:, 0]] - x[ends[:, 1]]) ** 2).sum(1))
    owner, name, size, out = list(range(n)), list(range(n)), [1] * n, np.zeros((n - 1, 4))

    def root(i: int) -> int:
        while owner[i] != i:
            owner[i] = i = owner[owner[i]]
        return i

    for k, e in enumerate(np.argsort(length, kind="stable").tolist()):
        a, b = sorted(map(root, ends[e].tolist()))
        out[k] = min(name[a], name[b]), max(name[a], name[b]), length[e], size[a] + size[b]
        owner[a], name[b], size[b] = b, n + k, size[a] + size[b]
    return out


def _centres(x: np.ndarray, method: str) -> np.ndarray:
    """Merges by centroids, medians or Ward's rule, which centres and sizes alone give.

    Each cluster knows its nearest other one, at ``least``, and a bound that no third one is
    under.  A merger's distances to all others are one product.  Whoever has lost its nearest
    takes the merger if that is under the bound; else the bound stands for it, and its row is
    computed only once no known distance is less.
    """
    n = len(x)
    slot, centre, size, name = np.arange(n), x.copy(), np.ones(n), np.arange(n)
    square = np.einsum("ij,ij->i", centre, centre)
    near, least, bound = np.empty(n, np.int64), np.empty(n), np.full(n, np.inf)

    def weighed(d: np.ndarray, one, others) -> np.ndarray:
        np.maximum(d, 0, out=d)
        return d * (2 * one * others / (one + others)) if method == "ward" else d

    step = max(1, STRIP // n)
    for s in range(0, n, step):
        d = centre[s : s + step] @ (-2 * centre.T)
        d += square
        d += square[s : s + step, None]
        np.maximum(d, 0, out=d)
        row = np.arange(len(d))
        d[row, row + s] = np.inf
        near[s : s + step] = i = d.argmin(1)
        least[s : s + step] = d[row, i]
        d[row, i] = np.inf
        bound[s : s + step] = d.min(1)
    known, live = np.ones(n, bool), np.ones(n, bool)
    out, many = np.zeros((n - 1, 4)), n

    def distances(a: int) -> np.ndarray:
        d = centre @ (-2 * centre[a])
        d += square
        d += square[a]
        d = weighed(d, size[a], size)
        d[~live] = np.inf
        d[a] = np.inf
        return d

    for k in range(n - 1):
        while not known[a := int(least.argmin())]:
            d = distances(a)
            near[a] = b = int(d.argmin())
            least[a], known[a] = d[b], True
            d[b] = np.inf
            bound[a] = d.min()
        b = int(near[a])
        a, b = min(a, b), max(a, b)
        height = weighed(((centre[a] - centre[b]) ** 2).sum(keepdims=True), size[a], size[b])[0]
        out[k] = min(name[a], name[b]), max(name[a], name[b]), np.sqrt(height), size[a] + size[b]
        if k == n - 2:
            break
        centre[b] = (centre[a] + centre[b]) / 2 if method == "median" else (size[a] * centre[a] + size[b] * centre[b]) / (size[a] + size[b])
        square[b] = centre[b] @ centre[b]
        size[b] += size[a]
        name[b] = n + k
        live[a], least[a], many = False, np.inf, many - 1
        d = distances(b)
        lost = (near == a) | (near == b)
        lost &= known
        lost &= live
        lost[b] = False
        taken = lost & (d < bound)
        gone = lost & ~taken
        closer = d < least
        closer |= (d == least) & (b < near)
        closer &= known & ~lost
        closer[b] = False
        between = d < bound
        between &= ~taken & ~closer
        # those of unknown nearest hold their bound as the least
        nearer = np.flatnonzero(~known & (d < least))
        bound[closer] = least[closer]
        for own in (np.flatnonzero(taken), np.flatnonzero(closer)):
            near[own], least[own] = b, d[own]
        between = np.flatnonzero(between)
        bound[between] = d[between]
        own = np.flatnonzero(gone)
        known[own], least[own] = False, bound[own]
        known[nearer], near[nearer], bound[nearer], least[nearer] = True, b, least[nearer], d[nearer]
        near[b] = c = int(d.argmin())
        least[b], known[b] = d[c], True
        d[c] = np.inf
        bound[b] = d.min()
        if many < 0.8 * len(slot) and len(slot) > 64:
            place = np.cumsum(live) - 1
            near = place[near[live]]
            # of unknown ones the nearest is never read
            slot, centre, size, name, square, least, bound, known = (v[live] for v in (slot, centre, size, name, square, least, bound, known))
            live = np.ones(many, bool)
    return out


def heights(z: np.ndarray) -> np.ndarray:
    """The greatest distance within each merge's subtree; linkage may not be monotone."""
    n = len(z) + 1
    top = z[:, 2].copy()
    for k in range(len(z)):
        for child in z[k, :2].astype(int):
            if child >= n:
                top[k] = max(top[k], top[child - n])
    return top


def cut(z: np.ndarray, cutoff: float, by: np.ndarray | None = None) -> np.ndarray:
    """Flat labels from 0, left branches first: subtrees that stay within the cutoff."""
    n = len(z) + 1
    top = heights(z if by is None else np.column_stack([z[:, :2], by, z[:, 3]]))
    labels, stack, label = np.zeros(n, np.int64), [2 * n - 2], 0
    while stack:
        node = stack.pop()
        if node < n:
            labels[node] = label
            label += 1
        elif top[node - n] <= cutoff:
            inner = [node]
            while inner:
                m = inner.pop()
                if m < n:
                    labels[m] = label
                else:
                    inner += z[m - n, :2].astype(int).tolist()
            label += 1
        else:
            left, right = z[node - n, :2].astype(int)
            stack += [right, left]
    return labels


def bounds(n: int, num: int | None = None, least: int | None = None, most: int | None = None) -> tuple[int | None, int, int]:
    """Resolved (num, min, max) clusters for n vectors, each within 1..n."""
    least, most = num or least or 1, num or most or n
    least, most = max(1, min(n, least)), max(1, min(n, most))
    if least > most:
        raise ValueError("min_clusters must not exceed max_clusters")
    return (least if least == most else num), least, most


def min_size(n: int, most: int = 15) -> int:
    """A tenth of n, halves to even, from 1 to most."""
    return min(most, max(1, round(0.1 * n)))


def unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine distances; NaN for zero vectors."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None])


def cluster(x: np.ndarray, threshold: float, method: str = "centroid", least_size: int = 15, num: int | None = None, least: int | None = None, most: int | None = None, centroid_space: str = "normalised") -> np.ndarray:
    """Labels of vectors: linkage of unit vectors, a cut, a search for the wanted number
    of large clusters where the cut misses it, and small clusters given to the nearest
    large one."""
    n = len(x)
    num, least, most = bounds(n, num, least, most)
    if n == 1 or most < 2:
        return np.zeros(n, np.int64)
    small = min_size(n, least_size)
    y = unit(np.asarray(x, np.float64))
    z = linkage(y, method)
    labels = cut(z, threshold)

    def large(of: np.ndarray) -> np.ndarray:
        names, many = np.unique(of, return_counts=True)
        return names[many >= small]

    kept = large(labels)
    if len(kept) < least:
        num = least
    elif len(kept) > most:
        num = most
    if num is not None and len(kept) != num:
        steps = np.arange(n - 1, dtype=np.float64)
        # after each merge: one large cluster more, for each large one that it took one less
        was = np.concatenate([np.full(n, small <= 1), z[:, 3] >= small]).astype(np.int64)
        after = was[:n].sum() + np.cumsum(was[n:] - was[z[:, :2].astype(np.int64)].sum(1))
        best, best_many = n - 1, 1
        for i in np.argsort(np.abs(z[:, 2] - threshold), kind="stable"):
            if z[i, 3] < small:
                continue
            many = int(after[i])
            if abs(many - num) < abs(best_many - num):
                best, best_many = i, many
            if many == num:
                break
        labels = cut(z, best, steps)
        kept = large(labels)
    if not len(kept):
        return np.zeros(n, np.int64)
    rest = np.setdiff1d(labels, kept)
    if len(rest):
        space = y if centroid_space == "normalised" else np.asarray(x, np.float64)
        by = np.argsort(labels, kind="stable")
        starts = np.flatnonzero(np.diff(labels[by], prepend=-1))
        means = np.add.reduceat(space[by], starts, axis=0) / np.diff(starts, append=n)[:, None]
        target, step = np.arange(len(means)), max(1, STRIP // len(kept))
        for k in range(0, len(rest), step):
            target[rest[k : k + step]] = kept[np.nan_to_num(cosine(means[kept], means[rest[k : k + step]]), nan=np.inf).argmin(0)]
        labels = target[labels]
    return np.unique(labels, return_inverse=True)[1]


def best_matching(similarity: np.ndarray) -> np.ndarray:
    """For each row its column in the matching of greatest sum, -2 without one; NaN counts as the least."""
    s = np.where(np.isnan(similarity), np.nanmin(similarity) if not np.isnan(similarity).all() else 0, similarity)
    rows, columns = s.shape
    cost = -s if rows <= columns else -s.T
    held = _shortest_paths(cost)
    out = np.full(rows, -2, np.int64)
    if rows <= columns:
        out[:] = held
    else:
        out[held] = np.arange(columns)
    return out


def _shortest_paths(cost: np.ndarray) -> np.ndarray:
    """The column of each row in the assignment of least cost, no more rows than columns:
    rows are added one by one, each along the cheapest augmenting path by reduced costs."""
    n, m = cost.shape
    by_row, by_column = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        reach, before, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, j, base = row, -1, 0.0
        while True:
            through = base + cost[i] - by_row[i] - by_column
            closer = ~done & (through < reach)
            reach[closer], before[closer] = through[closer], j
            j = int(np.where(done, np.inf, reach).argmin())
            base = reach[j]
            if owner[j] < 0:
                break
            done[j] = True
            i = owner[j]
        by_row[row] += base
        by_row[owner[done]] += base - reach[done]
        by_column[done] -= base - reach[done]
        while True:
            last = before[j]
            if last < 0:
                owner[j] = row
                break
            owner[j] = owner[last]
            j = last
    out = np.empty(n, np.int64)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows, without a Python object for each element."""
    x, length = vectors.matrix(column)
    if len(x) and (length != x.shape[1]).any():
        return np.array(column.to_pylist(), np.float64)
    return x


def _spread(rows: DataFrame, group: str) -> DataFrame:
    """Groups in partitions that stay apart: their work grows with the square of their bytes, so small ones aren't put together."""
    spark = rows.sparkSession
    return rows.repartition(max(partitions(spark), 16 * spark.sparkContext.defaultParallelism), group)


def dendrogram(rows: DataFrame, group: str, order: str, vector: str, method: str = "centroid") -> DataFrame:
    """``group, k, l, r, dist, size`` of each group's merges, points in order of ``order``."""
    kind = dict(rows.dtypes)[group]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        z = linkage(_matrix(table.column(vector)), method)
        return pa.table([pa.repeat(table.column(group)[0], len(z)), pa.array(np.arange(len(z)), pa.int32()), pa.array(z[:, 0], pa.int32()), pa.array(z[:, 1], pa.int32()), pa.array(z[:, 2]), pa.array(z[:, 3], pa.int32())], names=[group, "k", "l", "r", "dist", "size"])

    return rows.select(group, order, vector).transform(_spread, group).groupBy(group).applyInArrow(run, f"{group} {kind}, k int, l int, r int, dist double, size int")


def flat_clusters(rows: DataFrame, group: str, order: str, vector: str, cutoff: float, method: str = "centroid") -> DataFrame:
    """``group, order, cluster`` by the cut alone."""
    kinds = dict(rows.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        labels = cut(linkage(_matrix(table.column(vector)), method), cutoff)
        return pa.table([table.column(group), table.column(order), pa.array(labels, pa.int32())], names=[group, order, "cluster"])

    return rows.select(group, order, vector).transform(_spread, group).groupBy(group).applyInArrow(run, f"{group} {kinds[group]}, {order} {kinds[order]}, cluster int")


def cluster_groups(rows: DataFrame, group: str, order: list[str], vector: str, **options) -> DataFrame:
    """``group, order..., cluster`` by ``cluster`` within each group.

    Linkage is sequential, so a group (a recording) is one task; groups run in parallel.
    """
    kinds = dict(rows.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        labels = cluster(_matrix(table.column(vector)), **options)
        return pa.table([table.column(group), *[table.column(c) for c in order], pa.array(labels, pa.int32())], names=[group, *order, "cluster"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in (group, *order)) + ", cluster int"
    return rows.select(group, *order, vector).transform(_spread, group).groupBy(group).applyInArrow(run, schema)


def constrained_assign(similar: DataFrame, keys: list[str], row: str, column: str, value: str) -> DataFrame:
    """``keys, row, cluster``: within each group rows and clusters are matched one to one
    for the greatest total similarity; rows left over get -2."""
    kinds = dict(similar.dtypes)

    def run(table: pa.Table) -> pa.Table:
        rows, i = np.unique(table.column(row).to_numpy(), return_inverse=True)
        names, j = np.unique(table.column(column).to_numpy(), return_inverse=True)
        s = np.full((len(rows), len(names)), np.nan)
        s[i, j] = table.column(value).to_numpy()
        got = best_matching(s)
        label = np.where(got >= 0, names[np.maximum(got, 0)], -2)
        keyed = [pa.array(table.column(k).slice(0, 1).to_pylist() * len(rows), table.schema.field(k).type) for k in keys]
        return pa.table([*keyed, pa.array(rows, table.schema.field(row).type), pa.array(label, pa.int32())], names=[*keys, row, "cluster"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, row)) + ", cluster int"
    return similar.where(F.col(row).isNotNull()).select(*keys, row, column, value).groupBy(*keys).applyInArrow(run, schema)
