"""N-gram Jaccard join: all pairs of texts that share most of their word n-grams.

Texts are sets of word n-grams (``textops.ngrams``).  Texts with the same set
form a *class*; every class is joined once, under its signature.

1. *Frequencies.*  Each task sends its distinct (n-gram, class) postings, packed
   and sorted, to the partition of the n-gram.  There the number of classes that
   hold each n-gram is counted exactly; n-grams of a single class, which can
   match nothing, end here.
2. *Records.*  What is left goes back to the class.  Rare-first order puts the
   single n-grams first, so a class whose shared n-grams are fewer than the
   overlap that the threshold demands has its whole prefix single, and goes.
3. *Blocks.*  Classes whose n-grams have the same least hash, as near copies mostly
   do, form blocks of at most ``SIDE``.  A group of k near copies then has some
   (k / SIDE)**2 candidates in place of k**2.
4. *Candidates.*  Prefix n-grams are joined; length and positional filters act on
   every meeting of two blocks, and a pair of blocks leaves a partition once, then
   ``distinct`` once.
5. *Verification.*  Pairs of blocks are placed by their smallest neighbour, so records
   travel to few places; a suffix filter on hash ranges and then the exact overlap
   decide, once per pair of classes.  A place returns the pairs, each class's number
   of links, or as few edges as connect what the pairs connect.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import cluster
from tidemark.llm import textops as T
from tidemark.llm.arrow import lean, lean_batches, lean_group, lean_pair, small_batches

U64 = np.uint64
FLUSH = 1 << 20
BLOCK = 4096
SIDE, SIDE_GRAMS, DENSE, COLUMNS = 256, 1 << 20, 4096, 8192
RANGES = 16

_PACKED = "part int, kind int, payload binary"
_PACKED_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_RECORD = "sig bigint, doc_id bigint, docs array<bigint>, size int, singles int, key bigint, grams array<bigint>"
_RECORD_ARROW = pa.schema([("sig", pa.int64()), ("doc_id", pa.int64()), ("docs", pa.list_(pa.int64())), ("size", pa.int32()), ("singles", pa.int32()), ("key", pa.int64()), ("grams", pa.list_(pa.int64()))])
_PAIR_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_OUT_ARROW = pa.schema([("doc_a", pa.int64()), ("doc_b", pa.int64()), ("jaccard", pa.float64())])
_LINKS_ARROW = pa.schema([("class_id", pa.int64()), ("links", pa.int64())])


def order(values: np.ndarray) -> np.ndarray:
    """Indices that sort 64-bit values, equal ones by index.

    Sorting the values with their indices in the low bits is many times faster
    than an argsort; values that differ only in the bits lost to the index are
    put right afterwards.
    """
    n = len(values)
    if n < 2:
        return np.zeros(n, np.int64)
    low = values.min()
    bits, used = int(n - 1).bit_length(), int(values.max() - low).bit_length()
    key = (values - low) << U64(64 - used) if used < 64 else values - low
    mask = U64((1 << bits) - 1)
    key = (key & ~mask) | np.arange(n, dtype=U64)
    key.sort()
    at = (key & mask).astype(np.int64)
    got = values[at]
    if not np.all(got[1:] >= got[:-1]):
        at = at[np.argsort(got, kind="stable")]
    return at


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """The partition of a hash; grows with the hash."""
    return (((h >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)


def _borders(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]) if len(values) else np.zeros(1, np.int64)


def _rows(part: np.ndarray, kind: int, payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.full(len(part), kind), pa.int32()), pa.array(payloads, pa.binary())], schema=_PACKED_ARROW)


def _scan(n: int, parts: int):
    """Documents to packed postings (kind 0) and class rows (kind 1)."""

    def flush(grams: list, docs: list, ids: list) -> Iterator[pa.RecordBatch]:
        g, d, doc_id = np.concatenate(grams), np.concatenate(docs), np.concatenate(ids)
        at = order(g)
        g, d = g[at], d[at].astype(np.int32)
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        g, d = g[new], d[new]
        size = np.bincount(d, minlength=len(doc_id))
        m = T.mix(g)
        high, low = ((np.bincount(d, x.astype(np.float64), len(doc_id)).astype(np.int64).astype(U64)) for x in (m >> U64(32), m & U64(0xFFFFFFFF)))
        sig = T.mix(high * U64(0x9E3779B97F4A7C15) + low + size.astype(U64))
        del m
        held = np.flatnonzero(size)
        if not len(held):
            return
        known, first, inverse = np.unique(sig[held], return_index=True, return_inverse=True)
        local = np.full(len(doc_id), -1, np.int32)
        local[held[first]] = np.arange(len(known))
        d = local[d]
        g, d = g[d >= 0], d[d >= 0]
        p = _part(g, parts)
        cuts = _borders(p)
        payloads = []
        for s, e in zip(cuts[:-1], cuts[1:]):
            here, index = np.unique(d[s:e], return_inverse=True)
            payloads.append(T.pack(g[s:e], index.astype(np.uint16 if len(here) <= 1 << 16 else np.uint32), known[here]))
        yield _rows(p[cuts[:-1]], 0, payloads)
        by = np.argsort(inverse, kind="stable")
        s_, z_, i_ = known[inverse[by]], size[held][by].astype(np.int32), doc_id[held][by]
        p = _part(s_, parts)
        cuts = _borders(p)
        yield _rows(p[cuts[:-1]], 1, [T.pack(s_[s:e], z_[s:e], i_[s:e]) for s, e in zip(cuts[:-1], cuts[1:])])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, docs, ids, held, base, last = [], [], [], 0, 0, None
        for batch in batches:
            for piece in T.chunks(batch, "text"):
                own = piece.column("doc_id").to_numpy(zero_copy_only=False)
                # rows in a row of one doc_id are one document, which no flush cuts
                if held >= FLUSH and own[0] != last:
                    yield from flush(grams, docs, ids)
                    grams, docs, ids, held, base, last = [], [], [], 0, 0, None
                hashes, offsets = T.words(piece.column("text"))
                g, d = T.ngrams(hashes, offsets, n)
                new = np.concatenate([[last is None or own[0] != last], own[1:] != own[:-1]])
                number = np.cumsum(new) - 1 + base
                grams.append(g)
                docs.append(number[d])
                ids.append(own[new])
                base, held, last = int(number[-1]) + 1, held + len(g), own[-1]
        if held:
            yield from flush(grams, docs, ids)

    return scan


def _count(parts: int):
    """Postings of a partition of n-grams to those of n-grams in two classes or more."""

    def count(table: pa.Table) -> pa.Table:
        kinds, payloads = table.column("kind").to_numpy(), table.column("payload")
        out = [_rows(table.column("part").to_numpy()[kinds == 1], 1, payloads.filter(pa.array(kinds == 1)).to_pylist())]
        got = [T.unpack(x.as_py()) for x in payloads.filter(pa.array(kinds == 0))]
        if got:
            g = np.concatenate([x[0] for x in got])
            s = np.concatenate([x[2][x[1]] for x in got])
            del got
            at = order(g)
            g, s = g[at], s[at]
            same = np.zeros(len(g), bool)
            same[1:] = g[1:] == g[:-1]
            same[:-1] |= same[1:]
            g, s = g[same], s[same]
            at = np.lexsort((s, g))
            g, s = g[at], s[at]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
            g, s = g[new], s[new]
            cuts = _borders(g)
            df = np.repeat(np.diff(cuts), np.diff(cuts)).astype(np.int32)
            g, s, df = g[df > 1], s[df > 1], df[df > 1]
            at = order(s)
            g, s, df = g[at], s[at], df[at]
            p = _part(s, parts)
            cuts = _borders(p)
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                runs = _borders(s[a:b])
                rows.append(T.pack(s[a:b][runs[:-1]], np.diff(runs).astype(np.int32), g[a:b], df[a:b]))
            out.append(_rows(p[cuts[:-1]], 0, rows))
        return pa.Table.from_batches(out, _PACKED_ARROW)

    return count


def _needed(size: np.ndarray, t: Fraction) -> np.ndarray:
    """ceil(t * size)"""
    return -(-t.numerator * size.astype(np.int64) // t.denominator)


def _overlap(total: np.ndarray, t: Fraction) -> np.ndarray:
    """The least overlap of two sets of ``total`` n-grams together: ceil(t / (1 + t) * total)."""
    return -(-t.numerator * total.astype(np.int64) // (t.numerator + t.denominator))


def _records(t: Fraction):
    """What came back for a partition of classes to a row for each class that has
    several documents, or enough shared n-grams to be near another."""

    def records(table: pa.Table) -> pa.Table:
        kinds, payloads = table.column("kind").to_numpy(), table.column("payload").to_pylist()
        rows = [T.unpack(x) for x, k in zip(payloads, kinds) if k == 1]
        sig, size, ids = (np.concatenate([x[i] for x in rows]) for i in range(3)) if rows else (np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.int64))
        at = np.lexsort((ids, sig))
        sig, size, ids = sig[at], size[at], ids[at]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
        sig, size, ids = sig[new], size[new], ids[new]
        cuts = _borders(sig)
        first, many = cuts[:-1], np.diff(cuts)
        known, size, rep = sig[first], size[first].astype(np.int64), ids[first]

        got = [T.unpack(x) for x, k in zip(payloads, kinds) if k == 0]
        if got:
            where = np.searchsorted(known, np.repeat(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])))
            grams, df = np.concatenate([x[2] for x in got]), np.concatenate([x[3] for x in got])
        else:
            where, grams, df = np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int32)
        shared = np.bincount(where, minlength=len(known))
        near = shared >= np.maximum(_needed(size, t), 1)
        keep = near[where] if len(where) else np.zeros(0, bool)
        where, grams, df = where[keep], grams[keep], df[keep]
        at = np.lexsort((grams, df, where))
        where, grams = where[at], grams[at]
        out = np.flatnonzero(near | (many > 1))
        lists = np.concatenate([[0], np.cumsum(np.where(near, shared, 0)[out])])
        # the least hash of a class's shared n-grams, which near copies have in common more often than not
        key, full = known[out].copy(), np.diff(lists) > 0
        if full.any():
            key[full] = np.minimum.reduceat(T.mix(grams), lists[:-1][full])
        return pa.Table.from_arrays(
            [
                pa.array(known[out].view(np.int64)),
                pa.array(rep[out]),
                T.list_array(ids[T.ragged(first[out], many[out])], np.concatenate([[0], np.cumsum(many[out])])),
                pa.array(size[out], pa.int32()),
                pa.array((size - shared)[out], pa.int32()),
                pa.array(key.view(np.int64)),
                T.list_array(grams.view(np.int64), lists),
            ],
            schema=_RECORD_ARROW,
        )

    return records


def _prefixes(t: Fraction, parts: int):
    """Records to packed prefix postings: n-gram, block, size and position."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, size, singles = (batch.column(c).to_numpy().astype(np.int64) for c in ("block", "size", "singles"))
            lists = batch.column("grams")
            offsets, grams = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().view(U64)
            take = np.minimum(size - _needed(size, t) + 1 - singles, np.diff(offsets))
            at = T.ragged(offsets[:-1], take)
            row = np.repeat(np.arange(len(take)), take)
            position = (at - offsets[row] + singles[row] + 1).astype(np.int32)
            g = grams[at]
            by = order(g)
            g, row, position = g[by], row[by], position[by]
            p = _part(g, parts)
            cuts = _borders(p)
            payloads = []
            for s, e in zip(cuts[:-1], cuts[1:]):
                here, index = np.unique(row[s:e], return_inverse=True)
                payloads.append(T.pack(g[s:e], index.astype(np.uint32), position[s:e], block[here], size[here].astype(np.int32)))
            yield _rows(p[cuts[:-1]], 0, payloads)

    return prefixes


def _candidates(t: Fraction, limit: int = 1 << 20):
    """Prefix postings of a partition of n-grams to pairs of blocks that may hold a
    pair of near classes; a block is paired with itself where two of its classes meet."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [T.unpack(x.as_py()) for batch in batches for x in batch.column("payload")]
        g = np.concatenate([x[0] for x in got])
        s, z = (np.concatenate([x[k][x[1]] for x in got]) for k in (3, 4))
        j = np.concatenate([x[2] for x in got]).astype(np.int64)
        del got
        known, c = np.unique(s, return_inverse=True)
        z = z.astype(np.int64)
        at = np.lexsort((z, c, g))
        g, c, z, j = g[at], c[at], z[at], j[at]
        # what a block has at an n-gram: its least and greatest size, and the most that any of its classes has from here on
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(g))
        rest = np.maximum.reduceat(z - j, first)
        own = np.unique(c[first][last - first > 1])
        g, c, low, high = g[first], c[first], z[first], z[last - 1]
        at = np.lexsort((low, g))
        g, c, low, high, rest = g[at], c[at], low[at], high[at], rest[at]

        def made(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(known[pairs >> 32]), pa.array(known[pairs & 0xFFFFFFFF])], schema=_PAIR_ARROW)

        if len(own):
            yield made(own << 32 | own)
        cuts = _borders(g)
        end = np.repeat(cuts[1:], np.diff(cuts))
        active, found, held = np.arange(len(g)), [], 0
        for k in range(1, int(np.diff(cuts).max(initial=0))):
            # of the k-th next of each, whose least set is no smaller; beyond the length filter all later ones are too long
            active = active[active + k < end[active]]
            other = active + k
            fits = high[active] >= _needed(low[other], t)
            active, other = active[fits], other[fits]
            if not len(active):
                break
            enough = 1 + np.minimum(rest[active], rest[other]) >= _overlap(low[active] + low[other], t)
            a, b = c[active[enough]], c[other[enough]]
            found.append(np.minimum(a, b) << 32 | np.maximum(a, b))
            held += len(a)
            if held > limit:
                found = [np.unique(np.concatenate(found))]
                held = len(found[0])
                # what is still many goes out; should such a pair be found again, distinct drops it
                if held > limit // 2:
                    yield made(found[0])
                    found, held = [], 0
        if held:
            yield made(np.unique(np.concatenate(found)))

    return candidates


class _Place:
    """The records of some blocks, and the pairs of classes in pairs of blocks that reach the threshold."""

    def __init__(self, t: Fraction, records: pa.Table) -> None:
        self.t = t
        block = records.column("block").to_numpy()
        by = np.argsort(block, kind="stable")
        self.known, first = np.unique(block[by], return_index=True)
        self.first, self.last = first, np.append(first[1:], len(by))
        records = records.take(pa.array(by))
        self.size, self.rep, self.many = (records.column(c).to_numpy().astype(np.int64) for c in ("size", "doc_id", "many"))
        lists = records.column("grams").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        self.offsets = lists.offsets.to_numpy().astype(np.int64)
        grams = lists.values.to_numpy().view(U64)
        n = len(by)
        owner = np.repeat(np.arange(n), np.diff(self.offsets))
        self.spread = np.bincount(owner * RANGES + (grams[self.offsets[0] : self.offsets[-1]] >> U64(60)).astype(np.int64), minlength=n * RANGES).reshape(-1, RANGES).astype(np.int32)
        del owner
        self.dense = np.unique(grams, return_inverse=True)[1].astype(np.int32)
        self.mark = np.zeros(int(self.dense.max(initial=0)) + 1, np.int32)

    def near(self, pairs: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Both classes and the overlap of each pair, some pairs of blocks at a time."""
        a, b = (np.searchsorted(self.known, pairs.column(c).to_numpy()) for c in ("a", "b"))
        at = np.lexsort((b, a))
        a, b = a[at], b[at]
        many = (self.last - self.first)[a] * (self.last - self.first)[b]
        for x, y in zip(a[many >= DENSE], b[many >= DENSE]):
            yield from self._kept(*self._dense(int(x), int(y)))
        a, b, many = a[many < DENSE], b[many < DENSE], many[many < DENSE]
        part = (np.cumsum(many) - many) >> 18
        cuts = _borders(part)
        for s, e in zip(cuts[:-1], cuts[1:]):
            yield from self._kept(*self._single(a[s:e], b[s:e], many[s:e]))

    def _kept(self, a: np.ndarray, b: np.ndarray, overlap: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ok = (overlap >= _overlap(self.size[a] + self.size[b], self.t)) & (self.rep[a] != self.rep[b])
        if ok.any():
            yield a[ok], b[ok], overlap[ok]

    def _dense(self, x: int, y: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Overlaps of all pairs of two blocks, as products of their matrices of shared n-grams."""
        rows, grams = [], []
        for k in (x, y):
            s, e = self.first[k], self.last[k]
            rows.append(np.repeat(np.arange(e - s), np.diff(self.offsets[s : e + 1])))
            grams.append(self.dense[self.offsets[s] : self.offsets[e]])
        self.mark[grams[0]] = 1
        common = np.unique(grams[1][self.mark[grams[1]] > 0])
        self.mark[grams[0]] = 0
        self.mark[common] = np.arange(1, len(common) + 1)
        overlap = np.zeros((self.last[x] - self.first[x], self.last[y] - self.first[y]), np.float64)
        columns = [self.mark[g].astype(np.int64) - 1 for g in grams]
        self.mark[common] = 0
        for at in range(0, len(common), COLUMNS):
            sides = []
            for r, c, n in zip(rows, columns, overlap.shape):
                inside = (c >= at) & (c < at + COLUMNS)
                side = np.zeros((n, min(COLUMNS, len(common) - at)), np.float32)
                side[r[inside], c[inside] - at] = 1
                sides.append(side)
            overlap += sides[0] @ sides[1].T
        a, b = np.nonzero(overlap)
        if x == y:
            a, b = a[a < b], b[a < b]
        return a + self.first[x], b + self.first[y], overlap[a, b].astype(np.int64)

    def _single(self, a: np.ndarray, b: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Overlaps of the pairs in small blocks that pass the suffix filter: in no range
        of hashes can two sets share more than the smaller has."""
        inner = T.ragged(np.zeros(len(many), np.int64), many)
        width, same = np.repeat((self.last - self.first)[b], many), np.repeat(a == b, many)
        a, b = np.repeat(self.first[a], many) + inner // width, np.repeat(self.first[b], many) + inner % width
        need = _overlap(self.size[a] + self.size[b], self.t)
        length = np.diff(self.offsets)
        fits = (np.minimum(length[a], length[b]) >= need) & (~same | (a < b))
        a, b, need = a[fits], b[fits], need[fits]
        fits = np.zeros(len(a), bool)
        for s in range(0, len(a), 1 << 16):
            u, v = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
            fits[s : s + (1 << 16)] = np.minimum(self.spread[u], self.spread[v]).sum(1) >= need[s : s + (1 << 16)]
        a, b = a[fits], b[fits]
        at = np.lexsort((b, a))
        a, b = a[at], b[at]
        overlap, cuts = np.zeros(len(a), np.int64), _borders(a)
        for s, e in zip(cuts[:-1], cuts[1:]):
            own = self.dense[self.offsets[a[s]] : self.offsets[a[s] + 1]]
            self.mark[own] = 1
            for u in range(s, e, 256):
                other = b[u : min(e, u + 256)]
                lengths = length[other]
                sums = np.concatenate([[0], np.cumsum(self.mark[self.dense[T.ragged(self.offsets[other], lengths)]])])
                ends = np.cumsum(lengths)
                overlap[u : u + len(other)] = sums[ends] - sums[ends - lengths]
            self.mark[own] = 0
        return a, b, overlap


def _pairs(place: _Place, pairs: pa.Table) -> pa.Table:
    """Each pair and its similarity."""
    out = []
    for a, b, overlap in place.near(pairs):
        jaccard = overlap / (place.size[a] + place.size[b] - overlap)
        a, b = place.rep[a], place.rep[b]
        out.append(pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(jaccard)], schema=_OUT_ARROW))
    return pa.Table.from_batches(out, _OUT_ARROW)


def _links(place: _Place, pairs: pa.Table) -> pa.Table:
    """For each class, the documents of the classes near it."""
    links = np.zeros(len(place.rep), np.int64)
    for a, b, _ in place.near(pairs):
        np.add.at(links, a, place.many[b])
        np.add.at(links, b, place.many[a])
    some = np.flatnonzero(links)
    return pa.Table.from_arrays([pa.array(place.rep[some]), pa.array(links[some])], schema=_LINKS_ARROW)


def _edges(place: _Place, pairs: pa.Table) -> pa.Table:
    """One edge at most for each class, from which the same classes are connected as by all pairs."""
    root = np.arange(len(place.rep))
    for a, b, _ in place.near(pairs):
        while True:
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            apart = low < high
            if not apart.any():
                break
            np.minimum.at(root, high[apart], low[apart])
            while not np.array_equal(root, root[root]):
                root = root[root]
    some = np.flatnonzero(root != np.arange(len(root)))
    a, b = place.rep[some], place.rep[root[some]]
    return pa.Table.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_PAIR_ARROW)


def _verify(t: Fraction, made: Callable[[_Place, pa.Table], pa.Table], schema: pa.Schema):
    """Records and pairs of blocks of a place to what ``made`` makes of the near classes."""

    def verify(records: pa.Table, pairs: pa.Table) -> pa.Table:
        return made(_Place(t, records), pairs) if records.num_rows and pairs.num_rows else schema.empty_table()

    return verify


def _documents(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, all rows of one doc_id next to each other.

    Only ids are shuffled to find those that repeat; only their rows move.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    repeated = cluster.written(docs.sparkSession, source.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return source
    together = source.join(repeated, "doc_id", "left_semi").repartition("doc_id").sortWithinPartitions("doc_id", "text")
    return source.join(repeated, "doc_id", "left_anti").union(together)


def _joined(docs: DataFrame, n: int, threshold: float, parts: int | None, made: Callable, schema: pa.Schema, ddl: str) -> tuple[DataFrame, DataFrame]:
    """Records of the classes that have several documents or may be near another, and
    what ``made`` makes of the near classes of each place."""
    spark = docs.sparkSession
    parts = parts or 2 * cluster.partitions(spark)
    t = Fraction(str(threshold)).limit_denominator(10**9)
    if not 0 < t <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    small_batches(spark)
    source = _documents(docs)
    postings = source.mapInArrow(lean(_scan(n, parts)), _PACKED)
    shared = postings.groupBy("part").applyInArrow(lean_group(_count(parts)), _PACKED)
    classes = shared.groupBy("part").applyInArrow(lean_group(_records(t)), _RECORD)
    window = Window.partitionBy("key").orderBy("size", "sig").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    block = F.xxhash64("key", F.expr(f"(row_number() over (partition by key order by size, sig) - 1) div {SIDE}"), F.floor(F.sum(F.size("grams")).over(window) / SIDE_GRAMS))
    records = cluster.written(spark, classes.select("sig", "doc_id", "docs", "size", "singles", block.alias("block"), "grams"), "records")
    near = records.where("size(grams) > 0")
    prefixes = near.select("block", "size", "singles", "grams").mapInArrow(lean(_prefixes(t, parts)), _PACKED)
    pairs = cluster.written(spark, prefixes.groupBy("part").applyInArrow(lean_batches(_candidates(t)), "a bigint, b bigint").distinct(), "pairs")

    label = (
        pairs.union(pairs.select("b", "a")).groupBy(F.col("a").alias("block")).agg(F.least(F.first("a"), F.min("b")).alias("label"))
    )
    label = label.join(near.groupBy("block").agg(F.count(F.lit(1)).alias("classes")), "block")
    slices = label.groupBy("label").agg(F.ceil(F.sum("classes") / BLOCK).alias("slices"))
    slice_ = label.join(slices, "label").select("block", F.xxhash64("label", F.pmod(F.xxhash64("block"), "slices")).alias("slice"))
    placed = (
        pairs.join(slice_.select(F.col("block").alias("a"), F.col("slice").alias("slice_a")), "a")
        .join(slice_.select(F.col("block").alias("b"), F.col("slice").alias("slice_b")), "b")
        .select("a", "b", F.pmod(F.xxhash64(F.least("slice_a", "slice_b"), F.greatest("slice_a", "slice_b")), F.lit(parts)).alias("place"))
    )
    wanted = placed.select(F.col("place").alias("home"), F.explode(F.array("a", "b")).alias("block")).distinct()
    sent = wanted.join(near.select("block", "doc_id", F.size("docs").alias("many"), "size", "grams"), "block")
    return records, sent.groupBy("home").cogroup(placed.groupBy("place")).applyInArrow(lean_pair(_verify(t, made, schema)), ddl)


def ngram_jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.4, parts: int | None = None) -> DataFrame:
    """Pairs of documents whose word n-gram sets have a Jaccard similarity of ``threshold`` or more.

    Returns ``doc_a, doc_b, jaccard`` with ``doc_a < doc_b``.  Documents with the
    same n-gram set form a class, named by its smallest doc_id; a class of several
    documents gives a row (smallest, other, 1.0) for each other one, and two
    similar classes give one row for their smallest documents.  All pairs follow
    from these, in a size that copies of one text cannot make quadratic.

    A NULL, empty or wordless text has no n-gram and is in no pair; a text of
    fewer than n words has one n-gram, all its words.  Rows without a doc_id are
    left out; rows that share a doc_id are one document, whose n-grams are those of
    all its texts together, so repeated rows count once.  An empty table gives no
    row, and other columns are not read, whatever their names.  Texts of any length
    are read whole.
    """
    records, verified = _joined(docs, n, threshold, parts, _pairs, _OUT_ARROW, "doc_a bigint, doc_b bigint, jaccard double")
    copies = _members(records).where("doc_id <> class_id").select(F.col("class_id").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return copies.unionByName(verified)


def _members(records: DataFrame) -> DataFrame:
    """``class_id, doc_id, many`` of each document of the records' classes; many counts those of its class."""
    return records.select(F.col("doc_id").alias("class_id"), F.explode("docs").alias("doc_id"), F.size("docs").cast("bigint").alias("many"))


def ngram_jaccard_links(docs: DataFrame, n: int = 5, threshold: float = 0.4, parts: int | None = None) -> DataFrame:
    """One row for each doc_id: ``doc_id, class_id, links``.

    ``class_id`` is the smallest doc_id of those with the same n-gram set, and
    ``links`` the number of other documents whose similarity is ``threshold`` or more,
    those of the own class included: all pairs of documents are counted, though
    neither copies nor near copies make the rows more than the documents.

    Documents are those of ``ngram_jaccard_join``; one without an n-gram is alone
    in its class and has no link.
    """
    records, verified = _joined(docs, n, threshold, parts, _links, _LINKS_ARROW, "class_id bigint, links bigint")
    links = verified.groupBy("class_id").agg(F.sum("links").alias("links"))
    found = _members(records).join(links, "class_id", "left").select("doc_id", "class_id", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    return ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def ngram_jaccard_edges(docs: DataFrame, n: int = 5, threshold: float = 0.4, parts: int | None = None) -> DataFrame:
    """``doc_a, doc_b``: edges that connect the documents that the pairs of
    ``ngram_jaccard_join`` connect, no more than a few for each document."""
    records, verified = _joined(docs, n, threshold, parts, _edges, _PAIR_ARROW, "a bigint, b bigint")
    copies = _members(records).where("doc_id <> class_id").select(F.col("class_id").alias("doc_a"), F.col("doc_id").alias("doc_b"))
    return copies.union(verified)
