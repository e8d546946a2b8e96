"""A hierarchical Pitman-Yor bigram model of the corpus, and each document's perplexity.

The vocabulary is that of the corpus: a first scan gathers the 64-bit hashes of its
words, and a word's id is its rank among them, so no two share one (save for equal
64-bit hashes) and all vectors by word grow with it.  The word before is the context; every
context is a restaurant whose parent, shared by all, is the root restaurant, and the
root's parent is uniform over 2**20 words, or all of them if there are more.  A customer at
a new table of a context is a customer of the root.

The seating is sampled by blocked Gibbs steps, each from its exact conditional.  A draw of
the root's distribution and of one positive number x for each context (of a gamma law of
theta / d plus the context's tables: it turns the product of the weights of new tables into
a power) makes the tables of all dishes of all contexts independent: t tables of a dish of c
customers have the weight S_d(c, t) * (d * x * root)**t with a generalised Stirling number.
Their sums are the root's customers; given these its tables are drawn by the same rule,
then its x, then its distribution, as normalised sums of gamma and tempered stable numbers.
The draw of a type depends on the type, the round and the seed alone, so whoever needs its
tables, in any partition or subset, draws the same.  The first rounds are burn-in; the
predictive probabilities of the others are averaged.

What is gathered from the corpus are all its bigram types with their counts: they
are packed, sorted and shuffled by type.  For scoring the bigrams of all documents are
sent to the same partitions, except for those types so frequent that one of them would
weigh on a partition; these few are broadcast with their probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import cluster
from tidemark.llm import textops as T
from tidemark.llm.arrow import lean, lean_group, release, small_batches
from tidemark.llm.ngram_jaccard import order

U64 = np.uint64
BITS = 20  # of an id where there is no vocabulary
WORDS = 1 << BITS
FLUSH = 1 << 20
EXACT = 256  # customers up to which the conditional is tabulated
NODES, REACH = 40, 5.0  # of the integral beyond
SLICE = 1 << 14
SEATED = 1 << 15  # dishes of the root that are seated in one piece
SCORED = 1 << 19  # bigrams of a partition that are scored at once

_ROW = "part int, kind int, payload binary"
_ROW_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_prob", pa.float64())])
_STIRLING: dict[float, np.ndarray] = {}


def stirling(d: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers S_d(c, t): ways, weighted, to seat c customers at t tables."""
    if d not in _STIRLING:
        s = np.full((EXACT + 1, EXACT + 1), -np.inf)
        s[0, 0] = 0
        for c in range(1, EXACT + 1):
            t = np.arange(1, c + 1)
            with np.errstate(divide="ignore"):
                s[c, 1 : c + 1] = np.logaddexp(s[c - 1, :c], np.log(np.maximum(c - 1 - t * d, 0)) + s[c - 1, 1 : c + 1])
        _STIRLING[d] = s
    return _STIRLING[d]


def log_weight(t: np.ndarray, c: np.ndarray, log_g: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The log of S_d(c, t) * (d * g)**t for real t, up to a constant of the other
    arguments, and its first two derivatives by t.

    S_d(c, t) is c! / (t! d**t) times the coefficient of z**c in (1 - (1 - z)**d)**t.  That is
    integrated along a parabola around the cut z > 1, with w = 1 - z, which crosses the real
    axis at the saddle point, or where it decays as 4 / c if that is farther.
    """
    x = np.log(np.minimum(4 / c, 0.5))
    low, high = np.full(len(c), -700.0), np.full(len(c), -1e-9)
    for _ in range(30):  # the saddle point by bisection of log w
        x = (low + high) / 2
        w = np.exp(x)
        left = -np.expm1(x) * d * w ** (d - 1) * t > -np.expm1(d * x) * c
        low, high = np.where(left, x, low), np.where(left, high, x)
    w0 = np.maximum(np.exp(x), 4 / c)
    curve = 2 * np.sqrt(w0 * (c * w0 / (1 - np.minimum(w0, 1 - 1e-9)) + 1)) / np.sqrt(w0)
    u = np.sinh((np.arange(NODES) + 0.5) * (REACH / NODES)) / curve[:, None]
    step = np.cosh((np.arange(NODES) + 0.5) * (REACH / NODES)) / curve[:, None]
    root = 1 + 1j * u
    power = w0[:, None] * root**2
    f = np.log(1 - power**d)
    g = f * t[:, None] - (c[:, None] + 1) * np.log(1 - power)
    top = g.real.max(1)
    term = np.exp(g - top[:, None]) * root * step * w0[:, None]
    total = term.real.sum(1)
    mean = (term * f).real.sum(1) / total
    square = (term * f * f).real.sum(1) / total
    # one customer a table: the coefficient is d**c
    inner = np.where(t > c - 0.01, c * np.log(d) - np.log(2 / np.pi * REACH / NODES), np.log(np.maximum(total, 1e-300)) + top)
    return inner - _gammaln(t + 1) + t * log_g, mean - _digamma(t + 1) + log_g, square - mean**2 - 1 / (t + 0.5)


def _gammaln(x: np.ndarray) -> np.ndarray:
    """By Stirling's series above 8."""
    up = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - up


def _digamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    return np.log(y) - 0.5 / y - 1 / (12 * y**2) + 1 / (120 * y**4) - sum(1 / (x + k) for k in range(8))


class Keyed:
    """Uniform numbers that depend on a key, the place in a sequence and a salt alone."""

    def __init__(self, key: np.ndarray, *salt: int):
        base = np.zeros(1, U64)
        for x in salt:
            base = T.mix(base + U64(x + 1))
        self.key = T.mix(key ^ base)

    def __call__(self, at, number: int) -> np.ndarray:
        h = T.mix(self.key[at] + U64((number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        return ((h >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _seat_many(c: np.ndarray, log_g: np.ndarray, d: float, uniform: Keyed, which: np.ndarray) -> np.ndarray:
    """Draws of the conditional by rejection: it is log-concave, so that it lies under its
    greatest value around the mode and under exponentials, through two of its points, beyond."""
    low, high = np.ones(len(c)), c - 1
    mode = np.clip(d * np.exp(np.minimum(log_g, 500)) * np.log(c) + 2, low, high)
    open_ = np.arange(len(c))
    for _ in range(60):  # each until it is near its own mode, whatever it is drawn with
        at = mode[open_]
        value, slope, bend = log_weight(at, c[open_], log_g[open_], d)
        low[open_], high[open_] = np.where(slope > 0, at, low[open_]), np.where(slope > 0, high[open_], at)
        step = np.where(bend < 0, at - slope / np.minimum(bend, -1e-300), np.nan)
        after = np.where((step >= low[open_]) & (step <= high[open_]), step, (low[open_] + high[open_]) / 2)
        near = np.abs(after - at) < 0.01 / np.sqrt(np.maximum(-bend, 1e-3))
        mode[open_] = np.where(near, at, after)
        open_ = open_[~near]
        if not len(open_):
            break
    ends = log_weight(c, c, log_g, d)[0] > log_weight(c - 1, c, log_g, d)[0]
    mode = np.where(ends, c, mode)
    value, slope, bend = log_weight(mode, c, log_g, d)
    wide = np.maximum(1.5, 1.5 / np.sqrt(np.maximum(-bend, 1e-12)))
    wide = np.minimum(wide, np.maximum(1.5, 1.5 / np.maximum(np.abs(slope), 1e-9)))
    left, right = np.maximum(mode - wide, 1), np.minimum(mode + wide, c)
    first, last = np.ceil(left), np.floor(right)
    fall = [np.maximum((value - log_weight(x, c, log_g, d)[0]) / np.maximum(np.abs(x - mode), 1e-9), 1e-9) for x in (left, right)]
    mass = np.stack([
        np.where(first > 1, np.exp(-fall[0] * (mode - first + 1)) / -np.expm1(-fall[0]), 0),
        last - first + 1,
        np.where(last < c, np.exp(-fall[1] * (last + 1 - mode)) / -np.expm1(-fall[1]), 0),
    ])
    upto = np.cumsum(mass, 0)
    t, open_, number = np.zeros(len(c), np.int64), np.arange(len(c)), 0
    while len(open_):
        o = open_
        at = uniform(which[o], number) * upto[2, o]
        side = (at >= upto[0, o]).astype(int) + (at >= upto[1, o])
        away = np.where(side == 0, fall[0][o], fall[1][o])
        jump = np.floor(-np.log(uniform(which[o], number + 1)) / away)
        got = np.choose(side, [first[o] - 1 - jump, first[o] + np.floor(at - upto[0, o]), last[o] + 1 + jump])
        over = np.choose(side, [-fall[0][o] * (mode[o] - got), np.zeros(len(o)), -fall[1][o] * (got - mode[o])])
        inside = (got >= 1) & (got <= c[o])
        here = log_weight(np.clip(got, 1, c[o]), c[o], log_g[o], d)[0]
        taken = inside & (np.log(uniform(which[o], number + 2)) < here - value[o] - over)
        t[o[taken]] = got[taken].astype(np.int64)
        open_ = o[~taken]
        number += 3
    return t


def seat(c: np.ndarray, g: np.ndarray, d: float, uniform: Keyed) -> np.ndarray:
    """Draws the tables of each dish, with weights S_d(c, t) * (d * g)**t.

    c: its customers; g: its probability in the parent times its restaurant's x.  Up to
    EXACT customers the weights are tabulated, beyond they are integrated; both are the
    same conditional.
    """
    t = np.ones(len(c), np.int64)
    log_g = np.log(np.maximum(g, 1e-300))
    by = np.argsort(c, kind="stable")
    sizes = c[by]
    logs = stirling(d)
    start = int(np.searchsorted(sizes, 2))
    while start < len(by):
        n = int(sizes[start])
        if n > EXACT:
            break
        end = int(np.searchsorted(sizes, n, "right"))
        for a in range(start, end, max(1, (1 << 19) // n)):
            own = by[a : min(end, a + max(1, (1 << 19) // n))]
            weight = (log_g[own] + np.log(d))[:, None] * np.arange(1, n + 1) + logs[n, 1 : n + 1]
            weight = np.exp(weight - weight.max(1, keepdims=True))
            upto = np.cumsum(weight, 1)
            t[own] = 1 + (upto < (uniform(own, 0) * upto[:, -1])[:, None]).sum(1).clip(max=n - 1)
        start = end
    big = np.flatnonzero(c > EXACT)
    for a in range(0, len(big), 1 << 13):
        own = big[a : a + (1 << 13)]
        t[own] = _seat_many(c[own].astype(np.float64), log_g[own], d, uniform, own)
    return t


def tempered_stable(tau: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Draws of the law of Laplace transform exp(-tau * ((1 + s)**d - 1)): stable numbers,
    each taken with probability exp(-itself), summed over pieces of tau of at most 1."""
    pieces = np.maximum(np.ceil(tau), 1).astype(np.int64)
    owner = np.repeat(np.arange(len(tau)), pieces)
    each = (tau / pieces)[owner]
    out, open_ = np.zeros(len(owner)), np.arange(len(owner))
    while len(open_):
        u = rng.random(len(open_)) * np.pi
        with np.errstate(over="ignore"):
            s = np.sin(d * u) / np.sin(u) ** (1 / d) * (np.sin((1 - d) * u) / rng.exponential(size=len(open_))) ** ((1 - d) / d) * each[open_] ** (1 / d)
        taken = rng.random(len(open_)) < np.exp(-s)
        out[open_[taken]] = s[taken]
        open_ = open_[~taken]
    return np.bincount(owner, out, len(tau))


def _place(h: np.ndarray) -> np.ndarray:
    return h % U64(WORDS - 1) + U64(1)


class Vocabulary:
    """Ids 1.. of the words of the corpus by rank; id 0 is a text's start."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.size = len(hashes) + 1
        self.bits = max(1, int(len(hashes)).bit_length())
        if self.bits > 32:
            raise ValueError("over 2**32 - 1 distinct words: a pair of ids does not fit in 64 bits")
        self.ids = np.empty(len(hashes), np.uint32)
        self.ids[np.lexsort((self.hashes, _place(self.hashes)))] = np.arange(1, self.size, dtype=np.uint32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        one, inverse = np.unique(h, return_inverse=True)
        return self.ids[np.searchsorted(self.hashes, one)].astype(U64)[inverse]


def _keys(column: pa.Array, vocabulary: Vocabulary | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The bigram of each word (context above, word below; context 0 at a text's start), and offsets.

    Without a vocabulary an id is the word's place among 2**20, which words may share.
    """
    h, at = T.words(column)
    word = _place(h) if vocabulary is None else vocabulary(h)
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[at[:-1][np.diff(at) > 0]] = 0
    return context << U64(BITS if vocabulary is None else vocabulary.bits) | word, at


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return (((T.mix(key) >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)


def _split(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and words of keys."""
    return (key >> U64(bits)).astype(np.int64), (key & U64((1 << bits) - 1)).astype(np.int64)


def _by_part(key: np.ndarray, parts: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Partitions, sorted, and the indices that sort keys so; keys of one partition are
    sorted too, as far as both fit in 64 bits."""
    part, room = _part(key, parts), 64 - int(parts).bit_length()
    drop = max(0, 2 * bits - room)
    at = _sorted(part.astype(U64) << U64(2 * bits - drop) | key >> U64(drop), 2 * bits - drop + int(parts).bit_length())
    return part[at], at


def _word_scan(parts: int):
    """Texts to the distinct hashes of their words."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.unique(np.concatenate(held))
        part = (((h >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)
        cuts = _cuts(part)
        return _table([(int(part[s]), 0, T.pack(h[s:e])) for s, e in zip(cuts[:-1], cuts[1:])]).combine_chunks().to_batches()[0]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for piece in T.chunks(batch, "text"):
                held.append(np.unique(T.words(piece.column("text"))[0]))
                n += len(held[-1])
                if n >= FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return scan


def _distinct(table: pa.Table) -> pa.Table:
    h = np.unique(np.concatenate([T.unpack(x.as_py())[0] for x in table.column("payload")]))
    return _table([(table.column("part")[0].as_py(), 0, T.pack(h))])


def _cuts(part: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)


def _small(n: np.ndarray) -> np.ndarray:
    return n.astype(np.uint8 if n.max(initial=0) < 256 else np.uint32 if n.max(initial=0) < 1 << 32 else U64)


def _sorted(key: np.ndarray, bits: int) -> np.ndarray:
    """Indices that sort keys of so many bits; exact while bits and index fit in 64 bits, else in their high bits."""
    index = max(1, int(len(key) - 1).bit_length())
    drop = max(0, bits + index - 64)
    packed = (key >> U64(drop)) << U64(index) | np.arange(len(key), dtype=U64)
    packed.sort()
    return (packed & U64((1 << index) - 1)).astype(np.int64)


def _vectors(size: int, *named: tuple[int, np.ndarray, np.ndarray]) -> list[tuple[int, int, bytes]]:
    """Sparse counts by id (kind, ids, counts) as rows of slices of the vocabulary."""
    out = []
    for kind, ids, n in named:
        total = np.bincount(ids.astype(np.int64), n, size)
        held = np.flatnonzero(total)
        cuts = _cuts(held // SLICE)
        out += [(int(held[s] // SLICE), kind, T.pack((held[s:e] % SLICE).astype(np.uint16), _small(total[held[s:e]].astype(np.int64)))) for s, e in zip(cuts[:-1], cuts[1:])]
    return out


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    part, kind, payload = zip(*rows) if rows else ((), (), ())
    return pa.table([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], schema=_ROW_ARROW)


def _type_scan(parts: int, vocabulary):
    """Texts to packed bigram types with counts."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        part = _part(key, parts)
        at = np.argsort(part, kind="stable")
        part, key, n = part[at], key[at], n[at]
        cuts = _cuts(part)
        rows = [(int(part[s]), 0, T.pack(key[s:e], _small(n[s:e]))) for s, e in zip(cuts[:-1], cuts[1:])]
        return _table(rows).to_batches()[0]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for piece in T.chunks(batch, "text"):
                held.append(_keys(piece.column("text"), vocabulary.value)[0])
                n += len(held[-1])
                if n >= FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return scan


def _types(size: int, bits: int):
    def types(table: pa.Table) -> pa.Table:
        return _types_of(table, size, bits)

    return types


def _types_of(table: pa.Table, size: int, bits: int) -> pa.Table:
    """A partition's types: kind 0 the keys and counts of those of two customers or more;
    1 and 2 the customers and types by context, 3 the types by word, as vectors."""
    got = [T.unpack(x.as_py()) for x in table.column("payload")]
    key = np.concatenate([x[0] for x in got])
    n = np.concatenate([x[1].astype(np.int64) for x in got])
    del got
    at = order(key)
    key, n = key[at], n[at]
    cuts = _cuts(key)
    key, n = key[cuts[:-1]], np.add.reduceat(n, cuts[:-1])
    (context, word), many = _split(key, bits), n > 1
    part = table.column("part")[0].as_py()
    one = np.ones(len(key))
    rows = [(part, 0, T.pack(key[many], n[many]))] if many.any() else []
    return _table(rows + _vectors(size, (1, context, n), (2, context, one), (3, word, one)))


def _sum(table: pa.Table) -> pa.Table:
    total = np.zeros(SLICE, np.int64)
    for x in table.column("payload"):
        at, n = T.unpack(x.as_py())
        total[at] += n.astype(np.int64)
    return _table([(table.column("part")[0].as_py(), table.column("kind")[0].as_py(), T.pack(_small(total)))])


def _collect(rows: DataFrame, size: int) -> dict[int, np.ndarray]:
    """The summed vectors by kind; their size is that of the vocabulary."""
    out: dict[int, np.ndarray] = {}
    for r in rows.groupBy("part", "kind").applyInArrow(lean_group(_sum), _ROW).collect():
        out.setdefault(r.kind, np.zeros(-(-size // SLICE) * SLICE, np.int64))[r.part * SLICE : (r.part + 1) * SLICE] = T.unpack(bytes(r.payload))[0]
    return {kind: x[:size] for kind, x in out.items()}


def _seated(g: float, d: float, seed: int, number: int):
    """Words and their customers to the tables of the root's dishes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in zip(batch.column("part").to_pylist(), batch.column("payload")):
                word, n = T.unpack(x.as_py())
                t = seat(n.astype(np.int64), np.full(len(n), g), d, Keyed(word.astype(U64), seed, 2, number))
                yield from _table([(part, 0, T.pack(word, _small(t)))]).to_batches()

    return run


class Root:
    """The root restaurant: its tables, x and distribution, one step a round."""

    def __init__(self, d: float, theta: float, seed: int, spark: SparkSession | None = None):
        self.d, self.theta, self.seed, self.x, self.number, self.spark = d, theta, seed, None, 0, spark

    def seated(self, word: np.ndarray, n: np.ndarray, g: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The tables of words of two customers or more, in pieces: many words are drawn
        in the executors, and the same as here, since a draw depends on its word alone."""
        kernel = _seated(g, self.d, self.seed, self.number)
        pieces = max(1, -(-len(word) // SEATED))
        if self.spark is not None and pieces > 1:
            pieces = max(pieces, 4 * self.spark.sparkContext.defaultParallelism)
        # every so many-th word, for the frequent ones weigh most
        rows = _table([(k, 0, T.pack(word[k::pieces], n[k::pieces])) for k in range(pieces)])
        if self.spark is None or pieces == 1:
            for batch in kernel(iter(rows.to_batches(1))):
                yield from (T.unpack(x.as_py()) for x in batch.column("payload"))
        else:
            made = self.spark.createDataFrame([(r["part"], r["kind"], r["payload"]) for r in rows.to_pylist()], _ROW).repartition(pieces, "part")
            yield from (T.unpack(bytes(r.payload)) for r in made.mapInArrow(lean(kernel), _ROW).collect())

    def step(self, customers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Given its customers: each word's predictive probability by the new seating, and a draw of the distribution."""
        d, theta, size = self.d, self.theta, len(customers)
        rng = np.random.default_rng([self.seed, 1, self.number])
        words, held, total = max(WORDS, size), int(np.count_nonzero(customers)), int(customers.sum())
        if self.x is None:
            self.x = theta / d + held
        # slice by slice: only vectors of small numbers are as long as the vocabulary
        t = np.zeros(size, np.uint32)
        for own in _slices(size):
            t[own] = customers[own] > 0
        several = np.flatnonzero(customers > 1).astype(np.uint32)
        for at, n in self.seated(several, customers[several], self.x / words):
            t[at] = n
        tables = int(t.sum())
        self.x = rng.standard_gamma(theta / d + tables)
        probability, drawn, mass = np.empty(size, np.float32), np.zeros(size, np.float32), 0.0
        for own in _slices(size):
            some = np.flatnonzero(t[own])
            left = customers[own][some].astype(np.int64) - d * t[own][some]
            probability[own] = (theta + d * tables) / (theta + total) / words
            probability[own][some] += left / (theta + total)
            got = rng.standard_gamma(left) + tempered_stable(np.full(len(some), self.x / words), d, rng)
            drawn[own][some] = got
            mass += got.sum()
        drawn /= np.float32(mass + tempered_stable(np.array([self.x * (1 - held / words)]), d, rng)[0])
        self.number += 1
        release()
        return probability, drawn


def _slices(size: int) -> list[slice]:
    return [slice(a, min(size, a + (SLICE << 3))) for a in range(0, size, SLICE << 3)]


def context_x(tables: np.ndarray, d: float, theta: float, seed: int, number: int) -> np.ndarray:
    """The x of each context, given its tables."""
    rng = np.random.default_rng([seed, 0, number])
    return np.concatenate([rng.standard_gamma(theta / d + tables[own].astype(np.float64)).astype(np.float32) for own in _slices(len(tables))])


def _draw(fields: tuple, key: np.ndarray, n: np.ndarray, d: float, seed: int, bits: int = BITS) -> np.ndarray:
    """Tables of types in a round (x by context, the root's distribution, the round); the same for a type whatever it is drawn with."""
    x, root, number = fields
    context, word = _split(key, bits)
    return seat(n, x[context].astype(np.float64) * root[word], d, Keyed(key, seed, 3, number))


def probabilities(samples: list[tuple], customers: np.ndarray, key: np.ndarray, n: np.ndarray, d: float, theta: float, seed: int, bits: int = BITS) -> np.ndarray:
    """The predictive probability of each type, averaged over samples: of each what its
    round drew from, and the tables by context and the root's probabilities after it."""
    context, word = _split(key, bits)
    many = np.flatnonzero(n > 1)
    total = np.zeros(len(key))
    for fields, tables, root in samples:
        t = np.ones(len(key), np.int64)
        t[many] = _draw(fields, key[many], n[many], d, seed, bits)
        total += (n - d * t + (theta + d * tables[context].astype(np.float64)) * root[word]) / (theta + customers[context].astype(np.float64))
    return total / len(samples)


def _score_scan(parts: int, hot, vocabulary):
    """Documents to packed bigrams by partition (kind 0), and the sums of the hot ones by document (kind 1)."""

    def flush(keys: list, docs: list, ids: list) -> pa.RecordBatch:
        key, doc, doc_id = np.concatenate(keys), np.concatenate(docs), np.concatenate(ids)
        known, logs = hot.value
        rows = []
        if len(known):
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = known[at] == key
            many = np.bincount(doc[hit], minlength=len(doc_id))
            rows += _by_doc(doc_id, many, np.bincount(doc[hit], logs[at[hit]], len(doc_id)), parts)
            key, doc = key[~hit], doc[~hit]
        part, at = _by_part(key, parts, vocabulary.value.bits)
        key, doc = key[at], doc[at]
        cuts = _cuts(part)
        for s, e in zip(cuts[:-1], cuts[1:]):
            here, index = np.unique(doc[s:e], return_inverse=True)
            rows.append((int(part[s]), 0, T.pack(key[s:e], index.astype(np.uint16 if len(here) <= 1 << 16 else np.uint32), doc_id[here])))
        return _table(rows).combine_chunks().to_batches()[0]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, ids, base, n = [], [], [], 0, 0
        for batch in batches:
            for piece in T.chunks(batch, "text"):
                key, at = _keys(piece.column("text"), vocabulary.value)
                keys.append(key)
                docs.append(T.owners(at) + base)
                ids.append(piece.column("doc_id").to_numpy())
                base, n = base + piece.num_rows, n + len(key)
                if n >= FLUSH // 2:
                    yield flush(keys, docs, ids)
                    keys, docs, ids, base, n = [], [], [], 0, 0
        if n:
            yield flush(keys, docs, ids)

    return scan


def _by_doc(doc_id: np.ndarray, n: np.ndarray, log_prob: np.ndarray, parts: int) -> list[tuple[int, int, bytes]]:
    """Sums by document, packed by the document's partition."""
    held = np.flatnonzero(n)
    doc_id, n, log_prob = doc_id[held], n[held], log_prob[held]
    part = (((T.mix(doc_id.view(U64)) >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)
    at = np.lexsort((doc_id, part))
    part, doc_id, n, log_prob = part[at], doc_id[at], n[at], log_prob[at]
    cuts = _cuts(part)
    return [(int(part[s]), 1, T.pack(doc_id[s:e], _small(n[s:e]), log_prob[s:e].astype(np.float32))) for s, e in zip(cuts[:-1], cuts[1:])]


def _turn(key: np.ndarray, bits: int, turns: int) -> np.ndarray:
    """When each bigram is scored, all of a type at once."""
    context, word = _split(key, bits)
    return ((context + word) % turns).astype(np.int32)


def _score(kept: list, customers, d: float, theta: float, parts: int, seed: int, bits: int):
    """Bigrams of a partition of types to sums by document."""

    def score(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        passed = [(table.column("part")[i].as_py(), 1, table.column("payload")[i].as_py()) for i in np.flatnonzero(kinds == 1).tolist()]
        got = [T.unpack(table.column("payload")[i].as_py()) for i in np.flatnonzero(kinds == 0).tolist()]
        if not got:
            return _table(passed)
        ids = np.concatenate([x[2] for x in got])
        base = np.cumsum([0] + [len(x[2]) for x in got])
        many, sums = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        turns = -(-sum(len(x[0]) for x in got) // SCORED)
        for turn in range(turns):
            inside = [np.flatnonzero(_turn(x[0], bits, turns) == turn) for x in got]
            key = np.concatenate([x[0][i] for x, i in zip(got, inside)])
            if not len(key):
                continue
            doc = np.concatenate([x[1][i].astype(np.int32) + np.int32(b) for x, i, b in zip(got, inside, base)])
            del inside
            at = order(key)
            key, doc = key[at], doc[at]
            del at
            cuts = _cuts(key)
            n = np.diff(cuts)
            logs = np.log(probabilities([x.value for x in kept], customers.value, key[cuts[:-1]], n, d, theta, seed, bits))
            sums += np.bincount(doc, np.repeat(logs, n), len(ids))
            many += np.bincount(doc, minlength=len(ids))
        return _table(passed + _by_doc(ids, many, sums, parts))

    return score


def _documents(table: pa.Table) -> pa.Table:
    got = [T.unpack(x.as_py()) for x in table.column("payload")]
    ids, inverse = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
    n = np.bincount(inverse, np.concatenate([x[1].astype(np.float64) for x in got]), len(ids))
    sums = np.bincount(inverse, np.concatenate([x[2].astype(np.float64) for x in got]), len(ids))
    return pa.Table.from_arrays([pa.array(ids), pa.array(n.astype(np.int64)), pa.array(sums)], schema=_OUT)


def perplexity(docs: DataFrame, d: float = 0.75, theta: float = 5.0, root_d: float = 0.5, root_theta: float = 10.0, burn_in: int = 2, samples: int = 3, seed: int = 3, parts: int | None = None) -> DataFrame:
    """``doc_id, n_words, log_prob, perplexity`` of every document that has a word,
    under the model sampled on all documents.

    ``log_prob`` is the sum of the natural logs of the averaged predictive
    probabilities; perplexity its exponential by word.  NULL, empty and wordless
    texts, and rows without a doc_id, have no row and count for nothing; rows that
    share a doc_id are scored as one document, and each counts in the model.  An
    empty table gives an empty result; texts are read whole, other columns not at all.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or cluster.partitions(spark)
    source = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashes = [T.unpack(bytes(r.payload))[0] for r in source.select("text").mapInArrow(lean(_word_scan(parts)), _ROW).groupBy("part").applyInArrow(lean_group(_distinct), _ROW).collect()]
    if not hashes:
        return spark.createDataFrame([], "doc_id bigint, n_words bigint, log_prob double, perplexity double")
    vocabulary = Vocabulary(np.concatenate(hashes))
    del hashes
    release()
    size, bits = vocabulary.size, vocabulary.bits
    vocabulary = spark.sparkContext.broadcast(vocabulary)
    found = cluster.written(spark, source.select("text").mapInArrow(lean(_type_scan(parts, vocabulary)), _ROW).groupBy("part").applyInArrow(lean_group(_types(size, bits)), _ROW), "types")
    sums = _collect(found.where("kind > 0"), size)
    least = max(2, -(-int(sums[1].sum()) // (8 * parts)))
    customers, types, dishes = sums.pop(1).astype(np.float32), _small(sums.pop(2)), _small(sums.pop(3))
    multiple = found.where("kind = 0")
    shared_customers = spark.sparkContext.broadcast(customers)
    del customers, sums
    release()

    root, kept, tables = Root(root_d, root_theta, seed, spark), [], types
    _, drawn = root.step(dishes)
    for number in range(burn_in + samples):
        fields = context_x(tables, d, theta, seed, number), drawn, number
        shared = spark.sparkContext.broadcast(fields)
        more = _collect(multiple.mapInArrow(lean(_round(shared, d, seed, size, bits)), _ROW), size)
        shared.destroy()
        tables, arrivals = (_small(x + more.pop(kind)) if kind in more else x for kind, x in ((1, types), (2, dishes)))
        probability, drawn = root.step(arrivals)
        if number >= burn_in:
            # the driver keeps none of them
            kept.append(spark.sparkContext.broadcast((fields, tables, probability)))
        del fields, more, probability

    # at most 8 * parts types have least or more customers
    hot = sorted((r.key, r.log_prob) for r in multiple.mapInArrow(lean(_frequent(least, kept, shared_customers, d, theta, seed, bits)), "key bigint, log_prob double").collect())
    key, logs = (np.array(x, k) for x, k in zip(zip(*hot), (np.int64, np.float64))) if hot else (np.zeros(0, np.int64), np.zeros(0))
    hot = key.view(U64), logs
    scan = _score_scan(parts, spark.sparkContext.broadcast(hot), vocabulary)
    scored = source.mapInArrow(lean(scan), _ROW).groupBy("part").applyInArrow(lean_group(_score(kept, shared_customers, d, theta, parts, seed, bits)), _ROW)
    rows = scored.groupBy("part").applyInArrow(_documents, "doc_id bigint, n_words bigint, log_prob double")
    return rows.withColumn("perplexity", F.exp(-F.col("log_prob") / F.col("n_words")))


def _round(shared, d: float, seed: int, size: int, bits: int):
    """The tables beyond one of each type, by context (kind 1) and word (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_context, by_word = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("payload"):
                key, n = T.unpack(x.as_py())
                t = _draw(shared.value, key, n, d, seed, bits) - 1
                context, word = _split(key, bits)
                by_context += np.bincount(context, t, size).astype(np.int64)
                by_word += np.bincount(word, t, size).astype(np.int64)
        at, w = np.flatnonzero(by_context), np.flatnonzero(by_word)
        yield from _table(_vectors(size, (1, at, by_context[at]), (2, w, by_word[w]))).to_batches()

    return run


def _frequent(least: int, kept: list, customers, d: float, theta: float, seed: int, bits: int):
    """The types of least customers or more, with the logs of their probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("payload"):
                key, n = T.unpack(x.as_py())
                key, n = key[n >= least], n[n >= least]
                if len(key):
                    logs = np.log(probabilities([x.value for x in kept], customers.value, key, n, d, theta, seed, bits))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(logs)], names=["key", "log_prob"])

    return run
