"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

Texts become hashed byte-trigram histograms (upper case, signs and spacing kept)
with one bin more for words that repeat the word before, log-scaled, weighted by inverse document frequency and projected on the leading
singular vectors of a bounded labelled sample.  The labelled vectors, a table of
fixed size, are broadcast; every document is compared with all of them by exact
blocked cosine products, and the labels of the nearest vote by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops as T
from tidemark.llm.arrow import HIDDEN, lean, small_batches, with_columns

BINS = 4096
FEATURES = BINS + 1
REPEAT_WEIGHT = 12
ROWS = 256


def histograms(column: pa.Array) -> np.ndarray:
    """Counts of hashed byte trigrams, and of repeated words, a row for each text."""
    data, offsets = T.utf8(column)
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES), np.float32)
    if len(data) < 3:
        return out
    x = data.astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    h *= np.uint32(0x27D4EB2F)
    h >>= np.uint32(20)
    length = np.maximum(np.diff(offsets) - 2, 0)
    at = T.ragged(offsets[:-1], length)
    key = h[at].astype(np.int64) + np.repeat(np.arange(n) * BINS, length)
    out[:, :BINS] = np.bincount(key, minlength=n * BINS).reshape(n, BINS)
    words, at = T.words(column)
    doc = T.owners(at)
    again = np.flatnonzero((words[1:] == words[:-1]) & (doc[1:] == doc[:-1]))
    out[:, BINS] = np.bincount(doc[again], minlength=n)
    return out


@dataclass
class Model:
    """Weights of the bins, projection, labelled unit vectors and their labels."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, counts: np.ndarray) -> np.ndarray:
        """Unit latent vectors; zero where a text has no trigram."""
        x = np.log1p(counts)
        x *= self.idf
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
        z = x @ self.basis
        return z / np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z)), 1e-12)[:, None]

    def vote(self, z: np.ndarray, neighbours: int) -> np.ndarray:
        """Similarity-weighted mean label of the nearest labelled vectors, as if both
        labels were equally frequent among all; NaN without any."""
        if not len(self.labels):
            return np.full(len(z), np.nan)
        good = self.labels > 0.5
        rarity = np.where(good, 0.5 / max(good.mean(), 1e-12), 0.5 / max(1 - good.mean(), 1e-12)) if 0 < good.sum() < len(good) else np.ones(len(good))
        similar = z @ self.vectors.T
        k = min(neighbours, len(self.labels))
        near = np.argpartition(-similar, k - 1, axis=1)[:, :k] if k < len(self.labels) else np.broadcast_to(np.arange(k), (len(z), k))
        weight = np.maximum(np.take_along_axis(similar, near, 1), 0).astype(np.float64) * rarity[near]
        total = weight.sum(1)
        return np.where(total > 0, (weight * self.labels[near]).sum(1) / np.where(total > 0, total, 1), np.nan)


def fit(counts: np.ndarray, labels: np.ndarray, dims: int = 64, seed: int = 7) -> Model:
    """Latent-semantic analysis of labelled histograms by randomized subspace iteration."""
    n = len(counts)
    idf = np.log((1 + n) / (1 + (counts > 0).sum(0))).astype(np.float32) + np.float32(1)
    idf[BINS] = REPEAT_WEIGHT
    x = np.log1p(counts) * idf
    x /= np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None]
    k = max(1, min(dims, n))
    q = np.random.default_rng(seed).standard_normal((FEATURES, k + 16)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q)) if n else (q, None)
    small = x @ q
    _, _, right = np.linalg.svd(small, full_matrices=False) if n else (None, None, np.eye(q.shape[1], dtype=np.float32))
    model = Model(idf, np.ascontiguousarray((q @ right.T)[:, :k], np.float32), np.zeros((0, k), np.float32), labels.astype(np.float64))
    model.vectors = model.embed(counts).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1024, dims: int = 64) -> Model:
    """A model of ``per_class`` labelled documents of each class at most, those of
    least hash; this bound is the only part of the classifier that doesn't read all rows."""
    small_batches(docs.sparkSession)
    known = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy(F.col("doc_id").cast("bigint").alias("id"))
        .agg(F.min("quality").cast("int").alias("label"))
    )
    wanted = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(per_class)
        wanted = part if wanted is None else wanted.union(part)
    # at most 2 * per_class pairs of numbers
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.chunks(batch, "text"):
                for at in range(0, piece.num_rows, ROWS):
                    part = piece.slice(at, ROWS)
                    rows = np.minimum(histograms(part.column("text")), 65535).astype(np.uint16)
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "label", "counts"])

    # one histogram of each sampled document comes to the driver, however many rows it has
    counted = texts.mapInArrow(lean(count), "id bigint, label int, counts binary")
    rows = sorted((r.id, r.label, bytes(r.counts)) for r in counted.groupBy("id").agg(F.min("label").alias("label"), F.max("counts").alias("counts")).collect() if any(r.counts))
    counts = np.array([np.frombuffer(c, np.uint16) for _, _, c in rows], np.float32).reshape(-1, FEATURES)
    return fit(counts, np.array([label for _, label, _ in rows], np.float64), dims)


def quality_votes(docs: DataFrame, labels: DataFrame, per_class: int = 1024, dims: int = 64, neighbours: int = 15, threshold: float = 0.35, keep: list[str] | None = None) -> DataFrame:
    """Adds ``quality_score``, the similarity-weighted share of good among the
    nearest labelled documents, and ``quality_keep``, whether it reaches the threshold.
    Where the sample lacks documents of one label, their votes weigh more in proportion.

    ``keep`` names the columns of docs to return, all by default; columns that
    already have the added names are replaced.  A NULL text, or one under three
    bytes, has no vector: its score is NULL and it is not kept.  Without any
    usable label every score is NULL and every text with a vector is kept.
    Labels that are NULL or not 0 or 1 don't count, conflicting labels of a
    document count as 0; of the texts that share a labelled doc_id one, that of the
    greatest histogram, is learnt from.  Repeated rows are scored alike, and an empty
    table stays empty.  Texts are read whole.  Only ``quality`` is learnt: whether a
    document is toxic plays no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(train(docs, labels, per_class, dims)))

    def score(piece: pa.RecordBatch) -> list[pa.Array]:
        model = Model(**shared.value)
        counts = histograms(piece.column(HIDDEN))
        votes = model.vote(model.embed(counts), neighbours)
        empty = counts[:, :BINS].sum(1) == 0
        votes = np.where(empty, np.nan, votes)
        good = ~empty & (np.isnan(votes) | (votes >= threshold))
        return [pa.array(votes, pa.float64(), from_pandas=True), pa.array(good)]

    return with_columns(docs, "quality_score double, quality_keep boolean", score, keep, rows=ROWS)
