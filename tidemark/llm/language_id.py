"""Language identification, words first.

A model of bounded size is counted on a bounded sample of documents of each
language: log frequencies of known words and of character n-grams of orders 4 to
1, words padded by a space on both sides.  Every word of every document is
scored: a known word by its log frequency in each language, an unseen one by the
mean over its longest n-grams that are known, order by order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import cluster
from tidemark.llm import textops as T
from tidemark.llm.arrow import HIDDEN, lean_group, small_batches, with_columns

ORDERS = (4, 3, 2, 1)
_COUNTS = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each order the keys of the character n-grams of the words, and the word of each."""
    length = ends - starts
    n = len(starts)
    out = np.full(int(length.sum()) + n + 1, 32, np.uint8)
    begin = np.arange(n) + np.concatenate([[0], np.cumsum(length)[:-1]]) + 1 if n else np.zeros(0, np.int64)
    out[T.ragged(begin, length)] = data[T.ragged(starts, length)]
    points = np.frombuffer(out.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = points == 32
    word = np.cumsum(space) - 1
    result = {}
    for k in ORDERS:
        m = len(points) - k + 1
        if m <= 0:
            result[k] = np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        ok = np.ones(m, bool)
        for j in range(1, k - 1):
            ok &= ~space[j : j + m]
        if k == 1:
            ok = ~space[:m]
        elif k == 2:
            ok = ~(space[:m] & space[1 : 1 + m])
        h = np.zeros(m, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + points[j : j + m] + np.uint64(1)
        at = np.flatnonzero(ok)
        result[k] = T.mix(h[at]).view(np.int64), np.minimum(word[at], n - 1)
    return result


def _count(min_count: int):
    def count(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        keys: dict[int, list[np.ndarray]] = {}
        for batch in table.combine_chunks().to_batches():
            for piece in T.chunks(batch, "text"):
                data, offsets = T.utf8(T.lower(piece.column("text")))
                starts, ends, _ = T.runs(T.WORD[data], offsets)
                if not len(starts):
                    continue
                keys.setdefault(0, []).append(T.span_hash(data, starts, ends).view(np.int64))
                for k, (g, _) in _grams(data, starts, ends).items():
                    keys.setdefault(k, []).append(g)
        out = []
        for kind, parts in keys.items():
            key, n = np.unique(np.concatenate(parts), return_counts=True)
            if kind == 0:
                key, n = key[n >= min_count], n[n >= min_count]
            out.append(pa.table([pa.array([lang] * len(key), pa.string()), pa.array(np.full(len(key), kind), pa.int32()), pa.array(key), pa.array(n)], schema=_COUNTS))
        return pa.concat_tables(out) if out else _COUNTS.empty_table()

    return count


@dataclass
class Model:
    """Languages; for words (0) and each order, sorted keys and their log frequencies by language."""

    languages: list[str]
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    logs: dict[int, np.ndarray] = field(default_factory=dict)

    def look(self, kind: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and where."""
        own = self.keys.get(kind, np.zeros(0, np.int64))
        if not len(own):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(own, key), len(own) - 1)
        return own[at] == key, at

    def word_scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log scores of each distinct word, and the distinct word of each word."""
        h = T.span_hash(data, starts, ends).view(np.int64)
        key, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        scores = np.zeros((len(key), len(self.languages)), np.float64)
        hit, at = self.look(0, key)
        if hit.any():
            scores[hit] = self.logs[0][at[hit]]
        left = np.flatnonzero(~hit)
        if len(left):
            found = _grams(data, starts[first[left]], ends[first[left]])
            todo = np.ones(len(left), bool)
            for k in ORDERS:
                g, word = found[k]
                open_ = todo[word] if len(word) else np.zeros(0, bool)
                g, word = g[open_], word[open_]
                hit, at = self.look(k, g)
                if not hit.any():
                    continue
                word, logs = word[hit], self.logs[k][at[hit]]
                many = np.bincount(word, minlength=len(left))
                total = np.stack([np.bincount(word, logs[:, j], len(left)) for j in range(logs.shape[1])], 1)
                done = many > 0
                scores[left[done]] = total[done] / many[done, None]
                todo &= ~done
                if not todo.any():
                    break
        return scores, inverse


def train(docs: DataFrame, per_language: int = 500, min_count: int = 3, smoothing: float = 0.5) -> Model:
    """Counts a model on ``per_language`` documents of each language at most, those
    of least hash, all rows of them.  A word is known from ``min_count`` occurrences
    in a language on; character n-grams always are.  The bound holds the model's size
    whatever the corpus holds."""
    spark = docs.sparkSession
    small_batches(spark)
    named = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("id is not null and lang is not null and text is not null")
    # one scan for all languages; each task ranks its own before the shuffle
    rank = F.dense_rank().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    sample = cluster.written(spark, named.select("id", "lang").withColumn("rank", rank).where(F.col("rank") <= per_language).select("id", "lang").distinct(), "sample")
    languages = sorted(r[0] for r in sample.select("lang").distinct().collect())
    model = Model(languages)
    if not languages:
        return model
    # at most per_language rows of two short columns for each language, in a table whose size Spark knows
    texts = named.join(sample, ["id", "lang"]).select("lang", "text")
    counts = texts.groupBy("lang").applyInArrow(lean_group(_count(min_count)), "lang string, kind int, key bigint, n bigint").toArrow()
    lang = np.searchsorted(np.array(languages), np.array(counts.column("lang").to_pylist(), dtype=str)) if counts.num_rows else np.zeros(0, np.int64)
    kind, key, n = (counts.column(c).to_numpy() for c in ("kind", "key", "n"))
    for k in (0, *ORDERS):
        own = kind == k
        keys, inverse = np.unique(key[own], return_inverse=True)
        table = np.zeros((len(keys), len(languages)))
        np.add.at(table, (inverse, lang[own]), n[own])
        model.keys[k] = keys
        model.logs[k] = np.log((table + smoothing) / (table.sum(0) + smoothing * max(1, len(keys))))
    return model


def identify_language(docs: DataFrame, per_language: int = 500, keep: list[str] | None = None, model: Model | None = None, min_count: int = 3) -> DataFrame:
    """Adds ``lang_id``, the best language, and ``lang_confidence``, its share among
    the languages by mean word score.

    The model is counted on ``per_language`` labelled documents of each language at
    most, and knows the words that occur ``min_count`` times there; ``model`` takes
    its place where one is given.  The languages are those of the column ``lang`` of
    the training sample; docs without that column have none.  A text
    that is NULL or has no word, or a model without languages, gives NULL for both;
    of equal scores the first language by name wins.  ``keep`` names the columns of
    docs to return, all by default; columns of the added names are replaced.
    Repeated rows are scored alike, an empty table stays empty, texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model or (train(docs, per_language, min_count) if "lang" in docs.columns else Model([]))))

    def score(piece: pa.RecordBatch) -> list[pa.Array]:
        m = Model(**shared.value)
        data, offsets = T.utf8(T.lower(piece.column(HIDDEN)))
        starts, ends, at = T.runs(T.WORD[data], offsets)
        many = np.diff(at)
        if not len(starts) or not m.languages:
            return [pa.nulls(piece.num_rows, pa.string()), pa.nulls(piece.num_rows, pa.float64())]
        scores, inverse = m.word_scores(data, starts, ends)
        doc = T.owners(at)
        mean = np.stack([np.bincount(doc, scores[inverse, j], len(many)) for j in range(len(m.languages))], 1) / np.maximum(many, 1)[:, None]
        best = mean.argmax(1)
        share = 1 / np.exp(mean - mean.max(1, keepdims=True)).sum(1)
        none = many == 0
        return [pa.array(np.array(m.languages, object)[best], pa.string(), mask=none), pa.array(share, mask=none)]

    return with_columns(docs, "lang_id string, lang_confidence double", score, keep)
