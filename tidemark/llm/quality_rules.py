"""Quality rules: how far a document's characters and common words lie from its language.

The reference of a language is the sum of the histograms of all its documents: eight
character classes, and the language's most common words, counted over the whole
corpus, with one bin for all other words.  A document fails when the Jensen-Shannon distance (base 2, the square
root of the divergence) of either histogram exceeds its limit; short texts, whose
histograms say little, are not judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import cluster
from tidemark.llm import textops as T
from tidemark.llm.arrow import HIDDEN, fresh, lean, lean_group, small_batches, with_columns

TOP = 30
FLUSH = 1 << 20
CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "sign", "beyond")


def _class_table() -> np.ndarray:
    """The class of each byte; 8 for the bytes that continue a character."""
    table = np.full(256, 6, np.int64)
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r\f\v", ".,;:", "!?'\"()-")):
        table[[ord(c) for c in chars]] = k
    table[128:192] = 8
    table[192:] = 7
    return table


def word_hashes(listed: list[str]) -> np.ndarray:
    hashes, offsets = T.words(pa.array(listed))
    assert list(np.diff(offsets)) == [1] * len(listed)
    return hashes


def common_words(source: DataFrame, top: int) -> dict[str, np.ndarray]:
    """The hashes of the ``top`` words of most occurrences of each language, ties to the
    lesser hash, from ``lang, text``.

    All words are counted, in their tasks and then by range of the hash; the first of
    each range, and of them the first of the language, are exact.
    """
    parts = cluster.partitions(source.sparkSession)

    def flush(held: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
        rows = []
        for lang, hashes in held.items():
            h, n = np.unique(np.concatenate(hashes), return_counts=True)
            part = (((h >> T.U64(32)) * T.U64(parts)) >> T.U64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(h) else np.zeros(1, np.int64)
            rows += [(lang, int(part[s]), T.pack(h[s:e], n[s:e])) for s, e in zip(cuts[:-1], cuts[1:])]
        lang, part, payload = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(part, pa.int64()), pa.array(payload, pa.binary())], names=["lang", "part", "payload"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        n = 0
        for batch in batches:
            for piece in T.chunks(batch, "text"):
                hashes, offsets = T.words(piece.column("text"))
                names = np.array(piece.column("lang").to_pylist(), object)[T.owners(offsets)]
                for lang in set(names):
                    held.setdefault(lang, []).append(hashes[names == lang])
                n += len(hashes)
                if n >= FLUSH:
                    yield flush(held)
                    held, n = {}, 0
        if n:
            yield flush(held)

    def first(table: pa.Table) -> pa.Table:
        got = [T.unpack(x.as_py()) for x in table.column("payload")]
        h, inverse = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([x[1] for x in got]).astype(np.float64), len(h)).astype(np.int64)
        at = np.lexsort((h, -n))[:top]
        return pa.table([pa.array([table.column("lang")[0].as_py()] * len(at), pa.string()), pa.array(h[at].view(np.int64)), pa.array(n[at])], names=["lang", "word", "n"])

    counted = source.mapInArrow(lean(scan), "lang string, part bigint, payload binary").groupBy("lang", "part").applyInArrow(lean_group(first), "lang string, word bigint, n bigint")
    # the sign bit is turned, so that the order of numbers is that of hashes
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.col("word").bitwiseXOR(F.lit(-(1 << 63)))))
    out: dict[str, list[int]] = {}
    for r in counted.withColumn("rank", rank).where(F.col("rank") <= top).orderBy("lang", "rank").collect():
        out.setdefault(r.lang, []).append(r.word)
    return {lang: np.array(words, np.int64).view(np.uint64) for lang, words in out.items()}


def _source(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    return docs.where("text is not null").select(lang.alias("lang"), F.col("text").cast("string").alias("text"))


def histograms(column: pa.Array, langs: np.ndarray, common: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Character class counts, and counts of the common words of each text's language with all others last."""
    data, offsets = T.utf8(column)
    n = len(offsets) - 1
    classes = np.bincount(T.owners(offsets) * 9 + _class_table()[data], minlength=9 * n).reshape(n, 9)[:, :8]
    hashes, at = T.words(column)
    wide = max(map(len, common.values()), default=0)
    counts = np.zeros((n, wide + 1), np.int64)
    counts[:, wide] = np.diff(at)
    doc = T.owners(at)
    for lang in set(langs.tolist()) & set(common):
        own, known = langs == lang, common[lang]
        if not len(hashes) or not len(known):
            continue
        by = np.argsort(known)
        slot = np.minimum(np.searchsorted(known[by], hashes), len(known) - 1)
        hit = np.flatnonzero((known[by][slot] == hashes) & own[doc])
        found = np.bincount(doc[hit] * wide + by[slot[hit]], minlength=n * wide).reshape(n, wide)
        counts[:, :wide] += found
        counts[:, wide] -= found.sum(1)
    return classes, counts


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance by row of histograms; NaN where one is empty."""
    p, q = p.astype(np.float64), q.astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = p / p.sum(1, keepdims=True), q / q.sum(1, keepdims=True)
        m = (p + q) / 2
        part = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.maximum(part.sum(1) / 2, 0)) + np.where(np.isnan(p.sum(1) + q.sum(1)), np.nan, 0)


def references(docs: DataFrame, common: dict[str, np.ndarray]) -> DataFrame:
    """``lang, classes, words``: the summed histograms of all documents of each language."""
    source = _source(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        for batch in batches:
            for piece in T.chunks(batch, "text"):
                names = np.array(piece.column("lang").to_pylist(), object)
                both = np.concatenate(histograms(piece.column("text"), names, common), 1)
                for lang in set(names):
                    total[lang] = total.get(lang, 0) + both[names == lang].sum(0)
        for lang, row in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(row)), pa.array(range(len(row)), pa.int32()), pa.array(row)], names=["lang", "bin", "n"])

    bins = source.mapInArrow(lean(count), "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    rows = bins.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: x.n).alias("all"))
    return rows.select("lang", F.slice("all", 1, 8).alias("classes"), F.slice("all", 9, 1 + max(map(len, common.values()), default=0)).alias("words"))


def quality_divergence(
    docs: DataFrame, common: dict[str, list[str]] | None = None, max_chars: float = 0.25, max_words: float = 0.4, min_chars: int = 200, min_words: int = 40, keep: list[str] | None = None, top: int = TOP
) -> DataFrame:
    """Adds ``char_distance``, ``word_distance`` and ``rules_keep``.

    ``common`` lists the common words of each language; by default they are the
    ``top`` words of most occurrences among all documents of each.  A distance is NULL
    where a text has less than ``min_chars`` characters, or ``min_words`` words, or
    where its language has no common words; a NULL distance never fails a document.  A
    NULL or empty text is kept unjudged; documents without a language, or a table
    without that column, count as one language of their own.  ``keep`` names the
    columns of docs to return, all by default; columns of the added names are
    replaced.  Repeated rows count each time and are judged alike; an empty table
    stays empty; texts are read whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    common = common_words(_source(docs), top) if common is None else {lang: word_hashes(words) for lang, words in common.items()}
    own = F.coalesce(docs["lang"].cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    # written, so that its size is known and Spark broadcasts it or not by that
    of, c, w = fresh("of"), fresh("classes"), fresh("words")
    known = cluster.written(spark, references(docs, common), "references").select(F.col("lang").alias(of), F.col("classes").alias(c), F.col("words").alias(w))
    joined = docs.join(known, own == F.col(of), "left")

    def judge(piece: pa.RecordBatch) -> list[pa.Array]:
        names = np.array(piece.column("__lang").to_pylist(), object)
        classes, words = histograms(piece.column(HIDDEN), names, common)

        def rows(column: str, like: np.ndarray) -> np.ndarray:
            # a NULL list leaves a row of zeros
            column_ = piece.column(column)
            out, has = np.zeros(like.shape), np.array(column_.is_valid())
            if has.any():
                out[has] = column_.flatten().to_numpy().reshape(-1, like.shape[1])
            return out

        a, b = distance(classes, rows("__c", classes)), distance(words, rows("__w", words))
        a[classes.sum(1) < min_chars] = np.nan
        b[(words.sum(1) < min_words) | ~np.isin(names, list(common))] = np.nan
        good = ~(a > max_chars) & ~(b > max_words)
        return [pa.array(a, from_pandas=True), pa.array(b, from_pandas=True), pa.array(good)]

    also = {"__lang": own, "__c": F.col(c), "__w": F.col(w)}
    return with_columns(joined, "char_distance double, word_distance double, rules_keep boolean", judge, docs.columns if keep is None else keep, also)
