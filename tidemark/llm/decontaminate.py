"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and benchmark items are normalised to lower-case words with single spaces.
The test strings are all windows of ``window`` words of the items (a shorter item is
one string), bounded by spaces.  A table by hashed six-byte blocks tells how far the
search may skip from each position; where it says zero, the bucket of that block
names the strings whose leading part ends so, and bytes are compared directly.
Many positions of a batch step at once, each through its own stretch of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops as T
from tidemark.llm.arrow import HIDDEN, with_columns

BLOCK = 6
LANE = 512
BITS = 20


def normalise(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text as " word word ... ", all in one array; a text without a word is one space."""
    data, offsets = T.utf8(T.lower(column))
    starts, ends, at = T.runs(T.WORD[data], offsets)
    length = ends - starts
    many = np.diff(at)
    doc = T.owners(at)
    begin = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)[: len(length)] + np.arange(len(length)) + doc + 1
    bytes_ = np.bincount(doc, length, len(many)).astype(np.int64) + many + 1
    out = np.full(int(bytes_.sum()), 32, np.uint8)
    out[T.ragged(begin, length)] = data[T.ragged(starts, length)]
    return out, np.concatenate([[0], np.cumsum(bytes_)])


def _block(text: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the block of bytes that ends at each position."""
    h = text[end].astype(np.uint32)
    for k in range(1, BLOCK):
        h = h * np.uint32(0x01000193) ^ text[end - k]
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


@dataclass
class Tables:
    """Strings with the items of each; least length, shifts, and buckets by block."""

    strings: list[bytes]
    items: list[list[int]]
    least: int
    shift: np.ndarray
    bucket: np.ndarray
    start: np.ndarray
    head: np.ndarray


def strings_of(items: list[tuple[int, str]], window: int, min_words: int) -> dict[bytes, list[int]]:
    """Test strings and the items that hold each."""
    out: dict[bytes, list[int]] = {}
    if not items:
        return out
    text, offsets = normalise(pa.array([t for _, t in items], pa.string()))
    raw = text.tobytes()
    for (item, _), s, e in zip(items, offsets[:-1], offsets[1:]):
        words = raw[s:e].split()
        if len(words) < min_words:
            continue
        for k in range(max(1, len(words) - window + 1)):
            held = out.setdefault(b" " + b" ".join(words[k : k + window]) + b" ", [])
            if item not in held:
                held.append(item)
    return out


def compile_tables(strings: dict[bytes, list[int]]) -> Tables:
    """Shift and bucket tables of the strings."""
    listed = sorted(strings)
    least = min(map(len, listed))
    block = min(BLOCK, least)
    assert block == BLOCK, "strings of at least three words are longer than a block"
    shift = np.full(1 << BITS, least - BLOCK + 1, np.int64)
    lead = np.frombuffer(b"".join(x[:least] for x in listed), np.uint8)
    base = np.arange(len(listed)) * least
    for end in range(BLOCK - 1, least):
        np.minimum.at(shift, _block(lead, base + end), least - 1 - end)
    last = _block(lead, base + least - 1).astype(np.int64)
    bucket = np.argsort(last, kind="stable")
    start = np.searchsorted(last[bucket], np.arange((1 << BITS) + 1))
    return Tables(listed, [strings[x] for x in listed], least, shift, bucket, start, _head(lead, base))


def _head(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first six bytes from each position as a number."""
    h = np.zeros(len(at), np.uint64)
    for k in range(BLOCK):
        h = h << np.uint64(8) | text[at + k]
    return h


def search(t: Tables, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every occurrence, and the string."""
    first = np.arange(t.least - 1, len(text), LANE)
    position, stop, found = first, np.minimum(first + LANE, len(text)), []
    while len(position):
        step = t.shift[_block(text, position)]
        here = step == 0
        if here.any():
            found.append(position[here])
        position = position + np.maximum(step, 1)
        going = position < stop
        position, stop = position[going], stop[going]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.concatenate(found)
    block = _block(text, end)
    many = t.start[block + np.uint32(1)] - t.start[block]
    begin = np.repeat(end - t.least + 1, many)
    string = t.bucket[T.ragged(t.start[block], many)]
    same = _head(text, begin) == t.head[string]
    begin, string = begin[same], string[same]
    raw = text.tobytes()
    ok = np.fromiter((raw.startswith(t.strings[k], b) for b, k in zip(begin.tolist(), string.tolist())), bool, len(begin))
    return begin[ok], string[ok]


def benchmark_parts(benchmark: DataFrame, window: int, min_words: int, part_bytes: int) -> Iterator[dict]:
    """Tables of the benchmark, as many as its size demands."""
    held: dict[bytes, list[int]] = {}
    size = 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).distinct().orderBy("item_id", "text")
    for item, text in rows.toLocalIterator():
        for string, items in strings_of([(item, text)], window, min_words).items():
            own = held.setdefault(string, [])
            own += [i for i in items if i not in own]
            size += len(string)
        if size > part_bytes:
            yield vars(compile_tables(held))
            held, size = {}, 0
    if held:
        yield vars(compile_tables(held))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_words: int = 3, part_bytes: int = 32 << 20, keep: list[str] | None = None) -> DataFrame:
    """Adds ``leaked_items``, the sorted ids of the benchmark items of which a text
    holds ``window`` words in a row, or all words of a shorter item.

    Items of fewer than ``min_words`` words, NULL items and items without an id are
    not searched; items with one text are all named.  A NULL, empty or clean text
    has an empty list.  ``keep`` names the columns of docs to return, all by
    default; a column of the added name is replaced.  Repeated rows are treated
    alike, an empty table stays empty, an empty benchmark gives empty lists, and
    texts are read whole.  A benchmark beyond ``part_bytes`` of test strings is
    searched in several passes of tables of that size.
    """
    context = docs.sparkSession.sparkContext
    parts = [context.broadcast(x) for x in benchmark_parts(benchmark, window, min_words, part_bytes)]

    def leaks(piece: pa.RecordBatch) -> list[pa.Array]:
        text, offsets = normalise(piece.column(HIDDEN))
        pairs = set()
        for part in parts:
            t = Tables(**part.value)
            begin, string = search(t, text)
            doc = np.searchsorted(offsets, begin, "right") - 1
            for d, k in set(zip(doc.tolist(), string.tolist())):
                pairs.update((d, i) for i in t.items[k])
        found: list[list[int]] = [[] for _ in range(piece.num_rows)]
        for d, i in sorted(pairs):
            found[d].append(i)
        return [pa.array(found, pa.list_(pa.int64()))]

    return with_columns(docs, "leaked_items array<bigint>", leaks, keep)


def leaked_pairs(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_words: int = 3) -> DataFrame:
    """``doc_id, item`` of every leak, once, the item's id as text, so that the one
    number of a row is the document's; rows without a doc_id are left out."""
    found = find_leaks(docs.where("doc_id is not null"), benchmark, window, min_words, keep=["doc_id"]).where("size(leaked_items) > 0")
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.explode(F.col("leaked_items").cast("array<string>")).alias("item")).distinct()
