"""Vectorised text primitives shared by the corpus operators.

Everything works on whole Arrow batches: a string column is viewed as one byte
array plus offsets, and words, lines and n-grams are found and hashed with a
fixed number of numpy passes per chunk, never with a loop over rows.  Chunks
are cut at document borders and hold about ``CHUNK`` bytes, so the working set
of a Python worker stays small whatever the Arrow batch size; a document longer
than a chunk is still processed whole.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII
characters of the lower-cased text, i.e. the matches of
``(?:[a-z0-9]|[^\\x00-\\x7F])+`` over ``lower(text)``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
WORD_SQL = r"(?:[a-z0-9]|[^\x00-\x7F])+"

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1
_PAD = U64(0xD1B54A32D192ED03)


def _is_word() -> np.ndarray:
    table = np.zeros(256, bool)
    table[ord("a") : ord("z") + 1] = table[ord("0") : ord("9") + 1] = True
    table[128:] = True
    return table


WORD = _is_word()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_POW: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random value of each byte; powers of the base and of its inverse up to n."""
    if "byte" not in _POW:
        _POW["byte"] = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
    if len(_POW.get("pow", ())) <= n:
        size = max(n, CHUNK + (CHUNK >> 2)) + 1
        for name, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base & _MASK, U64)
            steps[0] = 1
            _POW[name] = np.multiply.accumulate(steps)
    return _POW["byte"], _POW["pow"], _POW["inv"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (first 0) of a string or binary array; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_dictionary(column.type):
        column = column.cast(column.type.value_type)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = raw[column.offset : column.offset + n + 1].astype(np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of one text column, one row at least."""
    _, offsets = utf8(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(column.type.value_type) if pa.types.is_dictionary(column.type) else column)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut at document borders, and
    the offsets of each document's runs in those lists."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by prefix sums of a polynomial hash."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    byte, power, inverse = _tables(len(data))
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum(byte[data] * power[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xC2B2AE3D27D4EB4F))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and the offsets of each text's words."""
    data, offsets = utf8(lower(column))
    starts, ends, at = runs(WORD[data], offsets)
    return span_hash(data, starts, ends), at


def owners(offsets: np.ndarray) -> np.ndarray:
    """The document of each element of a ragged array."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ngrams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every word n-gram; a text of 1 to n-1 words has one
    n-gram, that of all its words."""
    doc = owners(offsets)
    left = offsets[1:][doc] - np.arange(len(hashes))
    at = np.flatnonzero((left >= n) | (np.arange(len(hashes)) == offsets[:-1][doc]))
    left, padded = left[at], np.concatenate([hashes, np.zeros(n, U64)])
    total, factor = np.zeros(len(at), U64), 1
    short = left < n
    for k in range(n):
        part = padded[at + k]
        if short.any():
            part[short & (left <= k)] = _PAD
        total += part * U64(factor)
        factor = factor * (_BASE ^ 0xA5A5A5A4) & _MASK
    return mix(total), doc[at]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0]..starts[0]+lengths[0]-1, starts[1].. and so on."""
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    return np.arange(n) + np.repeat(starts - (ends - lengths), lengths)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each with its byte planes apart: of sorted or small
    numbers the high planes compress to little in a shuffle."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        out += [struct.pack("<3sQ", a.dtype.str[1:].encode().ljust(3), len(a)), a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    """What ``pack`` was given."""
    out, at = [], 1
    for _ in range(data[0]):
        kind, n = struct.unpack_from("<3sQ", data, at)
        at += 11
        dtype = np.dtype(kind.decode().strip())
        planes = np.frombuffer(data, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
        at += n * dtype.itemsize
    return out


def list_array(values: np.ndarray, offsets: np.ndarray, type_: pa.DataType | None = None) -> pa.Array:
    """An Arrow list array from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=type_))
