"""Token-ID output: texts as Parquet lists of byte-level BPE ids.

Texts are cut before the white space that follows a word; no token of the tokenizer
crosses such a place, so each distinct unit of a piece of the corpus is encoded once
and its ids are gathered for every occurrence.  The table is written with ids delta
encoded, short columns in dictionaries, row groups and pages of given sizes and page
indexes, documents in order of doc_id within a file: a reader can take the columns
of metadata alone, or the pages that hold a range of documents.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from tidemark import cluster
from tidemark.llm import textops as T
from tidemark.llm.arrow import HIDDEN, with_columns

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOADED: dict[int, Tokenizer] = {}


def vocabulary(path: str) -> bytes:
    """The file of ranks: base64 token and id on each line."""
    return Path(path).read_bytes()


class Tokenizer:
    """A byte-level BPE, with the distinct units of a piece encoded together."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN) -> None:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.size = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            self.size[rank] = len(token)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of each text's ids."""
        data, offsets = T.utf8(column)
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        space = _SPACE[data]
        # places after a character that is not white space, of any kind that Unicode knows
        b1, b2, b3 = (np.concatenate([np.zeros(k, np.uint8), data[: n + 1 - k]])[: n + 1] for k in (1, 2, 3))
        solid = ~_SPACE[b1] & ~((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) & ~((b3 >= 0xE1) & (b3 <= 0xE3) & (b1 >= 0x80))
        cut = np.zeros(n + 1, bool)
        cut[:n] = space & solid[:n]
        cut[offsets] = True
        bounds = np.flatnonzero(cut)
        starts, ends = bounds[:-1], bounds[1:]
        _, first, inverse = np.unique(T.span_hash(data, starts, ends), return_index=True, return_inverse=True)
        s, e = starts[first], ends[first]
        joined = space[s] & solid[e]
        ids, lengths = [], np.zeros(len(first), np.int64)
        at = np.flatnonzero(joined)
        if len(at):
            text = data[T.ragged(s[at], e[at] - s[at])].tobytes().decode()
            tokens = np.array(self.encoding.encode_ordinary(text), np.int64)
            upto = np.searchsorted(np.cumsum(self.size[tokens]), np.cumsum(e[at] - s[at])) + 1
            lengths[at] = np.diff(upto, prepend=0)
            ids.append(tokens)
        rest = np.flatnonzero(~joined)
        raw = data.tobytes()
        for i, (a, b) in zip(rest.tolist(), zip(s[rest].tolist(), e[rest].tolist())):
            tokens = self.encoding.encode_ordinary(raw[a:b].decode())
            lengths[i] = len(tokens)
            ids.append(np.array(tokens, np.int64))
        flat = np.concatenate(ids).astype(np.int32)
        order = np.concatenate([at, rest])
        begin = np.zeros(len(first), np.int64)
        begin[order] = np.concatenate([[0], np.cumsum(lengths[order])[:-1]])
        many = lengths[inverse]
        total = np.concatenate([[0], np.cumsum(many)])
        return flat[T.ragged(begin[inverse], many)], total[np.searchsorted(starts, offsets)]


def _tokenizer(ranks: bytes, pattern: str) -> Tokenizer:
    """The worker's tokenizer, built once."""
    key = hash((ranks, pattern))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer(ranks, pattern)
    return _LOADED[key]


def tokenized(docs: DataFrame, ranks: bytes, pattern: str = PATTERN) -> DataFrame:
    """``docs`` without its text, with ``n_tokens`` and ``tokens``.

    A NULL text has NULL for both, an empty one 0 and an empty list.  Columns of the
    added names are replaced, all others pass; repeated rows are encoded alike, an
    empty table stays empty, and texts are encoded whole.  Strings that look like
    special tokens are ordinary text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def encode(piece: pa.RecordBatch) -> list[pa.Array]:
        ids, offsets = _tokenizer(shared.value, pattern).encode(piece.column(HIDDEN))
        none = np.array(piece.column(HIDDEN).is_null())
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.append(none, False)), pa.array(ids)) if none.any() else T.list_array(ids, offsets)
        return [pa.array(np.diff(offsets).astype(np.int32), mask=none), lists]

    return with_columns(docs, "n_tokens int, tokens array<int>", encode, [c for c in docs.columns if c != "text"])


def write_tokens(df: DataFrame, path: str, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000, codec: str = "zstd") -> None:
    """Writes what ``tokenized`` returns: ids delta encoded, the other columns in
    dictionaries where these stay small, page indexes for all."""
    ordered = df.sortWithinPartitions("doc_id") if "doc_id" in df.columns else df
    options = {
        "compression": codec,
        "parquet.writer.version": "v2",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#tokens.list.element": "false",
    }
    ordered.write.options(**options).parquet(path)


def token_table(spark: SparkSession, docs: DataFrame, vocabulary_path: str, path: str | None = None) -> DataFrame:
    """Tokenizes docs, writes the table (to a new folder of the shared one by
    default) and returns it as read back."""
    path = path or cluster.new_path(spark, "tokens")
    made = tokenized(docs, vocabulary(vocabulary_path))
    write_tokens(made, path)
    return spark.read.schema(made.schema).parquet(path)
