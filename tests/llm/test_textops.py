import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import textops as T

WORD = re.compile(r"(?:[a-z0-9]|[^\x00-\x7F])+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab1 .\nÉé日A", max_size=30)), max_size=8)


@given(texts)
@settings(max_examples=150, deadline=None)
def test_words_match_the_pattern(rows):
    hashes, at = T.words(pa.array(rows, pa.string()))
    seen = {}
    for i, text in enumerate(rows):
        found = WORD.findall((text or "").lower())
        assert at[i + 1] - at[i] == len(found)
        for word, h in zip(found, hashes[at[i] : at[i + 1]].tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


@given(texts, st.integers(1, 5))
@settings(max_examples=100, deadline=None)
def test_ngrams_match_tuples(rows, n):
    hashes, at = T.words(pa.array(rows, pa.string()))
    grams, doc = T.ngrams(hashes, at, n)
    seen, k = {}, 0
    for i, text in enumerate(rows):
        words = WORD.findall((text or "").lower())
        expected = [tuple(words[j : j + n]) for j in range(max(1, len(words) - n + 1))] if words else []
        assert (doc == i).sum() == len(expected)
        for g in expected:
            assert seen.setdefault(g, int(grams[k])) == int(grams[k])
            k += 1
    assert len(set(seen.values())) == len(seen)


def test_pack_round_trip():
    arrays = [np.arange(5, dtype=np.uint64) << np.uint64(40), np.zeros(0, np.int32), np.array([1.5, -2], np.float32)]
    for a, b in zip(arrays, T.unpack(T.pack(*arrays))):
        assert a.dtype == b.dtype and np.array_equal(a, b)


def test_chunks_keep_all_rows_and_long_ones_whole():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 10, None, "y" * 5000, "", "z"]})
    pieces = list(T.chunks(batch, "text", 100))
    assert sum((p.column("text").to_pylist() for p in pieces), []) == batch.column("text").to_pylist()


def test_slices_and_dictionaries():
    column = pa.array(["aa bb", "cc", None, "dd ee"])
    whole, at = T.words(column)
    part, at2 = T.words(column.slice(1))
    assert np.array_equal(whole[at[1] :], part) and list(at2) == [0, 1, 1, 3]
    coded, _ = T.words(column.dictionary_encode())
    assert np.array_equal(coded, whole)
