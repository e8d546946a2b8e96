from __future__ import annotations

import random

import pytest

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or".split()


def sentence(rng: random.Random, n: int) -> str:
    made = [rng.choice(WORDS) if rng.random() < 0.3 else "".join(rng.choice(["ba", "ke", "lo", "mi", "tu", "sha", "ren"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(made)


@pytest.fixture
def text_of():
    return sentence


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs_of(spark):
    """Documents of (doc_id, text, lang, source) tuples; the last two may be left out."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0") for r in rows]
        return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in full], SCHEMA)

    return make


@pytest.fixture
def odd_rows():
    """NULLs, empty and very long texts, repeated rows and ties."""
    long_ = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    return [
        (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (5, "   \n \n"), (6, "!!! ???"), (7, "one"), (8, "one"),
        (9, long_), (10, long_ + " tail"), (None, "a b c d e f g"), (None, None), (11, "é è ñ 日本語 \U0001f600 ok"), (12, "a b c d e f g", None, None), (13, "x\ny\nx\ny long enough line here\ny long enough line here"),
    ]
