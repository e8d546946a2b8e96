import random
import re

import pyarrow as pa

from tidemark.llm import decontaminate as D
from tidemark.llm import language_id as L

WORD = re.compile(r"(?:[a-z0-9]|[^\x00-\x7F])+")


def norm(t):
    return WORD.findall((t or "").lower())


def brute(docs, items, window=8, min_words=3):
    out = set()
    for d, t, *_ in docs:
        body = f" {' '.join(norm(t))} "
        for i, q in items:
            w = norm(q)
            if d is None or i is None or len(w) < min_words:
                continue
            if any(f" {' '.join(w[k : k + window])} " in body for k in range(max(1, len(w) - window + 1))):
                out.add((d, i))
    return sorted(out)


def test_leaks_against_brute_force(spark, docs_of, text_of, odd_rows):
    rng = random.Random(4)
    items = [(i, text_of(rng, rng.randint(1, 40))) for i in range(40)] + [(40, None), (None, "x y z"), (41, ""), (42, "a b c d e f g"), (43, "a b c d e f g"), (3, "w1x1 w2x2 w3x3 w4x4")]
    docs = list(odd_rows)
    for i in range(100, 160):
        words = text_of(rng, rng.randint(0, 200)).split()
        if rng.random() < 0.5:
            q = norm(rng.choice(items[:40])[1])
            s = rng.randrange(len(q))
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + "," for w in q[s : s + rng.randint(1, 20)]]
        docs.append((i, " \n".join(words)))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = D.leaked_pairs(docs_of(docs), table)
    assert sorted((r.doc_id, int(r.item)) for r in found.collect()) == brute(docs, items)
    # the same in several passes of tables
    split = D.find_leaks(docs_of(docs).where("doc_id is not null"), table, part_bytes=500, keep=["doc_id"]).collect()
    assert sorted({(r.doc_id, i) for r in split for i in r.leaked_items}) == brute(docs, items)


def test_leaks_of_nothing(spark, docs_of):
    none = spark.createDataFrame([], "item_id bigint, text string")
    rows = D.find_leaks(docs_of([(1, "a b c"), (2, None)]).selectExpr("*", "1 as leaked_items"), none)
    assert [r.leaked_items for r in rows.collect()] == [[], []] and rows.columns.count("leaked_items") == 1
    assert D.leaked_pairs(docs_of([]), none).count() == 0


def test_normalise():
    text, at = D.normalise(pa.array(["Ab, c", None, "", "É"]))
    assert text.tobytes().decode() == " ab c    é " and len(at) == 5


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train(docs.where("doc_id % 2 = 0"), 100)
    held = L.identify_language(docs.where("doc_id % 2 = 1"), model=model, keep=["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_id for r in held) / len(held) > 0.98


def test_word_scores_back_off():
    model = L.Model(["aa", "bb"])
    import numpy as np

    data = np.frombuffer(b"known", np.uint8)
    key = L.T.span_hash(data, np.array([0]), np.array([5])).view(np.int64)
    model.keys, model.logs = {0: key}, {0: np.log([[0.9, 0.1]])}
    grams = L._grams(np.frombuffer("xyz".encode(), np.uint8), np.array([0]), np.array([3]))
    assert {k: len(g) for k, (g, _) in grams.items()} == {4: 2, 3: 3, 2: 4, 1: 3}
    two = np.sort(grams[2][0])
    model.keys[2], model.logs[2] = two, np.log(np.tile([[0.2, 0.8]], (4, 1)))
    text = np.frombuffer(b"known xyz", np.uint8)
    scores, inverse = model.word_scores(text, np.array([0, 6]), np.array([5, 9]))
    assert np.allclose(np.exp(scores[inverse]), [[0.9, 0.1], [0.2, 0.8]])


def test_language_odd_rows(spark, docs_of, odd_rows):
    out = L.identify_language(docs_of(odd_rows).selectExpr("*", "1 as key", "2 as kind", "'q' as lang_id"))
    rows = out.collect()
    assert len(rows) == len(odd_rows) and out.columns.count("lang_id") == 1
    by = {r.doc_id: r for r in rows}
    assert by[3].lang_id is None and by[4].lang_id is None and by[6].lang_id is None and by[7].lang_id == "en"
    nameless = docs_of([(1, "abc", None), (2, None, None)])
    assert [r.lang_id for r in L.identify_language(nameless).collect()] == [None, None]
    assert L.identify_language(docs_of([])).count() == 0
