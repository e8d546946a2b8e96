import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import quality_knn as Q
from tidemark.llm import quality_rules as R

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r.quality for r in labels.collect()}
    train = labels.where("doc_id % 2 = 0")
    scored = {r.doc_id: r.quality_keep for r in Q.quality_votes(docs, train, keep=["doc_id"]).collect()}
    held = [i for i in rows if i % 2 and i in scored]
    good = [scored[i] for i in held if rows[i] == 1]
    bad = [not scored[i] for i in held if rows[i] == 0]
    assert len(scored) == docs.count() and np.mean(good) > 0.95 and np.mean(bad) > 0.85


def test_votes_match_a_loop():
    rng = np.random.default_rng(0)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, 200)) for _ in range(40)]
    counts = Q.histograms(pa.array(texts))
    labels = rng.integers(0, 2, 40).astype(float)
    model = Q.fit(counts, labels, dims=8)
    z = model.embed(counts)
    for i, vote in enumerate(model.vote(z, 5)):
        similar = [max(float(z[i] @ v), 0) for v in model.vectors]
        near = sorted(range(40), key=lambda k: -similar[k])[:5]
        weight = {k: similar[k] / (labels == labels[k]).sum() for k in near}
        assert abs(vote - sum(weight[k] * labels[k] for k in near) / sum(weight.values())) < 1e-4


def test_trigrams_stay_within_texts():
    a = Q.histograms(pa.array(["abc", "de", None, "fghi"]))
    assert list(a[:, : Q.BINS].sum(1)) == [1, 0, 0, 2]
    assert list(Q.histograms(pa.array(["x x x", "x", "x y"]))[:, Q.BINS]) == [2, 0, 0]


def test_odd_rows_and_labels(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows).selectExpr("*", "1 as quality_score", "2 as label", "'x' as counts")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (7, 1, 0), (9, None, 0), (None, 1, 0), (11, 5, 0)], "doc_id bigint, quality int, toxic int")
    out = Q.quality_votes(docs, labels)
    rows = out.collect()
    assert len(rows) == len(odd_rows) and out.columns.count("quality_score") == 1 and "label" in out.columns
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[3].quality_score is None and not by[3].quality_keep and not by[4].quality_keep
    assert by[1].quality_score is not None and not by[1].quality_keep  # conflicting labels count as bad
    none = Q.quality_votes(docs, labels.limit(0)).collect()
    assert all(r.quality_score is None for r in none) and sum(r.quality_keep for r in none) == sum(r[1] is not None and len(r[1].encode()) > 2 for r in odd_rows)
    assert Q.quality_votes(docs_of([]), labels).count() == 0


def slow_histograms(text, lang, common):
    classes = [0] * 8
    for ch in text:
        k = 7 if ord(ch) > 127 else 6
        for i, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r\f\v", ".,;:", "!?'\"()-")):
            if ch in chars:
                k = i
        classes[k] += 1
    import re

    words = re.findall(r"(?:[a-z0-9]|[^\x00-\x7F])+", text.lower())
    listed = common.get(lang, [])
    wide = max(map(len, common.values()))
    counts = [sum(w == c for w in words) for c in listed] + [0] * (wide - len(listed))
    return classes, counts + [len(words) - sum(counts)]


def slow_distance(p, q):
    p, q = np.array(p, float), np.array(q, float)
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return np.sqrt(max(0, sum((x * np.log2(x / y) if x else 0) for a in (p, q) for x, y in zip(a, m)) / 2))


@pytest.mark.parametrize("given", [True, False])
def test_rules_against_a_loop(docs_of, text_of, given):
    rng = random.Random(3)
    rows = [(i, text_of(rng, rng.randint(5, 120)) + (" ÉÈ!" if i % 3 else ""), "en" if i % 2 else "fr") for i in range(30)]
    rows += [(90, "#### " * 80, "en"), (91, "WHOLE TEXT IN CAPITALS " * 20, "en"), (92, "kein " * 80, "xx")]
    if given:
        common = {"en": ["the", "of", "and"], "fr": ["à", "in"]}
    else:
        # the most frequent words of each language, ties to the lesser hash
        counts = {}
        for _, text, lang in rows:
            counts.setdefault(lang, Counter()).update(re.findall(r"(?:[a-z0-9]|[^\x00-\x7F])+", text.lower()))
        common = {lang: sorted(c, key=lambda w: (-c[w], int(R.word_hashes([w])[0])))[:5] for lang, c in counts.items()}
    total = {}
    for _, text, lang in rows:
        c, w = slow_histograms(text, lang, common)
        a, b = total.setdefault(lang, ([0] * 8, [0] * len(w)))
        total[lang] = ([x + y for x, y in zip(a, c)], [x + y for x, y in zip(b, w)])
    found = {r.doc_id: r for r in R.quality_divergence(docs_of(rows), common if given else None, top=5).collect()}
    for i, text, lang in rows:
        c, w = slow_histograms(text, lang, common)
        if len(text) >= 200:
            assert abs(found[i].char_distance - slow_distance(c, total[lang][0])) < 1e-9
        else:
            assert found[i].char_distance is None
        if sum(w) >= 40 and lang in common:
            assert abs(found[i].word_distance - slow_distance(w, total[lang][1])) < 1e-9
        else:
            assert found[i].word_distance is None
    assert not found[90].rules_keep


def test_rules_odd_rows(docs_of, odd_rows):
    out = R.quality_divergence(docs_of(odd_rows).selectExpr("*", "1 as bin", "2 as classes", "3 as __of", "4 as rules_keep"))
    rows = out.collect()
    assert len(rows) == len(odd_rows) and out.columns.count("rules_keep") == 1
    by = {r.doc_id: r for r in rows}
    assert by[3].rules_keep and by[4].rules_keep and by[3].char_distance is None
    assert R.quality_divergence(docs_of([])).count() == 0
    nameless = R.quality_divergence(docs_of(odd_rows).drop("lang")).collect()
    assert len(nameless) == len(odd_rows) and all(r.rules_keep for r in nameless if r.text is None)
