import random
import re

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import ngram_jaccard as J
from tidemark.llm import textops as T
from tidemark.llm.near_groups import components, keep_one_of_each_group
from tidemark.llm.ngram_jaccard import ngram_jaccard_edges, ngram_jaccard_join, ngram_jaccard_links, order

WORD = re.compile(r"(?:[a-z0-9]|[^\x00-\x7F])+")


def brute(rows, n, num, den):
    classes = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").lower())
        if i is not None and w:
            classes.setdefault(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))), set()).add(i)
    out = {(min(v), d, 1.0) for v in classes.values() for d in v if d != min(v)}
    listed = [(min(v), s) for s, v in classes.items()]
    for x in range(len(listed)):
        for y in range(x):
            (a, s), (b, t) = listed[x], listed[y]
            both = len(s & t)
            union = len(s) + len(t) - both
            if both * den >= union * num and a != b:
                out.add((min(a, b), max(a, b), both / union))
    return out


def plain(rows, n, num, den):
    """All pairs of documents, a document's n-grams being those of all its texts."""
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").lower())
        if i is not None and w:
            sets.setdefault(i, set()).update(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))
    ids, out = sorted(sets), set()
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both * den >= (len(sets[a]) + len(sets[b]) - both) * num:
                out.add((a, b, both / (len(sets[a]) + len(sets[b]) - both)))
    return out


def expanded(pairs):
    """All pairs from the rows of the join: (smallest, other, 1.0) of each class, and one row for two near classes."""
    members = {}
    for a, b, j in pairs:
        if j == 1.0:
            members.setdefault(a, {a}).add(b)
    out = set()
    for own in members.values():
        out |= {(a, b, 1.0) for a in own for b in own if a < b}
    for a, b, j in pairs:
        if j < 1.0:
            out |= {(min(x, y), max(x, y), j) for x in members.get(a, {a}) for y in members.get(b, {b})}
    return out


def test_all_pairs_follow(docs_of, text_of):
    rng = random.Random(8)
    rows = []
    for base in range(6):
        words = text_of(rng, 40).split()
        for _ in range(12):
            near = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                near[rng.randrange(3) * 10] = f"e{rng.randrange(3)}"
            rows.append((len(rows), " ".join(near)))
    rng.shuffle(rows)
    found = got(ngram_jaccard_join(docs_of(rows)))
    want = plain(rows, 5, 2, 5)
    assert expanded(found) == want and len(found) < len(want)


def test_rows_that_share_a_doc_id(docs_of):
    """They are one document: its n-grams are those of all its texts together."""
    one, other = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, one), (2, one), (3, other), (1, other), (4, "x y"), (4, one), (5, "x y"), (4, one)]
    found = got(ngram_jaccard_join(docs_of(rows).repartition(3)))
    assert expanded(found) == plain(rows, 5, 2, 5) and (1, 2, 0.5) in found and (1, 3, 0.5) in found


def got(df):
    return sorted((r.doc_a, r.doc_b, r.jaccard) for r in df.collect())


@pytest.mark.parametrize("n,num,den", [(5, 2, 5), (3, 1, 2), (2, 4, 5), (1, 1, 1)])
def test_against_brute_force(spark, docs_of, text_of, n, num, den):
    rng = random.Random(n)
    rows = []
    for i in range(40):
        rows.append((len(rows), text_of(rng, rng.randint(1, 80))))
        for _ in range(rng.choice([0, 0, 1, 3])):
            words = rows[-1][1].split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = text_of(rng, 1)
            rows.append((len(rows), " ".join(words).upper() + "."))
    assert got(ngram_jaccard_join(docs_of(rows), n, num / den)) == sorted(brute(rows, n, num, den))


def test_hot_groups(docs_of, text_of):
    rng = random.Random(5)
    base = text_of(rng, 60).split()
    rows = [(i, " ".join(base)) for i in range(150)]
    for i in range(150, 260):
        words = list(base)
        words[rng.randrange(60)] = f"edit{i}"
        rows.append((i, " ".join(words)))
    assert got(ngram_jaccard_join(docs_of(rows))) == sorted(brute(rows, 5, 2, 5))


def test_odd_rows(docs_of, odd_rows):
    found = got(ngram_jaccard_join(docs_of(odd_rows)))
    assert found == sorted(brute(odd_rows, 5, 2, 5))
    assert (1, 2, 1.0) in found and (7, 8, 1.0) in found and (1, 12, 1.0) in found


def test_empty_and_extra_columns(spark, docs_of):
    assert got(ngram_jaccard_join(docs_of([]))) == []
    rows = docs_of([(1, "a b c d e f"), (2, "A, b c d e f!")]).selectExpr("*", "1 as part", "2 as sig", "3 as kind", "4 as payload")
    assert got(ngram_jaccard_join(rows)) == [(1, 2, 1.0)]


def test_order_is_a_sort():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        v = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        v[n // 2 :] = v[: n - n // 2]
        v[:5] = v[:5] & np.uint64(2**64 - 8) | np.arange(len(v[:5]), dtype=np.uint64)
        assert np.array_equal(order(v), np.argsort(v, kind="stable"))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    expected = sorted((x, root(x)) for x in parent if root(x) != x)
    found = components(spark.createDataFrame(edges, "doc_a bigint, doc_b bigint"))
    assert sorted((r.doc_id, r.root) for r in found.collect()) == expected


def test_one_of_each_group_stays(docs_of, odd_rows):
    kept = keep_one_of_each_group(docs_of(odd_rows)).collect()
    ids = sorted((r.doc_id for r in kept if r.doc_id is not None))
    assert ids == [1, 1, 3, 4, 5, 6, 7, 9, 11, 13]
    assert sum(r.doc_id is None for r in kept) == 2
    assert keep_one_of_each_group(docs_of([])).count() == 0


def linked(rows, n, num, den):
    """doc_id, class_id and links from all pairs of documents."""
    ids = {i for i, *_ in rows if i is not None}
    class_of, links = {i: i for i in ids}, dict.fromkeys(ids, 0)
    for a, b, j in plain(rows, n, num, den):
        links[a], links[b] = links[a] + 1, links[b] + 1
        if j == 1.0:
            class_of[b] = min(class_of[b], a)
    return sorted((i, class_of[i], links[i]) for i in ids)


def near_copies(rng, text_of, bases, each, words, edits):
    rows = []
    for _ in range(bases):
        base = text_of(rng, words).split()
        for _ in range(each):
            near = list(base)
            for _ in range(rng.choice(edits)):
                near[rng.randrange(words)] = f"e{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(near)))
    rng.shuffle(rows)
    return rows


def test_links_count_all_pairs(docs_of, text_of, odd_rows):
    """Three texts of one n-gram set have two links each, and near classes link all their documents."""
    rows = near_copies(random.Random(12), text_of, 5, 14, 40, [0, 0, 1, 2, 3]) + [(500, "p q r s t u"), (501, "P q, r s t u"), (502, "p Q r s t u!")]
    for case in (rows, odd_rows, []):
        found = sorted((r.doc_id, r.class_id, r.links) for r in ngram_jaccard_links(docs_of(case)).collect())
        assert found == linked(case, 5, 2, 5)
    assert {(500, 500, 2), (501, 500, 2), (502, 500, 2)} <= set(linked(rows, 5, 2, 5))


def test_a_large_group_of_near_copies(docs_of, text_of):
    """The rows follow the documents, not their pairs, and blocks lose no link."""
    rows = near_copies(random.Random(13), text_of, 2, 300, 50, [1, 2])
    docs = docs_of(rows)
    assert sorted((r.doc_id, r.class_id, r.links) for r in ngram_jaccard_links(docs).collect()) == linked(rows, 5, 2, 5)
    edges, pairs = ngram_jaccard_edges(docs), plain(rows, 5, 2, 5)
    assert edges.count() < 4 * len(rows) < len(pairs) // 20
    assert components(edges).collect() and sorted(components(edges).collect()) == sorted(components(ngram_jaccard_join(docs)).collect())


def test_candidates_are_pairs_of_blocks():
    """Of k near copies that share an n-gram, (k / SIDE)**2 candidates are made and not k**2."""
    k, side = 2048, J.SIDE
    g = np.full(k, 7, np.uint64)
    payload = T.pack(g, np.arange(k, dtype=np.uint32), np.ones(k, np.int32), np.arange(k, dtype=np.int64) // side, np.full(k, 50, np.int32))
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([payload], pa.binary())], names=["part", "kind", "payload"])
    made = [(a, b) for x in J._candidates(Fraction(2, 5))(iter([batch])) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist())]
    assert sorted(made) == [(a, b) for a in range(k // side) for b in range(a, k // side)]


def test_dense_and_single_blocks_agree(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.int64)
    sets = [np.unique(np.concatenate([rng.choice(base, 60, replace=False), rng.integers(0, 2**63, rng.integers(0, 9))])) for _ in range(90)]
    records = pa.table({"block": pa.array([i // 30 for i in range(90)], pa.int64()), "doc_id": list(range(90)), "many": [1] * 90, "size": [len(x) for x in sets], "grams": [x.tolist() for x in sets]})
    pairs = pa.table({"a": [0, 0, 1, 2], "b": [0, 1, 2, 2]})
    inside = {(x, y) for x in range(90) for y in range(x + 1, 90) if (x // 30, y // 30) in {(0, 0), (0, 1), (1, 2), (2, 2)}}
    t = Fraction(1, 10)
    want = {(x, y, k) for x, y in inside if 10 * (k := len(np.intersect1d(sets[x], sets[y]))) >= len(sets[x]) + len(sets[y]) - k}
    for least in (1, 10**9):
        monkeypatch.setattr(J, "DENSE", least)
        monkeypatch.setattr(J, "COLUMNS", 64)
        found = [(int(x), int(y), int(k)) for a, b, o in J._Place(t, records).near(pairs) for x, y, k in zip(a, b, o)]
        assert set(found) == want and len(found) == len(want) > 50


def test_thresholds_are_not_rounded(docs_of):
    """0.9996 isn't 1: sets of 3,000 and 3,001 words have a similarity of 0.99967."""
    words = " ".join(f"w{i}" for i in range(3000))
    docs = docs_of([(1, words), (2, words + " more")])
    assert got(ngram_jaccard_join(docs, 1, 0.9996)) == [(1, 2, 3000 / 3001)]
    assert got(ngram_jaccard_join(docs, 1, 0.9997)) == []


def test_groups_are_found_from_few_edges(docs_of, text_of, monkeypatch):
    """What is kept of near copies comes from edges that follow the documents, not from all pairs."""
    from tidemark.llm import near_groups

    seen = []
    monkeypatch.setattr(near_groups, "components", lambda edges: seen.append(edges.count()) or components(edges))
    rows = near_copies(random.Random(14), text_of, 1, 200, 50, [1, 2])
    kept = {r.doc_id for r in keep_one_of_each_group(docs_of(rows)).collect()}
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = plain(rows, 5, 2, 5)
    for a, b, _ in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert kept == {i for i in parent if root(i) == i}
    assert seen[0] < 4 * len(rows) < len(pairs) // 5
