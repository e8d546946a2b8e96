import random
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import line_dedup as L
from tidemark.llm import mixing as M
from tidemark.llm import sharding as K
from tidemark.llm import textops as T
from tidemark.llm.line_dedup import line_dedup


def slow_dedup(rows, least=10):
    seen, out = {}, {}
    for i, t in sorted({(i, t) for i, t, *_ in rows if i is not None and t is not None}):
        kept = []
        for k, line in enumerate(t.split("\n")):
            key = line.strip(" ")
            if len(key) < least or seen.setdefault(key, (i, k)) == (i, k):
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def test_filters_miss_nothing(spark):
    """Whatever lies where: the twice filter holds each hash seen twice, the id filter each id."""
    rng = np.random.default_rng(4)
    ids = rng.integers(-(2**62), 2**62, 5000)
    shared = L.id_filter(spark.createDataFrame([(int(i),) for i in ids], "id bigint"), len(ids))
    assert L.inside(*shared, T.mix(ids.view(np.uint64))).all()
    others = rng.integers(-(2**62), 2**62, 20_000)
    assert L.inside(*shared, T.mix(others.view(np.uint64))).mean() < 0.02
    h = T.mix(np.arange(4000, dtype=np.uint64))
    held = np.concatenate([h, h[:500]])
    doc, number = np.arange(len(held)), np.arange(len(held), dtype=np.uint32)
    cut = 2200
    table = pa.table([pa.array([0, 0]), pa.array([T.pack(held[s], doc[s], number[s]) for s in (slice(0, cut), slice(cut, None))], pa.binary())], names=["segment", "bits"])
    found = set(L._probe(table).column("doc_id").to_pylist())
    assert set(range(500)) | set(range(4000, 4500)) <= found and len(found) < 1300


@pytest.mark.parametrize("limit", [512 << 20, 0])
def test_lines_against_a_loop(docs_of, text_of, odd_rows, limit):
    rng = random.Random(6)
    pool = [text_of(rng, rng.randint(1, 9)) for _ in range(60)] + ["ééééééééé", "éééééééééé"]
    rows = odd_rows + [(i, "\n".join(("  " if rng.random() < 0.2 else "") + (rng.choice(pool) if rng.random() < 0.5 else text_of(rng, 8)) for _ in range(rng.randint(0, 12)))) for i in range(50, 110)]
    out = line_dedup(docs_of(rows).selectExpr("*", "1 as line", "2 as content", "3 as lines_removed"), filter_bytes=limit)
    found = out.collect()
    assert len(found) == len(rows) and out.columns.count("lines_removed") == 1
    expected = slow_dedup(rows)
    for r in found:
        if r.doc_id is not None and r.text is not None:
            assert r.text == expected[r.doc_id], r.doc_id
    assert [r.text for r in found if r.doc_id is None].count("a b c d e f g") == 1
    assert {r.doc_id: r.lines_removed for r in found}[3] == 0


def test_lines_of_nothing(docs_of):
    assert line_dedup(docs_of([])).count() == 0
    assert line_dedup(docs_of([(1, None), (2, "")])).count() == 2


def spread(sums):
    return max(sums) - min(sums)


def test_differencing_is_tight():
    rng = random.Random(7)
    for shards in (2, 3, 4):
        sizes = [rng.randint(1, 100) for _ in range(8)]
        slots = K.differencing([[s] + [0] * (shards - 1) for s in sizes], shards)
        got = [sum(s for s, p in zip(sizes, slots) if p[0] == k) for k in range(shards)]
        best = min(spread([sum(s for s, p in zip(sizes, way) if p == k) for k in range(shards)]) for way in product(range(shards), repeat=8))
        assert sum(got) == sum(sizes) and spread(got) <= best + max(sizes) // 2
    big = [rng.randint(1, 10**6) for _ in range(2000)]
    slots = K.differencing([[s] + [0] * 7 for s in sorted(big, reverse=True)], 8)
    got = [0] * 8
    for s, p in zip(sorted(big, reverse=True), slots):
        got[p[0]] += s
    greedy = [0] * 8
    for s in sorted(big, reverse=True):
        greedy[greedy.index(min(greedy))] += s
    assert spread(got) < spread(greedy)


@pytest.mark.parametrize("part", [1 << 15, 10, 1])
def test_groups_stay_whole(docs_of, text_of, odd_rows, part):
    rng = random.Random(8)
    rows = odd_rows + [(i, text_of(rng, rng.randint(1, 40)), rng.choice(["en", "fr", None]), rng.choice(["", None, "a", "b", "c", "d", "e"])) for i in range(200, 400)]
    out = K.shard_by_groups(docs_of(rows).selectExpr("*", "1 as shard", "2 as key", "3 as part", "4 as slot"), ["source", "lang"], 4, part)
    found = out.collect()
    assert len(found) == len(rows) and out.columns.count("shard") == 1
    where = defaultdict(set)
    sums = Counter()
    for r in found:
        where[(r.source, r.lang)].add(r.shard)
        sums[r.shard] += r.bytes
        assert r.bytes == len((r.text or "").encode()) and 0 <= r.shard < 4
    assert all(len(s) == 1 for s in where.values())
    assert K.shard_by_groups(docs_of([]), ["source"], 4).count() == 0
    assert {r.shard for r in K.shard_by_groups(docs_of([(1, None), (2, None)]), ["source"], 9).collect()} <= set(range(9))


def test_the_tree_is_as_tight(spark):
    """One leaf is differencing as a whole; with leaves of no more than 16 groups the spread stays under the largest group."""
    rng = random.Random(12)
    rows = [(f"k{i}", rng.randint(1, 10**6)) for i in range(3000)]
    groups = spark.createDataFrame(rows, "key string, bytes bigint")
    size = dict(rows)
    for leaf, fan in ((1 << 12, 64), (16, 4)):
        got = [0] * 8
        found = K.assign_groups(groups, 8, leaf, fan).collect()
        assert sorted(r.key for r in found) == sorted(size)
        for r in found:
            got[r.shard] += size[r.key]
        assert spread(got) <= (10 if leaf > 3000 else max(size.values())), (leaf, got)


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000])
def test_permutation(size):
    got = M.permuted(np.arange(size), size, 5)
    assert sorted(got.tolist()) == list(range(size))
    if size > 10:
        assert got.tolist() != list(range(size)) and got.tolist() != M.permuted(np.arange(size), size, 6).tolist()


def slow_blocks(rows, length):
    stream = defaultdict(list)
    for i, text, _, source in sorted(((i, t, lang, s or "") for i, t, lang, s in rows if i is not None and t), key=lambda r: (r[0], r[1])):
        stream[source] += [(i, w) for w in text.split()]
    return {s: [x[k : k + length] for k in range(0, len(x), length)] for s, x in stream.items()}


def test_blocks_and_draws(docs_of, text_of, odd_rows):
    rng = random.Random(9)
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0") for r in odd_rows]
    rows += [(i * 3000, text_of(rng, rng.randint(0, 90)), "en", rng.choice(["x", "y", "z"])) for i in range(1, 120)]
    blocks = slow_blocks(rows, 16)
    out = M.mix_sources(docs_of(rows).selectExpr("*", "1 as block", "2 as range", "3 as n", "4 as shard"), block_tokens=16, shard_blocks=64)
    found = out.collect()
    total = sum(map(len, blocks.values()))
    assert len(found) == total
    assert sorted((r.shard, r.slot) for r in found) == [(k // 64, k % 64) for k in range(total)]
    uses = defaultdict(Counter)
    for r in found:
        block = blocks[r.source][r.block]
        assert r.text.split() == [w for _, w in block] and r.n == len(block)
        assert r.doc_ids == sorted(r.doc_ids) and set(r.doc_ids) == {i for i, _ in block}
        uses[(r.source, r.epoch)][r.block] += 1
    assert all(n == 1 for c in uses.values() for n in c.values())
    for (source, epoch) in uses:
        assert all(len(uses[(source, e)]) == len(blocks[source]) for e in range(epoch))
    again = M.mix_sources(docs_of(rows), block_tokens=16, shard_blocks=64).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_weights_are_met(docs_of, text_of):
    rng = random.Random(10)
    rows = [(i, text_of(rng, 64), "en", "big" if i % 4 else "small") for i in range(400)]
    found = M.mix_sources(docs_of(rows), {"big": 0.25, "small": 0.75, "absent": 3.0}, 16, 256, total_blocks=4000).collect()
    share = sum(r.source == "small" for r in found) / len(found)
    assert len(found) == 4000 and abs(share - 0.75) < 0.03 and max(r.epoch for r in found) > 0
    assert M.mix_sources(docs_of(rows), {"big": 1.0}, 16).select("source").distinct().collect()[0][0] == "big"


def test_mixing_nothing(docs_of):
    assert M.mix_sources(docs_of([])).count() == 0
    assert M.mix_sources(docs_of([(1, None), (2, " "), (None, "a")])).count() == 0
    assert M.mix_sources(docs_of([(1, "a b")]), {"other": 1.0}).count() == 0
