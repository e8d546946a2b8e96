import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.llm import pitman_yor as H
from tidemark.llm import textops as T
from tidemark.llm import token_output as K

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def tokenizer():
    return K.Tokenizer(K.vocabulary(VOCABULARY))


def test_units_give_the_ids_of_whole_texts(tokenizer):
    rng = random.Random(1)
    texts = ["", "  ", " a", "a ", "a  b", "a \n b", "\n\nx\n\n", "don't  stop\t\tnow ", "日本 語　 x", "é é", "<|endoftext|> a", "a\u0085 b \n", None]
    texts += ["".join(rng.choice(["a", " ", "\n", " ", "é", " ", "1", "!", "'s", "日", "　", "\t"]) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    ids, at = tokenizer.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encoding.encode_ordinary(text or ""), text


def test_table_round_trip(spark, docs_of, odd_rows, tokenizer, tmp_path):
    docs = docs_of(odd_rows).selectExpr("*", "7 as extra", "'y' as tokens")
    path = str(tmp_path / "tokens")
    out = K.token_table(spark, docs, VOCABULARY, path)
    rows = out.collect()
    assert "text" not in out.columns and out.columns.count("tokens") == 1 and all(r.extra == 7 for r in rows)
    texts = sorted(("", r[1])[r[1] is not None] for r in odd_rows)
    back = sorted("" if r.tokens is None else tokenizer.encoding.decode(r.tokens) for r in rows)
    assert back == texts and all(r.n_tokens == (None if r.tokens is None else len(r.tokens)) for r in rows)
    assert sum(r.tokens is None for r in rows) == sum(r[1] is None for r in odd_rows)
    file = next(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet") and pq.ParquetFile(os.path.join(path, f)).metadata.num_rows)
    group = pq.ParquetFile(file).metadata.row_group(0)
    columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["tokens.list.element"].encodings
    assert any("DICTIONARY" in e for e in columns["source"].encodings)
    assert all(c.has_column_index and c.has_offset_index for name, c in columns.items() if not name.startswith("tokens"))
    ids = [r.doc_id for r in spark.read.parquet(file).collect() if r.doc_id is not None]
    assert ids == sorted(ids)


def test_row_groups_keep_their_size(spark, docs_of, text_of, tmp_path):
    rng = random.Random(2)
    docs = docs_of([(i, text_of(rng, 2000)) for i in range(200)]).coalesce(1)
    path = str(tmp_path / "groups")
    K.write_tokens(K.tokenized(docs, K.vocabulary(VOCABULARY)), path, row_group_bytes=256 << 10, page_bytes=16 << 10, page_rows=20)
    files = [os.path.join(path, f) for f in os.listdir(path) if f.endswith(".parquet")]
    assert sum(pq.ParquetFile(f).metadata.num_row_groups for f in files) > 1
    assert K.tokenized(docs_of([]), K.vocabulary(VOCABULARY)).count() == 0


def test_stirling_numbers():
    d, s = 0.3, H.stirling(0.3)
    slow = {(0, 0): 1.0}
    for c in range(1, 8):
        for t in range(1, c + 1):
            slow[c, t] = slow.get((c - 1, t - 1), 0) + (c - 1 - t * d) * slow.get((c - 1, t), 0)
            assert abs(np.exp(s[c, t]) - slow[c, t]) < 1e-6


def log_stirling(c, d):
    """By the recurrence, of t = 0..c."""
    log_s = np.full(c + 1, -np.inf)
    log_s[0] = 0
    for k in range(1, c + 1):
        with np.errstate(divide="ignore"):
            log_s[1:] = np.logaddexp(log_s[:-1], np.log(np.maximum(k - 1 - np.arange(1, c + 1) * d, 0)) + log_s[1:])
        log_s[0] = -np.inf
    return log_s


@pytest.mark.parametrize(
    ("d", "g", "c"),
    [(0.5, 0.7, 2), (0.5, 3.0, 4), (0.75, 1e-6, 30), (0.75, 20.0, 256), (0.75, 300.0, 2048), (0.75, 140.0, 2048), (0.75, 700.0, 2048), (0.75, 2.0, 512), (0.5, 1000.0, 512), (0.75, 80_000.0, 600), (0.5, 0.2, 700), (0.5, 1e-5, 700)],
)
def test_seating_has_its_conditional(d, g, c):
    """Tabulated or integrated: the tables follow S_d(c, t) * (d * g)**t."""
    n, t = 6000, np.arange(1, c + 1)
    weight = log_stirling(c, d)[1:] + t * np.log(d * g)
    weight = np.exp(weight - weight.max())
    weight /= weight.sum()
    mean, sd = (weight * t).sum(), np.sqrt(max((weight * t**2).sum() - (weight * t).sum() ** 2, 0))
    got = H.seat(np.full(n, c), np.full(n, g), d, H.Keyed(np.arange(n, dtype=np.uint64), 5, c))
    assert abs(got.mean() - mean) < 5 * sd / np.sqrt(n) + 1e-3 and abs(got.std() - sd) < 0.06 * sd + 0.02
    assert np.abs(np.cumsum(np.bincount(got, minlength=c + 1)[1:] / n - weight)).max() < 0.03
    assert H.seat(np.array([1]), np.array([g]), d, H.Keyed(np.zeros(1, np.uint64)))[0] == 1


@pytest.mark.parametrize(("tau", "d"), [(1e-3, 0.5), (0.4, 0.75), (1.0, 0.5), (37.5, 0.5)])
def test_tempered_stable_has_its_transform(tau, d):
    s = H.tempered_stable(np.full(40_000, tau), d, np.random.default_rng(8))
    for q in (0.3, 1.0, 4.0):
        values = np.exp(-q * s)
        assert abs(values.mean() - np.exp(-tau * ((1 + q) ** d - 1))) < 5 * values.std() / 200 + 1e-6
    assert abs(s.mean() - tau * d) < 5 * s.std() / 200


def test_root_draws_have_its_predictions_as_mean():
    customers = np.array([0, 1, 5, 1, 12, 40, 1])
    root, drawn, told = H.Root(0.5, 3.0, 1), np.zeros(7), np.zeros(7)
    for _ in range(6000):
        p, g = root.step(customers)
        told, drawn = told + p / 6000, drawn + g.astype(float) / 6000
    assert np.abs(told - drawn).max() < 0.006
    assert abs(told[1:].sum() + told[0] * (H.WORDS - 6) - 1) < 1e-4


def test_draws_belong_to_types():
    """A type has the same tables alone, among some and among all."""
    rng = np.random.default_rng(9)
    key = np.unique(rng.integers(1, 50, 900).astype(np.uint64) << np.uint64(H.BITS) | rng.integers(1, 90, 900).astype(np.uint64))
    n = rng.integers(2, 900, len(key))
    fields = rng.gamma(9, 3, H.WORDS).astype(np.float32), rng.random(H.WORDS).astype(np.float32), 4
    whole = H._draw(fields, key, n, 0.75, 3)
    assert whole.max() > 1
    for own in (rng.permutation(len(key))[:100], np.flatnonzero(n < 300), np.array([7])):
        assert np.array_equal(H._draw(fields, key[own], n[own], 0.75, 3), whole[own])
    assert not np.array_equal(H._draw((*fields[:2], 5), key, n, 0.75, 3), whole)


class Chain:
    """The sampler on the driver, over all types at once, from plain counts."""

    def __init__(self, counts, d, theta, root_d, root_theta, seed):
        self.d, self.theta, self.seed = d, theta, seed
        self.key = np.array(sorted(counts), np.uint64)
        self.n = np.array([counts[int(k)] for k in self.key])
        self.context, self.word = (self.key >> np.uint64(H.BITS)).astype(int), (self.key & np.uint64(H.WORDS - 1)).astype(int)
        self.size = int(max(self.context.max(), self.word.max())) + 1
        self.customers = np.bincount(self.context, self.n, self.size)
        self.root, self.number, self.tables = H.Root(root_d, root_theta, seed), 0, np.bincount(self.context, minlength=self.size)
        self.drawn = self.root.step(np.bincount(self.word, minlength=self.size))[1]

    def step(self):
        """A round; the predictive probability of each type, the root's probabilities and the tables by context after it."""
        t, many = np.ones(len(self.key), int), self.n > 1
        fields = H.context_x(self.tables, self.d, self.theta, self.seed, self.number), self.drawn, self.number
        t[many] = H._draw(fields, self.key[many], self.n[many], self.d, self.seed)
        self.tables = np.bincount(self.context, t, self.size).astype(int)
        p, self.drawn = self.root.step(np.bincount(self.word, t, self.size).astype(int))
        self.number += 1
        return (self.n - self.d * t + (self.theta + self.d * self.tables[self.context]) * p[self.word]) / (self.theta + self.customers[self.context]), p, t


def seated_one_by_one(tokens, d, theta, root_d, root_theta, rounds, rng):
    """A sampler that shares nothing with the other: each customer leaves and sits down again, at a table of its own record."""
    inner, outer = {}, {}  # sizes of tables: by (context, word), and of the root by word

    def leave(tables, i):
        tables[i] -= 1
        if not tables[i]:
            tables.pop(i)
            return True
        return False

    def chosen(weights):
        x = rng.random() * sum(weights)
        for i, w in enumerate(weights):
            x -= w
            if x < 0:
                return i
        return len(weights) - 1

    def root_p(w):
        c, t = sum(map(sum, outer.values())), sum(map(len, outer.values()))
        own = outer.get(w, [])
        return (sum(own) - root_d * len(own) + (root_theta + root_d * t) / H.WORDS) / (root_theta + c)

    def sit(u, w):
        tables, t = inner.setdefault((u, w), []), sum(len(x) for (v, _), x in inner.items() if v == u)
        k = chosen([s - d for s in tables] + [(theta + d * t) * root_p(w)])
        if k < len(tables):
            tables[k] += 1
            return
        tables.append(1)
        above, t = outer.setdefault(w, []), sum(map(len, outer.values()))
        k = chosen([s - root_d for s in above] + [(root_theta + root_d * t) / H.WORDS])
        if k < len(above):
            above[k] += 1
        else:
            above.append(1)

    for u, w in tokens:
        sit(u, w)
    customers = Counter(u for u, _ in tokens)
    total, tables_of = Counter(), Counter()
    for r in range(rounds):
        for u, w in tokens:
            tables = inner[(u, w)]
            # customers of a table are alike: the one that leaves sits at a table by its size
            if leave(tables, chosen(tables)):
                leave(outer[w], chosen(outer[w]))
            sit(u, w)
        if r >= rounds // 10:
            for u, w in set(tokens):
                t = sum(len(x) for (v, _), x in inner.items() if v == u)
                own = inner[(u, w)]
                total[(u, w)] += (sum(own) - d * len(own) + (theta + d * t) * root_p(w)) / (theta + customers[u]) / (rounds - rounds // 10)
                tables_of[(u, w)] += len(own) / (rounds - rounds // 10)
    return total, tables_of


def test_sampler_against_one_by_one():
    """The blocked sampler and a plain one of customers have the same posterior means."""
    rng = random.Random(5)
    tokens = [(1 + rng.randrange(4), 1 + min(rng.randrange(6), rng.randrange(6))) for _ in range(45)] + [(1, 3)] * 8
    d, theta, root_d, root_theta = 0.6, 2.0, 0.4, 1.5
    slow, slow_t = seated_one_by_one(tokens, d, theta, root_d, root_theta, 2500, random.Random(6))
    chain = Chain(Counter(u << H.BITS | w for u, w in tokens), d, theta, root_d, root_theta, 7)
    total, tables = 0.0, 0.0
    for k in range(1700):
        p, _, t = chain.step()
        if k >= 200:
            total, tables = total + p / 1500, tables + t / 1500
    for u, w, p, t in zip(chain.context, chain.word, total, tables):
        assert abs(p - slow[(u, w)]) < 0.012, (u, w, p, slow[(u, w)])
        assert abs(t - slow_t[(u, w)]) < 0.15, (u, w, t, slow_t[(u, w)])


def test_predictions_sum_to_one():
    rng = np.random.default_rng(3)
    counts = Counter((int(u) << H.BITS | int(w)) for u, w in zip(rng.integers(1, 4, 90), rng.integers(1, 12, 90)))
    chain = Chain(counts, 0.6, 1.5, 0.5, 1.0, 0)
    for _ in range(3):
        seen, p, _ = chain.step()
        for u in np.unique(chain.context):
            own = chain.context == u
            free = np.ones(chain.size, bool)
            free[chain.word[own]] = False
            # words that the corpus doesn't hold are as probable as id 0
            rest = (1.5 + 0.6 * chain.tables[u]) / (1.5 + chain.customers[u]) * (p[free].astype(float).sum() + p[0] * (H.WORDS - chain.size))
            assert abs(seen[own].sum() + rest - 1) < 1e-3


def test_sorting_is_exact_at_any_size():
    """Over 2**24 keys, whose low bits no index leaves room for: equal ones lie together, and counts are those of numpy."""
    rng = np.random.default_rng(1)
    key = rng.choice(T.mix(np.arange(200_000, dtype=np.uint64)) >> np.uint64(18), (1 << 24) + 5)
    got = key[H.order(key)]
    assert np.array_equal(got, np.sort(key))
    assert len(H._cuts(got)) - 1 == len(np.unique(key))


def bigrams(text):
    words = re.findall(r"(?:[a-z0-9]|[^\x00-\x7F])+", (text or "").lower())
    return list(zip(["<s>"] + words, words))


@pytest.mark.parametrize("parts", [1, 3])
def test_counts_and_sums(spark, docs_of, text_of, odd_rows, parts):
    """Without randomness (every type at one table) the scores follow from plain counts."""
    rng = random.Random(11)
    rows = odd_rows + [(i, " ".join(f"{w}{k}" for k, w in enumerate(text_of(rng, 12).split()))) for i in range(50, 90)]
    found = {r.doc_id: r for r in H.perplexity(docs_of(rows).selectExpr("*", "1 as part", "2 as kind", "3 as log_prob"), parts=parts).collect()}
    n = Counter()
    for i, t, *_ in rows:
        if i is not None:
            n[i] += len(bigrams(t))
    assert {i: r.n_words for i, r in found.items()} == {i: k for i, k in n.items() if k}
    assert all(r.log_prob < 0 and abs(r.perplexity - np.exp(-r.log_prob / r.n_words)) < 1e-6 for r in found.values())


@pytest.mark.parametrize("parts", [1, 3])
def test_scores_against_a_chain_in_one_piece(spark, docs_of, text_of, parts):
    """Plain counts and one chain on the driver score the documents as the partitions do, hot types and all."""
    rng = random.Random(12)
    rows = [(i, text_of(rng, rng.randint(1, 60))) for i in range(60)] + [(70, "the of " * 300)]
    found = {r.doc_id: r.log_prob for r in H.perplexity(docs_of(rows), parts=parts, seed=4).collect()}
    known = H.Vocabulary(np.unique(T.words(pa.array([t for _, t in rows]))[0]))
    keys = []
    for _, text in rows:
        words = known(T.words(pa.array([text]))[0]).astype(int).tolist()
        keys.append([a << H.BITS | b for a, b in zip([0] + words, words)])
    chain = Chain(Counter(k for own in keys for k in own), 0.75, 5.0, 0.5, 10.0, 4)
    assert chain.key.max() < 1 << 2 * H.BITS
    # the chain's keys have other bits, and so other draws: it takes those of the module's keys
    narrow = (chain.key >> np.uint64(H.BITS) << np.uint64(known.bits)) | (chain.key & np.uint64(H.WORDS - 1))
    chain_draw, total = H._draw, 0.0
    try:
        H._draw = lambda fields, key, n, d, seed, bits=H.BITS: chain_draw(fields, narrow[np.searchsorted(chain.key, key)], n, d, seed, known.bits)
        for k in range(5):
            p = chain.step()[0]
            total = total + p / 3 if k >= 2 else 0.0
    finally:
        H._draw = chain_draw
    logs = dict(zip(chain.key.tolist(), np.log(total)))
    for (i, _), own in zip(rows, keys):
        assert abs(found[i] - sum(logs[k] for k in own)) < 2e-3 * max(1, len(own))


def test_repetition_is_expected(spark, docs_of, text_of):
    rng = random.Random(13)
    common = text_of(rng, 30)
    rows = [(i, common) for i in range(40)] + [(99, " ".join(f"odd{k}" for k in range(30)))]
    found = {r.doc_id: r.perplexity for r in H.perplexity(docs_of(rows)).collect()}
    assert found[0] * 10 < found[99]
    assert H.perplexity(docs_of([])).count() == 0 and H.perplexity(docs_of([(1, None), (2, "!")])).count() == 0


def test_unpacked_keys():
    key, at = H._keys(pa.array(["a b", "", None, "a"]))
    assert list(at) == [0, 2, 2, 2, 3] and key[0] == key[2] and key[0] >> np.uint64(H.BITS) == 0
    assert T.unpack(T.pack(key))[0].tolist() == key.tolist()


def test_words_of_one_place_stay_apart(spark, docs_of):
    """Before, words were hashed to 2**20 ids: a rare one took the counts of a frequent one of its id."""
    words = [f"w{i}" for i in range(6000)]
    place = (T.words(pa.array([" ".join(words)]))[0] % np.uint64(H.WORDS - 1)).tolist()
    first, pair = {}, None
    for w, p in zip(words, place):
        pair = pair or ((first[p], w) if p in first else None)
        first[p] = w
    often, rare = pair
    rows = [(i, f"x {often}") for i in range(40)] + [(50, f"x {rare}"), (51, "x other")]
    found = {r.doc_id: r.log_prob for r in H.perplexity(docs_of(rows), parts=2).collect()}
    assert abs(found[50] - found[51]) < 1e-4 and found[0] > found[50] + 1


def test_vocabulary_grows_with_the_words():
    hashes = T.mix(np.arange(H.WORDS + 100_000, dtype=np.uint64))
    known = H.Vocabulary(hashes)
    assert np.array_equal(np.sort(known(hashes)), np.arange(1, known.size)) and known.bits == 21
    told, drawn = H.Root(0.5, 10.0, 1).step(np.r_[0, np.ones(len(hashes), np.int64)])
    assert len(told) == len(drawn) == known.size and abs(told[1:].astype(float).sum() - 1) < 1e-4 and abs(drawn.astype(float).sum() - 1) < 1e-4


def test_a_partition_is_scored_in_turns(monkeypatch):
    """Its memory follows SCORED, not the partition, and the sums are the same."""
    import pyarrow as pa

    class Held:
        def __init__(self, value):
            self.value = value

    rng = np.random.default_rng(6)
    size, most, whole = 64, [], H.probabilities
    monkeypatch.setattr(H, "probabilities", lambda samples, customers, key, n, *rest: most.append(int(n.sum())) or whole(samples, customers, key, n, *rest))
    kept = [Held(((rng.random(size).astype(np.float32) + 1, np.full(size, 1 / size), k), np.full(size, 9, np.int64), np.full(size, 1 / size))) for k in range(2)]
    payloads = []
    for k in range(5):
        key = np.sort(rng.integers(0, size, 4000) << 20 | rng.integers(0, size, 4000)).astype(np.uint64)
        payloads.append(H.T.pack(key, rng.integers(0, 30, 4000).astype(np.uint16), np.arange(30) + 25 * k))
    table = pa.table({"part": pa.array([0] * 5, pa.int32()), "kind": pa.array([0] * 5, pa.int32()), "payload": pa.array(payloads, pa.binary())})
    kernel, found = H._score(kept, Held(np.full(size, 400.0, np.float32)), 0.75, 5.0, 3, 1, 20), []
    for scored in (10**9, 2000):
        monkeypatch.setattr(H, "SCORED", scored)
        most.clear()
        got = [H.T.unpack(x) for x in kernel(table).column("payload").to_pylist()]
        found.append([np.concatenate([x[i] for x in got]) for i in range(3)])
    assert max(most) < 4000 and sum(most) == 20000
    assert np.array_equal(found[0][0], found[1][0]) and np.array_equal(found[0][1], found[1][1]) and np.allclose(found[0][2], found[1][2], rtol=1e-5)
