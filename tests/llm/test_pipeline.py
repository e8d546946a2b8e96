import re

import corpus_pipeline as C

SF = "/root/testdata/sf0.001"


def norm(t):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7F])+", t.lower())


def grams(t):
    w = norm(t)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def near(a, b):
    return 5 * len(a & b) >= 2 * len(a | b)


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    names = [n for n, _ in C.STAGES]
    assert len(names) in (4, 5) and names == ["quality", "near_duplicates", "decontaminate", "mix", "tokens"]
    strings = {" " + " ".join(norm(q)[k : k + 8]) + " " for q in items for k in range(max(1, len(norm(q)) - 7))}
    at = docs
    for k, (name, stage) in enumerate(C.STAGES):
        before = at
        made = stage(spark, before, SF)
        made.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert at.columns == docs.columns
        rows = at.collect()
        if name == "quality":
            ids = {r.doc_id for r in rows}
            kept = [i in ids for i, q in labels.items() if q == 1]
            assert sum(kept) / len(kept) > 0.97 and sum(i in ids for i, q in labels.items() if q == 0) <= 0.1 * len(labels)
        if name == "near_duplicates":
            sets = {r.doc_id: grams(r.text) for r in before.collect() if norm(r.text)}
            ids = {r.doc_id for r in rows}
            left = [s for i, s in sets.items() if i in ids]
            assert not any(near(left[i], left[j]) for i in range(len(left)) for j in range(i))
            for i, s in sets.items():
                assert i in ids or any(o < i and near(s, sets[o]) for o in sets)
        if name == "decontaminate":
            ids = {r.doc_id for r in rows}
            for r in before.collect():
                body = f" {' '.join(norm(r.text))} "
                assert any(x in body for x in strings) != (r.doc_id in ids)
        if name == "mix":
            tokens = [w for r in before.collect() for w in r.text.split()]
            assert rows and {w for r in rows for w in r.text.split()} <= set(tokens)
        if name == "tokens":
            assert sum(len(r.tokens) for r in rows) == sum(r.n_tokens for r in rows) and len(rows) == before.count()


def test_run_and_contract(spark):
    assert C.ORACLE_SQL is None
    out = C.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "tokens", "n_tokens"} <= set(out.columns)


def test_stages_take_odd_rows(spark, docs_of, odd_rows):
    for rows in (odd_rows, []):
        for name, stage in C.STAGES:
            stage(spark, docs_of(rows), SF).collect()
