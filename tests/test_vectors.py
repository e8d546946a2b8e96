from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import vectors as V
from tidemark.plans import catalogue


def rows(spark, n=260):
    """Two groups and a missing one; vectors that are missing, short, empty, NaN, infinite or too long to square."""
    rng = random.Random(7)

    def vector():
        v = [rng.gauss(0, 1) for _ in range(rng.choice([3, 3, 3, 3, 2, 0]))]
        if v and rng.random() < 0.1:
            v[0] = rng.choice([None, float("nan"), float("inf"), 1e200])
        return None if rng.random() < 0.05 else v

    made = [(rng.choice([None, "a", "b"]), rng.choice([None, *range(80)]), vector(), rng.choice([None, 1, 2, 3, 4])) for _ in range(n)]
    return made, spark.createDataFrame(made, "k string, id int, v array<double>, l int")


def distance(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    total = 0.0
    for x, y in zip(a, b):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def text(found):
    return sorted(map(repr, found))


@pytest.mark.parametrize("block", [1024, 20])
def test_least_distances_of_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    made, df = rows(spark)
    least = {}
    for k, _, v, a in made:
        for m, _, w, b in made:
            if k is not None and k == m and a is not None and b is not None and a < b:
                least.setdefault((k, a, b), []).append(distance(v, w))
    # NULL counts for nothing, NaN is above all
    expected = [(*key, min((x for x in xs if x is not None), key=lambda x: (math.isnan(x), x), default=None)) for key, xs in least.items()]
    assert text(tuple(r) for r in V.cluster_distances(df, ["k"], "id", "v", "l").collect()) == text(expected)


def test_labels_of_one_table_are_spread(spark):
    """The pairs of labels are not one nested loop, and a row goes to BLOCKS cells at most."""
    x = np.random.default_rng(1).standard_normal((6000, 8))
    x[4000:] = x[:2000] + 1e-9
    df = spark.createDataFrame([(i, v.tolist(), i % 3 if i < 4000 else 3) for i, v in enumerate(x)], "id long, v array<double>, l long")
    found = V.cluster_distances(df, [], "id", "v", "l")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "__b" in plan
    cells = V._cells(V._blocks(df, [], ["id"]))
    assert cells.groupBy("__p", "__q").count().count() == 6 * 7 // 2 and cells.count() == 6 * 6000
    # near copies, where a product of matrices alone would round the distance away
    got = {(r.a, r.b): r.distance for r in found.collect()}
    for k in range(3):
        assert math.isclose(got[k, 3], np.sqrt(((x[4000:][np.arange(2000) % 3 == k] - x[:2000][np.arange(2000) % 3 == k]) ** 2).sum(1)).min(), rel_tol=1e-9)


@pytest.mark.parametrize("block", [1024, 20])
def test_pairs_of_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    made, df = rows(spark)
    expected = [(k, i, j, distance(v, w)) for k, i, v, _ in made for m, j, w, _ in made if k is not None and k == m and i is not None and j is not None and i < j]
    assert text(tuple(r) for r in V.pairwise(df, ["k"], "id", "v").collect()) == text(expected)


def test_pairs_of_one_group_are_spread(spark):
    df = spark.range(3000).select(F.col("id"), F.lit(1).alias("k"), F.array(F.col("id").cast("double")).alias("v"))
    found = V.pairwise(df, ["k"], "id", "v")
    per_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 3000 * 2999 // 2 and len(per_task) > 2
    assert found.where("distance <> j - i or i >= j").count() == 0


@pytest.mark.parametrize("block", [1024, 20])
def test_pairs_without_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    made, df = rows(spark)
    expected = [(k, i, j) for k, i, *_ in made for m, j, *_ in made if k is not None and k == m and i is not None and j is not None and i < j]
    assert text(tuple(r) for r in V.pairs(df, ["k"], "id").collect()) == text(expected)


def test_places_of_one_label_are_spread(spark, tmp_path):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"), F.lit(1).alias("label"))
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    found = catalogue.QUERIES["condensed_places"](spark, str(tmp_path))
    per_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 3000 * 2999 // 2 and len(per_task) > 2
    ends = found.agg(F.min("place"), F.max("place"), F.count_distinct("place")).first()
    assert tuple(ends) == (0, sum(per_task) - 1, sum(per_task))
