from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import linkage as L


def units(n, width, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("method", ["single", "centroid", "median", "ward"])
@pytest.mark.parametrize("seed", range(6))
def test_merges_are_those_of_all_distances(monkeypatch, method, seed):
    x = units(150, 5 + seed, seed)
    dense = L.linkage(x, method)
    monkeypatch.setattr(L, "DENSE", 4)
    assert np.allclose(L.linkage(x, method), dense, atol=1e-9)


@pytest.mark.parametrize("method", ["single", "centroid"])
def test_memory_follows_the_vectors(method):
    """All distances of 5,000 vectors are 200 MB."""
    x = units(5000, 8)
    tracemalloc.start()
    z = L.linkage(x, method)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6 and z[-1, 3] == 5000 and sorted(z[:, :2].ravel()) == list(range(2 * 5000 - 2))


def test_wanted_number_is_found_without_a_cut_for_each():
    x = np.repeat(np.eye(4), 400, 0) + 0.05 * np.random.default_rng(2).standard_normal((1600, 4))
    found = L.cluster(x, 5.0, num=4)
    assert len(set(found)) == 4 and all(len(set(found[k * 400 : k * 400 + 400])) == 1 for k in range(4))


def test_groups_are_not_put_in_one_task(spark):
    df = spark.createDataFrame([(i, i % 6, v.tolist()) for i, v in enumerate(units(120, 4))], "id long, g int, v array<double>")
    by_task = {(r.g, r.p) for r in L.dendrogram(df, "g", "id", "v").select("g", F.spark_partition_id().alias("p")).distinct().collect()}
    assert len(by_task) == 6 and len({p for _, p in by_task}) > 3


def test_components_of_many_vectors():
    """Chains of steps at the cutoff are one component, with copies among them; a longer step is a gap."""
    at = np.concatenate([np.arange(900) * 0.5, 1000 + np.arange(900) * 0.5])
    x = np.column_stack([at, np.zeros(1800)])[np.random.default_rng(3).permutation(1800)]
    x = np.concatenate([x, x[:50]])
    labels = L.cut(L.linkage(x, "single"), 0.5)
    assert len(set(labels)) == 2 and ((labels == labels[np.argmin(x[:, 0])]) == (x[:, 0] < 1000)).all()
    assert len(set(L.cut(L.linkage(x, "single"), 0.49))) == 1800


def test_flat_clusters_with_copies():
    """Copies merge first, at no distance, and stay together at any cutoff."""
    x = units(400, 16, 5)
    labels = L.cut(L.linkage(np.concatenate([x, x, x]), "centroid"), 0.3)
    assert (labels[:400] == labels[400:800]).all() and (labels[:400] == labels[800:]).all()
    assert np.allclose(L.linkage(np.concatenate([x, x, x]), "centroid")[:800, 2], 0, atol=1e-12)
