from __future__ import annotations

from itertools import permutations

import numpy as np
import pytest

from tidemark.operators import linkage as L

POINTS = np.array([(0, 0), (0, 1), (1, 0), (0, 4), (0, 3), (1, 4), (4, 0), (3, 0), (4, 1), (4, 4), (3, 4), (4, 3)], float)


def slow_linkage(x, method):
    """Merges by the definitions on members, not by updates."""
    groups = {i: [i] for i in range(len(x))}
    centre = {i: x[i].copy() for i in groups}
    weights = {i: {i: 1.0} for i in groups}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out, n = [], len(x)

    def distance(a, b):
        pairs = [d[i, j] for i in groups[a] for j in groups[b]]
        if method == "single":
            return min(pairs)
        if method == "complete":
            return max(pairs)
        if method == "average":
            return float(np.mean(pairs))
        if method == "weighted":
            return sum(weights[a][i] * weights[b][j] * d[i, j] for i in groups[a] for j in groups[b])
        gap = np.linalg.norm(centre[a] - centre[b])
        if method == "ward":
            return float(np.sqrt(2 * len(groups[a]) * len(groups[b]) / (len(groups[a]) + len(groups[b]))) * gap)
        return float(gap)

    while len(groups) > 1:
        keys = sorted(groups)
        best = min(((distance(a, b), a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]), key=lambda t: t[0])
        h, a, b = best
        k = n + len(out)
        out.append(h)
        na, nb = len(groups[a]), len(groups[b])
        centre[k] = (centre[a] + centre[b]) / 2 if method == "median" else (na * centre[a] + nb * centre[b]) / (na + nb)
        weights[k] = {i: w / 2 for g in (a, b) for i, w in weights[g].items()}
        groups[k] = groups.pop(a) + groups.pop(b)
    return np.array(out)


@pytest.mark.parametrize("method", L.METHODS)
@pytest.mark.parametrize("seed", range(3))
def test_heights_by_definition(method, seed):
    x = np.random.default_rng(seed).standard_normal((14, 3))
    z = L.linkage(x, method)
    assert np.allclose(z[:, 2], slow_linkage(x, method))
    assert z[-1, 3] == 14 and sorted(z[:, :2].ravel()) == list(range(26))


def test_twelve_points():
    z = L.linkage(POINTS, "centroid")
    assert np.allclose(np.sort(z[:, 2]), [1] * 4 + [1.118034] * 4 + [10 / 3] * 3, atol=1e-5)
    assert len(set(L.cut(z, 1.1))) == 8 and len(set(L.cut(z, 2.0))) == 4
    s = L.linkage(POINTS, "single")
    assert len(set(L.cut(s, 1.1))) == 4 and len(set(L.cut(s, 2.0))) == 1


def test_cut_minds_inversions():
    z = np.array([[0, 1, 2.0, 2], [2, 3, 1.0, 3]])
    assert list(L.heights(z)) == [2.0, 2.0]
    assert list(L.cut(z, 1.5)) == [1, 2, 0] or len(set(L.cut(z, 1.5))) == 3
    assert len(set(L.cut(z, 2.0))) == 1


def test_degenerate_groups():
    assert L.linkage(np.zeros((1, 2))).shape == (0, 4)
    assert list(L.cluster(np.ones((1, 2)), 0.5)) == [0]
    assert set(L.cluster(np.ones((30, 2)), 0.5)) == {0}
    assert set(L.cluster(np.random.default_rng(0).standard_normal((5, 3)), 1e-9, most=1)) == {0}


def test_bounds():
    assert L.bounds(10) == (None, 1, 10) and L.bounds(10, 3) == (3, 3, 3) and L.bounds(2, 5) == (2, 2, 2)
    with pytest.raises(ValueError):
        L.bounds(10, None, 5, 3)
    assert [L.min_size(n) for n in (1, 25, 45, 1000)] == [1, 2, 4, 15]


def test_wanted_number_and_small_clusters():
    rng = np.random.default_rng(1)
    centres = np.array([(10, 0, 0), (0, 10, 0), (0, 0, 10)], float)
    x = np.concatenate([c + 0.3 * rng.standard_normal((20, 3)) for c in centres] + [centres[:1] + rng.standard_normal((1, 3))])
    found = L.cluster(x, 0.3)
    assert len(set(found)) == 3 and all(len(set(found[k * 20 : k * 20 + 20])) == 1 for k in range(3)) and found[-1] == found[0]
    assert len(set(L.cluster(x, 1e-6, num=3))) == 3
    assert len(set(L.cluster(x, 0.3, num=2))) == 2
    assert sorted(set(L.cluster(x, 1e-6))) == list(range(len(set(L.cluster(x, 1e-6)))))


@pytest.mark.parametrize("shape", [(2, 3), (3, 3), (3, 2), (1, 4)])
def test_matching_is_optimal(shape):
    s = np.random.default_rng(3).random(shape)
    got = L.best_matching(s)
    total = sum(s[i, k] for i, k in enumerate(got) if k >= 0)
    r, c = shape
    best = max((sum(s[i, p[i]] for i in range(r)) for p in permutations(range(c), r)) if r <= c else (sum(s[p[j], j] for j in range(c)) for p in permutations(range(r), c)))
    assert abs(total - best) < 1e-12 and (got == -2).sum() == max(0, r - c)
    assert list(L.best_matching(np.full((2, 2), np.nan))) in ([0, 1], [1, 0])
