from __future__ import annotations

import numpy as np

from tidemark.llm import pitman_yor as P


def test_a_draw_depends_on_its_own_type_alone():
    """Whatever is drawn beside it, so that every partition has the same tables."""
    rng = np.random.default_rng(4)
    c = np.concatenate([rng.integers(257, 900, 300), [30_000, 200_000, 1_000_000]])
    g = np.concatenate([rng.random(300) * 3, [1e-9, 1e-4, 40.0]])
    key = np.arange(len(c)).astype(np.uint64)
    whole = P.seat(c, g, 0.5, P.Keyed(key, 1))
    assert list(whole) == [int(P.seat(c[k : k + 1], g[k : k + 1], 0.5, P.Keyed(key[k : k + 1], 1))[0]) for k in range(len(c))]


def test_executors_seat_the_root_as_the_driver_does(spark, monkeypatch):
    monkeypatch.setattr(P, "SEATED", 500)
    customers = np.random.default_rng(5).zipf(1.3, 4000).clip(max=3000)
    customers[::7] = 0
    here, there = P.Root(0.5, 10.0, 3), P.Root(0.5, 10.0, 3, spark)
    for _ in range(2):
        for a, b in zip(here.step(customers), there.step(customers)):
            assert np.array_equal(a, b)


def test_the_driver_seats_few_dishes_only(spark, monkeypatch):
    """With many dishes none is seated in the driver."""
    monkeypatch.setattr(P, "SEATED", 500)
    asked, seat = [], P.seat

    def told(*a):
        asked.append(len(a[0]))
        return seat(*a)

    monkeypatch.setattr(P, "seat", told)
    P.Root(0.5, 10.0, 3, spark).step(np.full(4000, 3))
    assert not asked
