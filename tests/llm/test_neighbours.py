"""Nearest neighbours against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from coldwatch.llm import neighbours

SCHEMA = "rank int, vec_id long, embedding array<float>, score string"


def brute(rows: list[tuple], step: int, k: int = 10) -> list[tuple]:
    held: dict = {}
    for _, vec_id, v, _ in rows:
        if vec_id is None or v is None or not v or None in v:
            continue
        w = [float(np.float32(x)) for x in v]
        if not all(map(math.isfinite, w)) or not any(w):
            continue
        held[vec_id] = min(held[vec_id], w) if vec_id in held else w
    out = []
    for q in sorted(i for i in held if i % step == 0):
        near = sorted(
            (neighbours.distances(np.array([held[q]]), np.array([held[c]]))[0], c)
            for c in held if c != q and len(held[c]) == len(held[q])
        )
        out += [(q, n + 1, c, s) for n, (s, c) in enumerate(near[:k])]
    return out


def found(spark, rows: list[tuple], step: int) -> list[tuple]:
    df = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % step == 0)
    return sorted(map(tuple, df.collect()))


def random_rows(n: int, width: int, seed: int, scale: float = 1.0) -> list[tuple]:
    rng = np.random.default_rng(seed)
    v = (rng.normal(0, scale, (n, width))).astype(np.float32)
    v[n // 3 : n // 2] = v[0]  # a third of copies, and ties
    return [(0, i, x.tolist(), "s") for i, x in enumerate(v)]


@pytest.mark.parametrize("width, scale", [(8, 1.0), (3, 1e-3), (2, 1e18)])
def test_against_brute_force(spark, monkeypatch, width, scale):
    monkeypatch.setattr(neighbours, "CANDIDATE_STRIP", 150)
    monkeypatch.setattr(neighbours, "QUERY_STRIP", 20)
    rows = random_rows(600, width, 4, scale)
    assert found(spark, rows, 10) == brute(rows, 10)


def test_unusable_vectors_and_repeats(spark):
    rows = [
        (0, 0, [1.0, 2.0], "s"), (0, 1, None, "s"), (0, 2, [], "s"), (0, 3, [0.0, 0.0], "s"),
        (0, 4, [1.0, None], "s"), (0, 5, [1.0, float("nan")], "s"), (0, 6, [float("inf"), 1.0], "s"),
        (0, 7, [1.0, 2.0], "s"), (0, 7, [1.0, 2.0], "s"), (0, 8, [3.0, 2.0], "s"),
        (0, 8, [0.5, 9.0], "s"), (0, 9, [1.0, 2.0, 3.0], "s"), (0, 10, [-1.0, 1e-40], "s"),
        (0, None, [1.0, 1.0], "s"), (0, 20, [1.0, 2.0], "s"), (0, 20, [1.0, 2.0], "s"),
    ]
    assert found(spark, rows, 10) == brute(rows, 10)


def test_empty_and_lone(spark):
    assert found(spark, [], 10) == []
    assert found(spark, [(0, 10, [1.0], "s")], 10) == []


def test_tile_products_are_exact_in_many_dimensions():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(-127, 128, (5, 3000)).astype(np.int8) for _ in range(2))
    assert (neighbours.tile_product(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()
