"""Whitening against exact integer sums and a dense eigenvalue solver."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from coldwatch.llm import queries, spectrum, whitening
from coldwatch.llm.common import table

SCHEMA = "x string, vec_id long, embedding array<float>, component int, n long"


def frame(spark, vectors: list, schema: str = SCHEMA):
    return spark.createDataFrame([("c", i, v, 0, 0) for i, v in enumerate(vectors)], schema)


def brute(vectors: list[list[float]], most: int = 16):
    """Components by a dense solver; deviations in exact arithmetic."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in x])
    own = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in fit])
    covariance = own.T @ own / n
    values, vectors_ = np.linalg.eigh(covariance)
    values, vectors_ = values[::-1][:most], vectors_[:, ::-1][:, :most]
    some = values > spectrum.EPS * len(covariance) * np.trace(covariance)
    whitened = centred @ vectors_[:, some] / np.sqrt(values[some])
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    return n, deviations, whitened, values[some] / np.trace(covariance)


def check(rows, vectors: list[list[float]], ids: list[int]):
    n, deviations, whitened, explained = brute(vectors)
    k = len(explained)
    assert len(rows) == len(vectors) * k
    got = {(r.vec_id, r.component): r for r in rows}
    signs = np.ones(k)
    for c in range(k):
        at = int(np.abs(whitened[:, c]).argmax())
        signs[c] = np.sign(got[ids[at], c + 1].whitened * whitened[at, c])
    for i, vec_id in enumerate(ids):
        for c in range(k):
            r = got[vec_id, c + 1]
            assert (r.n, r.deviation) == (n, deviations[i])
            assert r.whitened == pytest.approx(signs[c] * whitened[i, c], abs=1e-8)
            assert r.explained == pytest.approx(explained[c], rel=1e-9)
            assert 0 <= r.identity_error < 1e-9


def test_given_embeddings_against_a_dense_solver(spark):
    rows = table(spark, "/root/testdata/sf0.001", "embeddings").collect()
    found = queries.op11_whitening(spark, "/root/testdata/sf0.001").collect()
    check(found, [r.embedding for r in rows], [r.vec_id for r in rows])


def test_copies_count_once_and_all_get_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 5)).astype(np.float32).tolist()
    vectors = base + [base[0]] * 200 + [[c + 1e-6 for c in base[1]]]
    check(whitening.whiten(frame(spark, vectors)).collect(), vectors, list(range(len(vectors))))


def test_unusable_rows_are_dropped(spark):
    good = [[1.0, 2.0], [2.0, 1.0], [0.5, 3.0], [-4.0, 0.1]]
    bad = [None, [1.0, None], [float("nan"), 1.0], [1.0, float("inf")], [], [1.0], [1.0, 2.0, 3.0]]
    rows = whitening.whiten(frame(spark, good + bad)).collect()
    check(rows, good, [0, 1, 2, 3])


def test_nothing_varies_or_no_rows(spark):
    assert whitening.whiten(frame(spark, [[1.0, 2.0]] * 3)).count() == 0
    assert whitening.whiten(frame(spark, [None])).count() == 0
    empty = whitening.whiten(frame(spark, [[1.0]]).limit(0))
    assert empty.count() == 0 and empty.columns[0] == "vec_id"


def test_null_and_repeated_ids_keep_their_rows(spark):
    rows = [("", None, [1.0], 0, 0), ("", 7, [2.0], 0, 0), ("", 7, [4.0], 0, 0)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(r.vec_id) for r in found) == ["7", "7", "None"]


def test_fewer_components_than_dimensions(spark):
    vectors = [[float(i), 2.0 * i, 5.0] for i in range(10)]
    found = whitening.whiten(frame(spark, vectors)).collect()
    assert {r.component for r in found} == {1} and found[0].explained == pytest.approx(1)


def test_huge_entries_keep_exact_sums_or_none(spark):
    schema = SCHEMA.replace("float", "double")
    vectors = [[3.0e6, 1.0], [3.0e6 + 1, 2.0], [3.0e6 + 5, 7.0]]
    check(whitening.whiten(frame(spark, vectors, schema)).collect(), vectors, [0, 1, 2])
    far = whitening.whiten(frame(spark, [[1e300, 0.0], [-1e300, 1.0], [0.0, 5.0]], schema)).collect()
    assert len(far) == 6 or len(far) == 3
    assert all(r.deviation is None for r in far if r.vec_id < 2)


@pytest.mark.parametrize("width", [1, 2, 7, 40, 64])
def test_counts_are_those_of_the_eigenvalues(width):
    rng = np.random.default_rng(width)
    for _ in range(20):
        m = rng.standard_normal((width, width))
        m = m + m.T
        values = np.linalg.eigvalsh(m)
        for shift in [*rng.standard_normal(5), *((values[1:] + values[:-1]) / 2)[:3]]:
            assert spectrum.above(m, shift) == (values > shift).sum()
    assert spectrum.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert spectrum.above(np.zeros((3, 3)), 0.0) == 0


def test_close_and_equal_eigenvalues():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((24, 24)))
    for values in (
        [3, 3, 3, 3] + [1] * 20,
        [1, 1 - 1e-13, 1 - 1e-10, 1 - 1e-6] + [0.9] * 2 + list(np.linspace(0.5, 0.1, 18)),
        [1e8, 1, 1e-3] + [0] * 21,
    ):
        m = (q * np.array(values)) @ q.T
        m = (m + m.T) / 2
        found, vectors = spectrum.leading(m, 16)
        least = spectrum.EPS * 24 * np.trace(m)
        assert np.abs(found - np.array(values)[: len(found)]).max() < 10 * least
        assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12
        assert np.abs(m @ vectors - vectors * found).max() < 10 * least
