"""Embedding whitening: vectors on the leading components of their covariance, at unit variance.

Entries become integers, so counts and sums are exact. Copies collapse before anything is
fitted. The covariance is summed over centred vectors in every task, a few numbers per task
are shuffled by matrix entry, and only the matrix, as wide as the vectors, reaches the driver.
Its leading eigenpairs are found by spectrum slicing (see ``spectrum``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldwatch.llm.common import portions, ready, stored
from coldwatch.llm.spectrum import leading

SCALE = 64
MOST = 16  # components
FARTHEST = 2.0**56  # scaled entries beyond it count as it, so that sums stay exact
HALF = 28  # bits; sums of the high and low parts of entries stay inside a long
EXACT = 9.2e18  # just below what a long holds


@dataclass(frozen=True)
class Whitening:
    """What is fitted: as wide as a vector, or as the number of components."""

    n: int
    quotient: np.ndarray  # per dimension the sum divided by n, as integers
    remainder: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def width(self) -> int:
        return len(self.quotient)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.quotient).astype(np.float64) - self.remainder / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; None where a long cannot hold it."""
        near = ((self.centred(x) * self.n) ** 2).sum(axis=1)
        found: list[int | None] = [None] * len(x)
        fits = np.flatnonzero(near < EXACT)
        whole = (x[fits] - self.quotient) * self.n - self.remainder
        for at, value in zip(fits.tolist(), (whole * whole).sum(axis=1).tolist()):
            found[at] = value
        return found


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): usable vectors as integers, floor of 64 times each entry.

    The constant that the contract adds to x cancels wherever x is used.
    """

    def finite(c: Column) -> Column:
        c = c.cast("double")
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))

    def whole(c: Column) -> Column:
        far = F.lit(FARTHEST)
        return F.floor(F.greatest(F.least(c.cast("double") * SCALE, far), -far))

    usable = vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", finite))
    return usable.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("x")
    )


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, width)


def _summed(fit: DataFrame, width: int, count: int, task: Callable) -> list[list]:
    """``task`` gives ``count`` lists of numbers per batch; their sums over all tasks.

    Every task sends one row of sums, and the sums of the tasks are added position by position.
    """

    def partial(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in portions(source, 4096):
            part = task(_matrix(batch, width))
            total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            columns = [pa.array([np.asarray(t).ravel().tolist()]) for t in total]
            yield pa.record_batch(columns, names=[f"s{i}" for i in range(count)])

    kind = "long" if task is _halves else "double"
    schema = ", ".join(f"s{i} array<{kind}>" for i in range(count))
    rows = fit.mapInArrow(partial, schema)
    sums = []
    for i in range(count):
        value = F.col("v").cast("decimal(38,0)") if kind == "long" else F.col("v")
        added = rows.select(F.posexplode(f"s{i}").alias("at", "v")).groupBy("at").agg(F.sum(value))
        sums.append([v for _, v in sorted(map(tuple, added.collect()))])
    return sums


def _halves(x: np.ndarray) -> list[np.ndarray]:
    high = x >> HALF
    return [high.sum(axis=0), (x - (high << HALF)).sum(axis=0), np.array([len(x)])]


def fit(vectors: DataFrame, most: int = MOST) -> Whitening | None:
    """Fits on each distinct scaled vector once; None where nothing varies.

    ``vectors`` (x) as ``scaled`` gives them. If their widths differ, those of the width
    with the most distinct vectors are fitted (of equally many the widest).
    """
    ready(vectors.sparkSession)
    distinct = stored(vectors.select("x").distinct(), "fit-list")
    widths = distinct.groupBy(F.size("x").alias("width")).count()
    commonest = widths.where("width > 0").orderBy(F.desc("count"), F.desc("width")).first()
    if commonest is None:
        return None
    width = commonest["width"]
    own = distinct.where(F.size("x") == width)
    high, low, counted = _summed(own, width, 3, _halves)
    n = int(counted[0])
    split = [divmod((int(a) << HALF) + int(b), n) for a, b in zip(high, low)]
    quotient, remainder = (np.array(part, np.int64) for part in zip(*split))
    model = Whitening(n, quotient, remainder, np.empty(0), np.empty((width, 0)), 0.0)

    upper = np.triu_indices(width)

    def products(x: np.ndarray) -> list[np.ndarray]:
        c = model.centred(x)
        return [(c.T @ c)[upper]]

    covariance = np.zeros((width, width))
    covariance[upper] = np.array(_summed(own, width, 1, products)[0]) / n
    covariance = np.triu(covariance) + np.triu(covariance, 1).T
    values, vectors_ = leading(covariance, most)
    if not len(values):
        return None
    model = Whitening(n, quotient, remainder, values, vectors_, float(np.trace(covariance)))

    def outcome(x: np.ndarray) -> list[np.ndarray]:
        w = model.whitened(x)
        return [w.T @ w, w.sum(axis=0)]

    squares, sums = (np.array(s) / n for s in _summed(own, width, 2, outcome))
    error = squares.reshape(len(values), -1) - np.outer(sums, sums) - np.eye(len(values))
    return Whitening(
        n, quotient, remainder, values, vectors_, model.trace, float(np.abs(error).max())
    )


OUTPUT = (
    "vec_id long, component int, n long, deviation long, whitened double, "
    "explained double, identity_error double"
)


def apply(vectors: DataFrame, model: Whitening) -> DataFrame:
    """A row per vector and component, for vectors of the fitted width."""
    parts = model.values / model.trace

    def rows(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in portions(source, 2048):
            x = _matrix(batch, model.width)
            each = np.repeat(np.arange(len(x)), k)
            yield pa.record_batch(
                [
                    batch.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), model.n)),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(parts, len(x))),
                    pa.array(np.full(len(each), model.identity_error)),
                ],
                names=[f.split()[0] for f in OUTPUT.split(", ")],
            )

    ready(vectors.sparkSession)
    return vectors.where(F.size("x") == model.width).mapInArrow(rows, OUTPUT)


def whiten(vectors: DataFrame, most: int = MOST) -> DataFrame:
    """Whitened ``vectors`` (vec_id, embedding), one row per vector and component.

    Vectors that are null or hold null or non-finite entries are dropped. Copies count once
    in the fit and all get rows, whatever their ids, null ones too. Vectors of another width
    than the commonest, empty ones among them, get no rows. Scaled entries beyond 2^56 count
    as that. Components are those whose eigenvalue differs from zero by more than rounding,
    so vectors that do not vary, and empty tables, give no rows; equal eigenvalues get
    orthogonal vectors. ``deviation`` is null where a long cannot hold it. Other columns are
    ignored.
    """
    usable = scaled(vectors)
    model = fit(usable, most)
    if model is None:
        return vectors.sparkSession.createDataFrame([], OUTPUT)
    return apply(usable, model)
