"""Nearest neighbours as a block matrix join over int8 tiles, with exact results.

Queries and candidates are dealt by id to strips of bounded size. A cell of the block matrix
is a query strip against a candidate strip and is one group of rows. In a cell, vectors
are quantised to int8 with a scale each. Products of int8 tiles give distances of the
quantised vectors, and the quantisation errors of both bound how far these are from the
true ones. A pair survives if its lower bound is within the k-th smallest upper bound
of its query. Survivors are recomputed from the original vectors in double precision
and merged in a heap of k per query, whose worst entry prunes the next tiles. The cells'
heaps are merged by a grouped limit, which cuts to k before it shuffles.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coldwatch.llm.common import ready

QUERY_STRIP = 8192
CANDIDATE_STRIP = 4096
QUERY_TILE = 128
CANDIDATE_TILE = 2048
EXACT_DIMENSIONS = 1024  # of int8 products whose sum a float32 holds exactly
PAIRS_AT_ONCE = 1 << 15
SLACK = 1e-7  # for rounding in the bounds, times the norms


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the norms of what the codes miss."""
    scale = np.abs(vectors).max(axis=1) / 127
    scale[scale == 0] = np.finfo(np.float64).tiny  # subnormal components
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    missed = np.sqrt(((vectors - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, missed


def tile_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of two int8 tiles, through float32 matrix products."""
    total = None
    for at in range(0, a.shape[1], EXACT_DIMENSIONS):
        x = a[:, at : at + EXACT_DIMENSIONS].astype(np.float32)
        y = b[:, at : at + EXACT_DIMENSIONS].astype(np.float32)
        part = (x @ y.T).astype(np.float64)
        total = part if total is None else total + part
    return total


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise Euclidean distance; components are added in order, as a plain sum would."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += (x[:, d] - y[:, d]) ** 2
    return np.sqrt(total)


class _Side:
    """Ids, vectors and codes of one side of a cell, by ascending id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        if len(ids) > 1 and (ids[1:] == ids[:-1]).any():  # of repeated ids, the least vector
            order = np.lexsort((*vectors.T[::-1], ids))
            ids, vectors = ids[order], vectors[order]
            first = np.concatenate(([True], ids[1:] != ids[:-1]))
            ids, vectors = ids[first], vectors[first]
        self.ids, self.vectors = ids, vectors
        self.codes, self.scale, self.missed = quantise(vectors)
        squares = (self.codes.astype(np.int32) ** 2).sum(axis=1)
        self.squares = squares * self.scale**2
        self.slack = self.missed + SLACK * np.sqrt((vectors**2).sum(axis=1))


def _merge(best: list, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Pushes candidates on a heap whose top is the worst of the k best."""
    for score, vec_id in zip(scores.tolist(), ids.tolist()):
        entry = (-score, -vec_id)
        if len(best) < k:
            heapq.heappush(best, entry)
        elif entry > best[0]:
            heapq.heapreplace(best, entry)


def _tile(queries: _Side, q: slice, cands: _Side, c: slice, best: list[list], k: int) -> None:
    product = tile_product(queries.codes[q], cands.codes[c])
    squared = queries.squares[q, None] + cands.squares[None, c]
    squared -= 2 * (queries.scale[q, None] * cands.scale[None, c]) * product
    middle = np.sqrt(np.maximum(squared, 0))
    reach = queries.slack[q, None] + cands.slack[None, c]
    own = queries.ids[q, None] == cands.ids[None, c]
    upper = np.where(own, np.inf, middle + reach)
    bound = np.full(len(upper), np.inf)
    if upper.shape[1] >= k:
        bound = np.partition(upper, k - 1, axis=1)[:, k - 1]
    for row, heap in enumerate(best[q]):
        if len(heap) == k:
            bound[row] = min(bound[row], -heap[0][0])
    rows, cols = np.nonzero((middle - reach <= bound[:, None]) & ~own)
    for at in range(0, len(rows), PAIRS_AT_ONCE):
        r, j = rows[at : at + PAIRS_AT_ONCE], cols[at : at + PAIRS_AT_ONCE] + c.start
        exact = distances(queries.vectors[r + q.start], cands.vectors[j])
        edges = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1], [True])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            _merge(best[q.start + int(r[a])], exact[a:b], cands.ids[j[a:b]], k)


def cell_neighbours(queries: _Side, cands: _Side, k: int) -> list[list]:
    """A heap of (-distance, -id) per query, over the tiles of a cell."""
    best: list[list] = [[] for _ in queries.ids]
    for qa in range(0, len(queries.ids), QUERY_TILE):
        for ca in range(0, len(cands.ids), CANDIDATE_TILE):
            q = slice(qa, min(qa + QUERY_TILE, len(queries.ids)))
            c = slice(ca, min(ca + CANDIDATE_TILE, len(cands.ids)))
            _tile(queries, q, cands, c, best, k)
    return best


def _vectors(group: pa.Table, of: np.ndarray) -> _Side:
    picked = group.filter(pa.array(of))
    flat = picked.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    ids = picked.column("id").to_numpy()
    return _Side(ids, flat.astype(np.float64).reshape(len(ids), -1))


def _cell(k: int):
    def rows(group):
        asks = group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        found: tuple[list, list, list] = ([], [], [])
        if asks.any() and not asks.all():
            queries, cands = _vectors(group, asks), _vectors(group, ~asks)
            for query_id, heap in zip(queries.ids.tolist(), cell_neighbours(queries, cands, k)):
                for score, vec_id in heap:
                    for column, value in zip(found, (query_id, -vec_id, -score)):
                        column.append(value)
        return pa.table(
            [pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()),
             pa.array(found[2], pa.float64())],
            names=["query_id", "vec_id", "score"],
        )

    return rows


def nearest(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row that ``queries`` picks.

    ``vectors`` has ``vec_id`` and ``embedding``; ``queries`` is a condition on ``vec_id``.
    Score is the Euclidean distance, nearest first, ties to the smaller id; a query with
    fewer candidates gets all. Unusable vectors (null, empty, zero, or with null or
    non-finite components) and rows without id take no part, and only vectors of
    one length are compared. Rows that repeat an id count once, with the least of their vectors. Other
    columns are ignored. An empty table gives no rows.
    """
    ready(vectors.sparkSession)
    all_rows = vectors.select(
        F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"),
        queries.alias("asked"),
    ).where(F.col("id").isNotNull() & usable(F.col("vector")))
    n, asked = all_rows.agg(F.count("*"), F.count_if("asked")).first()
    across, down = -(-max(n, 1) // CANDIDATE_STRIP), -(-max(asked, 1) // QUERY_STRIP)

    def strip(strips: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(strips)).cast("int")

    def every(strips: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(strips - 1)))

    common = ["id", "vector", F.size("vector").alias("length")]
    cands = all_rows.select(
        *common, F.lit(False).alias("asks"), strip(across).alias("column"),
        every(down).alias("row"),
    )
    asking = all_rows.where("asked").select(
        *common, F.lit(True).alias("asks"), every(across).alias("column"),
        strip(down).alias("row"),
    )
    cells = cands.unionByName(asking).groupBy("length", "row", "column")
    found = cells.applyInArrow(_cell(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
