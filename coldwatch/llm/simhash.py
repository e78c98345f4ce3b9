"""SimHash near-duplicates: which fingerprints differ in few bits, exactly.

Fingerprints are embedded as bit counts of their 2-bit segments. The Manhattan distance
of two embeddings is a lower bound of the Hamming distance, so a pair within ``BITS``
bits has embeddings within ``BITS``. The grid: the 32 coordinates are dealt to
``GROUPS`` groups. A distance of at most ``BITS`` touches at most ``BITS`` groups, so
such a pair agrees in all coordinates of some ``GROUPS - BITS`` groups. Each choice
of that many groups is a grid, the agreed coordinates are the cell, and points meet
in at least one cell of one grid. Within a cell a pair is first held against the
Manhattan bound and then verified bit by bit.

Counts 0, 1, 2 are kept as thermometer codes 00, 01, 11: the Manhattan distance is
then the number of differing code bits, and a cell is the code under a mask.

A cell of many points is cut into strips, and pairs of strips are compared in tasks of
their own. From each portion only a spanning forest of the verified links is
passed on: it connects the same fingerprints and is never larger than the points.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldwatch.llm.common import portions, ready, stored, texts_of, with_text
from coldwatch.llm.components import components
from coldwatch.llm.joins import skew_join

WORDS = 4
SEED = 42
BITS = 4
GROUPS = 7
STRIP = 4096  # points of a cell compared in one task
PAIRWISE = 24  # points up to which a cell's pairs are compared offset by offset
HASHES_AT_ONCE = 1 << 16

LOW = np.uint64(0x5555555555555555)
ONE = np.uint64(1)


def fingerprint(text: str) -> int:
    """64-bit SimHash of the 4-word shingles of a whole text."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(WORDS, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), HASHES_AT_ONCE):
        span = zip(starts[at : at + HASHES_AT_ONCE], ends[at : at + HASHES_AT_ONCE])
        hashes = np.array([digest(joined[s:e], SEED) for s, e in span], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    over = set_bits * 2 > len(starts)
    return int.from_bytes(np.packbits(over, bitorder="little").tobytes(), "little")


def _fingerprints(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(source):
        found = np.array([fingerprint(t) for t in texts_of(batch)], dtype=np.uint64)
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(found.view(np.int64)), batch.column("text_hash")],
            names=["doc_id", "print", "text_hash"],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print, text_hash): the fingerprint is a signed long, its 64 bits unchanged."""
    ready(docs.sparkSession)
    texts = with_text(docs, F.col("doc_id").cast("long").alias("doc_id"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    return texts.mapInArrow(_fingerprints, "doc_id long, print long, text_hash long")


def segment_code(prints: np.ndarray) -> np.ndarray:
    """Bit counts of the 2-bit segments as thermometer codes."""
    high = prints >> ONE
    return ((prints | high) & LOW) | ((prints & high & LOW) << ONE)


def _code_column(bits: Column) -> Column:
    low = F.lit(int(LOW))
    high = F.shiftrightunsigned(bits, 1)
    either = bits.bitwiseOR(high).bitwiseAND(low)
    both = F.shiftleft(bits.bitwiseAND(high).bitwiseAND(low), 1)
    return either.bitwiseOR(both)


def grid_masks(groups: int = GROUPS, bits: int = BITS) -> list[int]:
    """A 64-bit mask for each choice of ``groups - bits`` groups of 2-bit segments."""
    edges = [32 * g // groups for g in range(groups + 1)]
    group = [
        sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges[:-1], edges[1:])
    ]
    return [sum(chosen) for chosen in combinations(group, groups - bits)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cells(points: DataFrame) -> DataFrame:
    """Every point once per grid, with its cell."""
    grids = F.array(*[F.lit(_signed(m)) for m in grid_masks()])
    code = _code_column(F.col("print"))
    return points.select("print", F.posexplode(grids).alias("grid", "mask")).select(
        "print", F.xxhash64("grid", code.bitwiseAND(F.col("mask"))).alias("cell")
    )


def _near(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, bits: int) -> np.ndarray:
    """Where x and y link: the Manhattan bound first, the exact count for what it leaves."""
    near = np.flatnonzero(np.bitwise_count(cx ^ cy) <= bits)
    return near[np.bitwise_count(x[near] ^ np.broadcast_to(y, x.shape)[near]) <= bits]


class _Forest:
    """Keeps of the links it is given only those that join two trees."""

    def __init__(self):
        self.above: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        above = self.above
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = up
        return x

    def add(self, a: Iterable[int], b: Iterable[int]) -> None:
        for x, y in zip(a, b):
            p, q = self._root(x), self._root(y)
            if p != q:
                self.above[max(p, q)] = min(p, q)
                self.links.append((x, y))


def _search(points: np.ndarray, other: np.ndarray | None, bits: int, forest: _Forest) -> None:
    """Links within ``points``, or between ``points`` and ``other``, by breadth-first search.

    A point leaves the unvisited ones when it is reached, and is then held once against
    those still unvisited; that gives a spanning forest without all the links.
    """
    both = points if other is None else np.concatenate((points, other))
    side = np.arange(len(both)) < len(points)
    code = segment_code(both)
    left = np.arange(len(both))
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            at = reached.pop()
            pool = left if other is None else left[side[left] != side[at]]
            hit = pool[_near(both[pool], both[at], code[pool], code[at], bits)]
            if len(hit):
                forest.add([int(both[at])] * len(hit), both[hit].tolist())
                reached.extend(hit.tolist())
                left = left[~np.isin(left, hit)]


def _links_of(cells: np.ndarray, prints: np.ndarray, bits: int, forest: _Forest) -> None:
    """Links among runs of equal ``cells``."""
    starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    sizes = np.diff(np.append(starts, len(cells)))
    for s, n in zip(starts[sizes > PAIRWISE].tolist(), sizes[sizes > PAIRWISE].tolist()):
        _search(prints[s : s + n], None, bits, forest)
    small = np.repeat((sizes > 1) & (sizes <= PAIRWISE), sizes)
    cells, prints = cells[small], prints[small]
    code = segment_code(prints)
    for step in range(1, PAIRWISE):
        at = np.flatnonzero(cells[step:] == cells[:-step])
        if not len(at):
            break
        hit = at[_near(prints[at], prints[at + step], code[at], code[at + step], bits)]
        forest.add(prints[hit].tolist(), prints[hit + step].tolist())


def _emit(forest: _Forest) -> pa.RecordBatch:
    found = np.array(forest.links, dtype=np.uint64).reshape(-1, 2)
    return pa.record_batch(
        [pa.array(found[:, 0].view(np.int64)), pa.array(found[:, 1].view(np.int64))]
        if len(found)
        else [pa.array([], pa.int64()), pa.array([], pa.int64())],
        names=["a", "b"],
    )


def _cell_links(bits: int):
    """Over rows sorted by cell. A run may go on in the next batch, so its last is held back."""

    def rows(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cells, held_prints = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in source:
            cells = np.concatenate((held_cells, batch.column("cell").to_numpy()))
            prints = np.concatenate(
                (held_prints, batch.column("print").to_numpy().view(np.uint64))
            )
            if not len(cells):
                continue
            cut = int(np.searchsorted(cells, cells[-1]))
            held_cells, held_prints = cells[cut:], prints[cut:]
            if cut:
                forest = _Forest()
                _links_of(cells[:cut], prints[:cut], bits, forest)
                yield _emit(forest)
        if len(held_cells):
            forest = _Forest()
            _links_of(held_cells, held_prints, bits, forest)
            yield _emit(forest)

    return rows


def _strip_links(bits: int):
    def rows(group):
        prints = group.column("print").to_numpy().view(np.uint64)
        first = group.column("first").to_numpy(zero_copy_only=False)
        forest = _Forest()
        if first.all():
            _search(prints, None, bits, forest)
        else:
            _search(prints[first], prints[~first], bits, forest)
        return pa.Table.from_batches([_emit(forest)])

    return rows


def links(points: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): links that connect just those ``print`` values which ``bits`` bits connect."""
    ready(points.sparkSession)
    cells = _cells(points)
    full = stored(
        cells.groupBy("cell").count().where(F.col("count") > STRIP).select(
            "cell", F.ceil(F.col("count") / STRIP).cast("int").alias("strips")
        ),
        "full-cells",
    )
    # A table of the few full cells; its file size decides how it is joined.
    usual = cells.join(full, "cell", "left_anti")
    found = (
        usual.repartition("cell")
        .sortWithinPartitions("cell")
        .mapInArrow(_cell_links(bits), "a long, b long")
    )
    own = F.pmod(F.xxhash64("print", F.lit(1)), F.col("strips")).cast("int")
    strips = cells.join(full, "cell").withColumn("own", own)
    tiles = strips.select(
        "cell", "print", "own", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("to")
    ).select(
        "cell", "print",
        F.least("own", "to").alias("low"), F.greatest("own", "to").alias("high"),
        (F.col("own") <= F.col("to")).alias("first"),
    )
    across = tiles.groupBy("cell", "low", "high").applyInArrow(_strip_links(bits), "a long, b long")
    return found.unionByName(across)


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, print, component_id) for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest ``doc_id`` that links of at most ``bits`` differing
    bits reach, itself included. Null and wordless texts have fingerprint zero and link
    like any other. Rows that repeat a ``doc_id`` stay rows, each with its text's
    fingerprint; a null ``doc_id`` keeps its row and names no component. Other columns
    are ignored. An empty table gives no rows.
    """
    return components_of(docs, bits).select("doc_id", "print", "component_id")


def components_of(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``near_duplicates`` with the text's hash and ``root``, which names the component.

    ``component_id`` alone does not, where one ``doc_id`` has texts of several components.
    """
    prints = stored(fingerprints(docs), "fingerprints")
    points = stored(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "points")
    roots = components(links(points.select("print"), bits), "a", "b")
    rooted = stored(
        points.join(roots.withColumnRenamed("node", "print"), "print", "left").select(
            "print", "least", F.coalesce("root", "print").alias("root")
        ),
        "rooted",
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(
        skew_join(rooted, named, "root").select("print", "root", "component_id"), "classes"
    )
    return skew_join(prints, classes, "print")
