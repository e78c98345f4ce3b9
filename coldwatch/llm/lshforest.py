"""MinHash near-duplicates by an LSH forest, confirmed on whole shingle sets.

A document is the set of its 3-word shingles; documents of equal sets are one node. Every
node has ``TREES`` signatures of ``DEPTH`` min-hashes. A tree is the sorted order of one
signature, and nodes that share a prefix are a region of it.

Neighbours first: next to each other in an order, and sharing ``LEAST`` min-hashes at
least, are candidates, and so are all pairs of a region of up to ``CROWD`` nodes.
A larger region is looked at one min-hash deeper, so the depth follows the crowd.
Candidates are screened by all min-hashes and confirmed on the sets. Most of a group is
one component then.

The rest exactly: what still is apart and shares ``LEAST`` min-hashes in any tree is
compared too, however large the region; nothing is capped. Only nodes outside a region's
commonest component are held against all others, in blocks, so a hot region costs
in proportion to its size as long as it is one group.

Two sets at the threshold of 0.85 share 5 min-hashes of one tree with probability 0.444,
hence of one of 16 trees with 0.9999. They agree on fewer than ``SCREEN`` of the
128 min-hashes with a probability of some 1e-5.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldwatch.llm.common import portions, ready, stored, texts_of, with_text
from coldwatch.llm.components import components
from coldwatch.llm.joins import only, skew_join

WORDS = 3
LINKED = 85  # percent of the union that linked sets share at least
TREES = 16
DEPTH = 8
LEAST = 5  # min-hashes that candidates share in a tree
CROWD = 8
SCREEN = 0.70
BLOCK = 1024  # nodes of a region on either side of a comparison in one task
UNIT = 4096  # candidates confirmed together
PAIRS_AT_ONCE = 1 << 14
BYTES_AT_ONCE = 1 << 16
SHINGLES_AT_ONCE = 256

_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_IS_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _factors(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)


_A, _B, _C = _factors(WORDS, 3)
_TIMES, _PLUS = (
    (_factors(TREES * DEPTH, seed) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    for seed in (5, 7)
)
_BYTES = _factors(256, 11)
_STEP = int(_factors(1, 13)[0])


@lru_cache(maxsize=4)
def _powers(step: int, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, step, np.uint64), dtype=np.uint64)


def _block_hashes(block: bytes) -> np.ndarray:
    """Hashes of the words of a block: differences of one running sum over its bytes."""
    data = np.frombuffer(block, np.uint8)
    n = BYTES_AT_ONCE if len(data) <= BYTES_AT_ONCE else len(data)
    powers, inverse = _powers(_STEP, n), _powers(pow(_STEP, -1, 1 << 64), n)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _IS_BLANK[data], [True]))))
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTES[data] * powers[: len(data)])))
    found = (sums[ends] - sums[starts]) * inverse[starts]
    return _mixed(found + (ends - starts).astype(np.uint64) * _C)


def _hashes_of_words(text: str) -> np.ndarray:
    """64-bit hashes of a text's words, found a block of the text at a time."""
    data = text.encode("utf-8", "replace").lower()
    found, at = [np.empty(0, np.uint64)], 0
    while at < len(data):
        end = at + BYTES_AT_ONCE - 1
        cut = _BLANK.search(data, end) if end < len(data) else None
        end = cut.start() if cut else len(data)
        found.append(_block_hashes(data[at:end]))
        at = end
    return np.concatenate(found)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct 3-word shingles of a whole text.

    Under three words the whole sequence is the one shingle; without words there is none.
    """
    words = _hashes_of_words(text)
    if len(words) >= WORDS:
        found = np.sort(_mixed(words[:-2] * _A + words[1:-1] * _B + words[2:] * _C))
        return found[np.concatenate(([True], found[1:] != found[:-1]))]
    if not len(words):
        return words
    return _mixed(words[:1] * _A + (words[1:] * _B if len(words) == 2 else _C))


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each of the ``TREES * DEPTH`` min-hashes of a set."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint32).max, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), SHINGLES_AT_ONCE):
        hashed = np.multiply.outer(_TIMES, short[at : at + SHINGLES_AT_ONCE])
        hashed += _PLUS[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    return (_mixed(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def _describe(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(source):
        sizes, digests, signatures = [], [], []
        for text in texts_of(batch):
            found = shingle_set(text)
            sizes.append(len(found))
            some = len(found) > 0
            digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if some else None)
            signatures.append(signature(found).tobytes() if some else None)
        yield pa.record_batch(
            [
                batch.column("row"), batch.column("doc_id"), pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()),
                batch.column("text"),
            ],
            names=["row", "doc_id", "n_shingles", "digest", "signature", "text"],
        )


def described(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_shingles, digest, signature, text) of every row, stored."""
    ready(docs.sparkSession)
    texts = with_text(docs, F.col("doc_id").cast("long").alias("doc_id")).withColumn(
        "row", F.monotonically_increasing_id()
    )
    kinds = (
        "row long, doc_id long, n_shingles long, digest binary, signature binary, text string"
    )
    return stored(texts.mapInArrow(_describe, kinds), "described")


# --- neighbours in the sorted orders -------------------------------------------------


def _pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    low, high = np.minimum(a, b), np.maximum(a, b)
    return pa.record_batch([pa.array(low), pa.array(high)], names=["a", "b"])


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted rows: the number of each row's run of equal ``keys``, and its size."""
    new = np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))
    run = np.cumsum(new) - 1
    return run, np.bincount(run)[run]


def _neighbours_of(order: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    """Candidates among consecutive rows of an order: (tree, signature) and node."""
    by_depth = [_runs(order[:, : 1 + depth]) for depth in range(DEPTH, LEAST - 1, -1)]
    left, right = [], []
    for step in range(1, CROWD):
        undecided = np.ones(max(len(nodes) - step, 0), bool)
        for run, size in by_depth:  # the deepest shared prefix decides
            shared = undecided & (run[step:] == run[:-step])
            undecided &= ~shared
            at = np.flatnonzero(shared if step == 1 else shared & (size[step:] <= CROWD))
            left.append(nodes[at])
            right.append(nodes[at + step])
    return _pairs_batch(np.concatenate(left), np.concatenate(right))


def _neighbours(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; the last ones of a batch are looked at again with the next."""
    order, nodes = np.empty((0, 1 + DEPTH), np.uint16), np.empty(0, np.int64)
    for batch in source:
        if not batch.num_rows:
            continue
        tree = batch.column("tree").to_numpy().astype(np.uint16)[:, None]
        signatures = b"".join(batch.column("prefix").to_pylist())
        signatures = np.frombuffer(signatures, np.uint16).reshape(-1, DEPTH)
        order = np.concatenate((order, np.concatenate((tree, signatures), axis=1)))
        nodes = np.concatenate((nodes, batch.column("node").to_numpy()))
        yield _neighbours_of(order, nodes)
        order, nodes = order[-CROWD:], nodes[-CROWD:]


def _in_trees(nodes: DataFrame, *columns: str) -> DataFrame:
    """Every node once per tree, with its signature there as ``prefix``."""
    trees = F.sequence(F.lit(0), F.lit(TREES - 1))
    prefix = F.expr(f"substring(signature, tree * {2 * DEPTH} + 1, {2 * DEPTH})")
    return nodes.select("*", F.explode(trees).alias("tree")).select(
        "tree", prefix.alias("prefix"), *columns
    )


def neighbours(nodes: DataFrame) -> DataFrame:
    """(a, b): candidates next to each other, from the sorted orders of all trees."""
    orders = _in_trees(nodes, "node").repartitionByRange("tree", "prefix", "node")
    found = orders.sortWithinPartitions("tree", "prefix", "node").mapInArrow(
        _neighbours, "a long, b long"
    )
    return found.distinct()


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).sum(axis=-1) >= SCREEN * TREES * DEPTH


def _signatures(column: pa.Array) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint16).reshape(-1, TREES * DEPTH)


def _screen(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        keep = _alike(_signatures(batch.column("x")), _signatures(batch.column("y")))
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def screened(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that agree on enough min-hashes of all trees."""
    for end, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("signature").alias(name)), end)
    return pairs.mapInArrow(_screen, "a long, b long")


# --- confirmation --------------------------------------------------------------------


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of shingles share enough of their union."""
    if 100 * min(len(x), len(y)) < LINKED * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= LINKED * (len(x) + len(y) - both)


class _Forest:
    """Which components the links found so far have joined."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def _root(self, x: int) -> int:
        above = self.above
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    def apart(self, x: int, y: int) -> bool:
        return self._root(x) != self._root(y)

    def join(self, x: int, y: int) -> None:
        self.above[self._root(x)] = self._root(y)


def _confirm(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit, its texts before its pairs. Gives links that make a forest."""
    unit, sets, forest = None, {}, _Forest()
    for batch in source:
        found = []
        units, firsts = batch.column("unit").to_pylist(), batch.column("a").to_pylist()
        seconds, texts = batch.column("b").to_pylist(), batch.column("text")
        for at, (key, a, b) in enumerate(zip(units, firsts, seconds)):
            if key != unit:
                unit, sets, forest = key, {}, _Forest()
            if b is None:
                sets[a] = shingle_set(texts[at].as_py())
            elif forest.apart(a, b) and linked(sets[a], sets[b]):
                forest.join(a, b)
                found.append((a, b))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        yield _pairs_batch(pairs[:, 0], pairs[:, 1])


def confirmed(pairs: DataFrame, texts: DataFrame, unit: int = UNIT) -> DataFrame:
    """(a, b): links that connect what the links among ``pairs`` connect.

    Pairs are dealt to units of some ``unit``, those of one neighbourhood together. A larger
    neighbourhood is dealt as a grid by both ends, so that a text is sent to few units
    even if most of its pairs are candidates. Only texts of candidates are sent at all.
    """
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = ends.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("label"))
    labelled = stored(skew_join(pairs, label, "a"), "labelled")
    side = F.ceil(F.sqrt(F.count("*") / unit)).alias("side")
    sides = labelled.groupBy("label").agg(side)
    row, column = (F.pmod(F.xxhash64(c), F.col("side")) for c in ("a", "b"))
    dealt = stored(
        skew_join(labelled, sides, "label").select(
            F.xxhash64("label", row, column).alias("unit"), "a", "b"
        ),
        "units",
    )
    members = stored(
        dealt.select("unit", F.col("a").alias("row")).unionByName(
            dealt.select("unit", F.col("b").alias("row"))
        ).distinct(),
        "unit-members",
    )
    named = only(texts.select("row", "text"), members.select("row").distinct(), "row")
    sent = skew_join(members, named, "row")
    rows = sent.select("unit", F.col("row").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = rows.unionByName(dealt.withColumn("text", F.lit(None).cast("string")))
    return (
        rows.repartition("unit").sortWithinPartitions("unit", F.col("b").asc_nulls_first())
        .mapInArrow(_confirm, "a long, b long")
    )


# --- what is left apart --------------------------------------------------------------


class _Region:
    """Nodes of a region with their components; a text's set is made when first needed."""

    def __init__(self, rows: pa.Table, outside: np.ndarray):
        self.nodes = rows.column("node").to_numpy()
        self.roots = rows.column("root").to_numpy()
        self.trees = rows.column("tree").to_numpy()
        self.signatures = _signatures(rows.column("signature"))
        self.texts = rows.column("text")
        self.outside = outside
        self.sets: dict[int, np.ndarray] = {}

    def set_of(self, at: int) -> np.ndarray:
        if at not in self.sets:
            self.sets[at] = shingle_set(self.texts[at].as_py())
        return self.sets[at]

    def __len__(self) -> int:
        return len(self.nodes)


def _first_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first tree in which pairs of signatures share a region."""
    same = (x == y).reshape(-1, TREES, DEPTH)[:, :, :LEAST].all(axis=2)
    return same.argmax(axis=1)


def _links_apart(x: _Region, y: _Region) -> pa.RecordBatch:
    """Links between nodes of ``x`` and ``y`` that join two components.

    A pair is confirmed in the first region that it shares, and only while its
    components are apart; no list of pairs is made.
    """
    forest, found = _Forest(), []
    for at in range(0, len(x), 16):
        part = slice(at, at + 16)
        other = x.roots[part, None] != y.roots[None, :]
        # A pair that is met from either side is confirmed from the smaller node.
        other &= ~y.outside[None, :] | (x.nodes[part, None] < y.nodes[None, :])
        i, j = np.nonzero(other)
        i += at
        for k in range(0, len(i), PAIRS_AT_ONCE):
            left, right = i[k : k + PAIRS_AT_ONCE], j[k : k + PAIRS_AT_ONCE]
            keep = _alike(x.signatures[left], y.signatures[right])
            left, right = left[keep], right[keep]
            first = _first_shared(x.signatures[left], y.signatures[right]) == x.trees[left]
            for p, q in zip(left[first].tolist(), right[first].tolist()):
                if forest.apart(x.roots[p], y.roots[q]) and linked(x.set_of(p), y.set_of(q)):
                    forest.join(x.roots[p], y.roots[q])
                    found.append((x.nodes[p], y.nodes[q]))
    return _pairs_batch(*np.array(found, np.int64).reshape(-1, 2).T)


def _regions(rows: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
    for start, end in zip(cuts[:-1], cuts[1:]):
        part = rows.slice(start, end - start)
        region = _Region(part, np.ones(part.num_rows, bool))
        yield _links_apart(region, region)


def _apart_in_regions(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by region; the last region of a batch waits for the next batch."""
    held = None
    for batch in source:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        keys = rows.column("region").to_numpy()
        cuts = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
        yield from _regions(rows, [0, *cuts])
        held = rows.slice(cuts[-1] if cuts else 0)
    if held is not None:
        yield from _regions(held, [0, held.num_rows])


def _apart_in_blocks(group: pa.Table) -> pa.Table:
    left = group.column("left").to_numpy(zero_copy_only=False)
    sides = []
    for which in (left, ~left):
        rows = group.filter(pa.array(which))
        sides.append(_Region(rows, rows.column("outside").to_numpy(zero_copy_only=False)))
    return pa.Table.from_batches([_links_apart(*sides)])


def apart(nodes: DataFrame, roots: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join the components in ``roots`` as far as links of nodes that
    share a region do."""
    rooted = nodes.join(roots, "node", "left").select(
        "node", "signature", F.coalesce("root", "node").alias("root")
    )
    region = F.xxhash64("tree", F.expr(f"substring(prefix, 1, {2 * LEAST})"))
    spread = _in_trees(rooted, "node", "root").select(
        region.alias("region"), "tree", "node", "root"
    )
    spread = stored(spread, "regions")
    mixed = stored(
        spread.groupBy("region")
        .agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low <> high").select("region", "size"),
        "mixed-regions",
    )
    held = stored(skew_join(spread, mixed, "region"), "mixed-members")
    named = texts.select(F.col("row").alias("node"), "text")
    named = only(named, held.select("node").distinct(), "node")
    told = stored(named.join(rooted.select("node", "signature"), "node"), "mixed-texts")
    usual = held.where(F.col("size") <= block).drop("size")
    found = (
        usual.join(told, "node").repartition("region").sortWithinPartitions("region")
        .mapInArrow(_apart_in_regions, "a long, b long")
    )
    crowds = held.where(F.col("size") > block).drop("size")
    if not crowds.isEmpty():
        found = found.unionByName(_apart_in_crowds(crowds, told, block))
    return found


def _apart_in_crowds(held: DataFrame, told: DataFrame, block: int) -> DataFrame:
    """Regions of more than a block: nodes outside the commonest component against all."""
    shares = held.groupBy("region", "root").agg(F.count("*").alias("rows"))
    tiles = stored(
        shares.groupBy("region").agg(
            F.max_by("root", F.struct("rows", "root")).alias("common"),
            F.sum("rows").alias("size"), F.max("rows").alias("most"),
        ).select(
            "region", "common", F.ceil(F.col("size") / block).cast("int").alias("strips"),
            F.ceil((F.col("size") - F.col("most")) / block).cast("int").alias("blocks"),
        ),
        "crowd-tiles",
    )
    part = F.xxhash64("node", F.lit(1))
    rows = skew_join(held, tiles, "region").withColumn(
        "outside", F.col("root") != F.col("common")
    )
    across = rows.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")
    ).withColumns({"j": F.pmod(part, F.col("strips")).cast("int"), "left": F.lit(False)})
    down = rows.where("outside").select(
        "*", F.pmod(part, F.col("blocks")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("j"),
    ).withColumn("left", F.lit(True))
    columns = ["region", "tree", "node", "root", "outside", "i", "j", "left"]
    tiled = skew_join(across.unionByName(down).select(*columns), told, "node")
    return tiled.groupBy("region", "i", "j").applyInArrow(_apart_in_blocks, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest ``doc_id`` that links reach, itself included. Null and
    wordless texts have no shingle and link with nothing. Rows that repeat a ``doc_id`` stay
    rows and link by their own texts. A null ``doc_id`` keeps its row, names no component,
    and is not ``kept``. Other columns are ignored. An empty table gives no rows.
    """
    rows = described(docs)
    nodes = stored(
        rows.where("digest is not null").groupBy("digest").agg(
            F.min("row").alias("node"), F.min("doc_id").alias("least"),
            F.first("signature").alias("signature"),
        ),
        "nodes",
    )
    near = stored(screened(neighbours(nodes), nodes), "neighbours")
    links = stored(confirmed(near, rows), "links")
    roots = components(links, "a", "b")
    more = stored(apart(nodes, roots, rows), "more-links")
    roots = components(links.unionByName(more), "a", "b")
    rooted = stored(
        nodes.join(roots, "node", "left").select(
            "digest", "least", F.coalesce("root", "node").alias("root")
        ),
        "rooted",
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(skew_join(rooted, named, "root").select("digest", "component_id"), "classes")
    some = skew_join(
        rows.where("digest is not null").select("digest", "row", "doc_id", "n_shingles"),
        classes, "digest",
    ).select("doc_id", "n_shingles", "component_id")
    none = rows.where("digest is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    found = some.unionByName(none)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
