"""The prefix trie of conversations: shared beginnings, and what sharing them saves.

A node is a distinct sequence of first turns, named by its depth and a 127-bit polynomial
hash of its turns' digests. Such hashes can be taken up in the middle, so a conversation of
any length is hashed in pieces, in range partitions, and stitched at their ends.

Subtree totals by time-forward processing: nodes in reverse level order, every node sending
its totals to its parent through a priority queue that spills. A shard holds whole fragments
of the trie. Nodes of many conversations (``heavy``) are fragments of their own; below them a
fragment is the subtree of a light node, cut again every ``band`` levels. Fragments are
processed first, then the small tree of their roots, then the fragments that got
something from deeper ones, and at last the heavy nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldwatch.llm.common import ready, stored
from coldwatch.llm.spilling import IN_MEMORY, SpillingQueue

GROUP = 20  # conversations that share the first turns of the first of them
SHARED = 4
PIECE = 1_000_000  # rows of a range partition
HEAVY = 256  # conversations above which a node is a fragment of its own
BAND = 1024  # levels of a fragment
CUTS = 100_000  # most heavy nodes, and most fragments that begin inside another
CHUNK = 4096  # identifiers hashed as one string

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix trie").digest()[:15], "little")
LOW = (1 << 64) - 1
KEY = ["depth", "k1", "k2"]


def pieces_of(rows: DataFrame) -> int:
    """As many range partitions as the rows fill, and one per core at least."""
    return max(-(-rows.count() // PIECE), rows.sparkSession.sparkContext.defaultParallelism)


# --- hashes along conversations --------------------------------------------------------


def _halves(hashes: list[int]) -> list[pa.Array]:
    low = np.array([h & LOW for h in hashes], np.uint64).view(np.int64)
    return [pa.array([h >> 64 for h in hashes], pa.int64()), pa.array(low)]


def _whole(high: Iterable[int], low: Iterable[int]) -> list[int]:
    return [(h << 64) | (x & LOW) for h, x in zip(high, low)]


RUNNING = (
    "piece int, opens boolean, conv long, digest binary, words long, "
    "depth long, k1 long, k2 long, p1 long, p2 long"
)


def _run_along(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers and hashes the turns of each conversation, as if it began in this piece."""
    conv = first = None
    depth = state = 0
    for batch in source:
        if not batch.num_rows:
            continue
        convs = batch.column("conv").to_pylist()
        opens, depths, states, before = [], [], [], []
        for own, digest in zip(convs, batch.column("digest").to_pylist()):
            if own != conv:
                conv, depth, state = own, 0, 0
                first = own if first is None else first
            depth += 1
            before.append(state)
            state = (state * BASE + int.from_bytes(digest, "little")) % PRIME
            depths.append(depth)
            states.append(state)
            opens.append(own == first)
        yield pa.record_batch(
            [
                batch.column("piece"), pa.array(opens), batch.column("conv"),
                batch.column("digest"), batch.column("words"), pa.array(depths, pa.int64()),
                *_halves(states), *_halves(before),
            ],
            names=[f.split()[0] for f in RUNNING.split(", ")],
        )


def _carried(ends: list) -> dict[int, tuple[int, int]]:
    """What goes on from one piece to the next: a conversation's depth and hash so far."""
    carried, conv, depth, state = {}, None, 0, 0
    for e in ends:
        own, high, low = e.last["depth"], e.last["k1"], e.last["k2"]
        end = _whole([high], [low])[0]
        if e.first == conv:
            carried[e.piece] = (depth, state)
            if e.last["conv"] == conv:
                end = (state * pow(BASE, own, PRIME) + end) % PRIME
                own += depth
        conv, depth, state = e.last["conv"], own, end
    return carried


def _stitch(carried: dict[int, tuple[int, int]]) -> Callable:
    def moved(state: int, length: int, tail: int) -> int:
        return (state * pow(BASE, length, PRIME) + tail) % PRIME

    def rows(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            held = batch.to_pydict()
            begun = [carried[p] for p in held["piece"]]
            keys = _whole(held["k1"], held["k2"])
            above = _whole(held["p1"], held["p2"])
            depths = held["depth"]
            keys = [moved(s, d, k) for (_, s), d, k in zip(begun, depths, keys)]
            above = [moved(s, d - 1, k) for (_, s), d, k in zip(begun, depths, above)]
            depth = pa.array([d + b for d, (b, _) in zip(depths, begun)], pa.int64())
            yield pa.record_batch(
                [*batch.columns[:5], depth, *_halves(keys), *_halves(above)], names=batch.schema.names
            )

    return rows


def along_conversations(rows: DataFrame, *order: Column) -> DataFrame:
    """(conv, digest, words, depth, k1, k2, p1, p2) of each of ``rows`` (conv, digest, words).

    ``depth`` numbers a conversation's rows from 1 in the given order, ``k1, k2`` hash them
    up to this one and ``p1, p2`` up to the one before. Range partitions cut conversations
    anywhere; one row per partition tells how the next goes on.
    """
    ready(rows.sparkSession)
    ordered = [F.col("conv"), *order]
    cut = rows.repartitionByRange(pieces_of(rows), *ordered).sortWithinPartitions(*ordered)
    cut = cut.select(F.spark_partition_id().alias("piece"), "conv", "digest", "words")
    run = stored(cut.mapInArrow(_run_along, RUNNING), "pieces")
    last = F.max(F.struct("conv", "depth", "k1", "k2"))
    ends = run.groupBy("piece").agg(F.min("conv").alias("first"), last.alias("last"))
    carried = _carried(ends.orderBy("piece").collect())
    whole = run
    if carried:
        goes_on = F.col("opens") & F.col("piece").isin(list(carried))
        stitched = run.where(goes_on).mapInArrow(_stitch(carried), RUNNING)
        whole = run.where(~goes_on).unionByName(stitched)
    return whole.drop("piece", "opens")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, turn, row, digest, words) of every turn; the text itself is left behind."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        F.monotonically_increasing_id().alias("row"),
        F.substring(F.unhex(F.sha2(told, 256)), 1, 16).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def members(conversations: DataFrame) -> DataFrame:
    """A row per rebuilt conversation and depth, the root's depth 0 among them."""
    said = stored(turns(conversations), "turns")
    order = [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    own = stored(along_conversations(said, *order).select("conv", "digest", "words", "depth"), "own")
    shared = (F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED).cast("long")
    convs = own.where("depth = 1").select("conv", shared.alias("shared"))
    base = (F.col("conv") - F.col("conv") % GROUP).alias("base")
    firsts = own.where(F.col("depth") < SHARED).withColumnRenamed("conv", "base")
    taken = convs.select("*", base).join(firsts, "base").where("depth <= shared")
    kept = own.where(F.col("depth") > shared)
    columns = ["conv", "digest", "words", "depth"]
    rebuilt = stored(
        taken.select(*columns, F.lit(False).alias("own")).unionByName(
            kept.select(*columns, F.lit(True).alias("own"))
        ),
        "rebuilt",
    ).withColumnRenamed("depth", "place")
    deep = along_conversations(rebuilt, F.col("own"), F.col("place")).drop("digest")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.select(
        "conv", zero.alias("words"), zero.alias("depth"), zero.alias("k1"), zero.alias("k2"),
        none.alias("p1"), none.alias("p2"),
    )
    return stored(deep.unionByName(root), "members")


# --- subtree totals --------------------------------------------------------------------

NODE = [*KEY, "pdepth", "p1", "p2"]
TOTALS = ["children", "leaves", "saved"]
FORWARD = ", ".join(
    f"{c} long" for c in ["tdepth", "t1", "t2", *NODE, "conv", "n_convs", *TOTALS]
)


def _forward(limit: int) -> Callable:
    """Over rows in reverse level order of each fragment; messages come before their node.

    A row is a node or a message to a node from outside the fragment. A node takes the
    messages addressed to it from the queue, adds its own, and sends the sums to its parent
    unless it is the top of its fragment. Without any message it is a leaf.
    """
    names = [f.split()[0] for f in FORWARD.split(", ")]

    def rows(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, sent = SpillingQueue(limit), 0
        for batch in source:
            found = []
            for row in zip(*(batch.column(c).to_pylist() for c in [*names, "is_node"])):
                top, (depth, k1, k2), above, rest = row[:3], row[3:6], row[6:9], row[9:]
                conv, n_convs, children, leaves, saved, is_node = rest
                sent += 1
                if not is_node:
                    queue.push(((-depth, k1, k2), sent, children, leaves, saved))
                    continue
                while (head := queue.peek()) and head[0] == (-depth, k1, k2):
                    _, _, more, leaves_below, saved_below = queue.pop()
                    children, leaves, saved = (
                        children + more, leaves + leaves_below, saved + saved_below
                    )
                if not children and not leaves:
                    leaves = 1
                found.append((*top, depth, k1, k2, *above, conv, n_convs, children, leaves, saved))
                if (depth, k1, k2) != top and above[0] is not None:
                    queue.push(((-above[0], above[1], above[2]), sent, 1, leaves, saved))
            columns = list(zip(*found)) if found else [[]] * len(names)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)

    return rows


def forwarded(rows: DataFrame, limit: int, shards: int = 1) -> DataFrame:
    """``rows`` (fragment top, node, totals, is_node) to nodes with whole totals."""
    top = ["tdepth", "t1", "t2"]
    spread = rows.repartition(shards, *top) if shards > 1 else rows.repartition(1)
    return spread.sortWithinPartitions(
        *top, F.desc("depth"), "k1", "k2", F.col("is_node").asc()
    ).mapInArrow(_forward(limit), FORWARD)


def _as_messages(rows: DataFrame) -> DataFrame:
    """Nodes (with the fragment their parent is in) to messages to their parents."""
    none = F.lit(None).cast("long")
    return rows.select(
        F.col("ptdepth").alias("tdepth"), F.col("pt1").alias("t1"), F.col("pt2").alias("t2"),
        F.col("pdepth").alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"),
        *[none.alias(c) for c in ("pdepth", "p1", "p2", "conv", "n_convs")],
        "children", "leaves", "saved", F.lit(False).alias("is_node"),
    )


def _light_totals(
    light: DataFrame, tops: DataFrame, band: int, limit: int, shards: int
) -> DataFrame:
    """Totals of all nodes below the heavy ones, fragment by fragment."""
    slot = F.floor(F.col("depth") / band)
    rows = stored(
        light.withColumn("slot", slot).join(tops, ["conv", "slot"]).drop("slot").withColumns(
            {"children": F.lit(0).cast("long"), "leaves": F.lit(0).cast("long"),
             "saved": (F.col("n_convs") - 1) * F.col("words"), "is_node": F.lit(True)}
        ).drop("words"),
        "fragments",
    )
    # Tops that go on a fragment of the band before: their parent is in it.
    is_top = (F.col("depth") == F.col("tdepth")) & (F.col("k1") == F.col("t1")) & (
        F.col("k2") == F.col("t2")
    )
    goes_on = rows.where(is_top & (F.col("depth") % band == 0))
    earlier = tops.select(
        "conv", (F.col("slot") + 1).alias("slot"), F.col("tdepth").alias("ptdepth"),
        F.col("t1").alias("pt1"), F.col("t2").alias("pt2"),
    )
    goes_on = stored(
        goes_on.withColumn("slot", slot).join(earlier, ["conv", "slot"]).drop("slot"), "bands"
    )
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    hints = _as_messages(goes_on.withColumns({"children": one, "leaves": zero, "saved": zero}))
    local = stored(forwarded(rows.unionByName(hints), limit, shards), "local-totals")
    if goes_on.isEmpty():
        return local
    # The tree of fragments: those that go on others, and those gone on.
    place = goes_on.select(*KEY, "ptdepth", "pt1", "pt2")
    gone_on = place.select(
        F.col("ptdepth").alias("tdepth"), F.col("pt1").alias("t1"), F.col("pt2").alias("t2")
    ).distinct()
    tree = local.where(is_top).join(F.broadcast(place), KEY, "left")
    joined = tree.join(F.broadcast(gone_on), ["tdepth", "t1", "t2"], "left_semi")
    tree = tree.where("ptdepth is not null").unionByName(joined.where("ptdepth is null"))
    whole = stored(
        forwarded(
            tree.select(
                *[F.lit(-1).cast("long").alias(c) for c in ("tdepth", "t1", "t2")], *KEY, F.col("ptdepth").alias("pdepth"), F.col("pt1").alias("p1"),
                F.col("pt2").alias("p2"), "conv", "n_convs", zero.alias("children"), "leaves",
                "saved", F.lit(True).alias("is_node"),
            ),
            limit,
        ),
        "fragment-totals",
    ).select(*KEY, "leaves", "saved")
    sent = goes_on.drop("children", "leaves", "saved").join(F.broadcast(whole), KEY)
    messages = _as_messages(sent.withColumn("children", one))
    again = rows.join(F.broadcast(gone_on), ["tdepth", "t1", "t2"], "left_semi")
    final = local.join(F.broadcast(gone_on), ["tdepth", "t1", "t2"], "left_anti")
    return stored(
        final.unionByName(forwarded(again.unionByName(messages), limit, shards)), "light-totals"
    )


def totals(
    rows: DataFrame, heavy: int = HEAVY, band: int = BAND, limit: int = IN_MEMORY
) -> DataFrame:
    """Every node of ``members`` with its conversation, counts and parent's conversation."""
    nodes = stored(
        rows.groupBy(*KEY).agg(
            F.min("conv").alias("conv"), F.count("*").alias("n_convs"),
            F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words"),
        ).withColumn("pdepth", F.col("depth") - 1),
        "nodes",
    )
    share, shards = -(-rows.count() // CUTS), pieces_of(rows)
    heavy, band = max(heavy, share), max(band, share)
    # Heavy nodes share out the rows, so there are at most CUTS of them, and the root.
    is_heavy = (F.col("n_convs") > heavy) | (F.col("depth") == 0)
    large = stored(nodes.where(is_heavy), "heavy")
    keys = F.broadcast(large.select(*KEY))
    parents = F.broadcast(
        large.select(
            F.col("depth").alias("pdepth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
            F.col("conv").alias("parent_conv"),
        )
    )
    under = ["pdepth", "p1", "p2"]
    begins = F.col("parent_conv").isNotNull() | (F.col("depth") % band == 0)
    tops = (
        rows.withColumn("pdepth", F.col("depth") - 1).join(keys, KEY, "left_anti")
        .join(parents, under, "left").where(begins)
        .select(
            "conv", F.floor(F.col("depth") / band).alias("slot"), F.col("depth").alias("tdepth"),
            F.col("k1").alias("t1"), F.col("k2").alias("t2"),
        )
    )
    light = nodes.where(~is_heavy)
    below = _light_totals(light, stored(tops, "tops"), band, limit, shards)
    placed = below.join(parents, under, "left").drop("tdepth", "t1", "t2")
    zero = F.lit(0).cast("long")
    root = {"tdepth": zero, "t1": zero, "t2": zero}
    messages = placed.where("parent_conv is not null").groupBy(*under).agg(
        F.count("*").alias("children"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"),
    ).withColumns({"ptdepth": zero, "pt1": zero, "pt2": zero})
    trunk = large.withColumns(
        {**root, "children": zero, "leaves": zero,
         "saved": (F.col("n_convs") - 1) * F.col("words"), "is_node": F.lit(True)}
    ).drop("words")
    above = forwarded(trunk.unionByName(_as_messages(messages)), limit)
    above = above.drop("tdepth", "t1", "t2").join(parents, under, "left")
    found = placed.unionByName(above)
    known = found.where("parent_conv is not null or depth = 0")
    # A light parent has at most ``heavy`` children, so no key of this join is hot.
    own = light.select(
        F.col("depth").alias("pdepth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
        F.col("conv").alias("parent_conv"),
    )
    unknown = found.where("parent_conv is null and depth > 0").drop("parent_conv").join(own, under)
    return known.unionByName(unknown)


# --- who ends where --------------------------------------------------------------------


def _chunked(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted identifiers of a node as strings of some ``CHUNK`` of them."""
    for batch in source:
        keys = list(zip(*(batch.column(c).to_pylist() for c in KEY)))
        convs, at, out = batch.column("conv").to_pylist(), 0, []
        for key, run in groupby(keys):
            size = len(list(run))
            for start in range(at, at + size, CHUNK):
                part = convs[start : min(start + CHUNK, at + size)]
                out.append((*key, part[0], ",".join(map(str, part))))
            at += size
        columns = list(zip(*out)) if out else [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.record_batch(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=[*KEY, "conv", "ids"]
        )


def _hashed(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of a node's strings one after the other, whatever their number."""
    names = [*KEY, "ends_sha256"]
    kinds = [pa.int64()] * 3 + [pa.string()]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * 4
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    key, state = None, None
    for batch in source:
        done = []
        columns = (batch.column(c).to_pylist() for c in [*KEY, "ids"])
        for *own, ids in zip(*columns):
            if own != key:
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield emit(done)
    if key:
        yield emit([(*key, state.hexdigest())])


def ends(rows: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes at which conversations end.

    A digest has to see a node's identifiers in order, so their strings, a row per some
    ``CHUNK`` of them, meet in one task, which only streams over them. Sorting and joining
    them is shared out over range partitions.
    """
    last = F.max(F.struct(*KEY)).alias("last")
    at = stored(rows.groupBy("conv").agg(last).select("last.*", "conv"), "ends")
    ordered = [*KEY, "conv"]
    strings = (
        at.repartitionByRange(pieces_of(at), *ordered).sortWithinPartitions(*ordered)
        .mapInArrow(_chunked, "depth long, k1 long, k2 long, conv long, ids string")
    )
    return strings.repartition(*KEY).sortWithinPartitions(*ordered).mapInArrow(
        _hashed, "depth long, k1 long, k2 long, ends_sha256 string"
    )


def prefix_trie(
    conversations: DataFrame, heavy: int = HEAVY, band: int = BAND, limit: int = IN_MEMORY
) -> DataFrame:
    """One row per node of the trie of rebuilt ``conversations`` (conv_id, turn, role, text).

    Turns are ordered by ``turn``, null first; turns of one number by a digest of role and
    text, so repeated rows stay and the order is the same in every run. Null roles and texts
    are empty ones. Rows without ``conv_id`` belong to no conversation. Other columns are
    ignored. An empty table has no conversation, hence no node.

    ``heavy`` and ``band`` set the size of fragments, ``limit`` the entries that a queue
    keeps in memory; none changes the result.
    """
    rows = members(conversations)
    found = totals(rows, heavy, band, limit).join(ends(rows), KEY, "left")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"),
        "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", nobody).alias("ends_sha256"),
    )
