"""Best-fit packing of token sequences in one pass and bounded memory.

Each task packs the documents of its input partition as they arrive. It keeps a fixed
number of open sequences. Which free spaces they have stands in a bitset, so the
tightest space that holds a piece is the lowest set bit from the piece's length up. If
none holds it and the number is reached, the fullest open sequence is closed.
Nothing is shuffled. Small input partitions are put together first, by the bytes of all texts, so
that a task fills many sequences and those left open at its end weigh little.

Pieces of one Arrow batch go longest first, which leaves the short ones to fill gaps.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldwatch.llm.common import lists, portions, ready, with_text
from coldwatch.llm.wordpieces import default_path, documents_ids

CAPACITY = 4096
OPEN_SEQUENCES = 1024
DOCUMENTS_AT_ONCE = 1024
TASK_BYTES = 8 << 20  # of text: some 500 sequences of 4096 tokens a task
PIECES = (
    "doc_id long, piece int, start long, length long, ids array<int>,"
    " sequence_id long, offset long"
)


class BestFit:
    """Open sequences by free space; ``place`` gives a piece's sequence and offset."""

    def __init__(self, capacity: int, open_sequences: int, first: int = 0):
        self.capacity, self.most, self.next = capacity, open_sequences, first
        self.spaces = 0  # bit f is set if an open sequence has f free
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.count = 0

    def _take(self, free: int) -> int:
        sequence = self.open[free].pop()
        if not self.open[free]:
            self.spaces ^= 1 << free
        self.count -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.spaces >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self.capacity, self.next
            self.next += 1
        left = free - length
        if left:
            if self.count == self.most:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            self.open[left].append(sequence)
            self.spaces |= 1 << left
            self.count += 1
        return sequence, self.capacity - free


def _packed(tokenizer: str, end_id: int, capacity: int, open_sequences: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
         ("length", pa.int64()), ("ids", pa.list_(pa.int32())), ("sequence_id", pa.int64()),
         ("offset", pa.int64())]
    )

    def rows(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = BestFit(capacity, open_sequences, TaskContext.get().partitionId() << 32)
        for batch in portions(source, DOCUMENTS_AT_ONCE):
            ids, sizes = documents_ids(tokenizer, batch.column("text"), end_id)
            pieces = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(sizes[doc] - start, capacity)
            sequence, offset = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
            for at in np.argsort(-length, kind="stable").tolist():
                sequence[at], offset[at] = packer.place(int(length[at]))
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)),
                 pa.array(start), pa.array(length),
                 lists(ids.view(np.int32), length, pa.int32()),
                 pa.array(sequence), pa.array(offset)],
                schema=schema,
            )

    return rows


def _few_partitions(texts: DataFrame, task_bytes: int) -> DataFrame:
    """No more partitions than of ``task_bytes`` of text on average; merged in place, not shuffled."""
    octets = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return texts.coalesce(max(1, -(-octets // task_bytes)))


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    end_id: int = 1,
    capacity: int = CAPACITY,
    open_sequences: int = OPEN_SEQUENCES,
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their ids, sequence and place in it.

    The texts are read twice, the first time for their bytes only; so pass a table.

    A document is its ids and the end id; only longer ones than ``capacity`` are cut.
    Null texts count as empty: such a document is the end id alone. Repeated rows and
    null ``doc_id`` are packed like any other; other columns are ignored. An empty
    table gives no rows.
    """
    ready(docs.sparkSession)
    texts = with_text(docs, F.col("doc_id").cast("long").alias("doc_id"))
    rows = _packed(tokenizer or default_path(), end_id, capacity, open_sequences)
    return _few_partitions(texts, task_bytes).mapInArrow(rows, PIECES)
