"""A priority queue that keeps a bounded number of entries in memory."""

from __future__ import annotations

import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator

IN_MEMORY = 200_000
BLOCK = 4096
RUNS = 32  # more are merged into one


def _scratch() -> str | None:
    """The executor's own spill folder, which Spark names to its Python workers."""
    named = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return named if named and os.path.isdir(named) else None


class SpillingQueue:
    """Entries come out in order, smallest first.

    Beyond ``limit`` entries the queue writes what it holds, sorted, to a nameless file of the
    task, which goes with the task as Spark's own spills do, and reads it back by blocks.
    """

    def __init__(self, limit: int = IN_MEMORY):
        self.limit = limit
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []  # (first entry, number, the entries after it)
        self.written = 0

    def _add_run(self, entries: Iterator[tuple]) -> None:
        file = tempfile.TemporaryFile(dir=_scratch())
        block: list[tuple] = []
        for entry in entries:
            block.append(entry)
            if len(block) == BLOCK:
                pickle.dump(block, file)
                block = []
        if block:
            pickle.dump(block, file)
        file.seek(0)
        self.written += 1
        self._put(self._read(file), self.written)

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    block = pickle.load(file)
                except EOFError:
                    return
                yield from block

    def _put(self, entries: Iterator[tuple], number: int) -> None:
        first = next(entries, None)
        if first is not None:
            heapq.heappush(self.runs, (first, number, entries))

    @staticmethod
    def _whole(run: tuple) -> Iterator[tuple]:
        yield run[0]
        yield from run[2]

    def push(self, entry: tuple) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.limit:
            entries, self.heap = sorted(self.heap), []
            self._add_run(iter(entries))
            if len(self.runs) > RUNS:
                runs, self.runs = self.runs, []
                self._add_run(heapq.merge(*map(self._whole, runs)))

    def peek(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            first, number, entries = heapq.heappop(self.runs)
            self._put(entries, number)
            return first
        return heapq.heappop(self.heap)
