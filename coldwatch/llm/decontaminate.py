"""Benchmark decontamination: passages within an edit distance of benchmark items.

Texts are sequences of words. An item is cut into parts, just so many that one of them has at
most ``PART_EDITS`` of the edits allowed. Parts, and the windows of their size in a
document, are embedded by CGK random walks: step j writes the word the walk stands on
and goes on by a bit drawn from (j, word), so that after an edit the walks fall into step
again and agree in many places. A repetition draws one walk and ``SAMPLED`` of its steps;
a window and a part that agree in them are a candidate. The chance that they do is worked out
for the least favourable edit of a part of that length, and there are as many
repetitions as it takes for ``RECALL``. Candidates are verified by aligning the whole item
exactly, with all places it could start at.

Windows that cannot hold an item are left out ahead of the walk, without loss: an item of
L words with k edits keeps at least L - q + 1 - qk of its runs of q words in the stretch that
holds it, at most L + k words wide. The runs are of three words, or of two or one where
an item keeps too few of them.

The operator is a pass over the documents without a shuffle. Items go to the tasks in
bounded groups, equal texts once, a pass for each group.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldwatch.llm.common import as_rows, portions, ready, stored, texts_of, with_text

SIMILARITY = 0.8  # one less edits per word of the item
PART_EDITS = 1  # that some part of an item has at most
SAMPLED = 2  # steps of a walk that must agree
RECALL = 0.999  # of a part with that many edits; an item has other parts besides
STEPS = 1.6  # of a walk, times the words of the window; on average it goes on every second step
TRIALS = 1024  # walks that the chance of a collision is worked out from
ITEMS_AT_ONCE = 16_384
RUN_BITS = 20
LEAST_RUNS = 3  # that a window must keep for runs of three words to be used

# Letters of scripts that put no spaces between words (Thai to Khmer, kana, Han).
UNSPACED = (
    "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
)
WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def edits_allowed(length: int, similarity: float = SIMILARITY) -> int:
    return int(length * (1 - similarity) + 1e-9)


def best_match(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int] | None:
    """Least edits that turn ``item`` into a beginning of ``text``, and that beginning's size.

    None if more than ``most`` are needed. Among equals the size nearest the item's wins.
    """
    width = min(len(text), len(item) + most)
    text = text[:width]
    if len(text) < len(item) - most:
        return None
    columns = np.arange(width + 1)
    row = columns.copy()
    for i, word in enumerate(item.tolist(), 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (text != word))
        step = np.concatenate(([i], step))
        # Insertions run along the row: the least of step[j'] + (j - j') up to j.
        row = np.minimum.accumulate(step - columns) + columns
        if row.min() > most:
            return None
    best = int(row.min())
    if best > most:
        return None
    ends = np.flatnonzero(row == best)
    return best, int(ends[np.abs(ends - len(item)).argmin()])


def first_start(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int] | None:
    """Least edits that turn ``item`` into any part of ``text``, and where the first such starts.

    None if more than ``most`` are needed.
    """
    text = text[::-1]
    columns = np.arange(len(text) + 1)
    row = np.zeros_like(columns)
    for i, word in enumerate(item[::-1].tolist(), 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (text != word))
        step = np.concatenate(([i], step))
        row = np.minimum.accumulate(step - columns) + columns
        if row.min() > most:
            return None
    start = int(row[::-1].argmin())
    return int(row[len(text) - start]), start


class Walks:
    """Random walks over windows of one length, and which of their steps are sampled."""

    def __init__(self, length: int, repetitions: int, seed: int = 0):
        rng = np.random.default_rng((length, seed))
        self.length, self.steps = length, max(int(STEPS * length), SAMPLED)
        self.factors = rng.integers(0, 1 << 63, (self.steps, repetitions, 1), dtype=np.uint64)
        self.factors |= np.uint64(1)
        self.sampled = np.stack(
            [rng.choice(self.steps, SAMPLED, replace=False) for _ in range(repetitions)]
        )

    def codes(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(repetitions, windows): the words at the sampled steps, as one number.

        Beyond its window, or the text, a walk reads no word.
        """
        words = np.append(words, np.int64(-1))
        hashes = _hashed_words(words)
        at = np.repeat(starts[None, :], len(self.sampled), axis=0)
        end = np.minimum(starts + self.length, len(words) - 1)
        codes = np.zeros(at.shape, dtype=np.int64)
        for j in range(self.steps):
            inside = at < end
            symbols = np.where(inside, words[at], -1)
            for r in np.flatnonzero((self.sampled == j).any(axis=1)):
                codes[r] = codes[r] * 1_000_003 + symbols[r] + 2
            bits = (hashes[at] * self.factors[j]) >> np.uint64(63)
            at += np.where(inside, bits, np.uint64(0)).astype(np.int64)
        return codes


def _hashed_words(words: np.ndarray) -> np.ndarray:
    x = (words + 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


@cache
def repetitions(length: int, edits: int) -> int:
    """Repetitions that find a part of ``length`` words with ``edits`` with chance ``RECALL``.

    The chance of one repetition is that of the least favourable insertion, deletion or
    replacement, over ``TRIALS`` walks drawn for it.
    """
    if not edits:
        return 1
    walks = Walks(length, TRIALS, seed=1)
    part, start = np.arange(length), np.zeros(1, np.int64)
    own = walks.codes(part, start)
    after = np.arange(1000, 1000 + length)
    agree = 1.0
    for at in range(length):
        for changed in ([-7], [], [-7, at]):
            other = np.concatenate((part[:at], np.array(changed, np.int64), part[at + 1 :], after))
            agree = min(agree, float((walks.codes(other, start) == own).mean()))
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - min(agree, 0.999))))


class Benchmark:
    """A bounded group of items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY):
        spelt = [(i, words_of(t)) for i, t in items]
        spelt = [(i, w) for i, w in spelt if w]
        spelt.sort(key=lambda s: (s[0] is None, s[0] or 0, s[1]))
        vocabulary = sorted({w for _, ws in spelt for w in ws})
        self.vocabulary = {w: n for n, w in enumerate(vocabulary, 1)}  # 0: any other word
        self.item_ids = [i for i, _ in spelt]
        self.items = [np.array([self.vocabulary[w] for w in ws]) for _, ws in spelt]
        self.similarity = similarity
        self.walks: dict[int, Walks] = {}
        self.parts = [self._embedded(item) for item in self.items]
        self.needed = np.array([self._needed(len(w)) for w in self.items], dtype=np.int64)
        # By words of a run: folded runs of the items, and all runs with the items that have each.
        self.folded: dict[int, np.ndarray] = {}
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.own_runs: list[np.ndarray] = [np.zeros(0, np.int64)] * len(self.items)
        # A window that holds an item has so many runs in some stretch of this size.
        self.dense: dict[int, tuple[int, int]] = {}
        lengths = [len(w) for w in self.items]
        for q in sorted({self._run(n) for n in lengths}):
            own = [n for n, length in enumerate(lengths) if self._run(length) == q]
            codes = [np.unique(self._codes(self.items[n], q)) for n in own]
            runs, numbers = np.unique(np.concatenate(codes), return_inverse=True)
            holders = np.repeat(own, [len(c) for c in codes])
            for n, part in zip(own, np.split(numbers, np.cumsum([len(c) for c in codes])[:-1])):
                self.own_runs[n] = part
            order = np.argsort(numbers, kind="stable")
            ends = np.cumsum(np.bincount(numbers, minlength=len(runs)))
            self.runs[q] = runs, np.concatenate(([0], ends)), holders[order]
            self.folded[q] = np.zeros(1 << RUN_BITS, dtype=bool)
            self.folded[q][self._fold(runs)] = True
            widths = {lengths[n] for n in own}
            stretch = min(n + self._edits(n) for n in widths)
            parts = {n: -(-(n + self._edits(n)) // stretch) for n in widths}
            self.dense[q] = min(-(-self._needed(n) // parts[n]) for n in widths), stretch

    def _edits(self, length: int) -> int:
        return edits_allowed(length, self.similarity)

    def _embedded(self, item: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(place, words, codes) of the parts of an item."""
        edits = self._edits(len(item))
        count = edits // (PART_EDITS + 1) + 1  # so that edits // count is PART_EDITS at most
        cuts = [len(item) * n // count for n in range(count + 1)]
        found = []
        for at, end in zip(cuts[:-1], cuts[1:]):
            length = end - at
            if length not in self.walks:
                times = repetitions(length, min(PART_EDITS, edits) if length > 1 else 0)
                self.walks[length] = Walks(length, times)
            codes = self.walks[length].codes(item[at:end], np.zeros(1, np.int64))
            found.append((at, length, codes))
        return found

    def _candidates(
        self, words: np.ndarray, n: int, starts: list[tuple[int, int]]
    ) -> list[tuple[int, int]]:
        """First and last start of places where a part of the item collides with a window."""
        most, length = self._edits(len(self.items[n])), len(self.items[n])
        hits: set[int] = set()
        for low, high in starts:
            first, last = max(low - most, 0), min(high + length + most, len(words))
            windows = np.arange(first, last)
            codes: dict[int, np.ndarray] = {}
            for at, size, own in self.parts[n]:
                if size not in codes:
                    codes[size] = self.walks[size].codes(words, windows)
                same = (codes[size] == own).any(axis=0)
                hits.update((windows[same] - at).tolist())
        found: list[tuple[int, int]] = []
        for start in sorted(hits):
            low, high = max(start - most, 0), max(start + most, 0)
            if found and low <= found[-1][1] + 1:
                found[-1] = found[-1][0], max(high, found[-1][1])
            else:
                found.append((low, high))
        return found

    def _kept(self, length: int, q: int) -> int:
        return length - q + 1 - q * self._edits(length)

    def _run(self, length: int) -> int:
        """Words of the runs that items of this length are looked for by."""
        if self._kept(length, 3) >= LEAST_RUNS:
            return 3
        return 2 if self._kept(length, 2) >= 1 else 1

    def _needed(self, length: int) -> int:
        """Runs of an item of this length that a window with it has at least."""
        return max(self._kept(length, self._run(length)), 1)

    @staticmethod
    def _codes(words: np.ndarray, q: int) -> np.ndarray:
        count = max(len(words) - q + 1, 0)
        mixed = words[:count]
        for n in range(1, q):
            mixed = mixed * 0x9E3779B1 + words[n : n + count]
        return mixed

    @staticmethod
    def _fold(codes: np.ndarray) -> np.ndarray:
        return (codes * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - RUN_BITS)

    def spell(self, text: str) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def _held(self, found: np.ndarray, q: int) -> np.ndarray:
        """Items with enough runs in a whole document; ``found`` are the numbers of its runs."""
        _, ends, holders = self.runs[q]
        distinct, counts = np.unique(found, return_counts=True)
        sizes = ends[distinct + 1] - ends[distinct]
        ahead = np.repeat(ends[distinct] - np.cumsum(sizes) + sizes, sizes)
        items = holders[ahead + np.arange(len(ahead))]
        totals = np.bincount(items, np.repeat(counts, sizes), len(self.items))
        return np.flatnonzero(totals >= self.needed)

    def _starts(self, at: np.ndarray, n: int, q: int) -> list[tuple[int, int]]:
        """First and last start of windows with enough of the item's runs, which stand at ``at``."""
        needed, length = int(self.needed[n]), len(self.items[n])
        width = length + self._edits(length)
        firsts, lasts = at[: len(at) - needed + 1], at[needed - 1 :]
        near = lasts - firsts <= width - q
        highs, lows = firsts[near], np.maximum(lasts[near] + q - width, 0)
        if not len(lows):
            return []
        cuts = np.flatnonzero(lows[1:] > highs[:-1] + 1)
        first = lows[np.concatenate(([0], cuts + 1))]
        return list(zip(first.tolist(), highs[np.append(cuts, len(highs) - 1)].tolist()))

    def find(self, words: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, start, size, edits) of the best place of each item in a document."""
        best: dict[int, tuple[int, int, int]] = {}
        for q, (fewest, stretch) in self.dense.items():
            codes = self._codes(words, q)
            at = np.flatnonzero(self.folded[q][self._fold(codes)])
            if len(at) < fewest:
                continue
            if not (at[fewest - 1 :] - at[: len(at) - fewest + 1] < stretch).any():
                continue
            runs = self.runs[q][0]
            numbers = np.minimum(np.searchsorted(runs, codes[at]), len(runs) - 1)
            same = runs[numbers] == codes[at]
            at, numbers = at[same], numbers[same]
            for n in self._held(numbers, q).tolist():
                places = at[np.isin(numbers, self.own_runs[n])]
                near = self._candidates(words, n, self._starts(places, n, q))
                found = self._best(words, n, near)
                if found:
                    best[n] = found
        return [(n, *place) for n, place in sorted(best.items())]

    def _best(self, words, n: int, starts: list[tuple[int, int]]) -> tuple[int, int, int] | None:
        """(start, size, edits) with the fewest edits, the first one on ties."""
        item = self.items[n]
        length, most = len(item), self._edits(len(item))
        for low, high in starts:  # an unedited copy needs no alignment
            for start in (low + np.flatnonzero(words[low : high + 1] == item[0])).tolist():
                if np.array_equal(words[start : start + length], item):
                    return start, length, 0
        best = None
        for low, high in starts:
            found = first_start(item, words[low : high + length + most], most)
            if found and (best is None or found[0] < best[1]):
                best = low + found[1], found[0]
        if best is None:
            return None
        start, edits = best
        return start, best_match(item, words[start:], most)[1], edits


def _searched(items: list[tuple[int, str]], similarity: float):
    ready_made: list[Benchmark] = []

    def rows(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not ready_made:
            ready_made.append(Benchmark(items, similarity))
        benchmark = ready_made[0]
        for batch in portions(source):
            found: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                for n, start, size, edits in benchmark.find(benchmark.spell(text)):
                    similar = 1 - edits / len(benchmark.items[n])
                    found.append((doc_id, benchmark.item_ids[n], start, size, edits, similar))
            columns = list(zip(*found)) if found else [()] * 6
            kinds = (*[pa.int64()] * 5, pa.float64())
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "item_id", "first_word", "n_words", "edits", "similarity"],
            )

    return rows


def _clean(items: list[tuple[int, str]], similarity: float):
    ready_made: list[Benchmark] = []

    def rows(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not ready_made:
            ready_made.append(Benchmark(items, similarity))
        benchmark = ready_made[0]
        for batch in portions(source):
            clean = [not benchmark.find(benchmark.spell(t)) for t in texts_of(batch)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return rows


def _distinct_items(benchmark: DataFrame) -> DataFrame:
    """(number, text, copies): each text once, with a number of its own."""
    texts = benchmark.where("text is not null").groupBy("text").agg(F.count("*").alias("copies"))
    return stored(texts.withColumn("number", F.monotonically_increasing_id()), "items")


def _item_groups(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in groups of bounded size, by a hash."""
    groups = -(-items.count() // ITEMS_AT_ONCE)
    for group in range(groups):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(groups)) == group)
        yield [(r.number, r.text) for r in part.collect()]


MATCHES = "doc_id long, item_id long, first_word long, n_words long, edits long, similarity double"


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """Which documents hold which items: a row per document row and item, with the best place.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Words are runs of letters,
    digits and underscores, in lower case. A passage matches if the word edits between it and
    the item are at most ``1 - similarity`` of the item's words. Reported are the first word
    (from 0), words and edits of the place with the fewest edits, the first one on ties.
    Letters of scripts without spaces are words each. A passage is missed with a chance
    of ``1 - RECALL`` at most; an item of under five words, which no edit is allowed, never.

    Null and wordless texts and items match nothing. Repeated
    documents and items are each reported; so is a null id. Other columns are ignored. Empty
    tables give no rows.
    """
    spark = ready(docs.sparkSession)
    texts = with_text(docs, F.col("doc_id").cast("long").alias("doc_id"))
    found = spark.createDataFrame([], MATCHES)
    distinct = _distinct_items(benchmark)
    for items in _item_groups(distinct):
        found = found.unionByName(texts.mapInArrow(_searched(items, similarity), MATCHES))
    ids = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    named = ids.join(distinct, "text").select("number", "item_id")
    found = found.withColumnRenamed("item_id", "number").join(named, "number")
    return found.select(*[f.split()[0] for f in MATCHES.split(", ")])


def without_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """The rows of ``docs`` that hold no item, whole, whatever their other columns."""
    ready(docs.sparkSession)
    rows = as_rows(docs)
    for items in _item_groups(_distinct_items(benchmark)):
        rows = rows.mapInArrow(_clean(items, similarity), rows.schema)
    return rows.select("row.*")
