"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its letter n-grams, hashed to ``BUCKETS``
rows; a linear layer and a softmax give the languages. Embeddings and layer are trained
together by stochastic gradient descent in numpy on a bounded sample. A part of the
sample is kept back: it sets the temperature of the softmax, so that scores are
probabilities, and the score below which a prediction is rejected.

Since both layers are linear, their product gives each bucket a vote per language, and
applying the model is an average of votes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldwatch.llm.common import crc_remainder, extended, lists, portions, ready, texts_of
from coldwatch.llm.sampling import bounded_sample

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
ORDERS = (1, 2, 3)
DIMENSIONS = 16
SAMPLE = 3000  # documents the model is fitted on, at most
EPOCHS = 12
BATCH = 32
RATE = 4.0
KEPT_BACK = 5  # one in so many sampled documents calibrates
REJECTED_SHARE = 0.001  # of calibration documents, at most
HIGHEST_THRESHOLD = 0.5
CHARACTERS_AT_ONCE = 1 << 18
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For every code point: is it a letter."""
    return np.fromiter(
        (chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000
    )


def subwords(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text's letters, words marked at both ends; in portions.

    Nothing is given for a text without letters.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    for at in range(0, len(codes), CHARACTERS_AT_ONCE):
        part = codes[at : at + CHARACTERS_AT_ONCE + max(ORDERS) - 1]
        letter = _letters()[part]
        if not letter.any():
            continue
        part = np.where(letter, part, 32).astype(np.uint64)
        part = np.concatenate(([np.uint64(32)], part, [np.uint64(32)]))
        found = []
        rolled, some = part * np.uint64(0x9E3779B97F4A7C15), part != 32
        for n in range(1, max(ORDERS) + 1):
            if n > 1:
                if len(part) < n:
                    break
                rolled = rolled[:-1] * np.uint64(0x100000001B3) + part[n - 1 :]
                some = some[:-1] | (part[n - 1 :] != 32)
            if n in ORDERS:
                mixed = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                found.append((mixed >> np.uint64(64 - BUCKET_BITS))[some])
        yield np.concatenate(found).astype(np.int64)


def subword_counts(text: str) -> np.ndarray:
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for buckets in subwords(text):
        counts += np.bincount(buckets, minlength=BUCKETS)
    return counts


@dataclass
class LanguageModel:
    languages: list[str]
    votes: np.ndarray  # buckets x languages, divided by the temperature
    threshold: float

    def scores(self, text: str) -> np.ndarray | None:
        """Probability of each language; None for a text without letters."""
        total, count = np.zeros(len(self.languages)), 0
        for buckets in subwords(text):
            total += self.votes.take(buckets, axis=0).sum(axis=0, dtype=np.float64)
            count += len(buckets)
        return _softmax(total[None] / count)[0] if count and len(self.languages) else None


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _averages(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for i, (buckets, counts) in enumerate(rows):
        x[i, buckets] = counts / max(counts.sum(), 1)
    return x


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> LanguageModel:
    """``rows``: language, buckets and their counts."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), 0.0)
    rng = np.random.default_rng(seed)
    target = np.array([languages.index(r[0]) for r in rows])
    features = [r[1:] for r in rows]
    order = rng.permutation(len(rows))
    held, fitted = order[: len(order) // KEPT_BACK], order[len(order) // KEPT_BACK :]
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(fitted), BATCH):
            pick = fitted[at : at + BATCH]
            x = _averages([features[i] for i in pick])
            hidden = x @ embed
            error = _softmax(hidden @ layer)
            error[np.arange(len(pick)), target[pick]] -= 1
            error /= len(pick)
            to_embed = x.T @ (error @ layer.T)
            layer -= rate * (hidden.T @ error)
            embed -= rate * 20 * to_embed  # each bucket gets a small part of an average
        rng.shuffle(fitted)
    votes = embed @ layer
    if not len(held):
        return LanguageModel(languages, votes, 0.0)  # nothing to calibrate on: rejects no letters
    logits = np.concatenate(
        [_averages([features[i] for i in held[a : a + 256]]) @ votes
         for a in range(0, len(held), 256)]
    )
    temperature = min(
        np.geomspace(0.05, 20, 60),
        key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(held)), target[held]] + 1e-12).mean(),
    )
    best = _softmax(logits / temperature).max(axis=1)
    # Conformal: a text like those held back scores below the k-th lowest of n with a chance of
    # k / (n + 1) at most, whatever n is.
    place = max(1, int(REJECTED_SHARE * (len(best) + 1)))
    threshold = min(HIGHEST_THRESHOLD, float(np.sort(best)[place - 1]))
    return LanguageModel(languages, (votes / temperature).astype(np.float32), threshold)


def _counted(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(source):
        counts = [subword_counts(t) for t in texts_of(batch)]
        buckets = [np.flatnonzero(c) for c in counts]
        sizes = [len(b) for b in buckets]
        yield pa.record_batch(
            [batch.column("lang"),
             lists(np.concatenate(buckets).astype(np.int32), sizes, pa.int32()),
             lists(np.concatenate([c[b] for c, b in zip(counts, buckets)]), sizes, pa.int64())],
            names=["lang", "buckets", "counts"],
        )


def fit(labelled: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Fits on at most ``sample`` rows of ``labelled`` (doc_id, text, lang); null labels are left out."""
    ready(labelled.sparkSession)
    rows = labelled.where("lang is not null").select("doc_id", "text", "lang")
    picked = bounded_sample(rows, "doc_id", sample, seed=6).select("text", "lang")
    counted = picked.mapInArrow(_counted, "lang string, buckets array<int>, counts array<long>")
    return train(
        [
            (r.lang, np.array(r.buckets, dtype=np.int64), np.array(r.counts, dtype=np.float32))
            for r in counted.collect()
            if r.buckets
        ]
    )


def _predicted(model: LanguageModel, column: str, names: list[str]):
    def rows(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(source):
            lang, score = [], []
            for text in texts_of(batch, column):
                p = model.scores(text)
                best = None if p is None else int(p.argmax())
                lang.append(UNKNOWN if best is None else model.languages[best])
                score.append(0.0 if best is None else float(p[best]))
            rejected = [a == UNKNOWN or s < model.threshold for a, s in zip(lang, score)]
            yield pa.record_batch(
                [*(batch.column(n) for n in names), pa.array(lang), pa.array(score, pa.float64()),
                 pa.array(rejected)],
                names=[*names, "lang_pred", "score", "rejected"],
            )

    return rows


def identify(docs: DataFrame, model: LanguageModel, *carried: str) -> DataFrame:
    """Columns ``carried`` of ``docs``, lang_pred, score, rejected; one row per row.

    The whole text is used. A null text or one without letters is ``und`` with score 0,
    and so is every text if the model saw no labelled row. Repeated rows are judged
    alike. An empty table gives no rows.
    """
    ready(docs.sparkSession)
    schema = extended(docs, list(carried), "lang_pred string, score double, rejected boolean")
    extra = [] if "text" in carried else [F.col("text")]
    return docs.select(*carried, *extra).mapInArrow(_predicted(model, "text", list(carried)), schema)


def learnt_from(docs: DataFrame) -> DataFrame:
    """The rows a model may learn from: held out are ids whose CRC-32 leaves 2 by 4."""
    return docs.where(crc_remainder("doc_id", 4) != 2)
