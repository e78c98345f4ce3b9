"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages, of which only the bag has a label. Every passage of
``PASSAGE_WORDS`` words is encoded: shares of character kinds and of their successions, and
how its words repeat. A gated attention, tanh times sigmoid of two projections, weighs the
passages against each other; the label is predicted from their weighted average by
a logistic layer. All of it is learnt from document labels alone, by gradient descent in
numpy on a bounded sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldwatch.llm.common import crc_remainder, extended, portions, ready, texts_of
from coldwatch.llm.sampling import bounded_sample
from coldwatch.llm.wordpieces import release

PASSAGE_WORDS = 64
PASSAGES_AT_ONCE = 2048
CHARACTERS_AT_ONCE = 1 << 20
SPACE = re.compile(r"\s")
MARKS = ".,!?|%&$#*:;-_/'\"@"  # each a kind of its own
KINDS = 7 + len(MARKS)
WORD_FEATURES = 5
FEATURES = KINDS + KINDS * KINDS + WORD_FEATURES
KIND_EMPHASIS, WORD_EMPHASIS = 3, 8
HIDDEN = 16
SAMPLE = 4000  # documents the model is fitted on, at most
EPOCHS = 40
BATCH = 64
RATE = 0.01
DECAY = 1e-3
THRESHOLD = 0.3


@cache
def _kinds() -> np.ndarray:
    """A kind for every code point: space, lower, upper, other letter, digit, mark, other."""
    table = np.full(0x110000, 5, dtype=np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isspace():
            table[c] = 0
        elif ch.isupper():
            table[c] = 2
        elif ch.islower():
            table[c] = 1
        elif ch.isalpha():
            table[c] = 3
        elif ch.isdigit():
            table[c] = 4
        elif c < 128:
            table[c] = 6
    for n, ch in enumerate(MARKS):
        table[ord(ch)] = 7 + n
    return table


def _pair_counts(joined: str, sizes: np.ndarray) -> np.ndarray:
    """Per passage how often kinds of characters follow each other, some characters at a time."""
    counts = np.zeros(len(sizes) * KINDS * KINDS, dtype=np.int64)
    ends = np.cumsum(sizes)
    for at in range(0, len(joined) - 1, CHARACTERS_AT_ONCE):
        piece = joined[at : at + CHARACTERS_AT_ONCE + 1]
        kind = _kinds()[np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)].astype(np.int64)
        first = int(np.searchsorted(ends, at, side="right"))
        stop = int(np.searchsorted(ends, at + len(piece) - 2, side="right")) + 1
        of = np.repeat(np.arange(stop - first), np.diff(np.clip(ends[first:stop], at, at + len(piece) - 1), prepend=at))
        pair = kind[:-1] * KINDS + kind[1:] + of * (KINDS * KINDS)
        found = np.bincount(pair, minlength=(stop - first) * KINDS * KINDS)
        counts[first * KINDS * KINDS : stop * KINDS * KINDS] += found
    return counts


def _block(passages: list[list[str]]) -> np.ndarray:
    """Encodings of some passages."""
    joined = [" ".join(p) for p in passages]
    sizes = np.array([len(j) + 1 for j in joined])
    pairs = _pair_counts(" ".join(joined) + " ", sizes)
    pairs = pairs.reshape(len(passages), KINDS, KINDS) / sizes[:, None, None]
    words = np.empty((len(passages), WORD_FEATURES))
    for i, p in enumerate(passages):
        repeats = sum(map(str.__eq__, p[1:], p[:-1]))
        distinct = len(set(p))
        words[i] = (
            distinct / len(p), repeats / len(p), min(sizes[i] / len(p), 50) / 10,
            len(p) / PASSAGE_WORDS, len(set(map(len, p))) / len(p),
        )
    return np.concatenate(
        [pairs.sum(axis=2), pairs.reshape(len(passages), -1), words], axis=1
    ).astype(np.float32)


def _words(text: str) -> Iterator[list[str]]:
    """The words of a whole text, some at a time."""
    at = 0
    while at < len(text):
        space = SPACE.search(text, at + CHARACTERS_AT_ONCE)
        end = space.start() if space else len(text)
        yield text[at:end].split()
        at = end


def encodings(text: str) -> Iterator[np.ndarray]:
    """A row per passage of a whole text, in blocks; one row of zeros if it has no words."""
    most, words, any_words = PASSAGE_WORDS * PASSAGES_AT_ONCE, [], False
    for more in _words(text):
        words += more
        while len(words) > most:
            yield _block([words[a : a + PASSAGE_WORDS] for a in range(0, most, PASSAGE_WORDS)])
            words, any_words = words[most:], True
    if words:
        yield _block([words[a : a + PASSAGE_WORDS] for a in range(0, len(words), PASSAGE_WORDS)])
    elif not any_words:
        yield np.zeros((1, FEATURES), dtype=np.float32)


def encode(text: str) -> np.ndarray:
    """All of ``encodings`` at once."""
    return np.concatenate(list(encodings(text)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, bags: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Scores of bags of encoded passages; ``starts`` are their first rows."""
        w = self.weights
        h = (bags - self.mean) / self.spread
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        raw = (t * s) @ w["a"]
        sizes = np.diff(np.append(starts, len(bags)))
        e = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), sizes))
        weight = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(h * weight[:, None], starts)
        score = _sigmoid(z @ w["c"] + w["b"])
        return {"h": h, "t": t, "s": s, "weight": weight, "z": z, "score": score, "sizes": sizes}

    def score(self, text: str) -> tuple[float, int]:
        """Score, and the passage that weighs most.

        The weighted average is kept up to date block by block, relative to the largest weight
        so far, so memory does not grow with the number of passages.
        """
        w = self.weights
        most, total, sums, best, before = -np.inf, 0.0, np.zeros(FEATURES), 0, 0
        for block in encodings(text):
            h = (block - self.mean) / self.spread
            raw = (np.tanh(h @ w["V"]) * _sigmoid(h @ w["U"])) @ w["a"]
            at = int(raw.argmax())
            if raw[at] > most:
                shrunk = np.exp(most - raw[at])
                most, best = raw[at], before + at
                total, sums = total * shrunk, sums * shrunk
            e = np.exp(raw - most)
            total, sums = total + e.sum(), sums + e @ h
            before += len(block)
        return float(_sigmoid(sums / total @ w["c"] + w["b"])[0]), best


def _gradients(model: QualityModel, out: dict, starts: np.ndarray, y: np.ndarray) -> dict:
    w, h, weight, sizes = model.weights, out["h"], out["weight"], out["sizes"]
    error = (out["score"] - y) / len(y)
    to_z = error[:, None] * w["c"]
    gain = np.einsum("ij,ij->i", h, np.repeat(to_z, sizes, axis=0))
    mean = np.repeat(np.add.reduceat(gain * weight, starts), sizes)
    to_raw = weight * (gain - mean)
    gate = out["t"] * out["s"]
    to_gate = to_raw[:, None] * w["a"]
    return {
        "c": out["z"].T @ error, "b": np.array([error.sum()]), "a": gate.T @ to_raw,
        "V": h.T @ (to_gate * out["s"] * (1 - out["t"] ** 2)),
        "U": h.T @ (to_gate * out["t"] * out["s"] * (1 - out["s"])),
    }


def train(bags: list[np.ndarray], labels: list[int], seed: int = 3) -> QualityModel:
    """Adam on the log-loss of the bags' labels. Without labels, every score is a half."""
    rng = np.random.default_rng(seed)
    weights = {
        "V": rng.normal(0, 0.1, (FEATURES, HIDDEN)), "U": rng.normal(0, 0.1, (FEATURES, HIDDEN)),
        "a": rng.normal(0, 0.1, HIDDEN), "c": np.zeros(FEATURES), "b": np.zeros(1),
    }
    if not bags:
        return QualityModel(np.zeros(FEATURES), np.ones(FEATURES), weights)
    total = sum(len(b) for b in bags)
    mean = sum(b.sum(axis=0, dtype=np.float64) for b in bags) / total
    spread = np.sqrt(sum(((b - mean) ** 2).sum(axis=0) for b in bags) / total)
    # Rare kinds are not blown up: a share of one percent counts as one spread at least. The
    # few features of words and single kinds are not outvoted by the many successions.
    spread = np.maximum(spread, 0.01)
    spread[:KINDS] /= KIND_EMPHASIS
    spread[-WORD_FEATURES:] /= WORD_EMPHASIS
    model = QualityModel(mean, spread, weights)
    y = np.array(labels, dtype=np.float64)
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            chosen = [bags[i] for i in pick]
            starts = np.cumsum([0] + [len(b) for b in chosen[:-1]])
            out = model.forward(np.concatenate(chosen).astype(np.float64), starts)
            step += 1
            for k, g in _gradients(model, out, starts, y[pick]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = first[k] / (1 - 0.9**step)
                weights[k] -= RATE * (
                    move / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    + (DECAY * weights[k] if k != "b" else 0)
                )
    return model


def _encoded(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in portions(source):
        bags = [encode(t).astype(np.float16).tobytes() for t in texts_of(batch)]
        yield pa.record_batch(
            [batch.column("quality"), pa.array(bags, pa.binary())], names=["quality", "bag"]
        )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Fits on at most ``sample`` labelled documents, joined on ``doc_id``.

    Labels that are null or contradict each other are left out.
    """
    spark = ready(docs.sparkSession)
    clear = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most")
        .select("doc_id", "quality")
    )
    # At most ``sample`` ids and labels, so they can be sent to every task.
    chosen = bounded_sample(clear, "doc_id", sample, seed=3).collect()
    few = spark.createDataFrame(chosen, clear.schema)
    # Rows may repeat an id; the bound holds for them too.
    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").limit(sample)
    rows = texts.select("quality", "text").mapInArrow(_encoded, f"quality {_kind(labels)}, bag binary")
    found = sorted((int(r.quality), bytes(r.bag)) for r in rows.collect())
    bags = [np.frombuffer(b, np.float16).reshape(-1, FEATURES).astype(np.float32) for _, b in found]
    return train(bags, [1 if q > 0 else 0 for q, _ in found])


def _kind(labels: DataFrame) -> str:
    return labels.schema["quality"].dataType.simpleString()


def _scored(model: QualityModel, names: list[str]):
    def rows(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in portions(source):
            score = [model.score(t)[0] for t in texts_of(batch)]
            predicted = [int(s >= THRESHOLD) for s in score]
            yield pa.record_batch(
                [*(batch.column(n) for n in names), pa.array(score, pa.float64()),
                 pa.array(predicted, pa.int32())],
                names=[*names, "score", "predicted"],
            )

    return rows


def score(docs: DataFrame, model: QualityModel, *carried: str) -> DataFrame:
    """Columns ``carried`` of ``docs``, score (0 to 1) and predicted (score >= 0.3).

    The whole text is scored. Null, empty and wordless texts are one empty passage. Repeated
    rows are scored alike. An empty table gives no rows.
    """
    ready(docs.sparkSession)
    schema = extended(docs, list(carried), "score double, predicted int")
    extra = [] if "text" in carried else [F.col("text")]
    return docs.select(*carried, *extra).mapInArrow(_scored(model, list(carried)), schema)


def learnt_from(labels: DataFrame) -> DataFrame:
    """The labels a model may learn from: held out are ids whose CRC-32 is divisible by 5."""
    return labels.where(crc_remainder("doc_id", 5) != 0)
