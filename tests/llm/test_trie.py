"""The prefix trie against a plain recursion over whole sequences."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from coldwatch.llm import trie
from coldwatch.llm.spilling import SpillingQueue

SCHEMA = "conv string, conv_id long, turn int, role string, text string, depth int, words int"


def brute(rows: list[tuple]) -> set[tuple]:
    convs: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            told = (role or "", text or "")
            mark = hashlib.sha256(f"{len(told[0])}:{told[0]}{told[1]}".encode()).digest()[:16]
            convs.setdefault(conv, []).append((turn is not None, turn or 0, mark, told))
    said = {c: [t[-1] for t in sorted(own)] for c, own in convs.items()}
    members: dict[tuple, list] = {}
    ends: dict[tuple, list] = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        rebuilt = said.get(base, [])[:h] + own[h:]
        for d in range(len(rebuilt) + 1):
            members.setdefault(tuple(rebuilt[:d]), []).append(c)
        ends.setdefault(tuple(rebuilt), []).append(c)
    children: dict[tuple, int] = {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, own in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(own) - 1) * words
    return {
        (
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own),
            children.get(node, 0), leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        )
        for node, own in members.items()
    }


def found(spark, rows: list[tuple], *args, slices: int = 3) -> set[tuple]:
    docs = spark.createDataFrame([("x", *r, 0, 0) for r in rows], SCHEMA).repartition(slices)
    got = [tuple(r) for r in trie.prefix_trie(docs, *args).collect()]
    assert len(got) == len(set(got))
    return set(got)


def random_rows(seed: int, convs: int, depth: int, kinds: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 3 * convs), convs):
        for turn in range(rng.randint(1, depth)):
            text = " ".join(["w"] * rng.randint(0, 3)) + str(rng.randrange(kinds))
            rows.append((c, turn, rng.choice(["user", "assistant"]), text))
    return rows


@pytest.mark.parametrize("heavy,band,limit", [(256, 1024, 1000), (2, 2, 3), (1, 3, 5), (1000, 2, 1)])
def test_random_conversations(spark, monkeypatch, heavy, band, limit):
    monkeypatch.setattr(trie, "PIECE", 40)
    monkeypatch.setattr(trie, "CHUNK", 3)
    rows = random_rows(heavy, 70, 9, 2)
    assert found(spark, rows, heavy, band, limit) == brute(rows)


def test_a_long_conversation_and_its_copies_are_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 100)
    long = [(t, "user", f"turn {t}") for t in range(700)]
    rows = [(c, *t) for c in (20, 21, 25, 47) for t in long] + [(22, t, "user", "a") for t in range(5)]
    assert found(spark, rows, 1, 50, 10) == brute(rows)


def test_a_hot_beginning(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    rows = [(c, 0, "user", "hello there") for c in range(300)]
    rows += [(c, 1, "assistant", f"answer {c % 5}") for c in range(0, 300, 2)]
    assert found(spark, rows, 16, 4, 10) == brute(rows)


def test_nulls_ties_repeats_and_missing_bases(spark):
    rows = [
        (1, None, "user", "first"), (1, 0, None, "second"), (1, 0, "user", None), (1, 0, "user", None),
        (1, 3, "user", ""), (None, 0, "user", "nobody's"), (2, 0, "user", "a b\tc"), (5, 0, "u", "x"),
        (6, 0, "u", "x"), (41, 0, "user", "é\x85 z"), (41, 0, "user", "é\x85 z"), (-3, 1, "a", "b"),
    ]
    assert found(spark, rows) == brute(rows)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(empty).collect() == []
    nobody = spark.createDataFrame([("x", None, 0, "user", "t", 0, 0)], SCHEMA)
    assert trie.prefix_trie(nobody).collect() == []


def test_long_text(spark):
    rows = [(20, 0, "user", "word " * 500_000), (40, 0, "user", "word " * 500_000)]
    assert found(spark, rows) == brute(rows)


def test_queue_spills_in_order():
    rng = random.Random(1)
    queue, model = SpillingQueue(10), []
    for step in range(5000):
        if rng.random() < 0.55 or not model:
            entry = (rng.randrange(1000), step)
            queue.push(entry)
            model.append(entry)
        else:
            assert queue.peek() == min(model) == queue.pop()
            model.remove(min(model))
    assert [queue.pop() for _ in model] == sorted(model) and queue.peek() is None
