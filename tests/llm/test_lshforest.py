"""LSH forest near-duplicates against brute force."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pytest

from coldwatch.llm import lshforest
from coldwatch.llm.common import table

SCHEMA = "source string, doc_id long, text string, node string, row int, digest string"


def brute_set(text: str | None) -> set:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    size = min(3, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute(texts: list[str | None], ids: list[int]) -> dict:
    sets = [brute_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    links = set()
    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            links.add((i, j))
            root[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), least[find(i)], least[find(i)] == ids[i]) for i in range(len(ids))}


def found(spark, rows: list[tuple]) -> dict:
    docs = spark.createDataFrame([("s", i, t, "clash", 1, "x") for i, t in rows], SCHEMA)
    return {r[0]: tuple(r[1:]) for r in lshforest.near_duplicates(docs).collect()}


def varied(seed: int, n: int, length: int, share: float) -> list[str]:
    """``n`` texts that differ from one another in a random ``share`` of up to all places."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(length)]
    texts = []
    for _ in range(n):
        words = list(base)
        for at in np.flatnonzero(rng.random(length) < share * rng.random()):
            words[at] = f"x{rng.integers(1000)}"
        texts.append(" ".join(words))
    return texts


def test_shingles_are_those_of_the_whole_text(monkeypatch):
    monkeypatch.setattr(lshforest, "BYTES_AT_ONCE", 7)
    for text in ["", " \n", "One", "one two", "two one", "ÉTÉ one\x0bTWO\x85x three", "a b c " * 40]:
        assert len(lshforest.shingle_set(text)) == len(brute_set(text))
    assert lshforest.shingle_set("One TWO") == lshforest.shingle_set("one  two\n")
    assert lshforest.shingle_set("one") != lshforest.shingle_set("one one")


def test_groups_against_brute_force(spark):
    texts = [None, "", " \n\t", "one", "One", "one two", "one two three", "ONE two\nthree"]
    texts += varied(1, 60, 80, 0.1) + varied(2, 40, 30, 0.2) + varied(3, 30, 400, 0.06)
    texts += [" ".join(f"u{(i * k) % 997}" for k in range(50)) for i in range(1, 30)]
    texts += texts[8:20]
    ids = [1000 - 3 * i for i in range(len(texts))]
    assert found(spark, list(zip(ids, texts))) == brute(texts, ids)


def test_crowded_regions_lose_no_link(spark, monkeypatch):
    """Short texts crowd the regions; with small blocks every way of comparing is used."""
    monkeypatch.setattr(lshforest.apart, "__defaults__", (16,))
    monkeypatch.setattr(lshforest.confirmed, "__defaults__", (20,))
    texts = varied(4, 150, 60, 0.12) + varied(5, 150, 60, 0.12)
    ids = list(range(len(texts)))
    assert found(spark, list(zip(ids, texts))) == brute(texts, ids)


def test_given_documents_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute([t for _, t in rows], [i for i, _ in rows])
    got = {r[0]: tuple(r[1:]) for r in lshforest.near_duplicates(docs).collect()}
    assert got == expected


def test_repeated_null_and_missing_ids(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (5, "other words here"), (None, "a b c d"), (3, None)]
    docs = spark.createDataFrame([("s", i, t, "", 0, "") for i, t in rows], SCHEMA)
    got = sorted(map(tuple, lshforest.near_duplicates(docs).collect()), key=str)
    assert got == sorted(
        [(5, 2, 5, True), (5, 2, 5, True), (5, 1, 5, True), (None, 2, 5, False), (3, 0, 3, True)],
        key=str,
    )
    assert lshforest.near_duplicates(docs.limit(0)).count() == 0


def test_long_text(spark):
    text = " ".join(str(i % 70_001) for i in range(300_000))
    got = found(spark, [(1, text), (2, text + " end"), (3, "short")])
    assert got == {1: (70_001, 1, True), 2: (70_002, 1, False), 3: (1, 3, True)}


def test_recall_of_pairs_at_the_threshold():
    """Sets of similarity 0.85 share a region in all but some 1 in 10,000 cases."""
    rng = np.random.default_rng(8)
    missed = 0
    for _ in range(2000):
        common = rng.integers(0, 1 << 63, 85, dtype=np.uint64)
        a, b = (np.concatenate((common, rng.integers(0, 1 << 63, n, dtype=np.uint64))) for n in (8, 7))
        x, y = lshforest.signature(a), lshforest.signature(b)
        same = (x == y).reshape(lshforest.TREES, lshforest.DEPTH)[:, : lshforest.LEAST].all(axis=1)
        missed += not (same.any() and lshforest._alike(x, y))
    assert missed <= 4


@pytest.mark.parametrize("share", [4, 1])
def test_skew_join_equals_join(spark, share):
    from coldwatch.llm.joins import skew_join

    many = spark.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(40)] + [(None, -1)], "k long, v long")
    one = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "k long, name string")
    for how in ("inner", "left"):
        assert sorted(map(str, skew_join(many, one, "k", how, share).collect())) == sorted(
            map(str, many.join(one, "k", how).collect())
        )
