"""SimHash near-duplicates against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from coldwatch.llm import simhash

SCHEMA = "source string, doc_id long, text string, print string"


def brute_fingerprint(text: str) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    size = min(4, len(words))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(
        1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)
    )


def brute_components(prints: dict[int, int], bits: int = 4) -> dict[int, int]:
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_fingerprint_of_whole_texts(spark):
    for text in ["", "  \n\t", "One", "ÉTÉ one TWO three", "a b c d e\x0bf\x85g h", "x " * 500]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_documents_against_brute_force(spark):
    base = [f"word{i}" for i in range(60)]
    texts = [None, "", " \n", "short", "short", "Short"]
    for i in range(40):
        words = list(base)
        words[(7 * i) % 60] = f"other{i % 9}"
        texts.append(" ".join(words) if i % 3 else "\n".join(words))
    texts += [" ".join(f"w{(i * k) % 97}" for k in range(80)) for i in range(40)]
    rows = [("s", i, t, "clash") for i, t in enumerate(texts)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = {i: brute_fingerprint(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: r.print % (1 << 64) for r in found} == prints
    assert {r.doc_id: r.component_id for r in found} == brute_components(prints)


def test_empty_table_and_repeated_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [("s", 5, "a b c d", None), ("s", 5, "a b c d", None), ("s", None, "a b c d", None)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in found) == [(-1, 5), (5, 5), (5, 5)]


def _clouds() -> np.ndarray:
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = [rng.integers(0, 1 << 63, 400, dtype=np.uint64)]
    for n, c in enumerate(centres):
        flips = np.zeros(60, dtype=np.uint64)
        for _ in range(1 + n % 4):
            flips ^= np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)
        prints.append(c ^ flips)
    return np.unique(np.concatenate(prints))


@pytest.mark.parametrize("strip, pairwise", [(4096, 24), (16, 4), (50, 2)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, strip, pairwise):
    monkeypatch.setattr(simhash, "STRIP", strip)
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    prints = _clouds()
    points = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long")
    found = simhash.links(points).collect()
    for r in found:
        assert ((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 4
    got = simhash.components(spark.createDataFrame(found, "a long, b long"), "a", "b").collect()
    want = brute_components({int(p): int(p) % (1 << 64) for p in prints.view(np.int64)})
    assert {r.node: r.root for r in got} == {p: r for p, r in want.items() if p != r}


def test_grid_meets_every_close_pair():
    rng = np.random.default_rng(2)
    masks = simhash.grid_masks()
    assert len(masks) == 35
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.integers(0, 64, 4):
            b ^= 1 << int(bit)
        x, y = (simhash.segment_code(np.array([v], np.uint64))[0] for v in (a, b))
        assert any(int(x) & m == int(y) & m for m in masks)
        assert (int(x) ^ int(y)).bit_count() <= (a ^ b).bit_count()
