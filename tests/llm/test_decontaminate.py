"""Decontamination against brute force over all windows."""

from __future__ import annotations

import random

from coldwatch.llm import decontaminate
from coldwatch.llm.decontaminate import best_match, edits_allowed, words_of

DOCS = "item_id string, doc_id long, text string, edits string"
ITEMS = "item_id long, text string, doc_id int"


def edit_row(item: list, text: list) -> list[int]:
    """Edits from ``item`` to every beginning of ``text``."""
    row = list(range(len(text) + 1))
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != v)))
        row = new
    return row


def brute(docs: list, items: list) -> dict:
    out: dict = {}
    for doc_id, text in docs:
        words = words_of(text or "")
        for item_id, item_text in items:
            item = words_of(item_text or "")
            if len(item) < 5:
                continue
            most = edits_allowed(len(item))
            best = min(
                ((min(edit_row(item, words[p : p + len(item) + most])), p) for p in range(len(words))),
                default=(len(item), 0),
            )
            if best[0] <= most:
                out[doc_id, item_id] = best
    return out


def edited(rng: random.Random, words: list[str], edits: int, vocabulary: list[str]) -> list[str]:
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = rng.choice(vocabulary)
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, rng.choice(vocabulary))
    return words


def fixture() -> tuple[list, list]:
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "é"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 6, 9, 15, 22, 40])))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "too short here"), (103, items[4][1])]
    docs: list = [(0, None), (1, ""), (2, " \n"), (3, "w1 w2 w3")]
    for n in range(60):
        item = rng.choice(items[:30])[1].split()
        body = edited(rng, item, rng.randint(0, edits_allowed(len(item))), vocabulary)
        if n % 4 == 0:
            body = [w.upper() + "," for w in item]
        before, after = (rng.choices(vocabulary, k=rng.randint(0, 60)) for _ in range(2))
        docs.append((10 + n, " ".join([*before, *body, *after])))
    docs += [(200 + n, " ".join(rng.choices(vocabulary, k=200))) for n in range(20)]
    docs.append((300, items[0][1] + " " + " ".join(["w1 w2"] * 40_000) + " " + items[1][1]))
    return docs, items


def test_against_brute_force(spark):
    docs, items = fixture()
    found = decontaminate.contaminated(
        spark.createDataFrame([("x", d, t, "y") for d, t in docs], DOCS),
        spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS),
    ).collect()
    want = brute(docs[:-1], items)
    got = {(r.doc_id, r.item_id): (r.edits, r.first_word) for r in found}
    assert {(300, 0), (300, 1)} <= got.keys()
    got = {k: v for k, v in got.items() if k[0] != 300}
    assert got.keys() <= want.keys()
    assert len(got) >= 0.97 * len(want)
    assert all(got[k][0] >= want[k][0] for k in got)
    assert sum(got[k] == want[k] for k in got) >= 0.97 * len(got)
    for r in found:
        size = len(words_of(dict(items)[r.item_id]))
        assert abs(r.similarity - (1 - r.edits / size)) < 1e-12


def test_recall_at_the_most_edits():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(800)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(14, 57)))) for i in range(100)]
    benchmark = decontaminate.Benchmark(items)
    hits = 0
    for i, text in items:
        words = text.split()
        body = edited(rng, words, edits_allowed(len(words)), vocabulary)
        doc = rng.choices(vocabulary, k=50) + body + rng.choices(vocabulary, k=50)
        hits += any(n == i for n, *_ in benchmark.find(benchmark.spell(" ".join(doc))))
    assert hits >= 95


def test_one_sided_edits_of_long_items():
    """Pure deletions and pure insertions, as many as are allowed: every one is found."""
    rng = random.Random(20)
    vocabulary = [f"w{i}" for i in range(3000)]
    for length in (59, 120, 250):
        items = [(i, " ".join(rng.choices(vocabulary, k=length))) for i in range(20)]
        benchmark = decontaminate.Benchmark(items)
        most = edits_allowed(length)
        for i, text in items:
            for inserted in (False, True):
                body = text.split()
                for _ in range(most):
                    if inserted:
                        body.insert(rng.randrange(1, len(body)), "new")
                    else:
                        del body[rng.randrange(1, len(body) - 1)]
                doc = rng.choices(vocabulary, k=50) + body + rng.choices(vocabulary, k=50)
                found = {n: edits for n, _, _, edits in benchmark.find(benchmark.spell(" ".join(doc)))}
                assert found.get(i, most + 1) <= most, (length, inserted)


def test_every_passage_of_brute_force_is_found(spark):
    docs, items = fixture()
    found = decontaminate.contaminated(
        spark.createDataFrame([("x", d, t, "y") for d, t in docs[:-1]], DOCS),
        spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS),
    ).collect()
    assert {(r.doc_id, r.item_id): (r.edits, r.first_word) for r in found} == brute(docs[:-1], items)


def test_best_match_against_plain_rows():
    import numpy as np

    rng = random.Random(4)
    for _ in range(300):
        item = [rng.randint(0, 4) for _ in range(rng.randint(1, 12))]
        text = [rng.randint(0, 4) for _ in range(rng.randint(0, 20))]
        most = rng.randint(0, 6)
        row = edit_row(item, text[: len(item) + most])
        got = best_match(np.array(item), np.array(text, dtype=int), most)
        assert (got and got[0]) == (min(row) if min(row) <= most else None)


def test_clean_rows_stay_whole(spark):
    docs, items = fixture()
    frame = spark.createDataFrame([("x", d, t, "y") for d, t in docs] + [("x", None, "w9", "y")] * 2, DOCS)
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    dirty = {r.doc_id for r in decontaminate.contaminated(frame, benchmark).collect()}
    kept = decontaminate.without_contaminated(frame, benchmark)
    assert kept.schema == frame.schema
    rows = [tuple(r) for r in kept.collect()]
    assert sorted(rows, key=str) == sorted(
        (tuple(r) for r in frame.collect() if r.doc_id not in dirty), key=str
    )


def test_groups_of_items_and_empty_tables(spark, monkeypatch):
    docs, items = fixture()
    frame = spark.createDataFrame([("x", d, t, "y") for d, t in docs[:40]], DOCS)
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    whole = sorted(map(tuple, decontaminate.contaminated(frame, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 10)
    parts = sorted(map(tuple, decontaminate.contaminated(frame, benchmark).collect()))
    assert {(a, b) for a, b, *_ in parts} == {(a, b) for a, b, *_ in whole}
    nothing = benchmark.limit(0)
    assert decontaminate.contaminated(frame, nothing).collect() == []
    assert decontaminate.without_contaminated(frame, nothing).count() == 40
    assert decontaminate.contaminated(frame.limit(0), benchmark).collect() == []


def test_recall_of_mixed_and_one_sided_edits():
    """At the most edits allowed, for items of 15 to 250 words: 0.99 of the exact search at least."""
    rng = random.Random(30)
    vocabulary = [f"w{i}" for i in range(3000)]
    for length in (15, 60, 120, 250):
        items = [(i, " ".join(rng.choices(vocabulary, k=length))) for i in range(60)]
        benchmark = decontaminate.Benchmark(items)
        most = edits_allowed(length)
        for kind in ("mixed", "deleted", "inserted"):
            hits = 0
            for i, text in items:
                body = text.split()
                if kind == "mixed":
                    body = edited(rng, body, most, vocabulary)
                for _ in range(0 if kind == "mixed" else most):
                    if kind == "inserted":
                        body.insert(rng.randrange(1, len(body)), rng.choice(vocabulary))
                    else:
                        del body[rng.randrange(1, len(body) - 1)]
                doc = rng.choices(vocabulary, k=50) + body + rng.choices(vocabulary, k=50)
                hits += any(n == i for n, *_ in benchmark.find(benchmark.spell(" ".join(doc))))
            assert hits >= 0.99 * len(items) - 0.6, (length, kind, hits)


def test_repetitions_follow_from_the_recall():
    import numpy as np

    rng = np.random.default_rng(6)
    for length in (5, 8, 12):
        times = decontaminate.repetitions(length, 1)
        missed = 0
        for trial in range(1500):
            walks = decontaminate.Walks(length, times, seed=100 + trial)
            part = rng.permutation(500)[:length]
            other = np.append(np.delete(part, rng.integers(length)), rng.integers(500, 900, length))
            start = np.zeros(1, np.int64)
            missed += not (walks.codes(part, start) == walks.codes(other, start)).any()
        assert missed <= 6, (length, times)


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "four words stand here"), (2, "\u5929\u5730\u7384\u9ec4\u5b87\u5b99\u6d2a\u8352\u65e5\u6708"), (3, "one"), (4, "one")]
    docs = [
        (1, "So four WORDS stand, here."), (2, "four words or more stand here"),
        (3, "\u300c\u5929\u5730\u7384\u9ec4\uff0c\u5b87\u5b99\u6d2a\u8352\u65e5\u6708\u300d"), (4, "\u5929\u5730\u5b87\u5b99"), (5, "Only ONE"),
    ]
    found = decontaminate.contaminated(
        spark.createDataFrame([("x", d, t, "y") for d, t in docs], DOCS),
        spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS),
    ).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (3, 2), (5, 3), (5, 4)}
