"""The pipeline against a plain version of its stages, and planted documents."""

from __future__ import annotations

import os
import sys

import numpy as np
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402

from coldwatch.llm import language, quality, simhash, stages  # noqa: E402
from coldwatch.llm.common import shared_folder, table  # noqa: E402
from coldwatch.llm.decontaminate import edits_allowed, words_of  # noqa: E402
from coldwatch.llm.wordpieces import default_path  # noqa: E402

SF = "/root/testdata/sf0.001"


def holds(words: list[str], item: list[str]) -> bool:
    """Some beginning at some word is within the edits allowed."""
    most = edits_allowed(len(item))
    if len(item) < 5 or len(words) < len(item) - most:
        return False
    text = np.array([hash(w) for w in words])
    row = np.zeros(len(words) + 1, dtype=int)  # a match may start anywhere
    columns = np.arange(len(words) + 1)
    for i, w in enumerate(item, 1):
        step = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (text != hash(w)))))
        row = np.minimum.accumulate(step - columns) + columns
    return bool(row.min() <= most)


def plain(spark, sf_dir: str) -> dict:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    model = language.fit(language.learnt_from(docs))
    kept = {}
    for i, t in rows.items():
        p = model.scores(t)
        if p is not None and p.max() >= model.threshold:
            kept[i] = t
    schema = docs.schema
    left = spark.createDataFrame([r for r in docs.collect() if r.doc_id in kept], schema)
    scorer = quality.fit(left, quality.learnt_from(labels))
    kept = {i: t for i, t in kept.items() if scorer.score(t)[0] >= quality.THRESHOLD}
    prints = {i: simhash.fingerprint(t) for i, t in kept.items()}
    root = {i: i for i in kept}
    for a in sorted(prints):
        for b in sorted(prints):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = a, b
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
    kept = {i: t for i, t in kept.items() if root[i] == i}
    items = [words_of(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    kept = {i: t for i, t in kept.items() if not any(holds(words_of(t), x) for x in items)}
    tokenizer = Tokenizer.from_file(default_path())
    return {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in kept.items()}


def test_pipeline_against_plain_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    want = plain(spark, SF)
    assert 50 < len(want) < 200
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == want
    used: dict = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_return_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.schema == docs.schema, name
        assert 0 < kept.count() <= docs.count()


def test_deduplication_of_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(3, text), (3, text), (2, text), (None, text), (None, "other"), (7, None), (8, ""), (9, "alone again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = stages.keep_one_of_each_group(spark, docs, SF).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == [
        (-1, "one two three four five six seven"), (-1, "other"), (2, text), (7, ""), (9, "alone again"),
    ]


def test_empty_documents(spark):
    folder = shared_folder(spark, "empty-tables")
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_one_of_each_group_where_ids_repeat(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, a, "x"), (5, a, "x"), (5, b, "x"), (5, b, "x"), (5, b, "y"), (None, a, "z"), (8, None, "x"), (9, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, print string")
    kept = stages.keep_one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, a), (5, b), (8, None), (None, a)], key=str)
    assert stages.keep_one_of_each_group(spark, docs.limit(0), "").count() == 0
