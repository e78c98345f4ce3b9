"""Held-out accuracy and edge cases of the language and quality models."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from coldwatch.llm import language, quality
from coldwatch.llm.common import as_rows, crc_remainder, table

SF = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"  # quality labels of 0 are few
SCHEMA = "score string, doc_id long, text string, lang string, predicted int"
ODD = [None, "", " \n", "1234 !!", "a", "é", "word " * 30_000, "x" * 300_000]


def odd_docs(spark):
    rows = [("s", i, t, "en", 7) for i, t in enumerate(ODD)] + [("s", None, "one two", None, 7)] * 2
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def languages(spark):
    return language.fit(language.learnt_from(table(spark, SF, "documents")))


@pytest.fixture(scope="module")
def qualities(spark):
    docs, labels = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    return quality.fit(docs, quality.learnt_from(labels))


def test_languages_of_held_out_documents(spark, languages):
    docs = table(spark, SF, "documents").where(crc_remainder("doc_id", 4) == 2)
    rows = language.identify(docs, languages, "doc_id", "lang").collect()
    assert len(rows) == docs.count() > 200
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts_have_defined_languages(spark, languages):
    rows = language.identify(odd_docs(spark), languages, "doc_id").collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) + 2
    for i in range(4):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    assert all(by_id[i].lang_pred in languages.languages for i in range(4, len(ODD)))


def test_long_texts_are_read_whole(languages, monkeypatch):
    text = "the quick brown fox " * 50 + "der schnelle braune fuchs " * 500
    whole = language.subword_counts(text)
    monkeypatch.setattr(language, "CHARACTERS_AT_ONCE", 97)
    parts = language.subword_counts(text)
    # Portions overlap by two letters, so few n-grams are counted twice and none is missing.
    assert (parts >= whole).sum() >= 0.99 * len(whole) and abs(parts.sum() / whole.sum() - 1) < 0.1


def test_without_labels_all_is_unknown(spark):
    model = language.fit(odd_docs(spark).where("doc_id < 0"))
    assert {r.lang_pred for r in language.identify(odd_docs(spark), model, "doc_id").collect()} == {"und"}
    empty = odd_docs(spark).limit(0)
    assert language.identify(empty, model, "doc_id").collect() == []


def test_clashing_names_pass_through(spark, languages, qualities):
    docs = odd_docs(spark)
    kept = language.identify(as_rows(docs), languages, "row").select("row.*")
    assert kept.schema == docs.schema and kept.count() == docs.count()
    kept = quality.score(as_rows(docs), qualities, "row").select("row.*")
    assert kept.schema == docs.schema and kept.count() == docs.count()


def test_quality_of_held_out_documents(spark, qualities):
    labels = table(spark, LARGER, "labels").where(crc_remainder("doc_id", 5) == 0)
    docs = table(spark, LARGER, "documents").join(labels, "doc_id")
    rows = quality.score(docs, qualities, "doc_id", "quality").collect()
    assert len(rows) > 500
    for label in (0, 1):
        of = [r for r in rows if r.quality == label]
        assert sum(r.predicted == label for r in of) >= 0.97 * len(of)


def test_odd_texts_have_defined_quality(spark, qualities):
    rows = quality.score(odd_docs(spark), qualities, "doc_id").collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert by_id[0].score == by_id[1].score == by_id[2].score
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_unlabelled_quality_is_a_half(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([(1, None), (2, 0), (2, 1), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, none)
    assert {r.score for r in quality.score(docs, model, "doc_id").collect()} == {0.5}


def test_gradients_of_the_attention():
    rng = np.random.default_rng(0)
    bags = [rng.normal(0, 1, (n, quality.FEATURES)) for n in (1, 4, 3)]
    y, starts = np.array([1.0, 0.0, 1.0]), np.array([0, 1, 5])
    weights = {
        "V": rng.normal(0, 0.1, (quality.FEATURES, quality.HIDDEN)),
        "U": rng.normal(0, 0.1, (quality.FEATURES, quality.HIDDEN)),
        "a": rng.normal(0, 1, quality.HIDDEN), "c": rng.normal(0, 0.1, quality.FEATURES),
        "b": np.zeros(1),
    }
    model = quality.QualityModel(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), weights)

    def loss() -> float:
        p = model.forward(np.concatenate(bags), starts)["score"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    out = model.forward(np.concatenate(bags), starts)
    found = quality._gradients(model, out, starts, y)
    for name, w in weights.items():
        at = tuple(rng.integers(0, n) for n in w.shape)
        kept = w[at]
        w[at] = kept + 1e-5
        up = loss()
        w[at] = kept - 1e-5
        down = loss()
        w[at] = kept
        assert abs((up - down) / 2e-5 - found[name][at]) < 1e-5
    weight = out["weight"]
    assert np.allclose(np.add.reduceat(weight, starts), 1)


@pytest.mark.parametrize("text", [
    " ", "a b", "ab " * 400_000, "x" * 2_500_000, "y" * (1 << 20) + " z", "\u3000".join(["\u5b57"] * 200_000),
])
def test_scoring_by_blocks_equals_scoring_at_once(text):
    rng = np.random.default_rng(5)
    bags = [quality.encode(" ".join(rng.choice(["ab", "Cd!", "7"], 90))) for _ in range(20)]
    model = quality.train(bags, [i % 2 for i in range(20)])
    at_once = model.forward(quality.encode(text), np.array([0]))
    assert model.score(text)[0] == pytest.approx(float(at_once["score"][0]), abs=1e-12)
    words = text.split()
    assert len(quality.encode(text)) == max(1, -(-len(words) // quality.PASSAGE_WORDS))


def test_memory_of_a_long_text_is_bounded():
    model = quality.train([], [])
    peaks = []
    for words in (500_000, 2_000_000):
        text = "some words " * (words // 2)
        tracemalloc.start()
        model.score(text)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0]
