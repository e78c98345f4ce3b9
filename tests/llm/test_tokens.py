"""Token files and packing against the tokenizer itself and exact round trips."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from coldwatch.llm import packing, token_files
from coldwatch.llm.common import shared_folder, table
from coldwatch.llm.wordpieces import WordEncoder, default_path, documents_ids, encoder

SF = "/root/testdata/sf0.001"
SCHEMA = "start string, doc_id long, text string, tokens int, piece string"
HARD = [
    None, "", " \n\t ", "Plain words, here.", "don't DON'T it's 'tis", "2.0 v1.2.3 !!! ...",
    "ÉTÉ Straße İstanbul ΟΔΟΣ ǅ", "café x̀y", "a b c\x85d\x0be", "日本語テキスト 漢字",
    "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "x" * 5000, "émile-zola@example.com #tag $5",
    "​zero​width", "🙂🙃 emoji", "ﬁ ligature Ⅷ ½ ٣", "tab\tand\r\nlines",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_path())


def whole(tokenizer, text: str | None) -> list[int]:
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_give_the_ids_of_whole_texts(tokenizer):
    rng = random.Random(5)
    pieces = [t for t in HARD if t] + list(" .,'!?-ABé\ńß1²")
    texts = [t or "" for t in HARD]
    texts += ["".join(rng.choices(pieces, k=8)) for _ in range(300)]
    for text, ids in zip(texts, encoder(default_path()).encode(texts)):
        assert np.frombuffer(ids, np.uint32).tolist() == whole(tokenizer, text)[:-1], text


def test_forgetting_words_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr("coldwatch.llm.wordpieces.CHUNKS_KEPT", 3)
    coder = encoder(default_path())
    for _ in range(3):
        (ids,) = coder.encode(["some more words than are kept here"])
        assert np.frombuffer(ids, np.uint32).tolist() == whole(
            tokenizer, "some more words than are kept here")[:-1]


def encoded_words(monkeypatch) -> tuple[WordEncoder, list[str]]:
    """A new encoder, and the words that it will give to the tokenizer's model."""
    coder, met = WordEncoder(default_path()), []
    letters = coder._letters
    monkeypatch.setattr(coder, "_letters", lambda w: met.append(w) or letters(w))
    return coder, met


def test_a_word_is_encoded_once_in_any_case_and_before_punctuation(monkeypatch):
    coder, met = encoded_words(monkeypatch)
    coder.encode(["Winter winter, WINTER. Straße straße!", "Winter... Ёлка, ёлка."])
    coder.encode(["wINTER; winter Straße?"])
    assert sorted(met) == ["straße", "winter", "ёлка"]


def test_words_met_again_outlast_others(monkeypatch):
    monkeypatch.setattr("coldwatch.llm.wordpieces.WORDS_KEPT", 8)
    monkeypatch.setattr("coldwatch.llm.wordpieces.CHUNKS_KEPT", 8)
    coder, met = encoded_words(monkeypatch)
    for c in "abcdefghij":
        coder.encode([f"often rare{c} odd{c} seldom{c}"])
    assert met.count("often") == 1
    coder.encode(["rarea"])
    assert met.count("rarea") == 2
    assert len(coder.words) + len(coder.words.old) <= 16


@pytest.mark.parametrize("text_bytes, strip", [(1, 1), (40, 3), (1 << 20, 1 << 16)])
def test_ids_of_sliced_columns(tokenizer, monkeypatch, text_bytes, strip):
    monkeypatch.setattr("coldwatch.llm.wordpieces.TEXT_BYTES", text_bytes)
    monkeypatch.setattr("coldwatch.llm.wordpieces.STRIP", strip)
    for texts in (HARD[2:-1], [None], ["", ""]):
        column = pa.array(["before", *texts, "after"], pa.string()).slice(1, len(texts))
        ids, sizes = documents_ids(default_path(), column, 1)
        want = [whole(tokenizer, t) for t in texts]
        assert ids.tolist() == [i for w in want for i in w]
        assert sizes.tolist() == [len(w) for w in want]


def hard_rows() -> list[tuple]:
    rows = [("s", i, t, 0, "p") for i, t in enumerate(HARD)]
    return [*rows, ("s", 3, "Plain words, here.", 0, "p"), ("s", None, "no id", 0, "p")]


def test_files_hold_all_ids_in_order(spark, tokenizer):
    path = shared_folder(spark, "test-files")
    token_files.write_tokens(spark.createDataFrame(hard_rows(), SCHEMA).repartition(5), path)
    rows = token_files.with_global_start(token_files.read_tokens(spark, path), path).collect()
    rows.sort(key=lambda r: r.start)
    want = sorted(hard_rows(), key=lambda r: (-1 if r[1] is None else r[1], r[2] or ""))
    assert [(r.doc_id, list(r.tokens)) for r in rows] == [
        (r[1], whole(tokenizer, r[2])) for r in want
    ]
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens) == (at, len(r.tokens))
        at += r.n_tokens


def test_selective_reads_and_encodings(spark):
    path = shared_folder(spark, "test-files")
    token_files.write_tokens(table(spark, SF, "documents"), path)
    some = token_files.read_tokens(spark, path, first=20, last=29)
    assert sorted(r.doc_id for r in some.collect()) == list(range(20, 30))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,20)" in plan
    plan = token_files.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan.split("ReadSchema")[1]
    file = spark.read.parquet(f"{path}/tokens").inputFiles()[0].removeprefix("file://")
    meta = pq.ParquetFile(file).metadata
    group = meta.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    tokens = next(c for n, c in columns.items() if n.startswith("tokens"))
    assert "RLE_DICTIONARY" in tokens.encodings
    assert tokens.has_offset_index and columns["doc_id"].has_column_index


def test_empty_tables(spark):
    path = shared_folder(spark, "test-files")
    nothing = spark.createDataFrame([], SCHEMA)
    token_files.write_tokens(nothing, path)
    rows = token_files.with_digest(token_files.read_tokens(spark, path), "tokens")
    assert token_files.with_global_start(rows, path).collect() == []
    assert packing.pack(nothing).collect() == []


def check_packing(rows, want: dict, capacity: int) -> int:
    """Every id once, no overlap, no gap; gives the number of sequences."""
    docs: dict = {}
    bins: dict = {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) <= capacity
    for pieces in bins.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert docs.keys() == want.keys()
    for doc_id, texts in want.items():
        ends = sorted(docs[doc_id], key=lambda r: r.piece)
        if len(texts) == 1:
            assert [r.piece for r in ends] == list(range(len(ends)))
            assert [i for r in ends for i in r.ids] == texts[0]
            assert all(r.length == capacity for r in ends[:-1])
            assert [r.start for r in ends] == [capacity * n for n in range(len(ends))]
        else:
            assert sorted(tuple(r.ids) for r in ends) == sorted(map(tuple, texts))
    return len(bins)


def test_packing_round_trip(spark, tokenizer):
    want: dict = {}
    for row in hard_rows():
        want.setdefault(row[1], []).append(whole(tokenizer, row[2]))
    docs = spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)
    check_packing(packing.pack(docs).collect(), want, packing.CAPACITY)


@pytest.mark.parametrize("open_sequences", [1, 3, 1024])
def test_packing_fills_sequences(spark, tokenizer, open_sequences):
    docs = table(spark, SF, "documents")
    want = {r.doc_id: [whole(tokenizer, r.text)] for r in docs.collect()}
    rows = packing.pack(docs, open_sequences=open_sequences, capacity=512).collect()
    used = check_packing(rows, want, 512)
    least = -(-sum(len(t[0]) for t in want.values()) // 512)
    assert used <= least * (1.02 if open_sequences == 1024 else 1.25) + 1


def test_best_fit_against_a_list_of_bins():
    rng = random.Random(2)
    packer, bins, closed, made = packing.BestFit(100, 4), {}, 0, 0
    for _ in range(3000):
        length = rng.randint(1, 100)
        sequence, offset = packer.place(length)
        fitting = [f for f in bins.values() if f >= length]
        if fitting:
            assert bins[sequence] == min(fitting) == 100 - offset
        else:
            assert (sequence, offset) == (made, 0)
            made += 1
            bins[sequence] = 100
        bins[sequence] -= length
        if not bins[sequence]:
            del bins[sequence]
        if len(bins) > 4:
            others = {s: f for s, f in bins.items() if s != sequence}
            fullest = min(others.values())
            gone = {s for s, f in others.items() if f == fullest and s not in {
                x for free in packer.open for x in free}}
            assert len(gone) == 1
            del bins[gone.pop()]
            closed += 1
    assert closed


def test_ids_equal_the_tokenizer_for_every_character():
    """Marks that normalising leaves at a word's end are joined to punctuation."""
    words = encoder(default_path())
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}. {chr(c)}b, {chr(c)}!" for c in points]
    texts += ["BİLGİ. TÜRKÇESİ, क़. ড়. ਸ਼.", "İ", "İ.", "x̸. a≮ b"]
    rng = random.Random(5)
    pool = [*range(1, 0x3000), *range(0x300, 0x370)] + [0x41, 0x61, 0x2E, 0x2C, 0x20, 0x20, 0x27] * 300
    texts += ["".join(map(chr, rng.choices(pool, k=rng.randint(1, 40)))) for _ in range(20_000)]
    for at in range(0, len(texts), 8192):
        part = texts[at : at + 8192]
        whole = words.tokenizer.encode_batch(part, add_special_tokens=False)
        got = [np.frombuffer(b, np.uint32).tolist() for b in words.encode(part)]
        assert got == [w.ids for w in whole]


@pytest.mark.parametrize("partitions", [1, 64, 512])
def test_small_partitions_fill_sequences_too(spark, partitions):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(partitions)
    packed = packing.pack(docs).select("sequence_id", "length").collect()
    least = -(-sum(r.length for r in packed) // packing.CAPACITY)
    assert len({r.sequence_id for r in packed}) <= 1.03 * least
