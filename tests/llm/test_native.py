"""License scans and tool calls: brute force, edge cases, and no Python in their plans."""

from __future__ import annotations

import json
import os
import random
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import connect, duck_result, spark_result  # noqa: E402

from coldwatch.llm import licenses, queries, tools  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "score int, doc_id long, text string, labels string"
GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    types, rows = spark_result(queries.queries()[name](spark, SF))
    assert (types, rows) == duck_result(connect(SF), queries.oracle_sql()[name])


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op5_licenses", "op7_tool_calls"])
def test_native_plans_run_no_python(spark, name):
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan(queries.queries()[name](spark, SF)))


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_scan(text: str | None) -> tuple:
    words = [w for w in GAP.split(lower(text or "")) if w]
    places = [
        (i, label)
        for i in range(len(words))
        for phrase, label in licenses.PHRASES.items()
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    best: dict = {}
    end = r"(?:\r\n|\n|\r(?!\n))"
    for block in re.split(rf"{end}[ \t]*{end}|[.!?](?=[ \t\n\x0B\f\r])", text or ""):
        spelt = [w for w in GAP.split(lower(block)) if w]
        pairs = set(zip(spelt, spelt[1:]))
        found = []
        for label, template in licenses.TEMPLATES:
            own = set(zip(template.split(), template.split()[1:]))
            share = len(pairs & own) / len(own)
            if share >= 0.8 - 1e-12:
                found.append(((share, len(own)), label, pairs & own))
        for rank, label, shared in found:
            if not any(more > rank and shared & theirs for more, _, theirs in found):
                best[label] = max(best.get(label, 0), rank[0])
    base = {label for _, label in places}
    starts = [i for i, _ in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | best.keys())),
        1.0 if places else max(best.values(), default=0.0),
    )


def license_texts() -> list:
    rng = random.Random(6)
    texts: list = [
        None, "", " ", "MIT License", "the MIT  license, mit-license! MIT LICENSE mit license",
        "mit licenses", "xmit license", "Apache\nLicense", "GNU General Public License v3",
        "é mit license é", "general public license general public license",
        "mit license " * 40_000,
    ]
    pool = sorted({w for _, t in licenses.TEMPLATES for w in t.split()}) + ["other", "Words", "ß"]
    for _, template in licenses.TEMPLATES:
        words = template.split()
        for drop in (0, 1, 2, 3):
            out = rng.sample(range(len(words)), min(drop, len(words)))
            some = [w for i, w in enumerate(words) if i not in out]
            texts.append(f"{' '.join(some)}\n{' '.join(reversed(some))}")
            if drop == 3:
                rng.shuffle(some)
            texts.append(f"Before. {' '.join(some).title()} {rng.choice(pool)}. After")
    texts += [" ".join(rng.choices(pool + [".", "\n", ";"], k=120)) for _ in range(40)]
    return texts


def test_license_scan_against_brute_force(spark):
    texts = license_texts()
    rows = [(1, i, t, "x") for i, t in enumerate(texts)]
    found = licenses.scan(spark.createDataFrame(rows, DOCS)).collect()
    got = {r.doc_id: tuple(r)[1:] for r in found}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(brute_scan(t)), t


def test_notices_wrapped_over_lines(spark):
    bsd = (
        "Copyright (c) someone.\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\n"
        "modification, are permitted provided that the following conditions are met:"
    )
    isc = (
        "Permission to use, copy, modify, and/or distribute this software for any\n"
        "purpose with or without fee is hereby granted, provided that the above\ncopyright notice appears."
    )
    comment = lambda text, mark: "\n".join(mark + line for line in text.split("\n"))
    wanted, texts = [], []
    for text, label in ((bsd, "bsd"), (isc, "isc")):
        forms = [text, text.replace("\n", "\r\n"), text.replace("\n", "\r"), comment(text, " * "), comment(text, "# ")]
        forms.append("word " * 5000 + "\n" + text + "\n" + "word " * 5000)
        texts += forms
        wanted += [label] * len(forms)
    for _, template in licenses.TEMPLATES:  # in narrow columns
        texts.append("\n".join(template.split()))
        wanted.append(next(label for label, t in licenses.TEMPLATES if t == template))
    # Over a blank line, or spread over a long text, words are no notice.
    texts += [bsd.replace("without\n", "without\n \n"), "\n".join(w + " other" * 30 for w in licenses.TEMPLATES[8][1].split())]
    wanted += ["", ""]
    rows = [(1, i, t, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    for i, label in enumerate(wanted):
        assert label in got[i].labels.split(","), (texts[i][:200], got[i])
        assert (got[i].score >= 0.8) == bool(label)


def test_other_licenses_are_not_named(spark):
    gnu = "under the terms of the GNU {}General Public License as published by the Free Software Foundation"
    cases = [
        ("This program is free software; you can redistribute it and/or modify it " + gnu.format(""), "gpl"),
        ("You may copy it " + gnu.format("Lesser "), "gpl,lgpl"),  # holds the base phrase too
        ("You may copy it " + gnu.format("Affero "), "agpl,gpl"),
        ("Released under the terms of the GNU General Public License", "gpl"),
        ("Released under the BSD license.", ""),
        ("Released under the Apache License", "apache"),
        ("Licensed under the Mozilla Public License, version 2.0", ""),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
         "cc-by-nc-sa"),
        ("The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may"
         " not use this file except in compliance with the License", "mpl"),
        ("The public works department said the terms of use under general rules and the gnu herd of the lesser bridge"
         " are no license of the city", ""),
    ]
    texts = [form(text) for text, _ in cases for form in (str, lambda t: " * " + t.replace(" ", "\n * "), lambda t: f"Yes. {t}")]
    found = licenses.scan(spark.createDataFrame([(1, i, t, "x") for i, t in enumerate(texts)], DOCS)).collect()
    got = {r.doc_id: r for r in found}
    for i, text in enumerate(texts):
        assert got[i].labels == cases[i // 3][1], text
        assert tuple(got[i])[1:] == pytest.approx(brute_scan(text)), text
    with pytest.raises(ValueError, match="two words"):
        licenses.template_matches(spark.createDataFrame([], DOCS), [("x", "word")])


def test_license_sql_on_every_template(spark, tmp_path):
    """The given tables hold few notices, so the SQL is held against hand-made ones here."""
    texts = license_texts()
    texts += ["\n".join(t.split()) for _, t in licenses.TEMPLATES] + [t.replace(" ", "\r\n") for _, t in licenses.TEMPLATES]
    texts += [t.replace(" ", "\n\n", 3) for _, t in licenses.TEMPLATES]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = db.execute(queries.oracle_sql()["op5_licenses"]).fetchall()
    found = queries.queries()["op5_licenses"](spark, str(tmp_path)).collect()
    assert len(found) == len(want) == len(texts)
    by_id = {r[0]: r[1:] for r in want}
    for row in found:
        assert tuple(row)[1:] == pytest.approx(by_id[row.doc_id]), texts[row.doc_id]


def test_license_scan_edge_cases(spark):
    assert licenses.scan(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(1, 4, "MIT License", "x")] * 3 + [(1, None, "MIT License", "x")]
    found = licenses.scan(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0, r.labels) for r in found) == [(0, "mit"), *[(4, "mit")] * 3]


CALLS = "level int, call_id string, conv_id long, turn long, name string, arguments string, uses array<string>"
RESULTS = "name string, call_id string, conv_id long, turn long, content string"
SCHEMA = "name string, argument string, type string, required boolean"
WANTED = [
    ("f", "s", "string", True), ("f", "i", "integer", False), ("f", "n", "number", False),
    ("f", "b", "boolean", False), ("f", "a", "array", False), ("f", "o", "object", False),
]


def linked(spark, calls: list, results: list) -> dict:
    rows = tools.link(
        spark.createDataFrame([(9, *c) for c in calls], CALLS),
        spark.createDataFrame([("x", *r) for r in results], RESULTS),
        spark.createDataFrame(WANTED, SCHEMA),
    ).collect()
    own = [r for r in rows if r.problems not in ("no identifier", "repeated identifier")]
    assert len({r.call_id for r in own}) == len(own)
    over = sorted((r for r in rows if r not in own), key=str)
    return {r.call_id: r for r in own} | ({"over": over} if over else {})


def test_order_cycles_and_orphans(spark):
    sound = '{"s":"x"}'
    calls = [
        ("a", 1, 0, "f", sound, []), ("b", 1, 1, "f", sound, ["a"]), ("c", 1, 2, "f", sound, ["a", "b", "b"]),
        ("d", 1, 3, "f", sound, ["c", "gone"]), ("p", 2, 0, "f", sound, ["q"]), ("q", 2, 1, "f", sound, ["p"]),
        ("r", 2, 2, "f", sound, ["q", "a"]), ("self", 2, 3, "f", sound, ["self"]), ("n", 3, 0, "f", sound, None),
        (None, 3, 1, "f", sound, []),
    ]
    results = [("a", 1, 9, "one"), ("a", 1, 8, "two"), ("z", 4, 1, None), (None, 1, 1, "lost")]
    got = linked(spark, calls, results)
    over = got.pop("over")
    assert sorted((r.call_id or "", r.name or "", r.problems, r.copies, json.loads(r.json)["result"] or "") for r in over) == [
        ("", "", "no identifier", 1, "lost"), ("", "f", "no identifier", 1, ""), ("a", "", "repeated identifier", 1, "one"),
    ]
    assert not any(r.linked or r.valid or r.level is not None for r in over)
    assert {k: r.level for k, r in got.items()} == {
        "a": 0, "b": 1, "c": 2, "d": 3, "p": None, "q": None, "r": None, "self": None, "n": 0, "z": None,
    }
    assert [k for k, r in sorted(got.items()) if r.linked] == ["a"]
    assert json.loads(got["a"].json)["result"] == "two" and got["a"].copies == 3
    assert not got["z"].valid and json.loads(got["z"].json)["result"] is None


def test_levels_of_chains_and_joins(spark):
    """Against plain recursion: chains of up to 70 calls, and calls that use several."""
    rng = random.Random(12)
    uses: dict = {}
    for i in range(400):
        several = rng.random() < 0.1
        near = range(max(0, i - 3), i)
        uses[i] = sorted(rng.sample(range(i), min(i, 3))) if several else [rng.choice(near)] if i % 70 else []
    for i in range(400, 420):
        uses[i] = [i + 1 if i < 405 else 400 if i == 405 else i - 1]
    uses[420], uses[421] = [3, 402], [419, 5]

    def level(i: int) -> int | None:
        below = [depth[u] for u in uses[i]]
        return None if None in below else 1 + max(below) if below else 0

    depth: dict = {i: None for i in uses}
    for i in range(400):
        depth[i] = level(i)
    calls = spark.createDataFrame(
        [(str(i), [str(u) for u in used] + ["none"]) for i, used in uses.items()], "call_id string, uses array<string>"
    )
    found = {int(r.call_id): r.level for r in tools.levels(calls).collect()}
    assert found == {i: d for i, d in depth.items() if d is not None}


def test_arguments_and_canonical_json(spark):
    arguments = {
        "ok": '{"s": "x\\n\\"é", "n": 1.5, "i": 3, "b": true, "a": [1, 2], "o": {"z": 1, "y": null}}',
        "missing": "{}", "type": '{"s": 5, "i": 1.5, "n": "1", "b": 0, "a": {}, "o": []}',
        "more": '{"s": "x", "extra": 1}', "null": None, "text": "not json", "list": "[1]", "nil": '{"s": null}',
    }
    calls = [(k, 1, n, "f", a, []) for n, (k, a) in enumerate(arguments.items())]
    calls += [("tool", 1, 20, "g", "{}", []), ("noname", 1, 21, None, "{}", [])] + [calls[0]] * 3
    got = linked(spark, calls, [])
    assert {k: r.problems for k, r in got.items()} == {
        "ok": None, "missing": "missing s", "more": "unknown extra", "null": "arguments are no object",
        "type": "wrong type of a,wrong type of b,wrong type of i,wrong type of n,wrong type of o,wrong type of s",
        "text": "arguments are no object", "list": "arguments are no object", "nil": "wrong type of s",
        "tool": "unknown tool", "noname": "unknown tool",
    }
    assert got["ok"].copies == 4 and got["ok"].valid
    for k, r in got.items():
        value = json.loads(r.json)
        assert r.json == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        want = arguments.get(k, "{}")
        try:
            want = json.loads(want) if want is not None else None
        except ValueError:
            pass
        assert value["arguments"] == want


def test_identifiers_count_within_their_conversation(spark):
    sound, other = '{"s":"x"}', '{"s":"y"}'
    calls = [("c1", conv, 0, "f", sound, []) for conv in (1, 2, 3)] + [("c2", conv, 1, "f", sound, ["c1"]) for conv in (2, 4)]
    calls += [("c1", 3, 0, "f", other, [])] * 5 + [("c1", 3, 0, "f", sound, [])] + [("c1", None, 0, "f", sound, [])] * 2
    results = [("c1", 1, 1, "one"), ("c1", 2, 1, "two"), ("c1", 5, 1, "five"), ("c1", 3, 1, None), ("c1", 3, 1, ""), ("c1", 3, 1, "")]
    rows = tools.link(
        spark.createDataFrame([(9, *c) for c in calls], CALLS),
        spark.createDataFrame([("x", *r) for r in results], RESULTS),
        spark.createDataFrame(WANTED, SCHEMA),
    ).collect()
    got = sorted(
        (r.conv_id or 0, r.call_id, r.name or "", -1 if r.level is None else r.level, r.linked, r.valid, r.problems or "", r.copies,
         str(json.loads(r.json)["result"])) for r in rows
    )
    assert got == sorted([
        (0, "c1", "f", -1, False, False, "no identifier", 2, "None"),
        (1, "c1", "f", 0, True, True, "", 2, "one"), (2, "c1", "f", 0, True, True, "", 2, "two"),
        (2, "c2", "f", 1, False, True, "", 1, "None"), (3, "c1", "f", 0, True, True, "", 10, "None"),
        (3, "c1", "f", -1, False, False, "repeated identifier", 5, "None"),
        (3, "c1", "", -1, False, False, "repeated identifier", 2, ""),
        (4, "c2", "f", 0, False, True, "", 1, "None"), (5, "c1", "", -1, False, False, "", 1, "five"),
    ])


def test_equal_numbers_are_spelt_alike(spark):
    same = [
        ["1", "1.0", "1e0", "1E+0", "10e-1", "0.1e1", "1." + "0" * 60], ["100", "1e2", "1E2", "100.00", "0.01e4"],
        ["0", "-0", "0.0", "-0.0", "0e5", "-0E-7", "0e99999999999"], ["100000000000000000000000", "1e23", "10.0E22"],
        ["0.0000001", "1e-7", "10e-8"], ["-1.5", "-1.50", "-15e-1"], ["1234567890123456789012345678.5", "12345678901234567890123456785e-1"],
        ["1e39", "1" + "0" * 39, "10E38"], ["1e-300", "0.1e-299"], ["12345678901234567890", "1234567890123456789e1"],
    ]
    calls = [(f"{i}-{j}", 1, 0, "f", f'{{"s":"1.0 1e0 \\"2.50", "n":{t}}}', []) for i, group in enumerate(same) for j, t in enumerate(group)]
    bad = ["01.0", "1.", ".5", "1e", "--1", "1.0.0", "+1.0", "1.0e1.0", "1.0 2.0", "1e5e5"]
    calls += [(f"bad-{t}", 1, 0, "f", f'{{"s":"", "n":{t}}}', []) for t in bad]
    calls += [("long", 1, 0, "f", '{"n":1.0,"s":"' + '1.0\\"' * 300_000 + '"}', [])]
    calls += [(f"int-{t}", 1, 0, "f", f'{{"s":"","i":{t}}}', []) for t in ("1.0", "2e3", "12345678901234567890", "1.5")]
    got = linked(spark, calls, [])
    for i, group in enumerate(same):
        texts = {got[f"{i}-{j}"].json.split('"call_id"')[0] for j in range(len(group))}
        assert len(texts) == 1, (group, texts)
        value = json.loads(got[f"{i}-0"].json)["arguments"]
        assert value["s"] == '1.0 1e0 "2.50' and value["n"] == pytest.approx(float(group[0]))
    for t in bad:
        assert got[f"bad-{t}"].problems == "arguments are no object", t
        assert json.loads(got[f"bad-{t}"].json)["arguments"] == f'{{"s":"", "n":{t}}}'
    assert json.loads(got["long"].json)["arguments"] == {"n": 1, "s": '1.0"' * 300_000}
    assert {k: r.problems for k, r in got.items() if k.startswith("int")} == {
        "int-1.0": None, "int-2e3": None, "int-12345678901234567890": None, "int-1.5": "wrong type of i",
    }


def test_tool_call_sql_on_repeats_and_nulls(spark, tmp_path):
    said = [
        (1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, 1, "assistant", "x"), (1, 1, "assistant", None),
        (1, 1, "assistant", None), (1, 2, "user", "1.0 1e0"), (1, 2, "user", None), (1, 3, "assistant", ""), (None, 0, "user", "n"),
        (None, 1, "assistant", "n"), (2, None, "user", "n"), (2, None, "user", "n"), (2, None, "assistant", None), (3, 1, "user", "late"),
        (3, 5, None, "x"), (3, 6, "assistant", "alone"), (4, 0, "system", "s"), (4, 1, "user", ""), (4, 2, "assistant", "y"),
    ]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        want = db.execute(queries.oracle_sql()["op7_tool_calls"]).fetchall()
    found = queries.queries()["op7_tool_calls"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def test_empty_tables(spark):
    assert linked(spark, [], []) == {}
