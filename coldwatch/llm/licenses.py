"""License scans: phrases, and an exact set-similarity join with license templates.

Only DataFrame functions are used. Two things are found in every whole text:

* base phrases, where their words stand consecutively;
* text blocks that hold at least ``CONTAINMENT`` of a template's pairs of neighbouring words.

A block is a sentence of a paragraph. It goes over line ends, so notices may be wrapped and
stand in comments. Pairs, not words, are what is compared: the words of a template scattered over
a sentence make no notice, and neither does the name of another license in its place.

The join orders template pairs by their frequency over all blocks, rarest first. A block
that holds ``need`` of a template's pairs holds one of its ``size - need + 1`` rarest, so
blocks and templates meet on those prefixes only. Length and position then bound the overlap
that is still possible, and what is left is counted exactly. Pairs outside all
templates cannot add to an overlap, so blocks are kept as their template pairs, numbered in that order.
Of templates that share pairs of a block the most contained wins, at a tie the longer.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldwatch.llm.common import stored, with_text

CONTAINMENT = 0.8
# Everything that is no word: ASCII but digits and letters (upper case is folded).
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Ends of blocks: blank lines, and sentence ends before white space.
LINE_END = r"(?:\r\n|\n|\r(?!\n))"
BLOCK_END = rf"{LINE_END}[ \t]*{LINE_END}|[.!?](?=[ \t\n\x0B\f\r])"

# Base phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Label and distinctive sentence of common license notices.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of"
            " the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "the contents of this file are subject to the mozilla public license version 1 1 the license"
            " you may not use this file except in compliance with the license"),
    *[
        (f"cc-by{short}", f"this work is licensed under a creative commons attribution{long} 4 0 international license")
        for short, long in (
            ("", ""), ("-sa", " sharealike"), ("-nd", " noderivatives"), ("-nc", " noncommercial"),
            ("-nc-sa", " noncommercial sharealike"), ("-nc-nd", " noncommercial noderivatives"),
        )
    ],
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or"
            " without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("epl", "made available under the terms of the eclipse public license"),
]


def need_of(size: int, containment: float = CONTAINMENT) -> int:
    return max(ceil(size * containment - 1e-9), 1)


def folded(text: Column) -> Column:
    """Words in lower case (A-Z only), each with a space on both sides."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, GAP, " ")), F.lit(" "))


def _words_in(spaced: Column) -> Column:
    """Number of words of a text as ``folded`` gives it; its words part at single spaces."""
    spaces = F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))
    return F.when(F.length(spaced) > 2, spaces - 1).otherwise(0).cast("long")


def phrase_columns(words: Column, phrases: dict[str, str] = PHRASES) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels of a folded text."""
    n_words, counts, firsts, lasts, labels = _words_in(words), [], [], [], []
    for phrase, label in phrases.items():
        mark = f" {phrase} "
        held = F.contains(words, F.lit(mark))
        # Neighbouring places share a space, so the one behind is looked at, not taken.
        counts.append(F.when(held, F.regexp_count(words, F.lit(f" {phrase}(?= )"))).otherwise(0))
        before = F.substring_index(words, mark, 1)
        after = F.substring_index(words, mark, -1)
        spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
        firsts.append(F.when(held, spaces(before)))
        lasts.append(F.when(held, n_words - spaces(after) - len(phrase.split())))
        labels.append(F.when(held, F.lit(label)))
    present = F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))
    return {
        "n_words": n_words,
        "n_base": sum(counts[1:], counts[0]).cast("long"),
        "first_word": F.least(*firsts).cast("long"),
        "last_word": F.greatest(*lasts).cast("long"),
        "base_labels": F.array_join(present, ","),
    }


def pairs_of(text: str) -> list[str]:
    """The distinct pairs of neighbouring words, sorted."""
    words = text.split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _template_rows(templates: list[tuple[str, str]]) -> list[tuple[int, str, list[str]]]:
    rows = [(n, label, pairs_of(text)) for n, (label, text) in enumerate(templates)]
    if not all(pairs for _, _, pairs in rows):
        raise ValueError("a template has two words at least")
    return rows


def _fewest_words(templates: list[tuple[str, str]], containment: float) -> int:
    """Distinct template words of any block that holds a template; a missing pair costs one at most."""
    return max(1, min(
        len(set(text.split())) - len(pairs_of(text)) + need_of(len(pairs_of(text)), containment)
        for _, text in templates
    ))


def blocks(docs: DataFrame, templates: list[tuple[str, str]], containment: float) -> DataFrame:
    """(doc_id, pairs): of each block that may hold a template, the template pairs in it.

    Texts are cut into blocks first, so a block is a row and a long text many rows.
    """
    rows = _template_rows(templates)
    words_known = sorted({w for _, text in templates for w in text.split()})
    pairs_known = sorted({p for _, _, ps in rows for p in ps})
    fewest_words = _fewest_words(templates, containment)
    fewest = min(need_of(len(ps), containment) for _, _, ps in rows)
    pieces = docs.select("doc_id", F.explode(F.split("text", BLOCK_END)).alias("block"))
    spelt = pieces.where(F.length("block") >= 2 * fewest_words - 1).select(
        "doc_id", F.split(F.trim(folded(F.col("block"))), " ").alias("words")
    )
    likely = spelt.where(F.size(F.array_intersect("words", F.lit(words_known))) >= fewest_words)
    behind = F.slice("words", F.lit(2), F.size("words"))
    # The last word has none behind it; its pair is null, and known to no template.
    pairs = F.zip_with("words", behind, lambda a, b: F.concat(a, F.lit(" "), b))
    held = likely.select("doc_id", F.array_intersect(pairs, F.lit(pairs_known)).alias("pairs"))
    return held.where(F.size("pairs") >= fewest)


def template_matches(
    docs: DataFrame,
    templates: list[tuple[str, str]] | None = None,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """(doc_id, label, score): per document and label the highest containment reached."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    rows = _template_rows(templates)
    vocabulary = sorted({p for _, _, ps in rows for p in ps})
    held = stored(blocks(docs, templates, containment), "license-blocks")
    ranks = _frequency_order(spark, held, vocabulary)
    found = _winners(_joined(spark, held, rows, ranks, containment))
    return found.groupBy("doc_id", "label").agg(F.max("score").alias("score"))


def _frequency_order(spark: SparkSession, held: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Rank of every template pair by the blocks it is in; the templates bound their number."""
    counted = held.select(F.explode("pairs").alias("pair")).groupBy("pair").count()
    found = {r["pair"]: r["count"] for r in counted.collect()}
    ordered = sorted(vocabulary, key=lambda p: (found.get(p, 0), p))
    return {p: n for n, p in enumerate(ordered)}


def _joined(
    spark: SparkSession, held: DataFrame, rows: list, ranks: dict[str, int], containment: float
) -> DataFrame:
    """(doc_id, ranks, label, size, shared, score): blocks, by what they hold, with their templates."""
    prefixes = []
    for n, label, pairs in rows:
        order = sorted(ranks[p] for p in pairs)
        need = need_of(len(order), containment)
        prefixes += [
            (order[at], at, n, label, order, need) for at in range(len(order) - need + 1)
        ]
    # One row per prefix pair of a template: as bounded as the templates are.
    keys = F.broadcast(
        spark.createDataFrame(
            prefixes, "rank int, at int, template int, label string, ordered array<int>, need int"
        )
    )
    number = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    numbered = held.select(
        "doc_id",
        F.array_sort(F.transform("pairs", lambda p: F.element_at(number, p))).alias("ranks"),
    )
    met = numbered.select("doc_id", "ranks", F.posexplode("ranks").alias("pos", "rank")).join(
        keys, "rank"
    )
    # Length filter, then position: what both sides still have behind this pair. A block and a
    # template that meet on several prefix pairs are counted at the first.
    possible = F.least(F.size("ordered") - F.col("at"), F.size("ranks") - F.col("pos"))
    earlier = F.arrays_overlap(F.slice("ranks", F.lit(1), F.col("pos")),
                               F.slice("ordered", F.lit(1), F.col("at")))
    open_pairs = met.where(
        (F.size("ranks") >= F.col("need")) & (possible >= F.col("need")) & ~earlier
    )
    shared = F.array_intersect("ranks", "ordered")
    size = F.size("ordered")
    return open_pairs.where(F.size(shared) >= F.col("need")).select(
        "doc_id", "ranks", "label", size.alias("size"), shared.alias("shared"),
        (F.size(shared) / size).alias("score"),
    )


def _winners(matches: DataFrame) -> DataFrame:
    """(doc_id, label, score) of matches no other one in the block beats on shared pairs.

    Blocks of a document that hold the same pairs have the same matches, so they are one group;
    a group has a match per template at most, copies aside, which the set removes.
    """
    match = F.struct("score", "size", "label", "shared")
    per_block = matches.groupBy("doc_id", "ranks").agg(F.collect_set(match).alias("all"))

    def beaten(m: Column) -> Column:
        return F.exists(
            "all",
            lambda o: (
                ((o["score"] > m["score"]) | ((o["score"] == m["score"]) & (o["size"] > m["size"])))
                & F.arrays_overlap(o["shared"], m["shared"])
            ),
        )

    kept = per_block.select("doc_id", F.explode(F.filter("all", lambda m: ~beaten(m))).alias("m"))
    return kept.select("doc_id", "m.label", "m.score")


def scan(
    docs: DataFrame,
    templates: list[tuple[str, str]] | None = None,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): words, base phrases, labels and score.

    ``n_words`` counts the words of the whole text, ``n_base`` all places of base phrases,
    ``first_word`` and ``last_word`` are the smallest and largest start among them (words
    from 0, null if none). ``base_labels`` are the phrases' labels, ``labels`` also those of
    templates, distinct, sorted and comma-joined. ``score`` is 1 if a base phrase is there,
    else the highest containment of a template in a block that reaches the threshold, else 0.

    Null and empty texts have no words and no labels. Repeated rows are each reported; rows
    that share a ``doc_id`` with different texts share what the templates add. A null
    ``doc_id`` keeps its row with base labels. Other columns are ignored. An empty table
    gives no rows.
    """
    texts = with_text(docs, F.col("doc_id").cast("long").alias("doc_id"))
    base = texts.select("doc_id", folded(F.col("text")).alias("words"))
    base = base.select("doc_id", *[c.alias(n) for n, c in phrase_columns(F.col("words")).items()])
    added = (
        template_matches(texts, templates, containment)
        .groupBy("doc_id")
        .agg(F.collect_set("label").alias("added"), F.max("score").alias("reached"))
    )
    own = F.filter(F.split("base_labels", ","), lambda x: x != "")
    every = F.array_sort(F.array_union(own, F.coalesce("added", F.array().cast("array<string>"))))
    return base.join(added, "doc_id", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("reached", F.lit(0.0))).alias("score"),
    )
