"""DuckDB SQL that gives the rows of the queries, by plain comparison of everything."""

from __future__ import annotations

from coldwatch.llm.licenses import PHRASES, TEMPLATES, need_of, pairs_of

NEAREST = """
WITH usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e),
    lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM usable q JOIN usable c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER)
    AS rank, vec_id, score
  FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

# CRC-32 by the bits of the text, lowest first; every prefix by a string of its turns' hashes.
PREFIX_TRIE = r"""
WITH said AS (
  SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, hash) AS pos,
    hash, words
  FROM (SELECT conv_id, turn,
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS hash,
      len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))
        AS words
    FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv, conv - conv % 20 AS base, (xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv AS VARCHAR), ''),
      lambda c: list_transform(range(8), lambda b: CAST((ord(c) >> b) & 1 AS BIGINT))))),
    lambda crc, bit: xor(crc >> 1, CASE WHEN xor(crc & 1, bit) = 1 THEN 3988292384 ELSE 0 END)))) % 4 AS h
  FROM (SELECT DISTINCT conv FROM said)
), rebuilt AS (
  SELECT c.conv, row_number() OVER (PARTITION BY c.conv ORDER BY s.conv = c.base AND s.pos <= h DESC, s.pos)
    AS depth, hash, words
  FROM convs c JOIN said s ON (s.conv = c.base AND s.pos <= h) OR (s.conv = c.conv AND s.pos > h)
), chains AS (
  SELECT conv, depth, words, sha256(string_agg(hash, '') OVER (PARTITION BY conv ORDER BY depth)) AS node
  FROM rebuilt UNION ALL SELECT conv, 0, 0, 'root' FROM convs
), linked AS (
  SELECT *, lag(node) OVER (PARTITION BY conv ORDER BY depth) AS parent,
    max(depth) OVER (PARTITION BY conv) AS last FROM chains
), nodes AS (
  SELECT node, depth, any_value(parent) AS parent, min(conv) AS conv, count(*) AS n_convs,
    any_value(words) AS words,
    sha256(coalesce(string_agg(conv, ',' ORDER BY conv) FILTER (depth = last), '')) AS ends
  FROM linked GROUP BY node, depth
), children AS (
  SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), totals AS (
  SELECT c.node, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM nodes n LEFT JOIN children k ON k.node = n.node
  JOIN chains c ON c.conv = n.conv AND c.depth <= n.depth GROUP BY c.node
)
SELECT n.conv AS conv_id, n.depth, p.conv AS parent_conv_id, n.n_convs,
  coalesce(k.n, 0) AS n_children, t.leaves AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens,
  n.ends AS ends_sha256
FROM nodes n JOIN totals t ON t.node = n.node LEFT JOIN nodes p ON p.node = n.parent
LEFT JOIN children k ON k.node = n.node
"""

MINHASH = r"""
WITH RECURSIVE said AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1),
      lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle
  FROM said
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= 85 * (x.n + y.n - k)
), reached AS (
  SELECT doc_id, doc_id AS other FROM said
  UNION SELECT reached.doc_id, b FROM reached JOIN links ON a = other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""

TOOL_CALLS = r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, role, text, 'c' || conv_id || '-' || turn AS own_id,
    'c' || conv_id || '-' || (turn - 1) AS asked_id,
    CASE WHEN turn >= 2 THEN 'c' || conv_id || '-' || (turn - 2) END AS after,
    len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '')) AS words
  FROM conversations
), asked AS (
  SELECT own_id AS call_id, conv_id, turn, after,
    CASE WHEN turn = 0 THEN 'ask' ELSE 'follow_up' END AS name,
    '{' || coalesce('"after":' || to_json(after) || ',', '')
      || coalesce('"text":' || to_json(text) || ',', '') || '"words":' || words || '}' AS arguments,
    text IS NULL AS no_text, count(*) AS same
  FROM said WHERE role = 'user' GROUP BY ALL
), told AS (
  SELECT asked_id AS call_id, conv_id, turn, text AS content, count(*) AS same
  FROM said WHERE role = 'assistant' GROUP BY ALL
), ranked_calls AS (
  SELECT *, sum(same) OVER (PARTITION BY call_id) AS copies,
    row_number() OVER (PARTITION BY call_id ORDER BY arguments) AS nr FROM asked
), ranked_results AS (
  SELECT *, sum(same) OVER (PARTITION BY call_id) AS copies,
    row_number() OVER (PARTITION BY call_id ORDER BY turn, content NULLS FIRST) AS nr FROM told
), calls AS (
  SELECT * FROM ranked_calls WHERE call_id IS NOT NULL AND nr = 1
), results AS (
  SELECT * FROM ranked_results WHERE call_id IS NOT NULL AND nr = 1
), levels AS (
  SELECT call_id, 0 AS level FROM calls
  WHERE after IS NULL OR after NOT IN (SELECT call_id FROM calls)
  UNION ALL
  SELECT c.call_id, l.level + 1 FROM levels l JOIN calls c ON c.after = l.call_id
), joined AS (
  SELECT coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.conv_id, r.conv_id) AS conv_id,
    coalesce(c.turn, r.turn) AS turn, c.name, l.level, c.arguments, c.after, r.content,
    c.call_id IS NOT NULL AS called, r.call_id IS NOT NULL AS answered,
    nullif(array_to_string(list_sort(list_filter([
      CASE WHEN c.name = 'follow_up' AND c.after IS NULL THEN 'missing after' END,
      CASE WHEN c.no_text THEN 'missing text' END
    ], lambda p: p IS NOT NULL)), ','), '') AS problems,
    coalesce(c.copies, 0) + coalesce(r.copies, 0) AS copies
  FROM calls c FULL JOIN results r ON c.call_id = r.call_id
  LEFT JOIN levels l ON l.call_id = c.call_id
  UNION ALL
  SELECT call_id, conv_id, turn, name, NULL, arguments, after, NULL, true, false,
    CASE WHEN call_id IS NULL THEN 'no identifier' ELSE 'repeated identifier' END, same
  FROM ranked_calls WHERE call_id IS NULL OR nr > 1
  UNION ALL
  SELECT call_id, conv_id, turn, NULL, NULL, NULL, NULL, content, false, true,
    CASE WHEN call_id IS NULL THEN 'no identifier' ELSE 'repeated identifier' END, same
  FROM ranked_results WHERE call_id IS NULL OR nr > 1
)
SELECT call_id, conv_id, turn, name, level, called AND answered AS linked,
  called AND problems IS NULL AS valid, problems, CAST(copies AS BIGINT) AS copies,
  '{"arguments":' || coalesce(arguments, 'null') || ',"call_id":' || coalesce(to_json(call_id), 'null')
    || ',"level":' || coalesce(CAST(level AS VARCHAR), 'null')
    || ',"name":' || coalesce(to_json(name), 'null')
    || ',"result":' || coalesce(to_json(content), 'null')
    || ',"uses":' || CASE WHEN NOT called THEN 'null' WHEN after IS NULL THEN '[]'
         ELSE '[' || to_json(after) || ']' END || '}' AS json
FROM joined
"""


def _places(words: str) -> str:
    """Starts of all base phrases in a list of words, from 1, with their labels."""
    tests = []
    for phrase, label in PHRASES.items():
        same = " AND ".join(f"{words}[i + {n}] = '{w}'" for n, w in enumerate(phrase.split()))
        tests.append(f"WHEN {same} THEN '{label}'")
    return (
        f"list_filter(list_transform(range(1, len({words}) + 1),"
        f" lambda i: {{'at': i, 'label': CASE {' '.join(tests)} END}}), lambda p: p.label IS NOT NULL)"
    )


def licenses() -> str:
    templates = ", ".join(
        f"('{label}', {pairs_of(text)}, {need_of(len(pairs_of(text)))})"
        for label, text in TEMPLATES
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = (
        f"list_filter(string_split_regex(translate({{}}, '{upper}', '{lower}'), '{gap}'),"
        " lambda w: w <> '')"
    )
    return rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), templates(label, pairs, need) AS (VALUES {templates}), spelt AS (
  SELECT doc_id, {words.format('text')} AS w FROM texts
), placed AS (
  SELECT doc_id, len(w) AS n_words, {_places('w')} AS places FROM spelt
), blocks AS (
  SELECT doc_id, row_number() OVER () AS block, {words.format('block')} AS w FROM (
    SELECT doc_id, unnest(string_split_regex(
      replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
      '\n[ \t]*\n|[.!?][ \t\n\x0B\f]')) AS block FROM texts)
), paired AS (
  SELECT doc_id, block, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pairs
  FROM blocks
), held AS (
  SELECT b.doc_id, b.block, t.label, len(t.pairs) AS size, list_intersect(b.pairs, t.pairs) AS shared,
    len(list_intersect(b.pairs, t.pairs)) / len(t.pairs) AS score
  FROM paired b JOIN templates t ON len(list_intersect(b.pairs, t.pairs)) >= t.need
), matched AS (
  SELECT doc_id, label, score FROM held m WHERE NOT EXISTS (
    SELECT 1 FROM held o WHERE o.block = m.block AND len(list_intersect(o.shared, m.shared)) > 0
      AND (o.score > m.score OR (o.score = m.score AND o.size > m.size)))
), added AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(score) AS reached FROM matched GROUP BY doc_id
), base AS (
  SELECT doc_id, n_words, places,
    list_sort(list_distinct(list_transform(places, lambda p: p.label))) AS own FROM placed
)
SELECT b.doc_id, n_words, len(places) AS n_base,
  list_min(list_transform(places, lambda p: p.at - 1)) AS first_word,
  list_max(list_transform(places, lambda p: p.at - 1)) AS last_word,
  array_to_string(own, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(own || coalesce(labels, []))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(reached, 0) END AS score
FROM base b LEFT JOIN added a ON a.doc_id = b.doc_id
"""
