"""SQL of the operators over conversations and the benchmark."""

from __future__ import annotations

#: crc32 of the column ``hashed`` of ``{rows}``, as column ``crc``; the table is made from the polynomial.
CRC = """bits AS (SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) t(i) UNION ALL
    SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS steps FROM bits WHERE k = 8),
crcs AS (SELECT {rows}.*, xor(list_reduce(list_transform(range(octet_length(encode(hashed))), lambda p: ('0x' || substr(hex(encode(hashed)), 2 * p + 1, 2))::BIGINT),
    lambda acc, b: xor(acc >> 8, steps[xor(acc & 255, b) + 1]), 4294967295), 4294967295) AS crc FROM {rows}, crc_table)"""

_edit = "{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}'}}".format
_may = lambda condition, *options: f"CASE WHEN {condition} THEN [{', '.join(options)}] ELSE [] END"
_least = lambda *lists: f"list_min(list_concat({', '.join(lists)}))"

REPAIRS = f"""
WITH RECURSIVE shown AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS hashed FROM conversations),
{CRC.format(rows="shown")},
damaged AS (SELECT conv_id, turn, CASE WHEN crc % 20 = 4 THEN 'user' ELSE role END AS role,
    CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE crc % 20 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crcs),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || ':' || text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, substr(role, 1, 1) AS r,
    NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS open_end FROM damaged),
turns AS (SELECT *, blank OR again AS gone, CASE WHEN open_end THEN 5 ELSE 0 END AS more,
    lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au') AS clash FROM placed),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT gone AND open_end) AS truncated, count(*) FILTER (clash) AS illegal, count(*) AS n FROM turns GROUP BY conv_id),
walk AS (
    SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS s0, {{'c': 1000000000::BIGINT, 'a': ''}} AS s1, {{'c': 5::BIGINT, 'a': 'I'}} AS s2, {{'c': 10::BIGINT, 'a': 'II'}} AS s3 FROM facts
    UNION ALL
    SELECT conv_id, i, m0, m1, {_least("[m2]", *[f"[{_edit(s=m, cost=5, edit='I')}]" for m in ("m0", "m1", "m3")])},
        {_least("[m3]", f"[{_edit(s='m2', cost=5, edit='I')}]", *[f"[{_edit(s=m, cost=10, edit='II')}]" for m in ("m0", "m1")])}
    FROM (SELECT t.conv_id, t.i, {_edit(s="s0", cost=2, edit="D")} AS m0,
        {_least(f"[{_edit(s='s1', cost=2, edit='D')}]", _may("r = 's' AND NOT gone", _edit(s="s0", cost="more", edit="K")))} AS m1,
        {_least(f"[{_edit(s='s2', cost=2, edit='D')}]", _may("r = 'u' AND NOT gone", *[_edit(s=s, cost="more", edit="K") for s in ("s0", "s1", "s3")]),
                _may("NOT gone", *[_edit(s=s, cost="more + 1", edit="R") for s in ("s0", "s1", "s3")]))} AS m2,
        {_least(f"[{_edit(s='s3', cost=2, edit='D')}]", _may("r = 'a' AND NOT gone", _edit(s="s2", cost="more", edit="K")), _may("NOT gone", _edit(s="s2", cost="more + 1", edit="R")))} AS m3
        FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1)),
best AS (SELECT w.conv_id, least(s0, s3).c AS cost, least(s0, s3).a AS audit FROM walk w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = f.n),
edits AS (SELECT conv_id, k, audit[k] AS e, length(replace(audit[:k], 'I', '')) AS i, length(replace(audit[:k], 'D', '')) AS said
    FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM best) WHERE audit[k] <> 'D'),
kept AS (SELECT e.conv_id, k, e, said, CASE WHEN e <> 'I' THEN t.text ELSE '' END AS text, t.role,
    max(said = 1 AND e = 'K' AND t.r = 's') OVER (PARTITION BY e.conv_id) AS led FROM edits e LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.i = e.i),
lines AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (said - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS said
    FROM kept GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM c.conv_id
"""

_words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
LEAKS = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS line, doc_id, coalesce({_words}, []) AS w FROM documents),
b AS (SELECT item_id, {_words} AS w, least(10, len(w)) AS size FROM benchmark),
windows AS MATERIALIZED (SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS words
    FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM b WHERE size > 0)),
grams AS (SELECT line, p, size, array_to_string(w[p:p + size - 1], ' ') AS words
    FROM (SELECT line, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM windows))),
hits AS MATERIALIZED (SELECT line, p, size, item_id FROM grams JOIN windows USING (size, words)),
places AS (SELECT line, count(DISTINCT place) AS n_hit FROM (SELECT line, unnest(range(p, p + size)) AS place FROM hits) GROUP BY line),
named AS (SELECT line, list(DISTINCT item_id::VARCHAR ORDER BY item_id::VARCHAR) FILTER (item_id IS NOT NULL) AS items FROM hits GROUP BY line)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
    sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (line) LEFT JOIN named USING (line)
"""
