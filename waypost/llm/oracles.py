"""Oracle SQL of the operators that SQL can express, for DuckDB; written apart from their Spark forms."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = rf"regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _windows(source: str, key: str, n: str) -> str:
    """Rows (key, i, g): the windows of ``n`` words of a table (key, w), by start."""
    return f"SELECT {key}, i, array_to_string(w[i:i + {n} - 1], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM {source} WHERE len(w) >= {n})"


OP3 = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
items AS (
  SELECT DISTINCT doc_id, g FROM ({_windows('words', 'doc_id', '2')})
  UNION ALL SELECT doc_id, w[1] FROM words WHERE len(w) = 1
),
sizes AS (SELECT doc_id, count(*) AS n FROM items GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM items x JOIN items y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 80 * (s.n + t.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n
"""

OP4 = rf"""
WITH sized AS (SELECT doc_id, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS name, source, len({WORDS})::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS rows FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS position FROM sums),
weighed AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(position - 1) % 3 + 1] AS weight FROM ranked),
filled AS (SELECT *, source_size * 2.0::DOUBLE / weight AS full_at FROM weighed),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(source_size) OVER (ORDER BY full_at, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2.0::DOUBLE)
    / sum(weight) OVER (ORDER BY full_at, position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM filled
),
fit AS (SELECT full_at AS fa, position AS fp, level AS fl FROM levels WHERE level <= full_at ORDER BY full_at, position LIMIT 1),
aimed AS (SELECT levels.*, CASE WHEN fl IS NULL OR full_at < fa OR (full_at = fa AND position < fp) THEN source_size * 2.0::DOUBLE ELSE fl * weight END AS target FROM levels LEFT JOIN fit ON true),
seats AS (SELECT round(sum(target) / 4)::BIGINT AS seats FROM aimed),
quotients AS (SELECT position, target / (2 * k + 1) AS quotient, k FROM (SELECT position, target, unnest(range(0, (ceil(target / 4) * 2 + 16)::BIGINT)) AS k FROM aimed WHERE target > 0)),
won AS (SELECT position, count(*) AS quota FROM (SELECT position, row_number() OVER (ORDER BY quotient DESC, position, k) AS r FROM quotients) CROSS JOIN seats WHERE r <= seats GROUP BY position),
dealt AS (SELECT aimed.*, coalesce(quota, 0) AS quota, greatest(1, ceil(rows / 2000))::BIGINT AS shards FROM aimed LEFT JOIN won USING (position)),
placed AS (
  SELECT s.doc_id, s.name, s.size, d.position, d.source_size, d.target, d.quota, ('0x' || substr(md5('17:shard:' || s.name), 1, 12))::BIGINT % d.shards AS shard
  FROM sized s JOIN dealt d ON s.source IS NOT DISTINCT FROM d.source
),
shards AS (SELECT position, shard, sum(size)::BIGINT AS words, max(quota) AS seats FROM placed GROUP BY 1, 2),
shard_quotients AS (SELECT position, shard, seats, words::DOUBLE / (2 * k + 1) AS quotient, k FROM (SELECT *, unnest(range(0, seats + 1)) AS k FROM shards WHERE words > 0)),
shard_won AS (SELECT position, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY quotient DESC, shard, k) AS r FROM shard_quotients) WHERE r <= seats GROUP BY 1, 2),
drawn AS (
  SELECT position, shard, n, least(coalesce(quota, 0), 2 * n) AS q, CASE WHEN n > 0 THEN ('0x' || substr(md5('17:start:' || position || ':' || shard), 1, 12))::BIGINT % n END AS u
  FROM (SELECT position, shard, ceil(words / 4)::BIGINT AS n FROM shards) LEFT JOIN shard_won USING (position, shard)
),
laid AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY position, shard ORDER BY md5('17:order:' || name), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM placed),
cut AS (
  SELECT doc_id, laid.size, source_size, target, q, n, u, greatest(a, 4 * j) AS low, least(a + laid.size, 4 * j + 4) AS high, j
  FROM (SELECT *, unnest(CASE WHEN size > 0 THEN range(a // 4, (a + size - 1) // 4 + 1) ELSE [0] END) AS j FROM laid) laid JOIN drawn USING (position, shard)
)
SELECT doc_id, size, source_size, target, sum(CASE WHEN n > 0 AND high > low THEN (high - low) * (((j + 1) * q + u) // n - (j * q + u) // n) ELSE 0 END)::BIGINT AS taken
FROM cut GROUP BY doc_id, size, source_size, target
"""

_WORD = "regexp_extract(text, '[A-Za-z]+', 0)"
_ESCAPED = "replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"
_CALLING, _ANSWERING, _CASE = "role = 'assistant'", "role = 'user' AND turn >= 2", "(conv_id * 3 + turn) % 8"
#: The call that an answer names: the one before it, the one after it, or none that there is.
_ANSWERED = "CASE conv_id % 5 WHEN 0 THEN 'zz' WHEN 1 THEN 'c' || (turn + 1) ELSE 'c' || (turn - 1) END"


def _call(name: str, arguments: str) -> str:
    return f"""'{{"name": "{name}", "id": "c' || turn || '", "arguments": {arguments}}}'"""


_W = f"' || {_WORD} || '"
_CALLS = f"""CASE {_CASE}
  WHEN 0 THEN {_call("search", f'{{"query": "{_W}", "limit": ' + "' || turn || '}")}
  WHEN 1 THEN {_call("search", f'{{"query": "{_W}", "limit": "3"}}')}
  WHEN 2 THEN {_call("search", '{"limit": 1}')}
  WHEN 3 THEN {_call("teleport", f'{{"to": "{_W}"}}')}
  WHEN 4 THEN {_call("calculate", f'{{"expression": "{_W}"}}')} || ', ' || {_call("search", f'{{"query": "{_W}"}}')}
  WHEN 5 THEN '{{"id": "c' || turn || '", "function": {{"name": "search", "arguments": "{{' || chr(92) || '"unit' || chr(92) || '": ' || chr(92) || '"km' || chr(92) || '", ' || chr(92) || '"query' || chr(92) || '": ' || chr(92) || '"{_W}' || chr(92) || '"}}"}}}}'
  WHEN 6 THEN {_call("fetch", f'{{"url": "{_W}", "options": {{"tags": [' + "' || CASE WHEN conv_id % 2 = 0 THEN '\"a\"' ELSE '1' END || '" + f', "{_W}"], "depth": 2}}}}')}
  ELSE {_call("search", f'{{"unit": "miles", "query": "{_W}"}}')} END"""
#: The conversations with calls and answers among their messages, in SQL that Spark and DuckDB read alike.
TOOL_MESSAGES = {
    "conv_id": "conv_id",
    "turn": "turn",
    "role": f"CASE WHEN {_ANSWERING} THEN 'tool' ELSE role END",
    "text": f"""CASE WHEN {_CALLING} THEN '{{"content": "' || {_ESCAPED} || '", "tool_calls": [' || {_CALLS} || ']}}'
      WHEN {_ANSWERING} THEN '{{"tool_call_id": "' || {_ANSWERED} || '", "content": "' || {_ESCAPED} || '"}}' ELSE text END""",
}

OP5 = f"""
WITH told AS (
  SELECT conv_id, turn, text, {_CALLING} AS calling, {_ANSWERING} AS answering, {_CASE} AS n, {_WORD} AS w, CASE WHEN {_ANSWERING} THEN 'tool' ELSE role END AS role, CASE WHEN {_ANSWERING} THEN {_ANSWERED} END AS answered
  FROM conversations
),
calls AS (
  SELECT conv_id, turn, role, 0::BIGINT AS i, 'c' || turn AS id, CASE n WHEN 3 THEN 'teleport' WHEN 4 THEN 'calculate' WHEN 6 THEN 'fetch' ELSE 'search' END AS tool, n IN (0, 4, 5) OR (n = 6 AND conv_id % 2 = 0) AS valid,
    CASE n WHEN 0 THEN '{{"limit":' || turn || ',"query":' || to_json(w) || '}}' WHEN 1 THEN '{{"limit":"3","query":' || to_json(w) || '}}' WHEN 2 THEN '{{"limit":1}}' WHEN 3 THEN '{{"to":' || to_json(w) || '}}'
      WHEN 4 THEN '{{"expression":' || to_json(w) || '}}' WHEN 5 THEN '{{"query":' || to_json(w) || ',"unit":"km"}}'
      WHEN 6 THEN '{{"options":{{"depth":2,"tags":[' || CASE WHEN conv_id % 2 = 0 THEN '"a"' ELSE '1' END || ',' || to_json(w) || ']}},"url":' || to_json(w) || '}}' ELSE '{{"query":' || to_json(w) || ',"unit":"miles"}}' END AS arguments
  FROM told WHERE calling
  UNION ALL SELECT conv_id, turn, role, 1, 'c' || turn, 'search', true, '{{"query":' || to_json(w) || '}}' FROM told WHERE calling AND n = 4
),
made AS (SELECT DISTINCT conv_id, id, turn AS made_at FROM calls),
answers AS (SELECT DISTINCT conv_id, answered AS id FROM told WHERE answering)
SELECT conv_id, turn, 'message' AS kind, role, NULL::VARCHAR AS call_id, NULL::BOOLEAN AS linked, NULL::BOOLEAN AS valid, turn AS order_turn, 0 AS order_kind, 0::BIGINT AS order_index,
  '{{"content":' || to_json(text) || ',"role":' || to_json(role) || '}}' AS json
FROM told WHERE NOT answering
UNION ALL SELECT conv_id, turn, 'result', role, answered, made_at IS NOT NULL, NULL, CASE WHEN made_at > turn THEN made_at ELSE turn END, 2, turn,
  '{{"content":' || to_json(text) || ',"role":"tool","tool_call_id":' || to_json(answered) || '}}'
FROM told LEFT JOIN (SELECT conv_id AS c, id, made_at FROM made) made ON conv_id = c AND answered = id WHERE answering
UNION ALL SELECT conv_id, turn, 'call', role, id, i = 0 AND a IS NOT NULL, valid, turn, 1, i, '{{"arguments":' || arguments || ',"id":' || to_json(id) || ',"name":' || to_json(tool) || '}}'
FROM calls LEFT JOIN (SELECT conv_id AS c, id AS a FROM answers) answers ON conv_id = c AND id = a
"""

OP6 = """
WITH hashed AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM hashed
"""

OP7 = f"""
WITH words AS (SELECT doc_id, {ALNUM} AS w FROM documents),
items AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {ALNUM} AS w FROM benchmark) WHERE len(w) > 0),
targets AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
lengths AS (SELECT DISTINCT n FROM targets),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words CROSS JOIN lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, grams.n, i, item_id FROM grams JOIN targets USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP8 = f"""
WITH words AS (SELECT doc_id, {WORDS} AS w FROM documents),
grams AS (SELECT doc_id, i, md5(g) AS g FROM ({_windows('words', 'doc_id', '50')})),
firsts AS (SELECT g, min(doc_id) AS first_id FROM grams GROUP BY g),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM grams JOIN firsts USING (g) WHERE first_id < doc_id)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)
"""

OP9 = rf"""
WITH words AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
grams AS ({_windows('words', 'doc_id', '8')}),
twice AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
again AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM grams JOIN twice USING (doc_id, g)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN again USING (doc_id) LEFT JOIN lines USING (doc_id)
),
tested AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM measured),
rates AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed)::DOUBLE AS f FROM tested GROUP BY source),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(f) AS f, sum(f * f / n) AS ff, sum(n * n) AS nn, (sum(f) + 1) / (sum(n) + 2) AS mean FROM rates),
spread AS (SELECT *, greatest(0, ff - 2 * mean * f + mean * mean * n - (k - 1) * mean * (1 - mean)) / greatest(1, n - nn / n) AS spread FROM s),
prior AS (SELECT CASE WHEN k < 2 THEN 0.5 ELSE mean END AS mean, CASE WHEN k < 2 THEN 2.0 WHEN spread > 0 THEN least(1e4, greatest(2.0, mean * (1 - mean) / spread - 1)) ELSE 1e4 END AS strength FROM spread),
verdicts AS (SELECT source, (f + mean * strength) / (n + strength) > 0.5 AS rejected FROM rates CROSS JOIN prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM tested JOIN verdicts ON tested.source IS NOT DISTINCT FROM verdicts.source
"""

_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(key, ''), lambda b: [ascii(b)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295)"
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP11 = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS harm
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations)
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE harm WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) FROM keyed)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, rtrim(text, {_SPACES}) AS whole
  FROM (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged)
),
rows AS (
  SELECT *, substr(role, 1, 1) AS x, CASE WHEN whole = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(whole, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed
),
walk AS (
  SELECT c, 0::BIGINT AS i, '' AS state, 0::BIGINT AS cost, '' AS audit FROM (SELECT DISTINCT c FROM rows)
  UNION ALL
  SELECT c, i, state, best.cost, best.audit FROM (
    SELECT c, i, right(state || made, 1) AS state, min({{'cost': cost + 3 * length(added) + 3 * (way = 'R')::INT + 4 * (way = 'D')::INT + CASE WHEN fault = 'truncated' AND way <> 'D' THEN 3 ELSE 0 END, 'audit': audit || repeat('I', length(added)) || way}}) AS best
    FROM (
      SELECT r.c, r.i, w.state, w.cost, w.audit, r.fault, added, way, added || CASE way WHEN 'K' THEN x WHEN 'R' THEN role_to ELSE '' END AS made
      FROM walk w JOIN rows r ON r.c = w.c AND r.i = w.i + 1, (VALUES (''), ('u'), ('a'), ('ua'), ('au')) a(added), (VALUES ('K', ''), ('R', 'u'), ('R', 'a'), ('D', '')) e(way, role_to)
      WHERE (fault NOT IN ('blank', 'duplicate') OR way = 'D')
    )
    WHERE (way = 'D' AND added = '') OR (way <> 'D' AND regexp_full_match(state || made, 's?(ua)*u?|(au)*a?') AND (state <> '' OR made[1] <> 'a'))
    GROUP BY ALL
  )
),
ended AS (
  SELECT c, min({{'cost': cost + CASE state WHEN 'u' THEN 3 WHEN 's' THEN 6 ELSE 0 END, 'audit': audit || CASE state WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END}}) AS best
  FROM walk JOIN (SELECT c, max(i) AS i FROM rows GROUP BY c) USING (c, i) GROUP BY c
),
letters AS (
  SELECT c, k, letter, sum((letter <> 'I')::INT) OVER (PARTITION BY c ORDER BY k) AS i, sum((letter <> 'D')::INT) OVER (PARTITION BY c ORDER BY k) AS pos
  FROM (SELECT c, string_split(best.audit, '') AS letters, unnest(range(1, length(best.audit) + 1)) AS k, letters[k] AS letter FROM ended WHERE best.audit <> '')
),
kept AS (SELECT l.c, l.k, letter, pos, x, role, text FROM letters l LEFT JOIN rows r ON r.c = l.c AND r.i = l.i AND letter <> 'I' WHERE letter <> 'D'),
headed AS (SELECT *, first_value(letter = 'K' AND x = 's') OVER (PARTITION BY c ORDER BY k) AS system FROM kept),
mended AS (
  SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN (pos + system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS text FROM headed GROUP BY c
),
pairs AS (SELECT c, lag(x) OVER (PARTITION BY c ORDER BY i) || x AS pair FROM rows),
illegal AS (SELECT c, count(*) AS illegal FROM pairs WHERE pair NOT IN ('su', 'ua', 'au') GROUP BY c),
faults AS (
  SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated FROM rows GROUP BY c
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(mended.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN illegal USING (c) LEFT JOIN ended USING (c) LEFT JOIN mended USING (c)
"""

OP12 = rf"""
WITH drawn AS (
  SELECT doc_id, text, t, len(t)::BIGINT AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT for i in range(4)] AS d
  FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents)
),
cut AS (
  SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR d[3] % 100 >= 90 THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
),
parts AS (SELECT *, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:n], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


def _found(name: str, pattern: str, holds: str = "true") -> str:
    """A table (doc_id, pos, match): leftmost matches of a pattern with their offsets. No text may hold the two marks."""
    return rf"""{name} AS (
  SELECT doc_id, pos, match FROM (
    SELECT doc_id, match, coalesce(sum(length(match) + length(rest)) OVER (PARTITION BY doc_id, row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos, i
    FROM (
      SELECT doc_id, row, i, CASE WHEN i = 1 THEN '' ELSE split_part(piece, chr(2), 1) END AS match, CASE WHEN i = 1 THEN piece ELSE split_part(piece, chr(2), 2) END AS rest
      FROM (SELECT doc_id, row, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS i FROM (SELECT doc_id, row, string_split(regexp_replace(text, '({pattern})', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS pieces FROM texts))
    )
  ) WHERE i > 1 AND {holds}
)"""


_KEYWORD = "|".join(
    "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    for word in ("password", "passwd", "secret", "token", "api_?key")
)
_ASSIGN = rf"""(?:{_KEYWORD})["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""


def _high(name: str, source: str, bits: float) -> str:
    """A table of spans (kind, start, stop): merged windows of 20 characters with enough entropy."""
    return rf"""{name} AS (
  SELECT doc_id, 'entropy_{source}' AS kind, min(pos + i) AS start, max(pos + i) + 20 AS stop FROM (
    SELECT doc_id, pos, i, sum(fresh) OVER (PARTITION BY doc_id, pos ORDER BY i) AS nth FROM (
      SELECT doc_id, pos, i, (i - coalesce(lag(i) OVER (PARTITION BY doc_id, pos ORDER BY i), -100) > 20)::INT AS fresh FROM (
        SELECT doc_id, pos, i, substr(match, i + 1, 20) AS w FROM (SELECT doc_id, pos, match, unnest(range(0, length(match) - 19)) AS i FROM {source}_runs
          WHERE NOT regexp_matches(match, '^[0-9A-Fa-f]{{8}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{12}}$|0123456789|1234567890|(?i:example|sample|dummy|placeholder|changeme|your_?key|abcdefgh)'))
      ) WHERE regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]')
        AND list_sum([round(65536 * c * log2(c)) for c in map_values(list_histogram(string_split(w, '')))]) <= floor(65536 * 20 * (log2(20) - {bits}))
    )
  ) GROUP BY doc_id, pos, nth
)"""


OP13 = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
{_found("assigned", _ASSIGN, "length(regexp_extract(match, '[A-Za-z0-9+/_.=-]+$')) >= 6")},
{_found("accesses", "AKIA[A-Z0-9]+", "length(match) >= 20")},
{_found("hexes", "[0-9a-f]{24,}")},
{_found("hex_runs", "[0-9A-Fa-f]{20,}")},
{_found("base64_runs", "[A-Za-z0-9+/_=-]{20,}")},
{_high("high_hex", "hex", 2.9)},
{_high("high_base64", "base64", 3.7)},
base AS (
  SELECT doc_id, 'assign' AS kind, pos AS start, pos + length(match) AS stop, 0 AS r FROM assigned UNION ALL SELECT doc_id, 'access', pos, pos + length(match), 1 FROM accesses
  UNION ALL SELECT doc_id, 'hex', pos, pos + length(match), 2 FROM hexes
),
added AS (
  SELECT h.*, CASE kind WHEN 'entropy_hex' THEN 3 ELSE 4 END AS r FROM (FROM high_hex UNION ALL FROM high_base64) h
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = h.doc_id AND b.start <= h.start AND h.stop <= b.stop)
),
listed AS (
  SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, r, stop) AS spans, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, r, stop) FILTER (WHERE r < 3) AS based,
    count(*) FILTER (WHERE r = 0) AS a, count(*) FILTER (WHERE r = 1) AS b, count(*) FILTER (WHERE r = 2) AS c
  FROM (FROM base UNION ALL FROM added) GROUP BY doc_id
)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed USING (doc_id)
"""

SQL = {
    "op3_minhash": OP3, "op4_mixing": OP4, "op5_tool_calls": OP5, "op6_warc": OP6, "op7_decontaminate": OP7,
    "op8_substring": OP8, "op9_quality": OP9, "op11_turn_repair": OP11, "op12_infill": OP12, "op13_secrets": OP13
}
