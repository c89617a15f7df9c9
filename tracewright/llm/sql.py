"""DuckDB statements of the queries that SQL can express over whole tables."""

_TEXT = "[^\\s\\x{a0}\\x{85}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}\\x{0b}]"

SQL = {
    "p2_found": f"""
WITH m0 AS (
  SELECT DISTINCT ON (msg_id) traj_id::VARCHAR AS conv_key, msg_id, step_idx, sent_at, tool_call_id, lower(trim(role, ' ' || chr(9) || chr(10) || chr(13))) AS r,
         content IS NOT NULL AND regexp_matches(content, '{_TEXT}') AS has_text, list_transform(list_filter(coalesce(tool_calls, []), lambda c: c IS NOT NULL), lambda c: c.id) AS ids
  FROM messages WHERE traj_id IS NOT NULL AND msg_id IS NOT NULL),
m AS (
  SELECT *, CASE WHEN r IN ('system', 'developer') THEN 'system' WHEN r IN ('user', 'human') THEN 'user' WHEN r IN ('assistant', 'ai', 'model') THEN 'assistant'
                 WHEN r IN ('tool', 'function', 'observation') THEN 'tool' WHEN coalesce(r, '') <> '' THEN NULL WHEN tool_call_id IS NOT NULL THEN 'tool' ELSE 'assistant' END AS speaker,
         count(step_idx) OVER c = count(*) OVER c AS stepped
  FROM m0 WINDOW c AS (PARTITION BY conv_key)),
a AS (
  SELECT DISTINCT ON (conv_key, id) conv_key, id AS tool_call_id, sent_at AS asked_at, msg_id AS asker, pos
  FROM (SELECT conv_key, msg_id, sent_at, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM m) WHERE id IS NOT NULL ORDER BY conv_key, id, asked_at NULLS FIRST, asker, pos),
o AS (
  SELECT m.*, CASE WHEN stepped THEN step_idx END AS o1, coalesce(sent_at, '9999-12-31') AS o2, coalesce(asked_at = sent_at, false) AND speaker = 'tool' AS same, a.asker, a.pos
  FROM m LEFT JOIN a USING (conv_key, tool_call_id)),
t AS (
  SELECT conv_key, msg_id, speaker, has_text, ids, tool_call_id, row_number() OVER (PARTITION BY conv_key ORDER BY o1 NULLS FIRST, o2,
           CASE WHEN same THEN 3 WHEN speaker = 'tool' THEN 0 WHEN speaker = 'system' THEN 1 WHEN speaker = 'user' THEN 2 WHEN len(ids) > 0 THEN 3 ELSE 4 END,
           CASE WHEN same THEN asker ELSE msg_id END, CASE WHEN speaker = 'tool' THEN coalesce(pos, 0) + 1 ELSE 0 END, msg_id) AS turn_no
  FROM o),
g AS (SELECT *, sum((speaker IS NOT DISTINCT FROM 'user')::INT) OVER (PARTITION BY conv_key ORDER BY turn_no) AS segment FROM t),
ends AS (
  SELECT conv_key FROM g GROUP BY 1
  HAVING bool_and(speaker IS NOT NULL) AND arg_min((speaker, has_text), turn_no) FILTER (WHERE speaker <> 'system') = ('user', true)
     AND arg_max((speaker, has_text), turn_no) FILTER (WHERE speaker <> 'system') = ('assistant', true)),
unheard AS (SELECT conv_key FROM g WHERE segment > 0 GROUP BY conv_key, segment HAVING NOT bool_or(speaker = 'assistant' AND (has_text OR len(ids) > 0))),
calls AS (SELECT *, row_number() OVER (PARTITION BY conv_key, id ORDER BY turn_no, pos) AS k FROM (SELECT conv_key, turn_no, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM g)),
answers AS (SELECT conv_key, turn_no, tool_call_id AS id, row_number() OVER (PARTITION BY conv_key, tool_call_id ORDER BY turn_no) AS k FROM g WHERE speaker = 'tool'),
wrong AS (
  SELECT coalesce(c.conv_key, r.conv_key) AS conv_key FROM calls c FULL JOIN answers r ON c.conv_key = r.conv_key AND c.id = r.id AND c.k = r.k
  WHERE c.conv_key IS NULL OR r.conv_key IS NULL OR c.turn_no >= r.turn_no),
e AS (
  SELECT sessionid AS conv_key, part.messageid AS message_key, min(ts_ms) AS t0, bool_or(event_type = 'step_start') AND bool_or(event_type = 'step_finish') AND NOT bool_or(event_type = 'tool_use' AND part.state.output IS NULL) AS good,
         bool_or(event_type = 'text' AND part.text IS NOT NULL AND coalesce(regexp_matches(part.text, '{_TEXT}'), false)) AND bool_or(event_type = 'step_finish' AND coalesce(part.reason = 'stop', false)) AS ends
  FROM opencode_events WHERE sessionid IS NOT NULL AND part.messageid IS NOT NULL GROUP BY ALL),
ek AS (SELECT conv_key FROM e GROUP BY 1 HAVING bool_and(good) AND arg_max(ends, (t0, message_key)))
SELECT conv_key, turn_no::INT AS turn_no, msg_id::VARCHAR AS message_key, speaker FROM g
WHERE conv_key IN (SELECT conv_key FROM ends) AND conv_key NOT IN (SELECT conv_key FROM unheard) AND conv_key NOT IN (SELECT conv_key FROM wrong)
UNION ALL
SELECT conv_key, (row_number() OVER (PARTITION BY conv_key ORDER BY t0, message_key))::INT, message_key, 'assistant' FROM e WHERE conv_key IN (SELECT conv_key FROM ek)
""",
    "p7_found": """
WITH big AS (SELECT DISTINCT ON (chunk_id) chunk_id, content FROM chunks WHERE length(content) > 6000)
SELECT chunk_id,
       CASE WHEN (SELECT max(length(u.l)) FROM (SELECT unnest(string_split(content, chr(10))) AS l) u) > 6000
            THEN 'inside' ELSE 'line' END AS cut_kind
FROM big
""",
    "p9_found": """
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') FROM eval_items),
p AS (SELECT side, id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
g AS (SELECT DISTINCT side, id, hash(array_to_string(list_slice(ws, i, i + 12), ' ')) AS k FROM p)
SELECT DISTINCT d.id AS doc_id, e.id AS item_id FROM g d JOIN g e ON d.k = e.k AND d.side = 'd' AND e.side = 'i'
""",
}
