"""DuckDB SQL for the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

_CELL = "regexp_replace(regexp_replace(lower(source), '[^\\p{L}\\p{N}\\p{M}]+', '_', 'g'), '^_+|_+$', '', 'g')"

_MIX = f"""
WITH cells AS (SELECT {_CELL} AS cell, label, count(*) AS n FROM combined_dataset GROUP BY ALL),
whole AS (SELECT count(*) AS w FROM combined_dataset),
plan AS (
  SELECT t.source, CAST(t.label AS INT) AS label, t.target_share, t.max_repeats, coalesce(c.n, 0) AS n, w,
         CAST(round(t.target_share, 9) AS DECIMAL(18,9)) * CAST(w AS DECIMAL(18,3)) AS budget
  FROM mix_targets t CROSS JOIN whole LEFT JOIN cells c ON c.cell = {_CELL.replace('source', 't.source')} AND c.label = t.label)
"""

_UUID = "regexp_replace(regexp_replace(lower({0}), '^urn:uuid:|[^0-9a-f]', '', 'g'), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"
_UNSEEN = "[\\p{Z}\\p{Cc}\\p{Cf}\\x{34F}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180F}\\x{2800}\\x{3164}\\x{FFA0}\\x{FE00}-\\x{FE0F}]"

_SESSIONS = f"""
WITH latest AS (SELECT * FROM classifications QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1),
m AS (SELECT {_UUID.format('session_id')} AS sid, *,
             coalesce(regexp_replace(text, '{_UNSEEN}', '', 'g') <> '' AND regexp_replace(reply, '{_UNSEEN}', '', 'g') <> '', false) AS sound FROM latest),
k AS (SELECT DISTINCT {_UUID.format('id')} AS sid FROM sessions),
c AS (SELECT sid, bool_and(sound) AS sound FROM m GROUP BY sid)
"""

_GAP = "[ \\t\\n\\x0B\\f\\r]*"
_FIELD = f'(?:(?:^[^\\p{{L}}\\p{{N}}]*|[\\n\\r;]{_GAP}){_GAP}"?|[,{{]{_GAP}")([\\p{{L}}_][\\p{{L}}\\p{{N}}_-]*){_GAP}"?{_GAP}[:=]'
_FIRST = f'^[^\\p{{L}}\\p{{N}}]*[\\p{{L}}_][\\p{{L}}\\p{{N}}_-]*{_GAP}"?{_GAP}[:=]'
_BARE = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g')"

_RECORDS = f"""
WITH r AS (SELECT row_id, label, text, coalesce(label IN (0, 1) AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]'), false) AS part FROM combined_dataset),
s AS (SELECT *, regexp_matches(text, '{_FIRST}') AND len(regexp_extract_all(text, '{_FIELD}')) >= 2 AS structured FROM r WHERE part),
f AS (SELECT *, CASE WHEN structured THEN list_filter(string_split(regexp_replace(text, '{_FIELD}', chr(1) || '\\1' || chr(2), 'g'), chr(1)), lambda p: contains(p, chr(2))) ELSE [chr(2) || text] END AS fields FROM s),
k AS (SELECT row_id, label, text, list_sort(list_transform(fields, lambda p: lower(string_split(p, chr(2))[1]) || chr(2) || {_BARE.format('string_split(p, chr(2))[-1]')})) AS key FROM f),
g AS (SELECT *, min(row_id) OVER (PARTITION BY key, label) AS first_row_id, count(*) OVER (PARTITION BY key, label) AS copies FROM k)
"""

LLM_ORACLE_SQL: dict[str, str] = {
    "p4_found": _RECORDS + "SELECT first_row_id, row_id FROM g WHERE row_id <> first_row_id",
    "p4_records": _RECORDS + "SELECT row_id, CAST(label AS INT) AS label, text, copies FROM g WHERE row_id = first_row_id UNION ALL SELECT row_id, CAST(label AS INT), text, 1 FROM r WHERE NOT part",
    "p2_found": _SESSIONS + "SELECT coalesce(k.sid, c.sid) AS session_id FROM k FULL JOIN c ON k.sid = c.sid WHERE k.sid IS NULL OR c.sid IS NULL OR NOT c.sound",
    "p2_conversations": _SESSIONS
    + """,
n AS (SELECT m.*, row_number() OVER (PARTITION BY m.sid ORDER BY created_at, id) AS n FROM m JOIN k USING (sid) JOIN c USING (sid) WHERE c.sound)
SELECT sid AS session_id, CAST(n * 2 - 1 AS INT) AS turn, 'user' AS role, text FROM n
UNION ALL SELECT sid, CAST(n * 2 AS INT), 'assistant', reply FROM n
""",
    "p1_found": """
SELECT template_id FROM (
  SELECT template_id, CASE WHEN s IN ('val', 'valid') THEN 'validation' ELSE s END AS s
  FROM (SELECT template_id, nullif(regexp_replace(lower(split), '^\\s+|\\s+$', '', 'g'), '') AS s FROM combined_dataset)
  WHERE template_id IS NOT NULL AND s IS NOT NULL)
GROUP BY template_id HAVING count(DISTINCT s) > 1
""",
    "p3_found": _MIX + "SELECT source, label FROM plan WHERE budget > max_repeats * n",
    "p3_report": _MIX
    + """
SELECT source, label, target_share,
       round(least(CAST(round(budget) AS DOUBLE), CAST(max_repeats AS DOUBLE) * n) / w, 6) AS reached_share, n AS cell_rows,
       CASE WHEN n > 0 THEN CAST(least(floor(CAST(budget AS DOUBLE) / n), max_repeats) AS INT) ELSE 0 END AS epochs, budget > max_repeats * n AS short
FROM plan
""",
    "p7_found": """
SELECT row_id FROM (
  SELECT row_id, row_number() OVER (PARTITION BY template_id ORDER BY CASE WHEN isnan(quality) THEN NULL ELSE quality END DESC NULLS LAST, row_id) AS r
  FROM combined_dataset WHERE template_id IS NOT NULL)
WHERE r > 5
""",
    "p7_kept": """
SELECT row_id, template_id FROM (
  SELECT row_id, template_id, row_number() OVER (PARTITION BY template_id ORDER BY CASE WHEN isnan(quality) THEN NULL ELSE quality END DESC NULLS LAST, row_id) AS r
  FROM combined_dataset)
WHERE r <= 5 OR template_id IS NULL
""",
}
