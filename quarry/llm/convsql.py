"""DuckDB SQL of op13: the damage, the faults and the cheapest edits by a forward recursion over each conversation's rows."""

from __future__ import annotations

#: The CRC of each byte by its definition, then of each key, byte by byte (keys are ASCII).
_CRC = """
bits AS (SELECT b AS b, 0 AS k, b AS v FROM range(256) AS x(b) UNION ALL
  SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc_of AS (SELECT b, v FROM bits WHERE k = 8),
keys AS (SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crc AS (SELECT key, 0 AS i, 4294967295 AS c FROM keys UNION ALL
  SELECT key, i + 1, xor(c >> 8, v) FROM crc JOIN crc_of ON b = xor(c, ascii(substr(key, i + 1, 1))) & 255 WHERE i < length(key)),
kinds AS (SELECT key, xor(c, 4294967295) % 20 AS kind FROM crc WHERE i = length(key))"""

_WHITE = r"[ \t\n\x0B\f\r]"


def _least(*options: str) -> str:
    """The cheapest of options {c, a, t}, ASCII-least if equal; null: impossible."""
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"


def _add(state: str, cost: str, letter: str, line: str | None) -> str:
    lines = f"list_append({state}.t, {line})" if line else f"{state}.t"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {lines}}} END"


def _keep(state: str, initial: str) -> str:
    return f"CASE WHEN stays AND ini = '{initial}' AND {state} IS NOT NULL THEN {{'c': {state}.c + extra, 'a': {state}.a || 'K', 't': list_append({state}.t, role || ':' || text)}} END"


def _rerole(state: str, name: str) -> str:
    return f"CASE WHEN stays AND {state} IS NOT NULL THEN {{'c': {state}.c + 1 + extra, 'a': {state}.a || 'R', 't': list_append({state}.t, '{name}:' || text)}} END"


_DROP = {q: _add(q, "2", "D", None) for q in ("q0", "qs", "qu", "qa")}
_STEP = f"""SELECT w.conv_id, w.i + 1 AS i, {_DROP["q0"]} AS q0, {_least(_DROP["qs"], _keep("q0", "s"))} AS qs,
  {_least(_DROP["qu"], _keep("q0", "u"), _keep("qs", "u"), _keep("qa", "u"), _rerole("q0", "user"), _rerole("qs", "user"), _rerole("qa", "user"))} AS qu,
  {_least(_DROP["qa"], _keep("qu", "a"), _rerole("qu", "assistant"))} AS qa
  FROM w JOIN faults r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1"""


def _inserted(step: str) -> str:
    u = _least("qu", _add("q0", "5", "I", "'user:'"), _add("qs", "5", "I", "'user:'"), _add("qa", "5", "I", "'user:'"))
    a = _least("qa", _add("qu", "5", "I", "'assistant:'"))
    return f"SELECT conv_id, i, q0, qs, qu, {a} AS qa FROM (SELECT conv_id, i, q0, qs, {u} AS qu, qa FROM ({step}))"


SQL = rf"""WITH RECURSIVE {_CRC},
d AS (SELECT conv_id, turn, kind, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
  FROM conversations JOIN kinds ON key = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS ini FROM d WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, regexp_replace(text, '{_WHITE}+$', '') AS bare FROM o),
faults AS (SELECT conv_id, turn, i, role, text, ini, bare = '' AS blank, bare <> '' AND again AS dup, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS short,
  bare <> '' AND NOT again AS stays, CASE WHEN bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS extra,
  coalesce(lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au'), false) AS bad FROM n),
nothing AS (SELECT conv_id, 0 AS i, {{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}} AS q0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR[])) AS qs,
  CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR[])) AS qu, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR[])) AS qa FROM (SELECT DISTINCT conv_id FROM conversations)),
w AS ({_inserted("SELECT * FROM nothing")} UNION ALL {_inserted(_STEP)}),
c AS (SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
  count(*) FILTER (short) AS truncated, count(*) FILTER (bad) AS illegal FROM faults GROUP BY conv_id),
e AS (SELECT w.conv_id, {_least("q0", "qa")} AS best, c.* EXCLUDE (conv_id) FROM w LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(c.n, 0))
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(array_to_string(best.t, chr(10))) AS repaired_sha256 FROM e"""
