"""DuckDB SQL for the rows of the conversation operators, by plain means: one step a row and a join with all ancestors."""

from __future__ import annotations

_CRC_TABLE = """crc_steps(i, k, v) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS places FROM crc_steps WHERE k = 8)"""


def _crc(text: str) -> str:
    """The unsigned CRC-32 of a text of ASCII characters."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, places[(xor(a, b) & 255) + 1])), 4294967295)"


def _plus(cost: object, edit: str, state: str) -> str:
    """A state's cost (8 digits) and the edits behind it, with one more in front; such texts compare as cost, then edits."""
    return f"lpad((left({state}, 8)::INT + {cost})::VARCHAR, 8, '0')||'{edit}'||substr({state}, 9)"


# By state: what a kept row leads to by initial, what an inserted or rewritten one leads to, and a second inserted one.
_STEPS = {"z": ({"s": "s", "u": "u"}, "u", "a"), "s": ({"u": "u"}, "u", "a"), "u": ({"a": "a"}, "a", "u"), "a": ({"u": "u"}, "u", "a")}


def _stay(q: str) -> str:
    """The best without an insertion before the row."""
    kept, to, _ = _STEPS[q]
    keeps = " ".join(f"WHEN initial = '{x}' THEN {_plus('cut', 'K', 'b' + t)}" for x, t in kept.items())
    return f"least({_plus(4, 'D', 'b' + q)}, CASE WHEN NOT must THEN {_plus('cut + 3', 'R', 'b' + to)} END, CASE WHEN must THEN NULL {keeps} END)"


def _grown(q: str) -> str:
    """The best with up to two insertions before the row."""
    _, to, more = _STEPS[q]
    return f"least(d{q}, {_plus(3, 'I', 'd' + to)}, {_plus(6, 'II', 'd' + more)})"


CONVERSATION_REPAIR = f"""
WITH RECURSIVE {_CRC_TABLE},
drawn AS (SELECT conv_id AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(conv_id::VARCHAR, ' ')||':'||coalesce(turn::VARCHAR, ' ')")} % 20 AS fault FROM conversations, crc_table),
damaged AS (SELECT c, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE fault <> 0),
placed AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY c) AS n, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last FROM damaged),
judged AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS found,
  i > 1 AND left(lag(role) OVER (PARTITION BY c ORDER BY i), 1)||left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM placed),
symbols AS (SELECT c, i, n, left(role, 1) AS initial, found IN ('blank', 'duplicate') IS TRUE AS must, CASE WHEN found = 'truncated' THEN 3 ELSE 0 END AS cut FROM judged),
costs(c, i, bz, bs, bu, ba) AS (SELECT DISTINCT c, n + 1, '00000000', '00000006II', '00000003I', '00000000' FROM symbols
  UNION ALL SELECT c, i, {_grown("z")}, {_grown("s")}, {_grown("u")}, {_grown("a")} FROM (SELECT k.c, r.i, {_stay("z")} AS dz, {_stay("s")} AS ds, {_stay("u")} AS du, {_stay("a")} AS da FROM costs k JOIN symbols r ON r.c IS NOT DISTINCT FROM k.c AND r.i = k.i - 1) q),
audits AS (SELECT c, left(bz, 8)::BIGINT AS cost, substr(bz, 9) AS audit FROM costs WHERE i = 1),
edits AS (SELECT c, k, substr(audit, k, 1) AS e FROM (SELECT c, audit, unnest(range(1, length(audit) + 1)) AS k FROM audits) q),
walked AS (SELECT c, k, e, count(*) FILTER (WHERE e <> 'I') OVER (PARTITION BY c ORDER BY k) AS i, count(*) FILTER (WHERE e <> 'D') OVER (PARTITION BY c ORDER BY k) AS j FROM edits),
lines AS (SELECT w.c, k, e, j, CASE WHEN e <> 'I' THEN p.role END AS role, CASE WHEN e = 'I' THEN '' ELSE p.text END AS text, coalesce(bool_or(e = 'K' AND j = 1 AND left(p.role, 1) = 's') OVER (PARTITION BY w.c), false)::INT AS opened
  FROM walked w LEFT JOIN placed p ON p.c IS NOT DISTINCT FROM w.c AND p.i = w.i WHERE e <> 'D'),
repaired AS (SELECT c, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (j - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END||':'||text, chr(10) ORDER BY k)) AS hash FROM lines GROUP BY c),
counts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE found = 'blank') AS blank, count(*) FILTER (WHERE found = 'duplicate') AS duplicate, count(*) FILTER (WHERE found = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM judged GROUP BY c)
SELECT o.c AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id AS c FROM conversations) o LEFT JOIN counts n ON n.c IS NOT DISTINCT FROM o.c LEFT JOIN audits a ON a.c IS NOT DISTINCT FROM o.c LEFT JOIN repaired r ON r.c IS NOT DISTINCT FROM o.c"""

PREFIX_TRIE = f"""
WITH RECURSIVE {_CRC_TABLE},
heads AS (SELECT c, c - c % 5 AS base, {_crc("c::VARCHAR")} % 9 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL) q, crc_table),
own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, ''))||':'||coalesce(role, '')||coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT c AS base, count(*) AS n FROM own GROUP BY c),
rebuilt AS (SELECT h.c, o.pos AS d, role, text FROM heads h JOIN own o ON o.c = h.base AND o.pos <= h.h
  UNION ALL SELECT h.c, o.pos - h.h + least(h.h, coalesce(n, 0)), role, text FROM heads h JOIN own o ON o.c = h.c AND o.pos > h.h LEFT JOIN sizes USING (base)),
chain(c, d, node, parent, b) AS (SELECT c, 0::BIGINT, 'root', NULL::VARCHAR, 0::BIGINT FROM heads
  UNION ALL SELECT r.c, r.d, sha256(node||'|'||strlen(role)||':'||role||text), node, strlen(text) FROM chain k JOIN rebuilt r ON r.c = k.c AND r.d = k.d + 1),
nodes AS (SELECT node, min(d) AS d, min(parent) AS parent, min(b) AS b, min(c) AS conv, count(*) AS n FROM chain GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS k FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
above(node, top) AS (SELECT node, node FROM nodes UNION ALL SELECT a.node, n.parent FROM above a JOIN nodes n ON n.node = a.top WHERE n.parent IS NOT NULL),
sums AS (SELECT a.top AS node, count(*) FILTER (WHERE k IS NULL) AS leaves, sum((n.n - 1) * n.b)::BIGINT AS saved FROM above a JOIN nodes n ON n.node = a.node LEFT JOIN kids ON kids.node = a.node GROUP BY a.top),
lasts AS (SELECT c, max(d) AS d FROM chain GROUP BY c),
ends AS (SELECT node, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS hash FROM chain JOIN lasts USING (c, d) GROUP BY node)
SELECT n.conv AS conv_id, n.d AS depth, p.conv AS parent_conv_id, n.n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, coalesce(hash, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids ON kids.node = n.node LEFT JOIN ends e ON e.node = n.node"""
