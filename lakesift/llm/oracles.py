"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

import hashlib

_KEYWORD = "(?i:password|passwd|secret|token|api_?key)"
#: Each rule marks its matches: chr(57344) before, chr(57345) before the value, chr(57346) after it.
_RULES = {
    "assign": (f"({_KEYWORD}[\"\'\']?\\x20*[:=]\\x20*[\"\'\']?)([A-Za-z0-9+/_.=-]+)", "length(v) >= 6"),
    "access": "()(AKIA[A-Z0-9]+)|length(v) >= 20",
    "hex": "()([0-9a-f]{24,})|true",
}


def _secrets() -> str:
    parts = []
    for rank, (kind, rule) in enumerate(_RULES.items()):
        pattern, keep = rule if isinstance(rule, tuple) else rule.rsplit("|", 1)
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s AS start, s + length(h) + length(v) AS stop, ({keep}) AS keep FROM (
 SELECT doc_id, k, split_part(p, chr(57345), 1) AS h, split_part(split_part(p, chr(57345), 2), chr(57346), 1) AS v,
  sum(length(p) - CASE WHEN k > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s
 FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (SELECT doc_id, string_split(regexp_replace(text, '{pattern}', chr(57344) || '\\1' || chr(57345) || '\\2' || chr(57346), 'g'), chr(57344)) AS ps FROM documents)))
 WHERE k > 1""")
    found = " UNION ALL ".join(parts)
    return f"""WITH f AS (SELECT * FROM ({found}) WHERE keep),
 a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) AS spans FROM f GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id"""


def _sharding(shards: int = 64, slots: int = 65537) -> str:
    """The table is filled here by itself, a turn for each shard at a time."""
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    names = [f"shard-{i:03d}" for i in range(shards)]
    wishes_of = lambda n: ((number(f"offset:{n}") % slots + j * (number(f"skip:{n}") % (slots - 1) + 1)) % slots for j in range(slots))
    preferred = [wishes_of(n) for n in names]
    owner: dict[int, int] = {}
    while len(owner) < slots:
        for k, wishes in enumerate(preferred):
            if len(owner) < slots:
                owner[next(s for s in wishes if s not in owner)] = k
    table = ",".join(str(owner[s]) for s in range(slots))
    return f"""WITH t AS (SELECT [{table}] AS owners), s AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {slots} AS slot FROM documents)
SELECT doc_id, slot, owners[slot + 1] AS shard, 'shard-' || lpad((owners[slot + 1])::VARCHAR, 3, '0') AS shard_name FROM s, t"""


_SUBSTRINGS = """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM w),
 s AS (SELECT p.doc_id, word, pos, n, CASE WHEN pos + 34 <= n THEN md5(array_to_string(ws[pos:pos + 34], ' ')) END AS h FROM p JOIN w ON p.doc_id = w.doc_id),
 r AS (SELECT *, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS twice FROM s),
 c AS (SELECT *, max(twice::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone FROM r),
 a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id"""

_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
 b AS (SELECT page_id, strlen(html) AS payload_bytes, unhex(hex)::BIT::VARCHAR AS bits, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_sum(list_transform(range(1, 6), lambda j: CASE WHEN bits[i * 5 + j] = '1' THEN 1 << (5 - j)::INT ELSE 0 END))::INT + 1, 1)), '') AS payload_digest,
 CASE WHEN first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM b"""

_DIVERGENCE = """WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
 w AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{80}-\\x{10FFFF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
 v AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
 c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN v USING (lang, term) GROUP BY 1, 2, 3),
 g AS (SELECT DISTINCT lang, source FROM d),
 s AS (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total, (SELECT count(*) FROM v WHERE v.lang = g.lang) AS terms FROM g),
 p AS (SELECT s.lang, s.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (s.total + 5 * s.terms)) AS p FROM s JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
 l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang))) AS q FROM c GROUP BY 1, 2),
 pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 3),
 r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
 n AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM n WHERE part = 'pair' OR rank <= 50"""


def _repair() -> str:
    """Conversations from their last row to the first: for each state the cheapest way on, as (cost, audit, lines)."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    way = lambda cost, letter, to, line: f"{{'c': {to}.c + {cost}, 'a': '{letter}' || {to}.a, 't': {line} || CASE WHEN {to}.t = '' THEN '' ELSE chr(10) || {to}.t END}}"
    least = lambda *ways: f"list_sort([{', '.join(ways)}], 'ASC', 'NULLS LAST')[1]"
    gone = lambda s: f"{{'c': y{s}.c + 3, 'a': 'D' || y{s}.a, 't': y{s}.t}}"
    kept = lambda initial, to: f"CASE WHEN NOT go AND initial = '{initial}' THEN {way('open', 'K', f'y{to}', 'line')} END"
    named = lambda to, role: f"CASE WHEN NOT go THEN {way('2 + open', 'R', f'y{to}', f'{role!r} || text')} END"
    user, both = lambda s: way(2, "I", f"o{s}", "'user:'"), way(4, "II", "o3", "'user:' || chr(10) || 'assistant:'")
    own = [least(gone(0), kept("s", 1), kept("u", 2), named(2, "user:")), least(gone(1), kept("u", 2), named(2, "user:")), least(gone(2), kept("a", 3), named(3, "assistant:")), least(gone(3), kept("u", 2), named(2, "user:"))]
    put = [least("o0", user(2), both), least("o1", user(2), both), least("o2", way(2, "I", "o3", "'assistant:'")), least("o3", user(2))]
    return f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
 h AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS code FROM c, (SELECT {table}::BIGINT[] AS t)),
 d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE code <> 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n, substr(role, 1, 1) AS initial FROM d),
 q AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM o),
 e AS (SELECT *, blank OR again AS go, (cut AND NOT blank AND NOT again)::INT AS open, role || ':' || text AS line FROM q),
 r AS (SELECT conv_id, n + 1 AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS y0, {{'c': 4::BIGINT, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS y1, {{'c': 2::BIGINT, 'a': 'I', 't': 'assistant:'}} AS y2, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS y3 FROM e WHERE i = 1
  UNION ALL SELECT conv_id, i, {', '.join(put)} FROM (SELECT e.conv_id, e.i, {', '.join(f'{x} AS o{k}' for k, x in enumerate(own))} FROM r JOIN e ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.i = r.i - 1)),
 m AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, sum(open)::BIGINT AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY 1),
 a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(y0.c, 0) AS cost, coalesce(y0.a, '') AS audit, sha256(coalesce(y0.t, '')) AS repaired_sha256
FROM a LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND r.i = 1"""


def oracle_sql() -> dict[str, str]:
    return {"op3_secret_scans": _secrets(), "op6_sharding": _sharding(), "op7_substring_dedup": _SUBSTRINGS, "op10_warc": _WARC, "op11_source_divergence": _DIVERGENCE, "op12_conversation_repair": _repair()}
