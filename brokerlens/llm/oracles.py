"""The SQL, for DuckDB, that corpus queries must agree with."""

from __future__ import annotations

TOPK = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""

WARC = """WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]"

QUALITY = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, text AS own FROM documents),
l AS (SELECT rid, source, own, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT rid, source, own, line, regexp_extract_all(line, '{_WORD}+') AS words,
    array_to_string(regexp_extract_all(translate(line, '{_UPPER}', '{_LOWER}'), '{_WORD}+'), ' ') AS norm
  FROM l WHERE regexp_matches(line, '{_WORD}')),
hosts AS (SELECT source, count(DISTINCT coalesce(md5(own), 'none')) AS total FROM d GROUP BY source),
often AS (SELECT source, norm, count(DISTINCT md5(own)) AS n FROM m GROUP BY source, norm),
over AS (SELECT o.source, o.norm FROM often o JOIN hosts h ON o.source IS NOT DISTINCT FROM h.source WHERE n > 100 OR (n > 5 AND n > 0.1 * total)),
ln AS (SELECT rid, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN o.norm IS NOT NULL THEN len(words) ELSE 0 END) AS common
  FROM m LEFT JOIN over o ON m.norm = o.norm AND m.source IS NOT DISTINCT FROM o.source GROUP BY rid),
w AS (SELECT rid, unnest(regexp_extract_all(text, '{_WORD}+')) AS w, generate_subscripts(regexp_extract_all(text, '{_WORD}+'), 1) AS i FROM d),
t AS (SELECT rid, i, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM t WHERE c IS NOT NULL),
r AS (SELECT rid, count(DISTINCT i + k) AS rep FROM g CROSS JOIN (VALUES (0), (1), (2)) z(k) WHERE n > 1 GROUP BY rid),
q AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '{_WORD}+')) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(common, 0) AS BIGINT) AS n_common_words FROM d LEFT JOIN ln USING (rid) LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q)
SELECT *, NOT base_failed AND 2 * n_common_words <= n_words AS kept FROM f"""


def _hits(name: str, pattern: str, group: int) -> str:
    """Matches of a pattern with where they begin: gaps and matches before them have the lengths summed up."""
    return rf"""{name}_x AS (SELECT rid, unnest(regexp_extract_all(text, {pattern}, 0)) AS hit, unnest(regexp_extract_all(text, {pattern}, {group})) AS part,
    unnest(string_split_regex(text, {pattern})[:len(regexp_extract_all(text, {pattern}, 0))]) AS gap,
    generate_subscripts(regexp_extract_all(text, {pattern}, 0), 1) AS i FROM d),
{name} AS (SELECT rid, hit, part, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS e, length(hit) AS n FROM {name}_x)"""


_ASSIGN = r"""'((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""

SECRETS = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{_hits("a", _ASSIGN, 2)}, {_hits("k", "'AKIA[A-Z0-9]+'", 0)}, {_hits("h", "'[0-9a-f]+'", 0)}, {_hits("ch", "'[0-9a-f]{20,}'", 0)},
{_hits("cu", "'[0-9A-F]{20,}'", 0)}, {_hits("ca", "'[0-9A-Za-z]{20,}'", 0)}, {_hits("cb", "'[A-Za-z0-9+/_=-]{20,}'", 0)},
base AS (SELECT rid, e - n AS s, 0 AS kind, e FROM a WHERE length(part) >= 6 UNION ALL SELECT rid, e - n, 1, e FROM k WHERE n >= 20
  UNION ALL SELECT rid, e - n, 2, e FROM h WHERE n >= 24),
runs AS (SELECT *, 3.0 AS least FROM ch UNION ALL SELECT *, 3.0 FROM cu UNION ALL SELECT *, 3.8 FROM ca UNION ALL SELECT *, 3.9 FROM cb),
cand AS (SELECT rid, hit, e - n AS s, n, least FROM runs WHERE regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')
    AND NOT regexp_full_match(hit, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}')
    AND NOT regexp_matches(hit, '(?i)example|sample|placeholder|dummy|changeme|0123456789|abcdefghij|qwertyuiop')),
win AS (SELECT rid, s, least, w, substr(hit, w + 1, 20) AS piece FROM (SELECT *, unnest(range(n - 19)) AS w FROM cand)),
chars AS (SELECT rid, s, least, w, unnest(string_split(piece, '')) AS ch FROM win),
freq AS (SELECT rid, s, least, w, ch, count(*) / 20 AS p FROM chars GROUP BY ALL),
high AS (SELECT rid, s, w FROM freq GROUP BY rid, s, least, w HAVING -sum(p * log2(p)) >= least - 1e-9),
places AS (SELECT DISTINCT rid, unnest(range(s + w, s + w + 20)) AS p FROM high),
free AS (SELECT rid, p, p - row_number() OVER (PARTITION BY rid ORDER BY p) AS island FROM places x
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = x.rid AND b.s <= x.p AND x.p < b.e)),
spans AS (SELECT * FROM base UNION ALL SELECT rid, min(p), 3, max(p) + 1 FROM free GROUP BY rid, island HAVING count(*) >= 16),
named AS (SELECT rid, s, kind, e, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || s || ':' || e AS span FROM spans),
lists AS (SELECT rid, count(*) FILTER (kind = 0) AS na, count(*) FILTER (kind = 1) AS nk, count(*) FILTER (kind = 2) AS nh,
    string_agg(span, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS own, string_agg(span, ',' ORDER BY s, kind, e) AS spans FROM named GROUP BY rid)
SELECT doc_id, coalesce(na, 0) AS n_assign, coalesce(nk, 0) AS n_access, coalesce(nh, 0) AS n_hex, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN lists USING (rid)"""
