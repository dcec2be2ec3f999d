"""SQL for the training-data queries that SQL can express, from the same tables."""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_URL = r"^(?s:.*?)://([^/?#]*)([^?#]*)"

#: Addresses as judged from the rules, then blocks carried over canonical links (those that are whole addresses).
URLS = rf"""
WITH RECURSIVE rules(r_host, r_path, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
page AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '{_URL}', 1), {_AZ}), '') AS host, coalesce(regexp_extract(url, '{_URL}', 2), '') AS path,
         regexp_extract(html, '(?is)<link\s[^>]*rel="canonical"[^>]*href="([a-z]+://[^"]*)"', 1) AS target
  FROM pages),
address AS (SELECT DISTINCT url FROM (SELECT url FROM page UNION ALL SELECT target FROM page WHERE target <> '') WHERE url IS NOT NULL),
parsed AS (SELECT url, translate(regexp_extract(url, '{_URL}', 1), {_AZ}) AS host, regexp_extract(url, '{_URL}', 2) AS path FROM address),
fit AS (
  SELECT url, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(action, length(r_host || r_path)) AS action
  FROM parsed JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY url),
link AS (SELECT url AS a, target AS b FROM page WHERE target <> '' UNION SELECT target, url FROM page WHERE target <> ''),
bad(url) AS (SELECT fit.url FROM fit JOIN link ON a = fit.url WHERE action = 'block' UNION SELECT b FROM bad JOIN link ON a = bad.url)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN bad.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM page LEFT JOIN fit USING (url) LEFT JOIN bad USING (url)
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEARCH = rf"""
WITH word AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_AZ}), '{_TERM}')) AS term FROM documents),
counted AS (SELECT doc_id, term, count(*) AS tf FROM word GROUP BY ALL),
doc AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM doc),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, {_AZ}), '{_TERM}')) AS term FROM benchmark),
item AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, total WHERE term IN (SELECT term FROM item) GROUP BY term, docs),
gain AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))) AS g
  FROM counted JOIN weight USING (term) JOIN doc USING (doc_id), total),
scored AS (SELECT item_id, doc_id, sum(times * g)::BIGINT AS score FROM item JOIN gain USING (term) GROUP BY ALL HAVING sum(times * g) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored QUALIFY rank <= 10
"""


def _framed(*fields: str) -> str:
    return " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields)


_CRC = """
crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) x(i))),
doc AS (
  SELECT *, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 7 = 0 AS hit
  FROM documents, crc_table)
"""

#: Levels of the tree of each group, then of the groups' roots, and every leaf folded along its path.
MERKLE = f"""
WITH RECURSIVE {_CRC},
leaf AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos,
         sha256({_framed("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
         CASE WHEN hit THEN sha256({_framed("doc_id", "source", "lang", "(n_chars + 1)", "text")}) ELSE leaf END AS used
  FROM doc),
low(g, level, pos, d, n) AS (
  SELECT g, 0, pos, leaf, count(*) OVER (PARTITION BY g) FROM leaf
  UNION ALL
  SELECT g, level + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY g, level, pos // 2),
sub AS (SELECT g, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM low WHERE n = 1),
high(level, pos, d, n) AS (
  SELECT 0, pos, subroot, count(*) OVER () FROM sub
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY level, pos // 2),
node AS (SELECT g, level, pos, d FROM low UNION ALL SELECT 'root', level, pos, d FROM high),
height AS (SELECT g, max(level) AS h FROM low GROUP BY g),
path(doc_id, g, level, h, pos, d, proof) AS (
  SELECT doc_id, g, 0, h, pos, used, '' FROM leaf JOIN height USING (g)
  UNION ALL
  SELECT p.doc_id, CASE WHEN p.level = h THEN 'root' ELSE p.g END, CASE WHEN p.level = h THEN 0 ELSE p.level + 1 END, CASE WHEN p.level = h THEN (SELECT max(level) FROM high) ELSE h END,
         CASE WHEN p.level = h THEN sub.pos ELSE p.pos // 2 END,
         CASE WHEN p.level = h THEN p.d WHEN p.pos % 2 = 1 THEN sha256(node.d || p.d) ELSE sha256(p.d || coalesce(node.d, '')) END,
         CASE WHEN p.level = h THEN proof ELSE proof || coalesce(node.d, '') END
  FROM path p LEFT JOIN sub ON sub.g = p.g LEFT JOIN node ON node.g = p.g AND node.level = p.level AND node.pos = xor(p.pos, 1)
  WHERE p.level < h OR p.g <> 'root')
SELECT leaf.doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, path.d AS folded_root, path.d = root AS verified
FROM leaf JOIN sub USING (g) JOIN path ON path.doc_id = leaf.doc_id AND path.g = 'root' AND path.level = path.h, (SELECT d AS root FROM high WHERE n = 1)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_urls": URLS, "op12_search": SEARCH, "op13_merkle": MERKLE}
