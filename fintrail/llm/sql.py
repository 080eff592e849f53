"""DuckDB statements for the queries that SQL can express."""

URL_FILTERS = r"""
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
n AS (SELECT *, row_number() OVER () AS no FROM u),
best AS (
  SELECT no, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM n JOIN r ON (n.host = h OR ends_with(n.host, '.' || h)) AND starts_with(n.path, p) GROUP BY no)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM n LEFT JOIN best USING (no)
"""

DECONTAMINATE = r"""
WITH d AS (
  SELECT row_number() OVER () AS no, doc_id, regexp_extract_all(
    coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') AS p
  FROM b, unnest(range(0, greatest(len(w) - 9, least(len(w), 1)))) AS t(i)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT no, n, i, array_to_string(w[i + 1:i + n], ' ') AS p
  FROM d, lens, unnest(range(0, greatest(len(w) - n + 1, 0))) AS t(i)),
m AS (SELECT no, item_id, i, n FROM dw JOIN bw USING (n, p)),
words AS (SELECT no, count(DISTINCT j) AS n_hit FROM m, unnest(range(i, i + n)) AS t(j) GROUP BY no),
items AS (
  SELECT no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT no, item_id::VARCHAR AS item FROM m) GROUP BY no)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (no) LEFT JOIN items USING (no)
"""

SUBSTRING_DEDUP = r"""
WITH d AS (
  SELECT row_number() OVER () AS no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT no, i, array_to_string(w[i + 1:i + 35], ' ') AS p
  FROM d, unnest(range(0, greatest(len(w) - 34, 0))) AS t(i)),
twice AS (SELECT no, i FROM (SELECT no, i, count(*) OVER (PARTITION BY p) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT no, j FROM twice, unnest(range(i, i + 35)) AS t(j)),
kept AS (
  SELECT no, string_agg(word, ' ' ORDER BY j) AS k, count(*) AS n
  FROM (SELECT no, unnest(w) AS word, unnest(range(0, len(w))) AS j FROM d) LEFT JOIN gone g USING (no, j)
  WHERE g.no IS NULL GROUP BY no)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (no)
"""

MERKLE_MANIFEST = r"""
WITH RECURSIVE
bits AS (
  SELECT n, n AS v, 0 AS k FROM range(256) AS t(n)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS t FROM bits WHERE k = 8),
d AS (
  SELECT row_number() OVER () AS no, doc_id, source, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0, false) AS even
  FROM documents, crc),
leaf AS (
  SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS bare FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM leaf),
up AS (
  SELECT source, 0 AS lvl, r AS i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM placed
  UNION ALL
  SELECT source, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3)
  FROM up WHERE n > 1 GROUP BY source, lvl, i // 3),
subs AS (SELECT source, lvl AS depth, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, s AS i, subroot AS h, count(*) OVER () AS n FROM subs
  UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3) FROM top WHERE n > 1 GROUP BY lvl, i // 3),
root AS (SELECT h AS root FROM top WHERE n = 1),
runs AS (
  SELECT no, lvl, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < mine), '') AS a, coalesce(string_agg(h, '' ORDER BY i) FILTER (i > mine), '') AS b
  FROM (
    SELECT no, lvl, i, h, r // (3 ** lvl)::BIGINT AS mine FROM placed p JOIN subs ON subs.source IS NOT DISTINCT FROM p.source
    JOIN up ON up.source IS NOT DISTINCT FROM p.source AND lvl < depth AND i // 3 = r // (3 ** (lvl + 1))::BIGINT
    UNION ALL
    SELECT no, depth + lvl, i, top.h, s // (3 ** lvl)::BIGINT FROM placed p JOIN subs ON subs.source IS NOT DISTINCT FROM p.source
    JOIN top ON top.n > 1 AND i // 3 = s // (3 ** (lvl + 1))::BIGINT)
  GROUP BY no, lvl),
proof AS (SELECT no, sha256(string_agg(a || b, '' ORDER BY lvl)) AS proof FROM runs GROUP BY no),
folded AS (
  SELECT no, 0 AS lvl, CASE WHEN even THEN bare ELSE leaf END AS h FROM leaf
  UNION ALL SELECT no, lvl + 1, sha256(a || h || b) FROM folded JOIN runs USING (no, lvl))
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM placed p JOIN subs ON subs.source IS NOT DISTINCT FROM p.source CROSS JOIN root LEFT JOIN proof USING (no)
JOIN (SELECT no, arg_max(h, lvl) AS h FROM folded GROUP BY no) f USING (no)
"""

ORACLES = {"op13_merkle_manifest": MERKLE_MANIFEST, "op9_substring_dedup": SUBSTRING_DEDUP, "op1_url_filters": URL_FILTERS, "op7_decontaminate": DECONTAMINATE}
