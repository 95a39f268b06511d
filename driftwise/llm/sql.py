"""DuckDB SQL of the text queries that SQL can express."""

OP13 = r"""
WITH numbered AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda i: 0::BIGINT)),
             lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM numbered)),
built AS (
  SELECT ids.conv_id, 0 AS own, pos, key, words FROM ids JOIN numbered AS n ON n.conv_id = ids.conv_id - ids.conv_id % 20 WHERE pos <= h
  UNION ALL
  SELECT ids.conv_id, 1, pos, key, words FROM ids JOIN numbered AS n ON n.conv_id = ids.conv_id WHERE pos > h),
placed AS (
  SELECT conv_id, words, string_agg(key, '') OVER w AS path, row_number() OVER w AS depth
  FROM built WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)),
members AS (
  SELECT conv_id, path, depth, words FROM placed UNION ALL SELECT conv_id, '', 0, 0 FROM ids),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM members GROUP BY path, depth),
ends AS (
  SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, max_by(path, depth) AS path FROM members GROUP BY conv_id) GROUP BY path),
children AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
sized AS (
  SELECT nodes.*, coalesce(c.n, 0) AS n_children FROM nodes LEFT JOIN children AS c USING (path)),
above AS (
  SELECT left(path, 32 * d) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM sized, LATERAL (SELECT unnest(range(depth + 1)) AS d) GROUP BY 1)
SELECT s.conv_id, s.depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, a.n_leaves::BIGINT AS n_leaves,
       a.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM sized AS s JOIN above AS a USING (path) LEFT JOIN ends AS e USING (path)
LEFT JOIN nodes AS p ON s.depth > 0 AND p.path = left(s.path, greatest(length(s.path) - 32, 0)) AND p.depth = s.depth - 1
"""

OP12 = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
coded AS (
  SELECT page_id, html, hex, list_transform(range(8), lambda g: ('0x' || substr(hex, (5 * g + 1)::INT, 5))::BIGINT) AS parts,
         max(page_id) OVER (PARTITION BY html) AS top, count(*) OVER (PARTITION BY html) AS n
  FROM hashed)
SELECT page_id, strlen(html) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((parts[(i // 4 + 1)::INT] >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM coded
"""
