"""SQL with the same results, where SQL can express them."""

from __future__ import annotations

OP3 = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           unnest(range(len(string_split(text, chr(10))))) AS pos
    FROM documents WHERE text IS NOT NULL
), worded AS (
    SELECT doc_id, pos, line, lead(pos) OVER w AS next_pos, lead(line) OVER w AS next_line
    FROM lines WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
    WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), runs AS (
    SELECT *, row_number() OVER (PARTITION BY line, next_line ORDER BY doc_id, pos) AS place
    FROM worded WHERE next_pos IS NOT NULL
), gone AS (
    SELECT doc_id, pos FROM runs WHERE place > 1
    UNION
    SELECT doc_id, next_pos FROM runs WHERE place > 1
), cut AS (
    SELECT l.doc_id, count(g.pos) AS n_removed,
           coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
    FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(c.n_removed, 0) AS n_removed, length(c.text) AS n_chars, sha256(c.text) AS text_sha256
FROM documents d LEFT JOIN cut c ON d.doc_id = c.doc_id
"""

# Fixed value: the polynomial of CRC-32, bits reversed.
POLYNOMIAL = 0xEDB88320

OP9 = rf"""
WITH RECURSIVE crc(byte, bit, value) AS (
    SELECT range, 0, range FROM range(256)
    UNION ALL
    SELECT byte, bit + 1, CASE WHEN value % 2 = 1 THEN xor(value // 2, {POLYNOMIAL}) ELSE value // 2 END FROM crc WHERE bit < 8
), steps AS (
    SELECT list(value ORDER BY byte) AS step FROM crc WHERE bit = 8
), sized AS (
    SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, coalesce(octet_length(encode(text)), 0) + 1 AS size,
           xor(4294967295, list_reduce(
               list_prepend(4294967295, list_transform(
                   regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
               lambda c, b: xor(c // 256, step[xor(c % 256, b) + 1]))) AS text_crc32
    FROM documents, steps
), scored AS (
    SELECT doc_id, key, s.shard,
           -ln((('0x' || substr(md5(key || ':' || s.shard), 1, 15))::BIGINT::DOUBLE + 0.5) / 1152921504606846976.0) AS score
    FROM (SELECT DISTINCT doc_id, key FROM sized), (SELECT range AS shard FROM range(9)) AS s
), best AS (
    SELECT key, arg_min(shard, score) FILTER (WHERE shard < 8) AS shard, arg_min(shard, score) AS grown_shard
    FROM scored GROUP BY key
)
SELECT z.doc_id, z.size, z.text_crc32, 'key' AS law, b.shard::INT AS shard, b.grown_shard::INT AS grown_shard,
       row_number() OVER (PARTITION BY b.shard ORDER BY md5(z.key || ':' || z.text_crc32), z.doc_id, z.size) - 1 AS slot
FROM sized z JOIN best b ON z.key = b.key
"""

SQL = {"op3_line_dedup": OP3, "op9_sharding": OP9}
