"""DuckDB SQL for the queries that SQL can express."""

OP1 = r"""
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, url, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p
), g AS (
  SELECT payload_digest, max(page_id) AS response FROM d WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN g.response IS NOT NULL AND d.page_id < g.response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.response IS NOT NULL AND d.page_id < g.response THEN g.response END AS refers_to,
       d.url
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND d.payload_bytes >= 1000
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s
), o AS (
  SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT AS budget,
         coalesce(sum(2 * source_size) OVER b, 0)::BIGINT AS held, (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER b, 0)::BIGINT AS free
  FROM w WINDOW b AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT max((budget - held) / free) AS level FROM o WHERE (budget - held) / free * weight < 2 * source_size
), t AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0 ELSE least((2 * source_size)::DOUBLE, weight * level) END AS target FROM w, l
), p AS (
  SELECT d.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM p
"""

#: CRC-32 of a blob column ``body`` by a table that its polynomial gives.
_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(body), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295)"

OP10 = f"""
WITH d AS (
  SELECT doc_id, source, encode(coalesce(text, '')) AS body, md5('shard:' || coalesce(doc_id::VARCHAR, '')) AS key, tbl
  FROM documents, (SELECT {_CRC_TABLE} AS tbl)
), c AS (
  SELECT doc_id, source, key, octet_length(body)::BIGINT + 8 AS size, CAST({_CRC} AS BIGINT) AS text_crc32 FROM d
), f AS (
  SELECT *, (2 * (row_number() OVER (PARTITION BY source ORDER BY key, doc_id, text_crc32) - 1) + 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS fraction FROM c
), p AS (
  SELECT *, row_number() OVER (ORDER BY fraction, source NULLS LAST, key, doc_id, text_crc32) - 1 AS place, count(*) OVER () AS n FROM f
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 24 // n AS INT) AS shard, place - (place * 24 // n * n + 23) // 24 AS slot, CAST(NULL AS INT) AS grown_shard
FROM p
"""
