"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from timeloom.llm.sharding import MULTIPLIER, SLOT_PARTS

SHARDS = 40


def _crc_nibbles() -> list[int]:
    """The sixteen entries of the table with which crc32 takes four bits at a time, by its rule."""
    table = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return table


def _crc32(hexadecimal: str) -> str:
    """SQL for the crc32 of bytes that are given in hexadecimal."""
    table = f"[{', '.join(f'{n}::BIGINT' for n in _crc_nibbles())}]"
    half = lambda x: f"xor(({x}) >> 4, {table}[(({x}) & 15) + 1])"
    numbers = f"list_transform(regexp_extract_all({hexadecimal}, '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {numbers}), lambda c, b: {half(half('xor(c, b)'))}))"


SHARDING = f"""
WITH RECURSIVE sized AS (
    SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 16)::BIGINT AS size, {_crc32("hex(encode(coalesce(text, '')))")}::BIGINT AS text_crc32 FROM documents
), walk(doc_id, k, b, j, step) AS (
    SELECT DISTINCT doc_id, doc_id::HUGEINT, -1::BIGINT, 0::BIGINT, 0 FROM documents
    UNION ALL
    SELECT doc_id, n, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((n // 8589934592) + 1)::DOUBLE))::BIGINT, step + 1
    FROM (SELECT *, (k * {MULTIPLIER} + 1) % 18446744073709551616::HUGEINT AS n FROM walk) WHERE j < {SHARDS}
), placed AS (
    SELECT doc_id, max(CASE WHEN j < {SHARDS} THEN j END)::INT AS shard, CASE WHEN bool_or(j = {SHARDS}) THEN {SHARDS} ELSE max(CASE WHEN j < {SHARDS} THEN j END) END::INT AS grown_shard,
        max(CASE WHEN step = 1 THEN (k // 8589934592) % {SLOT_PARTS} END) AS draw
    FROM walk GROUP BY doc_id
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY (draw + text_crc32 + size) % {SLOT_PARTS}, doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown_shard
FROM sized JOIN placed USING (doc_id)
"""

ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT payload, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload)
SELECT page_id, payload_bytes, sha256(payload) AS payload_digest,
    CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload)
"""

JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS ws FROM documents),
g AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS gs
    FROM w
),
e AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS gram FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, c = na AND c = nb AS same FROM p WHERE c >= 0.8 * (na + nb - c) - 1e-9),
r(a, b) AS (SELECT doc_id, doc_id FROM g UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, count(*) AS links, count(*) FILTER (same) AS copies FROM l GROUP BY a)
SELECT g.doc_id, (SELECT min(r.b) FROM r WHERE r.a = g.doc_id) AS class_id, coalesce(links, 0)::BIGINT AS n_links, (coalesce(copies, 0) + 1)::BIGINT AS n_copies
FROM g LEFT JOIN c ON c.a = g.doc_id
"""

def _vector_codes(rounds: int = 4) -> str:
    """Each round: the nearest entry by (distance, index), then the floor of the mean where an entry is used."""
    steps = []
    for r in range(rounds):
        steps.append(f"""
n{r} AS MATERIALIZED (
    SELECT i, p, v, min((list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c))::HUGEINT * 256 + e) AS m
    FROM parts JOIN c{r} USING (p) GROUP BY i, p, v
), s{r} AS (SELECT p, m % 256 AS e, k, floor(sum(v[k]) / count(*)) AS mean FROM n{r}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM parts) + 1)) AS k) GROUP BY p, m % 256, k),
c{r + 1} AS MATERIALIZED (
    SELECT c{r}.p, c{r}.e, coalesce(u.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT p, e, list(mean ORDER BY k) AS c FROM s{r} GROUP BY p, e) u ON u.p = c{r}.p AND u.e = c{r}.e
)""")
    return f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * 1024)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id, x) AS i FROM kept),
parts AS MATERIALIZED (SELECT i, p, x[p * (len(x) // 4) + 1 : (p + 1) * (len(x) // 4)] AS v FROM numbered, range(4) t(p)),
c0 AS MATERIALIZED (SELECT p, (i - 1)::HUGEINT AS e, v AS c FROM parts WHERE i <= 256),
{",".join(steps)},
last AS MATERIALIZED (
    SELECT i, p, min((list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c))::HUGEINT * 256 + e) AS m FROM parts JOIN c{rounds} USING (p) GROUP BY i, p
), rows AS (SELECT i, string_agg(format('{{:02x}}', (m % 256)::INT), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM last GROUP BY i),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT), ','), ',' ORDER BY p, e)) AS h FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM numbered JOIN rows USING (i), books
"""


MIXING = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5(concat_ws(':', 'mix', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 15))::BIGINT AS h
    FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2 AS lim FROM s),
o AS (
    SELECT *, row_number() OVER b AS rank,
        (sum(source_size) OVER () * 150 - 100 * coalesce(sum(lim) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS rest,
        100.0 * (sum(weight) OVER () - coalesce(sum(weight) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS heavy
    FROM w WINDOW b AS (ORDER BY lim / weight, source NULLS LAST)
), level AS (SELECT rest, heavy FROM o WHERE lim * heavy >= weight * rest ORDER BY rank LIMIT 1),
t AS (SELECT source, source_size, least(lim::DOUBLE, weight * level.rest / level.heavy) AS target FROM o, level),
g AS (SELECT source, h, count(*) AS n, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) - sum(size) AS before FROM d GROUP BY source, h),
turns AS (SELECT t.*, least(greatest(target - k * source_size, 0), source_size) AS budget FROM t, range(2) r(k)),
taken AS (
    SELECT g.source, g.h, sum(CASE WHEN before + words <= budget THEN n WHEN before >= budget OR words = 0 THEN 0 ELSE least(n, floor((budget - before) * n / words + 0.5)) END) AS rows_taken, any_value(n) AS n, any_value(target) AS target, any_value(source_size) AS source_size,
        list(CASE WHEN before + words <= budget THEN n WHEN before >= budget OR words = 0 THEN 0 ELSE least(n, floor((budget - before) * n / words + 0.5)) END) AS each
    FROM g JOIN turns ON turns.source IS NOT DISTINCT FROM g.source GROUP BY g.source, g.h
), numbered AS (SELECT *, row_number() OVER (PARTITION BY source, h) AS number FROM d)
SELECT doc_id, size, taken.source_size, taken.target, (size * len(list_filter(each, lambda e: numbered.number <= e)))::BIGINT AS taken, numbered.source
FROM numbered JOIN taken ON taken.source IS NOT DISTINCT FROM numbered.source AND taken.h = numbered.h
"""

ORACLES: dict[str, str] = {"op1_sharding": SHARDING, "op4_warc": ARCHIVES, "op10_jaccard": JACCARD, "op11_vector_codes": _vector_codes(), "op12_mixing": MIXING}
