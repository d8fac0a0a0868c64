"""SQL that DuckDB runs on the same tables, written from the contracts and not from the operators."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc_table() -> str:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return str(out)


def sharding_sql(n: int = 16) -> str:
    """Byte-balanced contiguous shards; DuckDB has no crc32, so it is computed byte by byte."""
    return f"""
WITH t AS (SELECT {_crc_table()}::BIGINT[] AS crc),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (
  SELECT doc_id, strlen(text)::BIGINT + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM d, t),
p AS (
  SELECT *, 2 * sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS middle, sum(size) OVER () AS total,
    row_number() OVER (ORDER BY doc_id) AS r
  FROM s),
q AS (SELECT *, (middle * {n} // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (r - min(r) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM q"""


EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, sha256({LOWER.format("coalesce(text, '')")}) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)"""

LINE_DEDUP = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, s.first IS NOT NULL AND s.first <> doc_id AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""

JACCARD_JOIN = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i:least(len(w), i + 4)], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c.i >= 80 * (x.n + y.n - c.i)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(seen) FROM r WHERE r.node = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d),
r AS (SELECT *, payload_bytes >= 100 AND page_id <> first AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM r"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, b AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, b) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, b AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, b) QUALIFY row_number() OVER w <= 3"""

FILL_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, list_transform(range(4), lambda i: ('0x' || h[8 * i + 1:8 * i + 8])::BIGINT) AS r FROM d),
c AS (SELECT *, len(u) AS n, least(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS a, greatest(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS b FROM u),
f AS (
  SELECT doc_id, t, n, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM f"""


def secrets_sql(reach: int = 240) -> str:
    """Base spans by the contract; weak ones by what cantabile.llm.secrets says of them."""
    value = r"""["'']?\x20*[:=]\x20*["'']?"""
    kinds = {
        "assign": (rf"(?i)(?:password|passwd|secret|token|api_?key){value}[A-Za-z0-9+/_.=-]+", rf"length(regexp_replace(m, '^(?i)(?:password|passwd|secret|token|api_?key){value}', '')) >= 6"),
        "access": (r"AKIA[A-Z0-9]+", "length(m) >= 20"),
        "hex": (r"[0-9a-f]+", "length(m) >= 24"),
        "login": (rf"(?i)(?:access_?key_?id|client_?id|user_?name|user|login|account){value}[A-Za-z0-9@+/_.=-]+", "true"),
        "bare": (r"[A-Za-z0-9+/]{32,}", "length(m) <= 128 AND m SIMILAR TO '.*[a-z].*' AND m SIMILAR TO '.*[A-Z].*' AND m SIMILAR TO '.*[0-9].*'"),
        "endpoint": (r"""[a-z][a-z0-9]{1,9}://[^\x20\x09-\x0D"''<>]+""", "true"),
    }
    each = [
        f"""SELECT id, {i} AS kind, '{kind}' AS name, upto - length(m) AS start_, upto AS end_, {keep} AS keep FROM (
  SELECT id, m, sum(length(g) + length(m)) OVER (PARTITION BY id ORDER BY pos)::BIGINT AS upto FROM (
    SELECT id, unnest(m) AS m, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS pos FROM (
      SELECT id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d)))"""
        for i, (kind, (pattern, keep)) in enumerate(kinds.items())
    ]
    near = f"p.id = s.id AND p.start_ >= s.start_ - {reach} AND p.start_ < s.end_ + {reach}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
x AS MATERIALIZED (SELECT * FROM ({" UNION ALL ".join(each)}) WHERE keep),
scope AS (SELECT * FROM x WHERE name IN ('access', 'login')),
secret AS (SELECT * FROM x WHERE name IN ('assign', 'hex', 'bare')),
whole AS (SELECT * FROM scope s WHERE EXISTS (SELECT 1 FROM secret p WHERE {near})),
told AS (
  SELECT * FROM x WHERE kind <= 2 UNION ALL SELECT * FROM whole WHERE name = 'login'
  UNION ALL SELECT * FROM x p WHERE name = 'bare' AND EXISTS (SELECT 1 FROM scope s WHERE {near})
  UNION ALL SELECT * FROM x p WHERE name = 'endpoint' AND EXISTS (SELECT 1 FROM whole s WHERE {near})),
o AS (SELECT *, name || ':' || start_ || ':' || end_ AS says FROM told),
g AS (
  SELECT id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h,
    string_agg(says, ',' ORDER BY start_, kind) FILTER (kind <= 2) AS base, string_agg(says, ',' ORDER BY start_, kind) AS spans FROM o GROUP BY id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (id)"""
