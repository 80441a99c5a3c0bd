"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

COMPONENTS = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words
  FROM documents
),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE
    WHEN len(words) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS shingle
  FROM w
),
n AS (SELECT doc_id, count(shingle) AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
both_in AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
),
pairs AS (
  SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= PERCENT * (x.n_shingles + y.n_shingles - shared)
),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached(doc_id, root) AS (
  SELECT doc_id, doc_id FROM w
  UNION SELECT l.a, r.root FROM reached r JOIN links l ON l.b = r.doc_id
),
c AS (SELECT doc_id, min(root) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, n_shingles, component_id FROM n JOIN c USING (doc_id)
"""

NEAR_DUPLICATES = f"""
SELECT *, doc_id = component_id AS kept FROM ({COMPONENTS.replace("PERCENT", "85")})
"""

SIMILAR = COMPONENTS.replace("PERCENT", "80")

MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5(concat_ws('|', 'mix', coalesce(CAST(doc_id AS VARCHAR), '-'),
      md5(coalesce(text, '')))), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM documents
),
sources AS (
  SELECT source, source_size, 3 * source_size AS cap, w, 3 * source_size / w AS c FROM (
    SELECT source, source_size,
      CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE
      ELSE 1.0::DOUBLE END AS w
    FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source))
),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER before_it, 0) AS DOUBLE)
    / sum(w) OVER from_it AS level
  FROM sources
  WINDOW before_it AS (ORDER BY c, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    from_it AS (ORDER BY c, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
),
share AS (SELECT max(level) AS level FROM levels WHERE c = (SELECT min(c) FROM levels WHERE level <= c)),
t AS (
  SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), w * (SELECT level FROM share)), 0.0) AS target
  FROM sources
),
e AS (
  SELECT *, floor(e) AS whole, e - floor(e) AS part, target - floor(e) * source_size AS rest
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS e FROM t)
),
r AS (
  SELECT d.*, e.source_size, e.target, e.whole, e.part, e.rest,
    CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS odds
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
),
m AS (
  SELECT *, CASE WHEN part > 0 AND coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 <= rest THEN 1 ELSE 0 END AS more
  FROM r
)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN CAST(whole AS BIGINT) + more ELSE 0 END AS copies,
  size * CASE WHEN size > 0 THEN CAST(whole AS BIGINT) + more ELSE 0 END AS taken
FROM m
"""

TOP_K = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id,
    list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
),
p AS (
  SELECT q.uid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.uid <> q.uid AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM p)
WHERE rank <= 20
"""

RESAMPLED = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS t
),
d AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
m AS (SELECT unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
w AS (SELECT doc_id, unnest(words) AS word FROM d),
known AS (SELECT word, hex(word) AS h FROM (SELECT word FROM w UNION SELECT word FROM m)),
b AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2),
      lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket
  FROM known, crc
),
s AS (SELECT bucket, count(*) AS n FROM w JOIN b USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM m JOIN b USING (word) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * (a.s + 10000) AS DOUBLE)
    / CAST((s.n + 1) * (a.t + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket),
    (SELECT (SELECT count(*) FROM w) AS s, (SELECT count(*) FROM m) AS t) a
),
f AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN b USING (word) JOIN g USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(
      sha256(concat('2024:', CAST(doc_id AS VARCHAR))), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM d LEFT JOIN f USING (doc_id)
),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op6_near_duplicates": NEAR_DUPLICATES,
    "op9_mixing": MIXING,
    "op10_top_k": TOP_K,
    "op11_resampling": RESAMPLED,
    "op12_ngram_join": SIMILAR,
}
