"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

from corvanta.llm.licenses import COPYRIGHT_LINE, NOT_WORD, SPELLINGS, known_texts

MIX = r"""
WITH rows AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS k
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS place
  FROM rows GROUP BY source
), weighted AS (
  SELECT source, source_size, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         3 * source_size AS cap
  FROM totals
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(coalesce(sum(cap) OVER before, 0) AS BIGINT) AS capped,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS left_weight,
         row_number() OVER (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST) AS pos
  FROM weighted
  WINDOW before AS (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT total - capped AS rest, left_weight FROM levels
  WHERE weight * (total - capped) <= cap * left_weight ORDER BY pos LIMIT 1
), targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN l.weight * v.rest <= l.cap * v.left_weight
              THEN CAST(l.weight * v.rest AS DOUBLE) / v.left_weight ELSE CAST(l.cap AS DOUBLE) END AS target
  FROM levels l CROSS JOIN level v
), placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.k, r.doc_id, r.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE CAST(budget // source_size AS BIGINT) * size
         + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END AS taken
FROM placed
"""

WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS digest FROM pages
), r AS (
  SELECT *, count(*) OVER (PARTITION BY digest) AS n, max(page_id) OVER (PARTITION BY digest) AS last FROM p
), m AS (
  SELECT *, size >= 1000 AND n > 1 AND last IS NOT NULL AND page_id IS DISTINCT FROM last AS again FROM r
)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN last END AS refers_to
FROM m
"""

NGRAM = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets
), each AS (SELECT doc_id, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM sizes UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other
)
SELECT s.doc_id, s.n AS n_shingles, r.component_id FROM sizes s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""


VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), usable AS (
  SELECT vec_id, x FROM v WHERE len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0
), links AS (
  SELECT a.vec_id AS p, b.vec_id AS q FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.95
), reach AS (
  SELECT vec_id, vec_id AS other FROM v UNION SELECT reach.vec_id, links.q FROM reach JOIN links ON links.p = reach.other
), least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), degrees AS (SELECT p AS vec_id, count(*) AS n FROM links GROUP BY p)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN degrees USING (vec_id)
"""

OVERLAPS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
), i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark
), items AS (SELECT item_id, w, len(w) AS n, least(13, (80 * len(w) + 99) // 100) AS need FROM i WHERE len(w) >= 5
), dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d
), iw AS (SELECT item_id, need, n, unnest(w) AS word, unnest(range(len(w))) AS p FROM items
), lines AS (
  SELECT doc_id, item_id, n, need, dw.p - iw.p AS shift, list(iw.p ORDER BY iw.p) AS ps FROM dw JOIN iw USING (word) GROUP BY ALL HAVING count(*) >= need
), begun AS (SELECT *, unnest(range(1, len(ps) + 1)) AS a FROM lines
), stretches AS (
  SELECT doc_id, item_id, n, need, shift, ps[a] AS s, unnest(ps[a:]) AS e, unnest(range(1, len(ps) - a + 2)) AS hits FROM begun
), best AS (
  SELECT * FROM stretches WHERE hits >= need AND 100 * hits >= 80 * (e - s + 1)
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY hits DESC, shift, e - s, s) = 1
)
SELECT doc_id, item_id, CAST(s + shift AS BIGINT) AS text_start, CAST(s AS BIGINT) AS item_start, CAST(e - s + 1 AS BIGINT) AS overlap_words, CAST(hits AS BIGINT) AS matching_words, CAST(n AS BIGINT) AS item_words FROM best
"""


def _licenses() -> str:
    known = ", ".join(f"('{digest}', '{scope}', '{license_}')" for digest, scope, license_, _ in known_texts())
    spelled = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in SPELLINGS.items())
    words = lambda x: f"trim(regexp_replace({x}, '{NOT_WORD}', ' ', 'g'))"
    kept = "regexp_replace(lower(text), '" + COPYRIGHT_LINE + "', '\\1', 'g')"
    return f"""
WITH known(digest, scope, license) AS (VALUES {known}
), lines AS (SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), units AS (
  SELECT doc_id, 'text' AS scope, CAST(NULL AS BIGINT) AS line, {words(kept)} AS w FROM documents
  UNION ALL SELECT doc_id, 'line', line, {words('lower(t)')} FROM lines
), digests AS (
  SELECT doc_id, scope, line, sha256(array_to_string(list_transform(string_split(w, ' '), lambda x: CASE x {spelled} ELSE x END), ' ')) AS digest
  FROM units WHERE w <> ''
)
SELECT doc_id, scope, line, license, digest FROM digests JOIN known USING (digest, scope)
"""


ORACLES: dict[str, str] = {
    "op2_mix_sources": MIX,
    "op3_vector_graph": VECTORS,
    "op4_decontamination": OVERLAPS,
    "op5_license_digests": _licenses(),
    "op7_ngram_join": NGRAM,
    "op8_warc_packages": WARC,
}
