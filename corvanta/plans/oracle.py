"""DuckDB SQL of the queries, written apart from them."""

from __future__ import annotations

from corvanta.operators.answers import INSTRUCTION, NO_CONTEXT
from corvanta.plans.queries import HALF_LIFE, LEAK, MANY_NODES, NODES, SINGLE, UNSEEN, WAIT

_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_IN_LINE = r"[\t\x0b-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_strip = lambda x: f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"
_lines = lambda x: f"regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '{_IN_LINE}+(\\n|$)', '\\1', 'g')"
_quote = lambda x: "'" + x.replace("'", "''") + "'"

_CHUNKS = f"""
chunks AS (
  SELECT doc_id, list_filter(list_transform(parts, lambda x: {_strip('x')}), lambda x: x <> '') AS c FROM parts
), each AS (
  SELECT doc_id, unnest(range(len(c))) AS chunk_index, unnest(c) AS chunk_text FROM chunks
), named AS (
  SELECT doc_id, chunk_index, doc_id || '::chunk::' || chunk_index AS chunk_id, chunk_text FROM each
)
"""
_PARAGRAPHS = f"""WITH parts AS (
  SELECT doc_id, regexp_split_to_array({_lines("replace(text, chr(10), chr(10) || chr(10))")}, '\\n{{2,}}') AS parts FROM documents
), {_CHUNKS}"""
_TRANSCRIPTS = f"""WITH md AS (
  SELECT conv_id AS doc_id, string_agg('## ' || role || ' ' || turn || chr(10) || text, chr(10) ORDER BY turn) AS text
  FROM conversations GROUP BY conv_id
), parts AS (
  SELECT doc_id, string_split(regexp_replace({_lines('text')}, '(?m)^(#{{1,6}}{_BLANK})', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM md
), {_CHUNKS}"""
_CHUNK_OUT = "SELECT doc_id, chunk_index, chunk_id, CAST(length(chunk_text) AS BIGINT) AS n_chars, md5(chunk_text) AS text_md5 FROM named"

_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]{{2,}}')"
_POSTINGS = f"""tokens AS (
  SELECT unit_id, unnest({_TOKENS.format('text')}) AS term FROM units
), postings AS (
  SELECT term, unit_id, count(*) AS tf FROM tokens GROUP BY ALL
), corpus AS (SELECT count(DISTINCT unit_id) AS n FROM tokens)"""
_UNITS = "units AS (SELECT CAST(doc_id AS VARCHAR) AS unit_id, text FROM documents)"
_IDF = "ln((n + 1)::DOUBLE / (df + 1)) + 1"


def _keyword(top_k: int, name: str = "keyword") -> str:
    """CTEs from units and queries (query_id, query) to the ranked hits ``name``."""
    return f"""{_POSTINGS}, qterms AS (
  SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOKENS.format('query')}) AS term FROM queries) GROUP BY ALL
), dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term
), qw AS (
  SELECT query_id, term, {_IDF.replace('df', 'coalesce(df, 0)')} AS idf, (1 + ln(qtf)) * ({_IDF.replace('df', 'coalesce(df, 0)')}) AS w
  FROM qterms LEFT JOIN dfs USING (term) CROSS JOIN corpus
), qn AS (SELECT query_id, sqrt(sum(w * w)) AS qnorm FROM qw GROUP BY query_id
), sums AS (
  SELECT query_id, unit_id, sum(w * (1 + ln(tf)) * idf) AS dot, sqrt(sum((1 + ln(tf)) * idf * (1 + ln(tf)) * idf)) AS dnorm
  FROM postings JOIN qw USING (term) GROUP BY ALL
), kscores AS (
  SELECT query_id, unit_id, greatest(0, least(1, dot / (qnorm * dnorm + 1e-9))) AS score FROM sums JOIN qn USING (query_id)
), {name} AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, unit_id) AS rank, unit_id, score FROM kscores
  QUALIFY rank <= {top_k}
)"""


def _vector(top_k: int, name: str = "near") -> str:
    return f"""vscores AS (
  SELECT query_id, unit_id, list_cosine_similarity(v.vector, q.vector) AS score FROM vectors v CROSS JOIN qvectors q
), {name} AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, unit_id) AS rank, unit_id, score FROM vscores
  QUALIFY rank <= {top_k}
)"""


_HITS = "SELECT query_id, rank, unit_id, round(score, 6) AS score FROM "
_single = lambda text: f"WITH {_UNITS}, queries AS (SELECT CAST(0 AS BIGINT) AS query_id, {_quote(text)} AS query), {_keyword(10)} {_HITS} keyword"
_ASKED = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
_HYBRID = """hu AS (SELECT CAST(doc_id AS VARCHAR) AS unit_id, text, CAST(embedding AS DOUBLE[]) AS vector FROM documents JOIN embeddings ON doc_id = vec_id
), units AS (SELECT unit_id, text FROM hu), vectors AS (SELECT unit_id, vector FROM hu
), hq AS (SELECT item_id AS query_id, text AS query, CAST(embedding AS DOUBLE[]) AS vector FROM benchmark JOIN embeddings ON item_id = vec_id
), queries AS (SELECT query_id, query FROM hq), qvectors AS (SELECT query_id, vector FROM hq)"""
_FUSED = """fscores AS (
  SELECT coalesce(k.query_id, v.query_id) AS query_id, coalesce(k.unit_id, v.unit_id) AS unit_id,
         0.7::DOUBLE * (0.5::DOUBLE * coalesce(k.score, 0) + 0.5::DOUBLE * coalesce(v.score, 0))
         + 0.3::DOUBLE * (10 * (coalesce(1 / (60 + k.rank)::DOUBLE, 0) + coalesce(1 / (60 + v.rank)::DOUBLE, 0))) AS score
  FROM keyword k FULL OUTER JOIN near v ON k.query_id = v.query_id AND k.unit_id = v.unit_id
), hybrid AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, unit_id) AS rank, unit_id, score FROM fscores
  QUALIFY rank <= 5
)"""
_CONTEXT = f"""{_ASKED}, {_UNITS}, {_keyword(5)}, entries AS (
  SELECT query_id, rank, '[' || rank || '] (doc: ' || unit_id || ', score: ' || CAST(CAST(CAST(round(score, 6) AS DECIMAL(18, 6)) AS DECIMAL(18, 4)) AS VARCHAR) || ')' || chr(10) || text AS entry
  FROM keyword JOIN units USING (unit_id)
), contexts AS (
  SELECT q.query_id, q.query, coalesce(string_agg(entry, chr(10) || chr(10) ORDER BY rank), '{NO_CONTEXT}') AS context
  FROM queries q LEFT JOIN entries USING (query_id) GROUP BY ALL
)"""


def _signed(key: str) -> str:
    h = f"CAST(CAST('0x' || substr(md5({key}), 1, 16) AS UBIGINT) AS HUGEINT)"
    return f"CAST(CASE WHEN {h} >= 9223372036854775808 THEN {h} - 18446744073709551616 ELSE {h} END AS BIGINT)"


_ring = lambda nodes, name="ring": f"""{name} AS MATERIALIZED (
  SELECT vnode_hash, first(node ORDER BY node, i) AS node FROM (
    SELECT node, i, {_signed("node || '#vnode-' || i")} AS vnode_hash
    FROM (SELECT unnest({nodes}) AS node) CROSS JOIN (SELECT unnest(range(150)) AS i)
  ) GROUP BY vnode_hash
)"""  # noqa: E731
_RING = _ring(NODES)
_KEYS = f"keys AS (SELECT key, {_signed('key')} AS h FROM (SELECT DISTINCT event_type || ':' || user_id AS key FROM events))"
_routed = lambda ring, name: f"""{name} AS (
  SELECT key, coalesce(
    (SELECT arg_min(node, vnode_hash) FROM {ring} WHERE vnode_hash >= h), (SELECT arg_min(node, vnode_hash) FROM {ring})) AS node FROM keys
)"""  # noqa: E731

_TTL = """RECURSIVE a AS (
  SELECT event_id AS seq, event_type || ':' || user_id AS key, epoch_us(ts) AS us,
         row_number() OVER (PARTITION BY event_type || ':' || user_id ORDER BY ts, event_id) AS n
  FROM events
), r AS (
  SELECT seq, key, n, false AS hit, us + 86400000000 AS expires FROM a WHERE n = 1
  UNION ALL
  SELECT a.seq, a.key, a.n, a.us <= r.expires, CASE WHEN a.us <= r.expires THEN r.expires ELSE a.us + 86400000000 END
  FROM r JOIN a ON a.key = r.key AND a.n = r.n + 1
)"""

_REV = f"""ls AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS lines FROM documents
), kept AS (SELECT * FROM ls WHERE len(lines) >= 3 AND len(lines) = len(list_distinct(lines))
), li AS (SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM kept
), placed AS (
  SELECT doc_id, i, i - (i + 2) // 6 + i // 6 AS j, line, 'inserted ' || doc_id || ' ' || i AS added, 2 * length(line) >= 0.55 * (2 * length(line) + 4) AS near FROM li
), deltas AS (
  SELECT doc_id, 'UNCHANGED' AS kind, i AS old_index, j AS new_index, line AS old_text, line AS new_text FROM placed WHERE i % 6 NOT IN (1, 3)
  UNION ALL SELECT doc_id, 'MODIFIED', i, j, line, line || ' rev' FROM placed WHERE i % 6 = 1 AND near
  UNION ALL SELECT doc_id, 'DELETED', i, NULL, line, NULL FROM placed WHERE i % 6 = 3 OR (i % 6 = 1 AND NOT near)
  UNION ALL SELECT doc_id, 'ADDED', NULL, j, NULL, line || ' rev' FROM placed WHERE i % 6 = 1 AND NOT near
  UNION ALL SELECT doc_id, 'ADDED', NULL, j + 1, NULL, added FROM placed WHERE i % 6 = 5
)"""

_UP = "translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_MOVES = f"""ls AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS lines FROM documents
), caps AS (SELECT doc_id, lines, list_filter(list_transform(lines, lambda line: {_UP}), lambda x: NOT list_contains(lines, x)) AS changed,
    len(list_filter(lines, lambda line: {_UP} <> line)) AS n_changed FROM ls
), kept AS (SELECT * FROM caps WHERE len(lines) >= 3 AND len(lines) = len(list_distinct(lines)) AND len(changed) = n_changed AND len(changed) = len(list_distinct(changed))
), li AS (SELECT doc_id, len(lines) AS n, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM kept
), placed AS (
  SELECT doc_id, n, i, line, {_UP} AS up, i % 6 = 3 AND i <= n - 4 AS moved, i - (least(i - 1, n - 4) + 3) // 6 AS j, (n - 4 + 3) // 6 AS all_moved FROM li
), deltas AS (
  SELECT doc_id, CASE WHEN i % 6 = 1 AND up <> line THEN 'MODIFIED' ELSE 'UNCHANGED' END AS kind, i AS old_index, j AS new_index, line AS old_text, CASE WHEN i % 6 = 1 THEN up ELSE line END AS new_text
  FROM placed WHERE NOT moved
  UNION ALL SELECT doc_id, 'DELETED', i, NULL, line, NULL FROM placed WHERE moved
  UNION ALL SELECT doc_id, 'ADDED', NULL, n - all_moved + (i - 3) // 6, NULL, line FROM placed WHERE moved
)"""

_lcs = lambda a, b: f"""RECURSIVE p AS (
  SELECT x.item_id AS id, string_split({a}, '') AS a, string_split({b}, '') AS b, length(x.text) AS la, length(y.text) AS lb
  FROM benchmark x JOIN benchmark y ON y.item_id = x.item_id + 1
), step AS (
  SELECT id, 0 AS i, list_transform(range(len(b) + 1), lambda k: 0) AS row FROM p
  UNION ALL
  SELECT id, i + 1, list_transform(range(1, len(c) + 1), lambda k: list_max(c[1:k])) FROM (
    SELECT s.id, s.i, list_transform(range(1, len(p.b) + 2), lambda k: CASE WHEN k > 1 AND p.a[s.i + 1] = p.b[k - 1] THEN s.row[k - 1] + 1 ELSE s.row[k] END) AS c
    FROM step s JOIN p ON p.id = s.id WHERE s.i < len(p.a)
  )
), lcs AS (SELECT id, CAST(max(row[-1]) AS BIGINT) AS lcs FROM step GROUP BY id)"""  # noqa: E731

_ENTRIES = "entries AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0 ORDER BY vec_id DESC LIMIT 500)"

_SEMANTIC = """p AS (
  SELECT a.vec_id AS i, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
), replay AS (
  SELECT 2 * i AS seq, 'entry ' || i AS key, 'miss' AS hit_type, 0::DOUBLE AS similarity FROM p
  UNION ALL
  SELECT 2 * i + 1, 'entry ' || i || CASE WHEN i % 3 = 0 THEN '' ELSE ' again' END, CASE i % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'semantic' ELSE 'miss' END,
    CASE i % 3 WHEN 0 THEN 1 WHEN 1 THEN round(list_cosine_similarity(x, list_transform(range(1, len(x) + 1), lambda k: 0.95::DOUBLE * x[k] + 0.2::DOUBLE * y[k])), 6) ELSE 0 END FROM p
)"""

ORACLES: dict[str, str] = {
    "tokenize_docs": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)",
    "chunk_paragraphs": f"{_PARAGRAPHS} {_CHUNK_OUT}",
    "chunk_headers": f"{_TRANSCRIPTS} {_CHUNK_OUT}",
    "chunk_ids": f"{_PARAGRAPHS} SELECT chunk_id, CAST(doc_id AS VARCHAR) AS parent FROM named",
    "postings": f"WITH {_UNITS}, {_POSTINGS} SELECT term, unit_id, tf FROM postings",
    "term_df_idf": f"WITH {_UNITS}, {_POSTINGS} SELECT term, df, round({_IDF}, 6) AS idf FROM (SELECT term, count(*) AS df FROM postings GROUP BY term) CROSS JOIN corpus",
    "doc_tf_weights": f"WITH {_UNITS}, {_POSTINGS} SELECT term, unit_id, round(1 + ln(tf), 6) AS weight FROM postings",
    "index_build": f"WITH {_UNITS}, {_POSTINGS} SELECT term, count(*) AS df FROM postings GROUP BY term",
    "keyword_search": _single(SINGLE),
    "keyword_search_texts": _single(SINGLE),
    "keyword_unseen_terms": _single(UNSEEN),
    "keyword_search_batch": f"WITH {_UNITS}, {_ASKED}, {_keyword(10)} {_HITS} keyword",
    "vector_search": f"WITH vectors AS (SELECT vec_id AS unit_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings), qvectors AS (SELECT unit_id AS query_id, vector FROM vectors WHERE unit_id = 0), {_vector(10)} {_HITS} near",
    "vector_search_batch": f"WITH vectors AS (SELECT vec_id AS unit_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings), qvectors AS (SELECT unit_id AS query_id, vector FROM vectors WHERE unit_id % 100 = 0), {_vector(10)} {_HITS} near",
    "vector_normalize": """WITH v AS (SELECT vec_id, CAST(list_slice(embedding, 1, 32) AS DOUBLE[]) AS x FROM embeddings),
        n AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS length FROM v)
        SELECT vec_id, unnest(range(len(x))) AS place, round(CASE WHEN length > 0 THEN unnest(x) / length ELSE unnest(x) END, 6) AS value FROM n""",
    "hybrid_search": f"WITH {_HYBRID}, {_keyword(10)}, {_vector(10)}, {_FUSED} {_HITS} hybrid",
    "rrf_fusion": f"WITH {_HYBRID}, {_keyword(10)}, {_vector(10)} SELECT query_id, unit_id, round(sum(1 / (60 + rank)::DOUBLE), 6) AS rrf FROM (FROM keyword UNION ALL FROM near) GROUP BY ALL",
    "compare_modes": f"""WITH {_HYBRID}, {_keyword(10)}, {_vector(10)}, {_FUSED}
        SELECT query_id, rank, unit_id, round(score, 6) AS score, source FROM (
          SELECT *, 'hybrid' AS source FROM hybrid UNION ALL SELECT *, 'keyword' FROM keyword WHERE rank <= 5 UNION ALL SELECT *, 'vector' FROM near WHERE rank <= 5)""",
    "hydrate_hits": f"WITH {_UNITS}, {_ASKED}, {_keyword(5)} SELECT query_id, rank, unit_id AS doc_id, round(score, 6) AS score, md5(text) AS text_md5, 'keyword' AS source FROM keyword JOIN units USING (unit_id)",
    "build_context": f"WITH {_CONTEXT} SELECT query_id, CAST(length(context) AS BIGINT) AS n_chars, md5(context) AS context_md5 FROM contexts",
    "build_prompt": f"""WITH {_CONTEXT}, p AS (
          SELECT query_id, {_quote(INSTRUCTION)} || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || query || chr(10) || chr(10) || 'Answer:' AS prompt FROM contexts)
        SELECT query_id, CAST(length(prompt) AS BIGINT) AS n_chars, md5(prompt) AS prompt_md5 FROM p""",
    "cache_key": "SELECT item_id AS query_id, mode, top_k, sha256(text || '|' || mode || '|' || top_k) AS cache_key FROM benchmark CROSS JOIN (SELECT unnest(['hybrid', 'vector', 'keyword']) AS mode) CROSS JOIN (SELECT unnest(range(1, 6)) AS top_k)",
    "ring_build": f"WITH {_RING} SELECT vnode_hash, node FROM ring",
    "ring_route": f"WITH {_RING}, {_KEYS}, {_routed('ring', 'routed')} SELECT key, node FROM routed",
    "ring_remove_node": f"""WITH {_RING}, {_KEYS}, less AS (SELECT * FROM ring WHERE node <> '{NODES[1]}'), {_routed('ring', 'one')}, {_routed('less', 'two')}
        SELECT one.node AS from_node, two.node AS to_node, count(*) AS keys FROM one JOIN two USING (key) WHERE one.node <> two.node GROUP BY ALL""",
    "ring_add_node": f"""WITH {_RING}, {_ring([*NODES, 'node-4'], 'more')}, {_KEYS}, {_routed('ring', 'one')}, {_routed('more', 'two')}
        SELECT one.node AS from_node, two.node AS to_node, count(*) AS keys FROM one JOIN two USING (key) WHERE one.node <> two.node GROUP BY ALL""",
    "ring_route_large": f"""WITH {_ring([f'node-{i}' for i in range(MANY_NODES)])}, {_KEYS}
        SELECT key, coalesce(ring.node, (SELECT arg_min(node, vnode_hash) FROM ring)) AS node FROM keys ASOF LEFT JOIN ring ON h <= vnode_hash""",
    "ring_nodes": f"SELECT unnest({[n for n in NODES if n != NODES[1]]}) AS node",
    "eviction_utility": f"""SELECT event_type || ':' || user_id AS key, count(*) AS accesses,
          round(ln(1 + count(*)) * exp(-0.693147::DOUBLE * ((SELECT max(epoch_us(ts)) FROM events) - max(epoch_us(ts))) / 1e6 / {HALF_LIFE}::DOUBLE), 6) AS utility
        FROM events GROUP BY key""",
    "ttl_cache_replay": f"WITH {_TTL} SELECT seq, key, hit FROM r",
    "lru_cache_roomy": f"WITH {_TTL}, {_RING}, {_KEYS}, {_routed('ring', 'routed')} SELECT node, seq, key, hit FROM r JOIN routed USING (key)",
    "key_recency": "SELECT key, max(event_id) AS last_seq, row_number() OVER (ORDER BY max(event_id) DESC) AS recency FROM (SELECT event_id, event_type || ':' || user_id AS key FROM events) GROUP BY key",
    "cache_stats": f"WITH {_TTL} SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*)::DOUBLE, 4) AS hit_rate FROM r",
    "semantic_fifo": f"WITH {_ENTRIES} SELECT vec_id AS entry_id, 'entry ' || vec_id AS key FROM entries",
    "semantic_lookup": f"""WITH {_ENTRIES}, p AS (
          SELECT a.vec_id AS probe_id, list_transform(range(1, len(a.embedding) + 1), lambda k:
            CASE WHEN a.vec_id % 200 = 0 THEN 0.95::DOUBLE ELSE 0.5::DOUBLE END * a.embedding[k]::DOUBLE
            + CASE WHEN a.vec_id % 200 = 0 THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END * b.embedding[k]::DOUBLE) AS q
          FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 100 = 0
        ), s AS (SELECT probe_id, vec_id, list_cosine_similarity(vector, q) AS score FROM p CROSS JOIN entries
        ), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY round(score, 12) DESC, vec_id) = 1)
        SELECT probe_id, CASE WHEN score >= 0.88 THEN vec_id END AS entry_id, round(CASE WHEN score >= 0.88 THEN score ELSE 0 END, 6) AS similarity,
               CASE WHEN score >= 0.88 THEN 'semantic' ELSE 'miss' END AS hit_type FROM best""",
    "semantic_replay": f"WITH {_SEMANTIC} SELECT 'all' AS scope, seq, hit_type, similarity FROM replay",
    "semantic_stats": f"""WITH {_SEMANTIC}, t AS (SELECT count(*) FILTER (hit_type = 'miss') AS misses, count(*) FILTER (hit_type <> 'miss') AS hits, count(*) FILTER (hit_type = 'semantic') AS semantic_hits FROM replay
        ), {_ring(['partition-0', 'partition-1', 'partition-2', 'partition-3'])}, put AS (SELECT key, {_signed('key')} AS h FROM replay WHERE hit_type = 'miss'
        ), shards AS (SELECT coalesce(ring.node, (SELECT arg_min(node, vnode_hash) FROM ring)) AS node, count(*) AS puts FROM put ASOF LEFT JOIN ring ON h <= vnode_hash GROUP BY ALL
        ), e AS (SELECT sum(least(64, puts)) AS size, sum(greatest(0, puts - 64)) AS evictions FROM shards)
        SELECT 'all' AS scope, CAST(size AS BIGINT) AS size, hits, misses, semantic_hits, least(500, misses) AS semantic_entries, CAST(evictions AS BIGINT) AS evictions,
          CAST(evictions AS BIGINT) AS predictive_evictions, CAST(0 AS BIGINT) AS epoch, CAST(256 AS BIGINT) AS capacity, CAST(4 AS BIGINT) AS num_partitions,
          CAST(150 AS BIGINT) AS virtual_nodes_per_partition, round(hits / (hits + misses)::DOUBLE, 4) AS hit_rate FROM t CROSS JOIN e""",
    "lcs_length": f"WITH {_lcs('x.text', 'y.text')} SELECT id, lcs FROM lcs",
    "char_similarity": f"WITH {_lcs('lower(x.text)', 'lower(y.text)')} SELECT id, round(lcs / ((la + lb) / 2::DOUBLE), 6) AS similarity FROM lcs JOIN p USING (id)",
    "lcs_align": f"WITH {_REV} SELECT doc_id, old_index, new_index FROM deltas WHERE kind = 'UNCHANGED'",
    "diff_deltas": f"WITH {_REV} SELECT doc_id, kind, old_index, new_index, md5(old_text) AS old_md5, md5(new_text) AS new_md5 FROM deltas",
    "diff_moves": f"WITH {_MOVES} SELECT doc_id, kind, old_index, new_index, md5(old_text) AS old_md5, md5(new_text) AS new_md5 FROM deltas",
    "diff_summary": f"WITH {_REV} SELECT doc_id, count(*) FILTER (kind = 'ADDED') AS added, count(*) FILTER (kind = 'MODIFIED') AS modified, count(*) FILTER (kind = 'DELETED') AS deleted FROM deltas GROUP BY doc_id",
    "incremental_update": f"WITH {_REV} SELECT doc_id, new_index AS chunk_index, doc_id || '::chunk::' || new_index AS chunk_id, md5(new_text) AS text_md5 FROM deltas WHERE kind <> 'DELETED'",
    "delete_documents": f"""WITH units AS (SELECT CAST(doc_id AS VARCHAR) AS unit_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), {_POSTINGS}
        SELECT term, df, round({_IDF}, 6) AS idf FROM (SELECT term, count(*) AS df FROM postings GROUP BY term) CROSS JOIN corpus""",
    "ingest_report": f"""{_PARAGRAPHS} SELECT doc_id, CAST(len(c) AS BIGINT) AS chunks, 'indexed' AS status FROM chunks JOIN documents USING (doc_id) WHERE {_strip('text')} <> ''""",
    "rate_limit": f"""WITH RECURSIVE a AS (
          SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
        ), r AS (
          SELECT user_id, event_id, n, s, true AS admitted, 1::DOUBLE AS level FROM a WHERE n = 1
          UNION ALL
          SELECT a.user_id, a.event_id, a.n, a.s, l.left_ + 1 <= 3, CASE WHEN l.left_ + 1 <= 3 THEN l.left_ + 1 ELSE l.left_ END
          FROM r JOIN a ON a.user_id = r.user_id AND a.n = r.n + 1, LATERAL (SELECT greatest(0, r.level - (a.s - r.s) * {LEAK!r}::DOUBLE) AS left_) l
        ) SELECT user_id, event_id, admitted FROM r""",
    "rate_limit_waiting": f"""WITH RECURSIVE a AS (
          SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
        ), r AS (
          SELECT user_id, event_id, n, s AS served, s AS free, s AS last_, 1::DOUBLE AS level FROM a WHERE n = 1
          UNION ALL
          SELECT user_id, event_id, n, CASE WHEN ok THEN served END, CASE WHEN ok THEN served ELSE free END,
                 CASE WHEN ok THEN served WHEN late THEN last_ ELSE begun END, CASE WHEN ok AND served > begun THEN 3 WHEN ok THEN left_ + 1 WHEN late THEN level ELSE left_ END
          FROM (
            SELECT *, begun - s > {WAIT} AS late, greatest(begun, begun + (left_ + 1 - 3) / {LEAK!r}::DOUBLE) AS served, NOT late AND served - s <= {WAIT} AS ok FROM (
              SELECT a.user_id, a.event_id, a.n, a.s, r.free, r.last_, r.level, greatest(a.s, r.free) AS begun, greatest(0, r.level - greatest(0, greatest(a.s, r.free) - r.last_) * {LEAK!r}::DOUBLE) AS left_
              FROM r JOIN a ON a.user_id = r.user_id AND a.n = r.n + 1))
        ) SELECT user_id, event_id, served IS NOT NULL AS admitted, round(served, 3) AS admitted_at FROM r""",
    "answer_queries": "SELECT item_id AS query_id, 'No model is connected. Question: ' || text AS answer, 'echo' AS model_used, false AS cached, CAST(5 AS BIGINT) AS n_sources FROM benchmark",
    "answer_cached": f"""WITH {_PARAGRAPHS.replace('replace(text, chr(10), chr(10) || chr(10))', 'text')[5:]}, units AS (SELECT chunk_id AS unit_id, chunk_text AS text FROM named), {_ASKED}, {_keyword(3)}, found AS (
          SELECT query_id, count(*) AS n FROM keyword GROUP BY ALL)
        SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'kept answer ' || item_id ELSE 'No model is connected. Question: ' || text END AS answer,
          CASE WHEN item_id % 2 = 0 THEN 'kept-model' ELSE 'echo' END AS model_used, item_id % 2 = 0 AS cached, CASE WHEN item_id % 2 = 0 THEN 1 ELSE coalesce(n, 0) END AS n_sources
        FROM benchmark LEFT JOIN found ON item_id = query_id""",
    "service_health": "SELECT 'ok' AS status, count(*) AS docs_indexed, CAST(0 AS BIGINT) AS cache_size FROM documents",
}
