"""Queries by name; each takes (spark, folder of the tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvanta.functions import keys, scoring, text
from corvanta.operators import answers, cache, index, ratelimit, revisions, ring, search, store
from corvanta.plans import fixtures
from corvanta.sources.tables import read_table
from corvanta.workspace import Workspace, is_kept

Query = Callable[[SparkSession, str], DataFrame]
SINGLE = "The thing and that of trash in zqxjk"
UNSEEN = "zqxjk the wvutq with qqqqq"
NODES = ["node-0", "node-1", "node-2", "node-3"]
TTL = 86_400.0
LEAK = 1 / 21_600
HALF_LIFE = 604_800.0
#: Seconds that a request may wait, and nodes of a large ring.
WAIT = 10_800.0
MANY_NODES = 1000

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


_KEPT: dict[tuple, str] = {}


def kept_index(spark: SparkSession, folder: str, name: str, units: DataFrame) -> index.Index:
    """The index of a corpus, built by the first query that needs it and kept for the session's later ones.

    It is built anew if the documents were written since, or if it was released.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/documents.parquet")
    changed = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    key = (spark.sparkContext.applicationId, folder, name, changed)
    if not is_kept(_KEPT.get(key)):
        ws = Workspace(spark, f"index-{name}")
        index.write_index(units, ws.path)
        _KEPT[key] = ws.path
    return index.read_index(spark, _KEPT[key])


def _documents_index(spark, folder):
    return kept_index(spark, folder, "documents", fixtures.units(spark, folder))


def _hybrid_index(spark, folder):
    return kept_index(spark, folder, "hybrid", fixtures.hybrid_units(spark, folder))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query
def tokenize_docs(spark, folder):
    tokens = text.tokenize(F.col("text"))
    return read_table(spark, folder, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5"))


def _chunks(found):
    return found.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id", F.length("chunk_text").cast("long").alias("n_chars"), F.md5("chunk_text").alias("text_md5"))


@query
def chunk_paragraphs(spark, folder):
    return _chunks(index.chunk_documents(fixtures.paragraphs(spark, folder)))


@query
def chunk_headers(spark, folder):
    return _chunks(index.chunk_documents(fixtures.transcripts(spark, folder)))


@query
def chunk_ids(spark, folder):
    return index.chunk_documents(fixtures.paragraphs(spark, folder)).select("chunk_id", text.document_of(F.col("chunk_id")).alias("parent"))


@query
def postings(spark, folder):
    return index.postings(fixtures.units(spark, folder))


@query
def term_df_idf(spark, folder):
    units = fixtures.units(spark, folder)
    return rounded(index.term_statistics(index.postings(units), index.corpus_size(units)), "idf")


@query
def doc_tf_weights(spark, folder):
    return rounded(index.weighted(index.postings(fixtures.units(spark, folder))).select("term", "unit_id", "weight"), "weight")


@query
def index_build(spark, folder):
    ws = Workspace(spark, "index-build")
    index.write_index(fixtures.units(spark, folder), ws.path)
    return index.read_index(spark, ws.path).terms


@query
def keyword_search_texts(spark, folder):
    return rounded(search.keyword_search(fixtures.units(spark, folder), fixtures.one_query(spark, SINGLE), 10), "score")


@query
def keyword_search(spark, folder):
    return rounded(search.search_index(_documents_index(spark, folder), fixtures.one_query(spark, SINGLE), 10), "score")


@query
def keyword_unseen_terms(spark, folder):
    return rounded(search.keyword_search(fixtures.units(spark, folder), fixtures.one_query(spark, UNSEEN), 10), "score")


@query
def keyword_search_batch(spark, folder):
    return rounded(search.search_index(_documents_index(spark, folder), fixtures.asked(spark, folder), 10), "score")


@query
def vector_search(spark, folder):
    v = fixtures.vectors(spark, folder)
    return rounded(search.vector_search(v, v.where("unit_id = 0").select(F.col("unit_id").alias("query_id"), "vector"), 10), "score")


@query
def vector_search_batch(spark, folder):
    v = fixtures.vectors(spark, folder)
    return rounded(search.vector_search(v, v.where("unit_id % 100 = 0").select(F.col("unit_id").alias("query_id"), "vector"), 10), "score")


@query
def vector_normalize(spark, folder):
    each = fixtures.vectors(spark, folder).select(F.col("unit_id").alias("vec_id"), F.posexplode(scoring.unit(F.col("vector"), 32)).alias("place", "value"))
    return rounded(each.withColumn("place", F.col("place").cast("long")), "value")


@query
def hybrid_search(spark, folder):
    return rounded(search.hybrid_search(fixtures.hybrid_units(spark, folder), fixtures.hybrid_queries(spark, folder), 5, index=_hybrid_index(spark, folder)), "score")


@query
def rrf_fusion(spark, folder):
    units, queries = fixtures.hybrid_units(spark, folder), fixtures.hybrid_queries(spark, folder)
    words = search.search_index(_hybrid_index(spark, folder), queries, 10)
    near = search.vector_search(units.select(F.col("chunk_id").alias("unit_id"), "vector"), queries, 10)
    return rounded(search.rank_fusion(words, near), "rrf")


@query
def compare_modes(spark, folder):
    return rounded(search.compare_modes(fixtures.hybrid_units(spark, folder), fixtures.hybrid_queries(spark, folder), 5, index=_hybrid_index(spark, folder)), "score")


def _hits(spark, folder):
    docs = read_table(spark, folder, "documents")
    chunks = docs.select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("chunk_text"))
    queries = fixtures.asked(spark, folder)
    return answers.hydrate(search.search_index(_documents_index(spark, folder), queries, 5), chunks), queries


@query
def hydrate_hits(spark, folder):
    hits, _ = _hits(spark, folder)
    return rounded(hits.select("query_id", "rank", "doc_id", "score", F.md5("chunk_text").alias("text_md5"), F.lit("keyword").alias("source")), "score")


@query
def build_context(spark, folder):
    return answers.build_context(*_hits(spark, folder)).select("query_id", F.length("context").cast("long").alias("n_chars"), F.md5("context").alias("context_md5"))


@query
def build_prompt(spark, folder):
    hits, queries = _hits(spark, folder)
    prompts = answers.build_prompt(answers.build_context(hits, queries), queries)
    return prompts.select("query_id", F.length("prompt").cast("long").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


@query
def cache_key(spark, folder):
    each = fixtures.asked(spark, folder).select("query_id", "query", F.explode(F.array(*map(F.lit, search.MODES))).alias("mode")).withColumn("top_k", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return each.select("query_id", "mode", F.col("top_k").cast("long").alias("top_k"), keys.cache_key(F.col("query"), F.col("mode"), F.col("top_k")).alias("cache_key"))


@query
def ring_build(spark, folder):
    return ring.build_ring(spark, NODES)


def _keys(spark, folder):
    return fixtures.accesses(spark, folder).select("key").distinct()


@query
def ring_route(spark, folder):
    return ring.route(_keys(spark, folder), ring.build_ring(spark, NODES))


@query
def ring_remove_node(spark, folder):
    full = ring.build_ring(spark, NODES)
    return ring.moved_keys(_keys(spark, folder), full, ring.remove_node(full, NODES[1]))


@query
def ring_add_node(spark, folder):
    return ring.moved_keys(_keys(spark, folder), ring.build_ring(spark, NODES), ring.build_ring(spark, [*NODES, "node-4"]))


@query
def ring_route_large(spark, folder):
    return ring.route(_keys(spark, folder), ring.build_ring(spark, [f"node-{i}" for i in range(MANY_NODES)]))


@query
def ring_nodes(spark, folder):
    return ring.ring_nodes(ring.remove_node(ring.build_ring(spark, NODES), NODES[1]))


@query
def eviction_utility(spark, folder):
    access = fixtures.accesses(spark, folder)
    last = access.agg(F.max("ts").alias("now"))
    by_key = access.groupBy("key").agg(F.count(F.lit(1)).alias("accesses"), F.max("ts").alias("last")).crossJoin(F.broadcast(last))
    idle = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 1e6
    return rounded(by_key.select("key", "accesses", keys.eviction_utility(F.col("accesses"), idle, HALF_LIFE).alias("utility")), "utility")


@query
def ttl_cache_replay(spark, folder):
    return cache.replay_ttl(fixtures.accesses(spark, folder), TTL)


@query
def cache_stats(spark, folder):
    return cache.cache_stats(cache.replay_ttl(fixtures.accesses(spark, folder), TTL))


@query
def lru_cache_replay(spark, folder):
    routed = ring.route(fixtures.accesses(spark, folder), ring.build_ring(spark, NODES))
    return cache.replay_cache(routed, capacity=64, ttl=TTL)


@query
def lru_cache_roomy(spark, folder):
    routed = ring.route(fixtures.accesses(spark, folder), ring.build_ring(spark, NODES))
    return cache.replay_cache(routed, capacity=1_000_000, ttl=TTL).select("node", "seq", "key", "hit")


@query
def key_recency(spark, folder):
    return cache.recency(fixtures.accesses(spark, folder)).withColumn("recency", F.col("recency").cast("long"))


@query
def lru_shard_stats(spark, folder):
    return cache.shard_stats(lru_cache_replay(spark, folder))


@query
def cache_log_replay(spark, folder):
    events = read_table(spark, folder, "events")
    op = F.when(F.col("event_type") == "purchase", "put").when(F.col("event_type") == "error", "delete").otherwise("get")
    # The user is the key, so that one kind of event gets what another puts.
    log = events.select(F.col("event_id").alias("seq"), "ts", op.alias("op"), F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("value"), F.lit(None).cast("double").alias("ttl"))
    return cache.replay_log(ring.route(log, ring.build_ring(spark, NODES)), capacity=16, default_ttl=TTL)


def _entries(spark, folder):
    return fixtures.vectors(spark, folder).select(F.col("unit_id").alias("seq"), F.col("unit_id").alias("entry_id"), F.concat(F.lit("entry "), F.col("unit_id").cast("string")).alias("key"), "vector")


@query
def semantic_fifo(spark, folder):
    return cache.semantic_fifo(_entries(spark, folder)).select("entry_id", "key")


@query
def semantic_lookup(spark, folder):
    return rounded(cache.semantic_lookup(cache.semantic_fifo(_entries(spark, folder)), fixtures.probes(spark, folder)), "similarity")


def _replayed(spark, folder):
    return cache.replay_semantic(fixtures.semantic_log(spark, folder), ttl=3600.0, default_ttl=3600.0)


@query
def semantic_replay(spark, folder):
    return rounded(_replayed(spark, folder).select("scope", "seq", "hit_type", "similarity"), "similarity")


@query
def semantic_stats(spark, folder):
    return cache.semantic_stats(_replayed(spark, folder))


@query
def lcs_length(spark, folder):
    return revisions.lcs_lengths(fixtures.text_pairs(spark, folder))


@query
def char_similarity(spark, folder):
    return rounded(revisions.similarities(fixtures.text_pairs(spark, folder)), "similarity")


@query
def lcs_align(spark, folder):
    found = revisions.diff_texts(fixtures.revisions(spark, folder))
    return found.where("kind = 'UNCHANGED'").select("doc_id", "old_index", "new_index")


@query
def diff_deltas(spark, folder):
    return revisions.diff_texts(fixtures.revisions(spark, folder)).select("doc_id", "kind", "old_index", "new_index", F.md5("old_text").alias("old_md5"), F.md5("new_text").alias("new_md5"))


@query
def diff_moves(spark, folder):
    return revisions.diff_texts(fixtures.moves(spark, folder)).select("doc_id", "kind", "old_index", "new_index", F.md5("old_text").alias("old_md5"), F.md5("new_text").alias("new_md5"))


@query
def diff_all_documents(spark, folder):
    return revisions.diff_texts(fixtures.revisions(spark, folder, distinct=False)).select("doc_id", "kind", "old_index", "new_index", F.md5("old_text").alias("old_md5"), F.md5("new_text").alias("new_md5"))


@query
def diff_summary(spark, folder):
    return revisions.summarize(revisions.diff_texts(fixtures.revisions(spark, folder)))


@query
def incremental_update(spark, folder):
    both = fixtures.revisions(spark, folder)
    before = store.ingest(both.select("doc_id", F.col("old_text").alias("text")))
    after, _ = store.update(before, both.select("doc_id", "new_text"))
    return after.chunks.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id", F.md5("chunk_text").alias("text_md5"))


@query
def delete_documents(spark, folder):
    docs = read_table(spark, folder, "documents")
    chunks = docs.select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("chunk_text"))
    left = store.delete(store.Store(docs.select("doc_id", "text"), chunks), read_table(spark, folder, "labels").where("toxic = 1"))
    return rounded(index.term_statistics(index.postings(left.chunks), index.corpus_size(left.chunks)), "idf")


@query
def ingest_report(spark, folder):
    return store.ingest_report(fixtures.paragraphs(spark, folder))


@query
def rate_limit(spark, folder):
    return ratelimit.rate_limit(read_table(spark, folder, "events"), 3.0, LEAK, "user_id", "event_id").select("user_id", "event_id", "admitted")


@query
def rate_limit_waiting(spark, folder):
    found = ratelimit.rate_limit(read_table(spark, folder, "events"), 3.0, LEAK, "user_id", "event_id", timeout=WAIT)
    waited = F.unix_micros("admitted_ts")
    return found.select("user_id", "event_id", "admitted", F.round(waited / 1e6, 3).alias("admitted_at"))


@query
def service_health(spark, folder):
    docs = read_table(spark, folder, "documents")
    return store.health(store.Store(docs, docs))


def _store(spark, folder):
    """A store of the corpus, kept like an index of it."""
    documents = read_table(spark, folder, "documents").select("doc_id", "text")
    key = (spark.sparkContext.applicationId, folder, "store")
    if key not in _STORES or not is_kept(_STORES[key][1]):
        made = store.ingest(documents)
        ws = Workspace(spark, "index-chunks")
        index.write_index(made.chunks, ws.path)
        _STORES[key] = made, ws.path
    made, path = _STORES[key]
    return made, index.read_index(spark, path)


_STORES: dict[tuple, tuple[store.Store, str]] = {}


@query
def answer_queries(spark, folder):
    kept, words = _store(spark, folder)
    found, _ = store.answer(kept, fixtures.asked(spark, folder), "hybrid", 5, index=words)
    return found.select("query_id", "answer", "model_used", "cached", F.size("sources").cast("long").alias("n_sources"))


@query
def answer_cached(spark, folder):
    kept, words = _store(spark, folder)
    queries = fixtures.asked(spark, folder)
    found, _ = store.answer(kept, queries, "keyword", 3, cache=fixtures.answered(queries, "keyword", 3), index=words)
    return found.select("query_id", "answer", "model_used", "cached", F.size("sources").cast("long").alias("n_sources"))
