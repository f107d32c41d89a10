"""A document store: ingest, update, delete and query, as tables in and tables out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvanta.functions.keys import cache_key
from corvanta.functions.text import chunk_id, chunk_text, is_blank
from corvanta.operators.answers import Generator, build_context, build_prompt, echo, generate, hydrate
from corvanta.operators.cache import semantic_lookup
from corvanta.operators.index import Index, chunk_documents
from corvanta.operators.revisions import LEAST_SIMILARITY, diff_texts, summarize, to_upsert
from corvanta.operators.search import checked_k, checked_mode, search
from corvanta.workspace import Workspace

DIMENSIONS = 128
Embedder = Callable[[list[str]], np.ndarray]


class Store(NamedTuple):
    """documents (doc_id, text) and chunks (doc_id, chunk_index, chunk_id, chunk_text, vector)."""

    documents: DataFrame
    chunks: DataFrame


def hashing_embedder(texts: list[str]) -> np.ndarray:
    """A deterministic stand-in for a model: signed counts of hashed words, at length 1."""
    import re
    import zlib

    places: dict[str, int] = {}

    def place(word: str) -> int:
        """The word's dimension, and beyond all of them if it counts against."""
        h = zlib.crc32(word.encode())
        return places.setdefault(word, h % DIMENSIONS + (0 if h >> 16 & 1 else DIMENSIONS))

    known, at, sizes = places.get, [], []
    for text in texts:
        words = re.findall(r"[a-z0-9]{2,}", text.lower())
        sizes.append(len(words))
        at += [p if (p := known(word)) is not None else place(word) for word in words]
    rows = np.repeat(np.arange(len(texts)) * 2 * DIMENSIONS, sizes)
    counts = np.bincount(rows + np.array(at, dtype=np.int64), minlength=len(texts) * 2 * DIMENSIONS).reshape(len(texts), 2, DIMENSIONS)
    out = (counts[:, 0] - counts[:, 1]).astype(np.float32)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(length > 0, out / np.where(length > 0, length, 1), out)


def embed(rows: DataFrame, text: str, embedder: Embedder = hashing_embedder, dimensions: int = DIMENSIONS) -> DataFrame:
    """``rows`` with column ``vector``: the first ``dimensions`` of a text's embedding at length 1, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(embedder(batch.column(text).to_pylist()), dtype=np.float32)[:, :dimensions] if batch.num_rows else np.zeros((0, dimensions), np.float32)
            length = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.where(length > 0, x / np.where(length > 0, length, 1), x)
            ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])
            own = pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, own], [*batch.schema.names, "vector"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, vector array<float>")


def rejected(documents: DataFrame) -> DataFrame:
    """The rows that an ingest refuses: a blank id or a blank text."""
    return documents.where(is_blank(F.col("doc_id").cast("string")) | is_blank(F.col("text")))


def accepted(documents: DataFrame) -> DataFrame:
    return documents.where(~is_blank(F.col("doc_id").cast("string")) & ~is_blank(F.col("text")))


def ingest(documents: DataFrame, into: Store | None = None, embedder: Embedder = hashing_embedder) -> Store:
    """The store with these documents; one that is there under an id is replaced, with all its chunks.

    Chunks and vectors are written to the shared folder, so that they are made once.
    """
    new = accepted(documents.select("doc_id", "text"))
    chunks = Workspace(documents.sparkSession, "store").save(embed(chunk_documents(new), "chunk_text", embedder), "chunks")
    if into is None:
        return Store(new, chunks)
    kept = delete(into, new.select("doc_id"))
    return Store(kept.documents.unionByName(new), kept.chunks.unionByName(chunks))


def ingest_report(documents: DataFrame) -> DataFrame:
    """(doc_id, chunks, status) of the documents that an ingest takes; one without chunks counts 0."""
    rows = accepted(documents.select("doc_id", "text"))
    return rows.select("doc_id", F.size(chunk_text(F.col("text"))).cast("long").alias("chunks"), F.lit("indexed").alias("status"))


def delete(store: Store, ids: DataFrame) -> Store:
    """The store without the documents of ``ids`` (doc_id), in all its tables."""
    gone = ids.select("doc_id").distinct()
    return Store(store.documents.join(gone, "doc_id", "left_anti"), store.chunks.join(gone, "doc_id", "left_anti"))


def unknown(store: Store, ids: DataFrame) -> DataFrame:
    """The ids that an update or a delete does not find."""
    return ids.select("doc_id").distinct().join(store.documents.select("doc_id"), "doc_id", "left_anti")


def update(store: Store, revisions: DataFrame, embedder: Embedder = hashing_embedder, least: float = LEAST_SIMILARITY) -> tuple[Store, DataFrame]:
    """The store with ``revisions`` (doc_id, new_text) of its documents, and (doc_id, added, modified, deleted).

    Only chunks that were added or modified are embedded; unchanged ones keep their
    vectors under their new ids. Ids that the store lacks change nothing: see ``unknown``.
    """
    both = store.documents.select("doc_id", F.col("text").alias("old_text")).join(revisions.select("doc_id", "new_text"), "doc_id")
    found = Workspace(both.sparkSession, "update").save(diff_texts(both, least), "deltas")
    fresh = embed(to_upsert(found).select("doc_id", F.col("new_index").alias("chunk_index"), F.col("new_text").alias("chunk_text")), "chunk_text", embedder)
    old = store.chunks.select("doc_id", F.col("chunk_index").cast("long").alias("old_index"), "vector")
    kept = found.where("kind = 'UNCHANGED'").select("doc_id", "old_index", "new_index", "new_text").join(old, ["doc_id", "old_index"])
    kept = kept.select("doc_id", F.col("new_index").alias("chunk_index"), F.col("new_text").alias("chunk_text"), "vector")
    chunks = fresh.unionByName(kept).select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "chunk_text", "vector")
    rest = delete(store, both)
    return Store(rest.documents.unionByName(both.select("doc_id", F.col("new_text").alias("text"))), rest.chunks.unionByName(chunks)), summarize(found)


def health(store: Store, cached: DataFrame | None = None) -> DataFrame:
    """One row: status, docs_indexed, cache_size."""
    entries = F.lit(0).cast("long") if cached is None else F.lit(cached.count()).cast("long")
    return store.documents.agg(F.count(F.lit(1)).alias("docs_indexed")).select(F.lit("ok").alias("status"), "docs_indexed", entries.alias("cache_size"))


#: What an answer cites, and what a cache keeps of it.
SOURCES = "array<struct<doc_id:string,chunk_text:string,score:double,source:string>>"


def answer(
    store: Store,
    queries: DataFrame,
    mode: str = "hybrid",
    top_k: int = 5,
    cache: DataFrame | None = None,
    models: dict[str, Generator] | None = None,
    embedder: Embedder = hashing_embedder,
    index: Index | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Answers to ``queries`` (query_id, query), and the cache entries that they add.

    ``cache`` (seq, entry_id, key, vector, answer, model_used, sources) is probed first,
    by key, then by similarity; without one, nothing is read or kept. A hit gives what
    was kept; its model is marked with the similarity if the key was another one.
    Returns (query_id, answer, model_used, cached, sources) and (key, vector, answer,
    model_used, sources) of what was generated. With a kept ``index`` of the chunks,
    keywords are not sought in their texts. Blank queries get no answer.
    """
    mode, top_k = checked_mode(mode), checked_k(top_k)
    ws = Workspace(queries.sparkSession, "answers")
    asked = embed(queries.where(~is_blank(F.col("query"))).select("query_id", "query"), "query", embedder)
    asked = ws.save(asked.withColumn("key", cache_key(F.col("query"), F.lit(mode), F.lit(top_k))), "asked")
    open_, hits = asked, None
    if cache is not None:
        probes = asked.select(F.col("query_id").alias("probe_id"), "key", "vector")
        found = semantic_lookup(cache, probes).where("hit_type <> 'miss'").join(cache.select("entry_id", "answer", "model_used", "sources"), "entry_id")
        near = F.concat("model_used", F.format_string(" (semantic: %.0f%%)", F.col("similarity") * 100))
        tag = F.when(F.col("hit_type") == "exact", F.col("model_used")).otherwise(near)
        hits = ws.save(found.select(F.col("probe_id").alias("query_id"), "answer", tag.alias("model_used"), F.lit(True).alias("cached"), F.col("sources").cast(SOURCES).alias("sources")), "hits")
        open_ = asked.join(hits.select("query_id"), "query_id", "left_anti")
    ranked = ws.save(hydrate(search(store.chunks, open_, mode, top_k, index=index), store.chunks), "ranked")
    texts = generate(build_prompt(build_context(ranked, open_), open_), models or {"echo": echo})
    source = F.struct("doc_id", "chunk_text", "score", F.lit(mode).alias("source"))
    sources = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", source.alias("hit")))).alias("s"))
    sources = sources.select("query_id", F.transform("s", lambda x: x["hit"]).cast(SOURCES).alias("sources"))
    cited = F.coalesce("sources", F.array().cast(SOURCES)).alias("sources")
    # A generator is asked once: its answers are kept before they are read twice.
    made = ws.save(texts.join(sources, "query_id", "left").select("query_id", "answer", "model_used", F.lit(False).alias("cached"), cited), "made")
    if cache is None:
        return made, None
    return made.unionByName(hits), made.join(asked, "query_id").select("key", "vector", "answer", "model_used", "sources")
