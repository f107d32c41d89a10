"""Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from corvanta.functions.text import document_of, tokenize
from corvanta.operators.index import Index, chunk_documents, postings
from corvanta.operators.ratelimit import Bucket


def stream_chunks(documents: DataFrame, path: str, checkpoint: str, order: str = "text") -> StreamingQuery:
    """Keep a Parquet table of chunks, one folder for each batch, from a stream of documents (doc_id, text).

    Of a document's revisions in one batch the one with the largest ``order`` counts, a
    sequence number or a time; revisions of equal order go by their text. A batch that
    is run again overwrites its own folder, so each is written once. ``current_chunks``
    reads the latest revision of each document.
    """

    def merge(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("doc_id").agg(F.max_by("text", F.struct(order, F.coalesce("text", F.lit("")))).alias("text"))
        rows = chunk_documents(last).withColumn("batch", F.lit(number).cast("long"))
        seen = last.select("doc_id", F.lit(number).cast("long").alias("batch"))
        rows.write.mode("overwrite").parquet(f"{path}/chunks/b={number}")
        seen.write.mode("overwrite").parquet(f"{path}/documents/b={number}")

    return documents.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_chunks(spark, path: str) -> DataFrame:
    """The chunks of each document's latest batch."""
    latest = spark.read.parquet(f"{path}/documents").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{path}/chunks").join(latest, ["doc_id", "batch"]).select("doc_id", "chunk_index", "chunk_id", "chunk_text")


def stream_rate_limit(requests: DataFrame, capacity: float, leak_rate: float, key: str = "user_id", amount: float = 1.0) -> DataFrame:
    """(key, event_id, admitted) of a stream (key, event_id, ts). A bucket's level is state of its key."""
    Bucket(capacity, leak_rate)

    def admit(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket = Bucket(capacity, leak_rate)
        if state.exists:
            bucket.level, bucket.last = state.get
        rows = pd.concat(list(parts)).sort_values(["micros", "event_id"], kind="stable")
        admitted = [bucket.admit(m / 1e6, amount) for m in rows["micros"]]
        state.update((bucket.level, bucket.last))
        yield pd.DataFrame({key: group[0], "event_id": rows["event_id"], "admitted": admitted})

    kinds = [requests.schema[c].dataType.simpleString() for c in (key, "event_id")]
    rows = requests.select(key, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return rows.groupBy(key).applyInPandasWithState(
        admit, f"{key} {kinds[0]}, event_id {kinds[1]}, admitted boolean", "level double, last double", "append", GroupStateTimeout.NoTimeout
    )


def stream_ttl_cache(access: DataFrame, ttl: float) -> DataFrame:
    """(key, seq, hit) of a stream (key, seq, ts): get, and put on a miss; the expiry is state of its key."""
    micros = round(ttl * 1e6)

    def replay(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expires = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["micros", "seq"], kind="stable")
        hits = []
        for now in rows["micros"]:
            hit = expires is not None and (ttl <= 0 or now <= expires)
            if not hit:
                expires = int(now) + micros
            hits.append(hit)
        state.update((expires,))
        yield pd.DataFrame({"key": group[0], "seq": rows["seq"], "hit": hits})

    rows = access.select("key", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return rows.groupBy("key").applyInPandasWithState(replay, "key string, seq long, hit boolean", "expires long", "append", GroupStateTimeout.NoTimeout)


def stream_index(documents: DataFrame, path: str, checkpoint: str, order: str = "text") -> StreamingQuery:
    """Keep postings from a stream of documents (doc_id, text), a folder for each batch, as ``stream_chunks`` keeps chunks.

    A batch's postings are sorted by term. ``current_index`` leaves out those of earlier
    revisions, so a changed document is removed and added by writing it alone.
    """

    def merge(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("doc_id").agg(F.max_by("text", F.struct(order, F.coalesce("text", F.lit("")))).alias("text"))
        chunks = chunk_documents(last)
        found = postings(chunks).withColumns({"doc_id": document_of(F.col("unit_id")), "batch": F.lit(number).cast("long")})
        found.sortWithinPartitions("term", "unit_id").write.mode("overwrite").parquet(f"{path}/postings/b={number}")
        sizes = chunks.groupBy("doc_id").agg(F.count_if(F.size(tokenize(F.col("chunk_text"))) > 0).alias("units"))
        seen = last.select("doc_id").join(sizes, "doc_id", "left").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("units", F.lit(0).cast("long")).alias("units"), F.lit(number).cast("long").alias("batch"))
        seen.write.mode("overwrite").parquet(f"{path}/documents/b={number}")

    return documents.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_index(spark, path: str) -> Index:
    """The index of each document's latest batch, for ``search_index``. Documents without text are as if deleted."""
    seen = spark.read.parquet(f"{path}/documents")
    latest = seen.groupBy("doc_id").agg(F.max("batch").alias("batch"), F.max_by("units", "batch").alias("units"))
    kept = spark.read.parquet(f"{path}/postings").join(latest.select("doc_id", "batch"), ["doc_id", "batch"]).select("term", "unit_id", "tf")
    terms = kept.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return Index(kept, terms, latest.agg(F.coalesce(F.sum("units"), F.lit(0)).alias("n_units")))
