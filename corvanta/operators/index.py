"""Chunks, postings and corpus statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvanta.functions.scoring import rarity, term_weight
from corvanta.functions.text import TOKEN, chunk_id, chunk_text, tokens_of
from corvanta.workspace import small_enough


def chunk_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chunk_index, chunk_id, chunk_text) of each chunk."""
    parts = documents.select(F.col(doc_id).alias("doc_id"), F.posexplode(chunk_text(F.col(text))).alias("chunk_index", "chunk_text"))
    return parts.select("doc_id", "chunk_index", chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "chunk_text")


#: Postings that a task passes on at once, and those of a segment.
PASSED = 1 << 18
SEGMENT = 1 << 20


def are_repeated(units: DataFrame, unit_id: str) -> bool:
    """Whether two rows may have one id. Only ids are read, by their hashes."""
    ids = units.groupBy(F.xxhash64(unit_id).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return not ids.where("n > 1").isEmpty()


def _counts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, ids, term, unit, tf): numbers of terms and units and how often they meet, in blocks of about ``most`` such rows."""
    names: dict[bytes, int] = {}
    ids, term, sizes, tf = [], [], [], []

    def block() -> tuple[list, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        return list(names), pa.concat_arrays(ids), np.array(term, dtype=np.int64), np.repeat(np.arange(len(sizes)), sizes), np.array(tf, dtype=np.int32)

    for batch in batches:
        kind = pa.large_binary() if pa.types.is_large_string(batch.column("text").type) else pa.binary()
        own = batch.column("unit_id")
        taken: list[int] = []
        for row, text in enumerate(batch.column("text").cast(kind)):
            counts = Counter(tokens_of(text.as_py() or b""))
            if not counts:
                continue
            term += [names.setdefault(x, len(names)) for x in counts]
            tf += counts.values()
            sizes.append(len(counts))
            taken.append(row)
            if len(term) >= most:
                ids.append(own.take(pa.array(taken)))
                yield block()
                names.clear()
                taken = []
                for x in (ids, term, sizes, tf):
                    x.clear()
        if taken:
            ids.append(own.take(pa.array(taken)))
    if ids:
        yield block()


def _texts(units: DataFrame, unit_id: str, text: str) -> tuple[DataFrame, str]:
    rows = units.select(F.col(unit_id).alias("unit_id"), F.col(text).cast("string").alias("text"))
    return rows, rows.schema["unit_id"].dataType.simpleString()


def postings(units: DataFrame, unit_id: str = "chunk_id", text: str = "chunk_text", terms: DataFrame | None = None) -> DataFrame:
    """(term, unit_id, tf): how often each unit has each term.

    Terms are counted text by text, so that nothing is shuffled unless rows share an id.
    With ``terms`` (term), only those: the others are dropped before anything is
    shuffled, if the terms are few enough to be sent to all tasks.
    """
    rows, kind = _texts(units, unit_id, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, ids, term, unit, tf in _counts(batches, PASSED):
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(term)), ids.take(pa.array(unit)), pa.array(tf.astype(np.int64))], ["term", "unit_id", "tf"])

    found = rows.mapInArrow(count, f"term string, unit_id {kind}, tf long")
    if terms is not None:
        wanted = terms.select("term").distinct()
        found = found.join(F.broadcast(wanted) if small_enough(wanted) else wanted, "term")
    return found.groupBy("term", "unit_id").agg(F.sum("tf").alias("tf")) if are_repeated(units, unit_id) else found


def corpus_size(units: DataFrame, unit_id: str = "chunk_id", text: str = "chunk_text") -> DataFrame:
    """One row (n_units): the units that have a token. A text is read up to its first one."""
    return units.select(F.lower(F.col(text)).rlike(TOKEN).alias("has")).agg(F.count_if("has").alias("n_units"))


class Index(NamedTuple):
    """postings (term, unit_id, tf), terms (term, df) in order of term, and corpus (n_units), a single row.

    ``segments``, of an index whose units have ids of their own, hold the postings of some
    units each, by term: (segment, term, n, places, tfs). Places number a segment's units
    in order of their ids, which are in a row of their own without a term.
    """

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    segments: DataFrame | None = None


def segments_of(units: DataFrame, unit_id: str = "chunk_id", text: str = "chunk_text") -> DataFrame:
    """(segment, term, n, places, tfs, ids) of units of distinct ids, as ``Index`` has them; nothing is shuffled."""
    rows, kind = _texts(units, unit_id, text)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, (names, ids, term, unit, tf) in enumerate(_counts(batches, SEGMENT)):
            order = np.asarray(pc.sort_indices(ids, null_placement="at_start")).astype(np.int64)
            place, rank = np.empty(len(order), np.int32), np.empty(len(names), np.int64)
            place[order] = np.arange(len(order), dtype=np.int32)
            at = sorted(range(len(names)), key=names.__getitem__)
            rank[at] = np.arange(len(at))
            sort = np.lexsort((place[unit], rank[term]))
            n = np.bincount(rank[term], minlength=len(names))
            ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[sort])) for x in (place[unit], tf)]
            own = ids.take(pa.array(order))
            none, whole = pa.nulls(len(names), pa.list_(own.type)), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            columns = ["segment", "term", "n", "places", "tfs", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array([task | number] * len(names)), pa.array([names[i] for i in at], pa.string()), pa.array(n), *lists, none], columns)
            empty = [pa.nulls(1, x.type) for x in lists]
            yield pa.RecordBatch.from_arrays([pa.array([task | number]), pa.nulls(1, pa.string()), pa.array([len(own)]), *empty, whole], columns)

    return rows.mapInArrow(pack, f"segment long, term string, n long, places array<int>, tfs array<int>, ids array<{kind}>")


def segment_units(segments: DataFrame) -> DataFrame:
    """(segment, place, unit_id) of segments."""
    return segments.where("term is null").select("segment", F.posexplode("ids").alias("place", "unit_id"))


def write_index(units: DataFrame, path: str, unit_id: str = "chunk_id", text: str = "chunk_text") -> None:
    """Keep the postings of ``units`` under ``path``: in segments, or where rows share an id, sorted by term."""
    spark = units.sparkSession
    if are_repeated(units, unit_id):
        found = postings(units, unit_id, text)
        found.repartitionByRange("term").sortWithinPartitions("term", "unit_id").write.mode("overwrite").parquet(f"{path}/postings")
        terms = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        size = corpus_size(units, unit_id, text)
    else:
        segments_of(units, unit_id, text).write.mode("overwrite").parquet(f"{path}/segments")
        kept = spark.read.parquet(f"{path}/segments")
        terms = kept.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
        size = kept.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_units"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    size.write.mode("overwrite").parquet(f"{path}/corpus")


def read_index(spark: SparkSession, path: str) -> Index:
    """The index that ``write_index`` keeps."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/segments")
    terms, corpus = (spark.read.parquet(f"{path}/{table}") for table in ("terms", "corpus"))
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return Index(spark.read.parquet(f"{path}/postings"), terms, corpus)
    segments = spark.read.parquet(f"{path}/segments")
    each = segments.where("term is not null").select("segment", "term", F.explode(F.arrays_zip("places", "tfs")).alias("p"))
    each = each.select("segment", "term", F.col("p.places").alias("place"), F.col("p.tfs").cast("long").alias("tf"))
    return Index(each.join(segment_units(segments), ["segment", "place"]).select("term", "unit_id", "tf"), terms, corpus, segments)


def term_statistics(index: DataFrame, size: DataFrame) -> DataFrame:
    """(term, df, idf) of postings ``index`` and corpus ``size``, a single row."""
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(size)).select("term", "df", rarity(F.col("n_units"), F.col("df")).alias("idf"))


def weighted(index: DataFrame) -> DataFrame:
    """Postings with the sublinear weight of their counts."""
    return index.withColumn("weight", term_weight(F.col("tf")))
