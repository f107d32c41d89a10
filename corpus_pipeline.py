"""A corpus through five stages: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage reads what the one before kept, written as Parquet. All but the last return
the columns of documents. Stages judge rows, not ids: null and repeated ids are told
apart by their texts. Empty tables give empty results, texts are read to their end
however long they are, and further columns pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvanta.llm.columns import fresh_name
from corvanta.llm.decontam import remove_contaminated
from corvanta.llm.mixing import mixed_rows
from corvanta.llm.ngram_join import ngram_classes
from corvanta.llm.sharding import shard_groups
from corvanta.llm.toxicity import score_toxicity, toxic_labels, train
from corvanta.sources.tables import read_table
from corvanta.workspace import Workspace

#: Documents that score this or more are rejected.
TOXIC_FROM = 0.3
SHARDS = 8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the model rejects. Trained on all labels of ``docs``.

    Null and empty texts are scored like any text without words, and stay. Repeated rows
    are judged each, alike. Without labels nothing is rejected.
    """
    model = train(docs, toxic_labels(read_table(spark, sf_dir, "labels"), held_out=None))
    prefix = "toxicity"
    while any(c.lower().startswith(prefix + "_") for c in docs.columns):
        prefix += "_"
    scored = score_toxicity(docs, model, keep=docs.columns, prefix=prefix)
    return scored.where(F.col(f"{prefix}_score") < TOXIC_FROM).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest doc_id.

    Where rows of the group share this id, the one with the smallest hash of its text;
    of equal texts the first in order of the other columns. Rows without an id come
    last. Texts without words are like nothing: all their rows stay.
    """
    ws = Workspace(spark, "near-duplicates")
    found = ws.save(ngram_classes(docs, k=5, percent=80), "classes")
    each = found.groupBy("class", "doc_id", "content").agg(F.count(F.lit(1)).alias("rows"))
    least = F.min_by(F.struct("doc_id", "content", "rows"), F.struct(F.col("doc_id").isNull(), "doc_id", "content"))
    best = each.where("class is not null").groupBy("class").agg(least.alias("b")).select("b.*")
    blank = each.where("class is null").select("doc_id", "content", F.lit(1).cast("long").alias("rows"))
    k_id, k_content, rows = (fresh_name(docs.columns, n) for n in ("k_id", "k_content", "k_rows"))
    kept = ws.save(best.union(blank).toDF(k_id, k_content, rows), "kept")
    of_row = docs["doc_id"].eqNullSafe(F.col(k_id)) & (F.xxhash64(docs["text"]) == F.col(k_content))
    once = docs.join(kept.where(F.col(rows) == 1), of_row, "left_semi")
    return once.unionByName(_one_each(docs.join(kept.where(F.col(rows) > 1), of_row, "left_semi")))


def _one_each(rows: DataFrame) -> DataFrame:
    """The first row of each id and text in order of the other columns."""
    place = fresh_name(rows.columns, "place")
    order = W.partitionBy("doc_id", F.xxhash64("text")).orderBy(*[F.col(c).asc_nulls_last() for c in rows.columns if c not in ("doc_id", "text")], F.lit(1))
    return rows.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*rows.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with the benchmark.

    Null and empty texts overlap with nothing and stay; repeated rows are judged each.
    """
    return remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"), least_words=13, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's budget takes it, and one of a source cut where the budget ends.

    Texts without words are not taken. Equal rows are exchangeable.
    """
    is_cut = fresh_name(docs.columns, "is_cut")
    mixed = mixed_rows(docs, weights=(5, 2, 1), max_epochs=3, cut_name=is_cut)
    return mixed.withColumn("n_chars", F.when(F.col(is_cut), F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot for each row of the mix.

    Rows with equal texts share a shard; null texts are one group, empty ones another.
    """
    return shard_groups(docs, shards=SHARDS)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The first and the last stage are no SQL: a trained model, and a sequential packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
