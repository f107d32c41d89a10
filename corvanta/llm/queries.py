"""Queries opN_<name> over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvanta.llm.compact_windows import repeated_passages
from corvanta.llm.decontam import find_overlaps
from corvanta.llm.licenses import scan_licenses
from corvanta.llm.mixing import mix_sources
from corvanta.llm.ngram_join import ngram_components
from corvanta.llm.secrets import invented_findings, scan_secrets, train_forest
from corvanta.llm.sharding import shard_groups
from corvanta.llm.toxicity import is_held_out, score_toxicity, toxic_labels, train
from corvanta.llm.vector_graph import near_vectors
from corvanta.llm.warczip import read_packages, write_packages
from corvanta.sources.tables import read_table
from corvanta.workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]


#: A document is predicted toxic from this score on.
TOXIC_FROM = 0.3


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    model = train(documents, toxic_labels(read_table(spark, folder, "labels"), held_out=2))
    scored = score_toxicity(documents, model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity_score").alias("score"),
        (F.col("toxicity_score") >= TOXIC_FROM).cast("int").alias("predicted"),
        F.size("toxicity_sentences").cast("long").alias("n_sentences"),
        F.transform("toxicity_sentences", lambda x: F.struct(x["start"], x["end"])).alias("sentences"),
    )


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_sources(read_table(spark, folder, "documents"), weights=(5, 2, 1), max_epochs=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_vector_graph(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(read_table(spark, folder, "embeddings"), least=0.95).select("vec_id", "n_links", "component_id", "kept")


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return find_overlaps(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"), least_words=13, percent=80)


def op5_license_digests(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(read_table(spark, folder, "documents"))


def op6_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(read_table(spark, folder, "documents"), least_words=50, percent=80)


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_components(read_table(spark, folder, "documents"), k=5, percent=80)


def op8_warc_packages(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    packages = write_packages(pages, Workspace(spark, "packages").path, package_bytes=32 << 20, digest_from=1000)
    return read_packages(packages, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    model = train_forest(invented_findings(spark))
    found = scan_secrets(read_table(spark, folder, "documents"), model, path="source")
    return found.select("doc_id", "place", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").cast("long").alias("length"), "score", "is_secret")


def op10_shard_groups(spark: SparkSession, folder: str) -> DataFrame:
    packed = shard_groups(read_table(spark, folder, "documents"), shards=8)
    return packed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_mix_sources": op2_mix_sources,
    "op3_vector_graph": op3_vector_graph,
    "op4_decontamination": op4_decontamination,
    "op5_license_digests": op5_license_digests,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_ngram_join": op7_ngram_join,
    "op8_warc_packages": op8_warc_packages,
    "op9_secret_forest": op9_secret_forest,
    "op10_shard_groups": op10_shard_groups,
}
