"""Tables derived from the driver's, by rules that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvanta.functions.keys import cache_key
from corvanta.functions.text import strip
from corvanta.operators.store import embed
from corvanta.sources.tables import read_table


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def units(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_id, chunk_text): each document as one unit."""
    return read_table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("chunk_text"))


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, query): every benchmark item as a query."""
    return read_table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def one_query(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "query_id long, query string")


def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a blank line for each line end."""
    return read_table(spark, folder, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """A conversation as a text with a header for each turn."""
    turn = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), "text")
    turns = read_table(spark, folder, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", turn.alias("t")))).alias("turns"))
    return turns.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("turns", lambda x: x["t"]), "\n").alias("text"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, lines): the stripped lines of documents, without blank ones."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), strip), lambda x: x != "")
    # Exploded from an array of one, they are not made anew for each condition on them.
    return read_table(spark, folder, "documents").select("doc_id", F.explode(F.array(lines)).alias("lines"))


def _are_distinct(*columns: str):
    both = F.concat(*columns)
    return (F.size("lines") >= 3) & (F.size(both) == F.size(F.array_distinct(both)))


def moves(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, old_text, new_text): documents of which some lines are put in capitals, and some moved to the end.

    Of documents of distinct lines, so that no line could be aligned with two.
    """
    capitals = F.transform("lines", lambda x: F.translate(x, LETTERS, LETTERS.upper()))
    rows = _lines(spark, folder).withColumn("capitals", F.transform(F.filter(F.zip_with("lines", capitals, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"] != p["y"]), lambda p: p["y"]))
    rows = rows.where(_are_distinct("lines", "capitals"))
    moved = lambda i: (i % 6 == 3) & (i <= F.size("lines") - 4)
    stay = F.transform("lines", lambda x, i: F.when(moved(i), F.array().cast("array<string>")).when(i % 6 == 1, F.array(F.translate(x, LETTERS, LETTERS.upper()))).otherwise(F.array(x)))
    gone = F.filter(F.transform("lines", lambda x, i: F.when(moved(i), x)), lambda x: x.isNotNull())
    return rows.select("doc_id", F.array_join("lines", "\n\n").alias("old_text"), F.array_join(F.concat(F.flatten(stay), gone), "\n\n").alias("new_text"))


def revisions(spark: SparkSession, folder: str, distinct: bool = True) -> DataFrame:
    """(doc_id, old_text, new_text): documents of which some lines are changed, dropped or added; those of ``distinct`` lines or all."""
    rows = _lines(spark, folder)
    rows = rows.where(_are_distinct("lines")) if distinct else rows

    def changed(line, i):
        inserted = F.concat(F.lit("inserted "), F.col("doc_id").cast("string"), F.lit(" "), i.cast("string"))
        return (
            F.when(i % 6 == 1, F.array(F.concat(line, F.lit(" rev"))))
            .when(i % 6 == 3, F.array().cast("array<string>"))
            .when(i % 6 == 5, F.array(line, inserted))
            .otherwise(F.array(line))
        )

    return rows.select("doc_id", F.array_join("lines", "\n\n").alias("old_text"), F.array_join(F.flatten(F.transform("lines", changed)), "\n\n").alias("new_text"))


def text_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(id, a, b): each benchmark item with the next."""
    items = read_table(spark, folder, "benchmark")
    following = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("b"))
    return items.join(following, "item_id").select(F.col("item_id").alias("id"), F.col("text").alias("a"), "b")


def accesses(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, ts, key): events as reads of a cache."""
    key = F.concat("event_type", F.lit(":"), F.col("user_id").cast("string"))
    return read_table(spark, folder, "events").select(F.col("event_id").alias("seq"), "ts", key.alias("key"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vector"))


def probes(spark: SparkSession, folder: str) -> DataFrame:
    """(probe_id, key, vector): vectors with ids divisible by 100, blended with the next vector."""
    v = vectors(spark, folder)
    following = v.select((F.col("unit_id") - 1).alias("unit_id"), F.col("vector").alias("next"))
    near = F.col("unit_id") % 200 == 0
    one, two = F.when(near, 0.95).otherwise(0.5), F.when(near, 0.2).otherwise(0.5)
    blend = F.zip_with(F.col("vector").cast("array<double>"), F.col("next").cast("array<double>"), lambda x, y: one * x + two * y)
    rows = v.where(F.col("unit_id") % 100 == 0).join(following, "unit_id")
    return rows.select(F.col("unit_id").alias("probe_id"), F.concat(F.lit("probe "), F.col("unit_id").cast("string")).alias("key"), blend.alias("vector"))


def semantic_log(spark: SparkSession, folder: str) -> DataFrame:
    """(scope, seq, ts, key, vector): each vector asks, and then something like it.

    The second one has the same key for every third vector; else it leans to the vector,
    or lies halfway to the next one.
    """
    v = vectors(spark, folder).select("unit_id", F.col("vector").cast("array<double>").alias("vector"))
    following = v.select((F.col("unit_id") - 1).alias("unit_id"), F.col("vector").alias("next"))
    both = v.join(following, "unit_id")
    one, two = F.when(F.col("unit_id") % 3 == 1, 0.95).otherwise(0.5), F.when(F.col("unit_id") % 3 == 1, 0.2).otherwise(0.5)
    blend = F.zip_with("vector", "next", lambda x, y: one * x + two * y)
    key = F.concat(F.lit("entry "), F.col("unit_id").cast("string"))
    asks = F.array(
        F.struct((2 * F.col("unit_id")).alias("seq"), key.alias("key"), F.col("vector")),
        F.struct((2 * F.col("unit_id") + 1).alias("seq"), F.when(F.col("unit_id") % 3 == 0, key).otherwise(F.concat(key, F.lit(" again"))).alias("key"), blend.alias("vector")),
    )
    each = both.select(F.explode(asks).alias("a")).select("a.*")
    return each.select(F.lit("all").alias("scope"), "seq", F.timestamp_seconds("seq").alias("ts"), "key", "vector")


def answered(queries: DataFrame, mode: str, top_k: int) -> DataFrame:
    """Cache entries for the queries of even ids."""
    rows = embed(queries.where("query_id % 2 = 0"), "query")
    source = F.struct(F.lit("d").alias("doc_id"), F.lit("kept").alias("chunk_text"), F.lit(1.0).alias("score"), F.lit(mode).alias("source"))
    return rows.select(
        F.col("query_id").alias("seq"),
        F.col("query_id").alias("entry_id"),
        cache_key(F.col("query"), F.lit(mode), F.lit(top_k)).alias("key"),
        "vector",
        F.concat(F.lit("kept answer "), F.col("query_id").cast("string")).alias("answer"),
        F.lit("kept-model").alias("model_used"),
        F.array(source).alias("sources"),
    )


def hybrid_units(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_id, chunk_text, vector): documents with the vector of their number."""
    v = vectors(spark, folder)
    docs = read_table(spark, folder, "documents")
    return docs.join(v, docs["doc_id"] == v["unit_id"]).select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("chunk_text"), "vector")


def hybrid_queries(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, query, vector): benchmark items with the vector of their number."""
    v = vectors(spark, folder)
    q = asked(spark, folder)
    return q.join(v, q["query_id"] == v["unit_id"]).select("query_id", "query", "vector")
