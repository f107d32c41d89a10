"""Mixing sources to target weights, with DataFrame operations only.

Each row gets a hash-random key. Within its source, rows are sorted by that key
over key ranges; sums of the ranges, then running sums inside a range, give each
row its place in the source's order without gathering a source in one task. The
source's budget is cut from that order: whole epochs first, then the words up to
the exact cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvanta.llm.columns import WORD, fresh_name, random_key, word_count
from corvanta.workspace import Workspace, small_enough

#: Key ranges of each source. A range of a source with ten billion rows has 2.4 million.
RANGES = 4096
KEY_BITS = 60


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Targets by source: ``totals`` (source, source_size) with weight, target added.

    Sources by code point, null last, take the weights in turn. Targets share the
    sum of all sizes by weight. None exceeds ``max_epochs`` times its source's size;
    what exceeds is shared by weight among the others until none is above. With the
    sources sorted by cap over weight, that is the first level that leaves the rest
    below their caps. An empty table gives none; sources of size 0 get target 0.
    Works on a row for each source, not for each document.
    """
    n = len(weights)
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(place, F.lit(n)) + 1).cast("int")).cast("long")
    t = totals.withColumn("weight", weight).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    t = (
        t.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("open", F.col("weight") * (F.col("total") - F.col("capped")) <= F.col("cap") * F.col("left_weight"))
    )
    first = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "total", "capped", "left_weight"))).over(everything)
    t = t.withColumn("level", first)
    free = F.col("weight") * (F.col("level.total") - F.col("level.capped"))
    shared = free.cast("double") / F.col("level.left_weight")
    target = F.when(
        F.col("level").isNotNull() & (free <= F.col("cap") * F.col("level.left_weight")), shared
    ).otherwise(F.col("cap").cast("double"))
    return t.select("source", "source_size", "weight", target.alias("target"))


def order_key(row_id: Column, text: Column, seed: int) -> Column:
    """The hash-random key of a row: of its id, or of its text where it has no id."""
    return random_key(F.coalesce(row_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit(""))))), seed)


def _range(key: Column, ranges: int) -> Column:
    return F.floor(key / F.lit((1 << KEY_BITS) // ranges)).cast("int")


def _starts(sums: DataFrame) -> DataFrame:
    """``sums`` (source, range, range_size) with the words of the source's ranges before."""
    before = F.sum("range_size").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    return sums.withColumn("start", F.coalesce(before, F.lit(0)))


#: Times a source is taken whole, by its columns target and source_size.
_WHOLE = "coalesce(cast(floor(target) as bigint) div nullif(source_size, 0), 0)"


def mix_sources(
    df: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 20,
    ranges: int = RANGES,
    text: str = "text",
    source: str = "source",
    row_id: str = "doc_id",
) -> DataFrame:
    """What a mix by ``weights`` takes of each row of ``df``.

    Returns a row for each row of ``df``: doc_id, source, size (words), source_size,
    weight, target, epochs (times the whole text is taken), cut (further words of
    it taken, below size) and taken = epochs * size + cut. Reruns agree: the key is
    a hash of the id and of ``seed``, or of the text where the id is null.

    Null and empty texts have size 0 and are never taken. Null sources form a source
    of their own, placed last. Repeated rows and rows with one key are taken in order
    of (key, id, size), so equal rows are exchangeable. Very long texts count with all
    their words. An empty table gives an empty result. Other columns are neither read
    nor returned.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "mixing")
    rows = ws.save(
        df.select(
            F.col(row_id).alias("doc_id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            order_key(F.col(row_id), F.col(text), seed).alias("key"),
        ).withColumn("range", _range(F.col("key"), ranges)),
        "rows",
    )
    sums = ws.save(rows.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "sums")
    targets = ws.save(source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs), "targets")
    plan = _starts(sums).alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        F.col("s.source").alias("p_source"), F.col("s.range").alias("p_range"), "start", "source_size", "weight", "target"
    )
    inside = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("range") == F.col("p_range")))
    budget = F.floor("target").cast("long")
    whole = F.expr(_WHOLE)
    rest = budget - whole * F.col("source_size")
    left = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("start") - F.col("inside")))
    return (
        joined.withColumn("whole", whole)
        .withColumn("part", left)
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "weight",
            "target",
            (F.col("whole") + ((F.col("part") == F.col("size")) & (F.col("size") > 0)).cast("long")).alias("epochs"),
            F.when(F.col("part") == F.col("size"), 0).otherwise(F.col("part")).cast("long").alias("cut"),
            (F.col("whole") * F.col("size") + F.col("part")).alias("taken"),
        )
    )


def source_cuts(rows: DataFrame, ws: Workspace, weights: tuple[int, ...], max_epochs: int, ranges: int) -> DataFrame:
    """Where each source's budget ends, a row for each source, of ``rows`` (source, size, key, tie).

    (m_source, whole, b_key, b_tie, full, cut): every row is taken ``whole`` times, those
    whose (key, tie) is below (b_key, b_tie) once more; of the equal rows at that place
    ``full`` once more, and of another one ``cut`` words. b_key is null where the budget
    is a multiple of the source's size. Only the range that holds the cut is sorted.
    """
    rows = ws.save(rows.withColumn("range", _range(F.col("key"), ranges)), "rows")
    sums = ws.save(rows.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "sums")
    targets = ws.save(source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs), "targets")
    plan = targets.withColumn("whole", F.expr(_WHOLE)).select(
        F.col("source").alias("m_source"), "whole", (F.floor("target").cast("long") - F.col("whole") * F.col("source_size")).alias("rest")
    )
    last = _starts(sums).join(plan.where("rest > 0"), F.col("source").eqNullSafe(F.col("m_source")))
    last = last.where((F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("start") + F.col("range_size")))
    last = last.select("m_source", F.col("range").alias("m_range"), (F.col("rest") - F.col("start")).alias("left"))
    near = rows.join(last, F.col("source").eqNullSafe(F.col("m_source")) & (F.col("range") == F.col("m_range")))
    near = near.groupBy("m_source", "key", "tie", "left").agg(F.max("size").alias("size"), F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("m_source").orderBy("key", "tie").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = near.withColumn("over", F.col("left") - before).where((F.col("over") > 0) & (F.col("over") <= F.col("words")))
    ends = ends.select(
        F.col("m_source").alias("e_source"), F.col("key").alias("b_key"), F.col("tie").alias("b_tie"), F.expr("over div size").alias("full"), (F.col("over") % F.col("size")).alias("cut")
    )
    return plan.join(ends, F.col("m_source").eqNullSafe(F.col("e_source")), "left").select("m_source", "whole", "b_key", "b_tie", "full", "cut")


def mixed_rows(
    df: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 20,
    ranges: int = RANGES,
    text: str = "text",
    source: str = "source",
    row_id: str = "doc_id",
    cut_name: str = "is_cut",
) -> DataFrame:
    """The mix itself: each row of ``df`` as often as its source's budget takes it.

    All columns of ``df`` and ``cut_name``, which is true for the one row of a source
    that is cut to the words that are left of its budget. Rows are taken in order of a
    hash of the id (of the text where the id is null) and of the whole row, so rows are
    told apart even if ids are null or repeated; rows equal in all columns are
    exchangeable. The words of each source sum to its target, rounded down.

    Texts do not move: a row for each source tells where its budget ends, and each row
    compares itself with it. Null, empty and blank texts are not taken; null sources
    form one source, placed last. A very long text is cut like any other. An empty
    table gives an empty result. A column of ``df`` named like ``cut_name`` raises
    ValueError; other columns may have any name.
    """
    if cut_name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"{cut_name} is a column already")
    ws = Workspace(df.sparkSession, "mixed")
    key, tie = (fresh_name([*df.columns, cut_name], n) for n in ("key", "tie"))
    marked = df.withColumns({key: order_key(F.col(row_id), F.col(text), seed), tie: F.xxhash64(*df.columns)})
    sized = marked.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.col(key).alias("key"), F.col(tie).alias("tie"))
    cuts = ws.save(source_cuts(sized, ws, weights, max_epochs, ranges), "cuts")
    names = {c: fresh_name([*marked.columns, cut_name], f"c_{c}") for c in cuts.columns}
    cuts = cuts.withColumnsRenamed(names)
    cuts = F.broadcast(cuts) if small_enough(cuts, 100_000) else cuts
    c = lambda name: F.col(names[name])
    joined = marked.where(F.col(text).rlike(WORD)).join(cuts, F.col(source).eqNullSafe(c("m_source")))
    copy = fresh_name(joined.columns, "copy")
    below = F.coalesce(F.struct(F.col(key), F.col(tie)) < F.struct(c("b_key"), c("b_tie")), F.lit(False))
    times = c("whole") + (c("b_key").isNotNull() & below).cast("long")
    whole = joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.when(times > 0, times)))).select(*df.columns, F.lit(False).alias(cut_name))
    at = joined.where((F.col(key) == c("b_key")) & (F.col(tie) == c("b_tie")))
    row = F.struct(*[F.col(x) for x in df.columns])
    # Equal rows: one stands for all.
    at = at.groupBy(key, tie, names["m_source"]).agg(F.first(row).alias("r"), F.max(c("full")).alias("full"), F.max(c("cut")).alias("cut"))
    at = at.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("full") + 1))).where((F.col("copy") <= F.col("full")) | (F.col("cut") > 0))
    words = F.regexp_extract_all(F.col("r")[text], F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    part = F.array_join(F.slice(words, F.lit(1), F.col("cut").cast("int")), "")
    is_cut = F.col("copy") > F.col("full")
    ends = at.select(*[F.when(is_cut, part).otherwise(F.col("r")[x]).alias(x) if x == text else F.col("r")[x].alias(x) for x in df.columns], is_cut.alias(cut_name))
    return whole.unionByName(ends)
