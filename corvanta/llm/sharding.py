"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group that no shard boundary may cut. Groups enter the
bin with the tightest remaining capacity, largest first; a balanced tree holds the
bins by what remains. Groups far below a bin's capacity are first bundled by hash,
so that what is packed in one task has a size bound that no input can exceed.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvanta.llm.columns import byte_count
from corvanta.workspace import Workspace

#: Groups of at least total / (shards * FINE) are packed one by one: at most shards * FINE
#: of them exist. All other groups go to BUNDLES * shards bundles.
FINE = 1000
BUNDLES = 1000
#: Slots are numbered in so many pieces of each shard.
PIECES = 512


class CapacityTree:
    """Bins by remaining capacity in an AVL tree; ties by bin number."""

    __slots__ = ("_root",)

    def __init__(self) -> None:
        self._root = None

    # A node is [key, left, right, height] with key = (remaining, bin).

    @staticmethod
    def _height(node) -> int:
        return node[3] if node else 0

    def _fixed(self, node):
        lean = self._height(node[1]) - self._height(node[2])
        if lean > 1:
            if self._height(node[1][1]) < self._height(node[1][2]):
                node[1] = self._turned(node[1], 2)
            return self._turned(node, 1)
        if lean < -1:
            if self._height(node[2][2]) < self._height(node[2][1]):
                node[2] = self._turned(node[2], 1)
            return self._turned(node, 2)
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        return node

    def _turned(self, node, side: int):
        """The child on ``side`` becomes the parent of ``node``."""
        child = node[side]
        node[side] = child[3 - side]
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        child[3 - side] = node
        child[3] = 1 + max(self._height(child[1]), self._height(child[2]))
        return child

    def add(self, key: tuple[int, int]) -> None:
        def put(node):
            if node is None:
                return [key, None, None, 1]
            side = 1 if key < node[0] else 2
            node[side] = put(node[side])
            return self._fixed(node)

        self._root = put(self._root)

    def pop_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the least (remaining, bin) with remaining >= size."""
        node, best = self._root, None
        while node:
            if node[0] >= (size, -1):
                best, node = node[0], node[1]
            else:
                node = node[2]
        if best is not None:
            self._root = self._without(self._root, best)
        return best

    def _without(self, node, key):
        if key == node[0]:
            if node[1] is None or node[2] is None:
                return node[1] or node[2]
            least = node[2]
            while least[1]:
                least = least[1]
            node[0] = least[0]
            node[2] = self._without(node[2], least[0])
        else:
            side = 1 if key < node[0] else 2
            node[side] = self._without(node[side], key)
        return self._fixed(node)


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[int]:
    """The bin of each size. Larger sizes first, ties by position; a size above the
    capacity gets a bin of its own. Bins are numbered as they open."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    tree, bins, opened = CapacityTree(), [0] * len(sizes), 0
    for i in order:
        found = tree.pop_tightest(sizes[i])
        if found is None:
            left, bin_ = max(capacity, sizes[i]), opened
            opened += 1
        else:
            left, bin_ = found
        bins[i] = bin_
        tree.add((left - sizes[i], bin_))
    return bins


def pack_into(sizes: Sequence[int], shards: int) -> list[int]:
    """Bins of the least capacity found by bisection for which ``shards`` bins are enough.

    What is larger than its share of the bytes that are left, largest first, gets a bin
    of its own; the capacity is that of the other bins.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    alone, left = 0, sum(sizes)
    while alone < min(shards - 1, len(sizes)) and sizes[order[alone]] * (shards - alone) > left:
        left -= sizes[order[alone]]
        alone += 1
    bins = [0] * len(sizes)
    for bin_, i in enumerate(order[:alone]):
        bins[i] = bin_
    rest = sorted(order[alone:])
    for i, bin_ in zip(rest, _pack_evenly([sizes[i] for i in rest], shards - alone), strict=True):
        bins[i] = alone + bin_
    return bins


def _pack_evenly(sizes: list[int], shards: int) -> list[int]:
    if not sizes:
        return []
    low = max(max(sizes), -(-sum(sizes) // shards))
    bins = best_fit_decreasing(sizes, low)
    if max(bins) < shards:
        return bins
    high = low + max(sizes)
    while max(bins := best_fit_decreasing(sizes, high)) >= shards:
        high += max(sizes)
    while low + 1 < high:
        middle = (low + high) // 2
        tried = best_fit_decreasing(sizes, middle)
        if max(tried) < shards:
            high, bins = middle, tried
        else:
            low = middle
    return bins


def _packer(shards: int | None, capacity: int | None):
    def pack(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["size", "item"], ascending=[False, True], kind="stable")
        sizes = [int(x) for x in items["size"]]
        bins = best_fit_decreasing(sizes, capacity) if capacity else pack_into(sizes, shards)
        return pd.DataFrame({"cohort": items["cohort"].to_numpy(), "item": items["item"].to_numpy(), "bin": pd.array(bins, dtype="int64")})

    return pack


def shard_groups(
    df: DataFrame,
    shards: int | None = None,
    capacity: int | None = None,
    text: str = "text",
    row_id: str = "doc_id",
    cohort_items: int = 100_000,
) -> DataFrame:
    """A shard and a slot for each row of ``df``; rows with equal texts share a shard.

    Give ``shards`` for that many shards of near equal bytes, or ``capacity`` for as few
    shards of at most so many bytes as best fit finds. Only a group that alone exceeds
    the capacity makes a larger shard. Returns doc_id, size (UTF-8 bytes of the text
    plus 1), text_crc32 (unsigned), shard, slot (0, 1, ... in each shard).

    Null texts have size 1, a null text_crc32, and form one group; empty texts form
    another. Texts are grouped by a 64-bit hash, so a collision of different texts
    would only join two groups. Null ids, equal ids and repeated rows each keep their
    row. An empty table gives an empty result. Other columns are neither read nor
    returned.
    """
    if (shards is None) == (capacity is None) or (capacity if shards is None else shards) < 1:
        raise ValueError("give a positive number of shards or a positive capacity")
    spark = df.sparkSession
    ws = Workspace(spark, "sharding")
    content = F.col(text)
    rows = ws.save(
        df.select(
            F.col(row_id).alias("doc_id"),
            (byte_count(content) + 1).alias("size"),
            F.crc32(content.cast("binary")).alias("text_crc32"),
            F.when(content.isNotNull(), F.xxhash64(content)).alias("content"),
        ),
        "rows",
    )
    groups = ws.save(rows.groupBy("content").agg(F.sum("size").alias("size")), "groups")
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    width = shards or max(1, -(-total // capacity))
    fine = max(1, -(-total // (width * FINE)))
    bundles = width * BUNDLES
    large = F.col("size") >= fine
    items = groups.select(
        F.when(large, F.col("content")).alias("content"),
        large.alias("large"),
        F.when(~large, F.pmod(F.xxhash64(F.col("content"), F.lit("bundle")), F.lit(bundles))).alias("bundle"),
        "size",
    )
    items = items.groupBy("large", "content", "bundle").agg(F.sum("size").alias("size"))
    items = items.withColumn("item", F.xxhash64("large", F.coalesce(F.col("content"), F.lit(0)), F.coalesce(F.col("bundle"), F.lit(-1))))
    cohorts = 1 if shards else max(1, -(-width * (FINE + BUNDLES) // cohort_items))
    items = ws.save(items.withColumn("cohort", F.pmod(F.hash("item", F.lit("cohort")), F.lit(cohorts)).cast("long")), "items")
    packed = ws.save(
        items.select("cohort", "item", "size").groupBy("cohort").applyInPandas(_packer(shards, capacity), "cohort long, item long, bin long"),
        "packed",
    )
    opened = packed.groupBy("cohort").agg((F.max("bin") + 1).alias("bins"))
    first = opened.select("cohort", F.coalesce(F.sum("bins").over(W.orderBy("cohort").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    placed = packed.join(first, "cohort").select("item", (F.col("bin") + F.col("first")).cast("int").alias("shard"))
    homes = ws.save(items.join(placed, "item").select("large", "content", "bundle", "shard"), "homes")
    # width * (FINE + BUNDLES) rows at most: with some thousand shards too many to broadcast.
    small = width * (FINE + BUNDLES) <= 500_000
    hint = F.broadcast if small else (lambda x: x)
    one = homes.where("large").select(F.col("content").alias("l_content"), F.lit(True).alias("l_found"), F.col("shard").alias("l_shard"))
    many = homes.where("not large").select(F.col("bundle").alias("b_bundle"), F.col("shard").alias("b_shard"))
    found = (
        rows.join(hint(one), F.col("content").eqNullSafe(F.col("l_content")), "left")
        .withColumn("bundle", F.when(F.col("l_found").isNull(), F.pmod(F.xxhash64(F.col("content"), F.lit("bundle")), F.lit(bundles))))
        .join(hint(many), F.col("bundle") == F.col("b_bundle"), "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("l_shard", "b_shard").alias("shard"))
        .withColumn("piece", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(PIECES)).cast("int"))
    )
    found = ws.save(found, "found")
    counts = found.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(
        F.col("shard").alias("s_shard"),
        F.col("piece").alias("s_piece"),
        F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"),
    )
    inside = F.row_number().over(W.partitionBy("shard", "piece").orderBy("doc_id", "size", "text_crc32"))
    return (
        found.withColumn("inside", inside)
        .join(starts, (F.col("shard") == F.col("s_shard")) & (F.col("piece") == F.col("s_piece")))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("inside") - 1).cast("long").alias("slot"))
    )
