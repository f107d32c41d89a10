"""Consistent hashing: keys go to the next virtual node on a ring of hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvanta.functions.keys import fresh_name, ring_hash

# Places of a node, and the mark in their names.
VIRTUAL_NODES = 150
PLACE_MARK = "#vnode-"
#: Places of a ring that is sent to all tasks, about 100 bytes each; a larger one is joined by a shuffle.
BROADCAST_PLACES = 500_000


def build_ring(spark: SparkSession, nodes: list[str], virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """(vnode_hash, node): ``virtual_nodes`` places of each node. Of equal hashes the first node keeps the place."""
    if virtual_nodes < 1:
        raise ValueError("virtual_nodes must be at least 1")
    names = spark.createDataFrame(list(enumerate(dict.fromkeys(nodes))), "place int, node string")
    each = names.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(virtual_nodes - 1))))
    hashed = each.select("place", "node", "i", ring_hash(F.concat("node", F.lit(PLACE_MARK), F.col("i").cast("string"))).alias("vnode_hash"))
    return hashed.groupBy("vnode_hash").agg(F.min_by("node", F.struct("place", "i")).alias("node"))


def remove_node(ring: DataFrame, node: str, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """The ring without the hashes of a node's places, whoever holds them."""
    gone = ring.sparkSession.range(virtual_nodes).select(ring_hash(F.concat(F.lit(node + PLACE_MARK), F.col("id").cast("string"))).alias("vnode_hash"))
    return ring.join(F.broadcast(gone), "vnode_hash", "left_anti")


def ring_nodes(ring: DataFrame) -> DataFrame:
    """The nodes that hold a place, sorted."""
    return ring.select("node").distinct().orderBy("node")


def ring_arcs(ring: DataFrame) -> DataFrame:
    """(low, high, node): a node's hashes, low < hash <= high; the first place also takes those above the last."""
    order = W.orderBy("vnode_hash")
    arcs = ring.select(F.lag("vnode_hash").over(order).alias("low"), F.col("vnode_hash").alias("high"), "node")
    last = ring.agg(F.max("vnode_hash").alias("low"), F.min_by("node", "vnode_hash").alias("node")).where("low is not null")
    return arcs.unionByName(last.select("low", F.lit(None).cast("long").alias("high"), "node"))


def _buckets(ring: DataFrame, bits: int) -> DataFrame:
    """(bucket, places, next_node): the ring's places by the first ``bits`` bits of their hash, and the node after them.

    A row for each bucket, of which there are as many as places or up to twice as many.
    """
    own = ring.select(_bucket(F.col("vnode_hash"), bits).alias("bucket"), F.struct("vnode_hash", "node").alias("place"))
    lists = own.groupBy("bucket").agg(F.sort_array(F.collect_list("place")).alias("places"))
    every = ring.sparkSession.range(1 << bits).select(F.col("id").alias("bucket")).join(lists, "bucket", "left")
    # The places are as many as virtual nodes, not as keys: one task can order them.
    # From the last bucket down, so that the frame only grows.
    following = F.last(F.get("places", F.lit(0))["node"], ignorenulls=True).over(W.orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1))
    least = F.min(F.get("places", F.lit(0))).over(W.partitionBy())["node"]
    return every.select("bucket", "places", F.coalesce(following, least).alias("next_node"))


def _bucket(hash_: Column, bits: int) -> Column:
    """The first bits of a signed hash, counted from the smallest hash."""
    return F.shiftright(hash_, 64 - bits).cast("long") + F.lit(1 << (bits - 1)).cast("long")


def route(keys: DataFrame, ring: DataFrame, key: str = "key") -> DataFrame:
    """``keys`` with column ``node``: that of the smallest hash >= the key's, else of the smallest; null on an empty ring.

    Keys and places meet by the first bits of their hashes, so a key is compared with
    the one or two places of its bucket, however large the ring. Null keys get null.
    """
    taken = [*keys.columns, "node"]
    places, next_node, bucket, hash_ = (fresh_name(taken, n) for n in ("places", "next_node", "bucket", "hash"))
    n = ring.count()
    if n == 0:
        return keys.withColumn("node", F.lit(None).cast("string"))
    buckets = _buckets(ring, max(1, (n - 1).bit_length())).toDF(bucket, places, next_node)
    buckets = F.broadcast(buckets) if n <= BROADCAST_PLACES else buckets
    bits = max(1, (n - 1).bit_length())
    hashed = keys.withColumn(hash_, ring_hash(F.col(key)))
    joined = hashed.join(buckets, _bucket(F.col(hash_), bits) == F.col(bucket), "left")
    at_or_after = F.get(F.filter(places, lambda x: x["vnode_hash"] >= F.col(hash_)), F.lit(0))["node"]
    return joined.withColumn("node", F.coalesce(at_or_after, F.col(next_node))).select(*[c for c in keys.columns if c.lower() != "node"], "node")


def moved_keys(keys: DataFrame, before: DataFrame, after: DataFrame, key: str = "key") -> DataFrame:
    """(from_node, to_node, keys): how many keys changed their node, of distinct ``keys``."""
    one, two = route(keys, before, key).withColumnRenamed("node", "from_node"), route(keys, after, key).withColumnRenamed("node", "to_node")
    both = one.join(two, key).where(~F.col("from_node").eqNullSafe(F.col("to_node")))
    return both.groupBy("from_node", "to_node").agg(F.count(F.lit(1)).alias("keys"))
