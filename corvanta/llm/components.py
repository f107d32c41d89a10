"""Connected components of links that may be too many for any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvanta.workspace import Workspace


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``links`` (a, b) as (node, component): the smallest node that each node reaches.

    Large-star and small-star steps alternate until nothing changes; each round is
    written to the shared folder. Nodes without links do not appear, nulls and links
    of a node with itself are ignored. Raises RuntimeError beyond ``rounds``.
    """
    ws = Workspace(links.sparkSession, "components")
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    current = ws.save(pairs.distinct(), "links-0")
    last = None
    for k in range(1, rounds + 1):
        both = current.select("u", "v").union(current.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Every node keeps a link to the least of its own neighbourhood.
        large = large.union(least.where("u > m").select("u", F.col("m").alias("v"))).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        current = ws.save(small.where("u <> v").distinct(), f"links-{k}")
        ws.drop(f"links-{k - 1}")
        found = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == last:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        last = tuple(found)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
