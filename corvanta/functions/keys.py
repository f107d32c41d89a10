"""Keys and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: ln 2 as the decay of a half-life has it.
HALVING = 0.693147


def fresh_name(taken: list[str], wanted: str) -> str:
    """``wanted``, lengthened by underscores until no column of ``taken`` has that name."""
    lower = {x.lower() for x in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def cache_key(query: Column, mode: Column, top_k: Column) -> Column:
    """Hex SHA-256 of query, mode and top_k with bars between."""
    return F.sha2(F.concat_ws("|", query, mode, top_k.cast("string")), 256)


def ring_hash(key: Column) -> Column:
    """The first 8 bytes of the key's MD5 as a signed big-endian long."""
    return F.conv(F.substring(F.md5(key), 1, 16), 16, -10).cast("long")


def eviction_utility(accesses: Column, idle_seconds: Column, half_life: float = 300.0) -> Column:
    """How much an entry is worth keeping: ln(1 + accesses), halved with each half-life of idleness."""
    return F.log1p(accesses.cast("double")) * F.exp(F.lit(-HALVING) * F.greatest(idle_seconds.cast("double"), F.lit(0.0)) / F.lit(half_life))


def hit_rate(hits: Column, misses: Column) -> Column:
    """hits / (hits + misses) at 4 places, 0 without any."""
    return F.round(F.coalesce(F.try_divide(hits.cast("double"), (hits + misses).cast("double")), F.lit(0.0)), 4)
