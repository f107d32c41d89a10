"""Response caches replayed over logs of events: exact, bounded, sharded, semantic."""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvanta.functions.keys import HALVING, hit_rate
from corvanta.operators.folds import ordered_fold
from corvanta.operators.ring import PLACE_MARK, VIRTUAL_NODES
from corvanta.operators.search import vector_search

#: Least recently used entries among which a predictive eviction chooses, and the size above which it does.
SAMPLE = 6
PREDICT_ABOVE = 4
SEMANTIC_CAPACITY = 500
SEMANTIC_LEAST = 0.88
#: Shards of a cache, and entries of each.
SHARDS = ("partition-0", "partition-1", "partition-2", "partition-3")
SHARD_CAPACITY = 64


class Entry:
    __slots__ = ("accesses", "expires", "last", "value")

    def __init__(self, value: Any, expires: float | None, now: float):
        self.value, self.expires, self.accesses, self.last = value, expires, 1, now


class BoundedCache:
    """A least-recently-used cache with lifetimes, in event time."""

    def __init__(self, capacity: int, predictive: bool = True, half_life: float = 300.0):
        if capacity <= 0:
            raise ValueError("capacity must be above 0")
        self.capacity, self.predictive, self.half_life = capacity, predictive, half_life
        self.entries: OrderedDict[Any, Entry] = OrderedDict()  # least recent first
        self.evictions = self.predictive_evictions = 0

    def get(self, key: Any, now: float) -> Any:
        """The value, or None if there is none or it has expired; an expired one is dropped."""
        entry = self.entries.get(key)
        if entry is None:
            return None
        if entry.expires is not None and now > entry.expires:
            del self.entries[key]
            return None
        self._touch(key, entry, now)
        return entry.value

    def put(self, key: Any, value: Any, now: float, ttl: float | None = None) -> Any:
        """Store a value; the key that was evicted for it, if any. No ttl, or one of 0 or less, never expires."""
        expires = now + ttl if ttl is not None and ttl > 0 else None
        entry = self.entries.get(key)
        if entry is not None:
            entry.value, entry.expires = value, expires
            self._touch(key, entry, now)
            return None
        gone = None
        if len(self.entries) >= self.capacity:
            gone = self._victim(now)
            del self.entries[gone]
            self.evictions += 1
        self.entries[key] = Entry(value, expires, now)
        return gone

    def delete(self, key: Any) -> bool:
        return self.entries.pop(key, None) is not None

    def clear(self) -> None:
        """Drop all entries; the counts of evictions stay."""
        self.entries.clear()

    def _touch(self, key: Any, entry: Entry, now: float) -> None:
        entry.accesses += 1
        entry.last = now
        self.entries.move_to_end(key)

    def _victim(self, now: float) -> Any:
        keys = iter(self.entries)
        if not (self.predictive and len(self.entries) > PREDICT_ABOVE):
            return next(keys)
        self.predictive_evictions += 1
        tail = [key for key, _ in zip(keys, range(SAMPLE), strict=False)]
        return min(tail, key=lambda k: self._utility(self.entries[k], now))

    def _utility(self, entry: Entry, now: float) -> float:
        return math.log1p(entry.accesses) * math.exp(-HALVING * max(0.0, now - entry.last) / self.half_life)


REPLAY = "node string, seq long, key string, hit boolean, evicted string, size long, evictions long, predictive_evictions long"


def replay_ttl(access: DataFrame, ttl: float) -> DataFrame:
    """Replay of ``access`` (seq, ts, key) on an unbounded cache: get, and put on a miss. Adds hit, expires_micros.

    An entry lives ``ttl`` seconds from its put; a get at the last microsecond hits.
    """
    micros = round(ttl * 1e6)

    def step(state: dict, row) -> tuple:
        hit = bool(state) and (ttl <= 0 or row.micros <= state["expires"])
        if not hit:
            state["expires"] = row.micros + micros
        return row.seq, row.key, hit

    events = access.select("key", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return ordered_fold(events, "key", ["micros", "seq"], dict, step, "seq long, key string, hit boolean")


def replay_cache(access: DataFrame, capacity: int, ttl: float | None, predictive: bool = True) -> DataFrame:
    """Replay of ``access`` (node, seq, ts, key) on a bounded cache for each node: get, and put on a miss.

    Returns node, seq, key, hit, evicted, size after the event, and the node's
    evictions so far. Nodes are independent, and so run in parallel.
    """

    def step(cache: BoundedCache, row) -> tuple:
        now = row.micros / 1e6
        hit = cache.get(row.key, now) is not None
        gone = None if hit else cache.put(row.key, True, now, ttl)
        return row.node, row.seq, row.key, hit, gone, len(cache.entries), cache.evictions, cache.predictive_evictions

    BoundedCache(capacity)  # rejects a bad capacity before anything runs
    events = access.select("node", "seq", "key", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return ordered_fold(events, "node", ["micros", "seq"], lambda: BoundedCache(capacity, predictive), step, REPLAY)


LOG = "node string, seq long, op string, key string, value string, hit boolean, removed string, size long, hits long, misses long, evictions long"


class _Shard:
    """A bounded cache with counts of hits and misses since it was last cleared."""

    def __init__(self, capacity: int, predictive: bool):
        self.cache, self.hits, self.misses = BoundedCache(capacity, predictive), 0, 0


def replay_log(log: DataFrame, capacity: int, default_ttl: float | None, predictive: bool = True) -> DataFrame:
    """Replay of operations ``log`` (node, seq, ts, op, key, value, ttl), a bounded cache for each node.

    get returns the value, and counts a hit, or a miss if there is none, it is null or
    has expired. put stores a value, with ``default_ttl`` where ttl is null. delete
    drops a key. clear drops all and the counts of hits and misses; those of evictions
    stay. Returns what each did, with the node's counts after it; ``removed`` is the key
    that was evicted or deleted. Other operations raise ValueError in their task.
    """
    BoundedCache(capacity)

    def step(shard: _Shard, row) -> tuple:
        cache, now, value, hit, removed = shard.cache, row.micros / 1e6, None, None, None
        if row.op == "get":
            value = cache.get(row.key, now)
            hit = value is not None
            shard.hits += hit
            shard.misses += not hit
        elif row.op == "put":
            removed = cache.put(row.key, row.value, now, default_ttl if row.ttl is None else row.ttl)
        elif row.op == "delete":
            removed = row.key if cache.delete(row.key) else None
        elif row.op == "clear":
            cache.clear()
            shard.hits = shard.misses = 0
        else:
            raise ValueError(f"no such operation: {row.op}")
        return row.node, row.seq, row.op, row.key, value, hit, removed, len(cache.entries), shard.hits, shard.misses, cache.evictions

    events = log.select("node", "seq", "op", "key", "value", F.col("ttl").cast("double").alias("ttl"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return ordered_fold(events, "node", ["micros", "seq"], lambda: _Shard(capacity, predictive), step, LOG)


def cache_stats(replay: DataFrame) -> DataFrame:
    """One row of a replay's hits, misses and hit rate."""
    hits, misses = F.count_if("hit"), F.count_if(~F.col("hit"))
    return replay.agg(hits.alias("hits"), misses.alias("misses")).select("hits", "misses", hit_rate(F.col("hits"), F.col("misses")).alias("hit_rate"))


def shard_stats(replay: DataFrame) -> DataFrame:
    """By node: hits, misses, entries at the end and evictions."""
    return replay.groupBy("node").agg(
        F.count_if("hit").alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"),
        F.max_by("size", "seq").alias("entries"),
        F.max("evictions").alias("evictions"),
        F.max("predictive_evictions").alias("predictive_evictions"),
    )


def semantic_fifo(entries: DataFrame, capacity: int = SEMANTIC_CAPACITY) -> DataFrame:
    """The latest ``capacity`` entries (seq, ...), those with a zero vector left out."""
    live = entries.where(F.exists("vector", lambda x: x != 0))
    return live.orderBy(F.desc("seq")).limit(capacity)


def semantic_lookup(entries: DataFrame, probes: DataFrame, least: float = SEMANTIC_LEAST, now: str | None = None) -> DataFrame:
    """(probe_id, entry_id, similarity, hit_type) of ``probes`` (probe_id, key, vector) in ``entries`` (seq, entry_id, key, vector).

    An equal key is an exact hit with similarity 1; else the most similar live entry
    hits from ``least`` on, the earliest of ties; else a miss with similarity 0. With
    ``now``, a timestamp, entries past their expiry_ts are left out.
    """
    live = entries if now is None else entries.where(F.col("expiry_ts").isNull() | (F.lit(now).cast("timestamp") <= F.col("expiry_ts")))
    exact = live.groupBy("key").agg(F.max_by("entry_id", "seq").alias("exact_id"))
    asked = probes.join(exact, "key", "left")
    best = vector_search(live.select(F.struct("seq", "entry_id").alias("s"), "vector").select(F.col("s.seq").alias("unit_id"), "vector"), probes.select(F.col("probe_id").alias("query_id"), "vector"), 1)
    best = best.join(live.select(F.col("seq").alias("unit_id"), "entry_id"), "unit_id").select(F.col("query_id").alias("probe_id"), "entry_id", "score")
    nonzero = F.exists("vector", lambda x: x != 0)
    joined = asked.join(best.where(F.col("score") >= least), "probe_id", "left")
    kind = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("score").isNotNull() & nonzero, "semantic").otherwise("miss")
    return joined.withColumn("hit_type", kind).select(
        "probe_id",
        F.when(F.col("hit_type") == "exact", F.col("exact_id")).when(F.col("hit_type") == "semantic", F.col("entry_id")).alias("entry_id"),
        F.when(F.col("hit_type") == "exact", 1.0).when(F.col("hit_type") == "semantic", F.col("score")).otherwise(0.0).alias("similarity"),
        "hit_type",
    )


class SemanticCache:
    """A cache of bounded shards on a hash ring, with a list of vectors beside them that finds like keys.

    The list is bounded too: the oldest entry goes first. A null lifetime means
    ``default_ttl`` for the shards, and none for the list.
    """

    def __init__(self, nodes: Sequence[str], capacity: int, default_ttl: float | None, least: float, semantic_capacity: int, predictive: bool, virtual_nodes: int):
        self.shards = {node: BoundedCache(capacity, predictive) for node in nodes}
        self.default_ttl, self.least, self.semantic_capacity = default_ttl, least, semantic_capacity
        places: dict[int, str] = {}
        for node in nodes:
            for i in range(virtual_nodes):
                places.setdefault(_place(f"{node}{PLACE_MARK}{i}"), node)
        self.places = sorted(places.items())
        self.near: list[tuple[Any, float]] = []  # key, end of life; their unit vectors are the first rows
        self.rows: Any = None
        self.hits = self.misses = self.semantic_hits = self.epoch = 0

    def shard(self, key: str) -> BoundedCache:
        return self.shards[self.places[bisect_left(self.places, (_place(key),)) % len(self.places)][1]]

    def get(self, key: str, now: float) -> Any:
        found = self.shard(key).get(key, now)
        self._count(found is not None)
        return found

    def get_like(self, key: str, vector: Any, now: float) -> tuple[str, float]:
        """("exact", 1), ("semantic", similarity) or ("miss", 0); entries of the list past their life are dropped."""
        if self.shard(key).get(key, now) is not None:
            self._count(True)
            return "exact", 1.0
        own = _unit(vector)
        if own is not None and self.near:
            self._keep([now <= end for _, end in self.near])
            if self.near:
                best = float((self.rows[: len(self.near)] @ own).max())
                if best >= self.least:
                    self._count(True)
                    self.semantic_hits += 1
                    return "semantic", best
        self._count(False)
        return "miss", 0.0

    def put(self, key: str, now: float, ttl: float | None = None, vector: Any = None) -> None:
        self.shard(key).put(key, True, now, self.default_ttl if ttl is None else ttl)
        own = _unit(vector)
        if own is not None:
            if self.rows is None:
                self.rows = np.empty((self.semantic_capacity, len(own)))
            if len(self.near) >= self.semantic_capacity:
                self._keep([False] + [True] * (len(self.near) - 1))
            self.rows[len(self.near)] = own
            self.near.append((key, now + ttl if ttl is not None and ttl > 0 else math.inf))

    def delete(self, key: str) -> bool:
        self._keep([e[0] != key for e in self.near])
        return self.shard(key).delete(key)

    def _keep(self, which: list[bool]) -> None:
        if not all(which):
            at = np.flatnonzero(which)
            self.rows[: len(at)] = self.rows[at]
            self.near = [self.near[i] for i in at]

    def clear(self) -> None:
        """Drop all entries and counts of hits and misses; those of evictions stay, and an epoch begins."""
        for shard in self.shards.values():
            shard.clear()
        self.near.clear()
        self.hits = self.misses = self.semantic_hits = 0
        self.epoch += 1

    def _count(self, hit: bool) -> None:
        self.hits += hit
        self.misses += not hit

    def counts(self) -> tuple[int, ...]:
        own = self.shards.values()
        return (
            sum(len(s.entries) for s in own), self.hits, self.misses, self.semantic_hits, len(self.near),
            sum(s.evictions for s in own), sum(s.predictive_evictions for s in own), self.epoch,
        )


def _place(key: str) -> int:
    return int.from_bytes(hashlib.md5(key.encode()).digest()[:8], "big", signed=True)


def _unit(vector: Any) -> Any:
    if vector is None:
        return None
    x = np.asarray(vector, dtype=np.float64)
    length = float(np.linalg.norm(x))
    return x / length if length > 0 else None


COUNTS = "size long, hits long, misses long, semantic_hits long, semantic_entries long, evictions long, predictive_evictions long, epoch long"


def replay_semantic(
    log: DataFrame,
    ttl: float | None = None,
    least: float = SEMANTIC_LEAST,
    capacity: int = SEMANTIC_CAPACITY,
    nodes: Sequence[str] = SHARDS,
    shard_capacity: int = SHARD_CAPACITY,
    default_ttl: float | None = None,
    predictive: bool = True,
    virtual_nodes: int = VIRTUAL_NODES,
) -> DataFrame:
    """Replay of ``log`` (scope, seq, ts, key, vector) on a sharded semantic cache for each scope.

    Without a column ``op`` each row asks: an exact, then a semantic get, and a put on a
    miss. With one, it is ask, get, put, delete or clear; with a column ``ttl`` that is
    the entry's lifetime in seconds, else the argument. Returns scope, seq, hit_type
    (exact, semantic or miss; null for other operations), similarity, and the scope's
    counts after the row. A scope is one cache, and so one task's; scopes run in
    parallel. Other operations raise ValueError in their task.
    """

    def step(cache: SemanticCache, row) -> tuple:
        now, kind, similarity = row.micros / 1e6, None, 0.0
        if row.op == "ask":
            kind, similarity = cache.get_like(row.key, row.vector, now)
            if kind == "miss":
                cache.put(row.key, now, row.ttl, row.vector)
        elif row.op == "get":
            kind = "miss" if cache.get(row.key, now) is None else "exact"
            similarity = float(kind == "exact")
        elif row.op == "put":
            cache.put(row.key, now, row.ttl, row.vector)
        elif row.op == "delete":
            cache.delete(row.key)
        elif row.op == "clear":
            cache.clear()
        else:
            raise ValueError(f"no such operation: {row.op}")
        return row.scope, row.seq, kind, similarity, *cache.counts()

    def start() -> SemanticCache:
        return SemanticCache(nodes, shard_capacity, default_ttl, least, capacity, predictive, virtual_nodes)

    start()  # rejects a bad capacity before anything runs
    op = F.col("op") if "op" in log.columns else F.lit("ask")
    life = F.col("ttl").cast("double") if "ttl" in log.columns else F.lit(ttl).cast("double")
    events = log.select("scope", "seq", "key", F.col("vector").cast("array<double>").alias("vector"), op.alias("op"), life.alias("ttl"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return ordered_fold(events, "scope", ["micros", "seq"], start, step, f"scope string, seq long, hit_type string, similarity double, {COUNTS}")


def semantic_stats(replay: DataFrame, nodes: Sequence[str] = SHARDS, shard_capacity: int = SHARD_CAPACITY, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """By scope of a ``replay_semantic``: what the cache holds and has counted at the end of its log."""
    names = [part.strip().split()[0] for part in COUNTS.split(",")]
    last = replay.groupBy("scope").agg(F.max_by(F.struct(*names), "seq").alias("s")).select("scope", "s.*")
    fixed = {"capacity": F.lit(len(nodes) * shard_capacity), "num_partitions": F.lit(len(nodes)), "virtual_nodes_per_partition": F.lit(virtual_nodes)}
    return last.withColumns({n: c.cast("long") for n, c in fixed.items()} | {"hit_rate": hit_rate(F.col("hits"), F.col("misses"))})


def recency(access: DataFrame, key: str = "key") -> DataFrame:
    """(key, last_seq, recency): keys by their last access, the latest first."""
    last = access.groupBy(key).agg(F.max("seq").alias("last_seq"))
    return last.withColumn("recency", F.row_number().over(W.orderBy(F.desc("last_seq"))))
