import hashlib
import math
from bisect import bisect_left
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvanta.functions.keys import cache_key
from corvanta.operators import cache, ratelimit, ring, search, store
from corvanta.operators.cache import BoundedCache
from corvanta.operators.ratelimit import Bucket
from corvanta.streaming import jobs

START = datetime(2024, 1, 1)


def hashed(key):
    return int.from_bytes(hashlib.md5(key.encode()).digest()[:8], "big", signed=True)


def test_ring(spark):
    nodes = ["n0", "n1", "n2"]
    places = sorted((hashed(f"{n}#vnode-{i}"), n) for n in nodes for i in range(20))
    full = ring.build_ring(spark, nodes, 20)
    assert sorted((r.vnode_hash, r.node) for r in full.collect()) == places
    keys = spark.createDataFrame([(f"k{i}",) for i in range(300)], "key string")
    want = {f"k{i}": places[bisect_left(places, (hashed(f"k{i}"), "")) % len(places)][1] for i in range(300)}
    assert {r.key: r.node for r in ring.route(keys, full).collect()} == want
    less = ring.remove_node(full, "n1", 20)
    after = {r.key: r.node for r in ring.route(keys, less).collect()}
    assert {k for k in want if want[k] != after[k]} == {k for k in want if want[k] == "n1"}
    moved = {(r.from_node, r.to_node): r["keys"] for r in ring.moved_keys(keys, full, less).collect()}
    assert sum(moved.values()) == sum(n == "n1" for n in want.values()) and {a for a, _ in moved} == {"n1"}
    assert [r.node for r in ring.ring_nodes(less).collect()] == ["n0", "n2"]
    assert {r.node for r in ring.route(keys, ring.build_ring(spark, ["only"], 1)).collect()} == {"only"}
    assert {r.node for r in ring.route(keys, full.limit(0)).collect()} == {None}
    arcs = ring.ring_arcs(full).collect()
    inside = lambda h, r: (r.low is None or h > r.low) and (r.high is None or h <= r.high)
    assert all({r.node for r in arcs if inside(hashed(k), r)} == {n} for k, n in want.items())
    with pytest.raises(ValueError):
        ring.build_ring(spark, nodes, 0)


@pytest.mark.parametrize("broadcast", [True, False])
def test_large_ring(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(ring, "BROADCAST_PLACES", 0)
    for n in (1000, 5000):  # 100,000 places and more
        places = sorted((hashed(f"n{j}#vnode-{i}"), f"n{j}") for j in range(n) for i in range(100))
        keys = spark.createDataFrame([(f"k{i}", i) for i in range(400)] + [(None, -1)], "key string, hash int")
        got = ring.route(keys, ring.build_ring(spark, [f"n{j}" for j in range(n)], 100))
        assert got.columns == ["key", "hash", "node"]
        assert {r.key: r.node for r in got.collect()} == {None: None} | {f"k{i}": places[bisect_left(places, (hashed(f"k{i}"), "")) % len(places)][1] for i in range(400)}


def test_bounded_cache():
    c = BoundedCache(2, predictive=False)
    assert c.put("a", 1, 0, 10) is None and c.put("b", 2, 0, 0) is None
    assert c.get("a", 10) == 1 and c.get("a", 10.001) is None and len(c.entries) == 1
    assert c.get("b", 1e9) == 2  # a lifetime of 0 is none
    c.put("c", None, 1)
    assert c.get("c", 2) is None and c.put("d", 4, 3) == "b"
    c.clear()
    assert c.evictions == 1 and not c.entries and c.delete("d") is False
    # With five entries the least useful of the six least recent goes, not the oldest.
    p = BoundedCache(5)
    for k in "abcde":
        p.put(k, k, 0)
    for _ in range(5):
        p.get("a", 1)
    p.get("b", 1), p.get("c", 1), p.get("d", 1), p.get("e", 1), p.get("e", 1)
    assert p.put("f", 1, 2) == "b" and p.predictive_evictions == 1
    four = BoundedCache(4)
    for k in "abcde":
        four.put(k, k, 0)
    assert four.evictions == 1 and four.predictive_evictions == 0
    # An expired entry takes its place until it is read.
    e = BoundedCache(1, predictive=False)
    e.put("a", 1, 0, 1)
    assert e.put("b", 1, 5) == "a"
    with pytest.raises(ValueError):
        BoundedCache(0)


class PlainCache:
    """The same rules over a plain list, most recent last."""

    def __init__(self, capacity):
        self.capacity, self.rows = capacity, []

    def access(self, key, now, ttl):
        row = next((r for r in self.rows if r["k"] == key), None)
        if row and now <= row["e"]:
            row |= {"n": row["n"] + 1, "t": now}
            self.rows.append(self.rows.pop(self.rows.index(row)))
            return True
        if row:
            self.rows.remove(row)
        if len(self.rows) >= self.capacity:
            worth = lambda r: math.log1p(r["n"]) * math.exp(-0.693147 * (now - r["t"]) / 300)
            self.rows.remove(min(self.rows[:6], key=worth) if len(self.rows) > 4 else self.rows[0])
        self.rows.append({"k": key, "e": now + ttl, "n": 1, "t": now})
        return False


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 9), st.lists(st.tuples(st.integers(0, 12), st.integers(0, 40)), max_size=120))
def test_cache_like_plain(capacity, steps):
    mine, plain, now = BoundedCache(capacity), PlainCache(capacity), 0
    for key, wait in steps:
        now += wait
        hit = mine.get(key, now) is not None
        if not hit:
            mine.put(key, True, now, 100)
        assert hit == plain.access(key, now, 100)
        assert list(mine.entries) == [r["k"] for r in plain.rows] and len(mine.entries) <= capacity


def accesses(spark, n=400):
    rows = [(i, START + timedelta(seconds=37 * i % 5000 + i), f"k{i * i % 23}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "seq long, ts timestamp, key string")


def test_replays(spark):
    rows, df = accesses(spark)
    expires, want = {}, {}
    for seq, ts, key in sorted(rows, key=lambda r: (r[1], r[0])):
        want[seq] = key in expires and ts <= expires[key]
        if not want[seq]:
            expires[key] = ts + timedelta(seconds=600)
    got = cache.replay_ttl(df.repartition(3), 600.0)
    assert {r.seq: r.hit for r in got.collect()} == want
    routed = ring.route(df, ring.build_ring(spark, ["a", "b"]))
    caches, hits = {}, {}
    for r in sorted(routed.collect(), key=lambda r: (r.ts, r.seq)):
        own = caches.setdefault(r.node, PlainCache(5))
        hits[r.seq] = own.access(r.key, (r.ts - START).total_seconds(), 600.0)
    replay = cache.replay_cache(routed, 5, 600.0)
    assert {r.seq: r.hit for r in replay.collect()} == hits
    stats = cache.cache_stats(replay).first()
    assert stats.hits == sum(hits.values()) and stats.hits + stats.misses == 400
    assert {r.node: r.entries for r in cache.shard_stats(replay).collect()} == {n: len(c.rows) for n, c in caches.items()}
    assert cache.cache_stats(replay.limit(0)).first().hit_rate == 0
    assert cache.recency(df).orderBy("recency").first().last_seq == 399


def test_log(spark):
    at = lambda s: START + timedelta(seconds=s)
    rows = [
        ("n", 1, at(0), "get", "a", None, None), ("n", 2, at(1), "put", "a", "x", None), ("n", 3, at(2), "get", "a", None, None), ("n", 4, at(12), "get", "a", None, None),
        ("n", 5, at(13), "put", "b", None, 0.0), ("n", 6, at(14), "get", "b", None, None), ("n", 7, at(15), "put", "c", "y", -1.0), ("n", 8, at(16), "put", "d", "z", None),
        ("n", 9, at(999), "get", "c", None, None), ("n", 10, at(1000), "delete", "c", None, None), ("n", 11, at(1001), "delete", "c", None, None), ("n", 12, at(1002), "clear", None, None, None),
        ("m", 13, at(0), "put", "a", "1", None), ("m", 14, at(1), "put", "a", "2", None), ("m", 15, at(2), "get", "a", None, None),
    ]
    df = spark.createDataFrame(rows, "node string, seq long, ts timestamp, op string, key string, value string, ttl double")
    got = {r.seq: r for r in cache.replay_log(df.repartition(3), 2, 10.0).collect()}
    assert [got[i].hit for i in (1, 3, 4, 6, 9, 15)] == [False, True, False, False, True, True]
    assert got[3].value == "x" and got[9].value == "y" and got[15].value == "2"
    assert got[8].removed == "b" and got[8].size == 2 and got[10].removed == "c" and got[11].removed is None
    assert (got[11].hits, got[11].misses, got[11].evictions) == (2, 3, 1)
    assert (got[12].hits, got[12].misses, got[12].evictions, got[12].size) == (0, 0, 1, 0)
    with pytest.raises(Exception, match="no such operation"):
        cache.replay_log(df.withColumn("op", F.lit("peek")), 2, None).collect()


def test_semantic(spark):
    entries = [(1, "a", "ka", [1.0, 0.0]), (2, "b", "kb", [1.0, 0.0]), (3, "c", "kc", [0.0, 0.0]), (4, "d", "kd", [0.6, 0.8])]
    e = spark.createDataFrame(entries, "seq long, entry_id string, key string, vector array<double>")
    assert sorted(r.seq for r in cache.semantic_fifo(e, 2).collect()) == [2, 4]
    probes = [(1, "kd", [0.0, 1.0]), (2, "x", [2.0, 0.0]), (3, "y", [-1.0, 0.0]), (4, "z", [0.0, 0.0]), (5, "w", [0.88, math.sqrt(1 - 0.88**2)])]
    p = spark.createDataFrame(probes, "probe_id long, key string, vector array<double>")
    got = {r.probe_id: (r.entry_id, round(r.similarity, 6), r.hit_type) for r in cache.semantic_lookup(e, p, 0.88).collect()}
    assert got[1] == ("d", 1.0, "exact") and got[2] == ("a", 1.0, "semantic") and got[3][2] == got[4][2] == "miss"
    assert got[5][0] == "d" and got[5][2] == "semantic"
    log = [("s", 1, START, "q1", [1.0, 0.0]), ("s", 2, START + timedelta(seconds=1), "q2", [1.0, 0.1]), ("s", 3, START + timedelta(seconds=2), "q1", [0.0, 1.0]),
           ("s", 4, START + timedelta(seconds=3), "q3", [0.0, 0.0]), ("s", 5, START + timedelta(seconds=50), "q4", [1.0, 0.0]), ("t", 6, START, "q1", [1.0, 0.0])]
    df = spark.createDataFrame(log, "scope string, seq long, ts timestamp, key string, vector array<double>")
    assert [r.hit_type for r in cache.replay_semantic(df, ttl=10).orderBy("seq").collect()] == ["miss", "semantic", "exact", "miss", "miss", "miss"]


def test_semantic_operations(spark):
    at = lambda s: START + timedelta(seconds=s)
    x, near, y = [1.0, 0.0], [1.0, 0.1], [0.0, 1.0]
    rows = [
        ("s", 1, at(0), "put", "a", x, None), ("s", 2, at(1), "ask", "b", near, None), ("s", 3, at(20), "get", "a", None, None), ("s", 4, at(21), "ask", "a", x, None),
        ("s", 5, at(22), "delete", "a", None, None), ("s", 6, at(23), "ask", "b", near, 5.0), ("s", 7, at(30), "ask", "c", x, 0.0), ("s", 8, at(31), "clear", None, None, None),
        ("s", 9, at(32), "ask", "c", x, None), ("s", 10, at(33), "ask", "d", None, None), ("s", 11, at(34), "ask", "e", y, None), ("s", 12, at(35), "ask", "f", y, None),
    ]
    df = spark.createDataFrame(rows, "scope string, seq long, ts timestamp, op string, key string, vector array<double>, ttl double")
    replay = cache.replay_semantic(df.repartition(2), capacity=2, default_ttl=10.0, nodes=["p", "q"], shard_capacity=8)
    got = {r.seq: r for r in replay.collect()}
    # The shards' entry dies by the default lifetime; the list's has none, and is found though its key is a's own.
    assert [got[i].hit_type for i in range(1, 13)] == [None, "semantic", "miss", "semantic", None, "miss", "miss", None, "miss", "miss", "miss", "semantic"]
    assert got[5].semantic_entries == 0 and got[7].semantic_entries == 1 and (got[8].size, got[8].epoch, got[8].hits, got[8].misses) == (0, 1, 0, 0)
    stats = cache.semantic_stats(replay, ["p", "q"], 8).first()
    assert (stats.size, stats.hits, stats.misses, stats.semantic_hits, stats.semantic_entries, stats.epoch, stats.capacity, stats.num_partitions, stats.hit_rate) == (3, 1, 3, 1, 2, 1, 16, 2, 0.25)
    with pytest.raises(Exception, match="no such operation"):
        cache.replay_semantic(df.withColumn("op", F.lit("peek"))).collect()


def test_null_and_long_keys(spark):
    long_ = 2**60
    rows = [(None, i, START) for i in range(4)] + [(long_ + i % 2, 10 + i, START) for i in range(6)]
    got = ratelimit.rate_limit(spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp"), 2.0, 1.0, "user_id", "event_id").collect()
    assert {r.event_id for r in got if r.admitted} == {0, 1, 10, 11, 12, 13} and {r.user_id for r in got} == {None, long_, long_ + 1}


def test_waiting_requests(spark):
    seconds = [0, 0, 0, 0, 1, 1, 9]
    rows = [(1, i, START + timedelta(seconds=s)) for i, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")
    got = ratelimit.rate_limit(df, 2.0, 1.0, "user_id", "event_id", timeout=2.0).orderBy("event_id").collect()
    at = [None if r.admitted_ts is None else (r.admitted_ts - START).total_seconds() for r in got]
    # Two fit at once, two wait for a second each; of those at 1 one waits two seconds, the next would wait for three.
    assert at == [0, 0, 1, 2, 3, None, 9] and [r.admitted for r in got] == [a is not None for a in at]
    none = ratelimit.rate_limit(df, 2.0, 1.0, "user_id", "event_id").orderBy("event_id").collect()
    assert [r.admitted for r in none] == [True, True, False, False, True, False, True]
    with pytest.raises(ValueError):
        ratelimit.rate_limit(df, 2.0, 1.0, "user_id", "event_id", timeout=-1.0)


def test_bucket():
    b = Bucket(3, 1)
    assert [b.admit(0), b.admit(0), b.admit(0), b.admit(0)] == [True, True, True, False]
    assert b.admit(0.5) is False and b.admit(1.0) is True and b.level == 3
    assert b.admit(100, 3) and b.level == 3
    for bad in (0, -1, 4):
        with pytest.raises(ValueError):
            b.admit(101, bad)
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            Bucket(*bad)


def requests(spark):
    rows = [(u, 10 * i + u, START + timedelta(seconds=(i * 7) % 90 + i)) for i in range(60) for u in range(4)]
    return rows, spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")


def test_rate_limit_batch_and_stream(spark, tmp_path):
    rows, df = requests(spark)
    buckets, want = {}, {}
    for user, event, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        want[event] = buckets.setdefault(user, Bucket(3, 0.2)).admit((ts - START).total_seconds())
    assert {r.event_id: r.admitted for r in ratelimit.rate_limit(df.repartition(3), 3.0, 0.2, "user_id", "event_id").collect()} == want
    df.orderBy("ts", "event_id").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = jobs.stream_rate_limit(stream, 3.0, 0.2).writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.event_id: r.admitted for r in spark.table("limited").collect()} == want


def test_stream_cache_over_two_batches(spark, tmp_path):
    rows, df = accesses(spark, 200)
    ordered = df.orderBy("ts", "seq").withColumn("n", F.monotonically_increasing_id())
    want = {r.seq: r.hit for r in cache.replay_ttl(df, 600.0).collect()}
    middle = sorted(r[1] for r in rows)[100]
    ordered.where(F.col("ts") < F.lit(middle)).drop("n").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = jobs.stream_ttl_cache(stream, 600.0).writeStream.format("memory").queryName("cached").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
    q.processAllAvailable()
    ordered.where(F.col("ts") >= F.lit(middle)).drop("n").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q.processAllAvailable()
    q.stop()
    assert {r.seq: r.hit for r in spark.table("cached").collect()} == want


def test_stream_of_documents(spark, tmp_path):
    schema = "doc_id string, text string"
    spark.createDataFrame([("a", "one\n\ntwo"), ("b", "x")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    run = lambda: jobs.stream_chunks(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    run()
    spark.createDataFrame([("a", "three")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    run()
    assert sorted((r.chunk_id, r.chunk_text) for r in jobs.current_chunks(spark, f"{tmp_path}/out").collect()) == [("a::chunk::0", "three"), ("b::chunk::0", "x")]


def test_stream_of_an_index(spark, tmp_path):
    schema = "doc_id string, seq long, text string"
    spark.createDataFrame([("a", 1, "warm milk\n\ncats"), ("a", 0, "zebra old"), ("b", 1, "dogs and cats"), ("c", 1, "gone soon")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    run = lambda: jobs.stream_index(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/out", f"{tmp_path}/c", "seq").awaitTermination()
    run()
    spark.createDataFrame([("b", 2, "cold milk"), ("c", 2, None)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    run()
    kept = jobs.current_index(spark, f"{tmp_path}/out")
    queries = spark.createDataFrame([(0, "cats milk zebra"), (1, "gone")], "query_id long, query string")
    chunks = spark.createDataFrame([("a::chunk::0", "warm milk"), ("a::chunk::1", "cats"), ("b::chunk::0", "cold milk")], "chunk_id string, chunk_text string")
    rows = lambda df: sorted((r.query_id, r["rank"], r.unit_id, round(r.score, 9)) for r in df.collect())
    assert rows(search.search_index(kept, queries)) == rows(search.keyword_search(chunks, queries)) and kept.corpus.first().n_units == 3


def test_store(spark):
    docs = spark.createDataFrame([("a", "one\n\ntwo\n\nthree"), ("b", "alpha beta"), (" ", "x"), ("c", " \n"), (None, "y")], "doc_id string, text string")
    assert store.rejected(docs).count() == 3
    assert sorted((r.doc_id, r.chunks) for r in store.ingest_report(docs).collect()) == [("a", 3), ("b", 1)]
    s = store.ingest(docs)
    again = store.ingest(spark.createDataFrame([("b", "gamma\n\ndelta")], "doc_id string, text string"), s)
    assert sorted(r.chunk_text for r in again.chunks.where("doc_id = 'b'").collect()) == ["delta", "gamma"]
    after, counts = store.update(s, spark.createDataFrame([("a", "zero\n\none\n\ntwos"), ("zz", "q")], "doc_id string, new_text string"))
    assert [tuple(r) for r in counts.collect()] == [("a", 1, 1, 1)]
    want = store.ingest(spark.createDataFrame([("a", "zero\n\none\n\ntwos"), ("b", "alpha beta")], "doc_id string, text string"))
    rows = lambda x: sorted((r.chunk_id, r.chunk_text, [round(v, 6) for v in r.vector]) for r in x.chunks.collect())
    assert rows(after) == rows(want)
    assert [r.doc_id for r in store.unknown(s, spark.createDataFrame([("zz",), ("a",)], "doc_id string")).collect()] == ["zz"]
    gone = store.delete(s, spark.createDataFrame([("a",)], "doc_id string"))
    assert gone.documents.count() == 1 and gone.chunks.count() == 1 and store.health(gone).first().docs_indexed == 1


def test_answer_with_cache(spark):
    s = store.ingest(spark.createDataFrame([("a", "cats drink milk"), ("b", "dogs chew bones")], "doc_id string, text string"))
    queries = spark.createDataFrame([(1, "who drinks milk"), (2, "what do dogs chew"), (3, " ")], "query_id long, query string")
    plain, none = store.answer(s, queries, "hybrid", 1)
    got = {r.query_id: r for r in plain.collect()}
    assert none is None and set(got) == {1, 2} and got[1].sources[0].doc_id == "a" and got[2].sources[0].chunk_text == "dogs chew bones" and not got[1].cached
    key = spark.range(1).select(cache_key(F.lit("who drinks milk"), F.lit("hybrid"), F.lit(1)).alias("k")).first().k
    kept = [(1, "e1", key, "who drinks milk", "cats", "m", [("a", "cats drink milk", 0.5, "hybrid")])]
    schema = f"seq long, entry_id string, key string, q string, answer string, model_used string, sources {store.SOURCES}"
    entries = store.embed(spark.createDataFrame(kept, schema), "q")
    cached, new = store.answer(s, queries, "hybrid", 1, cache=entries)
    got = {r.query_id: r for r in cached.collect()}
    assert (got[1].answer, got[1].cached, got[1].model_used, got[1].sources[0].doc_id) == ("cats", True, "m", "a") and not got[2].cached
    added = new.collect()
    assert len(added) == 1 and added[0].model_used == "echo" and added[0].sources[0].chunk_text == "dogs chew bones"
    # Another number of hits is another key: the entry is found by its vector.
    like, _ = store.answer(s, queries.where("query_id = 1"), "hybrid", 2, cache=entries)
    assert [(r.answer, r.model_used) for r in like.collect()] == [("cats", "m (semantic: 100%)")]


def test_embed_counts_words_and_passes_columns(spark):
    texts = ["warm milk warm", "", "A b"]
    rows = spark.createDataFrame([(i, [t], t) for i, t in enumerate(texts)], "id int, parts array<string>, t string")
    found = store.embed(rows, "t")
    assert "ArrowEvalPython" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "MapInArrow" in plan
    got = {r.id: r for r in found.collect()}
    one = store.hashing_embedder(["warm"])[0]
    assert [got[i].parts for i in range(3)] == [[t] for t in texts] and set(got[1].vector) == {0.0}
    both = 2 * one + store.hashing_embedder(["milk"])[0]
    assert got[0].vector == pytest.approx((both / np.linalg.norm(both)).tolist(), abs=1e-6)


def test_entries_of_a_semantic_cache_lie_in_one_matrix():
    rng = np.random.default_rng(3)
    made = cache.SemanticCache(["a"], 64, None, 0.9, 5, True, 10)
    vectors, live = rng.normal(size=(40, 6)), []
    for i, v in enumerate(vectors):
        near = max((float(x / np.linalg.norm(x) @ v / np.linalg.norm(v)) for _, x, end in live if i <= end), default=-1.0)
        kind, similarity = made.get_like(f"new {i}", v, float(i))
        assert (kind == "semantic") == (near >= 0.9) and (kind == "miss" or similarity == pytest.approx(near))
        life = 3.0 if i % 4 == 0 else None
        made.put(f"k{i}", float(i), life, v if i % 3 else vectors[0])
        live = [e for e in live if i <= e[2]][-4:] + [(f"k{i}", v if i % 3 else vectors[0], i + life if life else math.inf)]
        if i % 7 == 6:
            made.delete(f"k{i}")
            live = live[:-1]
        assert len(made.near) == len(live) and made.rows.shape[0] == 5
