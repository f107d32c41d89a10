import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvanta.llm.sharding import best_fit_decreasing, pack_into, shard_groups
from tests.llm.corpus import SCHEMA, documents


def plain_best_fit(sizes, capacity):
    left, bins = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(room, b) for b, room in enumerate(left) if room >= sizes[i]]
        if fits:
            b = min(fits)[1]
        else:
            b = len(left)
            left.append(max(capacity, sizes[i]))
        left[b] -= sizes[i]
        bins[i] = b
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60), st.integers(1, 90))
def test_tree_is_best_fit(sizes, capacity):
    assert best_fit_decreasing(sizes, capacity) == plain_best_fit(sizes, capacity)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=60), st.integers(1, 9))
def test_pack_into(sizes, shards):
    bins = pack_into(sizes, shards)
    load = defaultdict(int)
    for s, b in zip(sizes, bins, strict=True):
        load[b] += s
    assert max(bins) < shards and max(load.values()) <= sum(sizes) / shards + max(sizes)


def test_shards(spark):
    rows = documents(n=150)
    df = spark.createDataFrame([(*r, 5, 5) for r in rows], SCHEMA + ", shard int, content long")
    got = shard_groups(df, shards=4).collect()
    assert len(got) == len(rows)
    homes, load, slots = defaultdict(set), defaultdict(int), defaultdict(list)
    text = defaultdict(list)
    for r in rows:
        text[r[0]].append(r[1])
    for r in got:
        own = {len((t or "").encode()) + 1: t for t in text[r.doc_id]}[r.size]
        assert r.text_crc32 == (None if own is None else zlib.crc32(own.encode()))
        homes[own].add(r.shard)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(x) == 1 for x in homes.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert len(load) == 4 and max(load.values()) - min(load.values()) < 0.05 * sum(load.values())
    assert sorted(map(repr, got)) == sorted(map(repr, shard_groups(df.repartition(5), shards=4).collect()))


def test_capacity(spark):
    rows = documents(n=150)
    df = spark.createDataFrame(rows, SCHEMA)
    load = defaultdict(int)
    for r in shard_groups(df, capacity=20_000).collect():
        load[r.shard] += r.size
    assert max(load.values()) <= 20_000 and len(load) <= -(-sum(load.values()) // 20_000) + 1


def test_empty_and_bad_parameters(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert shard_groups(empty, shards=8).count() == 0 and shard_groups(empty, capacity=5).count() == 0
    for bad in ({}, {"shards": 0}, {"shards": 2, "capacity": 2}):
        with pytest.raises(ValueError):
            shard_groups(empty, **bad)


def test_one_group_of_a_third_of_the_bytes(spark):
    sizes = [7000, *[10 + i % 7 for i in range(1077)]]
    load = [0] * 8
    for size, bin_ in zip(sizes, pack_into(sizes, 8), strict=True):
        load[bin_] += size
    assert max(load) == 7000 and max(sorted(load)[:7]) - min(load) < 0.05 * max(sorted(load)[:7])
    rows = [(i, "copied " * 20 if i < 300 else f"text {i} " + "x " * (50 + i % 30)) for i in range(1000)]
    load = defaultdict(int)
    for r in shard_groups(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect():
        load[r.shard] += r.size
    others = sorted(load.values())[:7]
    assert set(load) == set(range(8)) and others[-1] - others[0] < 0.05 * others[-1]
