import random

import numpy as np
import pytest

from corvanta.llm.ngram_join import ngram_components
from corvanta.llm.signature_tree import bitmap, folded, needed, spanning_links, with_partner, with_partner_sized
from tests.llm.corpus import SCHEMA, documents
from tests.llm.test_components import brute as components_of


def sets_of(text):
    own = (text or "").encode().lower().split()
    return frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else frozenset()


def brute(rows):
    sets = [sets_of(r[1]) for r in rows]
    links = [(i, i) for i in range(len(rows))]
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * len(sets[i] | sets[j]):
                links.append((j, i))
    root = components_of(links)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(r[0], least.get(root[i], r[0]))
    return sorted(((r[0], len(sets[i]), least.get(root[i])) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("block", [None, 4])
def test_like_brute_force(spark, monkeypatch, block):
    if block:  # hot groups and large areas become pairs of blocks
        monkeypatch.setattr("corvanta.llm.ngram_join.BLOCK", block)
        monkeypatch.setattr("corvanta.llm.ngram_join.AREA_WEIGHT", 100 * block)
        monkeypatch.setattr("corvanta.llm.ngram_join.BROADCAST_ROWS", 0)
    rng = random.Random(5)
    rows = documents()
    base = [f"b{i}" for i in range(60)]
    for i in range(25):  # a chain of near copies, each some words from the one before
        base = base[:]
        base[rng.randrange(60)] = f"c{i}"
        rows.append((1000 + i, " ".join(base), "en", "s", 1))
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", grp string, component long")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(df).collect()), key=repr)
    assert got == brute(rows)


def test_empty_table(spark):
    out = ngram_components(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and out.count() == 0


@pytest.mark.parametrize("many", [0, 1 << 30])
def test_tree_prunes_nothing_that_links(monkeypatch, many):
    monkeypatch.setattr("corvanta.llm.signature_tree.MANY", many)
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        own = np.unique(rng.integers(0, 1 << 60, rng.integers(1, 1500), dtype=np.uint64))
        sets.append(own)
        kept = own[rng.random(len(own)) < 0.93]
        if len(kept):
            sets.append(kept)
    sizes = np.array([len(s) for s in sets])
    share = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= needed(int(sizes[i] + sizes[j]), 80)
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if share(i, j)]
    one = with_partner(sizes, np.array([bitmap(s) for s in sets]), 80)
    two = with_partner_sized(sizes, [bitmap(s, 8 if len(s) <= 512 else 32) for s in sets], 80)
    for i, j in linked:
        assert one[i] and one[j] and two[i] and two[j]
    every = [(i, i) for i in range(len(sets))]
    assert components_of(spanning_links(sets, 80) + every) == components_of(linked + every)


def test_folded_bitmaps():
    tokens = np.arange(0, 5000, 7, dtype=np.uint64)
    assert (folded(bitmap(tokens, 64)[None, :], 8)[0] == bitmap(tokens, 8)).all()
