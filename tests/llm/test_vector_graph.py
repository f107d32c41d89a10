import numpy as np
import pytest

from corvanta.llm.vector_graph import Router, near_vectors, range_search, robust_prune, shard_graph
from tests.llm.test_components import brute as components_of


def rows_of(rng, n=300, dim=16):
    x = rng.normal(size=(n, dim))
    out = [(i, x[i].tolist()) for i in range(n)]
    for k in range(6):  # groups of near copies
        for j in range(3 + 4 * k):
            out.append((1000 + 100 * k + j, (x[k] + rng.normal(size=dim) * 0.05).tolist()))
    out += [(2000, x[9].tolist()), (2001, (2 * x[9]).tolist()), (2000, x[9].tolist())]
    return out


def test_like_brute_force(spark):
    rows = rows_of(np.random.default_rng(1))
    odd = [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [float("inf")] + [0.0] * 15), (3004, [None] + [1.0] * 15), (3005, []), (None, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], "vec_id long, embedding array<double>, node int, unit int")
    got = near_vectors(df).collect()
    assert len(got) == len(rows) + len(odd)
    use = rows + [odd[-1]]
    x = np.array([v for _, v in use])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    root = components_of([(i, j) for i, j in zip(*np.nonzero(near), strict=True)])
    least = {}
    for i, (v, _) in enumerate(use):
        if v is not None:
            least[root[i]] = min(v, least.get(root[i], v))
    want = sorted(((v, int(near[i].sum()) - 1, least[root[i]]) for i, (v, _) in enumerate(use)), key=repr)
    have = sorted(((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is None or r.vec_id < 3000), key=repr)
    assert sum(a == b for a, b in zip(want, have, strict=True)) >= 0.97 * len(want)
    alone = [r for r in got if r.vec_id is not None and r.vec_id >= 3000]
    assert len(alone) == 6 and all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in alone)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("local", [4096, 200])
def test_graph_reaches_what_brute_force_finds(monkeypatch, local):
    monkeypatch.setattr("corvanta.llm.vector_graph.LOCAL", local)  # with cells of its own
    monkeypatch.setattr("corvanta.llm.vector_graph.SHARD", 150)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 12))
    x[100:160] = x[0] + rng.normal(size=(60, 12)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges = shard_graph(x)
    q, r = range_search(x, edges, np.arange(500), 0.95)
    assert ((x[q] * x[r]).sum(axis=1) >= 0.95 - 1e-12).all()
    assert len(set(zip(q, r, strict=True))) >= 0.99 * (x @ x.T >= 0.95).sum()
    pools = np.argsort(-(x @ x.T), axis=1)[:, 1:40]
    assert (robust_prune(x, pools, degree=4)[:, 0] == pools[:, 0]).all()
    many = rng.normal(size=(400, 12))
    found = Router(many).nearest(x, 3)
    assert (found[:, 0] == (x @ many.T).argmax(axis=1)).mean() > 0.8


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors(df).columns == ["vec_id", "n_links", "component_id", "kept", "recall"]
    assert near_vectors(df).count() == 0
    one = spark.createDataFrame([(7, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:4] for r in near_vectors(one).collect()] == [(7, 0, 7, True)]
