"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors are dealt to overlapping shards around centroids. Each shard builds a flat graph:
nearest candidates, thinned by robust pruning, so that edges lead in all directions.
The shards' adjacency lists are united. In each shard, every vector is searched for
greedily from the medoid along the united lists; once the walk settles, it expands
over all that lies in range. Pairs are verified in double precision, and the recall
of a fixed set of queries is audited against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvanta.llm.columns import random_key
from corvanta.llm.components import connected_components
from corvanta.workspace import Workspace

#: Vectors of a shard, on average, before overlap.
SHARD = 1000
#: Shards of each vector: its nearest ones.
OVERLAP = 3
#: Edges that robust pruning keeps in a shard, from so many nearest candidates.
DEGREE = 24
POOL = 64
#: Nearest neighbours of a row that get an edge back to it.
BACK = 3
#: Pruning drops a candidate that a kept one is nearer to, by this factor of distance.
ALPHA = 1.2
#: Best nodes that a greedy walk holds.
BEAM = 32
#: Vectors that centroids are fitted on: so many for each centroid, and in all. Every vector is indexed.
FIT_PER_CENTROID = 32
FIT_ROWS = 65_536
#: Centroids at most; beyond SHARD times as many vectors, shards grow.
CENTROIDS = 8192
#: Rows above which a shard finds its nearest candidates in overlapping cells of its own.
LOCAL = 4096
#: Queries of the audit.
AUDIT = 200


def unit_rows(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which of ``vectors`` have one."""
    dim = max((len(v) for v in vectors if v is not None), default=0)
    out = np.zeros((len(vectors), dim))
    ok = np.zeros(len(vectors), dtype=bool)
    for i, v in enumerate(vectors):
        if v is None or len(v) == 0:
            continue
        x = np.array(v, dtype=np.float64)
        if np.isfinite(x).all() and (x != 0).any():
            x = x / np.abs(x).max()
            out[i, : len(x)] = x / np.linalg.norm(x)
            ok[i] = True
    return out, ok


def fit_centroids(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.maximum(norms, 1e-300), c)
    return c


class Router:
    """Nearest centroids of vectors, through coarse centroids when there are many."""

    def __init__(self, centroids: np.ndarray):
        self.fine = centroids
        n = int(np.sqrt(len(centroids)))
        self.coarse = fit_centroids(centroids, n) if n > 16 else None
        if self.coarse is not None:
            owner = (centroids @ self.coarse.T).argmax(axis=1)
            self.members = [np.flatnonzero(owner == i) for i in range(len(self.coarse))]

    def nearest(self, x: np.ndarray, m: int) -> np.ndarray:
        """The m nearest centroids of each row; of the 8 nearest coarse cells if there are any."""
        m = min(m, len(self.fine))
        if self.coarse is None:
            return np.argsort(-(x @ self.fine.T), axis=1, kind="stable")[:, :m]
        out = np.empty((len(x), m), dtype=np.int64)
        cells = np.argsort(-(x @ self.coarse.T), axis=1, kind="stable")[:, :8]
        for i, row in enumerate(cells):
            own = np.concatenate([self.members[c] for c in row])
            if len(own) < m:
                own = np.arange(len(self.fine))
            out[i] = own[np.argsort(-(self.fine[own] @ x[i]), kind="stable")[:m]]
        return out


def robust_prune(x: np.ndarray, pools: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours kept of each row's pool, nearest first; both are padded with -1."""
    n, width = pools.shape
    kept = np.full((n, degree), -1)
    for s in range(0, n, 256):
        pool = pools[s : s + 256]
        near = x[pool]  # rows, pool, dimensions
        to_row = np.where(pool >= 0, 1 - np.einsum("npd,nd->np", near, x[s : s + len(pool)]), np.inf)
        alive = pool >= 0
        for j in range(degree):
            first = np.where(alive, to_row, np.inf).argmin(axis=1)
            rows = np.flatnonzero(alive.any(axis=1))
            if not len(rows):
                break
            chosen = first[rows]
            kept[s + rows, j] = pool[rows, chosen]
            between = 1 - np.einsum("npd,nd->np", near[rows], near[rows, chosen])
            # Squared distances of unit vectors are 2 (1 - cosine); alpha is a factor of distance.
            alive[rows] &= alpha**2 * between > to_row[rows]
            alive[rows, chosen] = False
    return kept


def nearest_pools(x: np.ndarray, rows: np.ndarray, among: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` nearest of rows ``among`` for each of ``rows``, nearest first, without the row itself; padded with -1."""
    out = np.full((len(rows), width), -1)
    take = min(width, len(among) - 1)
    if take < 1:
        return out
    for s in range(0, len(rows), 512):
        own = rows[s : s + 512]
        near = x[own] @ x[among].T
        near[own[:, None] == among[None, :]] = -np.inf
        top = np.argpartition(-near, take - 1, axis=1)[:, :take]
        order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
        out[s : s + 512, :take] = among[np.take_along_axis(top, order, axis=1)]
    return out


def shard_graph(x: np.ndarray) -> np.ndarray:
    """The edges of each row: its robust-pruned neighbours, and the ways back to it.

    Candidates are the nearest among all rows; in a shard of more than LOCAL rows,
    among those of its two nearest cells.
    """
    n = len(x)
    rows = np.arange(n)
    if n <= LOCAL:
        return with_back_edges(robust_prune(x, nearest_pools(x, rows, rows, min(POOL, n - 1))))
    cells = n // SHARD + 1
    fit = x[np.random.default_rng(n).permutation(n)[: cells * FIT_PER_CENTROID]]
    near = Router(fit_centroids(fit, cells)).nearest(x, 2)
    pools = np.full((n, 2 * POOL), -1)
    for cell in range(near.max() + 1):
        among = np.flatnonzero((near == cell).any(axis=1))
        for slot in range(near.shape[1]):
            own = np.flatnonzero(near[:, slot] == cell)
            pools[own, slot * POOL : (slot + 1) * POOL] = nearest_pools(x, own, among, POOL)
    return with_back_edges(robust_prune(x, pools))


def with_back_edges(kept: np.ndarray, nearest: int = BACK) -> np.ndarray:
    """Edges with a way back from each of a row's ``nearest`` first neighbours, so that every row is reached.

    A row that is near to many gets edges to the first DEGREE of them, these to the
    next, and so on, so that no row has very many edges.
    """
    n = len(kept)
    near = kept[:, :nearest]
    row, hub = np.nonzero(near >= 0)[0], near[near >= 0]
    order = np.argsort(hub, kind="stable")
    row, hub = row[order], hub[order]
    starts = np.searchsorted(hub, hub)
    place = np.arange(len(hub)) - starts
    parent = np.where(place < DEGREE, hub, row[starts + np.maximum(place // DEGREE - 1, 0)])
    pairs = np.concatenate([np.nonzero(kept >= 0)[0] * n + kept[kept >= 0], parent * n + row])
    pairs = np.unique(pairs[pairs // n != pairs % n])
    start, end = pairs // n, pairs % n
    counts = np.bincount(start, minlength=n)
    out = np.full((n, counts.max(initial=1)), -1)
    out[start, np.arange(len(start)) - np.repeat(np.cumsum(counts) - counts, counts)] = end
    return out


def range_search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) with cosine >= least that greedy walks from the medoid reach.

    ``edges`` are neighbours by row, padded with -1. The walks of a block of queries
    advance together: each expands the best node of its beam that it has not expanded;
    once none is left, all nodes in range are expanded until no new one is in range.
    """
    n = len(x)
    medoid = int((x @ x.mean(axis=0)).argmax())
    found_q, found_r = [], []
    block = max(8, min(256, (1 << 25) // n))
    for s in range(0, len(queries), block):
        own = queries[s : s + block]
        q = x[own]
        m = len(own)
        rows = np.arange(m)
        cosine = np.full((m, n), -np.inf)
        opened = np.zeros((m, n), dtype=bool)
        beam = np.full((m, BEAM), -1)
        value = np.full((m, BEAM), -np.inf)
        beam[:, 0] = medoid
        value[:, 0] = cosine[:, medoid] = q @ x[medoid]
        while True:
            fresh = (beam >= 0) & ~opened[rows[:, None], beam]
            go = rows[fresh.any(axis=1)]
            if not len(go):
                break
            at = beam[go, fresh[go].argmax(axis=1)]
            opened[go, at] = True
            next_ = edges[at]
            new = (next_ >= 0) & np.isneginf(cosine[go[:, None], next_])
            near = np.where(new, np.einsum("nkd,nd->nk", x[next_], q[go]), -np.inf)
            r, k = np.nonzero(new)
            cosine[go[r], next_[r, k]] = near[r, k]
            # A node may stand twice in a list; beams keep its first place.
            every = np.concatenate([beam[go], np.where(new, next_, -1)], axis=1)
            scores = np.concatenate([value[go], near], axis=1)
            order = np.argsort(-scores, axis=1, kind="stable")[:, :BEAM]
            beam[go], value[go] = np.take_along_axis(every, order, axis=1), np.take_along_axis(scores, order, axis=1)
        frontier = (cosine >= least) & ~opened
        while frontier.any():
            r, at = np.nonzero(frontier)
            opened[r, at] = True
            frontier = np.zeros_like(opened)
            for part in range(0, len(r), 1 << 15):
                rp, next_ = r[part : part + (1 << 15)], edges[at[part : part + (1 << 15)]]
                i, k = np.nonzero((next_ >= 0) & np.isneginf(cosine[rp[:, None], next_]))
                a, b = rp[i], next_[i, k]
                cosine[a, b] = np.einsum("nd,nd->n", q[a], x[b])
                hit = cosine[a, b] >= least
                frontier[a[hit], b[hit]] = True
            frontier &= ~opened
        r, at = np.nonzero(cosine >= least)
        found_q.append(own[r])
        found_r.append(at)
    return np.concatenate([*found_q, np.empty(0, np.int64)]), np.concatenate([*found_r, np.empty(0, np.int64)])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, ok = unit_rows(batch.column("vector").to_pylist())
        unit = [x[i].tobytes() if ok[i] else None for i in range(len(x))]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(unit, pa.binary())], ["vec_id", "unit"])


def _router(centroids: np.ndarray, shards: int):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = Router(centroids)
        for batch in batches:
            if not batch.num_rows:
                continue
            near = router.nearest(_matrix(batch.column("unit").to_pylist()), shards)
            at = np.repeat(np.arange(len(near)), near.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(near.ravel()), batch.column("node").take(pa.array(at)), batch.column("unit").take(pa.array(at))], ["shard", "node", "unit"]
            )

    return route


def _builder(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("node", kind="stable").drop_duplicates("node")
    nodes = part["node"].to_numpy()
    if len(nodes) < 2:
        return pd.DataFrame({"node": nodes, "edges": [[]] * len(nodes)})
    kept = shard_graph(_matrix(part["unit"]))
    return pd.DataFrame({"node": nodes, "edges": [nodes[k[k >= 0]] for k in kept]})


def _searcher(least: float):
    def search(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node", kind="stable").drop_duplicates("node")
        nodes, x = part["node"].to_numpy(), _matrix(part["unit"])
        lists = [np.asarray(e, dtype=np.int64) for e in part["edges"]]
        width = max((len(e) for e in lists), default=0)
        if len(nodes) < 2 or not width:
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        edges = np.full((len(nodes), width), -1)
        for i, e in enumerate(lists):
            at = np.searchsorted(nodes, e)
            at[at == len(nodes)] = 0
            at = at[nodes[at] == e]
            edges[i, : len(at)] = at
        q, r = range_search(x, edges, np.arange(len(nodes)), least)
        keep = q != r
        a, b = np.minimum(q[keep], r[keep]), np.maximum(q[keep], r[keep])
        pairs = np.unique(a * len(nodes) + b)
        return pd.DataFrame({"a": nodes[pairs // len(nodes)], "b": nodes[pairs % len(nodes)]})

    return search


def _auditor(queries: np.ndarray, ids: np.ndarray, least: float):
    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = _matrix(batch.column("unit").to_pylist()) @ queries.T >= least
            at, q = np.nonzero(near)
            node = np.asarray(batch.column("node"))[at]
            keep = node != ids[q]
            a, b = np.minimum(node, ids[q])[keep], np.maximum(node, ids[q])[keep]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return audit


def near_vectors(df: DataFrame, least: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding", overlap: int = OVERLAP, target_recall: float = 0.95) -> DataFrame:
    """Links of vectors with cosine >= ``least``, and the components they make.

    Returns a row for each row of ``df``: vec_id, n_links (other rows linked directly),
    component_id (smallest vec_id that links reach, its own included), kept (vec_id is
    component_id) and recall (share of the audit's true links that were found; null
    without any). If the audit finds less than ``target_recall``, the search is run
    again with twice the overlap, until it does or every shard holds all.

    Vectors that are null, empty, zero, or hold null, NaN or infinite components link
    with nothing. Equal unit vectors are searched for once and linked with each other.
    Shorter vectors count as if zeros followed. Rows with equal ids are told apart only
    by their vectors; null ids are counted in n_links, but never name a component. An
    empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "vectors")
    kind = df.schema[vector].dataType
    if not isinstance(kind, T.ArrayType):
        raise ValueError(f"{vector} is not an array column")
    dim = df.agg(F.max(F.size(vector))).first()[0] or 0
    padded = F.when(F.size(vector) < dim, F.concat(F.col(vector), F.array_repeat(F.lit(0).cast(kind.elementType), F.lit(dim) - F.size(vector)))).otherwise(F.col(vector))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), padded.alias("vector"))
    units = ws.save(rows.mapInArrow(_units, "vec_id long, unit binary").withColumn("node", F.xxhash64("unit")), "units")
    usable = units.where("unit is not null")
    nodes = ws.save(usable.groupBy("node").agg(F.min("unit").alias("unit"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")), "nodes")
    n = nodes.count()

    def alone(recall: float | None) -> DataFrame:
        return units.where("unit is null").select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(recall).cast("double").alias("recall")
        )

    if n == 0:
        return alone(None)
    k = min(-(-n // SHARD), CENTROIDS)
    sample = nodes.select("node", "unit", random_key(F.col("node"), 5).alias("key")).orderBy("key", "node").limit(min(k * FIT_PER_CENTROID, FIT_ROWS))
    centroids = fit_centroids(_matrix(sample.toArrow().column("unit").to_pylist()), k)
    audited = nodes.select("node", "unit", random_key(F.col("node"), 6).alias("key")).orderBy("key", "node").limit(AUDIT).toArrow()
    queries, ids = _matrix(audited.column("unit").to_pylist()), np.asarray(audited.column("node"))
    truth = ws.save(nodes.select("node", "unit").mapInArrow(_auditor(queries, ids, least), "a long, b long").distinct(), "truth")
    true_links = truth.count()
    turn = 0
    while True:
        dealt = ws.save(nodes.select("node", "unit").mapInArrow(_router(centroids, overlap), "shard long, node long, unit binary"), f"dealt-{turn}")
        built = dealt.groupBy("shard").applyInPandas(_builder, "node long, edges array<long>")
        graph = ws.save(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges")), f"graph-{turn}")
        found = dealt.join(graph, "node").groupBy("shard").applyInPandas(_searcher(least), "a long, b long")
        links = ws.save(found.distinct(), f"links-{turn}")
        recall = links.join(truth, ["a", "b"], "left_semi").count() / true_links if true_links else None
        if recall is None or recall >= target_recall or overlap >= k:
            break
        turn, overlap = turn + 1, min(k, overlap * 2)
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    weights = nodes.select(F.col("node").alias("b"), "copies")
    degree = both.join(weights, "b").groupBy("a").agg(F.sum("copies").alias("others"))
    joined = connected_components(links)
    named = nodes.join(degree, nodes["node"] == degree["a"], "left").join(joined.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left")
    named = ws.save(named.select("node", "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")), "named")
    tops = named.groupBy("component").agg(F.min("least").alias("component_id"))
    marks = named.join(tops, "component").select("node", "n_links", "component_id")
    own = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    linked = usable.join(marks, "node").select("vec_id", "n_links", "component_id", own.alias("kept"), F.lit(recall).cast("double").alias("recall"))
    return linked.union(alone(recall))
