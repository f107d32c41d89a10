"""Signature trees over token sets, and joins of sets by dual traversal.

A node holds the bitwise OR of its sets' token bitmaps, the range of their sizes, and
the most tokens by which a set exceeds its bitmap's bits. Two nodes are compared only
if some pair below them could still overlap enough.
"""

from __future__ import annotations

import numpy as np

#: 64-bit lanes of a short bitmap, and the fewest of one that grows with its set.
LANES = 8
LEAF = 32
FAN = 8
#: Pairs of two leaves above which their overlaps are computed at once, if they have so few tokens.
MANY = 32
MATRIX_TOKENS = 150_000


def bitmap(tokens: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """``lanes`` * 64 bits, of which each token sets one."""
    bits = (tokens % np.uint64(lanes * 64)).astype(np.int64)
    flags = np.zeros(lanes * 64, dtype=np.uint8)
    flags[bits] = 1
    return np.packbits(flags).view(np.uint64)


def lanes_for(size: int) -> int:
    """Lanes of a bitmap that has at least a bit for each token: a power of two."""
    return max(LANES, 1 << max(0, (size - 1) // 64).bit_length())


def folded(bits: np.ndarray, lanes: int) -> np.ndarray:
    """Bitmaps (rows of lanes) as they would be with fewer lanes."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, lanes), axis=1)


def needed(total: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap of two sets with so many tokens in all: 100 i >= p (total - i)."""
    return -(-percent * total // (100 + percent))


class SignatureTree:
    """A tree over sets given by size and bitmap; sets are in order of size."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray):
        self.order = np.lexsort((bitmaps[:, 0], sizes))
        self.sizes = sizes[self.order]
        self.bitmaps = bitmaps[self.order]
        excess = self.sizes - np.bitwise_count(self.bitmaps).sum(axis=1).astype(np.int64)
        starts = np.arange(0, len(sizes), LEAF)
        #: Levels from the leaves up: arrays (ors, least size, largest size, excess) by node.
        self.levels = [
            (np.bitwise_or.reduceat(self.bitmaps, starts), np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts), np.maximum.reduceat(excess, starts))
        ]
        while len(self.levels[-1][0]) > 1:
            ors, low, high, more = self.levels[-1]
            at = np.arange(0, len(ors), FAN)
            self.levels.append((np.bitwise_or.reduceat(ors, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(more, at)))

    def could_overlap(self, level: int, a: int, b: int, percent: int) -> bool:
        """Whether sets below nodes a and b may reach the similarity."""
        ors, low, high, more = self.levels[level]
        if 100 * min(high[a], high[b]) < percent * max(low[a], low[b]):
            return False
        shared = int(np.bitwise_count(ors[a] & ors[b]).sum()) + int(min(more[a], more[b]))
        return min(shared, int(high[a]), int(high[b])) >= needed(int(low[a] + low[b]), percent)

    def leaf_pairs(self, percent: int, skip=None):
        """Pairs of leaves that survive the traversal; skip(first, last) spans may prune more."""
        top = len(self.levels) - 1
        stack = [(top, 0, 0)]
        while stack:
            level, a, b = stack.pop()
            if skip is not None and skip(*self.span(level, a), *self.span(level, b)):
                continue
            if not self.could_overlap(level, a, b, percent):
                continue
            if level == 0:
                yield a, b
                continue
            n = len(self.levels[level - 1][0])
            mine = range(a * FAN, min(n, a * FAN + FAN))
            theirs = range(b * FAN, min(n, b * FAN + FAN))
            stack.extend((level - 1, x, y) for x in reversed(mine) for y in reversed(theirs) if a != b or x <= y)

    def span(self, level: int, node: int) -> tuple[int, int]:
        width = LEAF * FAN**level
        return node * width, min(len(self.sizes), (node + 1) * width)

    def surviving(self, a: int, b: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of set pairs of two leaves whose own bitmaps still allow a link."""
        (s, t), (u, v) = self.span(0, a), self.span(0, b)
        left, right = self.bitmaps[s:t, None], self.bitmaps[None, u:v]
        x, y = self.sizes[s:t, None], self.sizes[None, u:v]
        most = np.minimum(
            x - np.bitwise_count(left & ~right).sum(axis=2).astype(np.int64),
            y - np.bitwise_count(right & ~left).sum(axis=2).astype(np.int64),
        )
        ok = most >= needed(x + y, percent)
        if a == b:
            ok &= np.tri(t - s, k=-1, dtype=bool).T
        i, j = np.nonzero(ok)
        return i + s, j + u


class Forest:
    """Disjoint sets of positions, with an array of roots that is always current."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: int, j: int) -> None:
        a, b = self.root[i], self.root[j]
        self.root[self.root == max(a, b)] = min(a, b)


def with_partner(sizes: np.ndarray, bitmaps: np.ndarray, percent: int) -> np.ndarray:
    """Which sets have any other set that their bitmaps allow to link with."""
    tree = SignatureTree(sizes, bitmaps)
    found = np.zeros(len(sizes), dtype=bool)
    done = lambda s, t, u, v: found[s:t].all() and found[u:v].all()
    for a, b in tree.leaf_pairs(percent, done):
        i, j = tree.surviving(a, b, percent)
        found[i] = True
        found[j] = True
    out = np.zeros(len(sizes), dtype=bool)
    out[tree.order] = found
    return out


def with_partner_sized(sizes: np.ndarray, bitmaps: list[np.ndarray], percent: int) -> np.ndarray:
    """As with_partner, for bitmaps whose lanes grow with their sets, compared at the shorter's lanes."""
    lanes = np.array([len(b) for b in bitmaps])
    found = np.zeros(len(sizes), dtype=bool)
    for own in np.unique(lanes).tolist():
        most = sizes[lanes == own].max()
        at = np.flatnonzero((lanes == own) | ((lanes > own) & (percent * sizes <= 100 * most)))
        if len(at) > 1:
            bits = np.concatenate([folded(bitmaps[i][None, :], own) for i in at])
            found[at] |= with_partner(sizes[at], bits, percent)
    return found


def spanning_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (i, j) with similarity >= percent / 100 that join all that links join.

    ``sets`` are sorted arrays of distinct tokens. Pairs known to be connected are not
    verified.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    lanes = min(64, lanes_for(int(np.quantile(sizes, 0.75))))
    tree = SignatureTree(sizes, np.array([bitmap(s, lanes) for s in sets], dtype=np.uint64))
    forest = Forest(len(sets))
    root = forest.root
    order = tree.order
    same = lambda s, t, u, v: root[s] == root[u] and (root[s:t] == root[s]).all() and (root[u:v] == root[s]).all()
    links = []
    for a, b in tree.leaf_pairs(percent, same):
        i, j = tree.surviving(a, b, percent)
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        if len(i) > MANY:
            ok = overlap_matrix([sets[k] for k in order[slice(*tree.span(0, a))]], [sets[k] for k in order[slice(*tree.span(0, b))]])
            if ok is not None:
                shared = ok[i - tree.span(0, a)[0], j - tree.span(0, b)[0]]
                linked = shared >= needed(tree.sizes[i] + tree.sizes[j], percent)
                for x, y in zip(i[linked].tolist(), j[linked].tolist(), strict=True):
                    if root[x] != root[y]:
                        forest.join(x, y)
                        links.append((int(order[x]), int(order[y])))
                continue
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if root[x] == root[y]:
                continue
            p, q = sets[order[x]], sets[order[y]]
            small, big = (p, q) if len(p) <= len(q) else (q, p)
            at = np.searchsorted(big, small)
            at[at == len(big)] = 0
            if (big[at] == small).sum() >= needed(len(p) + len(q), percent):
                forest.join(x, y)
                links.append((int(order[x]), int(order[y])))
    return links


def overlap_matrix(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray | None:
    """Sizes of the overlaps of all sets of two leaves, as one product; None if it would take too much memory."""
    if sum(map(len, left)) + sum(map(len, right)) > MATRIX_TOKENS:
        return None
    every = np.unique(np.concatenate(left + right))
    sides = []
    for own in (left, right):
        flags = np.zeros((len(own), len(every)), dtype=np.float32)
        flags[np.repeat(np.arange(len(own)), [len(s) for s in own]), np.searchsorted(every, np.concatenate(own))] = 1
        sides.append(flags)
    return (sides[0] @ sides[1].T).astype(np.int64)
