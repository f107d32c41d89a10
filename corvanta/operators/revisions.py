"""Differences of document revisions, chunk by chunk."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvanta.functions.text import chunk_text

KINDS = ("ADDED", "DELETED", "MODIFIED", "UNCHANGED")
LEAST_SIMILARITY = 0.55


class Delta(NamedTuple):
    kind: str
    old_index: int | None = None
    new_index: int | None = None
    old_text: str | None = None
    new_text: str | None = None


def common_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, with the rows of its table as bits of an integer.

    What both begin and end with is counted without a table.
    """
    start = _shared_start(a, b)
    a, b = a[start:], b[start:]
    end = _shared_end(a, b)
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return start + end
    if len(a) < len(b):  # fewer and longer rows
        a, b = b, a
    places: dict = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    return start + len(b) - row.bit_count() + end


def _shared_start(a: Sequence, b: Sequence) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _shared_end(a: Sequence, b: Sequence) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[len(a) - middle : len(a) - low] == b[len(b) - middle : len(b) - low]:
            low = middle
        else:
            high = middle - 1
    return low


def _lengths(a: Sequence, b: Sequence) -> list[int]:
    """Common lengths of ``a`` and each prefix of ``b``."""
    places: dict = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    out = [0]
    for i in range(len(b)):
        out.append(out[-1] + 1 - (row >> i & 1))
    return out


def align(old: Sequence, new: Sequence) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence of equal items.

    ``old`` is halved; ``new`` is split at the first place where the common lengths of
    the halves sum to most; a single item takes the first that equals it. This fixes
    which of several longest ones is meant.
    """
    out: list[tuple[int, int]] = []
    work = [(0, len(old), 0, len(new))]
    while work:
        a, b, c, d = work.pop()
        if b - a == 1 or d - c == 1:
            hit = next(((i, j) for i in range(a, b) for j in range(c, d) if old[i] == new[j]), None)
            if hit:
                out.append(hit)
        elif b > a and d > c:
            middle = a + (b - a) // 2
            top = _lengths(old[a:middle], new[c:d])
            rest = _lengths(old[middle:b][::-1], new[c:d][::-1])[::-1]
            sums = [x + y for x, y in zip(top, rest, strict=True)]
            cut = c + sums.index(max(sums))
            work += [(middle, b, cut, d), (a, middle, c, cut)]
    return sorted(out)


def similarity(a: str, b: str) -> float:
    """Common length over mean length of two lower-cased texts; 1 for two empty ones."""
    a, b = a.lower(), b.lower()
    if a == b:
        return 1.0
    return common_length(a, b) / ((len(a) + len(b)) / 2)


def _similar(a: str, b: str, least: float) -> bool:
    x, y = a.lower(), b.lower()
    # The common length cannot exceed the shorter text's.
    if x != y and 2 * min(len(x), len(y)) < least * (len(x) + len(y)):
        return False
    return similarity(a, b) >= least


def deltas(old: Sequence[str], new: Sequence[str], least: float = LEAST_SIMILARITY) -> list[Delta]:
    """What became of each chunk, gap by gap between the aligned ones.

    In a gap each old chunk takes, in order, the first free new chunk that is similar
    enough (MODIFIED); what is left is DELETED and ADDED; then the aligned chunk follows
    as UNCHANGED.
    """
    out: list[Delta] = []
    i = j = 0
    for end_i, end_j in [*align(old, new), (len(old), len(new))]:
        free = list(range(j, end_j))
        gone = []
        for a in range(i, end_i):
            b = next((b for b in free if _similar(old[a], new[b], least)), None)
            if b is None:
                gone.append(a)
            else:
                free.remove(b)
                out.append(Delta("MODIFIED", a, b, old[a], new[b]))
        out += [Delta("DELETED", a, None, old[a], None) for a in gone]
        out += [Delta("ADDED", None, b, None, new[b]) for b in free]
        if end_i < len(old) and end_j < len(new):
            out.append(Delta("UNCHANGED", end_i, end_j, old[end_i], new[end_j]))
        i, j = end_i + 1, end_j + 1
    return out


def checked_least(least: float) -> float:
    """``least``. Raises ValueError outside 0 to 1."""
    if not 0 <= least <= 1:
        raise ValueError("the similarity threshold must be between 0 and 1")
    return least


DELTA_SCHEMA = "ordinal long, kind string, old_index long, new_index long, old_text string, new_text string"


def diff_chunks(revisions: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """Deltas of ``revisions`` (doc_id, old_chunks, new_chunks), numbered by ``ordinal`` in a document.

    Each row is read once: a filter for equal revisions would cut texts into chunks a
    second time. Null lists are empty ones.
    """
    checked_least(least)
    rows = revisions.select("doc_id", "old_chunks", "new_chunks")
    names = ["doc_id", *(x.strip().split()[0] for x in DELTA_SCHEMA.split(","))]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for row, (old, new) in enumerate(zip(batch.column("old_chunks").to_pylist(), batch.column("new_chunks").to_pylist(), strict=True)):
                old, new = old or [], new or []
                found = [Delta("UNCHANGED", i, i, x, x) for i, x in enumerate(old)] if old == new else deltas(old, new, least)
                at += [row] * len(found)
                out += [(n, *delta) for n, delta in enumerate(found)]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), *(pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True))], names)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {DELTA_SCHEMA}")


def diff_texts(revisions: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """Deltas of ``revisions`` (doc_id, old_text, new_text)."""
    return diff_chunks(revisions.select("doc_id", chunk_text(F.col("old_text")).alias("old_chunks"), chunk_text(F.col("new_text")).alias("new_chunks")), least)


def to_upsert(found: DataFrame) -> DataFrame:
    """The ADDED and MODIFIED chunks."""
    return found.where(F.col("kind").isin("ADDED", "MODIFIED"))


def to_delete(found: DataFrame) -> DataFrame:
    """(doc_id, old_index) of the DELETED chunks."""
    return found.where("kind = 'DELETED'").select("doc_id", "old_index")


def summarize(found: DataFrame) -> DataFrame:
    """By document: how many chunks were added, modified and deleted."""
    return found.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(k.lower()) for k in ("ADDED", "MODIFIED", "DELETED")])


def _pairwise(pairs: DataFrame, name: str, kind: str, score) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[["id"]].assign(**{name: [score(a, b) for a, b in zip(part["a"], part["b"], strict=True)]})

    return pairs.select("id", "a", "b").mapInPandas(run, f"id {pairs.schema['id'].dataType.simpleString()}, {name} {kind}")


def lcs_lengths(pairs: DataFrame) -> DataFrame:
    """(id, lcs) of ``pairs`` (id, a, b): lengths of longest common subsequences of characters."""
    return _pairwise(pairs, "lcs", "long", common_length)


def similarities(pairs: DataFrame) -> DataFrame:
    """(id, similarity) of ``pairs`` (id, a, b)."""
    return _pairwise(pairs, "similarity", "double", similarity)
