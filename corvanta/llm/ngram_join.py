"""Near-duplicate texts by a Jaccard join of word-shingle sets with signature trees.

A link needs 100 * |x & y| >= percent * |x | y|. Under any one order of shingles, two
linked sets share a shingle among the first |x| - ceil(percent |x| / 100) + 1 of each,
so every linked pair meets in the group of such a shingle; the order is that of the
hashes. In a group, a signature tree's dual traversal prunes node pairs by the most
that they can overlap. What remains is verified on the whole sets. Pairs that are
known to be connected are never listed: only their component is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvanta.llm.components import connected_components
from corvanta.llm.signature_tree import LANES, bitmap, folded, lanes_for, needed, spanning_links, with_partner, with_partner_sized
from corvanta.llm.tokens import ascii_words, mixed, shingles, utf8_texts, word_hashes
from corvanta.workspace import Workspace

#: Rows of a shingle group that one tree holds; larger groups become pairs of blocks.
BLOCK = 4096
#: Shingles, and SET_WEIGHT for each set, of an area that one tree holds (8 bytes each); larger
#: areas become pairs of blocks.
AREA_WEIGHT = 12_000_000
SET_WEIGHT = 64
#: Ids of texts that are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows (shingle, set) of one bucket, on average.
BUCKET_ROWS = 1 << 18

ROW = np.dtype([("token", "<u8"), ("set", "<i8"), ("size", "<u4")])


def token_set(text: bytes | None, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingles(word_hashes(ascii_words(text or b"")), k))


def set_id(tokens: np.ndarray) -> int:
    """A 62-bit identity of a set of tokens, and at least 1."""
    x = mixed(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mixed(np.array([x], dtype=np.uint64))[0] >> np.uint64(2)) + 1


def _described(k: int, percent: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sizes, ids, prefixes, shorts, longs = [], [], [], [], []
            for text in utf8_texts(batch.column("text")):
                tokens = token_set(text, k)
                n = len(tokens)
                sizes.append(n)
                identity = set_id(tokens) if n else None
                ids.append(identity)
                if n == 0 or identity in seen:  # a set's shingles are needed once
                    prefixes.append(None)
                    shorts.append(None)
                    longs.append(None)
                    continue
                seen.add(identity)
                prefixes.append(tokens[: n - -(-percent * n // 100) + 1].tobytes())
                wide = bitmap(tokens, lanes_for(n))
                shorts.append(folded(wide[None, :], LANES).tobytes())
                longs.append(wide.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(prefixes, pa.binary()), pa.array(shorts, pa.binary()), pa.array(longs, pa.binary())],
                ["content", "doc_id", "n", "set", "prefix", "bits", "wide"],
            )

    return describe


def _to_buckets(buckets: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def packed():
            rows = np.concatenate(held)
            at = (rows["token"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            rows, at = rows[order], at[order]
            edges = np.flatnonzero(np.diff(at, prepend=-1))
            ends = np.append(edges[1:], len(rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(at[edges], pa.int64()), pa.array([rows[s:t].tobytes() for s, t in zip(edges, ends, strict=True)], pa.binary())], ["bucket", "rows"]
            )

        for batch in batches:
            for identity, n, prefix in zip(batch.column("set").to_pylist(), batch.column("n").to_pylist(), batch.column("prefix").to_pylist(), strict=True):
                tokens = np.frombuffer(prefix, dtype=np.uint64)
                rows = np.empty(len(tokens), dtype=ROW)
                rows["token"], rows["set"], rows["size"] = tokens, identity, n
                held.append(rows)
                count += len(rows)
            if count > 1_000_000:
                yield packed()
                held, count = [], 0
        if count:
            yield packed()

    return deal


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables with all rows of each of their keys, from batches sorted by it; starts and ends of the keys."""
    held: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        keys = np.asarray(table.column(key))
        if held and held[0].column(key)[0].as_py() != keys[0]:
            yield _with_edges(pa.concat_tables(held), key)
            held = []
        last = int(np.searchsorted(keys, keys[-1]))
        if last and held:
            held.append(table.slice(0, last))
            yield _with_edges(pa.concat_tables(held), key)
            held = []
        elif last:
            yield _with_edges(table.slice(0, last), key)
        held.append(table.slice(last))
    if held:
        yield _with_edges(pa.concat_tables(held), key)


def _with_edges(table: pa.Table, key: str) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    keys = np.asarray(table.column(key))
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return table, starts, np.append(starts[1:], len(keys))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.ChunkedArray]:
    for table, starts, ends in whole_groups(batches, "bucket"):
        for s, t in zip(starts.tolist(), ends.tolist(), strict=True):
            yield table.column("rows").slice(s, t - s)


def _meetings(percent: int):
    """From buckets of shingle rows, the (group, set) in which some other set fits by size."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _buckets(batches):
            rows = np.concatenate([np.frombuffer(x.as_py(), dtype=ROW) for x in part])
            rows = rows[np.lexsort((rows["set"], rows["size"], rows["token"]))]
            new = np.empty(len(rows), dtype=bool)
            new[0] = True
            new[1:] = (rows["token"][1:] != rows["token"][:-1]) | (rows["set"][1:] != rows["set"][:-1])
            rows = rows[new]
            token, size = rows["token"], rows["size"].astype(np.int64)
            follows = np.zeros(len(rows), dtype=bool)
            follows[1:] = (token[1:] == token[:-1]) & (100 * size[:-1] >= percent * size[1:])
            # Runs of neighbours that fit; no link crosses from one run to another.
            run = np.cumsum(~follows)
            length = np.bincount(run)[run]
            rows, run = rows[length > 1], run[length > 1]
            group, member = [], []
            edges = np.flatnonzero(np.diff(run, prepend=-1))
            ends = np.append(edges[1:], len(rows))
            big = (ends - edges) > BLOCK
            keys = mixed(rows["token"] ^ (run.astype(np.uint64) << np.uint64(1)))
            keep = np.repeat(~big, ends - edges)
            group.append(keys[keep])
            member.append(rows["set"][keep])
            for s, t in zip(edges[big].tolist(), ends[big].tolist(), strict=True):
                blocks = [(x, min(t, x + BLOCK // 2)) for x in range(s, t, BLOCK // 2)]
                for i, (a, b) in enumerate(blocks):
                    for j, (c, d) in enumerate(blocks[i:], i):
                        if 100 * int(rows["size"][b - 1]) < percent * int(rows["size"][c]):
                            break
                        if i == j and len(blocks) > 1 and i + 1 < len(blocks) and 100 * int(rows["size"][b - 1]) >= percent * int(rows["size"][blocks[i + 1][0]]):
                            continue  # the next pair of blocks holds this one too
                        both = np.concatenate([rows["set"][a:b], rows["set"][c:d]]) if i != j else rows["set"][a:b]
                        group.append(np.full(len(both), mixed(keys[s : s + 1] ^ np.uint64(1 + i * 1_000_003 + j))[0]))
                        member.append(both)
            if group:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(group).view(np.int64)), pa.array(np.concatenate(member))], ["grp", "set"]
                )

    return meet


def _pruned(percent: int, sized: bool = False):
    """Keep the (group, set) that a signature tree cannot rule out."""

    def fits(sizes: np.ndarray, column: pa.ChunkedArray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(sizes), dtype=bool)
        if sized:
            for s, t in zip(starts.tolist(), ends.tolist(), strict=True):
                bits = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in column.slice(s, t - s)]
                keep[s:t] = with_partner_sized(sizes[s:t], bits, percent)
            return keep
        bits = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(sizes), -1)
        two = starts[ends - starts == 2]
        x, y = bits[two], bits[two + 1]
        least = needed(sizes[two] + sizes[two + 1], percent)
        ok = (sizes[two] - np.bitwise_count(x & ~y).sum(axis=1).astype(np.int64) >= least) & (
            sizes[two + 1] - np.bitwise_count(y & ~x).sum(axis=1).astype(np.int64) >= least
        )
        keep[two] = ok
        keep[two + 1] = ok
        more = ends - starts > 2
        for s, t in zip(starts[more].tolist(), ends[more].tolist(), strict=True):
            keep[s:t] = with_partner(sizes[s:t], bits[s:t], percent)
        return keep

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in whole_groups(batches, "grp"):
            keep = fits(np.asarray(table.column("n")), table.column("bits"), starts, ends)
            if keep.any():
                # Groups with the same members become one: a group is named by its members.
                members = np.asarray(table.column("set"))
                name = np.add.reduceat(np.where(keep, mixed(members.view(np.uint64)), np.uint64(0)), starts)
                name = np.repeat(mixed(name).view(np.int64), ends - starts)
                yield pa.RecordBatch.from_arrays([pa.array(name[keep]), pa.array(members[keep])], ["grp", "set"])

    return prune


def _sets_of(k: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, sets = [], []
            for identity, text in zip(batch.column("set").to_pylist(), utf8_texts(batch.column("text")), strict=True):
                if identity not in seen:
                    seen.add(identity)
                    ids.append(identity)
                    sets.append(token_set(text, k).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["set", "tokens"])

    return read


def _linked(percent: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in whole_groups(batches, "grp"):
            ids, tokens = np.asarray(table.column("set")), table.column("tokens")
            found = []
            more = ends - starts > 1
            for s, t in zip(starts[more].tolist(), ends[more].tolist(), strict=True):
                sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in tokens.slice(s, t - s)]
                found += [(s + i, s + j) for i, j in spanning_links(sets, percent)]
            if found:
                at = np.array(found)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], ["a", "b"])

    return link


def _blocks(members: DataFrame, percent: int) -> DataFrame:
    """Groups (grp, set) to verify: areas (area, set, n), or pairs of blocks of the larger ones.

    A large area's sets are cut into blocks in order of size. Two blocks make a group
    if their sizes let sets of both link.
    """
    weight = F.col("n") + SET_WEIGHT
    sizes = members.groupBy("area").agg(F.sum(weight).alias("weight"))
    rows = members.join(sizes, "area")
    before = F.coalesce(F.sum(weight).over(W.partitionBy("area").orderBy("n", "set").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    large = rows.where(F.col("weight") > AREA_WEIGHT).withColumn("block", F.floor(before / F.lit(AREA_WEIGHT // 2)).cast("int"))
    spans = large.groupBy("area", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    one, two = spans.alias("x"), spans.alias("y")
    pairs = one.join(two, (F.col("x.area") == F.col("y.area")) & (F.col("x.block") <= F.col("y.block")) & (100 * F.col("x.high") >= percent * F.col("y.low")))
    pairs = pairs.select(F.col("x.area").alias("area"), F.col("x.block").alias("i"), F.col("y.block").alias("j"), F.xxhash64("x.area", "x.block", "y.block").alias("grp"))
    halves = pairs.select("area", F.col("i").alias("block"), "grp").union(pairs.where("i < j").select("area", F.col("j").alias("block"), "grp"))
    return rows.where(F.col("weight") <= AREA_WEIGHT).select(F.col("area").alias("grp"), "set").union(large.join(halves, ["area", "block"]).select("grp", "set"))


def ngram_components(df: DataFrame, k: int = 5, percent: int = 80, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Components of texts whose k-word shingle sets have a Jaccard of percent / 100 or more.

    Returns a row for each row of ``df``: doc_id, n_shingles (size of its set) and
    component_id, the smallest doc_id that links reach, its own included. Texts with
    fewer than k words have one shingle, their whole word sequence.

    Null texts, empty texts and texts of blanks have no shingles, and link with
    nothing: component_id is their own id. Texts with equal sets are linked whatever
    their ids. Rows with equal ids stay rows of their own. Null ids take the smallest
    id of their component, or null if it has none. An empty table gives an empty
    result. Very long texts are read to their end; a task holds one text's shingles at
    a time, 8 bytes each. Other columns are neither read nor returned.
    """
    return ngram_classes(df, k, percent, text, row_id).select("doc_id", "n_shingles", "component_id")


def ngram_classes(df: DataFrame, k: int = 5, percent: int = 80, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """As ``ngram_components``, with what tells rows and components apart where ids do not.

    Adds content (xxhash64 of the text) and class (a number of the component; null for
    texts without shingles). Two components can share a component_id where ids repeat,
    but not a class.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "ngram-join")
    texts = df.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("content"))
    described = ws.save(
        texts.mapInArrow(_described(k, percent), "content long, doc_id long, n long, set long, prefix binary, bits binary, wide binary"),
        "described",
    )
    known = described.where("set is not null")
    firsts = known.where("prefix is not null")
    total = firsts.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0] // 8
    buckets = max(16, total // BUCKET_ROWS + 1)
    dealt = firsts.select("set", "n", "prefix").mapInArrow(_to_buckets(buckets), "bucket long, rows binary")
    meetings = ws.save(
        dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meetings(percent), "grp long, set long"), "meetings"
    )
    marks = firsts.groupBy("set").agg(F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("wide").alias("wide"))

    def pruned(members: DataFrame, bits: str, table: str) -> DataFrame:
        rows = members.join(marks.select("set", "n", F.col(bits).alias("bits")), "set").select("grp", "set", "n", "bits")
        rows = rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(_pruned(percent, bits == "wide"), "grp long, set long")
        return ws.save(rows.distinct(), table)

    candidates = pruned(pruned(meetings, "bits", "candidates-1"), "wide", "candidates-2")
    ws.drop("meetings", "candidates-1")
    # Sets that may link, directly or through others, are verified together: each is sent once.
    ties = candidates.groupBy("grp").agg(F.min("set").alias("least"))
    areas = connected_components(candidates.join(ties, "grp").select(F.col("set").alias("a"), F.col("least").alias("b")))
    members = ws.save(areas.join(marks.select("set", "n"), areas["node"] == marks["set"]).select(F.col("component").alias("area"), "set", "n"), "members")
    holders = known.groupBy("set").agg(F.min(F.struct("doc_id", "content")).alias("holder"))
    wanted = ws.save(members.select("set").join(holders, "set").select("set", "holder.doc_id", "holder.content"), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    held = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["content"] == wanted["content"]))
    sets = held.select("set", "text").mapInArrow(_sets_of(k), "set long, tokens binary")
    rows = _blocks(members, percent).join(sets, "set").select("grp", "set", "tokens")
    links = ws.save(rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(_linked(percent), "a long, b long"), "links")
    joined = connected_components(links)
    least = known.groupBy("set").agg(F.min("doc_id").alias("least"))
    classes = least.join(joined, least["set"] == joined["node"], "left").select("set", "least", F.coalesce("component", "set").alias("component"))
    names = ws.save(classes, "classes")
    ws.drop("candidates-2", "members", "wanted", "links")
    tops = names.groupBy("component").agg(F.min("least").alias("component_id"))
    named_sets = names.join(tops, "component").select("set", F.col("component").alias("class"), "component_id")
    out = ("doc_id", F.col("n").alias("n_shingles"), "component_id", "content", "class")
    alone = described.where("set is null").withColumns({"component_id": F.col("doc_id"), "class": F.lit(None).cast("long")}).select(*out)
    return known.join(named_sets, "set").select(*out).union(alone)
