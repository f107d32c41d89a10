"""Benchmark decontamination by spaced seeds.

A mask is a fixed list of word offsets; the words between them are ignored, so a seed
holds though words there are substituted. The masks of an item's length are chosen so
that every overlap with few enough substitutions shows one of them unharmed, wherever
its substitutions are. Texts and benchmark items are hashed under the masks; equal
hashes are joined; and along each hit the text and the item are aligned and compared
word by word, substitutions allowed.
"""

from __future__ import annotations

import io
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvanta.llm.files import located, write_whole
from corvanta.llm.ngram_join import whole_groups
from corvanta.llm.tokens import mixed, utf8_texts, window_hashes, word_hashes
from corvanta.workspace import Workspace

WORD = re.compile(r"[^\W_]+")
#: Items of fewer words match nothing.
SHORT = 5
#: Words of benchmark items in a block, of which each costs a pass over the texts; about 60 bytes a word in a task.
BLOCK_WORDS = 500_000
#: Words that a mask may span, masks of an item, and patterns of substitutions among which they are sought.
SPAN = 10
MASKS = 4
PATTERNS = 100_000

Mask = tuple[int, ...]


class Family(NamedTuple):
    """Masks of items of ``low`` to ``high`` words."""

    low: int
    high: int
    masks: tuple[Mask, ...]


class Items(NamedTuple):
    """Benchmark items: their words' hashes end to end, where each begins, and their seeds in order of hash with item and place."""

    words: np.ndarray
    starts: np.ndarray
    keys: np.ndarray
    places: np.ndarray

    def words_of(self, i: int) -> np.ndarray:
        return self.words[self.starts[i] : self.starts[i + 1]]


def text_words(text: bytes | None) -> np.ndarray:
    """Hashes of a text's words: runs of letters and digits, in lower case."""
    return word_hashes([w.encode() for w in WORD.findall((text or b"").decode(errors="replace").lower())])


def needed_words(n: int, least: int, percent: int) -> int:
    """Equal words that an overlap with an item of ``n`` words has."""
    return max(1, min(least, -(-percent * n // 100)))


def allowed(length: int, need: int, percent: int) -> int:
    """Unequal words in an overlap of ``length`` words."""
    return min(length * (100 - percent) // 100, length - need)


def consecutive(n: int, least: int, percent: int) -> Mask:
    """A mask without gaps that every overlap with an item of ``n`` words shows.

    An overlap of q equal words has at most n - q others, and no more than its share
    allows; k of them leave a run of at least q / (k + 1).
    """
    need = needed_words(n, least, percent)
    return tuple(range(min(-(-q // (min(n - q, q * (100 - percent) // percent) + 1)) for q in range(need, n + 1))))


def fewest_substitutions(masks: tuple[Mask, ...], length: int) -> int:
    """The fewest unequal words among ``length`` that leave no mask unharmed, by all patterns of the last words."""
    span = max(m[-1] for m in masks) + 1
    state = np.arange(1 << span)
    ends = [sum(1 << (m[-1] - at) for at in m) for m in masks]
    hit = np.zeros(1 << span, dtype=bool)
    for bits in ends:
        hit |= state & bits == bits
    cost = np.full(1 << span, length + 1)
    cost[0] = 0
    for _ in range(length):
        from_ = np.minimum(cost[state >> 1], cost[state >> 1 | 1 << (span - 1)])
        cost = np.where(hit, length + 1, from_ + (state & 1 == 0))
    return int(cost.min())


def lose_nothing(masks: tuple[Mask, ...], lengths: list[tuple[int, int]]) -> bool:
    """Whether every pattern of at most so many unequal words in so many words leaves a mask unharmed."""
    return all(fewest_substitutions(masks, length) > most for length, most in lengths)


@lru_cache(maxsize=None)
def chosen_masks(lengths: tuple[tuple[int, int], ...]) -> tuple[Mask, ...] | None:
    """The heaviest masks found that lose nothing in overlaps of ``lengths`` (words, unequal words); None if none are.

    Of all masks of a weight, the one that most patterns leave unharmed is taken, then
    the one that most of the others do, up to MASKS.
    """
    patterns = []
    for length, most in lengths:
        places = list(itertools.islice(itertools.combinations(range(length), most), PATTERNS + 1))
        if len(places) > PATTERNS:
            continue  # judged at the end
        patterns.append((length, np.array([sum(1 << at for at in p) for p in places], dtype=np.int64)))
    shortest = min(length for length, _ in lengths)
    for weight in range(min(SPAN, shortest), 1, -1):
        masks = [(0, *inner, last) for last in range(weight - 1, min(SPAN, shortest)) for inner in itertools.combinations(range(1, last), weight - 2)]
        unharmed = np.stack([np.concatenate([_unharmed(m, length, p) for length, p in patterns]) for m in masks])
        left, found = np.ones(unharmed.shape[1], dtype=bool), []
        while left.any() and len(found) < MASKS:
            best = int((unharmed & left).sum(axis=1).argmax())
            found.append(masks[best])
            left &= ~unharmed[best]
        if not left.any() and lose_nothing(tuple(found), list(lengths)):
            return tuple(found)
    return None


def _unharmed(mask: Mask, length: int, patterns: np.ndarray) -> np.ndarray:
    own = sum(1 << at for at in mask)
    out = np.zeros(len(patterns), dtype=bool)
    for shift in range(length - mask[-1]):
        out |= patterns & (own << shift) == 0
    return out


def families(least: int, percent: int) -> list[Family]:
    """Masks by item length.

    From the length on at which every overlap needs ``least`` words, one family serves
    all: a longer overlap than 2 b - 1 words can be cut into parts of b to 2 b - 1, of
    which one has the share. Shorter items are taken three lengths at a time.
    """
    long_ = -(-least * 100 // percent)
    bounds = [(n, min(n + 2, long_ - 1)) for n in range(SHORT, long_, 3)] + [(max(long_, SHORT), 2**31)]
    out = []
    for low, high in bounds:
        lengths: dict[int, int] = {}
        for n in range(low, min(high, 2 * low - 1) + 1):
            need = needed_words(n, least, percent)
            for length in range(need, n + 1):
                lengths[length] = max(lengths.get(length, 0), allowed(length, need, percent))
        masks = chosen_masks(tuple(sorted(lengths.items())))
        out.append(Family(low, high, masks or (min(consecutive(n, least, percent) for n in range(low, min(high, 2 * low) + 1)),)))
    return out


def mask_hashes(words: np.ndarray, mask: Mask) -> np.ndarray:
    """Hashes by position of the words under a mask, each mask with hashes of its own."""
    own = sum(1 << at for at in mask)
    return mixed(window_hashes(words, mask) + np.uint64(own))


def prepare(texts: list[str | None], by_length: list[Family]) -> Items:
    """Seeds of benchmark items, numbered as they come, in order of hash."""
    all_words, starts, keys, places = [np.empty(0, np.uint64)], [0], [np.empty(0, np.uint64)], [np.empty((0, 2), np.int32)]
    for i, text in enumerate(texts):
        words = text_words((text or "").encode())
        all_words.append(words)
        starts.append(starts[-1] + len(words))
        for mask in next((f.masks for f in by_length if f.low <= len(words) <= f.high), ()):
            hashes = mask_hashes(words, mask)
            keys.append(hashes)
            places.append(np.stack([np.full(len(hashes), i), np.arange(len(hashes))], axis=1).astype(np.int32))
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    return Items(np.concatenate(all_words), np.array(starts), key[order], np.concatenate(places)[order])


def best_stretch(same: np.ndarray, percent: int) -> tuple[int, int, int]:
    """Start, end and matches of the stretch with most matches of which ``percent`` match.

    Each match adds what each mismatch takes ``percent`` / (100 - percent) times, so
    that a stretch has the share if its sum is not negative. From each start, the
    farthest such end has most matches. Of equal ones the shortest, then the first; it
    begins and ends with a match. At least one place of ``same`` is true.
    """
    gain = np.where(same, 100 - percent, -percent).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(gain)))
    count = np.concatenate(([0], np.cumsum(same)))
    places = np.flatnonzero(same)
    # The highest sum from each end on falls, so the farthest end is found by bisection.
    highest = np.maximum.accumulate(total[::-1])[::-1]
    ends = np.searchsorted(-highest, -total[places], "right") - 1
    matches = count[ends] - count[places]
    lengths = places[count[ends] - 1] + 1 - places
    at = np.lexsort((lengths, -matches))[0]
    return int(places[at]), int(places[at] + lengths[at]), int(matches[at])


def candidates(words: np.ndarray, starts: np.ndarray, items: Items, masks: list[Mask]) -> np.ndarray:
    """Distinct rows (text, item, shift) in which a mask of some text hashes like one of an item.

    ``words`` are those of all texts end to end, text i from starts[i] on; a shift is
    the item's first word as a position in ``words``.
    """
    found = [np.empty((0, 3), np.int64)]
    # A bit filter of the seeds that fits the processor's cache if they are few.
    bits = np.uint64(64 - min(24, max(12, len(items.keys).bit_length() + 4)))
    known = np.zeros(1 << (64 - int(bits)), dtype=bool)
    known[items.keys >> bits] = True
    for mask in masks:
        hashes = mask_hashes(words, mask)
        at = np.flatnonzero(known[hashes >> bits])
        low, high = (np.searchsorted(items.keys, hashes[at], side) for side in ("left", "right"))
        text = np.searchsorted(starts, at, "right") - 1
        real = (high > low) & (at + mask[-1] < starts[text + 1])
        at, text, low, count = at[real], text[real], low[real], (high - low)[real]
        if not len(at):
            continue
        seed = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        item, place = items.places[seed].astype(np.int64).T
        found.append(np.unique(np.stack([np.repeat(text, count), item, np.repeat(at, count) - place], axis=1), axis=0))
    return np.unique(np.concatenate(found), axis=0)


def overlaps(texts: Iterator[bytes | None], items: Items, masks: list[Mask], least: int, percent: int) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, text start, item start, length, matches) of verified overlaps, the best of each text and item."""
    each = [text_words(text) for text in texts]
    starts = np.concatenate(([0], np.cumsum([len(w) for w in each], dtype=np.int64)))
    words = np.concatenate([*each, np.empty(0, np.uint64)])
    best: dict[tuple[int, int], tuple[int, int, int, int, int, int]] = {}
    for text, i, shift in candidates(words, starts, items, masks).tolist():
        own = items.words_of(i)
        first = int(starts[text])
        begin, end = max(0, first - shift), min(len(own), int(starts[text + 1]) - shift)
        same = own[begin:end] == words[begin + shift : end + shift]
        need = needed_words(len(own), least, percent)
        if same.sum() < need:
            continue
        s, e, matches = best_stretch(same, percent)
        if matches >= need and ((text, i) not in best or matches > best[text, i][5]):
            best[text, i] = (text, i, begin + s + shift - first, begin + s, e - s, matches)
    return sorted(best.values())


OUT = "item_id {kind}, text_start long, item_start long, overlap_words long, matching_words long, item_words long"


def _used(items: Items, by_length: list[Family]) -> list[Mask]:
    lengths = np.diff(items.starts)
    return sorted({m for f in by_length if ((lengths >= f.low) & (lengths <= f.high)).any() for m in f.masks})


def _block(path: str) -> tuple[Items, pa.Array]:
    """A block of the benchmark and the ids of its items, from the shared folder."""
    fs, where = located(path)
    with fs.open_input_file(where) as file:
        data = np.load(io.BytesIO(file.readall()))
    ids = pa.ipc.open_stream(pa.py_buffer(data["ids"].tobytes())).read_all().column("i").combine_chunks()
    return Items(*(data[name] for name in Items._fields)), ids


def _writer(folder: str, by_length: list[Family]):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in whole_groups(batches, "block"):
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                own = table.slice(s, e - s)
                items = prepare(own.column("t").to_pylist(), by_length)
                ids, buffer = pa.BufferOutputStream(), io.BytesIO()
                with pa.ipc.new_stream(ids, pa.schema([own.schema.field("i")])) as stream:
                    stream.write_table(own.select(["i"]))
                np.savez(buffer, ids=np.frombuffer(ids.getvalue(), dtype=np.uint8), **items._asdict())
                number = own.column("block")[0].as_py()
                path = f"{folder}/block-{number}.npz"
                write_whole(path, buffer.getvalue())
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([path])], ["block", "path"])

    return write


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int, by_length: list[Family]) -> list[str]:
    """Write the benchmark's words and seeds as files of about ``block_words`` words; their paths.

    Tasks write and read them, so the driver holds the paths only. Items are dealt by hash.
    """
    ws = Workspace(benchmark.sparkSession, "decontamination")
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    size = F.coalesce(F.size(F.split("t", r"[^\p{L}\p{N}]+")), F.lit(0))
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_words))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))).repartition("block").sortWithinPartitions("block", "i", "t")
    written = ws.save(dealt.mapInArrow(_writer(f"{ws.path}/blocks", by_length), "block long, path string"), "paths")
    return [r["path"] for r in written.orderBy("block").collect()]


def _finder(path: str, by_length: list[Family], least: int, percent: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, ids = _block(path)
        masks = _used(items, by_length)
        for batch in batches:
            found = overlaps(utf8_texts(batch.column("text")), items, masks, least, percent)
            if found:
                text, item, text_start, item_start, length, matches = (np.array(x) for x in zip(*found, strict=True))
                sizes = items.starts[item + 1] - items.starts[item]
                numbers = [pa.array(x, pa.int64()) for x in (text_start, item_start, length, matches, sizes)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(text)), ids.take(pa.array(item)), *numbers], ["doc_id", "item_id", "text_start", "item_start", "overlap_words", "matching_words", "item_words"]
                )

    return find


def find_overlaps(
    df: DataFrame,
    benchmark: DataFrame,
    least_words: int = 13,
    percent: int = 80,
    text: str = "text",
    row_id: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Overlaps of texts with benchmark items, a row for each text and item.

    An overlap is an aligned stretch of which ``percent`` of the words are equal, with
    at least ``least_words`` equal words, or ``percent`` of a shorter item's. Returns
    doc_id, item_id, text_start and item_start (word positions), overlap_words,
    matching_words and item_words; the best stretch if several overlap: that with most
    equal words, then the one whose item begins first in the text, the shortest, the first.

    Every such overlap is found. Items below 5 words, null or empty ones match nothing,
    nor do null and empty texts. Very long texts are searched to their end. The
    benchmark is kept in the shared folder in blocks of about ``block_words`` words (or
    one longer item), with a pass over the texts for each block. Rows with equal ids
    are reported each, and so are repeated items; null ids as null. An empty table on
    either side gives an empty result. Other columns are not read.
    """
    rows = df.select(F.col(row_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = [rows.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, " + OUT.format(kind=kinds[1])
    by_length = families(least_words, percent)
    found = df.sparkSession.createDataFrame([], schema)
    for path in benchmark_blocks(benchmark, item_id, item_text, block_words, by_length):
        part = rows.mapInArrow(_finder(path, by_length, least_words, percent), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _cleaner(path: str, by_length: list[Family], least: int, percent: int, text: str):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, _ = _block(path)
        masks = _used(items, by_length)
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            keep[[hit[0] for hit in overlaps(utf8_texts(batch.column(text)), items, masks, least, percent)]] = False
            yield batch.filter(pa.array(keep))

    return clean


def remove_contaminated(
    df: DataFrame, benchmark: DataFrame, least_words: int = 13, percent: int = 80, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The rows of ``df`` without an overlap as ``find_overlaps`` has it; all columns stay.

    Each row is judged by its own text, whatever its id, so nothing is shuffled. The
    blocks of the benchmark follow each other in one pass. Null and empty texts stay.
    """
    by_length = families(least_words, percent)
    for path in benchmark_blocks(benchmark, item_id, item_text, block_words, by_length):
        df = df.mapInArrow(_cleaner(path, by_length, least_words, percent, text), df.schema)
    return df
