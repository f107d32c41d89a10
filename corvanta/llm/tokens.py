"""Words and word shingles of Arrow text columns as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8_texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text, one at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for value in binary:
        yield value.as_py()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def ascii_words(text: bytes) -> list[bytes]:
    """Words between the six ASCII blanks, A-Z in lower case, other letters as they are."""
    return text.lower().split()


def window_hashes(words: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """A hash, for each start, of the words at these offsets from it."""
    span = offsets[-1] + 1
    n = len(words) - span + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, len(offsets), dtype=np.uint64)
    for j, offset in enumerate(offsets):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(_ODD[j % 5]) + words[offset : offset + n]
    return mixed(out)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles by position; fewer than k words make one shingle."""
    if len(words) == 0:
        return words
    return window_hashes(words, tuple(range(min(k, len(words)))))


def shingle_blocks(texts: Iterable[tuple[Any, bytes]], k: int, words: int = 1 << 20) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(marks, shingles, starts) of texts with their marks, in blocks of about ``words`` words or one longer text.

    Shingles of all texts of a block lie end to end, those of text i from starts[i] to
    starts[i + 1]; a text of fewer than k words has none.
    """
    marks, held, count = [], [], 0
    for mark, text in texts:
        marks.append(mark)
        held.append(word_hashes(ascii_words(text)))
        count += len(held[-1])
        if count >= words:
            yield marks, *_shingle_block(held, k)
            marks, held, count = [], [], 0
    if marks:
        yield marks, *_shingle_block(held, k)


def _shingle_block(held: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in held], dtype=np.int64)
    sizes = np.maximum(0, lengths - k + 1)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    first = np.cumsum(lengths) - lengths
    own = window_hashes(np.concatenate(held), tuple(range(k)))
    return own[np.repeat(first - starts[:-1], sizes) + np.arange(starts[-1])], starts
