"""Small texts with copies, near copies, blanks and odd rows."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(seed: int = 0, n: int = 60) -> list[tuple]:
    """Rows of ``documents``: random texts, then copies and near copies of some, then odd ones."""
    rng = random.Random(seed)
    texts: list[str | None] = [" ".join(words(rng, rng.randrange(3, 220))) for _ in range(n)]
    for i in range(0, n, 5):
        texts.append(texts[i])
        own = texts[i].split()
        own[rng.randrange(len(own))] = "changed"
        texts.append("\n".join(own))
    texts += [None, "", " \t\n", "one", "two words", "Two\x0bWORDS", "é ß É", "x " * 3000, None, ""]
    rows = [(i, t, "en", f"s{i % 5}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[0])  # a repeated row
    rows.append((None, "a text without an id that is long enough for a shingle", "en", "s1", 10))
    rows.append((None, None, None, None, None))
    return rows
