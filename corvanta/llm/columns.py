"""Column helpers for operators that carry callers' tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvanta.functions.keys import fresh_name

__all__ = ["WORD", "byte_count", "fresh_name", "random_key", "word_count"]

#: A word is a maximal run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text as a long; 0 where the text is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_count(text: Column) -> Column:
    """UTF-8 bytes of a text as a long; 0 where the text is null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def random_key(column: Column, seed: int) -> Column:
    """60 pseudo-random bits of a value, the same in any SQL engine that has MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
