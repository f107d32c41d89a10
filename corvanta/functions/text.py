"""Text functions as column expressions: tokens, lines, chunks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# All Unicode blanks, as a class of a regular expression and as they are.
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# A token, a header line, and what parts paragraphs.
TOKEN = "[a-z0-9]{2,}"
HEADER = rf"(?md)^#{{1,6}}{BLANK}"
PARAGRAPH = r"\n{2,}"
CHUNK_MARK = "::chunk::"


def tokenize(text: Column) -> Column:
    """Runs of two or more of a-z and 0-9 in the lower-case text, in order; none for a null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def tokens_of(text: bytes) -> list[bytes]:
    """What ``tokenize`` gives for a text in UTF-8."""
    lower = text.lower()
    if not lower.isascii():
        # Of all other letters, these two have a-z in their lower case.
        lower = lower.replace("\u212a".encode(), b"k").replace("\u0130".encode(), "i\u0307".encode())
    return re.findall(TOKEN.encode(), lower)


def strip(text: Column) -> Column:
    """The text without Unicode blanks at its ends."""
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    """Whether a text is null, empty or of blanks only."""
    return F.coalesce(strip(text) == "", F.lit(True))


def normalize_lines(text: Column) -> Column:
    """LF for CRLF, and no blanks at the ends of lines."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return F.array_join(F.transform(lines, lambda x: F.rtrim(x, F.lit(BLANKS.replace("\n", "")))), "\n")


def chunk_text(text: Column) -> Column:
    """A text's chunks: one for each header and its body if there are headers, else its paragraphs.

    What precedes the first header is a chunk of its own. Chunks are stripped, empty
    ones left out; a null has none.
    """

    def chunks(lines: Column) -> Column:
        parts = F.when(lines.rlike(HEADER), F.split(lines, rf"(?md)(?=^#{{1,6}}{BLANK})", -1)).otherwise(F.split(lines, PARAGRAPH, -1))
        return F.filter(F.transform(parts, strip), lambda x: x != "")

    # In an array of one, the lines are made once for all that reads them.
    return F.coalesce(F.element_at(F.transform(F.array(normalize_lines(text)), chunks), 1), F.array().cast("array<string>"))


def chunk_id(doc_id: Column, index: Column) -> Column:
    """The id of a document's chunk at a position."""
    return F.concat(doc_id.cast("string"), F.lit(CHUNK_MARK), index.cast("string"))


def document_of(chunk: Column) -> Column:
    """What stands before the first mark of a chunk id."""
    return F.split_part(chunk, F.lit(CHUNK_MARK), F.lit(1))
