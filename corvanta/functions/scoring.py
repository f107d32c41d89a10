"""Scores and vectors as column expressions; all arithmetic in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the fused score, and the offset of reciprocal ranks.
KEYWORD_SHARE = 0.5
SCORE_SHARE = 0.7
RANK_SHARE = 0.3
RANK_SCALE = 10.0
RANK_OFFSET = 60.0
#: What keeps the keyword cosine's denominator from zero.
EPSILON = 1e-9


def term_weight(count: Column) -> Column:
    """1 + ln of a count, 0 for none."""
    return F.when(count > 0, 1 + F.log(count.cast("double"))).otherwise(F.lit(0.0))


def rarity(documents: Column, having: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((documents.cast("double") + 1) / (having.cast("double") + 1)) + 1


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either is zero."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def unit(vector: Column, dimensions: int | None = None) -> Column:
    """The first ``dimensions`` of a vector at length 1; a zero vector as it is."""
    v = doubles(F.slice(vector, 1, dimensions) if dimensions else vector)
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v)


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def rank_term(rank: Column) -> Column:
    """What a rank, from 1, adds to a fused rank score."""
    return F.lit(1.0) / (F.lit(RANK_OFFSET) + rank)


def fused(keyword: Column, vector: Column, ranks: Column) -> Column:
    """The hybrid score of a keyword score, a vector score and a sum of rank terms; a missing one is 0."""
    k, v, r = (F.coalesce(x, F.lit(0.0)) for x in (keyword, vector, ranks))
    return SCORE_SHARE * (KEYWORD_SHARE * k + (1 - KEYWORD_SHARE) * v) + RANK_SHARE * (RANK_SCALE * r)
