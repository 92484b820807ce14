"""Arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.regex import let


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def total(vector: Column) -> Column:
    return F.aggregate(_doubles(vector), F.lit(0.0), lambda a, x: a + x)


def argmax(vector: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def softmax(vector: Column) -> Column:
    """Numerically stable softmax."""
    raised = let(_doubles(vector), lambda v: let(
        F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))
    return let(raised, lambda r: _divided(r, F.greatest(total(r), F.lit(1e-12))))


def _divided(vector: Column, divisor: Column) -> Column:
    return let(divisor, lambda d: F.transform(vector, lambda x: x / d))


def unit_length(vector: Column) -> Column:
    """Scale to length one; a zero vector stays."""
    def scale(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return _divided(v, F.greatest(norm, F.lit(1e-12)))

    return let(_doubles(vector), scale)


def masked_mean(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is set (divisor at least one)."""
    weighted = F.zip_with(tokens, mask, lambda v, m: F.transform(_doubles(v), lambda x: x * m))
    width = F.size(F.get(tokens, 0))
    zero = F.array_repeat(F.lit(0.0), width)
    summed = F.aggregate(weighted, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return _divided(summed, F.greatest(total(mask), F.lit(1.0)))


def feature_dropout(vector: Column, key: Column, rate: float, seed: int) -> Column:
    """Inverted dropout with a mask that depends only on seed, key and position."""
    if rate >= 1:
        raise ValueError("Feature dropout must be < 1.")
    if rate <= 0:
        return vector

    def keep(x: Column, i: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(seed), key, i))
        draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
        return F.when(draw >= rate, x / F.lit(1.0 - rate)).otherwise(F.lit(0.0))

    return F.transform(_doubles(vector), keep)
