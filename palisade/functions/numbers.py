"""Arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str, digits: int) -> Column:
    """a / b rounded; null where b is 0."""
    return F.round(column(a).cast("double") / F.nullif(column(b), F.lit(0)), digits)


def long_sum(c: Column | str) -> Column:
    return F.sum(column(c)).cast("long")


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.greatest(as_column(low), F.least(as_column(high), x))


def beta_mean(tp: Column | str, fp: Column | str, prior: float = 2.0) -> Column:
    """Posterior mean of a rate with a Beta(prior, prior) prior."""
    return (column(tp) + prior) / (column(tp) + column(fp) + 2 * prior)


def beta_lower(tp: Column | str, fp: Column | str, prior: float = 2.0, z: float = 1.96) -> Column:
    """The posterior mean less z standard deviations, 0 at least."""
    a, b = column(tp) + prior, column(fp) + prior
    spread = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return F.greatest(F.lit(0.0), a / (a + b) - z * spread)


def decay(days: Column, half_life: float = 30.0) -> Column:
    return F.pow(F.lit(0.5), days / half_life)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; 0 where lengths differ or one is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def entropy(counts: Column, total: Column) -> Column:
    """Bits, of an array of counts."""
    return F.aggregate(counts, F.lit(0.0), lambda s, c: s - c / total * F.log2(c / total))
