"""Column helpers for operators that use built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x)


def prefix_sums(array: Column, then: Callable[[Column, Column], Column]) -> Column:
    """The array's places i (from 0) mapped by then(i, sum of the ints before i).

    Sums are taken over blocks of about the root of the size: n ** 1.5 steps rather than n ** 2.
    """

    def by_blocks(s: Column) -> Column:
        a, width = s["a"], s["w"]
        sums = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(a) - 1), width), lambda b: total(F.slice(a, b + 1, width)))

        def at(t: Column, i: Column) -> Column:
            block = F.floor(i / width).cast("int")
            return then(i, total(F.slice(t, F.lit(1), block)) + total(F.slice(a, block * width + 1, i - block * width)))

        return let(sums, lambda t: F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: at(t, i)))

    return let(F.struct(array.alias("a"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(array)))).cast("int").alias("w")), by_blocks)


def matches(text: Column, pattern: Column, fields: Callable[[Column, Column, Column], Column]) -> Column:
    """An array of fields(match, start, end) for the leftmost non-overlapping matches; code points, end exclusive.

    The pattern must not match the empty string. fields may give null: drop those with array_compact.
    """

    def of(s: Column) -> Column:
        found, pieces = s["m"], s["p"]
        steps = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(pieces, i + 1)))
        first = F.length(F.get(pieces, F.lit(0)))
        return prefix_sums(steps, lambda i, before: let(F.struct(F.get(found, i).alias("m"), (first + before).alias("s")), lambda x: fields(x["m"], x["s"], x["s"] + F.length(x["m"]))))

    both = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    return let(both, lambda s: F.when(F.size(s["m"]) > 0, of(s)))
