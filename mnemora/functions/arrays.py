"""Array helpers built from higher-order functions; all run in one row, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indexes(count: Column) -> Column:
    """0 .. count-1, empty when count is 0 or less."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def total(values: Column) -> Column:
    """Sum of an array as DOUBLE, 0.0 for an empty one."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def run_starts(ordered: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Indexes where a run of equal neighbours starts in a sorted array."""
    return F.filter(
        indexes(F.size(ordered)),
        lambda i: (i == 0) | ~same(F.get(ordered, i), F.get(ordered, i - 1)),
    )


def value_counts(values: Column) -> Column:
    """Distinct values with their counts, ``array<struct<value, n>>``, by sorting: O(n log n)."""
    return let(
        F.sort_array(values),
        lambda s: let(
            run_starts(s, lambda a, b: a == b),
            lambda st: F.transform(
                st,
                lambda p, j: F.struct(
                    F.get(s, p).alias("value"),
                    (F.coalesce(F.get(st, j + 1), F.size(s)) - p).alias("n"),
                ),
            ),
        ),
    )


def keep_first(keys: Column) -> Column:
    """Indexes of the first occurrence of every key, ascending."""
    return let(
        F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))),
        lambda s: F.sort_array(
            F.transform(
                run_starts(s, lambda a, b: a["k"] == b["k"]),
                lambda p: F.get(s, p)["i"],
            )
        ),
    )


def r6(value: Column) -> Column:
    """Round for comparison; the nudge keeps exact halves off the rounding edge."""
    return F.round(value + F.lit(1e-9), 6)
