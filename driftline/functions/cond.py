"""Conditionals with the NULL rules the quality-control scripts rely on."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, functions as F


def r_ifelse(condition: Column, yes, no) -> Column:
    """Two-way choice where an unknown condition gives NULL (not ``no``)."""
    return F.when(condition.isNotNull(), F.when(condition, yes).otherwise(no))


def case_when(branches: Iterable[tuple[Column, object]], default=None) -> Column:
    """First true branch wins; unknown conditions fall through."""
    first, *rest = branches
    chain = F.when(*first)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def recode(column: Column, codes: Mapping[str, int]) -> Column:
    return case_when([(column == label, F.lit(code)) for label, code in codes.items()])


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def any_set(flags: Iterable[Column], null_flag: str = "keep") -> Column:
    """True when one of the flags is not 0.

    ``null_flag='keep'`` reads an unknown flag as not set; ``'drop'`` lets it
    make the answer unknown unless another flag is set already.
    """
    tests = [f != 0 for f in flags]
    if null_flag == "keep":
        tests = [F.coalesce(t, F.lit(False)) for t in tests]
    return reduce(lambda a, b: a | b, tests)


def masked(value: Column, flags: Iterable[Column], null_flag: str = "keep") -> Column:
    """NULL where a flag is set, see :func:`any_set` for unknown flags."""
    return F.when(~any_set(flags, null_flag), value)


def clip_to_null(value: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """NULL outside the closed range ``[lo, hi]``; an open end is None."""
    inside = F.lit(True)
    if lo is not None:
        inside = inside & (value >= lo)
    if hi is not None:
        inside = inside & (value <= hi)
    return F.when(inside, value)


def below_limit(value: Column, limit) -> Column:
    """1 below the limit, 0 at or above it, NULL where the value is missing."""
    return (value < limit).cast("int")


def combine_flags(*flags: Column) -> Column:
    """One 0/1 flag out of several; unknown if any is unknown."""
    total = reduce(lambda a, b: a + b, flags)
    return F.when(total.isNotNull(), F.when(total > 0, 1).otherwise(0))
