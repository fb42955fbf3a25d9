"""Aggregate expressions, with the strict (any NULL gives NULL) forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _strict(aggregate: Column, value: Column) -> Column:
    return F.when(F.count(value) == F.count(F.lit(1)), aggregate)


def mean_strict(value: Column) -> Column:
    return _strict(F.avg(value), value)


def sd_strict(value: Column) -> Column:
    return _strict(F.stddev_samp(value), value)


def quadrature(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)
