"""Row and column shaping: filters, masks, names, unions, long form."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

from driftline.functions.cond import clip_to_null as _clip
from driftline.functions.cond import masked, nan_to_null, r_ifelse
from driftline.functions.times import ts


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing; done once, where data enters."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floats}) if floats else df


# filters --------------------------------------------------------------------

def between_time(df: DataFrame, lo: str | None = None, hi: str | None = None,
                 closed: bool = False, time: str = "date") -> DataFrame:
    """Rows inside the bounds, which are open unless ``closed``."""
    instant = F.col(time)
    if lo is not None:
        df = df.filter(instant >= ts(lo) if closed else instant > ts(lo))
    if hi is not None:
        df = df.filter(instant <= ts(hi) if closed else instant < ts(hi))
    return df


def exclude(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    """Rows whose value is none of ``values``; an unknown value drops the row."""
    return df.filter(~F.col(col).isin(list(values)))


def only(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    return df.filter(F.col(col).isin(list(values)))


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows without any missing value."""
    return df.na.drop("any")


# masks and flags ------------------------------------------------------------

def mask(df: DataFrame, spec: Mapping[str, Iterable[str]], null_flag: str = "keep") -> DataFrame:
    """Null each value column where one of its flag columns is set.

    ``null_flag='keep'`` reads an unknown flag as not set, ``'drop'`` nulls the value.
    """
    return df.withColumns({
        value: masked(F.col(value), [F.col(f) for f in flags], null_flag)
        for value, flags in spec.items() if flags})


def mask_interval(df: DataFrame, col: str, lo: str, hi: str, time: str = "date") -> DataFrame:
    """Null ``col`` in the closed interval; an unknown instant nulls it as well."""
    return df.withColumn(
        col, r_ifelse(F.col(time).between(ts(lo), ts(hi)), F.lit(None), F.col(col)))


def clip_to_null(df: DataFrame, col: str, lo: float | None = None,
                 hi: float | None = None) -> DataFrame:
    return df.withColumn(col, _clip(F.col(col), lo, hi))


def override_flag(df: DataFrame, col: str,
                  windows: Iterable[tuple[str | None, str | None]] = (),
                  when_set: str | None = None, value: int = 0,
                  time: str = "date") -> DataFrame:
    """Set the flag to ``value`` inside open windows and where another flag is set.

    A window's missing bound (None) is no bound. An unknown other flag makes the result unknown, as a two-way choice would.
    """
    flag = F.col(col)
    for lo, hi in windows:
        inside = F.lit(True)
        if lo is not None:
            inside = F.col(time) > ts(lo)
        if hi is not None:
            inside = inside & (F.col(time) < ts(hi))
        flag = r_ifelse(inside, F.lit(value), flag)
    if when_set is not None:
        flag = r_ifelse(F.col(when_set) != 0, F.lit(value), flag)
    return df.withColumn(col, flag)


# names and shapes -----------------------------------------------------------

def _snake(name: str) -> str:
    name = re.sub(r"([a-z])([A-Z])|([A-Z])([A-Z][a-z])", r"\1\3_\2\4", name.strip())
    name = re.sub(r"[^0-9A-Za-z]+", "_", name.replace("%", "_percent_").replace("#", "_number_"))
    name = name.strip("_").lower()
    return f"x{name}" if not name or name[0].isdigit() else name


def clean_names(df: DataFrame) -> DataFrame:
    """Unique snake_case names; repeats get ``_2``, ``_3``, ..."""
    names: list[str] = []
    for name in map(_snake, df.columns):
        number, free = 1, name
        while free in names:
            number += 1
            free = f"{name}_{number}"
        names.append(free)
    return df.toDF(*names)


def remove_empty(df: DataFrame, which: Iterable[str] = ("rows", "cols")) -> DataFrame:
    """Drop rows and columns holding nothing; columns need one counting pass."""
    which = set(which)
    if "rows" in which:
        df = df.na.drop("all")
    if "cols" in which:
        counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
        df = df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c] > 0])
    return df


def rename_channels(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """``{old: new}``; every old name has to be there."""
    missing = set(mapping) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.withColumnsRenamed(dict(mapping))


def bind_rows(*tables: DataFrame, strict: bool = False) -> DataFrame:
    """Append tables by name; a missing column is NULL, or an error if ``strict``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=not strict), tables)


def species_long(df: DataFrame, values: Iterable[str], ids: Iterable[str] = ("date",),
                 name: str = "name", value: str = "value") -> DataFrame:
    """Wide to long: one row per id and value column."""
    return df.unpivot(list(ids), list(values), name, value)


def tagged_union(parts: Mapping[str, tuple[DataFrame, str]], ids: Iterable[str] = ("date",),
                 tag: str = "species", value: str = "value") -> DataFrame:
    """Long form of value columns that live in differently sampled tables."""
    return bind_rows(*[
        df.select(*ids, F.col(col).cast("double").alias(value), F.lit(label).alias(tag))
        for label, (df, col) in parts.items()], strict=True)


def assert_unique(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """``df`` itself, after checking that no key repeats (one aggregate job)."""
    keys = list(keys)
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").first()
    if twice is not None:
        raise ValueError(f"repeated key {[twice[k] for k in keys]}")
    return df


def column_or_null(df: DataFrame, name: str, type_: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(type_)
