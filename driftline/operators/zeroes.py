"""Instrument zeroes: find them, estimate them, subtract them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from driftline.functions.cond import clip_to_null, combine_flags, r_ifelse
from driftline.operators.groups import distinct_stats, group_mean, group_median, join_on
from driftline.operators.intervals import Interval, rule_column
from driftline.operators.rows import exclude
from driftline.operators.scan import (MAX_SLICE_ROWS, SLICE, Order, Sliced, _drop_run_columns,
                                      _RUN_COLUMNS, _interpolate, _runs, _trim, run_id,
                                      slice_series)
from driftline.session import small_table

#: What the runs tell beside their number; of no use once a cycle's edges are trimmed.
_PLACES = tuple(c for c in _RUN_COLUMNS if c != "run_id")


# tabulated offsets ----------------------------------------------------------

@dataclass(frozen=True)
class Offset:
    """``target - offset`` for a key; ``source`` is the column subtracted from."""

    key: str
    target: str
    source: str
    offset: float


def apply_offsets(df: DataFrame, offsets: Sequence[Offset], key: str = "station",
                  suffix: str = "_corr", fix_sources: bool = False) -> DataFrame:
    """Subtract the tabulated offset of each row's key, NULL where none is listed.

    ``fix_sources`` subtracts from the target column whatever the table says.
    """
    corrected = {}
    for target in dict.fromkeys(o.target for o in offsets):
        branches = " ".join(
            f"WHEN '{o.key}' THEN `{target if fix_sources else o.source}` - ({o.offset!r}D)"
            for o in offsets if o.target == target)
        corrected[target + suffix] = F.expr(f"CASE `{key}` {branches} END")
    return df.withColumns(corrected)


def apply_offset_table(df: DataFrame, table: DataFrame, targets: Iterable[str],
                       key: str = "station", suffix: str = "_corr") -> DataFrame:
    """The same with computed offsets: one row per key, one column per target.

    The table is broadcast only once its size is known to be small. An unknown key is a
    key like any other: it meets the table's row without one.
    """
    targets = list(targets)
    named = table.select(key, *[F.col(t).alias(f"__o_{t}") for t in targets])
    joined = join_on(df, small_table(named) or named, [key], "left")
    corrected = {t + suffix: F.col(t) - F.col(f"__o_{t}") for t in targets}
    return joined.withColumns(corrected).drop(*[f"__o_{t}" for t in targets])


def missing_keys(df: DataFrame, table: DataFrame, key: str = "station") -> DataFrame:
    """Keys of ``df`` without a computed offset, an unknown one among them."""
    known = table.select(F.col(key).alias("__key"))
    return df.select(key).distinct().join(known, F.col(key).eqNullSafe(F.col("__key")), "left_anti")


def apply_constant(df: DataFrame, offsets: Mapping[str, float],
                   suffix: str = "_corr") -> DataFrame:
    return df.withColumns({c + suffix: F.col(c) - F.lit(v) for c, v in offsets.items()})


# zero cycles ----------------------------------------------------------------

def zero_cycles(df: DataFrame, status: str, order: Order, out: str = "id",
                scan: str = "auto") -> DataFrame:
    """Number the stretches with status 1; a missing status counts as 0."""
    filled = df.withColumn(status, F.coalesce(F.col(status), F.lit(0)))
    return run_id(filled, status, 1, order, out=out, scan=scan)


def station_zeroes(df: DataFrame, channels: Iterable[str], order: Order,
                   status: str = "zero_box", key: str = "station",
                   exclude_stations: Iterable[str] = (), exclude_ids: Iterable[int] = (),
                   stat: str = "mean", scan: str = "auto") -> DataFrame:
    """One zero per station from its zero cycles, odd cycles left out.

    The mean is strict (a missing sample makes it missing), the median is not.
    """
    rows = zero_cycles(df, status, order, out="__cycle", scan=scan).filter(F.col(status) == 1)
    if exclude_stations:
        rows = exclude(rows, key, exclude_stations)
    if exclude_ids:
        rows = exclude(rows, "__cycle", exclude_ids)
    keys = [*order.series, key]
    return group_median(rows, keys, channels) if stat == "median" \
        else group_mean(rows, keys, channels, strict=True)


# attaching run statistics ---------------------------------------------------

def _group_stats(sliced: Sliced, keys: list[str], channels: Mapping[str, str], stat: str,
                 strict: bool) -> DataFrame:
    """Statistic of each channel over the rows in wanted runs, by ``keys``."""
    rows = sliced.df.filter("run_id > 0").select(
        *keys, *[F.col(c).alias(out) for out, c in channels.items()])
    return group_median(rows, keys, channels) if stat == "median" \
        else group_mean(rows, keys, channels, strict=strict)


def _attach(sliced: Sliced, table: DataFrame, keys: list[str]) -> Sliced:
    """Give every row in a wanted run its group's values (others: NULL).

    A run may be longer than a slice. The table is therefore spread to the slices
    each group touches, and the row join uses the slice as part of its key: no
    task receives more rows of one group than a slice holds.
    """
    values = [c for c in table.columns if c not in keys]
    tagged = sliced.df.withColumn("__in", F.when(F.col("run_id") > 0, F.lit(True)))
    spread = [*dict.fromkeys([*sliced.keys, *keys])]
    touched = tagged.filter("__in").select(*spread).distinct()
    local = join_on(touched, table, keys, "inner").withColumn("__in", F.lit(True))
    named = local.withColumnsRenamed({k: f"__r_{k}" for k in spread})
    same = [F.col(k) == F.col(f"__r_{k}") if k in (SLICE, "run_id")
            else F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in spread]
    named = named.withColumnRenamed("__in", "__r_in")
    joined = tagged.join(named, [*same, F.col("__in") == F.col("__r_in")], "left")
    return sliced.with_df(joined.select(
        *[c for c in sliced.df.columns if c not in values], *values))


def run_statistic(df: DataFrame, channels: Iterable[str], status: str, order: Order,
                  value=1, stat: str = "mean", strict: bool = False, prefix: str = "zero_",
                  scan: str = "auto", max_rows: int = MAX_SLICE_ROWS) -> DataFrame:
    """Mean or median of each run of ``status == value``, given back to its rows."""
    sliced = _runs(slice_series(df, order, scan, max_rows), status, value).staged(_PLACES)
    keys = [*order.series, "run_id"]
    names = {prefix + c: c for c in channels}
    attached = _attach(sliced, _group_stats(sliced, keys, names, stat, strict), keys)
    return _drop_run_columns(attached.df.withColumn("id", F.col("run_id"))).drop("__slice")


# interpolated zeroes --------------------------------------------------------

def interpolated_zero(df: DataFrame, channels: Iterable[str], status: str, order: Order,
                      stat: str = "mean", strict: bool = False, head: int = 0,
                      trim_background: bool = False,
                      reject: Mapping[str, tuple[float | None, float | None]] | None = None,
                      skip_ids: Iterable[int] = (), by: str | None = None,
                      x: str = "position", scan: str = "auto",
                      max_rows: int = MAX_SLICE_ROWS) -> DataFrame:
    """Subtract a zero level that is interpolated between the zero cycles.

    Each cycle (or, with ``by``, all cycles of one value of that column) gets the
    mean or median of its samples; estimates outside ``reject`` and those of
    ``skip_ids`` are discarded; the level between cycles follows the straight
    line by row position. ``head`` leaves out the first samples of each cycle
    (of the rest of the series too, with ``trim_background``).

    Adds ``id``, ``zero_<channel>`` and ``<channel>_corr``.
    """
    channels = list(channels)
    sliced = _runs(slice_series(df, order, scan, max_rows), status, 1)
    if head:
        sliced = _trim(sliced, channels, head, 0, trim_background)
    sliced = sliced.staged(_PLACES)
    keys = [*order.series, by or "run_id"]
    zero = {f"zero_{c}": c for c in channels}
    table = _group_stats(sliced, keys, zero, stat, strict)
    for c, (lo, hi) in (reject or {}).items():
        table = table.withColumn(f"zero_{c}", clip_to_null(F.col(f"zero_{c}"), lo, hi))
    attached = _attach(sliced, table, keys)
    if skip_ids:
        kept = ~F.col("run_id").isin(list(skip_ids))
        attached = attached.with_df(attached.df.withColumns(
            {z: F.when(kept, F.col(z)) for z in zero}))
    level = _interpolate(attached, list(zero), x, "")
    out = level.df.withColumn("id", F.col("run_id")).withColumns(
        {f"{c}_corr": F.col(c) - F.col(f"zero_{c}") for c in channels})
    return _drop_run_columns(out).drop("__slice")


# diagnostics ----------------------------------------------------------------

def zero_diagnostics(df: DataFrame, channel: str, keep: Iterable[str], order: Order,
                     drop_windows: Sequence[Interval], status: str = "zero_box",
                     flags: Sequence[str] = ("flag_all", "nox_flag"),
                     scan: str = "auto") -> tuple[DataFrame, DataFrame]:
    """Zero levels of one channel by mean and by median, with their spread.

    Zero samples inside ``drop_windows`` are discarded first. Returns the rows
    (median and mean per cycle, and both interpolated) and one row with mean and
    standard deviation over the distinct cycle values.
    """
    rows = df.select(*dict.fromkeys([*order.series, *order.by, channel, *keep, status, *flags]))
    rows = rows.withColumns({
        "flag": combine_flags(*[F.col(f) for f in flags]),
        "zero_flag": rule_column(drop_windows, 0, order.time)})
    rows = rows.withColumn(channel, r_ifelse(
        (F.col(status) == 1) & (F.col("zero_flag") == 1), F.lit(None), F.col(channel)))
    sliced = _runs(slice_series(rows, order, scan), status, 1).staged(_PLACES)
    keys = [*order.series, "run_id"]
    med, mean = f"zero_med_{channel}", f"zero_mean_{channel}"
    table = join_on(_group_stats(sliced, keys, {med: channel}, "median", False),
                    _group_stats(sliced, keys, {mean: channel}, "mean", False), keys, "left")
    attached = _attach(sliced, table, keys)
    level = _interpolate(attached, [med, mean], "position", "_line")
    out = _drop_run_columns(level.df.withColumn("id", F.col("run_id"))).drop("__slice")
    spread = distinct_stats(table.filter(F.col(mean).isNotNull()), [mean, med], order.series)
    return out, spread
