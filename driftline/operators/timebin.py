"""Averages over time bins, with the vector mean of wind."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

from driftline.functions.angles import direction_of, speed_of
from driftline.functions.stats import mean_strict
from driftline.functions.times import bin_seconds, time_bin
from driftline.operators.groups import join_on


def time_average(df: DataFrame, every: str = "1 minute", by: Iterable[str] = (),
                 time: str = "date", wind: Sequence[tuple[str, str]] = (),
                 vector_ws: bool = False, strict: bool = False,
                 columns: Iterable[str] | None = None, pad: bool = False,
                 rounded: bool = False) -> DataFrame:
    """Mean of the numeric columns per bin; other columns drop out.

    ``wind`` names (direction, speed) pairs. A direction is averaged as a vector:
    weighted with the speed if ``vector_ws`` (the speed then is the length of the
    mean vector), else as unit vectors beside the plain mean speed.
    ``strict`` makes a bin with any missing value missing. ``pad`` adds the bins
    between a series' first and last that have no rows. ``rounded`` bins instants
    as if rounded to the second.

    One shuffle on (by, bin) of partial sums, so a crowded bin or series is
    reduced where it is read. Rows without an instant are left out.
    """
    binned = df.withColumn(time, time_bin(F.col(time), every, rounded))
    means = bin_means(binned, by, time, wind, vector_ws, strict, columns)
    return pad_bins(means, every, by, time) if pad else means


def bin_means(binned: DataFrame, by: Iterable[str], time: str,
              wind: Sequence[tuple[str, str]] = (), vector_ws: bool = False,
              strict: bool = False, columns: Iterable[str] | None = None) -> DataFrame:
    """The averages of :func:`time_average` over rows whose instant is a bin already."""
    by = list(by)
    paired = {name for pair in wind for name in pair}
    hidden = {"u", "v"} if wind else set()  # components are recomputed from the means
    if columns is None:
        columns = [f.name for f in binned.schema if isinstance(f.dataType, NumericType)]
    plain = [c for c in columns if c not in {*by, time, *paired, *hidden}]
    mean = mean_strict if strict else F.avg

    aggregates = [mean(F.col(c)).alias(c) for c in plain]
    for wd, ws in wind:
        weight = F.col(ws) if vector_ws else F.lit(1.0)
        aggregates += [mean(weight * F.sin(F.radians(wd))).alias(f"__u_{wd}"),
                       mean(weight * F.cos(F.radians(wd))).alias(f"__v_{wd}")]
        if not vector_ws:
            aggregates.append(mean(F.col(ws)).alias(f"__s_{wd}"))

    means = binned.groupBy(*by, time).agg(*(aggregates or [F.count(F.lit(1))]))
    winds = []
    for wd, ws in wind:
        u, v = F.col(f"__u_{wd}"), F.col(f"__v_{wd}")
        speed = speed_of(u, v) if vector_ws else F.col(f"__s_{wd}")
        winds += [direction_of(u, v).alias(wd), speed.alias(ws)]
    return means.select(*by, time, *plain, *winds)


def pad_bins(df: DataFrame, every: str, by: Iterable[str] = (), time: str = "date") -> DataFrame:
    """Add the missing bins of each series between its first and last bin."""
    by = list(by)
    step = bin_seconds(every)
    chunk = step * 1000  # bins are listed a thousand at a time, however long the series
    span = df.groupBy(*by).agg(F.min(time).alias("__lo"), F.max(time).alias("__hi"))
    chunks = span.withColumn("__lo", F.explode(F.sequence(
        "__lo", "__hi", F.expr(f"INTERVAL '{chunk}' SECOND"))))
    last = F.least(F.col("__hi"), F.col("__lo") + F.expr(f"INTERVAL '{chunk - step}' SECOND"))
    bins = chunks.select(*by, F.explode(F.sequence(
        F.col("__lo"), last, F.expr(f"INTERVAL '{step}' SECOND"))).alias(time))
    return join_on(bins, df, [*by, time], "left").select(*df.columns)
