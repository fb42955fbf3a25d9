"""Compile raw logger and ship files into tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructType, TimestampNTZType

from driftline.functions.times import (join_text, parse_dmy_hms, parse_mdy_hms, round_second,
                                       shift)
from driftline.operators.align import align_left
from driftline.operators.rows import bind_rows, clean_names, remove_empty, rename_channels
from driftline.sources.tables import read_positional, read_table

# fixed values: places of the wanted fields in headerless surface met files
SURFACE_MET = {2: "date", 3: "time", 11: "rel_ws", 12: "rel_wd", 13: "air_temp",
               14: "air_humidity"}
_MET_VALUES = ("rel_ws", "rel_wd", "air_temp", "air_humidity")


def harmonise_logs(spark: SparkSession, sets: Sequence[tuple[str | Sequence[str], float]],
                   channels: Mapping[str, str], time: str = "TheTime",
                   text: Sequence[str] = (), round_to_second: bool = False) -> DataFrame:
    """Logger files written under different clocks, as one table in UTC.

    ``sets`` holds (paths, hours the clock is ahead of UTC). Every column but the
    instant and those in ``text`` is numeric. The sets must have equal columns.
    The result has no order; sort where it is written.
    """
    tables = []
    for paths, ahead in sets:
        raw = read_table(spark, paths)
        values = [c for c in raw.columns if c != time and c not in text]
        tables.append(raw.select(
            shift(parse_mdy_hms(F.col(time)), -ahead).alias("date"),
            *[F.col(f"`{c}`").try_cast("double").alias(c) for c in values], *text))
    merged = remove_empty(clean_names(bind_rows(*tables, strict=True)))
    renamed = rename_channels(merged, {k: v for k, v in channels.items() if k in merged.columns})
    return renamed.withColumn("date", round_second(F.col("date"))) if round_to_second else renamed


def compile_surface_met(spark: SparkSession, paths: str | Sequence[str],
                        glob: str | None = None) -> DataFrame:
    """Relative wind and air state from headerless surface met files."""
    raw = read_positional(spark, paths, SURFACE_MET, glob=glob)
    return raw.select(
        round_second(parse_dmy_hms(join_text(F.col("date"), F.col("time")))).alias("date"),
        *[F.col(c).try_cast("double").alias(c) for c in _MET_VALUES])


def compile_navigation(spark: SparkSession, paths: str | Sequence[str],
                       glob: str | None = None, index: str = "X") -> DataFrame:
    """Ship position files; the row index they carry is dropped."""
    schema = StructType().add("date", TimestampNTZType())
    for name in ("lat", "long", "speed", "heading"):
        schema = schema.add(name, DoubleType())
    raw = read_table(spark, paths, schema, glob=glob)
    return raw.drop(index).withColumn("date", round_second(F.col("date")))


def compile_met(navigation: DataFrame, surface: DataFrame) -> DataFrame:
    """Surface met joined onto the navigation instants."""
    return align_left(navigation, [surface])
