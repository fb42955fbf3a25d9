"""True wind from the wind measured on a moving ship."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftline.functions.angles import (direction_of, east, knots_to_ms, north, speed_of,
                                        wrap_once)
from driftline.operators.rows import drop_incomplete
from driftline.operators.timebin import time_average


def true_wind(df: DataFrame, index: str | None = "...1",
              corrected_direction: bool = False) -> DataFrame:
    """Add the true wind to rows of heading, speed (knots), rel_ws and rel_wd.

    rel_wd is 0 for a headwind. ``true_wd`` is the apparent direction in the earth
    frame; ``corrected_direction`` adds ``true_wd_corrected``, taken from the
    vector that has the ship's own motion removed. Incomplete rows drop out.
    """
    if index and index in df.columns:
        df = df.drop(index)
    col = F.col
    df = drop_incomplete(df).withColumn("true_wd", wrap_once(col("heading") + col("rel_wd")))
    df = df.withColumn("true_wd_towards", wrap_once(col("true_wd") + 180))
    ship = knots_to_ms(col("speed"))
    df = df.withColumns({
        "u_rel": east(col("rel_ws"), col("true_wd_towards")),
        "v_rel": north(col("rel_ws"), col("true_wd_towards")),
        "ship_motion_u": east(ship, col("heading")),
        "ship_motion_v": north(ship, col("heading"))})
    df = df.withColumns({"u": col("u_rel") + col("ship_motion_u"),
                         "v": col("v_rel") + col("ship_motion_v")})
    df = df.withColumn("ws", speed_of(col("u"), col("v")))
    if corrected_direction:
        # u, v point towards; a wind direction is where it comes from
        df = df.withColumn("true_wd_corrected", direction_of(-col("u"), -col("v")))
    return df


def wind_average(met: DataFrame, every: str = "1 minute", by: tuple[str, ...] = ()) -> DataFrame:
    """Binned relative and true wind (vector means) beside the other met channels.

    Both winds come from the same rows, so one aggregation serves both and their
    join on the bin is not needed.
    """
    named = met.select(*by, "date", "lat", "long", "speed", "heading", "air_temp",
                       "air_humidity", F.col("true_wd").alias("wd"), "ws", "rel_ws", "rel_wd")
    return time_average(named, every, by=by, wind=[("rel_wd", "rel_ws"), ("wd", "ws")],
                        vector_ws=True)
