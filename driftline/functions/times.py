"""Instants: typed literals, parsing, rounding, binning.

Every instant is TIMESTAMP_NTZ holding UTC. All expressions here stay in that
type, so results do not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# year/month/day order of the three text layouts and the capture groups that
# rearrange each of them into the ISO order
_LAYOUTS = {
    "ymd": (r"(\d{4})\D+(\d{1,2})\D+(\d{1,2})", "$1-$2-$3"),
    "mdy": (r"(\d{1,2})\D+(\d{1,2})\D+(\d{4})", "$3-$1-$2"),
    "dmy": (r"(\d{1,2})\D+(\d{1,2})\D+(\d{4})", "$3-$2-$1"),
}
_CLOCK = r"\D+(\d{1,2})\D(\d{1,2})\D(\d{1,2}(?:\.\d{1,6})?)\d*(?:Z|\s*UTC)?\s*$"


def ts(text: str) -> Column:
    """A TIMESTAMP_NTZ literal."""
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def _parse(text: Column, layout: str) -> Column:
    day, iso = _LAYOUTS[layout]
    pattern = r"^\s*" + day + _CLOCK
    rearranged = F.regexp_replace(text, pattern, iso + " $4:$5:$6")
    return F.when(text.rlike(pattern), rearranged.try_cast("timestamp_ntz"))


def parse_ymd_hms(text: Column) -> Column:
    return _parse(text, "ymd")


def parse_mdy_hms(text: Column) -> Column:
    return _parse(text, "mdy")


def parse_dmy_hms(text: Column) -> Column:
    return _parse(text, "dmy")


def join_text(*parts: Column) -> Column:
    """Glue date and time texts with one blank (NULL if any part is NULL)."""
    spaced = [parts[0]]
    for part in parts[1:]:
        spaced += [F.lit(" "), part]
    return F.concat(*spaced)


def round_second(instant: Column) -> Column:
    """Nearest second, half up. Like time_bin, one per select or withColumn.

    A second's window is moved back by half a second; its middle is the answer.
    """
    known = F.coalesce(instant, ts("1970-01-01"))  # a window would drop the row
    half = F.expr("INTERVAL '0.5' SECOND")
    window = F.window(known, "1 second", startTime="500 milliseconds")
    return F.when(instant.isNotNull(), window.start + half)


def shift(instant: Column, hours: float) -> Column:
    """Move an instant by a fixed number of hours (negative: earlier)."""
    return instant + F.expr(f"INTERVAL '{hours * 3600:f}' SECOND")


_UNITS = {"s": 1, "sec": 1, "second": 1, "min": 60, "minute": 60, "h": 3600, "hour": 3600,
          "day": 86400}


def bin_seconds(every: str) -> int:
    """Length of a bin such as "1 min", "hour" or "10 minutes"."""
    number, _, unit = every.strip().rpartition(" ")
    unit = unit if unit in _UNITS else unit.removesuffix("s")
    if unit not in _UNITS:
        raise ValueError(f"not a time bin: {every!r}")
    return int(number or 1) * _UNITS[unit]


def time_bin(instant: Column, every: str, rounded: bool = False) -> Column:
    """Start of the bin holding the instant; rows without one drop out.

    ``rounded`` bins the nearest second. Spark's tumbling window is integer
    arithmetic, several times cheaper than truncation; it allows one such column per
    select or withColumn. As no bin is missing the column says so, which spares the
    joins on it a test for missing keys among the raw rows.
    """
    length = bin_seconds(every)
    if rounded:
        window = F.window(instant, f"{length} seconds",
                          startTime=f"{length * 1000 - 500} milliseconds")
        start = window.start + F.expr("INTERVAL '0.5' SECOND")
    else:
        start = F.window(instant, f"{length} seconds").start
    return F.coalesce(start, ts("1970-01-01"))


def day_number(instant: Column) -> Column:
    return F.datediff(F.to_date(instant), F.lit("1970-01-01").cast("date"))


def hour_number(instant: Column) -> Column:
    return day_number(instant) * 24 + F.hour(instant)


def epoch_seconds(instant: Column) -> Column:
    since = instant - ts("1970-01-01")
    return since.cast("interval second").cast("decimal(18,6)").cast("double")


def epoch_micros(instant: Column) -> Column:
    """Whole microseconds since 1970, exact."""
    since = instant.cast("timestamp_ntz") - ts("1970-01-01")
    return (since.cast("interval second").cast("decimal(18,6)") * 1_000_000).cast("bigint")


def from_micros(micros: Column) -> Column:
    seconds = (micros.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return ts("1970-01-01") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
