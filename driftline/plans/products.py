"""The quality-controlled tables the campaign publishes.

Inputs (instants in UTC, TIMESTAMP_NTZ):

measured  date, so2, noy, no, no2, o3, zero_box, so2_zero_channel
co        date, co_calibrated
met       output of driftline.operators.wind.true_wind
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from driftline.functions.cond import below_limit, case_when, r_ifelse
from driftline.functions.times import round_second
from driftline.operators.align import align_full, align_left
from driftline.operators.groups import lod
from driftline.operators.intervals import flag_intervals, rule_column, tag_intervals
from driftline.operators.rows import (between_time, column_or_null, mask, mask_interval,
                                      nan_as_null, only, override_flag, species_long)
from driftline.operators.scan import Order
from driftline.operators.timebin import time_average
from driftline.operators.wind import wind_average
from driftline.operators.zeroes import (Offset, apply_constant, apply_offsets, station_zeroes,
                                        zero_cycles)
from driftline.plans import rules

# fixed values: columns of the published tables and of the measured input
SPECIES = ("co", "so2", "noy", "o3", "no", "no2", "nox")
MEASURED = ("so2", "noy", "no", "no2", "zero_box", "so2_zero_channel", "o3")


# tags and flags -------------------------------------------------------------

def tag_station(df: DataFrame, coarse: bool = False, out: str = "station") -> DataFrame:
    return tag_intervals(df, rules.stations(coarse), out)


def instrument_flags(df: DataFrame, version: str = "current",
                     polluted: bool = False) -> DataFrame:
    """Add nox and the nine 0/1 flags (earlier versions also use code 2).

    ``polluted`` counts the polluted leg as bad for every instrument.
    """
    if version == "current":
        df = df.withColumn("nox", F.col("no") + F.col("no2"))
    flags = rules.flag_rules(version)
    if polluted:
        flags["flag_all"] = [*flags["flag_all"], *rules.pollution()]
    return df.withColumns({flag: rule_column(set_, 0) for flag, set_ in flags.items()})


def stack_flags(df: DataFrame, coded: bool = True) -> DataFrame:
    """Whose plume is sampled: 0 none, 1 calm, 2 astern, 3 other ship, 4 NOx only."""
    if "ws" in df.columns:
        df = mask_interval(df, "ws", *rules.WS_MASK)
    default = rules.STACK_CODES["no"] if coded else "no"
    return df.withColumn("stack_flag", rule_column(rules.plume_rules(coded), default))


def zeroing_flag(df: DataFrame, out: str = "flag") -> DataFrame:
    return flag_intervals(df, rules.zeroing_flag(), out)


def pollution_flag(df: DataFrame, out: str = "poll") -> DataFrame:
    return flag_intervals(df, rules.pollution(), out)


# tables ---------------------------------------------------------------------

def corrected_minutes(measured: DataFrame, offsets: Sequence[Offset] | None = None,
                      fix_sources: bool = False) -> DataFrame:
    """Station zeroes taken off NO and NO2 at native cadence, then minute means."""
    rows = nan_as_null(measured.select("date", *MEASURED))
    rows = rows.withColumn("second", round_second(F.col("date")))
    rows = tag_intervals(rows, rules.stations(), "station", time="second")
    rows = apply_offsets(rows, offsets or rules.offsets(), fix_sources=fix_sources)
    rows = rows.drop("no", "no2").withColumnsRenamed({"no_corr": "no", "no2_corr": "no2"})
    return time_average(rows, "1 minute", rounded=True)


def calibrated_co(co: DataFrame, bin_first: bool = False) -> DataFrame:
    rows = nan_as_null(co).withColumn("date", round_second(F.col("date")))
    rows = between_time(rows, hi=rules.CO_END).select("date", F.col("co_calibrated").alias("co"))
    return time_average(rows, "1 minute") if bin_first else rows


def minute_table(measured: DataFrame, co: DataFrame, met: DataFrame, how: str = "left",
                 bin_first: bool = False, fix_sources: bool = False) -> DataFrame:
    """All channels by minute.

    ``left``: the minutes that have met rows; ``full``: any instant. CO joins at its
    own instants unless ``bin_first``, so the left form keeps its full minutes only
    and the full form has extra rows.
    """
    wind = wind_average(nan_as_null(met))
    gases = corrected_minutes(measured, fix_sources=fix_sources)
    co = calibrated_co(co, bin_first)
    if how == "left":
        if not bin_first:  # only full minutes can meet one; the others need not be exchanged
            co = co.filter(F.second("date") == 0)
        return align_left(wind, [co, gases])
    # averages never repeat an instant, CO may: it alone joins the costlier way
    if bin_first:
        return align_full([wind, co, gases], unique=True)
    return align_full([align_full([wind, gases], unique=True), co])


def flagged_table(table: DataFrame) -> DataFrame:
    """A minute table with instrument flags, station and stack flag."""
    return stack_flags(tag_station(instrument_flags(table)))


def qc_mask(df: DataFrame, spec: Mapping[str, Sequence[str]] | None = None,
            drop_flag: str | None = "flag_all", null_flag: str = "keep") -> DataFrame:
    """Drop the rows no instrument is trusted in and null the flagged species."""
    if drop_flag is not None:
        df = df.filter(F.col(drop_flag) == 0)
    return mask(df, spec or rules.QC_MASK, null_flag)


def qc_mask_older(df: DataFrame, skip: Iterable[str] = ()) -> DataFrame:
    """Earlier masking: rows stay, an unknown flag nulls the value, SO2 is masked.

    A flag that a present value depends on has to be there too, unless ``skip`` names it.
    """
    skip = set(skip)
    spec = {value: tuple(f for f in flags if f not in skip)
            for value, flags in rules.OLDER_QC_MASK.items() if value in df.columns}
    absent = {f for flags in spec.values() for f in flags} - set(df.columns)
    if absent:
        raise ValueError(f"no such flags: {sorted(absent)}")
    return qc_mask(df, spec, drop_flag=None, null_flag="drop")


# products -------------------------------------------------------------------

def _published(df: DataFrame) -> DataFrame:
    return df.select("date", *[F.col(s).alias(f"{s}_ppb") for s in SPECIES], "stack_flag")


def minute_product(measured: DataFrame, co: DataFrame, met: DataFrame, **options) -> DataFrame:
    """Masked minutes with limits of detection and flags of values below them."""
    table = flagged_table(minute_table(measured, co, met, how="full", **options))
    return lod_flags(qc_mask(table))


def lod_flags(masked: DataFrame, limits: Mapping[str, float] | None = None) -> DataFrame:
    limits = limits or rules.LODS
    out = masked.select("date", *SPECIES, "stack_flag")
    out = out.withColumns({f"{s}_lod": F.lit(v) for s, v in limits.items()})
    out = out.withColumns({f"{s}_flag": below_limit(F.col(s), F.col(f"{s}_lod"))
                           for s in ("no", "no2", "noy", "nox")})
    return out.withColumnsRenamed({s: f"{s}_ppb" for s in SPECIES})


def hourly_product(measured: DataFrame, co: DataFrame, met: DataFrame, **options) -> DataFrame:
    """Hourly means of the masked minutes (of the stack flag code too)."""
    table = flagged_table(minute_table(measured, co, met, how="left", **options))
    # Distrusted minutes are blanked, not filtered: Spark would push a filter on the
    # minute down to the raw rows and test every rule there. Hours left with no
    # minute at all go by their empty count.
    trusted = F.col("flag_all") == 0
    masked = mask(table, rules.QC_MASK).select("date", *[
        F.when(trusted, F.col(c)).alias(c) for c in (*SPECIES, "stack_flag")],
        F.when(trusted, 1).alias("minutes"))
    return _published(time_average(masked, "1 hour").filter(F.col("minutes").isNotNull()))


def stack_fractions(flagged: DataFrame, every: str = "1 hour") -> DataFrame:
    """Share of rows per stack flag code in each bin, beside the mean of codes."""
    shares = flagged.select("date", *[
        (F.col("stack_flag") == code).cast("double").alias(f"share_{label}")
        for label, code in rules.STACK_CODES.items()])
    return time_average(shares, every)


def species_table(df: DataFrame, species: Sequence[str],
                  ids: Sequence[str] = ("date",)) -> DataFrame:
    return species_long(df, species, ids)


def older_one_minute(df: DataFrame, polluted: bool = False,
                     since: str | None = None) -> DataFrame:
    """Earlier minute means: any missing sample makes the minute missing.

    ``since`` keeps the rows after that instant only.
    """
    means = time_average(between_time(df, lo=since) if since else df, "1 minute", strict=True)
    if "co_cal" in means.columns:
        means = override_flag(means, "co_cal", [(None, rules.CO_CAL_START)])
    return instrument_flags(means, version="v1", polluted=polluted)


def older_minute_product(measured: DataFrame, co: DataFrame) -> DataFrame:
    """Earlier minute product: constant zeroes, values masked as sampled, then minute means.

    The flags are averaged like the values. CO is masked by its own two flags and joins
    at its own instants, so a minute has the CO of its first second or none.
    """
    rows = nan_as_null(measured.select("date", *MEASURED))
    rows = instrument_flags(apply_constant(rows, rules.CONSTANT_ZEROES), "v2").drop("co_flag")
    rows = pollution_flag(rows, "pollution")
    spec = {("so2" if value == "so2_corr" else value): flags
            for value, flags in rules.OLDER_QC_MASK.items() if value != "co"}
    masked = qc_mask(rows, spec, drop_flag=None, null_flag="drop")
    minutes = time_average(masked.withColumn("date", round_second(F.col("date"))), "1 minute")
    flags = rules.flag_rules("v2")
    co = calibrated_co(co).filter(F.second("date") == 0).withColumns({
        "co_flag_all": rule_column(flags["flag_all"], 0),
        "co_flag": rule_column(flags["co_flag"], 0)})
    return align_left(minutes, [mask(co, {"co": ("co_flag_all", "co_flag")})])


# zeroes and limits ----------------------------------------------------------

def zero_job_rows(measured: DataFrame) -> DataFrame:
    """Samples the zero jobs work on: calibrations removed, station known."""
    flagged = flag_intervals(measured, rules.zero_job_calibration(), "nox_cal")
    return tag_station(flagged.filter("nox_cal = 0"))


def older_zero_rows(flagged: DataFrame) -> DataFrame:
    """Rows of the earlier zero job: distrusted ones out, flagged species blank, status known."""
    return flagged.filter("flag_all = 0").withColumns({
        **{c: F.coalesce(F.col(c), F.lit(0)) for c in ("zero_box", "so2_zero_channel")},
        **{c: r_ifelse(F.col(flag) == 1, F.lit(None), F.col(c))
           for c, flag in (("no", "nox_flag"), ("no2", "nox_flag"), ("so2", "so2_flag"))}})


def station_zero_rows(measured: DataFrame) -> DataFrame:
    """Rows of the zero job by station: flagged, calibrating and polluted ones out."""
    clean = zeroing_flag(measured, "__flag").filter("__flag = 0").drop("__flag")
    return tag_station(clean.withColumn("zero_box", F.coalesce("zero_box", F.lit(0))))


def station_zero_table(measured: DataFrame, order: Order, stat: str = "mean",
                       scan: str = "auto") -> DataFrame:
    """NO and NO2 zero of each station, the odd cycles left out."""
    return station_zeroes(zero_job_rows(measured), ["no", "no2"], order,
                          exclude_stations=rules.ZERO_EXCLUDED_STATIONS,
                          exclude_ids=rules.ZERO_EXCLUDED_CYCLES, stat=stat, scan=scan)


def detection_limits(measured: DataFrame, order: Order, scan: str = "auto") -> DataFrame:
    """Limits of detection from the long zero cycles."""
    cycles = zero_cycles(zero_job_rows(measured), "zero_box", order, scan=scan)
    return lod(only(cycles, "id", rules.LOD_CYCLES), "no", "no2", [*order.series, "id"])


# SO2 diagnostics ------------------------------------------------------------

# fixed values: raw diagnostic columns of the SO2 analyser and their names
SO2_DIAGNOSTICS = {
    "t101_022639_samppress": "samp_pressure",
    "t101_022639_sampflow": "samp_flow",
    "t101_022639_rcelltemp": "rcell_temp",
    "t101_022639_boxtemp": "box_temp",
    "t101_022639_pmttemp": "pmt_temp",
    "t101_022639_convtemp": "conv_temp",
}


def so2_diagnostics(raw: DataFrame) -> DataFrame:
    """SO2 with the analyser's housekeeping channels."""
    return raw.select(
        round_second(F.col("date")).alias("date"), "so2",
        *[column_or_null(raw, old, "double").alias(new) for old, new in SO2_DIAGNOSTICS.items()],
        "so2_zero_channel")


def so2_flags(flagged: DataFrame) -> DataFrame:
    """SO2 with one instrument flag and one plume flag."""
    bad = case_when([(F.col("flag_all") == 1, F.lit(1)), (F.col("so2_flag") == 1, F.lit(1))], 0)
    ship = case_when([(F.col("stack_flag") == 0, F.lit(0))], 1)
    return flagged.select("date", "so2", "so2_zero_channel", bad.alias("flag"),
                          ship.alias("ship_flag"))

