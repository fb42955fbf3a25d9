"""Versioned rule tables of the campaign.

All values below are fixed values: instants (UTC), labels, offsets and limits that
results have to agree on. They are data; nothing in the operators depends on them.
"""

from __future__ import annotations

from driftline.operators.intervals import Interval, Value
from driftline.operators.zeroes import Offset

# fixed values: stations, in order; the earlier one wins on a shared closed end.
# The first and the last are open, the others closed at both ends.
_STATIONS = (
    (None, "2022-05-20 20:15", "Reykjavik"),
    ("2022-05-20 20:15:00", "2022-05-23 06:15:00", "Sailing 1"),
    ("2022-05-23 06:15:00", "2022-05-26 00:00", "East Greenland"),
    ("2022-05-26 00:00", "2022-05-28 12:00", "Sailing 2"),
    ("2022-05-28 12:00", "2022-05-31 08:00", "Nuuk"),
    ("2022-05-31 08:00", "2022-06-01 08:00", "Sailing 3"),
    ("2022-06-01 08:00", "2022-06-03 07:00", "Maniitsoq 1"),
    ("2022-06-03 07:00", "2022-06-03 20:00", "Sailing 4"),
    ("2022-06-03 20:00", "2022-06-04 20:00", "Sisimiut"),
    ("2022-06-04 20:00", "2022-06-05 11:00", "Sailing 5"),
    ("2022-06-05 11:00", "2022-06-06 10:30", "Disko Bay"),
    ("2022-06-06 10:30", "2022-06-06 18:30", "Sailing 6"),
    ("2022-06-06 18:30", "2022-06-12 23:55", "Sea ice"),
    ("2022-06-12 23:55", "2022-06-13 21:00", "Sailing 7"),
    ("2022-06-13 21:00", "2022-06-16 09:00", "Maniitsoq 2"),
    ("2022-06-16 09:00", None, "Sailing home"),
)

# fixed values: zero offsets as (station, channel, column subtracted from, offset)
_OFFSETS = (
    ("Disko Bay", "no", "no", -0.029),
    ("Disko Bay", "no2", "no2", -0.128),
    ("East Greenland", "no", "no", -0.050),
    ("East Greenland", "no2", "no2", -0.121),
    ("Maniitsoq 1", "no", "no", -0.028),
    ("Maniitsoq 1", "no2", "no2", -0.129),
    ("Maniitsoq 2", "no", "no", -0.021),
    ("Maniitsoq 2", "no2", "no2", -0.141),
    ("Nuuk", "no", "no", -0.044),
    ("Nuuk", "no2", "no2", -0.144),
    ("Reykjavik", "no", "no", -0.50),
    ("Sailing 1", "no", "no", -0.050),
    ("Sailing 1", "no2", "no2", -0.121),
    ("Sailing 2", "no", "no", -0.066),
    ("Sailing 2", "no2", "no2", -0.130),
    ("Sailing 3", "no", "no", -0.044),
    ("Sailing 3", "no2", "no", -0.144),
    ("Sailing 4", "no", "no", -0.028),
    ("Sailing 4", "no2", "no", -0.129),
    ("Sailing 5", "no", "no", -0.049),
    ("Sailing 5", "no2", "no2", -0.139),
    ("Sailing 6", "no", "no", -0.029),
    ("Sailing 6", "no2", "no", -0.128),
    ("Sailing 7", "no", "no", 0.033),
    ("Sailing 7", "no2", "no", 0.139),
    ("Sailing home", "no", "no", -0.021),
    ("Sailing home", "no2", "no", -0.141),
    ("Sea ice", "no", "no", -0.033),
    ("Sea ice", "no2", "no2", -0.139),
    ("Sisimiut", "no", "no", -0.027),
    ("Sisimiut", "no2", "no2", -0.119),
)

# fixed values: instrument flags as open windows; None is unbounded. Two windows of
# noy_cal end before they start and match nothing.
_FLAG_WINDOWS = {
    "flag_all": (
        (None, "2022-05-18 20:21"),
        ("2022-05-20 16:15", "2022-05-20 18:15"),
        ("2022-05-21 00:00", "2022-05-22 06:00"),
        ("2022-06-11 13:33", "2022-06-11 13:37"),
    ),
    "o3_flag": (
        ("2022-05-19 15:51:30", "2022-05-19 17:51:30"),
        ("2022-06-11 12:56", "2022-06-11 15:03"),
        ("2022-06-20 09:58", "2022-06-20 10:17"),
    ),
    "co_flag": (
        (None, "2022-05-22 19:30"),
        ("2022-06-11 10:30", "2022-06-11 13:32"),
        ("2022-06-22 10:13", None),
    ),
    "so2_flag": (
        ("2022-06-11 12:49", "2022-06-11 14:56"),
    ),
    "nox_flag": (
        ("2022-06-11 12:40", "2022-06-11 13:08"),
        ("2022-06-20 09:58", "2022-06-20 10:17"),
    ),
    "nox_cal": (
        ("2022-05-23 08:30", "2022-05-23 09:44"),
        ("2022-06-03 09:02", "2022-06-03 09:18"),
        ("2022-06-15 10:00", "2022-06-15 11:40"),
        ("2022-06-19 14:08", "2022-06-19 14:42"),
        ("2022-06-22 09:33", "2022-06-22 09:44"),
    ),
    "noy_flag": (
        ("2022-06-16 17:00", "2022-06-19 14:50"),
    ),
    "noy_cal": (
        ("2022-05-23 09:39", "2022-05-23 10:25"),
        ("2022-06-03 09:18", "2022-06-03 10:48"),
        ("2022-06-05 09:27", "2022-06-05 09:57"),
        ("2022-06-05 13:16", "2022-06-05 14:15"),
        ("2022-06-15 10:44", "2022-06-15 11:05"),
        ("2022-06-19 14:19", "2022-06-17 14:30"),
        ("2022-06-19 14:30", "2022-06-17 14:41"),
        ("2022-06-22 09:42", "2022-06-22 09:54"),
    ),
    "noy_zero": (
        ("2022-06-05 13:51", "2022-06-05 14:03"),
        ("2022-06-22 10:00", None),
    ),
}
CO_CAP = 250

# fixed values: what earlier versions of the flag windows have instead, as
# (start, end) or (start, end, code)
_OLDER_WINDOWS = {
    "o3_flag": (
        ("2022-05-19 15:51:30", "2022-05-19 17:51:30"),
        ("2022-06-11 12:56", "2022-06-11 15:03"),
        ("2022-06-20 09:58", "2022-06-20 10:17", 2),
    ),
    "co_flag": (
        (None, "2022-05-22 19:30"),
        ("2022-06-11 13:18", "2022-06-11 13:32"),
        ("2022-06-22 10:13", None),
    ),
    "nox_flag": (
        ("2022-06-11 12:40", "2022-06-11 12:50"),
        ("2022-06-20 09:58", "2022-06-20 10:17", 2),
    ),
    "nox_cal": (
        ("2022-05-23 09:22", "2022-05-23 09:44"),
        ("2022-06-03 09:02", "2022-06-03 09:18"),
        ("2022-06-15 10:12", "2022-06-15 11:00"),
        ("2022-06-19 14:08", "2022-06-19 14:42"),
        ("2022-06-22 09:33", "2022-06-22 09:44"),
    ),
}
_V1_CO_WINDOWS = (
    (None, "2022-05-22 18:30"),
    ("2022-06-11 13:18", "2022-06-11 13:32"),
)

# fixed values: calibration windows the zero and detection-limit jobs leave out
_ZERO_JOB_CAL = (
    ("2022-05-23 09:22", "2022-05-23 09:44"),
    ("2022-06-03 09:02", "2022-06-03 09:18"),
    ("2022-06-15 10:00", "2022-06-15 11:40"),
    ("2022-06-19 14:08", "2022-06-19 14:42"),
    ("2022-06-22 09:33", "2022-06-22 09:44"),
)

# fixed values: everything that spoils a zero, as one flag
_ZEROING = (
    (None, "2022-05-18 20:21"),
    ("2022-05-20 16:15", "2022-05-20 18:15"),
    ("2022-05-21 00:00", "2022-05-22 06:00"),
    ("2022-06-11 13:33", "2022-06-11 13:37"),
    ("2022-06-11 12:40", "2022-06-11 12:50"),
    ("2022-06-20 09:58", "2022-06-20 10:17"),
    ("2022-05-23 09:22", "2022-05-23 09:44"),
    ("2022-06-03 09:02", "2022-06-03 09:18"),
    ("2022-06-15 10:12", "2022-06-15 11:00"),
    ("2022-06-19 14:08", "2022-06-19 14:42"),
    ("2022-06-22 09:33", "2022-06-22 09:44"),
    ("2022-06-12 23:55", "2022-06-13 21:00"),
)

# fixed values: the polluted leg
_POLLUTION = (("2022-06-12 23:55", "2022-06-13 21:00"),)

# fixed values: windows whose NO2 zeroes are not used
_NO2_ZERO_DROP = (
    ("2022-06-19", None),
    (None, "2022-05-23"),
    ("2022-06-13", "2022-06-14"),
    ("2022-05-31", "2022-06-01"),
    ("2022-06-03", "2022-06-04"),
)

# fixed values: instants at which the NO calibration status is not believed
NO_CAL_OVERRIDES = (
    ("2022-06-15 10:00", "2022-06-15 10:31"),
    ("2022-05-23 09:37", "2022-05-23 09:44"),
    ("2022-06-15 10:44", "2022-06-15 11:40"),
)

# fixed values: plume windows, closed at both ends, in order
_PLUMES = (
    ("2022-05-20 19:30", "2022-05-20 20:35", "ws"),
    ("2022-05-22 19:50", "2022-05-22 23:45", "other_ship"),
    ("2022-05-23 00:55", "2022-05-23 01:37", "nox_spike"),
    ("2022-05-25 15:15", "2022-05-25 17:17", "nox_spike"),
    ("2022-05-28 07:45", "2022-05-28 12:00", "nox_spike"),
    ("2022-05-29 01:09", "2022-05-29 01:42", "nox_spike"),
    ("2022-05-29 03:32", "2022-05-29 03:46", "nox_spike"),
    ("2022-05-29 04:00", "2022-05-29 04:25", "nox_spike"),
    ("2022-05-29 14:41", "2022-05-29 15:00", "nox_spike"),
    ("2022-05-29 15:30", "2022-05-29 16:45", "nox_spike"),
    ("2022-05-29 20:05", "2022-05-29 20:45", "nox_spike"),
    ("2022-05-29 23:20", "2022-05-29 23:40", "nox_spike"),
    ("2022-05-30 06:25", "2022-05-30 08:05", "other_ship"),
    ("2022-05-30 10:45", "2022-05-30 11:45", "wd"),
    ("2022-05-30 13:30", "2022-05-30 19:30", "nox_spike"),
    ("2022-05-31 07:57", "2022-05-31 09:35", "ws"),
    ("2022-06-01 00:57", "2022-06-01 01:22", "nox_spike"),
    ("2022-06-01 06:00", "2022-06-01 18:00", "ws"),
    ("2022-06-02 07:15", "2022-06-03 04:00", "ws"),
    ("2022-06-03 06:00", "2022-06-03 09:00", "ws"),
    ("2022-06-03 19:00", "2022-06-03 21:00", "wd"),
    ("2022-06-03 15:55", "2022-06-03 16:20", "nox_spike"),
    ("2022-06-03 17:00", "2022-06-03 17:26", "nox_spike"),
    ("2022-06-03 23:15", "2022-06-04 02:00", "ws"),
    ("2022-06-04 07:30", "2022-06-04 08:00", "nox_spike"),
    ("2022-06-04 11:45", "2022-06-04 11:53", "ws"),
    ("2022-06-04 13:15", "2022-06-04 14:00", "ws"),
    ("2022-06-04 13:00", "2022-06-04 22:23", "ws"),
    ("2022-06-05 03:10", "2022-06-05 03:23", "nox_spike"),
    ("2022-06-05 08:00", "2022-06-05 10:31", "nox_spike"),
    ("2022-06-06 03:15", "2022-06-06 03:35", "nox_spike"),
    ("2022-06-06 11:24", "2022-06-06 11:34", "nox_spike"),
    ("2022-06-06 16:29", "2022-06-06 16:39", "nox_spike"),
    ("2022-06-06 17:05", "2022-06-06 17:28", "nox_spike"),
    ("2022-06-06 23:30", "2022-06-07 02:30", "other_ship"),
    ("2022-06-07 04:02", "2022-06-07 04:25", "other_ship"),
    ("2022-06-07 10:30", "2022-06-07 10:58", "nox_spike"),
    ("2022-06-07 11:11", "2022-06-07 11:30", "nox_spike"),
    ("2022-06-07 11:40", "2022-06-07 11:50", "nox_spike"),
    ("2022-06-07 21:05", "2022-06-07 23:00", "other_ship"),
    ("2022-06-08 01:07", "2022-06-08 01:27", "other_ship"),
    ("2022-06-08 02:23", "2022-06-08 02:45", "other_ship"),
    ("2022-06-08 10:30", "2022-06-08 17:15", "nox_spike"),
    ("2022-06-09 07:40", "2022-06-09 08:40", "nox_spike"),
    ("2022-06-09 13:35", "2022-06-09 14:35", "other_ship"),
    ("2022-06-09 15:22", "2022-06-09 15:40", "nox_spike"),
    ("2022-06-10 19:10", "2022-06-10 20:15", "nox_spike"),
    ("2022-06-10 20:35", "2022-06-10 20:41", "other_ship"),
    ("2022-06-10 21:10", "2022-06-10 23:05", "other_ship"),
    ("2022-06-12 23:55", "2022-06-13 21:00", "wd"),
    ("2022-06-14 18:40", "2022-06-14 21:00", "nox_spike"),
    ("2022-06-15 05:10", "2022-06-15 05:48", "nox_spike"),
    ("2022-06-15 13:05", "2022-06-15 14:35", "other_ship"),
)

# fixed values: calm or following relative wind samples the ship's own stack
CALM_BELOW = 2.5
ASTERN = (157.5, 202.5)
STACK_CODES = {"no": 0, "ws": 1, "wd": 2, "other_ship": 3, "nox_spike": 4}

# fixed values: the anemometer was unreliable here
WS_MASK = ("2022-06-10 06:00", "2022-06-10 12:30")

# fixed value: CO calibration flags before this instant are not believed
CO_CAL_START = "2022-05-19"

# fixed value: no calibrated CO from here on
CO_END = "2022-06-22 10:13"

# fixed values: limits of detection (ppb, one minute)
LODS = {"no": 0.00687, "noy": 0.00687, "no2": 0.00988, "nox": 0.012}

# fixed values: long zero cycles used for the limits of detection
LOD_CYCLES = (4, 16, 28, 37)

# fixed values: stations and odd cycles left out of the station zeroes
ZERO_EXCLUDED_STATIONS = ("Sailing home", "Reykjavik")
ZERO_EXCLUDED_CYCLES = (12, 2, 25, 15, 3, 16, 7)

# fixed values: one zero for the whole campaign, from an earlier version
CONSTANT_ZEROES = {"no": -0.0363139655120056, "no2": -0.134759009068831}

# fixed values: label bands of the display table
_BANDS = (
    ("2022-05-20 20:15:00", "2022-05-23 06:15:00", "Sailing"),
    ("2022-05-23 06:15:00", "2022-05-26 00:00", "Eastern coast of Greenland"),
    ("2022-05-26 00:00", "2022-05-29 00:00", "Sailing"),
    ("2022-05-29 00:00", "2022-05-31 08:00", "Nuuk"),
    ("2022-05-31 08:00", "2022-06-01 08:00", "Sailing"),
    ("2022-06-01 08:00", "2022-06-03 07:00", "Maniitsoq"),
    ("2022-06-03 07:00", "2022-06-03 20:00", "Sailing"),
    ("2022-06-03 20:00", "2022-06-04 20:00", "Sisimut"),
    ("2022-06-04 20:00", "2022-06-05 11:00", "Sailing"),
    ("2022-06-05 11:00", "2022-06-06 10:30", "Disko Bay"),
    ("2022-06-06 10:30", "2022-06-06 18:30", "Sailing"),
    ("2022-06-06 18:30", "2022-06-12 23:55", "Sea ice"),
    ("2022-06-12 23:55", "2022-06-13 20:40", "Sailing"),
    ("2022-06-13 20:40", "2022-06-16 09:00", "Maniitsoq"),
    ("2022-06-16 09:00", "2022-06-23 12:00", "Sailing"),
)

# fixed values: raw logger columns and the channels they hold
LOGGER_CHANNELS = {
    "t101_022639_so2": "so2",
    "al5002_inst_co_conc": "co",
    "t200up_021842_no": "noy",
    "t200up_023828_no": "no",
    "t200up_023828_no2": "no2",
}


def _windows(rows) -> list[Interval]:
    return [Interval(lo, hi, code[0] if code else 1) for lo, hi, *code in rows]


def stations(coarse: bool = False) -> list[Interval]:
    """Station rules; ``coarse`` gives every sailing leg but the last one label."""
    return [
        Interval(lo, hi, "Sailing" if coarse and label.startswith("Sailing ")
                 and label != "Sailing home" else label,
                 closed=lo is not None and hi is not None)
        for lo, hi, label in _STATIONS]


def bands() -> list[Interval]:
    return [Interval(lo, hi, label, closed=True) for lo, hi, label in _BANDS]


def offsets() -> list[Offset]:
    return [Offset(*row) for row in _OFFSETS]


def flag_rules(version: str = "current") -> dict[str, list]:
    """Rules of each instrument flag: ``current``, ``v2`` or ``v1``."""
    if version not in ("current", "v2", "v1"):
        raise ValueError(f"unknown version {version!r}")
    windows = dict(_FLAG_WINDOWS)
    if version != "current":
        windows |= _OLDER_WINDOWS
    if version == "v1":
        windows["co_flag"] = _V1_CO_WINDOWS
    rules: dict[str, list] = {flag: _windows(rows) for flag, rows in windows.items()}
    if version == "current":
        rules["co_flag"].append(Value(f"co > {CO_CAP}"))
        rules["noy_flag"].append(Value("noy < nox"))
    return rules


def plume_rules(coded: bool = False) -> list:
    """Labels (or codes) of ``stack_flag``: relative wind first, then the listed plumes."""
    def name(label):
        return STACK_CODES[label] if coded else label

    return [
        Value(f"rel_ws < {CALM_BELOW}D", name("ws")),
        Value(f"rel_wd > {ASTERN[0]}D AND rel_wd < {ASTERN[1]}D", name("wd")),
        *[Interval(lo, hi, name(label), closed=True) for lo, hi, label in _PLUMES]]


def zero_job_calibration() -> list[Interval]:
    return _windows(_ZERO_JOB_CAL)


def zeroing_flag() -> list[Interval]:
    return _windows(_ZEROING)


def pollution() -> list[Interval]:
    return _windows(_POLLUTION)


def no2_zero_drop() -> list[Interval]:
    return _windows(_NO2_ZERO_DROP)


# what nulls which species; SO2 is flagged but never masked in the current version
QC_MASK = {
    "co": ("co_flag",),
    "no": ("nox_flag", "nox_cal", "zero_box"),
    "no2": ("nox_flag", "nox_cal", "zero_box"),
    "nox": ("nox_flag", "nox_cal", "zero_box"),
    "noy": ("noy_flag", "noy_cal", "noy_zero"),
    "o3": ("o3_flag",),
}
# the earlier version masks in place of dropping rows, and masks SO2 as well
OLDER_QC_MASK = {
    "o3": ("o3_flag", "flag_all"),
    "co": ("co_flag", "flag_all", "co_cal"),
    "no_corr": ("nox_flag", "zero_box", "nox_cal", "flag_all"),
    "no2_corr": ("nox_flag", "zero_box", "nox_cal", "flag_all"),
    "so2_corr": ("so2_flag", "so2_zero_channel", "flag_all"),
    "noy": ("noy_cal", "noy_flag", "noy_zero", "flag_all"),
}
