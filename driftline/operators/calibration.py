"""Calibration periods and the response measured in them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from driftline.operators.groups import group_mean
from driftline.operators.rows import override_flag
from driftline.operators.scan import (Order, _diff, _drop_run_columns, _flag_edges, _runs, _trim,
                                      slice_series)


def calibration_from_sensitivity(df: DataFrame, sensitivity: str, order: Order,
                                 value: str | None = "co", edge: int = 49,
                                 carry: bool = True, out: str = "co_cal",
                                 scan: str = "auto") -> DataFrame:
    """Flag calibration from changes of the instrument's sensitivity setting.

    While the sensitivity does not change the instrument is measuring. The first
    and last ``edge`` samples of each group are flagged. ``carry``: a group is a
    measuring stretch and the changing rows after it, and rows without a value
    are not flagged; otherwise the changing rows together are one group.
    """
    changes = _diff(slice_series(df, order, scan), sensitivity, "__change").staged()
    groups = _runs(changes, "__change", 0)
    flagged = _flag_edges(groups, edge, edge, "carry" if carry else "run", out).df
    if carry and value is not None:
        flagged = flagged.withColumn(
            out, F.when(F.col(value).isNull(), 0).otherwise(F.col(out)))
    return _drop_run_columns(flagged).drop("__change", "__slice")


def calibration_response(df: DataFrame, channel: str, status: str, order: Order,
                         windows: Sequence[tuple[str, str]] = (),
                         when_set: str | None = "zero_box", head: int = 6, tail: int = 2,
                         scan: str = "auto") -> DataFrame:
    """Mean response of each calibration run, its ends trimmed.

    ``windows`` and ``when_set`` name instants at which the status is not believed.
    """
    believed = override_flag(df, status, windows, when_set, time=order.time)
    numbered = _runs(slice_series(believed, order, scan), status, 1)
    trimmed = _trim(numbered, [channel], head, tail, background=True).df.filter("run_id > 0")
    return group_mean(trimmed.withColumnRenamed("run_id", "id"),
                      [*order.series, "id"], [channel])

