"""Labels and flags from time intervals and value rules.

A rule set is short, written by people, and versioned (driftline.plans.rules).
Intervals are first resolved into segments that do not overlap, each with its
winning label. Up to ``CHAIN_LIMIT`` rules become one conditional expression that
halves the segments: no join, no shuffle. With a longer list, a row is joined to
the one segment of its day that holds it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from heapq import heappop, heappush
from itertools import groupby

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (DateType, IntegerType, StringType, StructField, StructType,
                               TimestampNTZType)

CHAIN_LIMIT = 200
#: Day rows of a rule table that may be broadcast, well below 10 MB; a larger one is joined.
BROADCAST_ROWS = 50_000
_TICK = timedelta(microseconds=1)


@dataclass(frozen=True)
class Interval:
    """``label`` between two instants; None is unbounded, bounds open or closed."""

    start: str | None
    end: str | None
    label: str | int = 1
    closed: bool = False

    def half_open(self) -> tuple[datetime | None, datetime | None]:
        """The same instants as [start, end) at microsecond resolution."""
        lo = None if self.start is None else datetime.fromisoformat(self.start)
        hi = None if self.end is None else datetime.fromisoformat(self.end)
        if lo is not None and not self.closed:
            lo += _TICK
        if hi is not None and self.closed:
            hi += _TICK
        return lo, hi


@dataclass(frozen=True)
class Value:
    """``label`` where a condition on the row's values, given as SQL, is true."""

    condition: str
    label: str | int = 1


Rule = Interval | Value


def check_rules(rules: Iterable[Rule]) -> list[str]:
    """Warnings: intervals that can never match."""
    found = []
    for number, rule in enumerate(rules, 1):
        if isinstance(rule, Interval):
            lo, hi = rule.half_open()
            if lo is not None and hi is not None and lo >= hi:
                found.append(f"rule {number} ({rule.label}) ends before it starts")
    return found


def _literal(value, text: bool = False) -> str:
    if value is None:
        return "NULL"
    value = str(value) if text else value
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "\\'") + "'"


def _bisect(parts: Sequence[tuple], time: str, text: bool) -> str:
    """SQL finding the stretch an instant lies in by halving the list of stretches."""
    if len(parts) == 1:
        return _literal(parts[0][1], text)
    middle = len(parts) // 2
    return (f"CASE WHEN `{time}` < TIMESTAMP_NTZ '{parts[middle][0]}' "
            f"THEN {_bisect(parts[:middle], time, text)} "
            f"ELSE {_bisect(parts[middle:], time, text)} END")


def _interval_sql(rules: Sequence[Interval], time: str, text: bool) -> str:
    """Label of the first matching interval, or NULL.

    The intervals are resolved to stretches that follow each other without gaps, so
    a row is placed with a handful of comparisons, however many rules there are.
    """
    stretches: list[tuple] = []
    reached = None
    for lo, hi, label in segments(rules):
        if lo is not None and lo != reached:
            stretches.append((reached, None))
        stretches.append((lo, label))
        reached = hi
    if reached is not None:
        stretches.append((reached, None))
    if not stretches:
        return "NULL"
    return f"CASE WHEN `{time}` IS NOT NULL THEN {_bisect(stretches, time, text)} END"


def _as_text(rules: Sequence[Rule], default) -> bool:
    """Labels are text if one of them is, whatever the form and the length of the list."""
    return any(isinstance(x, str) for x in [default, *(r.label for r in rules)])


def _value_sql(rules: Sequence[Value], text: bool) -> str:
    branches = " ".join(f"WHEN {r.condition} THEN {_literal(r.label, text)}" for r in rules)
    return f"CASE {branches} END"


def rule_column(rules: Sequence[Rule], default=None, time: str = "date") -> Column:
    """First matching rule wins; unknown conditions do not match."""
    text = _as_text(rules, default)
    choices = [_interval_sql(list(group), time, text) if is_interval
               else _value_sql(list(group), text)
               for is_interval, group in groupby(rules, lambda r: isinstance(r, Interval))]
    return F.expr(f"coalesce({', '.join([*choices, _literal(default, text)])})")


def tag_intervals(df: DataFrame, rules: Sequence[Rule], out: str, default=None,
                  time: str = "date", limit: int = CHAIN_LIMIT) -> DataFrame:
    """Add the label of the first rule that matches each row.

    A list means the same at every length: stretches of more than ``limit`` intervals
    are looked up in a table, the rest are conditions, and the first match wins.
    """
    if len(rules) <= limit:
        return df.withColumn(out, rule_column(rules, default, time))
    text, choices, scratch = _as_text(rules, default), [], []
    for number, (is_interval, group) in enumerate(
            groupby(rules, lambda r: isinstance(r, Interval))):
        group = list(group)
        if not is_interval:
            choices.append(_value_sql(group, text))
        elif len(group) <= limit:
            choices.append(_interval_sql(group, time, text))
        else:
            scratch.append(f"__rules_{number}")
            df = _tag_by_segments(df, group, scratch[-1], None, time, text)
            choices.append(f"`{scratch[-1]}`")
    label = F.expr(f"coalesce({', '.join([*choices, _literal(default, text)])})")
    return df.withColumn(out, label).drop(*scratch)


def flag_intervals(df: DataFrame, rules: Sequence[Rule], out: str, time: str = "date",
                   limit: int = CHAIN_LIMIT) -> DataFrame:
    """0/1 (or the rule's own code) by interval membership."""
    return tag_intervals(df, rules, out, default=0, time=time, limit=limit)


def segments(rules: Sequence[Interval]) -> list[tuple[datetime | None, datetime | None, object]]:
    """Disjoint half-open stretches of time with the label of the first rule there."""
    spans = [(*r.half_open(), r.label) for r in rules]
    spans = [(lo, hi, label) for lo, hi, label in spans if lo is None or hi is None or lo < hi]
    low, high = datetime.min, datetime.max
    starts, ends = {}, {}
    for rank, (lo, hi, _) in enumerate(spans):
        starts.setdefault(lo or low, []).append(rank)
        ends.setdefault(hi or high, []).append(rank)
    cuts = sorted({*starts, *ends})
    active: list[int] = []  # a heap; rules that have ended leave it when they come up
    ended: set[int] = set()
    out: list[tuple] = []
    for lo, hi in zip(cuts, cuts[1:]):
        for rank in starts.get(lo, ()):
            heappush(active, rank)
        ended.update(ends.get(lo, ()))
        while active and active[0] in ended:
            heappop(active)
        if not active:
            continue
        label = spans[active[0]][2]
        if out and out[-1][1] == lo and out[-1][2] == label:
            out[-1] = (out[-1][0], hi, label)
        else:
            out.append((lo, hi, label))
    return [(None if lo == low else lo, None if hi == high else hi, label)
            for lo, hi, label in out]


def _tag_by_segments(df: DataFrame, rules: Sequence[Interval], out: str, default,
                     time: str, text: bool) -> DataFrame:
    parts = segments(rules)
    if text:
        parts = [(lo, hi, str(label)) for lo, hi, label in parts]
    instant = F.col(time)
    # the two unbounded segments are plain conditions, the others are looked up by day
    open_ended = [Interval(None if lo is None else str(lo - _TICK),
                           None if hi is None else str(hi), label)
                  for lo, hi, label in parts if lo is None or hi is None]
    bounded = [(lo.date(), (hi - _TICK).date(), lo, hi, label)
               for lo, hi, label in parts if lo is not None and hi is not None]
    number = all(isinstance(label, int) for *_, label in parts)
    schema = StructType([
        StructField("__first", DateType()), StructField("__last", DateType()),
        StructField("__lo", TimestampNTZType()), StructField("__hi", TimestampNTZType()),
        StructField("__label", IntegerType() if number else StringType())])
    table = df.sparkSession.createDataFrame(bounded, schema).select(
        F.explode(F.sequence("__first", "__last")).alias("__day"), "__lo", "__hi", "__label")
    # the list is on the driver, so the rows it makes are known before it is sent
    if sum((last - first).days + 1 for first, last, *_ in bounded) <= BROADCAST_ROWS:
        table = F.broadcast(table)
    match = (F.to_date(instant) == F.col("__day")) & (instant >= F.col("__lo")) \
        & (instant < F.col("__hi"))
    joined = df.join(table, match, "left")
    label = F.col("__label")
    if open_ended:
        label = F.coalesce(label, rule_column(open_ended, None, time))
    return joined.withColumn(out, F.coalesce(label, F.lit(default)) if default is not None
                             else label).drop("__day", "__lo", "__hi", "__label")


def band_table(df: DataFrame, rules: Sequence[Interval], out: str = "band",
               time: str = "date") -> DataFrame:
    """Rows with the label band they fall in, for display."""
    return tag_intervals(df, rules, out, time=time)
