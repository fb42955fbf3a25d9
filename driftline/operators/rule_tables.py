"""Labels and flags from a table of interval rules.

The rules are a table like any other (start, end, label, priority, closed), as long as it
likes to be. :func:`resolve_intervals` turns overlapping rules into stretches that do not
overlap, by a sweep line over sampled ranges of the instant. :func:`tag_by_table` then
gives each row the label of its stretch: few stretches become the conditions of
:mod:`driftline.operators.intervals`, many are met range by range in the order of the
instant, and a range with many rows is split.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from driftline.functions.times import epoch_micros, from_micros
from driftline.operators.intervals import Interval, tag_intervals
from driftline.operators.rows import column_or_null
from driftline.session import stage

#: Ranges of the instant at most; a range's number is found by halving its bounds.
RANGES = 512
#: Starts and ends that one task sweeps, rows that meet the stretches of their range.
RANGE_CUTS, RANGE_ROWS = 100_000, 2_000_000
#: Stretches that become conditions or a broadcast table.
FEW_STRETCHES = 10_000
_LOW, _HIGH = -(1 << 62), 1 << 62  # no bound
_EPOCH = datetime(1970, 1, 1)


def _bounds_of(cuts: DataFrame, ranges: int) -> list[int]:
    """Instants that part ``cuts`` (column t) into ranges of about equal size."""
    if ranges < 2:
        return []
    found = cuts.agg(F.percentile_approx("t", [i / ranges for i in range(1, ranges)],
                                         20 * ranges)).first()[0]
    return sorted(set(found or []))


def _range_of(t: str, bounds: Sequence[int], first: int = 0) -> str:
    """SQL for the number of bounds at or below ``t``."""
    if not bounds:
        return str(first)
    middle = len(bounds) // 2
    return (f"CASE WHEN {t} < {bounds[middle]}L THEN {_range_of(t, bounds[:middle], first)} "
            f"ELSE {_range_of(t, bounds[middle + 1:], first + middle + 1)} END")


def _at(bounds: Sequence[int], number: Column, before: int) -> Column:
    """The bound with this number, from 0; ``before`` stands for number -1."""
    return F.element_at(F.array(F.lit(before), *[F.lit(b) for b in bounds], F.lit(_HIGH)),
                        (number + 2).cast("int"))


# resolving --------------------------------------------------------------------

def _spans(rules: DataFrame, start: str, end: str, label: str, priority: str,
           closed: str) -> DataFrame:
    """[lo, hi) in microseconds and what wins: the least (priority, label)."""
    shut = F.coalesce(column_or_null(rules, closed, "boolean"), F.lit(False))
    tick = F.when(shut, 0).otherwise(1)
    lo = F.coalesce(epoch_micros(F.col(start)) + tick, F.lit(_LOW))
    hi = F.coalesce(epoch_micros(F.col(end)) + 1 - tick, F.lit(_HIGH))
    # no rule outranks one without a priority, and a rule without a label hides nothing
    rank = column_or_null(rules, priority, "bigint").cast("bigint")
    return rules.where(F.col(label).isNotNull()).select(
        lo.alias("lo"), hi.alias("hi"), F.struct(
            F.coalesce(rank, F.lit(_HIGH)).alias("rank"), F.col(label).alias("label")).alias("best")
    ).where("lo < hi")


def _nodes(first: str, last: str, levels: int) -> Column:
    """The aligned blocks of ranges (level, number) that make up [first, last), few of them."""
    found, a, b = [], F.col(first), F.col(last)
    for level in range(levels):
        odd = lambda c: c.bitwiseAND(1) == 1
        found += [F.when((a < b) & odd(a), F.struct(F.lit(level).alias("level"), a.alias("number"))),
                  F.when((a < b) & odd(b), F.struct(F.lit(level).alias("level"),
                                                    (b - 1).alias("number")))]
        a, b = F.shiftright(a + 1, 1), F.shiftright(b, 1)
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _sweep(key, pieces: pa.Table, base: pa.Table) -> pa.Table:
    """Stretches of one range: a heap of the rules that are active, best first."""
    lo, hi = base["__lo"][0].as_py(), base["__hi"][0].as_py()
    whole = base["best"][0].as_py()
    spans = list(zip(pieces["lo"].to_pylist(), pieces["hi"].to_pylist(), pieces["best"].to_pylist()))
    if whole is not None:
        spans.append((lo, hi, whole))
    spans.sort(key=lambda s: s[0])
    cuts = sorted({x for a, b, _ in spans for x in (a, b)})
    active, out, at = [], [], 0
    for begin, end in zip(cuts, cuts[1:]):
        while at < len(spans) and spans[at][0] <= begin:
            heappush(active, (spans[at][2]["rank"], spans[at][2]["label"], spans[at][1]))
            at += 1
        while active and active[0][2] <= begin:
            heappop(active)
        if not active:
            continue
        label = active[0][1]
        if out and out[-1][1] == begin and out[-1][2] == label:
            out[-1] = (out[-1][0], end, label)
        else:
            out.append((begin, end, label))
    kind = base.schema.field("best").type.field("label").type
    return pa.table({"lo": pa.array([x[0] for x in out], pa.int64()),
                     "hi": pa.array([x[1] for x in out], pa.int64()),
                     "label": pa.array([x[2] for x in out], kind)})


def resolve_intervals(rules: DataFrame, start: str = "start", end: str = "end",
                      label: str = "label", priority: str = "p", closed: str = "closed",
                      cuts: int = RANGE_CUTS) -> DataFrame:
    """Stretches [lo, hi) in microseconds that do not overlap, with the winning label.

    A rule without a start or an end is unbounded; bounds are open, or closed where
    ``closed`` says so; a rule that ends before it starts matches nothing. Where rules
    overlap the least ``priority`` wins, then the least label; a missing priority comes
    last. Columns ``priority`` and ``closed`` may be absent.

    The starts and ends are sampled into ranges. A rule is swept only in the ranges where it
    starts and ends; the ranges it covers whole are marked through a few aligned blocks of
    ranges each, of which only the best rule matters. So no task holds more than the cuts
    of one range, and rules that start together meet as one row for each range.
    """
    spans = stage(_spans(rules, start, end, label, priority, closed))
    points = spans.select(F.explode(F.array("lo", "hi")).alias("t")).where(
        f"t > {_LOW} and t < {_HIGH}")
    bounds = _bounds_of(points, min(RANGES, 1 + points.count() // cuts))
    ranges = len(bounds) + 1
    placed = spans.withColumns({
        "__a": F.expr(f"cast({_range_of('lo', bounds)} as bigint)"),
        "__b": F.expr(f"cast({_range_of('(hi - 1)', bounds)} as bigint)")})
    one = F.col("__a") == F.col("__b")
    parts = placed.select("best", F.explode(F.when(one, F.array(F.struct(
        F.col("__a").alias("range"), "lo", "hi"))).otherwise(F.array(
            F.struct(F.col("__a").alias("range"), "lo", _at(bounds, F.col("__a"), _LOW).alias("hi")),
            F.struct(F.col("__b").alias("range"), _at(bounds, F.col("__b") - 1, _LOW).alias("lo"),
                     "hi")))).alias("__p"))
    pieces = parts.groupBy("__p.range", "__p.lo", "__p.hi").agg(F.min("best").alias("best"))

    levels = max(1, ranges.bit_length())
    blocks = (placed.where(F.col("__b") - F.col("__a") > 1)
              .withColumn("__from", F.col("__a") + 1)
              .select("best", F.explode(_nodes("__from", "__b", levels)).alias("__n"))
              .groupBy("__n.level", "__n.number").agg(F.min("best").alias("best")))
    numbers = spans.sparkSession.range(ranges).withColumnRenamed("id", "nr")
    above = numbers.withColumn("level", F.explode(F.array(*[F.lit(x) for x in range(levels)])))
    above = above.withColumn("number", F.expr("shiftright(nr, level)"))
    base = (above.join(blocks, ["level", "number"], "left").groupBy("nr")
            .agg(F.min("best").alias("best"))
            .withColumns({"__lo": _at(bounds, F.col("nr") - 1, _LOW),
                          "__hi": _at(bounds, F.col("nr"), _LOW)}))
    kind = spans.schema["best"].dataType["label"].dataType.simpleString()
    return pieces.groupBy("range").cogroup(base.groupBy("nr")).applyInArrow(
        _sweep, f"lo long, hi long, label {kind}")


# tagging ----------------------------------------------------------------------

def tag_by_table(df: DataFrame, rules: DataFrame, out: str, default=None, time: str = "date",
                 start: str = "start", end: str = "end", label: str = "label",
                 priority: str = "p", closed: str = "closed", few: int = FEW_STRETCHES,
                 range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add the label of the best rule at each row's instant, else ``default``.

    A row without an instant gets the default. With up to ``few`` stretches (counted)
    no row is moved. Beyond, the instants of ``df`` are sampled into ranges and counted;
    each row meets the stretches of its range behind one exchange, in the order of the
    instant, and a range with more than ``range_rows`` rows is dealt to several tasks that
    each get its stretches.
    """
    stretches = stage(resolve_intervals(rules, start, end, label, priority, closed))
    kind = "string" if isinstance(default, str) else stretches.schema["label"].dataType
    found = stretches.limit(few + 1).collect()
    if len(found) > few:
        tagged = _tag_by_ranges(df, stretches, out, default, time, range_rows)
    elif found:
        listed = [Interval(None if r.lo == _LOW else _text(r.lo - 1),
                           None if r.hi == _HIGH else _text(r.hi), r.label)
                  for r in sorted(found, key=lambda r: r.lo)]
        tagged = tag_intervals(df, listed, out, default, time)
    else:
        tagged = df.withColumn(out, F.lit(default))
    return tagged.withColumn(out, F.col(out).cast(kind))


def _text(micros: int) -> str:
    return str(_EPOCH + timedelta(microseconds=micros))


def flag_by_table(df: DataFrame, rules: DataFrame, out: str, **options) -> DataFrame:
    """0/1 (or the rule's own code) by membership in the rules of a table."""
    return tag_by_table(df, rules, out, default=0, **options)


def _tag_by_ranges(df: DataFrame, stretches: DataFrame, out: str, default, time: str,
                   range_rows: int) -> DataFrame:
    instants = df.select(epoch_micros(F.col(time)).alias("t"))
    total = instants.count()
    bounds = _bounds_of(instants.where("t is not null"), min(RANGES, 1 + total // range_rows))
    number = f"cast({_range_of('__t', bounds)} as int)"
    counted = instants.withColumnRenamed("t", "__t").groupBy(
        F.when(F.col("__t").isNotNull(), F.expr(number)).alias("range")).count().collect()
    # a number for each range, and one for the rows without an instant
    parts = {r["range"]: 1 + r["count"] // range_rows for r in counted}
    places = F.array(*[F.lit(parts.get(i, 1)) for i in [None, *range(len(bounds) + 1)]])

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"),
                     epoch_micros(F.col(time)).alias("__t"))
    rows = rows.withColumn("__range", F.when(F.col("__t").isNotNull(), F.expr(number)).otherwise(-1))
    rows = rows.withColumn("__part", F.pmod(
        F.xxhash64("__t", F.spark_partition_id()), F.element_at(places, F.col("__range") + 2)))
    spread = stretches.withColumn("__range", F.explode(F.expr(
        f"sequence({number.replace('__t', 'lo')}, {number.replace('__t', '(hi - 1)')})")))
    spread = spread.withColumn("__part", F.explode(F.sequence(
        F.lit(0).cast("bigint"), (F.element_at(places, F.col("__range") + 2) - 1).cast("bigint"))))
    both = rows.withColumn("__s", F.lit(None).cast(_stretch_type(stretches))).unionByName(
        spread.select(F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"),
                      F.col("lo").alias("__t"), "__range", "__part",
                      F.struct("hi", "label").alias("__s")))
    # of equal instants the stretch comes first: it holds its start
    upto = Window.partitionBy("__range", "__part").orderBy(
        "__t", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("__s", F.last("__s", ignorenulls=True).over(upto)).where(
        F.col("__row").isNotNull())
    label = F.when(F.col("__t") < F.col("__s.hi"), F.col("__s.label"))
    if default is not None:
        text = "string" if isinstance(default, str) else stretches.schema["label"].dataType
        label = F.coalesce(label.cast(text), F.lit(default))
    return met.select("__row.*", label.alias("__label")).withColumn(out, F.col("__label")).drop("__label")


def _stretch_type(stretches: DataFrame) -> str:
    return f"struct<hi:bigint,label:{stretches.schema['label'].dataType.simpleString()}>"


def stretch_bounds(stretches: DataFrame) -> DataFrame:
    """Stretches with instants: start (with it), end (without it), label; NULL is no bound."""
    return stretches.select(
        F.when(F.col("lo") > _LOW, from_micros(F.col("lo"))).alias("start"),
        F.when(F.col("hi") < _HIGH, from_micros(F.col("hi"))).alias("end"), "label")
