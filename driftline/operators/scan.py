"""Order-dependent operators over long series, without one global sort.

Runs, positions, differences, carrying values forward and interpolation all need
the rows of a series in order. A series may be far too long for one task, so it
is cut into slices: every slice is scanned by its own window, one summary row
per slice is scanned in series order, and the carried state is joined back.

How a frame is cut is decided by :func:`slice_series` from measured row counts:

``series``  a whole series per window group (one shuffle, no summary join)
``day``     one slice per series and day
``hour``    one slice per series and hour
``range``   the same, with every crowded hour split at values of the total order
            until no slice is above the bound, even when most rows share one instant

No frame runs to "unbounded following", which is quadratic in Spark: looking ahead
is a descending window looking back.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftline.functions.times import day_number, epoch_seconds, hour_number
from driftline.operators.groups import join_on
from driftline.session import stage

MAX_SLICE_ROWS = 2_000_000
SMALL_SERIES_ROWS = 250_000
#: Parts a crowded slice is split into at a time, and sampled rows for each part.
PARTS, SAMPLED = 64, 100
#: Crowded slices whose boundaries may be broadcast: PARTS keys each.
BROADCAST_SLICES = 1_000
SLICE = "__slice"
_BEFORE_TIME = -2_147_483_648  # slice of rows without an instant: they sort first


@dataclass(frozen=True)
class Order:
    """What makes a frame a series: its keys, its instant and the tie-breakers.

    A NULL in a ``series`` column is a key like any other; ``(series, time, ties)`` is unique.
    """

    time: str = "date"
    ties: tuple[str, ...] = ()
    series: tuple[str, ...] = ()

    @property
    def by(self) -> list[str]:
        return [self.time, *self.ties]


@dataclass(frozen=True)
class Sliced:
    """A frame with its order; ``__slice`` is present when ``cut`` is true.

    ``numbered`` slices have a number that no slice of another series has.
    """

    df: DataFrame
    order: Order
    cut: bool
    numbered: bool = False

    @property
    def keys(self) -> list[str]:
        return [*self.order.series, *([SLICE] if self.cut else [])]

    def window(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order.by)

    def reverse(self):
        return Window.partitionBy(*self.keys).orderBy(
            *[F.col(c).desc() for c in self.order.by])

    def meet(self, rows: DataFrame, summary: DataFrame) -> DataFrame:
        """``rows`` with the columns of their slice's summary row."""
        if not self.numbered:
            return join_on(rows, summary, self.keys, "left")
        # one known key: rows that lie by slice number stay where they are
        named = summary.drop(*self.order.series).withColumnRenamed(SLICE, "__of")
        return rows.join(named, F.col(SLICE) == F.col("__of"), "left").drop("__of")

    def with_df(self, df: DataFrame) -> "Sliced":
        return replace(self, df=df)

    def staged(self, drop: Iterable[str] = ()) -> "Sliced":
        """Cut the lineage before the next pass; a whole-series scan needs none.

        ``drop`` names columns that no later pass reads.
        """
        lean = self.df.drop(*drop)
        return self.with_df(stage(lean) if self.cut else lean)

    def in_order(self, order: Order) -> "Sliced":
        if order != self.order:
            raise ValueError(f"the slices are stored for {self.order}, not {order}")
        return self

    def plain(self) -> DataFrame:
        return self.df.drop(SLICE)


def _slice_column(order: Order, grain: str) -> Column:
    number = {"day": day_number, "hour": hour_number}[grain](F.col(order.time))
    return F.coalesce(number, F.lit(_BEFORE_TIME))


def measure(df: DataFrame, order: Order) -> dict[str, int]:
    """Rows in total and in the largest series, series-day and series-hour.

    Reads only the key columns and combines counts before each shuffle.
    """
    series = list(order.series)
    hours = (df.groupBy(*series, _slice_column(order, "day").alias("__d"),
                        _slice_column(order, "hour").alias("__h"))
             .agg(F.count(F.lit(1)).alias("n")))
    days = hours.groupBy(*series, "__d").agg(F.sum("n").alias("n"), F.max("n").alias("hour"))
    whole = days.groupBy(*series).agg(
        F.sum("n").alias("n"), F.max("n").alias("day"), F.max("hour").alias("hour"))
    row = whole.agg(F.sum("n").alias("total"), F.max("n").alias("series"),
                    F.max("day").alias("day"), F.max("hour").alias("hour")).first()
    return {k: v or 0 for k, v in row.asDict().items()}


def slice_series(df: DataFrame, order: Order, scan: str = "auto",
                 max_rows: int = MAX_SLICE_ROWS) -> Sliced:
    """Cut ``df`` so that no window group exceeds ``max_rows`` rows.

    ``scan='auto'`` measures the frame and takes the coarsest cut that fits. Whole
    series are taken when they are small or spread evenly enough to keep all cores
    busy. The bound is held by ``auto`` and ``range``; the other cuts are the caller's.
    Slices that are stored (:mod:`driftline.operators.stored`) are taken as they are:
    every scan accepts them in place of a frame.
    """
    if isinstance(df, Sliced):
        return df.in_order(order)
    if scan == "auto":
        sizes = measure(df, order)
        total, largest = sizes["total"], sizes["series"]
        cores = df.sparkSession.sparkContext.defaultParallelism
        spread = largest <= SMALL_SERIES_ROWS or largest * cores <= total
        cuts = ("series", "day", "hour") if spread else ("day", "hour")
        scan = next((s for s in cuts if sizes[s] <= max_rows), "range")
    if scan == "series":
        return Sliced(df, order, cut=False)
    if scan == "range":
        hours = df.withColumn(SLICE, F.array(_slice_column(order, "hour")))
        return Sliced(_split_crowded(hours, order, max_rows), order, cut=True)
    return Sliced(df.withColumn(SLICE, _slice_column(order, scan)), order, cut=True)


def _split_crowded(df: DataFrame, order: Order, max_rows: int) -> DataFrame:
    """Append part numbers to the slice (an array) of crowded slices until none is left.

    The boundaries of the parts are keys of rows, sampled by a hash, so the slice of a row
    depends on its values alone and a retried task finds the same one.
    """
    keys = [*order.series, SLICE]
    place = F.struct(*order.by)
    before = None
    while True:
        crowded = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(
            F.col("__n") > max_rows)
        found = crowded.agg(F.count(F.lit(1)).alias("slices"), F.max("__n").alias("n")).first()
        if not found["slices"]:
            return df
        if before is not None and found["n"] >= before:
            raise ValueError(f"more than {max_rows} rows share one place in the order "
                             f"{[*order.series, *order.by]}; name ties that tell them apart")
        before = found["n"]
        small = found["slices"] <= BROADCAST_SLICES
        crowded = F.broadcast(crowded) if small else crowded
        # about PARTS * SAMPLED rows of each crowded slice
        drawn = join_on(df.select(*dict.fromkeys([*keys, *order.by])), crowded, keys, "inner").where(
            F.pmod(F.xxhash64(*order.series, *order.by),
                   F.floor(F.col("__n") / (PARTS * SAMPLED)) + 1) == 0)
        ranked = Window.partitionBy(*keys).orderBy(*order.by)
        part = F.floor((F.row_number().over(ranked) - 1) * PARTS
                       / F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        starts = (drawn.select(*keys, place.alias("__at"), part.alias("__part"))
                  .groupBy(*keys, "__part").agg(F.min("__at").alias("__at"))
                  .groupBy(*keys).agg(F.array_sort(F.collect_list("__at")).alias("__starts")))
        placed = join_on(df, F.broadcast(starts) if small else starts, keys, "left")
        number = F.size(F.filter("__starts", lambda at: at <= place))
        df = placed.withColumn(SLICE, F.when(F.col("__starts").isNull(), F.col(SLICE)).otherwise(
            F.concat(F.col(SLICE), F.array(number)))).drop("__starts")


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _upto(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


class _Carry:
    """Windows over the per-slice summary: one row per series and slice."""

    def __init__(self, sliced: Sliced):
        self.all = Window.partitionBy(*sliced.order.series)
        self.forward = self.all.orderBy(SLICE)
        self.backward = self.all.orderBy(F.col(SLICE).desc())

    def total_before(self, c) -> Column:
        return F.coalesce(F.sum(c).over(_before(self.forward)), F.lit(0))

    def last_before(self, c) -> Column:
        return F.last(c, ignorenulls=True).over(_before(self.forward))

    def first_after(self, c) -> Column:
        return F.last(c, ignorenulls=True).over(_before(self.backward))


def _same(a: Column, b: Column) -> Column:
    """Equal and both known: an unknown value never continues a run."""
    return F.coalesce(a == b, F.lit(False))


# positions and sums ---------------------------------------------------------

def _running_sum(sliced: Sliced, amount: Column, out: str) -> Sliced:
    df = sliced.df.withColumn("__a", amount)
    local = df.withColumn("__s", F.sum("__a").over(_upto(sliced.window())))
    if not sliced.cut:
        return sliced.with_df(local.withColumn(out, F.col("__s")).drop("__a", "__s"))
    sums = df.groupBy(*sliced.keys).agg(F.sum("__a").alias("__a"))
    carry = _Carry(sliced)
    prior = sums.select(*sliced.keys, F.sum("__a").over(_before(carry.forward)).alias("__p"))
    joined = sliced.meet(local, prior)
    total = F.when(F.col("__s").isNotNull() | F.col("__p").isNotNull(),
                   F.coalesce("__s", F.lit(0)) + F.coalesce("__p", F.lit(0)))
    return sliced.with_df(joined.withColumn(out, total).drop("__a", "__s", "__p"))


def running_sum(df: DataFrame, amount: Column, out: str, order: Order,
                scan: str = "auto") -> DataFrame:
    """Cumulative sum in series order; NULL amounts are passed over."""
    return _running_sum(slice_series(df, order, scan), amount, out).plain()


def with_position(df: DataFrame, order: Order, out: str = "idx",
                  scan: str = "auto") -> DataFrame:
    """Row number from 1 in each series."""
    sliced = slice_series(df, order, scan)
    if not sliced.cut:
        return sliced.df.withColumn(out, F.row_number().over(sliced.window()).cast("bigint"))
    return _running_sum(sliced, F.lit(1).cast("bigint"), out).plain()


# neighbours -----------------------------------------------------------------

def _previous(sliced: Sliced, cols: Sequence[str], prefix: str = "__prev_") -> Sliced:
    """The previous row's values; NULL on the first row of a series."""
    row = F.struct(*[F.col(c) for c in cols])
    local = sliced.df.withColumn("__l", F.lag(row).over(sliced.window()))
    if sliced.cut:
        last = sliced.df.groupBy(*sliced.keys).agg(
            F.max_by(row, F.struct(*sliced.order.by)).alias("__t"))
        carried = last.select(
            *sliced.keys, F.lag("__t").over(_Carry(sliced).forward).alias("__c"))
        local = sliced.meet(local, carried).withColumn(
            "__l", F.coalesce("__l", "__c")).drop("__c")
    out = local.withColumns({prefix + c: F.col("__l").getField(c) for c in cols})
    return sliced.with_df(out.drop("__l"))


def _diff(sliced: Sliced, col: str, out: str) -> Sliced:
    moved = _previous(sliced, [col])
    return moved.with_df(moved.df.withColumn(out, F.col(col) - F.col("__prev_" + col))
                         .drop("__prev_" + col))


def diff(df: DataFrame, col: str, order: Order, out: str = "diff",
         scan: str = "auto") -> DataFrame:
    """Change against the previous row; NULL on the first row."""
    return _diff(slice_series(df, order, scan), col, out).plain()


def locf(df: DataFrame, cols: str | Iterable[str], order: Order, suffix: str = "",
         scan: str = "auto") -> DataFrame:
    """Carry the last known value forward; leading NULLs stay."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    sliced = slice_series(df, order, scan)
    window = _upto(sliced.window())
    local = sliced.df.withColumns(
        {f"__f_{c}": F.last(c, ignorenulls=True).over(window) for c in cols})
    if sliced.cut:
        last = sliced.df.groupBy(*sliced.keys).agg(*[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order.by))).alias(f"__t_{c}")
            for c in cols])
        carry = _Carry(sliced)
        carried = last.select(*sliced.keys, *[
            carry.last_before(f"__t_{c}").alias(f"__c_{c}") for c in cols])
        local = sliced.meet(local, carried)
        filled = {c + suffix: F.coalesce(f"__f_{c}", f"__c_{c}") for c in cols}
    else:
        filled = {c + suffix: F.col(f"__f_{c}") for c in cols}
    scratch = [f"__f_{c}" for c in cols] + [f"__c_{c}" for c in cols]
    return local.withColumns(filled).drop(SLICE, *scratch)


# interpolation --------------------------------------------------------------

def _interpolate(sliced: Sliced, cols: Sequence[str], x: str, suffix: str) -> Sliced:
    order = sliced.order
    by_position = x == "position"
    df = sliced.df.withColumn("__lp", F.row_number().over(sliced.window()))
    df = df.withColumn("__x", F.col("__lp").cast("double") if by_position
                       else epoch_seconds(F.col(order.time)))
    # the row number leads, so the extremes of a slice are its first and last points
    points = {c: F.when(F.col(c).isNotNull(), F.struct(
        F.col("__lp"), F.col("__x").alias("x"), F.col(c).alias("y"))) for c in cols}
    ahead, back = {}, {}
    for c in cols:
        back[f"__b_{c}"] = F.last(points[c], ignorenulls=True).over(_upto(sliced.window()))
        ahead[f"__n_{c}"] = F.last(points[c], ignorenulls=True).over(_upto(sliced.reverse()))
    local = df.withColumns(back).withColumns(ahead)
    if sliced.cut:
        ends = df.groupBy(*sliced.keys).agg(
            F.count(F.lit(1)).alias("__n"),
            *[F.min(points[c]).alias(f"__lo_{c}") for c in cols],
            *[F.max(points[c]).alias(f"__hi_{c}") for c in cols])
        carry = _Carry(sliced)
        offset = carry.total_before("__n").cast("double") if by_position else F.lit(0.0)
        ends = ends.withColumn("__off", offset)

        def moved(c):
            return F.when(F.col(c).isNotNull(), F.struct(
                F.col(c).getField("__lp").alias("__lp"),
                (F.col(c).getField("x") + F.col("__off")).alias("x"),
                F.col(c).getField("y").alias("y")))

        state = ends.select(
            *sliced.keys, "__off",
            *[carry.last_before(moved(f"__hi_{c}")).alias(f"__cb_{c}") for c in cols],
            *[carry.first_after(moved(f"__lo_{c}")).alias(f"__cn_{c}") for c in cols])
        local = sliced.meet(local, state)
        local = local.withColumns({
            name: F.coalesce(moved(name), F.col(name.replace("__b_", "__cb_", 1)
                                                .replace("__n_", "__cn_", 1)))
            for c in cols for name in (f"__b_{c}", f"__n_{c}")})
        local = local.withColumn("__x", F.col("__x") + F.col("__off"))

    def value(c):
        b, n = F.col(f"__b_{c}"), F.col(f"__n_{c}")
        span = n.getField("x") - b.getField("x")
        line = b.getField("y") + (n.getField("y") - b.getField("y")) \
            * (F.col("__x") - b.getField("x")) / span
        return F.when(F.col(c).isNotNull(), F.col(c).cast("double")) \
            .when(span == 0, b.getField("y").cast("double")).otherwise(line)

    out = local.withColumns({c + suffix: value(c) for c in cols})
    scratch = [f"__{p}_{c}" for p in ("b", "n", "cb", "cn") for c in cols]
    return sliced.with_df(out.drop("__lp", "__x", "__off", *scratch))


def interpolate(df: DataFrame, cols: str | Iterable[str], order: Order, x: str = "position",
                suffix: str = "", scan: str = "auto") -> DataFrame:
    """Fill NULLs on the straight line between the known neighbours.

    ``x='position'`` measures distance in rows, ``'time'`` in seconds. NULLs
    before the first and after the last known value stay.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    return _interpolate(slice_series(df, order, scan), cols, x, suffix).plain()


# runs -----------------------------------------------------------------------

_RUN_COLUMNS = ("row_pos", "run_no", "run_id", "carried_id", "run_start", "run_end",
                "group_start", "group_end", "other_pos", "other_total")


def _runs(sliced: Sliced, col: str, value) -> Sliced:
    """Everything about the runs of ``col`` in one pass.

    row_pos                 position in the series, from 1
    run_no                  number of the run, counting all runs
    run_id                  number of the run among those equal to ``value``, else 0
    carried_id              the same, kept until the next such run begins
    run_start, run_end      first and last position of the row's run
    group_start, group_end  the same for the carried group
    other_pos, other_total  position among, and number of, rows with run_id 0
    """
    cut = sliced.cut
    window, upto = sliced.window(), _upto(sliced.window())
    later = _before(sliced.reverse())
    hit = F.coalesce(F.col(col) == value, F.lit(False))
    first = F.col("__prev").isNull()
    # the head row of a slice is judged by the summary, which sees the row before it
    starts = F.when(first, F.lit(not cut)).otherwise(
        ~_same(F.col("__prev").getField("x"), F.col(col)))

    df = sliced.df.withColumns({
        "__prev": F.lag(F.struct(F.col(col).alias("x"))).over(window),
        "__lp": F.row_number().over(window).cast("bigint"),
        "__hit": hit})
    df = df.withColumn("__start", starts)
    df = df.withColumn("__tstart", F.col("__start") & F.col("__hit"))
    place, tplace = F.when(F.col("__start"), F.col("__lp")), F.when(F.col("__tstart"), F.col("__lp"))
    one = lambda c: F.col(c).cast("bigint")
    local = df.withColumns({
        "__no": F.sum(one("__start")).over(upto),
        "__tno": F.sum(one("__tstart")).over(upto),
        "__other": F.sum((~F.col("__hit")).cast("bigint")).over(upto),
        "__s": F.max(place).over(upto),
        "__ts": F.max(tplace).over(upto)})
    local = local.withColumns({
        "__e": F.min(place).over(later), "__te": F.min(tplace).over(later)})

    if cut:
        head = F.min(F.struct(F.col("__lp"), F.col(col).alias("x")))
        tail = F.max(F.struct(F.col("__lp"), F.col(col).alias("x")))
        ends = df.groupBy(*sliced.keys).agg(
            F.count(F.lit(1)).alias("n"), head.alias("head"), tail.alias("tail"),
            F.sum(one("__start")).alias("no"), F.sum(one("__tstart")).alias("tno"),
            F.sum((~F.col("__hit")).cast("bigint")).alias("other"),
            F.min(place).alias("lo"), F.max(place).alias("hi"),
            F.min(tplace).alias("tlo"), F.max(tplace).alias("thi"))
        carry = _Carry(sliced)
        ends = ends.withColumns({
            "__off": carry.total_before("n"),
            "__total": F.sum("n").over(carry.all),
            "__obefore": carry.total_before("other"),
            "__ototal": F.sum("other").over(carry.all),
            "before": F.lag("tail").over(carry.forward)})
        ends = ends.withColumn("__h", ~_same(
            F.col("before").getField("x"), F.col("head").getField("x")))
        ends = ends.withColumn("__th", F.col("__h") & F.coalesce(
            F.col("head").getField("x") == value, F.lit(False)))

        def first_last(flag, lo, hi):
            at_head = F.when(F.col(flag), F.lit(1).cast("bigint"))
            return (F.coalesce(at_head, F.col(lo)) + F.col("__off"),
                    F.coalesce(F.col(hi), at_head) + F.col("__off"))

        lo, hi = first_last("__h", "lo", "hi")
        tlo, thi = first_last("__th", "tlo", "thi")
        state = ends.select(
            *sliced.keys, "__off", "__total", "__obefore", "__ototal", "__h", "__th",
            carry.total_before(F.col("no") + one("__h")).alias("__no0"),
            carry.total_before(F.col("tno") + one("__th")).alias("__tno0"),
            carry.last_before(hi).alias("__s0"), carry.last_before(thi).alias("__ts0"),
            carry.first_after(lo).alias("__e0"), carry.first_after(tlo).alias("__te0"))
        local = sliced.meet(local, state)
    else:
        everything = Window.partitionBy(*sliced.keys)
        zero, none, no = F.lit(0).cast("bigint"), F.lit(None).cast("bigint"), F.lit(False)
        local = local.withColumns({
            "__off": zero, "__obefore": zero, "__no0": zero, "__tno0": zero,
            "__h": no, "__th": no, "__s0": none, "__ts0": none, "__e0": none, "__te0": none,
            "__total": F.count(F.lit(1)).over(everything),
            "__ototal": F.sum((~F.col("__hit")).cast("bigint")).over(everything)})

    off = F.col("__off")

    def start(local_start, at_head, carried):
        return F.coalesce(off + F.col(local_start), F.when(F.col(at_head), off + 1),
                          F.col(carried))

    def end(local_next, carried):
        return F.coalesce(off + F.col(local_next), F.col(carried), F.col("__total") + 1) - 1

    carried_id = F.col("__tno0") + one("__th") + F.col("__tno")
    out = local.withColumns({
        "row_pos": off + F.col("__lp"),
        "run_no": F.col("__no0") + one("__h") + F.col("__no"),
        "carried_id": carried_id,
        "run_id": F.when(F.col("__hit"), carried_id).otherwise(F.lit(0).cast("bigint")),
        "run_start": start("__s", "__h", "__s0"),
        "run_end": end("__e", "__e0"),
        "group_start": F.coalesce(start("__ts", "__th", "__ts0"), F.lit(1).cast("bigint")),
        "group_end": end("__te", "__te0"),
        "other_pos": F.col("__obefore") + F.col("__other"),
        "other_total": F.col("__ototal")})
    kept = [c for c in sliced.df.columns if c not in _RUN_COLUMNS]
    return sliced.with_df(out.select(*kept, *_RUN_COLUMNS))


def _drop_run_columns(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    return df.drop(*[c for c in _RUN_COLUMNS if c not in set(keep)])


def run_id(df: DataFrame, col: str, value, order: Order, out: str = "id",
           carry: bool = False, scan: str = "auto") -> DataFrame:
    """Number the runs of ``col == value`` 1, 2, ... in order; other rows get 0.

    ``carry=True`` keeps the number until the next run begins, as filling the
    number forward would (0 before the first run).
    """
    runs_ = _runs(slice_series(df, order, scan), col, value)
    number = "carried_id" if carry else "run_id"
    return _drop_run_columns(runs_.df.withColumn("__id", F.col(number))) \
        .withColumnRenamed("__id", out).drop(SLICE)


def runs(df: DataFrame, col: str, order: Order, value=None, scan: str = "auto") -> DataFrame:
    """Run-length encoding: one row per run (``value``: only runs of that value)."""
    numbered = _runs(slice_series(df, order, scan), col, F.lit(None) if value is None else value)
    table = numbered.df.groupBy(*order.series, "run_no").agg(
        F.max(col).alias("value"), F.max("run_id").alias("id"),
        F.min("row_pos").alias("start_idx"), F.max("row_pos").alias("end_idx"),
        F.count(F.lit(1)).alias("n"),
        F.min(order.time).alias("start_ts"), F.max(order.time).alias("end_ts"))
    return table.drop("id") if value is None else table.filter("id > 0").drop("run_no")


def run_lengths(df: DataFrame, col: str, value, order: Order, scan: str = "auto") -> DataFrame:
    """Rows in each run of ``col == value``."""
    numbered = _runs(slice_series(df, order, scan), col, value)
    return (numbered.df.filter("run_id > 0").groupBy(*order.series, F.col("run_id").alias("id"))
            .agg(F.count(F.lit(1)).alias("n")))


def _edge_positions(grouping: str) -> tuple[Column, Column]:
    """Position in the group from its start and from its end, both from 1.

    ``run``: rows outside the wanted runs form one pooled group with number 0.
    ``carry``: a group is a wanted run with all rows up to the next one.
    """
    pos = F.col("row_pos")
    if grouping == "carry":
        return pos - F.col("group_start") + 1, F.col("group_end") - pos + 1
    inside = F.col("run_id") > 0
    return (F.when(inside, pos - F.col("run_start") + 1).otherwise(F.col("other_pos")),
            F.when(inside, F.col("run_end") - pos + 1)
            .otherwise(F.col("other_total") - F.col("other_pos") + 1))


def with_run_position(df: DataFrame, col: str, value, order: Order, grouping: str = "run",
                      scan: str = "auto") -> DataFrame:
    """Add ``id``, ``from_start`` and ``from_end`` for the runs of ``col == value``."""
    numbered = _runs(slice_series(df, order, scan), col, value)
    head, tail = _edge_positions(grouping)
    number = "carried_id" if grouping == "carry" else "run_id"
    out = numbered.df.withColumns({"__i": F.col(number), "__h": head, "__t": tail})
    return _drop_run_columns(out).drop(SLICE).withColumnsRenamed(
        {"__i": "id", "__h": "from_start", "__t": "from_end"})


def _trim(sliced: Sliced, cols: Iterable[str], head: int, tail: int, background: bool) -> Sliced:
    from_start, from_end = _edge_positions("run")
    edge = (from_start <= head) | (from_end <= tail)
    if not background:
        edge = edge & (F.col("run_id") > 0)
    return sliced.with_df(sliced.df.withColumns({c: F.when(~edge, F.col(c)) for c in cols}))


def trim_runs(df: DataFrame, cols: Iterable[str], status: str, value, order: Order,
              head: int = 0, tail: int = 0, background: bool = False,
              scan: str = "auto") -> DataFrame:
    """Null the first ``head`` and last ``tail`` samples of each run.

    ``background=True`` treats the rows outside all runs as one more run.
    """
    numbered = _runs(slice_series(df, order, scan), status, value)
    trimmed = _trim(numbered, cols, head, tail, background).df
    return _drop_run_columns(trimmed.withColumn("__id", F.col("run_id"))) \
        .withColumnRenamed("__id", "id").drop(SLICE)


def flag_run_edges(df: DataFrame, status: str, value, order: Order, head: int, tail: int,
                   grouping: str = "run", out: str = "edge_flag",
                   scan: str = "auto") -> DataFrame:
    """1 on the first ``head`` and last ``tail`` samples of each group, else 0."""
    numbered = _runs(slice_series(df, order, scan), status, value)
    return _drop_run_columns(_flag_edges(numbered, head, tail, grouping, out).df).drop(SLICE)


def _flag_edges(sliced: Sliced, head: int, tail: int, grouping: str, out: str) -> Sliced:
    from_start, from_end = _edge_positions(grouping)
    return sliced.with_df(sliced.df.withColumn(
        out, ((from_start <= head) | (from_end <= tail)).cast("int")))
