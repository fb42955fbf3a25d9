"""Group statistics and their attachment to rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from driftline.functions.stats import mean_strict, quadrature, sd_strict

#: Rows of a group whose middle one task finds; larger groups are narrowed before the exchange.
RANKED_VALUES = 250_000
#: Large groups whose brackets may be broadcast, two numbers for each group and channel.
BRACKETED = 10_000
_CELLS = 256


def group_mean(df: DataFrame, keys: Iterable[str], cols: Iterable[str],
               strict: bool = False) -> DataFrame:
    mean = mean_strict if strict else F.avg
    return df.groupBy(*keys).agg(*[mean(F.col(c)).alias(c) for c in cols])


def group_sd(df: DataFrame, keys: Iterable[str], cols: Iterable[str],
             strict: bool = True) -> DataFrame:
    """Sample standard deviation; one row has none."""
    sd = sd_strict if strict else F.stddev_samp
    return df.groupBy(*keys).agg(*[sd(F.col(c)).alias(c) for c in cols])


def group_median(df: DataFrame, keys: Iterable[str], cols: Iterable[str],
                 max_rows: int = RANKED_VALUES) -> DataFrame:
    """Exact median, missing values skipped.

    Groups of at most ``max_rows`` rows are aggregated as they are. For larger ones
    quantile summaries, merged from partial aggregates, bracket the middle
    (:func:`brackets`); then only rows inside the bracket are exchanged, the others are
    counted where they are read (:func:`middle_values`). The summaries are made when the
    plan is built; each round reads the keys and channels once.
    """
    keys, cols = list(keys), list(cols)
    if not cols:
        return df.select(*keys).distinct()
    if not keys:
        return group_median(df.withColumn("__all", F.lit(0)), ["__all"], cols, max_rows).drop("__all")
    large = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max_rows)
             .orderBy(F.col("__n").desc()).limit(BRACKETED).select(*keys))
    found = large.collect()
    if not found:
        return df.groupBy(*keys).agg(*[F.median(F.col(c).cast("double")).alias(c) for c in cols])
    known = df.sparkSession.createDataFrame(found, large.schema)
    merged = middle_values(df, keys, cols, brackets(df, keys, cols, known, max_rows))
    by = [*keys, "__c"]
    ordered = Window.partitionBy(*by).orderBy("__side", "__x").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = merged.withColumns({"__upto": F.sum("__n").over(ordered),
                                 "__all": F.sum("__n").over(Window.partitionBy(*by))})
    middle = {(i, side): F.max(F.when((F.col("__c") == i) & _covers(rank), F.col("__x")))
              for i in range(len(cols)) for side, rank in enumerate(_middle_ranks(F.col("__all")))}
    return ranked.groupBy(*keys).agg(*[
        ((middle[i, 0] + middle[i, 1]) / 2).alias(c) for i, c in enumerate(cols)])


def _middle_ranks(total: Column) -> tuple[Column, Column]:
    """The rank of the median, or the two ranks it lies between."""
    return F.floor((total + 1) / 2), F.floor(total / 2) + 1


def _covers(rank: Column) -> Column:
    return (F.col("__upto") >= rank) & (F.col("__upto") - F.col("__n") < rank)


def _side(x: Column, i: int) -> Column:
    """-1 below the bracket, 1 above it, 0 inside; a group without a bracket is inside."""
    return (F.when(x < F.col(f"__lo_{i}"), -1).when(x > F.col(f"__hi_{i}"), 1).otherwise(0))


def brackets(df: DataFrame, keys: list[str], cols: list[str], known: DataFrame,
             max_rows: int = RANKED_VALUES) -> DataFrame:
    """Bounds around the middle of the groups ``known``: __lo_i and __hi_i of each channel.

    Every round counts, exactly, what lies below, inside and above the bounds, and merges a
    quantile summary of what lies inside; the next bounds are the summary's cells around
    the middle. Bounds that turn out not to hold the middle are given up for the ones
    before, so how well the summaries fit affects the number of rounds, not the result. A
    round's exchange carries counts and summaries, and a row for each group comes back.
    """
    bounds = [f"__{end}_{i}" for i in range(len(cols)) for end in ("lo", "hi")]
    groups = [tuple(r[k] for k in keys) for r in known.collect()]
    types = [*[known.schema[k] for k in keys], StructField("__nr", IntegerType()),
             *[StructField(b, DoubleType()) for b in bounds]]
    now = [[(None, None)] * len(cols) for _ in groups]
    sure = [list(ends) for ends in now]

    def table(ends):
        return df.sparkSession.createDataFrame(
            [(*g, nr, *[x for pair in ends[nr] for x in pair]) for nr, g in enumerate(groups)],
            StructType(types))

    while True:
        moved = False
        for row in _round(df, keys, cols, table(now)).collect():
            group = row["__nr"]
            for i in range(len(cols)):
                seen = row[f"__s_{i}"]
                if not seen["covered"]:
                    now[group][i] = sure[group][i]
                    continue
                sure[group][i] = now[group][i]
                narrower = (seen["lo"], seen["hi"])
                if seen["inside"] > max_rows and narrower != now[group][i]:
                    now[group][i] = narrower
                    moved = True
        if not moved:
            return table(sure).drop("__nr")


def _round(df: DataFrame, keys: list[str], cols: list[str], bounds: DataFrame) -> DataFrame:
    """What one round of :func:`brackets` learns of group __nr: __s_i (covered, inside, lo, hi)."""
    rows = join_on(df.select(*keys, *[F.col(c).cast("double").alias(f"__x_{i}")
                                      for i, c in enumerate(cols)]),
                   F.broadcast(bounds), keys, "inner")
    aggregates = [F.first("__nr").alias("__nr")]
    for i in range(len(cols)):
        x = F.col(f"__x_{i}")
        inside = F.when(_side(x, i) == 0, x)
        aggregates += [
            F.count(x).alias(f"__n_{i}"), F.count(inside).alias(f"__m_{i}"),
            F.count(F.when(_side(x, i) < 0, x)).alias(f"__b_{i}"),
            F.percentile_approx(inside, [k / _CELLS for k in range(1, _CELLS)],
                                10 * _CELLS).alias(f"__g_{i}"),
            F.first(f"__lo_{i}").alias(f"__lo_{i}"), F.first(f"__hi_{i}").alias(f"__hi_{i}")]
    seen = []
    for i in range(len(cols)):
        n, m, below, grid = (F.col(f"__{x}_{i}") for x in "nmbg")
        low, high = _middle_ranks(n)
        first = F.floor((low - below) * _CELLS / F.nullif(m, F.lit(0))) - 1
        last = F.ceil((high - below) * _CELLS / F.nullif(m, F.lit(0))) + 1
        seen.append(F.struct(
            ((n == 0) | ((below < low) & (high <= below + m))).alias("covered"), m.alias("inside"),
            F.when(first >= 1, F.get(grid, first.cast("int") - 1)).otherwise(
                F.col(f"__lo_{i}")).alias("lo"),
            F.when(last < _CELLS, F.get(grid, last.cast("int") - 1)).otherwise(
                F.col(f"__hi_{i}")).alias("hi")).alias(f"__s_{i}"))
    return rows.groupBy(*keys).agg(*aggregates).select("__nr", *seen)


def middle_values(df: DataFrame, keys: list[str], cols: list[str], bounds: DataFrame) -> DataFrame:
    """Values of each group and channel (__c, __x) with their number of rows (__n).

    Rows outside the bounds are one row each side (__side), counted before the exchange.
    A group without bounds has all its values; missing ones are a row that counts nothing.
    """
    rows = join_on(df.select(*keys, *[F.col(c).cast("double").alias(f"__x_{i}")
                                      for i, c in enumerate(cols)]),
                   F.broadcast(bounds), keys, "left")
    values = rows.select(*keys, F.explode(F.array(*[F.struct(
        F.lit(i).alias("c"), _side(F.col(f"__x_{i}"), i).alias("side"),
        F.when(_side(F.col(f"__x_{i}"), i) == 0, F.col(f"__x_{i}")).alias("x"),
        F.col(f"__x_{i}").isNotNull().cast("bigint").alias("n")) for i in range(len(cols))]))
        .alias("__v"))
    return (values.groupBy(*keys, F.col("__v.c").alias("__c"), F.col("__v.side").alias("__side"),
                           F.col("__v.x").alias("__x")).agg(F.sum("__v.n").alias("__n")))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which an unknown key matches an unknown key, as in a grouping."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"__r_{k}" for k in keys])


def distinct_stats(df: DataFrame, cols: Iterable[str], keys: Iterable[str] = ()) -> DataFrame:
    """Mean and sample standard deviation over the distinct values.

    Equal values are merged before and after one exchange by value; the moments of what is
    left are merged in a second, which carries one row per task, group and column.
    """
    keys, cols = list(keys), list(cols)
    values = df.select(*keys, F.explode(F.array(*[F.struct(
        F.lit(i).alias("c"), F.col(c).cast("double").alias("x"))
        for i, c in enumerate(cols)])).alias("__v"))
    once = values.select(*keys, F.col("__v.c").alias("__c"), F.col("__v.x").alias("__x")).distinct()
    moments = []
    for i, c in enumerate(cols):
        x = F.when(F.col("__c") == i, F.col("__x"))
        moments += [F.avg(x).alias(f"{c}_mean"), F.stddev_samp(x).alias(f"{c}_sd")]
    return once.groupBy(*keys).agg(*moments)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def lod(df: DataFrame, a: str, b: str, keys: Iterable[str], combined: str = "nox",
        k: float = 2.0, n: int = 6) -> DataFrame:
    """Limits of detection of two channels and of their sum.

    ``k`` standard deviations of the zero signal, combined in quadrature and
    divided by the root of the ``n`` samples averaged into one value.
    """
    keys = list(keys)
    sd = group_sd(df, keys, [a, b]).select(
        *keys, (F.lit(k) * F.col(a)).alias(f"{a}_sd"), (F.lit(k) * F.col(b)).alias(f"{b}_sd"))
    sd = sd.withColumn(f"{combined}_sd", quadrature(F.col(f"{a}_sd"), F.col(f"{b}_sd")))
    return sd.withColumns({f"{c}_lod": F.col(f"{c}_sd") / F.sqrt(F.lit(float(n)))
                           for c in (a, b, combined)})
