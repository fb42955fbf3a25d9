"""Bring tables together on a common instant."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import AtomicType

from driftline.operators.rows import bind_rows
from driftline.session import small_table

#: Rows of one key and table that one task multiplies with the other tables' rows.
KEY_ROWS = 20_000


def align_left(spine: DataFrame, others: Sequence[DataFrame],
               on: Iterable[str] = ("date",)) -> DataFrame:
    """Left joins onto ``spine``: its rows decide which instants exist."""
    keys = list(on)
    return reduce(lambda a, b: a.join(b, keys, "left"), others, spine)


def align_full(tables: Sequence[DataFrame], on: Iterable[str] = ("date",),
               unique: bool = False, key_rows: int = KEY_ROWS) -> DataFrame:
    """Every instant of any table. Value columns must differ between tables.

    A repeated key multiplies rows, as a fold of full joins does; a row with an unknown
    key stays alone. All tables go through one exchange, whatever their number
    (:func:`_multiplied`). With ``unique`` no table may repeat a key (averages never do);
    a row for each key is then aggregated, and a repeated key is an error.
    """
    keys = list(on)
    values = [c for t in tables for c in t.columns if c not in keys]
    if len(values) != len(set(values)):
        raise ValueError("the tables share value columns")
    if not unique:
        return _multiplied(tables, keys, key_rows)
    stacked = bind_rows(*[t.withColumn("__table", F.lit(i)) for i, t in enumerate(tables)])
    rows = [F.sum(F.when(F.col("__table") == i, 1).otherwise(0)) for i in range(len(tables))]
    most = F.greatest(*rows, F.lit(0))
    once = F.when(F.col("__most") > 1, F.raise_error(F.lit("a table repeats a key")).cast("boolean")
                  ).otherwise(F.lit(True))
    return (stacked.groupBy(*keys).agg(most.alias("__most"), *[F.max(c).alias(c) for c in values])
            .filter(once).drop("__most"))


def tagged(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The rows of all tables: keys, __table and the row's values in its table's struct __r_i."""
    parts = []
    for i, table in enumerate(tables):
        values = [F.col(f"`{c}`") for c in table.columns if c not in keys]
        # the place tells a row without values from no row
        row = F.struct(F.lit(i).alias("__i"), *values).alias(f"__r_{i}")
        simple = [F.col(f"`{f.name}`") for f in table.schema if isinstance(f.dataType, AtomicType)]
        # rows are dealt by their values and the partition they were read in, which a retried
        # task finds again; copies of one row are spread as well
        spread = F.xxhash64(F.lit(i), *simple, F.spark_partition_id()).alias("__spread")
        parts.append(table.select(*keys, row, F.lit(i).alias("__table"), spread))
    return bind_rows(*parts)


def _multiplied(tables: Sequence[DataFrame], keys: list[str], key_rows: int) -> DataFrame:
    """The fold of full joins as one grouping of tagged rows by key.

    A key's rows are lists, one for each table, and their product is unfolded. A key of
    which some table has more than ``key_rows`` rows is cut: the rows of each table are
    dealt to parts, and every combination of parts is a group of its own, so that each pair
    of rows meets once and no group holds much more than ``key_rows`` rows of a table. The
    keys' rows are counted first, combined where they are read. Rows with an unknown key
    are dealt to groups of their own table.
    """
    rows = tagged(tables, keys)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    per_table = rows.where(known).groupBy(*keys).agg(*[
        F.count(F.when(F.col("__table") == i, 1)).alias(f"__n_{i}") for i in range(len(tables))])
    parts = [F.greatest(F.lit(1), F.ceil(F.col(f"__n_{i}") / key_rows)) for i in range(len(tables))]
    held = [F.signum(f"__n_{i}").cast("int") for i in range(len(tables))]
    crowded = per_table.select(*keys, F.array(*parts).alias("__parts"), F.array(*held).alias(
        "__held")).where(F.exists("__parts", lambda n: n > 1))
    rows = _cut_keys(rows, crowded, keys, len(tables))
    alone = -1 - F.pmod(F.col("__spread"), F.lit(1 << 40)) * len(tables) - F.col("__table")
    rows = rows.withColumn("__cell", F.when(known, F.col("__cell")).otherwise(alone))
    lists = rows.groupBy(*keys, "__cell").agg(F.max("__held").alias("__held"), *[
        F.collect_list(f"__r_{i}").alias(f"__r_{i}") for i in range(len(tables))])
    # a table that has rows of a cut key, but none in this part, has its pairs in other cells
    lists = lists.where(reduce(lambda a, b: a & b, [
        (F.size(f"__r_{i}") > 0) | (F.coalesce(F.get("__held", i), F.lit(0)) == 0)
        for i in range(len(tables))]))
    for i in range(len(tables)):
        lists = lists.withColumn(f"__r_{i}", F.explode_outer(f"__r_{i}"))
    return lists.select(*keys, *[F.col(f"__r_{i}").getField(c).alias(c)
                                 for i, t in enumerate(tables) for c in t.columns if c not in keys])


def _cut_keys(rows: DataFrame, crowded: DataFrame, keys: list[str], tables: int) -> DataFrame:
    """Rows with the cell, or cells, of their key that they belong to (__cell).

    A cell is one part of every table. A row has its own table's part and goes to all cells
    with it; a key that isn't crowded is one cell.
    """
    few = small_table(crowded)
    if few is not None and few.isEmpty():
        return rows.withColumns({"__cell": F.lit(0).cast("bigint"),
                                 "__held": F.lit(None).cast("array<int>")})
    placed = rows.join(F.broadcast(few) if few is not None else crowded, keys, "left")
    size = F.aggregate("__parts", F.lit(1).cast("bigint"), lambda a, n: a * n)
    before = F.aggregate(F.slice("__parts", 1, F.col("__table")), F.lit(1).cast("bigint"),
                         lambda a, n: a * n)
    own = F.element_at("__parts", F.col("__table") + 1)
    placed = placed.withColumns({"__size": size, "__before": before, "__own": own})
    others = F.sequence(F.lit(0).cast("bigint"), (F.col("__size") / F.col("__own")).cast("bigint") - 1)
    part = F.pmod(F.col("__spread"), F.col("__own"))

    def cell(rest: Column) -> Column:
        low = F.pmod(rest, F.col("__before"))
        high = F.floor(rest / F.col("__before"))
        return (high * F.col("__own") + part) * F.col("__before") + low

    cells = F.when(F.col("__parts").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(
        F.transform(others, cell))
    return placed.withColumn("__cell", F.explode(cells)).drop("__parts", "__size", "__before", "__own")
