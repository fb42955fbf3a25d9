"""How quality filters act together: every order of the filters over every document."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import pieces_of, small_batches, whole_text
from driftline.llm.transducer import Transducer

COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")
#: Conditions under which a document fails, over the counts of :func:`profile`.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 2 * n_points",
    "D": "n_symbols > 0",
}
#: The filter that a text fails where a smaller id has the same text.
REPEAT = "E"


def profile(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_column: str = "text",
            symbols: bytes = b"#$%&*|") -> DataFrame:
    """The columns ``keep`` of each row, the counts of its whole text and its SHA-256 (binary).

    Words are runs of bytes other than space and 0x09 to 0x0D; words are distinct by their
    bytes; capitals are A-Z. A null text counts as empty. No exchange: a task holds one
    small slice of texts (or one long text), a block's arrays and the different words.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)],
                       whole_text(text_column).cast("binary").alias("__text"))

    def run(batches):
        transducer = Transducer(symbols)
        for batch in (x for whole in batches for x in pieces_of(whole, len(keep))):
            texts = batch.column(len(keep)).to_pylist()
            counts = transducer.run(texts)
            digests = [hashlib.sha256(x).digest() for x in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], *[pa.array(c) for c in counts.T],
                 pa.array(digests, pa.binary())],
                names=[*[f"__k{i}" for i in range(len(keep))], *COUNTS, "text_sha256"])

    schema = T.StructType([*rows.schema.fields[:len(keep)],
                           *[T.StructField(c, T.LongType()) for c in COUNTS],
                           T.StructField("text_sha256", T.BinaryType())])
    return rows.mapInArrow(run, schema).withColumnsRenamed(
        {f"__k{i}": c for i, c in enumerate(keep)})


def _bits(flags: Sequence[Column]) -> Column:
    total = F.lit(0)
    for place, flag in enumerate(flags):
        total = total + F.when(flag, F.lit(1 << place)).otherwise(0)
    return total


def failure_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS,
                   id_column: str = "doc_id", text_column: str = "text",
                   part_column: str = "source") -> DataFrame:
    """Documents by part and failed filters: part, failed (bits in the order of the filters,
    the repeat filter last), n, n_good, n_toxic.

    A text is a repeat where the table has the same text under a smaller id; a null id has
    no order and never is one, rows of one id don't repeat each other. Labels of one id count
    together (good or toxic if any row says so); labels without an id belong to nothing.
    Counts are combined before every exchange, none carries texts, and a text's rows meet
    only as one row for each part and label, so many copies don't meet in one task.
    """
    rows = profile(docs.select(F.col(id_column).alias("__id"), F.coalesce(
        F.col(part_column).cast("string"), F.lit("")).alias("__part"),
        F.col(text_column).alias("__text")), ("__id", "__part"), "__text")
    rows = rows.select(
        "__id", "__part", F.col("text_sha256").alias("__sha"),
        _bits([F.expr(x) for x in filters.values()]).alias("__failed"),
        # rows without an id match no label: they are spread instead of meeting at NULL
        F.when(F.col("__id").isNull(), F.xxhash64("text_sha256", "__part"))
        .otherwise(F.lit(0)).alias("__spread"))
    told = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("__id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("__good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("__toxic"))
    told = told.withColumn("__spread", F.lit(0).cast("bigint"))
    labelled = rows.join(told, ["__id", "__spread"], "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("__good", "__toxic")})

    kind = ["__sha", "__part", "__failed", "__good", "__toxic"]
    per_id = labelled.groupBy(*kind, "__id").agg(F.count(F.lit(1)).alias("__n"))
    per_text = per_id.groupBy(*kind).agg(
        F.sum("__n").alias("__n"), F.min("__id").alias("__first"),
        F.coalesce(F.min_by("__n", "__id"), F.lit(0)).alias("__at_first"),
        F.sum(F.when(F.col("__id").isNull(), F.col("__n")).otherwise(0)).alias("__without"))
    least = F.min("__first").over(Window.partitionBy("__sha"))
    single = F.col("__without") + F.when(F.col("__first") == least, F.col("__at_first")).otherwise(0)
    sides = F.explode(F.array(
        F.struct(F.col("__failed").alias("failed"), F.col("__single").alias("n")),
        F.struct((F.col("__failed") + (1 << len(filters))).alias("failed"),
                 (F.col("__n") - F.col("__single")).alias("n"))))
    split = per_text.withColumn("__single", single).select(
        "__part", "__good", "__toxic", sides.alias("__s"))
    n = F.col("__s.n")
    return split.groupBy(F.col("__part").alias("part"), F.col("__s.failed").alias("failed")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("__good"), n).otherwise(0)).alias("n_good"),
        F.sum(F.when(F.col("__toxic"), n).otherwise(0)).alias("n_toxic"))


def interactions(counts: DataFrame, letters: str) -> DataFrame:
    """Every order of the filters over the counts of :func:`failure_counts`.

    One row for each part, ``filter_order`` and ``step``, zeros included: kept, removed,
    redundant, unique_fails, good_lost, toxic_lost and shapley (what the step's filter
    removes, summed over all orders: a document that fails k filters is removed by each of
    them in one order of k). A part is one row of at most 2 ** len(letters) cells.
    """
    cells = counts.groupBy("part").agg(F.collect_list(
        F.struct("failed", "n", "n_good", "n_toxic")).alias("__cells"))
    orders = ",".join("".join(p) for p in permutations(letters))
    steps = cells.select("part", "__cells", F.explode(F.split(F.lit(orders), ",")).alias(
        "filter_order")).select("*", F.explode(F.sequence(
            F.lit(1), F.lit(len(letters)))).alias("step"))
    steps = steps.withColumns({
        "__own": _shifted(letters, F.substring("filter_order", F.col("step"), F.lit(1))),
        "__prior": _shifted(letters, F.substring("filter_order", F.lit(1), F.col("step") - 1))})
    own, before = F.col("__own"), F.col("__prior")

    def total(condition, field="n", weight=None):
        def add(acc, cell):
            amount = cell[field] if weight is None else cell[field] * weight(cell)
            return acc + F.when(condition(cell.failed), amount).otherwise(F.lit(0))
        return F.aggregate("__cells", F.lit(0).cast("bigint"), add)

    def fails(x, bits):
        return x.bitwiseAND(bits) != 0

    def here(x):
        return fails(x, own) & ~fails(x, before)

    share = factorial(len(letters))
    return steps.select(
        "part", "filter_order", "step",
        total(lambda x: ~fails(x, own) & ~fails(x, before)).alias("kept"),
        total(here).alias("removed"),
        total(lambda x: fails(x, own) & fails(x, before)).alias("redundant"),
        total(lambda x: x == own).alias("unique_fails"),
        total(here, "n_good").alias("good_lost"),
        total(here, "n_toxic").alias("toxic_lost"),
        total(lambda x: fails(x, own), weight=lambda c: (
            F.lit(share) / F.bit_count(c.failed)).cast("bigint")).alias("shapley"))


def _shifted(letters: str, text: Column) -> Column:
    """The bits of the letters that ``text`` holds."""
    return _bits([F.contains(text, F.lit(x)) for x in letters])


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS,
                  id_column: str = "doc_id", text_column: str = "text",
                  part_column: str = "source") -> DataFrame:
    """The report of :func:`interactions` for ``filters`` and the repeat filter.

    A null part counts as the empty one. Parts are those that occur in ``docs``; an empty
    table gives an empty report. Other columns are not looked at.
    """
    counts = failure_counts(docs, labels, filters, id_column, text_column, part_column)
    return interactions(counts, "".join(filters) + REPEAT)
