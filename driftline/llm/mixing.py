"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import NON_SPACE, cut, whole_text

WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 1024
ROWS_PER_BUCKET = 5_000
SLOTS_PER_CHUNK = 1 << 16
#: The golden ratio's fractional part in 31 bits; odd, so that i * STEP visits every point.
STEP, POINTS_BITS = 1327217885, 31
POINTS = 1 << POINTS_BITS
CELL_BITS = 10
_WIDE = "decimal(38,0)"


def source_targets(sizes: DataFrame) -> DataFrame:
    """rank, weight, source_size and target of every source of ``sizes`` (source, size).

    Sources by code point, null last, weigh 3, 1, 2 and so on. They share one and a half
    times all words; a source that would pass twice its size stops there, and the others
    share what it leaves by weight. Sorted by size over weight, those that stop come
    first, so one running sum finds them all. Works on one row per source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = total.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]),
                          ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    fill = Window.orderBy("level", "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    wide = (ranked.withColumn("weight", weight)
            .withColumn("level", (F.col("source_size") * (F.lit(6) / F.col("weight")).cast("long")))
            .withColumn("s", F.col("source_size").cast(_WIDE))
            .withColumn("w", F.col("weight").cast(_WIDE))
            .withColumn("s_before", F.coalesce(F.sum("s").over(before), F.lit(0).cast(_WIDE)).cast(_WIDE))
            .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0).cast(_WIDE)).cast(_WIDE))
            .withColumn("s_all", F.sum("s").over(everything).cast(_WIDE))
            .withColumn("w_all", F.sum("w").over(everything).cast(_WIDE)))
    stops = F.expr("w * (3 * s_all - 4 * s_before) >= 4 * s * (w_all - w_before)")
    told = (wide.withColumn("stops", stops)
            .withColumn("s_stop", F.sum(F.expr("if(stops, s, 0bd)")).over(everything))
            .withColumn("w_stop", F.sum(F.expr("if(stops, w, 0bd)")).over(everything)))
    target = F.expr("if(stops, 2 * double(source_size), "
                    "double(w * (3 * s_all - 4 * s_stop)) / double(2 * (w_all - w_stop)))")
    return told.select("source", "rank", "weight", "source_size", target.alias("target"))


def _quotas(targets: DataFrame, block: int) -> DataFrame:
    """Words to take of each source, and the slots its blocks need for them."""
    return (targets.withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
            .withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
            .withColumn("passes", F.expr("if(source_size = 0, 0L, quota div source_size)"))
            .withColumn("slots", F.expr(
                f"passes * blocks + cast(ceil((quota - passes * source_size) / {block}) as long)")))


class Mix:
    """A mix of ``docs``: sizes, targets and the schedule, as DataFrames.

    documents  one row per row of docs: id, source, rank, tie, size, start (its place in
               the source's shuffled stream of words), source_size, target
    schedule   slot, rank, pass, and the run of words (id, first, words) of each document
               that the slot's block takes

    The stream order is a hash of the id and the text, so reruns agree. The running sum of
    sizes is taken in buckets of some thousand different rows, however large a source and
    however many rows repeat an id, or have none.
    Slot i of n is the point i * golden ratio mod 1, looked up in the cumulative weights;
    a source's k-th slot takes its block k mod its number of blocks. A source whose points
    fall short by the sequence's discrepancy gets the rest at the end, so that it takes
    exactly its target, rounded.
    """

    def __init__(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 source_column: str = "source", block_words: int = BLOCK_WORDS):
        self.spark, self.block = docs.sparkSession, block_words
        text = whole_text(text_column)
        key = F.md5(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(":"),
                             F.md5(text)))
        sized = docs.select(
            F.col(id_column).alias("id"), F.col(source_column).alias("source"),
            F.regexp_count(text, F.lit(NON_SPACE)).cast("long").alias("size"),
            key.alias("key"), F.xxhash64(text).alias("tie"))
        # rows that repeat id and text stand one after the other: one row with their number
        sized = cut(sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("copies")))
        rows = sized.count()
        buckets = max(1, -(-rows // ROWS_PER_BUCKET))
        words = (F.col("size") * F.col("copies")).alias("size")
        self.sources = cut(_quotas(source_targets(sized.select("source", words)), block_words))
        known = (self.sources.withColumnRenamed("source", "__source"))
        joined = sized.join(known, sized["source"].eqNullSafe(F.col("__source"))).drop("__source")
        joined = joined.withColumn("bucket", F.floor(
            F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int"))
        inside = Window.partitionBy("rank", "bucket").orderBy("key", "size", "tie").rowsBetween(
            Window.unboundedPreceding, 0)
        offsets = (joined.groupBy("rank", "bucket").agg(F.sum(words).alias("n"))
                   .select("rank", "bucket", (F.sum("n").over(
                       Window.partitionBy("rank").orderBy("bucket")) - F.col("n")).alias("offset")))
        copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
        self.documents = cut(
            joined.withColumn("upto", F.sum(words).over(inside)).join(offsets, ["rank", "bucket"])
            .select("*", copy)
            .select("id", "source", "rank", "tie", "size",
                    (F.col("offset") + F.col("upto") - F.col("copy") * F.col("size")).alias("start"),
                    "source_size", "target"))

    def _slots(self) -> DataFrame:
        """slot, rank, k: the k-th slot of the source of that rank."""
        n = self.sources.agg(F.sum("slots")).first()[0] or 0
        order = Window.orderBy("rank")
        edges = self.sources.where("slots > 0").select("rank", "slots", F.sum(
            F.col("slots").cast(_WIDE)).over(order).cast(_WIDE).alias("upto"))
        edges = edges.select(
            "rank", F.expr(f"cast(((upto - slots) * {POINTS}) div {max(n, 1)} as bigint)").alias("lo"),
            F.expr(f"cast((upto * {POINTS}) div {max(n, 1)} as bigint)").alias("hi")).where("lo < hi")
        shift = POINTS_BITS - CELL_BITS
        edges = edges.withColumn("cell", F.explode(F.sequence(
            F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))))
        points = self.spark.range(n).select(
            F.col("id").alias("slot"), (F.col("id") % POINTS * STEP % POINTS).alias("x"))
        points = points.withColumn("cell", F.shiftright("x", shift))
        drawn = (points.join(edges, "cell").where("x >= lo and x < hi").select("slot", "rank")
                 .withColumn("chunk", F.expr(f"slot div {SLOTS_PER_CHUNK}")))
        counted = drawn.groupBy("rank", "chunk").agg(F.count(F.lit(1)).alias("n"))
        offsets = counted.select("rank", "chunk", (F.sum("n").over(
            Window.partitionBy("rank").orderBy("chunk")) - F.col("n")).alias("offset"))
        inside = Window.partitionBy("rank", "chunk").orderBy("slot")
        ranked = (drawn.withColumn("r", F.row_number().over(inside)).join(offsets, ["rank", "chunk"])
                  .select("slot", "rank", (F.col("offset") + F.col("r") - 1).alias("k")))
        short = (self.sources.select("rank", "slots")
                 .join(counted.groupBy("rank").agg(F.sum("n").alias("n")), "rank", "left")
                 .withColumn("n", F.coalesce("n", F.lit(0))).where("slots > n"))
        rest = short.select("rank", F.explode(F.sequence("n", F.col("slots") - 1)).alias("k"))
        return ranked.unionByName(rest.select((F.col("k") + n).alias("slot"), "rank", "k"))

    @property
    def schedule(self) -> DataFrame:
        block = self.block
        slots = (self._slots().join(self.sources.select(
            "rank", F.col("source_size").alias("all"), "quota", "blocks", "slots"), "rank")
            .where("k < slots")
            .withColumn("pass", F.expr("k div blocks")).withColumn("block", F.expr("k % blocks"))
            .withColumn("from", F.col("block") * block)
            .withColumn("take", F.expr(f"least({block}, all - from, quota - pass * all - from)"))
            .where("take > 0").select("slot", "rank", "pass", "block", "from", "take"))
        parts = self.documents.where("size > 0").select(
            "id", "rank", "tie", "size", "start", F.explode(F.sequence(
                F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
        first = F.greatest("start", "from")
        upto = F.least(F.col("start") + F.col("size"), F.col("from") + F.col("take"))
        return (parts.join(slots, ["rank", "block"])
                .select("slot", "rank", "pass", "id", "tie", "start",
                        (first - F.col("start")).alias("first"), (upto - first).alias("words"))
                .where("words > 0"))

    def taken(self) -> DataFrame:
        """The documents with ``taken``, the words the schedule takes of each."""
        took = self.schedule.groupBy("rank", "start").agg(F.sum("words").alias("taken"))
        some = self.documents.where("size > 0").join(took, ["rank", "start"], "left")
        none = self.documents.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
        return some.unionByName(none).withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs``.

    A null source is a source of its own, a null text has size 0 and is never taken; an
    empty table gives no rows; repeated rows are separate documents; extra columns are not
    looked at.
    """
    return Mix(docs).taken().select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                                    "taken")


def mix_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  chars_column: str | None = "n_chars",
                  source_column: str = "source") -> DataFrame:
    """The mixed documents: a row for each time a document is taken, with the taken words.

    A document taken in part (at the end of a source's quota) is cut after its last taken
    word. Rows that repeat a source, an id and its text count as one document with as many
    copies; where their other columns differ, the least of the rows stands for all.
    Columns stay; ``chars_column``, if there, becomes the length of the text.
    """
    mix = Mix(docs, id_column, text_column, source_column)
    took = (mix.schedule.groupBy("rank", "start", "pass", "id", "tie")
            .agg(F.sum("words").alias("words"))
            .join(mix.sources.select("rank", F.col("source").alias("from_source")), "rank"))
    columns = docs.columns
    keyed = docs.withColumn("__tie", F.xxhash64(whole_text(text_column)))
    # the text is the same in all of them; JSON orders columns of any type
    rest = F.to_json(F.struct(*[F.col(c) for c in columns if c != text_column]))
    one = keyed.groupBy(F.col(id_column).alias("__id"), F.col(source_column).alias("__from"),
                        "__tie").agg(
        F.min_by(F.struct(*[F.col(c) for c in columns]), rest).alias("__row"))
    rows = (took.join(one, took["id"].eqNullSafe(one["__id"]) & (took["tie"] == one["__tie"])
                      & took["from_source"].eqNullSafe(one["__from"]))
            .select(F.col("words").alias("__words"),
                    *[F.col("__row").getField(c).alias(c) for c in columns]))
    part = r"[\x20\x09-\x0D]*" + NON_SPACE
    text = F.col(text_column)
    cut_text = F.when(F.regexp_count(text, F.lit(NON_SPACE)) <= F.col("__words"), text).otherwise(
        F.array_join(F.slice(F.regexp_extract_all(text, F.lit(part), 0), 1,
                             F.col("__words").cast("int")), ""))
    rows = rows.withColumn(text_column, cut_text).drop("__words")
    if chars_column in columns:
        rows = rows.withColumn(chars_column, F.length(text_column).cast(
            docs.schema[chars_column].dataType))
    return rows.select(*columns)
