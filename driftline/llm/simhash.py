"""SimHash near-duplicates: fingerprints linked through pivot distance tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import cut, per_text, with_answer
from driftline.llm.components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Reference fingerprints; the first is 0, so its distances are the numbers of set bits.
PIVOTS = 24
BLOCKS, PARTS = 4, 4
_SPLIT_ABOVE = 4096


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints from a fixed rule: 0, then hashes of 1, 2, ..."""
    return np.array([0, *[xxhash.xxh64_intdigest(str(i), SEED) for i in range(1, count)]], np.uint64)


def fingerprint(data: bytes | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles, repeats included."""
    words = data.lower().split() if data else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    of, seed = xxhash.xxh64_intdigest, SEED
    if len(words) <= size:
        hashes = [of(joined, seed)]
    else:
        starts = [0, *[e + 1 for e in ends]]
        hashes = [of(joined[s:e], seed) for s, e in zip(starts, ends[size - 1:])]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of some hashes: a bit is 1 if it is set in over half of them."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
    counts = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def signed(value: int) -> int:
    """A fingerprint as a signed long."""
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 size: int = SHINGLE) -> DataFrame:
    """id and ``fp`` (the fingerprint as a signed long) of every row."""
    return per_text(docs, id_column, text_column, _signed_fingerprint(size), {"fp": "long"})


def _signed_fingerprint(size: int):
    return lambda: lambda data: (signed(fingerprint(data, size)),)


def within(values: np.ndarray, most: int, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join every value of ``values`` to all others in reach, by chains.

    The pivot table holds each value's distance to every reference. Two values within
    ``most`` bits differ by ``most`` at the highest in every column: sorted by the first
    column, a value meets only those in a band, and of these only those pass whose largest
    column difference is small enough. What passes is verified bit by bit. Only pairs that
    join two groups not joined yet are returned, so there are fewer pairs than values.
    """
    table = np.bitwise_count(values[:, None] ^ references[None, :]).astype(np.int8)
    order = np.lexsort((values, table[:, 0]))
    table, values = np.ascontiguousarray(table[order]), values[order]
    first = table[:, 0].astype(np.int64)
    upto = np.searchsorted(first, first + most, "right")
    parent = np.arange(len(values))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    left, right = [], []
    for i in range(len(values) - 1):
        lo, hi = i + 1, int(upto[i])
        if hi <= lo:
            continue
        near = np.flatnonzero(np.abs(table[lo:hi, 1:] - table[i, 1:]).max(axis=1, initial=0) <= most) + lo
        if not len(near):
            continue
        near = near[np.bitwise_count(values[near] ^ values[i]) <= most]
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                left.append(i)
                right.append(j)
    return order[left] if left else np.zeros(0, np.int64), order[right] if right else np.zeros(0, np.int64)


def joined_in_cell(values: np.ndarray, free: tuple[tuple[int, int], ...], most: int,
                   references: np.ndarray):
    """Pairs (values) that join a cell's values; a crowded cell is split by its free bits.

    ``free`` are the bit ranges (shift, width) that the cell doesn't fix. With one range
    more than bits may differ, two values in reach agree in one of them at least.
    """
    if len(values) <= _SPLIT_ABOVE or len(free) <= most:
        a, b = within(values, most, references)
        yield values[a], values[b]
        return
    for k, (shift, width) in enumerate(free[:most + 1]):
        part = (values >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        rest = (*free[:k], *free[k + 1:])
        for rows in np.split(order, cuts):
            if len(rows) > 1:
                yield from joined_in_cell(values[rows], rest, most, references)


def _cells(known: DataFrame, *others: str) -> DataFrame:
    """Sixteen cells for each fingerprint (and ``others``): 16 bits of a block and 12 bits of the rest.

    Of four blocks, one is equal in two fingerprints that differ in three bits at most; of
    four parts of the other 48 bits, again one is. Equal blocks have equal distances to
    every reference, so a cell holds all links of the pivot columns it stands for.
    """
    fp, keys = F.col("fp"), []
    for block in range(BLOCKS):
        low = 16 * block
        value = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit(0xFFFF))
        # the 48 other bits, without a gap
        above = F.shiftrightunsigned(fp, low + 16) if block < 3 else F.lit(0).cast("long")
        below = fp.bitwiseAND(F.lit((1 << low) - 1))
        rest = F.shiftleft(above, low).bitwiseOR(below)
        for part in range(PARTS):
            piece = F.shiftrightunsigned(rest, 12 * part).bitwiseAND(F.lit(0xFFF))
            keys.append(F.shiftleft(value, 16).bitwiseOR(F.shiftleft(piece, 4))
                        .bitwiseOR(F.lit(4 * block + part)))
    return known.select(F.explode(F.array(*keys)).alias("cell"), "fp", *others)


def free_bits(cell: int) -> tuple[tuple[int, int], ...]:
    """The bit ranges (shift, width) of a fingerprint that the cell doesn't fix, in nine parts or so."""
    block, part = (cell & 15) // 4, cell & 3
    places = [i for i in range(64) if not 16 * block <= i < 16 * block + 16]
    places = places[:12 * part] + places[12 * part + 12:]
    ranges, start = [], None
    for i, place in enumerate(places):
        if start is None:
            start = place
        if i + 1 == len(places) or places[i + 1] != place + 1 or place - start + 1 == 9:
            ranges.append((start, place - start + 1))
            start = None
    return tuple(sorted(ranges, key=lambda r: -r[1]))


def links(known: DataFrame, most: int = MAX_BITS, of: str = "fp") -> DataFrame:
    """Edges (a, b) between different fingerprints of ``known`` (fp) in reach, enough to chain them all.

    With another column in ``of`` the edges are between its values (longs) instead, and
    different values of one fingerprint are chained as well.
    """
    if most > 3:
        raise ValueError("cells are complete for three differing bits at most")
    references = pivots()

    def run(batches):
        def edge_rows(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        def edges(cell, parts):
            values, nodes = (np.concatenate(x) for x in zip(*parts))
            values, first, at = np.unique(values.view(np.uint64), return_index=True, return_inverse=True)
            stands = nodes[first]
            other = nodes != stands[at]
            if cell & 15 == 0 and other.any():  # the other cells of a fingerprint hold the same
                yield edge_rows(stands[at[other]], nodes[other])
            for a, b in joined_in_cell(values, free_bits(cell), most, references):
                yield edge_rows(stands[np.searchsorted(values, a)], stands[np.searchsorted(values, b)])

        def many(cells, values, nodes):
            """Cells that begin and end in a batch; those of two values need no table."""
            starts = np.flatnonzero(np.diff(cells, prepend=cells[0] - 1))
            sizes = np.diff(np.append(starts, len(cells)))
            two = starts[sizes == 2]
            a, b = values[two].view(np.uint64), values[two + 1].view(np.uint64)
            near = (np.bitwise_count(a ^ b) <= most) & (nodes[two] != nodes[two + 1])
            if near.any():
                yield edge_rows(nodes[two[near]], nodes[two[near] + 1])
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                yield from edges(int(cells[s]), [(values[s:s + n], nodes[s:s + n])])

        held, current = [], None
        for batch in batches:
            # without a column of their own the fingerprints are the nodes
            cells, values, nodes = (batch.column(k).to_numpy() for k in (0, 1, batch.num_columns - 1))
            if not len(cells):
                continue
            lo = 0
            if current is not None:
                lo = int(np.searchsorted(cells, current, "right"))
                held.append((values[:lo], nodes[:lo]))
            if lo < len(cells):
                if current is not None:
                    yield from edges(current, held)
                last = int(np.searchsorted(cells, cells[-1], "left"))
                if last > lo:
                    yield from many(cells[lo:last], values[lo:last], nodes[lo:last])
                last = max(last, lo)
                current, held = int(cells[-1]), [(values[last:], nodes[last:])]
        if current is not None:
            yield from edges(current, held)

    return (_cells(known, *[of] * (of != "fp")).repartition("cell").sortWithinPartitions("cell")
            .mapInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    size: int = SHINGLE, most: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    Words are runs without ASCII white space, A-Z in lower case; shingles are ``size``
    words, repeats included; fewer words make one shingle, none (null or empty texts) the
    fingerprint zero, which links like any other. Fingerprints that differ in ``most`` bits
    at most are linked; component_id is the smallest id that links lead to. A null id is
    never the smallest; a component of null ids has none. Rows with equal ids are separate
    rows. An empty table gives an empty result.

    Ids and fingerprints are cut once. Links are sought between different fingerprints
    only, so copies cost nothing, and a cell gives fewer links than it has fingerprints.
    Pivot distances alone would leave a share of all pairs (one column passes 46 % of
    random pairs), so fingerprints first meet in cells that no link is lost by; inside a
    cell, pivot tables discard pairs and what passes is verified.
    """
    rows = cut(fingerprints(docs, id_column, text_column, size)
               .withColumnRenamed(id_column, "__id"))
    known = rows.groupBy("fp").agg(F.min("__id").alias("least"))
    found = components(links(known.select("fp"), most))
    told = known.join(found, known["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    per_root = told.groupBy("root").agg(F.min("least").alias("component_id"))
    per_fp = told.join(per_root, "root").select("fp", "root", "component_id")
    return rows.join(per_fp, "fp").select(
        F.col("__id").alias(id_column), _hex("fp").alias("fingerprint"), "component_id",
        _hex("root").alias("root"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one of each component does.

    It is the row with the smallest id. Rows that share an id are one document: the one
    with the least text hash stands for it, and of a component without ids the one with
    the least text hash stays.
    """
    groups, columns = near_duplicates(docs, id_column, text_column), docs.columns
    tie = F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))

    def one(rows, key):
        return rows.groupBy(key).agg(F.min_by(F.struct(*columns), tie).alias("__row")).select(
            *[F.col("__row").getField(c).alias(c) for c in columns])

    keep = groups.where("component_id is not null").select(
        F.col("component_id").alias("__keep")).distinct()
    named = one(docs.join(keep, docs[id_column] == keep["__keep"], "left_semi")
                .withColumn("__group", F.col(id_column)), "__group")
    bare = groups.where("component_id is null").select(
        F.conv("fingerprint", 16, -10).cast("long").alias("__fp"), F.col("root").alias("__group")
    ).distinct()
    without = with_answer(docs.where(F.col(id_column).isNull()), "__found", text_column,
                          _signed_fingerprint(SHINGLE), {"fp": "long"})
    without = without.withColumn("__fp", F.col("__found.fp")).join(bare, "__fp")
    return named.unionByName(one(without, "__group"))


def _hex(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
