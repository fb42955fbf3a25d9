"""Token ids packed into rows of fixed length by best-fit-decreasing."""

from __future__ import annotations

import base64
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import pieces_of, small_batches, whole_text

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern of the public vocabulary.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SEQUENCE = 2048
SHARD_BYTES = 8 << 20
ROW_BYTES = 64  # what holding a row's pieces takes, however short its text
_APART = 1_000_003  # between the shards of copies that were read in neighbouring partitions
_ENCODERS: dict[str, Encoder] = {}


def read_ranks(spark, path: str) -> dict[bytes, int]:
    """A vocabulary file of one token (base64) and rank a line; its size doesn't grow."""
    lines = spark.read.text(path).collect() if "://" in path else [(x,) for x in open(path)]
    return {base64.b64decode(t): int(i) for t, i in (r[0].split() for r in lines if r[0].strip())}


class Encoder:
    """Ids of a text as 16-bit little-endian bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken
        self.core = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks,
                                      special_tokens={})

    def encode(self, text: str) -> bytes:
        return np.array(self.core.encode_ordinary(text), np.uint16).tobytes()


class CapacityTree:
    """Segment tree over remaining capacities: the smallest one that still fits."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, change: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += change
            node >>= 1

    def smallest_from(self, size: int) -> int:
        """The smallest capacity >= size that a row has, or -1."""
        count, node = self.count, size + self.leaves
        if count[node]:
            return size
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``sizes`` by row: longest first, each into the fullest row it fits."""
    tree, rows, open_rows = CapacityTree(capacity), [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        left = tree.smallest_from(size)
        if left < 0:
            row, left = len(rows), capacity
            rows.append([])
        else:
            row = open_rows[left].pop()
            tree.add(left, -1)
        rows[row].append(i)
        if left > size:
            open_rows.setdefault(left - size, []).append(row)
            tree.add(left - size, 1)
    return rows


PIECES = "shard int, doc_id {kind}, piece int, tie long, ids binary"
ROWS = ("shard int, row int, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, "
        "position_resets array<int>, doc_ids array<{kind}>, pieces array<int>")


def token_pieces(docs: DataFrame, ranks: dict[bytes, int], sequence: int, shards: int,
                 id_column: str, text_column: str) -> DataFrame:
    """Pieces of at most ``sequence`` ids of every document, dealt to shards one by one."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(ranks)
    mark = uuid.uuid4().hex
    rows = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"),
                       F.xxhash64(id_column, text_column).alias("tie"),
                       F.spark_partition_id().alias("part"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    step = 2 * sequence

    def run(batches):
        encoder = _ENCODERS.get(mark)
        if encoder is None:  # one for all tasks of a worker
            _ENCODERS.clear()
            encoder = _ENCODERS[mark] = Encoder(shared.value)
        for batch in (x for whole in batches for x in pieces_of(whole, 1)):
            out: list[list] = [[], [], [], [], []]
            rows = zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))
            for i, (text, tie, part) in enumerate(rows):
                ids = encoder.encode(text)
                first = tie % (1 << 40) + part * _APART
                for piece, at in enumerate(range(0, len(ids), step)):
                    for column, value in zip(out, ((first + piece) % shards, i, piece, tie,
                                                   ids[at:at + step])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), batch.column(0).take(pa.array(out[1], pa.int64())),
                 pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64()),
                 pa.array(out[4], pa.binary())],
                names=["shard", "doc_id", "piece", "tie", "ids"])

    return rows.mapInArrow(run, PIECES.format(kind=kind))


def pack(docs: DataFrame, sequence: int = SEQUENCE, tokenizer: str = TOKENIZER,
         pad_id: int = 50256, shard_bytes: int = SHARD_BYTES, id_column: str = "doc_id",
         text_column: str = "text") -> DataFrame:
    """Packed rows of ``sequence`` ids each.

    shard, row (together they name a packed row), n_tokens (without padding), n_segments,
    ids (``sequence`` 16-bit little-endian ids, padded with ``pad_id``), cu_seqlens (0 and
    the end of every segment), position_resets (where positions start again at 0), doc_ids
    and pieces (of every segment; the pieces 0, 1, ... of a document in order are all its
    ids). Null and empty texts have no ids and are in no row; repeated rows are packed as
    often as they occur, a null id stays null; other columns are not looked at; an empty
    table gives no rows.

    Pieces are dealt to shards by a hash of their row's id and text, their place in it and
    the partition it was read in (which a retried task finds again), so neither a long
    document nor many copies fill a shard, rows that repeat both id and text included. A task holds one shard (about
    ``shard_bytes`` of text, each row that has any counting ``ROW_BYTES`` more, so that many
    short texts don't fill one either) and packs it by best-fit-decreasing.
    """
    length = F.octet_length(text_column).cast("long")
    size = docs.agg(F.sum(F.when(length > 0, length + F.lit(ROW_BYTES)))).first()[0] or 0
    shards = max(1, math.ceil(size / shard_bytes))
    spark = docs.sparkSession
    ranks = read_ranks(spark, tokenizer)
    if max(ranks.values(), default=0) > 65535 or pad_id > 65535:
        raise ValueError("rows hold 16-bit ids")
    pieces = token_pieces(docs, ranks, sequence, shards, id_column, text_column)
    kind = pieces.schema["doc_id"].dataType.simpleString()
    names = [f.split()[0] for f in ROWS.format(kind="x").split(", ")]

    def rows_of(shard, held):
        """One record batch with the packed rows of a shard."""
        table = pa.Table.from_batches(held).sort_by(
            [("tie", "ascending"), ("piece", "ascending")]).combine_chunks()
        ids, numbers = table.column("ids").to_pylist(), table.column("piece").to_pylist()
        packed = best_fit_decreasing([len(x) // 2 for x in ids], sequence)
        order = [i for row in packed for i in row]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in packed])]).astype(np.int32)
        ends = [np.cumsum([0, *[len(ids[i]) // 2 for i in r]]).tolist() for r in packed]
        pad = np.uint16(pad_id).tobytes()
        matrix = [b"".join([ids[i] for i in r]) + pad * (sequence - e[-1])
                  for r, e in zip(packed, ends)]
        doc_ids = table.column("doc_id").take(pa.array(order, pa.int64()))
        doc_ids = doc_ids.combine_chunks() if isinstance(doc_ids, pa.ChunkedArray) else doc_ids
        return pa.RecordBatch.from_arrays(
            [pa.array([shard] * len(packed), pa.int32()),
             pa.array(range(len(packed)), pa.int32()),
             pa.array([e[-1] for e in ends], pa.int32()),
             pa.array([len(r) for r in packed], pa.int32()),
             pa.array(matrix, pa.binary()), pa.array(ends, pa.list_(pa.int32())),
             pa.array([e[:-1] for e in ends], pa.list_(pa.int32())),
             pa.ListArray.from_arrays(pa.array(offsets), doc_ids),
             pa.array([[numbers[i] for i in r] for r in packed], pa.list_(pa.int32()))],
            names=names)

    def run(batches):
        held, current = [], None
        for batch in batches:
            shard_of = batch.column(0).to_numpy()
            cuts = np.flatnonzero(shard_of[1:] != shard_of[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(shard_of)]):
                if hi == lo:
                    continue
                if held and shard_of[lo] != current:
                    yield rows_of(current, held)
                    held = []
                current = int(shard_of[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield rows_of(current, held)

    return (pieces.repartition(min(shards, 1 << 16) if shards > 1 else 1, "shard")
            .sortWithinPartitions("shard").mapInArrow(run, ROWS.format(kind=kind)))


def position_ids(cu_seqlens: Column) -> Column:
    """Positions within segments, for every id of a row that is no padding."""
    return F.flatten(F.transform(
        F.slice(cu_seqlens, 2, F.greatest(F.size(cu_seqlens) - 1, F.lit(0))),
        lambda end, i: F.sequence(F.lit(0), end - F.get(cu_seqlens, i) - 1)))


def write_matrix(packed: DataFrame, folder: str) -> None:
    """The packed rows as files: fixed-size id rows with lengths and resets beside them."""
    packed.write.parquet(folder)
