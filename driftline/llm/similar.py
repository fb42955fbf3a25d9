"""Near-duplicates by the Jaccard similarity of word shingles; no pair in reach is missed.

1. A text is the set of its five-word shingles, as 64-bit hashes; equal sets are one set.
2. A set has a SimHash fingerprint. Fingerprints that differ in three bits at most meet in
   op5's cells, through its pivot distance tables, and are chained to groups.
3. Three bits don't reach down to a similarity of 0.8, so the pairs that they leave come by an
   exact way. Shingles have one order for all texts: rare ones first, by counts in hashed
   buckets, whose number grows with the shingles. Two sets of similarity t share SHARED of their
   first n - ceil(t n) + SHARED shingles (prefix filter). Sets that share such a shingle meet
   without their texts. Few of them give all pairs whose sizes and places of the shingle allow
   t; of these pairs those stay that SHARED shingles give, as pairs that share one by chance grow
   with the square of the table. Of many sets the first one stands for a group.
4. Groups and pairs, with those of 2, are split by parity bitmaps, two to four bits a shingle:
   bitmaps differ in no more bits than their sets differ in shingles, so no pair in reach is
   parted. What is left of them is chained to new groups.
5. The sets of these come together and are compared in full: each is expanded once, against
   those not reached yet, so a group of near copies costs little.

Of a group of more than BLOCK sets no task holds the whole, in 4 or in 5: its sets are dealt
to blocks, and a few leaders of the group go to every block, so that near copies of one text
are joined through them. Sets that the leaders don't join to the most (strays) then meet
every block as well, a block of strays at a time, so that no pair in reach is missed.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm import simhash
from driftline.llm.common import cut, freed, per_text, pieces_of, small_batches, whole_text
from driftline.llm.components import components, evened

SHINGLE = 5
SEED = 42
#: Similarity from which two texts are near-duplicates: numerator and denominator.
SIMILARITY = (4, 5)
#: Sets of one shingle that are paired each with each; more form a group.
PAIRED = 12
#: Sets of a group that are compared in one place, and leaders of a larger group.
BLOCK, LEADERS = 512, 8
#: Shingles of their prefixes that two sets of few have to share. Different sets in reach share
#: four shingles at least (4 of 5), so up to four loses none.
SHARED = 3
#: Least and most buckets of the shingle counts, and shingles for each between; any number of
#: buckets gives the same result, but with too many shingles in each the order is no longer by rarity.
BUCKETS, MOST_BUCKETS, LOAD = 1 << 20, 1 << 24, 32
#: Least and most bits that tell the wanted keys, and bits for each key between.
BITS, MOST_BITS, KEY_BITS = 1 << 20, 1 << 26, 16
#: Tasks that merge counts of the least number of buckets, or bits.
MERGERS = 8
_CHUNK = 1 << 14
_ROWS = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different word shingles; fewer words than ``size`` make one."""
    words = data.lower().split() if data else []
    if not words:
        return np.zeros(0, np.uint64)
    of = xxhash.xxh64_intdigest
    hashes = np.fromiter((of(w, SEED) for w in words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        out = (out + hashes[k:k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def key_of(found: np.ndarray) -> int:
    """A set's key, as a signed long."""
    value = xxhash.xxh64_intdigest(found.tobytes(), SEED)
    return value - (1 << 64) if value >> 63 else value


def _key():
    """Key, SimHash fingerprint and size of a text's set; one without shingles has no fingerprint."""
    def of(data):
        found = shingles(data)
        return key_of(found), simhash.signed(simhash.majority(found)) if len(found) else None, len(found)
    return of


def _sets(batches):
    """Key and shingles of each different text set of a task, texts in the first column."""
    seen = set()
    for batch in (x for whole in batches for x in pieces_of(whole, 0)):
        for data in batch.column(0).to_pylist():
            found = shingles(data)
            key = key_of(found)
            if key not in seen:
                seen.add(key)
                yield key, found


def power_for(n: int, least: int, most: int) -> int:
    """The first power of two from ``n`` on, between two others."""
    return min(most, max(least, 1 << max(0, n - 1).bit_length()))


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values * _MIX) >> np.uint64(40)).astype(np.int64) % buckets


def bucket_counts(rows: DataFrame, values_of, buckets: int = BUCKETS) -> np.ndarray:
    """How many of the values that ``values_of`` makes of a task's batches fall in each bucket.

    A task counts up to 255 for each bucket, and the result goes up to 65,535.
    """
    def count(batches):
        counts = np.zeros(buckets, np.uint8)
        for values in values_of(batches):
            at, more = np.unique(bucket_of(values, buckets), return_counts=True)
            counts[at] = np.minimum(counts[at] + more, 255)
        used = [(i, c) for i, c in enumerate(counts.reshape(-1, _CHUNK)) if c.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in used], pa.int32()),
             pa.array([zlib.compress(c.tobytes(), 1) for _, c in used], pa.binary())],
            names=["chunk", "counts"])

    def add(batches):
        total = {}
        for batch in batches:
            for i, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if i not in total:
                    total[i] = np.zeros(_CHUNK, np.uint32)
                total[i] += np.frombuffer(zlib.decompress(blob), np.uint8)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()),
             pa.array([zlib.compress(np.minimum(c, 65535).astype(np.uint16).tobytes(), 1)
                       for c in total.values()], pa.binary())], names=["chunk", "counts"])

    shape = "chunk int, counts binary"
    out = np.zeros((buckets // _CHUNK, _CHUNK), np.uint16)
    # 64 chunks need no more tasks than that, however many partitions an exchange has
    mergers = max(1, MERGERS * buckets // BUCKETS)
    merged = rows.mapInArrow(count, shape).repartition("chunk").coalesce(mergers).mapInArrow(add, shape)
    for i, blob in freed(merged).collect():
        out[i] = np.frombuffer(zlib.decompress(bytes(blob)), np.uint16)
    return out.reshape(-1)


def key_bits(members: DataFrame) -> np.ndarray:
    """Bits, a power of two of them: one is set where a key of ``members`` falls in it."""
    bits = power_for(KEY_BITS * members.count(), BITS, MOST_BITS)
    at, word = F.pmod("key", F.lit(bits)), 8 * 4096  # bits of one of Spark's bitmaps
    found = members.groupBy(F.floor(at / word).alias("chunk")).agg(
        F.bitmap_construct_agg(F.pmod("key", F.lit(word))).alias("bits"))
    out = np.zeros((bits // word, word // 8), np.uint8)
    for i, part in freed(found.coalesce(MERGERS)).collect():
        out[i] = np.frombuffer(bytes(part), np.uint8)
    return out.reshape(-1)


def prefix(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, of which any other set in reach has SHARED among its own.

    Two sets in reach share ceil(t n) shingles at least. So the m-th that they share, in the
    order of all, has as many less m behind it, and is no later than n - ceil(t n) + m.
    """
    up, down = SIMILARITY
    order = np.lexsort((found, counts[bucket_of(found, len(counts))]))
    return found[order[:len(found) + (-up * len(found)) // down + SHARED]]


def in_reach(shared, size_a, size_b):
    """Whether sets of two sizes with so many shared shingles are near-duplicates."""
    up, down = SIMILARITY
    return (up + down) * shared >= up * (size_a + size_b)


def bitmap(found: np.ndarray) -> bytes:
    """Parity of the shingles in each of at least twice as many cells, a power of two."""
    width = 64
    while width < 2 * len(found):
        width *= 2
    cells = np.bincount((found % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").tobytes()


def parted(keys: list[int], sizes: list[int], bitmaps: list[bytes]) -> list[list[int]]:
    """The keys in lists, so that sets in reach are in one list; those without company go."""
    up, down = SIMILARITY
    order = sorted(range(len(keys)), key=lambda i: (sizes[i], keys[i]))
    lists, left = [], order
    matrices: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    size_of = np.array(sizes)
    for width in {len(b) for b in bitmaps}:
        rows = np.array([i for i in order if len(bitmaps[i]) == width])
        matrices[width] = rows, np.frombuffer(b"".join(bitmaps[i] for i in rows), np.uint64).reshape(
            len(rows), -1)

    def folded(block):
        half = block.shape[1] // 2
        return block[:, :half] ^ block[:, half:]

    reached = np.zeros(len(keys), bool)
    for first in left:
        if reached[first]:
            continue
        reached[first] = True
        queue, members = [first], [first]
        while queue:
            i = queue.pop()
            own = np.frombuffer(bitmaps[i], np.uint64)[None]
            n, width = sizes[i], len(bitmaps[i])
            for w in (width // 2, width, 2 * width):
                if w not in matrices:
                    continue
                rows, block = matrices[w]
                here = size_of[rows]
                lo = np.searchsorted(here * down, up * n, "left")
                hi = np.searchsorted(here * up, down * n, "right")
                at = np.flatnonzero(~reached[rows[lo:hi]]) + lo
                if not len(at):
                    continue
                part, mine = block[at], own
                if w < width:
                    mine = folded(own)
                elif w > width:
                    part = folded(part)
                apart = np.bitwise_count(part ^ mine).sum(axis=1, dtype=np.int64)
                near = rows[at[(up + down) * apart <= (down - up) * (n + here[at])]].tolist()
                reached[near] = True
                queue += near
                members += near
        if len(members) > 1:
            lists.append([keys[i] for i in members])
    return lists


def chained(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Index pairs in reach that join every set to all others in reach, by chains."""
    sizes = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    left, owner = np.arange(len(sets)), np.repeat(np.arange(len(sets)), sizes)
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    pairs = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        keep = owner != queue[0]
        flat, owner = flat[keep], owner[keep]
        while queue and len(left):
            i = queue.pop()
            mine = np.zeros(len(values), bool)
            mine[parts[i]] = True
            shared = np.bincount(owner[mine[flat]], minlength=len(sets))[left]
            near = in_reach(shared, sizes[i], sizes[left])
            if near.any():
                pairs += [(i, j) for j in left[near].tolist()]
                queue += left[near].tolist()
                gone = np.zeros(len(sets), bool)
                gone[left[near]] = True
                left, keep = left[~near], ~gone[owner]
                flat, owner = flat[keep], owner[keep]
    return pairs


def whole_groups(batches):
    """Lists of sorted batches in which no value of the first column is cut."""
    held, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        first = batch.column(0).to_numpy()
        if held and first[-1] == current:
            held.append(batch)
            continue
        at = int(np.searchsorted(first, first[-1], "left"))
        if held or at:
            yield [*held, batch.slice(0, at)]
        held, current = [batch.slice(at)], first[-1]
    if held:
        yield held


def _cuts(first: np.ndarray):
    starts = np.flatnonzero(np.diff(first)) + 1
    return np.concatenate([[0], starts]), np.append(starts, len(first))


def _pairs(token: np.ndarray, key: np.ndarray, place: np.ndarray):
    """Edges (a, b, many) of whole tokens: a token's first set with all of many, or pairs that may be.

    A pair comes once for each token. Of the first SHARED tokens that a pair in reach shares,
    the shingles from a token on and those shared before it are enough.
    """
    up, down = SIMILARITY
    order = np.lexsort((key, token))
    token, key, place = token[order], key[order], place[order]
    one = np.append(True, (token[1:] != token[:-1]) | (key[1:] != key[:-1]))
    token, key, place = token[one], key[one], place[one]
    lo, hi = _cuts(token)
    sizes = hi - lo
    crowd = np.repeat(sizes > PAIRED, sizes)
    first = np.repeat(lo, sizes)
    other = crowd & (first != np.arange(len(token)))
    out = [(key[first[other]], key[other], True)]
    n, rest = place & 0xFFFFFFFF, (place & 0xFFFFFFFF) - (place >> 32)
    for step in range(1, min(PAIRED, int(sizes.max(initial=0)))):
        i = np.flatnonzero(~crowd[:-step] & (first[:-step] == first[step:]))
        j = i + step
        fits = ((down * np.minimum(n[i], n[j]) >= up * np.maximum(n[i], n[j]))
                & in_reach(np.minimum(rest[i], rest[j]) + SHARED - 1, n[i], n[j]))
        out.append((key[i[fits]], key[j[fits]], False))
    a, b = (np.concatenate([x[k] for x in out]) for k in range(2))
    return a, b, np.repeat([x[2] for x in out], [len(x[0]) for x in out])


def _met(batches):
    """(a, b, many) from (token, key, place) sorted by token: sets that share a token of their prefixes.

    A place is the token's number in its set's order above the set's size. A pair of few sets
    comes once for each token that they share. Of a token that goes on from batch to batch a
    few rows are held: its first set stands for all that follow.
    """
    current, first = None, None  # of a token of many that goes on: its first set

    def rows_of(held):
        return [np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3)]

    def going_on():
        """The rows, some _ROWS at a time, and whether they are the last."""
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= _ROWS:
                yield rows_of(held), False
                held, size = [], 0
        if held:
            yield rows_of(held), True

    kept = None
    for (token, key, place), last in going_on():
        if first is not None:
            at = int(np.searchsorted(token, current, "right"))
            more = np.unique(key[:at])
            more = more[more != first]
            yield _edges(np.full(len(more), first), more, np.ones(len(more), bool))
            token, key, place = token[at:], key[at:], place[at:]
            if not len(token):
                continue
            first = None
        if kept is not None:
            token, key, place = (np.concatenate(x) for x in zip(kept, (token, key, place)))
            kept = None
        if not last:
            at = int(np.searchsorted(token, token[-1], "left"))
            keys, rows = np.unique(key[at:], return_index=True)
            if len(keys) > PAIRED:
                current, first = token[-1], keys[0]
            else:
                kept = token[at:][rows], key[at:][rows], place[at:][rows]
                token, key, place = token[:at], key[:at], place[:at]
        if len(token):
            yield _edges(*_pairs(token, key, place))
    if kept is not None:
        yield _edges(*_pairs(*kept))


def _edges(a: np.ndarray, b: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                       pa.array(many, pa.bool_())], names=["a", "b", "many"])


def _compared(batches):
    """Edges (a, b) in reach from rows (group, key, set) sorted by group."""
    for held in whole_groups(batches):
        rows = [r for b in held for r in zip(*(c.to_pylist() for c in b.columns))]
        lo, hi = _cuts(np.array([r[0] for r in rows], np.int64))
        out = []
        for s, e in zip(lo.tolist(), hi.tolist()):
            sets = {k: np.frombuffer(x, np.uint64) for _, k, x in rows[s:e]}
            keys = list(sets)
            if len(keys) > 1:
                out += [(keys[i], keys[j]) for i, j in chained(list(sets.values()))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])


def _reached(batches):
    """Edges (a, b) that join the parts of groups, from rows (group, key, size, bitmap) sorted by group."""
    for held in whole_groups(batches):
        rows = [r for b in held for r in zip(*(c.to_pylist() for c in b.columns))]
        lo, hi = _cuts(np.array([r[0] for r in rows], np.int64))
        out = []
        for s, e in zip(lo.tolist(), hi.tolist()):
            of = {r[1]: r for r in rows[s:e]}
            _, keys, sizes, bitmaps = map(list, zip(*of.values()))
            out += [(part[0], k) for part in parted(keys, sizes, bitmaps) for k in part[1:]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])


def _told(texts: DataFrame, members: DataFrame, fields: str, answer) -> DataFrame:
    """``key`` and ``answer`` of the sets that ``members`` name, and maybe of some others."""
    wanted = texts.sparkSession.sparkContext.broadcast(key_bits(members))

    def of(batches):
        some = wanted.value
        for key, found in _sets(batches):
            at = key % (8 * len(some))
            if some[at >> 3] >> (at & 7) & 1:
                yield pa.RecordBatch.from_pydict({"key": [key], **answer(found)})

    return texts.mapInArrow(of, f"key long, {fields}")


def _of_members(told: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (group, key) with what is told of each key, sorted by group in partitions."""
    names = [c for c in told.columns if c != "key"]
    return (members.join(told, "key").select("group", "key", *names)
            .repartition("group").sortWithinPartitions("group"))


def _blocks(members: DataFrame) -> DataFrame | None:
    """of and blocks of every group with more than BLOCK members; None without any."""
    large = cut(members.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
                .select(F.col("group").alias("of"), F.ceil(F.col("n") / BLOCK).alias("blocks")))
    return None if large.isEmpty() else large


def _numbers(upto: str):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(upto) - 1))


def _in_blocks(told: DataFrame, members: DataFrame, large: DataFrame, compare) -> DataFrame:
    """Edges (a, b) of the members of large groups, as ``compare`` gives them for whole groups."""
    def edges(rows):
        return cut(_of_members(told, rows).mapInArrow(compare, "a long, b long"))

    dealt = cut(members.join(large, F.col("group") == F.col("of")).withColumn(
        "block", F.pmod(F.xxhash64("key"), F.col("blocks"))).drop("of"))
    leaders = (dealt.groupBy("group", "blocks", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(LEADERS)))
               .agg(F.min("key").alias("key")).select("group", "key", _numbers("blocks").alias("block")))
    label = F.xxhash64("group", "block").alias("group")
    first = edges(dealt.select(label, "key").unionByName(leaders.select(label, "key")))

    found = components(first)
    rooted = dealt.join(found, F.col("key") == F.col("node"), "left").select(
        "group", "blocks", "key", F.coalesce("root", "key").alias("root"))
    most = (rooted.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("group")
            .agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n")))
    most = most.where("most.n < n").select(F.col("group").alias("of"), F.col("most.root").alias("main"),
                                           F.ceil((F.col("n") - F.col("most.n")) / BLOCK).alias("parts"))
    most = cut(most)
    if most.isEmpty():
        return first
    strays = rooted.join(most, F.col("group") == F.col("of")).where("root <> main").select(
        "group", "key", F.pmod(F.xxhash64("key", F.lit(2)), F.col("parts")).alias("part"),
        _numbers("blocks").alias("block"))
    others = dealt.join(most, F.col("group") == F.col("of")).select(
        "group", "key", "block", _numbers("parts").alias("part"))
    label = F.xxhash64("group", "block", "part").alias("group")
    return first.unionByName(edges(strays.select(label, "key").unionByName(others.select(label, "key"))))


def links(docs: DataFrame, prints: DataFrame, text_column: str = "text") -> DataFrame:
    """Edges (a, b) between keys of different sets in reach, enough to chain them all.

    ``prints`` has the key, fp and size of every set of ``docs`` that has shingles, once or more.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(whole_text(text_column).cast("binary").alias("text"))
    context = docs.sparkSession.sparkContext
    total = prints.agg(F.sum("size")).first()[0] or 0
    common = context.broadcast(bucket_counts(texts, lambda batches: (s for _, s in _sets(batches)),
                                             power_for(total // LOAD, BUCKETS, MOST_BUCKETS)))

    def tokens(batches):
        counts = common.value
        for key, found in _sets(batches):
            first = prefix(found, counts)
            if len(first):
                n = len(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first.view(np.int64)), pa.array(np.full(n, key, np.int64)),
                     pa.array((np.arange(n) << 32) + len(found))], names=["token", "key", "place"])

    met = cut(texts.mapInArrow(tokens, "token long, key long, place long")
              .repartition("token").sortWithinPartitions("token")
              .mapInArrow(_met, "a long, b long, many boolean")
              .groupBy("a", "b").agg(F.max("many").alias("many"), F.count(F.lit(1)).alias("shared"))
              .where(F.col("many") | (F.col("shared") >= SHARED)).select("a", "b", "many"))
    near = simhash.links(prints.select("key", "fp").distinct(), of="key")
    # A group is the sets that a first one stands for, and not all that such groups lead to:
    # tokens that sets share by chance would lead from everywhere to everywhere.
    many = met.where("many").select(F.col("a").alias("group"), F.explode(F.array("a", "b")).alias("key"))
    pair = met.where("not many").select("a", "b").unionByName(
        near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    members = cut(evened(many.unionByName(pair.select(
        F.xxhash64("a", "b").alias("group"), F.explode(F.array("a", "b")).alias("key"))).distinct()))

    def compared(members, fields, answer, compare):
        """Edges (a, b) of the members of all groups, by what is told of their sets."""
        large, told = _blocks(members), _told(texts, members, fields, answer)
        if large is None:
            return _of_members(told, members).mapInArrow(compare, "a long, b long")
        told, in_large = cut(told), F.col("group") == F.col("of")
        rest = _of_members(told, members.join(large, in_large, "left_anti"))
        return rest.mapInArrow(compare, "a long, b long").unionByName(
            _in_blocks(told, members.join(large, in_large, "left_semi"), large, compare))

    parts = compared(members, "size long, bits binary", lambda found: {
        "size": [len(found)], "bits": [bitmap(found)]}, _reached)
    members = cut(_as_members(components(evened(parts), roots=True)))
    return compared(members, "found binary", lambda found: {"found": [found.tobytes()]}, _compared)


def _as_members(found: DataFrame) -> DataFrame:
    """Components (node, root), roots among the nodes, as groups of keys."""
    return found.select(F.col("root").alias("group"), F.col("node").alias("key"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one of each group of near-duplicates does.

    Words are runs without ASCII white space, A-Z in lower case. Texts whose sets of
    five-word shingles have a Jaccard similarity of 0.8 at least are linked, and a group is
    what links join; texts without words are one group. Of each group the row with the
    smallest id stays, of such rows one with the least text hash; a null id comes last.
    Rows that share an id are separate rows.
    """
    tie = F.xxhash64(whole_text(text_column)).alias("__tie")
    rows = per_text(docs.select(F.struct(F.col(id_column).alias("id"), tie).alias("__row"),
                                text_column), "__row", text_column, _key,
                    {"key": "long", "fp": "long", "size": "long"})
    rows = cut(rows.select("__row.id", "__row.__tie", "key", "fp", "size"))
    found = components(links(docs, rows.where("fp is not null"), text_column))
    best = rows.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("bare"), "id", "__tie"))
                                   .alias("best"))
    keep = (best.join(found, best["key"] == found["node"], "left")
            .groupBy(F.coalesce("root", "key").alias("__group")).agg(F.min("best").alias("best"))
            .select(F.col("best.id").alias("__id"), F.col("best.__tie").alias("__tie"),
                    F.lit(True).alias("__keep")))
    # rows and what stays meet in one aggregation, so that texts are exchanged once
    columns = docs.columns
    rest = F.to_json(F.struct(*[c for c in columns if c != text_column]))
    met = docs.select(F.col(id_column).alias("__id"), tie, F.struct(*columns).alias("__row"),
                      rest.alias("__rest")).unionByName(keep, allowMissingColumns=True)
    kept = met.groupBy("__id", "__tie").agg(F.min_by("__row", "__rest").alias("__row"),
                                            F.max("__keep").alias("__keep")).where("__keep")
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in columns])
