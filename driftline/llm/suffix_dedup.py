"""Repeated byte strings across documents, by a merge sort of suffix runs.

The rule: a byte is removed if it lies in a string of LENGTH bytes that also starts in a
document with a smaller id.

1. Sparse suffixes. Every string of LENGTH bytes has an *anchor*: the place of its least
   hashed GRAM (the leftmost of equals). Equal strings have equal anchors, so it is enough
   to look at suffixes that start at anchors, about one in eighteen, with what precedes.
2. Anchors whose gram stands in one document only are dropped: hashes and ids alone are
   sorted for that.
3. The other suffixes are sorted into runs, front-coded (length of the prefix shared with
   the one before, then the rest) and exchanged by the hash of their gram. A loser tree
   merges the runs of a partition; it compares shared prefix lengths first and looks at
   bytes only beyond the prefix both sides are known to share.
4. Neighbours that share at least GRAM bytes form a class. Within it, the shared prefix
   lengths tell how far two suffixes agree to the right, and a second order, by the bytes
   before the anchor read backwards, how far to the left. A string at an anchor's offset
   l is another's if they agree in l bytes to the left and LENGTH - l to the right.
5. A task sends a context (the bytes before and after an anchor) once, with the least id
   that it has read there and that id's places; the places of larger ids are answered at
   once, as they repeat the least. A gram of very many documents is cut by the offset of
   the string: a group for some offsets needs more bytes to agree than the gram, so the
   gram's suffixes part into groups by those bytes, at most as fine as one group for each
   string. All groups go through the same runs and the same merge.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import pieces_of, small_batches, whole_text

LENGTH = 50
GRAM = 16
BEFORE = LENGTH - GRAM  # bytes that an anchored string can have before its anchor
#: Documents of one gram whose suffixes may meet in one group; the gram of more is cut.
HOT_GRAM = 100_000
#: Bytes of text worked on at once in a task.
CHUNK_BYTES = 1 << 19
#: Suffixes in a sorted run, and bytes of text for each bucket that runs are dealt to.
RUN_RECORDS = 200_000
BUCKET_BYTES = 8 << 20
#: Records made at a time from a chunk.
BLOCK_RECORDS = 1 << 16
#: Below this are the numbers of texts without an id, from their hash; all rank alike.
_NO_ID = -(1 << 62)


def ranks(d: np.ndarray) -> np.ndarray:
    """What ids are compared by: texts without an id are no smaller than each other."""
    return np.maximum(d, _NO_ID - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed hashes of all GRAM-byte strings, by doubling."""
    h = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    size = 1
    while size < GRAM:
        h = h[:-size] * np.uint64(0xD6E8FEB86659FD93) + h[size:]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        size *= 2
    return h


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of texts laid end to end: text number, place, first and last string, hash.

    A text's strings p .. p + LENGTH with the same anchor are consecutive; first and last
    are the smallest and largest p. Strings that cross texts don't count.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, np.zeros(0, np.uint64)
    h = gram_hashes(data)
    width, n = BEFORE + 1, len(data) - LENGTH + 1
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(n, bool)
    for s, e in zip(starts.tolist(), ends.tolist()):
        inside[s:max(s, e - LENGTH + 1)] = True
    least, at, size = h, np.arange(len(h), dtype=np.int32), 1
    while size < width:  # windows of 1, 2, 4, ... and at last of width; the left one wins ties
        step = min(size, width - size)
        take = least[step:] < least[:-step]
        at = np.where(take, at[step:], at[:-step])
        least = np.where(take, least[step:], least[:-step])
        size += step
    p = np.flatnonzero(inside)
    if not len(p):
        return none, none, none, none, np.zeros(0, np.uint64)
    text = np.searchsorted(ends, p, "right")
    new = np.ones(len(p), bool)
    new[1:] = (at[p[1:]] != at[p[:-1]]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    place = at[p[first]]
    return text[first], place, p[first], p[last], h[place]


def chunks(batches):
    """Lists of pieces (id, tag, text, ..., base) with some CHUNK_BYTES of text each.

    A long text is cut into pieces from ``base`` on, each string of LENGTH bytes lying in
    one of them.
    """
    for batch in (x for whole in batches for x in pieces_of(whole, 2)):
        rows, size = [], 0
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            for base in range(0, max(1, len(row[2]) - LENGTH + 1), CHUNK_BYTES):
                piece = row[2][base:base + CHUNK_BYTES + LENGTH - 1]
                rows.append((*row[:2], piece, *row[3:], base))
                size += len(piece)
                if size >= CHUNK_BYTES:
                    yield rows
                    rows, size = [], 0
        if rows:
            yield rows


def laid_out(rows) -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer(b"".join([r[2] for r in rows]), np.uint8),
            np.cumsum([len(r[2]) for r in rows]))


def gram_rows(batches):
    """(h, d): the different anchor grams of every piece of text and its id."""
    for rows in chunks(batches):
        data, ends = laid_out(rows)
        text, _, _, _, h = anchors(data, ends)
        order = np.lexsort((h, text))
        text, h = text[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        ids = np.array([r[0] for r in rows], np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[new].view(np.int64)), pa.array(ids[text[new]])], names=["h", "d"])


def cuts_of(count: np.ndarray, hot_gram: int) -> np.ndarray:
    """Groups of offsets that a gram of so many rows is cut into: 1, 4, 16 or one for each."""
    out = np.ones(len(count), np.int32)
    for times, cuts in ((1, 4), (2, 16), (4, BEFORE + 1)):
        out[count > times * hot_gram] = cuts
    return out


def shared_grams(batches, hot_gram: int):
    """Rows of sorted (h, d) whose gram has two ids, with the cuts of the gram.

    Holds one gram's rows at a time, up to the number from which it is cut the most.
    """
    def out(h, d, cuts):
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(h), pa.array(cuts)],
                                          names=["d", "h", "cuts"])

    most = 4 * hot_gram
    held: list[np.ndarray] = []
    current, count = None, 0

    def close():
        if held:
            d = np.concatenate(held)
            if count > most or ranks(d).min() < ranks(d).max():
                yield out(np.full(len(d), current, np.int64), d,
                          np.full(len(d), cuts_of(np.array([count]), hot_gram)[0]))

    for batch in batches:
        h, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(h):
            continue
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.append(starts, len(h)))
        # groups that lie inside the batch
        inner = np.ones(len(starts), bool)
        inner[-1] = False
        if current is not None and h[0] == current:
            inner[0] = False
        low, high = (f.reduceat(ranks(d), starts) for f in (np.minimum, np.maximum))
        many = inner & (low < high)
        rows = np.repeat(many, sizes)
        if rows.any():
            yield out(h[rows], d[rows], np.repeat(cuts_of(sizes, hot_gram), sizes)[rows])
        for i in np.flatnonzero(~inner).tolist():
            part = d[starts[i]:starts[i] + sizes[i]]
            if h[starts[i]] != current or current is None:
                yield from close()
                held, current, count = [], int(h[starts[i]]), 0
            held.append(part)
            count += len(part)
            if count > most:
                yield from close()
                held = []
    yield from close()


def as_bytes(block: np.ndarray) -> np.ndarray:
    """Rows of a byte matrix as strings that sort by their bytes (zeros at the end don't count)."""
    return np.ascontiguousarray(block).view(f"S{block.shape[1]}")[:, 0]


def shared_prefixes(block: np.ndarray) -> np.ndarray:
    """Bytes that each row of a matrix shares with the row before."""
    out = np.zeros(len(block), np.int64)
    if len(block) > 1:
        same = block[1:] == block[:-1]
        out[1:] = np.where(same.all(axis=1), block.shape[1], same.argmin(axis=1))
    return out


def windows_at(data: np.ndarray, at: np.ndarray, size: np.ndarray, width: int, back: bool) -> np.ndarray:
    """``size`` bytes from ``at`` on (or before it, backwards), zeros after them."""
    steps = np.arange(width)
    places = at[:, None] - 1 - steps if back else at[:, None] + steps
    block = data[np.clip(places, 0, len(data) - 1)]
    block[steps[None, :] >= size[:, None]] = 0
    return block


def progressions(group, ids, tags, place) -> np.ndarray:
    """Where places begin that follow the one before, in a group and text, by an equal step."""
    n = len(group)
    same, step = np.zeros(n, bool), np.zeros(n, np.int64)
    same[1:] = (group[1:] == group[:-1]) & (ids[1:] == ids[:-1]) & (tags[1:] == tags[:-1])
    step[1:] = place[1:] - place[:-1]
    joins = same.copy()
    joins[1:] &= (step[1:] == step[:-1]) | ~same[:-1]
    return np.flatnonzero(~joins)


def places_of(group, ids, tags, place):
    """Progressions of places: group, id, tag, first place, step, number."""
    at = progressions(group, ids, tags, place)
    count = np.diff(np.append(at, len(group)))
    second = np.minimum(at + 1, max(len(group) - 1, 0))
    step = np.where(count > 1, place[second] - place[at], 0)
    return group[at], ids[at], tags[at], place[at], step, count


def masks(right, left) -> np.ndarray:
    """Bit l for every offset l at which a context holds a whole string."""
    one = np.uint64(1)
    return ((one << (left + 1).astype(np.uint64)) - one) \
        & ~((one << np.maximum(LENGTH - right, 0).astype(np.uint64)) - one)


class Runs:
    """Suffix records of one task, flushed as sorted, front-coded runs for each bucket."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.count = buckets, [], 0

    def add(self, data, ends, rows, found, cuts):
        starts = np.concatenate([[0], ends[:-1]])
        ids, tags, base = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, -1))
        for lo in range(0, len(cuts), BLOCK_RECORDS):
            block = slice(lo, lo + BLOCK_RECORDS)
            text, place, first, last, h = (x[block] for x in found)
            right, left = last + LENGTH - place, place - first
            part = [h, ids[text], tags[text], place - starts[text] + base[text], right, left,
                    windows_at(data, place, right, LENGTH, False),
                    windows_at(data, place, left, BEFORE, True)]
            for kind in np.unique(cuts[block]).tolist():
                mine = [x[cuts[block] == kind] for x in part]
                for record in [mine] if kind == 1 else cut_by_offset(mine, kind):
                    self.parts.append(record)
                    self.count += len(record[0])
                    if self.count >= RUN_RECORDS:
                        yield from self.flush()

    def flush(self):
        rows = []
        if self.count:
            key, ids, tags, place, right, left, after, before = (
                np.concatenate(x) for x in zip(*self.parts))
            bucket = (key % np.uint64(self.buckets)).astype(np.int64)
            # the lengths, which are never zero here, end the context
            context = np.concatenate([after, before, (right + 1)[:, None].astype(np.uint8),
                                      (left + 1)[:, None].astype(np.uint8)], axis=1)
            context = as_bytes(context)
            order = np.argsort(context, kind="stable")
            order = order[np.argsort(bucket[order], kind="stable")]
            bucket, context = bucket[order], context[order]
            new = np.ones(len(order), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (context[1:] != context[:-1])
            group, heads = np.cumsum(new) - 1, np.flatnonzero(new)
            ids, tags, place = ids[order], tags[order], place[order]
            rank = ranks(ids)
            least = np.minimum.reduceat(rank, heads)[group]
            late = rank > least
            if late.any():
                g, *answer = places_of(group[late], ids[late], tags[late], place[late])
                mask = masks(right[order[heads[g]]], left[order[heads[g]]])
                rows.append((int(bucket[late][0]), 1, packed(*answer, mask)))
            g, *members = places_of(group[~late], ids[~late], tags[~late], place[~late])
            head, limits = order[heads], np.flatnonzero(np.diff(bucket[heads])) + 1
            for part in np.split(np.arange(len(heads)), limits):
                lo, hi = np.searchsorted(g, [part[0], part[-1] + 1])
                rows.append((int(bucket[heads[part[0]]]), 0, front_coded(
                    np.bincount(g[lo:hi] - part[0], minlength=len(part)),
                    [x[lo:hi] for x in members], right[head[part]], left[head[part]],
                    after[head[part]], before[head[part]])))
        self.parts, self.count = [], 0
        for lo in range(0, len(rows), 4096):
            part = list(zip(*rows[lo:lo + 4096]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[0], pa.int32()), pa.array(part[1], pa.int32()),
                 pa.array(part[2], pa.binary())], names=["bucket", "kind", "run"])


def cut_by_offset(record, cuts: int):
    """Copies of records for each group of offsets, limited to the bytes that those need.

    A string at offset l agrees in l bytes before the anchor and LENGTH - l after it; all
    strings of the offsets lo .. hi agree in lo before and LENGTH - hi after, and by these
    the copies are dealt.
    """
    h, ids, tags, place, right, left, after, before = record
    for i in range(cuts):
        lo, hi = i * (BEFORE + 1) // cuts, (i + 1) * (BEFORE + 1) // cuts - 1
        pick = np.flatnonzero(np.maximum(lo, LENGTH - right) <= np.minimum(hi, left))
        if not len(pick):
            continue
        key = h[pick] + np.uint64(lo * 64 + hi + 1)
        for column in [*after[pick, GRAM:LENGTH - hi].T, *before[pick, :lo].T]:
            key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        r, f = np.minimum(right[pick], LENGTH - lo), np.minimum(left[pick], hi)
        a, b = after[pick], before[pick]
        a[np.arange(LENGTH) >= r[:, None]] = 0
        b[np.arange(BEFORE) >= f[:, None]] = 0
        yield [key, ids[pick], tags[pick], place[pick], r, f, a, b]


def packed(ids, tags, place, step, count, mask) -> bytes:
    """Answers: progressions of places and the offsets at which their strings are repeated."""
    return zlib.compress(b"".join([
        ids.tobytes(), tags.tobytes(), place.astype(np.int32).tobytes(),
        step.astype(np.int32).tobytes(), count.astype(np.int32).tobytes(), mask.tobytes()]), 1)


def unpacked(blob: bytes):
    blob = zlib.decompress(blob)
    n, at, out = len(blob) // 36, 0, []
    for kind in (np.int64, np.int64, np.int32, np.int32, np.int32, np.uint64):
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    return out


def front_coded(sizes, members, right, left, after, before) -> bytes:
    """A sorted run: the bytes that each suffix adds to the prefix shared with the one before.

    ``sizes`` tells how many of ``members`` (progressions of places of the least id) a
    suffix has.
    """
    shared = np.minimum(shared_prefixes(after), right)
    steps = np.arange(after.shape[1])
    tails = after[(steps >= shared[:, None]) & (steps < right[:, None])]
    heads = before[np.arange(before.shape[1]) < left[:, None]]
    ids, tags, *places = members
    return zlib.compress(b"".join([
        np.int64(len(right)).tobytes(), np.int64(len(ids)).tobytes(),
        sizes.astype(np.int32).tobytes(), ids.tobytes(), tags.tobytes(),
        *[x.astype(np.int32).tobytes() for x in places], shared.astype(np.uint8).tobytes(),
        right.astype(np.uint8).tobytes(), left.astype(np.uint8).tobytes(),
        tails.tobytes(), heads.tobytes()]), 1)


class Run:
    """A run read back: suffixes as padded strings with the prefix shared with the one before."""

    def __init__(self, blob: bytes):
        blob = zlib.decompress(blob)
        n, m = np.frombuffer(blob, np.int64, 2).tolist()
        at = 16

        def take(kind, count=n):
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        self.sizes = take(np.int32)
        self.members = [take(np.int64, m), take(np.int64, m),
                        *[take(np.int32, m) for _ in range(3)]]
        self.rank = ranks(self.members[0][np.cumsum(self.sizes) - self.sizes])
        shared, right, left = (take(np.uint8).astype(np.int64) for _ in range(3))
        tails, heads = take(np.uint8, int((right - shared).sum())), take(np.uint8, int(left.sum()))
        self.right, self.left = right, left
        self.before = np.zeros((n, BEFORE), np.uint8)
        self.before[np.arange(BEFORE) < left[:, None]] = heads
        self.after = np.zeros((n, LENGTH), np.uint8)
        steps = np.arange(LENGTH)
        own = (steps >= shared[:, None]) & (steps < right[:, None])
        self.after[own] = tails
        # byte j of a suffix is that of the last one before it that brought its own
        source = np.where(steps >= shared[:, None], np.arange(n)[:, None], 0)
        source = np.maximum.accumulate(source, axis=0)
        self.after = self.after[source, steps]
        self.after[steps >= right[:, None]] = 0
        self.shared = shared_prefixes(self.after).tolist()
        flat = self.after.tobytes()
        self.strings = [flat[i:i + LENGTH] for i in range(0, n * LENGTH, LENGTH)]


def merge(runs: list[Run]) -> tuple[list[int], list[int], list[int]]:
    """Run, index and prefix shared with the previous suffix, in the order of all suffixes.

    A loser tree whose nodes hold, for the suffix that lost there, the prefix it shares
    with the suffix that beat it. All suffixes on the way to the top share a known prefix
    with the last one that left; the longer one wins unseen, and only equal ones are
    compared, from the byte after that prefix on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    lengths = [len(r.strings) for r in runs] + [0] * (size - len(runs))
    strings = [r.strings for r in runs] + [[]] * (size - len(runs))
    shared = [r.shared for r in runs] + [[]] * (size - len(runs))
    at = [0] * size
    losers, known = [-1] * (2 * size), [0] * (2 * size)

    def beats(a, pa_, b, pb):
        """The winner of runs a and b with its known prefix, then the loser with its own."""
        if b < 0 or at[b] >= lengths[b]:
            return a, pa_, b, 0
        if a < 0 or at[a] >= lengths[a]:
            return b, pb, a, 0
        if pa_ > pb:
            return a, pa_, b, pb
        if pa_ < pb:
            return b, pb, a, pa_
        x, y = strings[a][at[a]][pa_:], strings[b][at[b]][pa_:]
        if x == y:
            return (a, pa_, b, LENGTH) if a < b else (b, pb, a, LENGTH)
        n = len(x)
        same = n - (((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) >> 3)
        return (a, pa_, b, pa_ + same) if x < y else (b, pb, a, pa_ + same)

    def build(node):
        if node >= size:
            return node - size, 0
        a, pa_ = build(2 * node)
        b, pb = build(2 * node + 1)
        w, pw, l, pl = beats(a, pa_, b, pb)
        losers[node], known[node] = l, pl
        return w, pw

    winner, prefix = build(1)
    out_run, out_index, out_shared = [], [], []
    for _ in range(sum(lengths)):
        i = at[winner]
        out_run.append(winner)
        out_index.append(i)
        out_shared.append(prefix)
        at[winner] = i + 1
        prefix = shared[winner][i + 1] if i + 1 < lengths[winner] else 0
        node = (winner + size) >> 1
        while node:
            loser, kept = losers[node], known[node]
            if loser >= 0 and at[loser] < lengths[loser]:
                if at[winner] >= lengths[winner] or kept > prefix:
                    losers[node], known[node] = winner, prefix
                    winner, prefix = loser, kept
                elif kept == prefix:
                    winner, prefix, losers[node], known[node] = beats(winner, prefix, loser, kept)
            node >>= 1
    return out_run, out_index, out_shared


def repeated(runs: list[Run]):
    """Progressions of places (id, tag, place, step, number) with strings that a smaller id
    has too, and the mask of those strings: bit l for offset l."""
    order_run, order_index, shared = merge(runs)
    base = np.concatenate([[0], np.cumsum([len(r.strings) for r in runs])])
    order = base[np.array(order_run, np.int64)] + np.array(order_index, np.int64)
    shared = np.array(shared, np.int64)
    rank, right, left, before = (np.concatenate([getattr(r, k) for r in runs])[order]
                                 for k in ("rank", "right", "left", "before"))
    n = len(rank)
    backward = np.argsort(as_bytes(before), kind="stable")
    back_shared = shared_prefixes(before[backward])
    mask = np.zeros(n, np.uint64)
    for offset in range(BEFORE + 1):
        part = np.flatnonzero((left >= offset) & (LENGTH - right <= offset))
        if len(part) < 2:
            continue
        after_class = np.cumsum(shared < LENGTH - offset)
        before_class = np.empty(n, np.int64)
        before_class[backward] = np.cumsum(back_shared < offset)
        key = after_class[part] * (n + 1) + before_class[part]
        by = np.argsort(key, kind="stable")
        key = key[by]
        starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        d = rank[part][by]
        least = np.repeat(np.minimum.reduceat(d, starts), np.diff(np.append(starts, len(d))))
        mask[part[by[d > least]]] |= np.uint64(1 << offset)
    of_suffix = np.zeros(n, np.uint64)
    of_suffix[order] = mask
    of_member = np.repeat(of_suffix, np.concatenate([r.sizes for r in runs]))
    hit = of_member > 0
    members = [np.concatenate(x)[hit] for x in zip(*[r.members for r in runs])]
    return *members, of_member[hit]


def removable(batches):
    """Answers of sorted (bucket, kind, run) rows: runs of a bucket are merged, answers go on."""
    def out(d, tag, at, step, number, mask):
        return pa.RecordBatch.from_arrays(
            [pa.array(d), pa.array(tag), pa.array(at), pa.array(step), pa.array(number),
             pa.array(mask.view(np.int64))], names=["d", "tag", "at", "step", "number", "mask"])

    held, current = [], None
    for batch in batches:
        for bucket, kind, run in zip(*[c.to_pylist() for c in batch.columns]):
            if held and (bucket, kind) != (current, 0):
                yield out(*repeated([Run(x) for x in held]))
                held = []
            current = bucket
            if kind == 0:
                held.append(run)
            else:
                yield out(*unpacked(run))
    if held:
        yield out(*repeated([Run(x) for x in held]))


def starts_of(at, step, number, mask):
    """Starts of repeated strings, some at a time: places less the offsets of their mask."""
    at, step, number, mask = (np.array(x, np.int64) for x in (at, step, number, mask))
    offsets = np.arange(BEFORE + 1)
    single = number == 1
    for lo in range(0, len(at), 1 << 13):
        some = np.flatnonzero(single[lo:lo + (1 << 13)]) + lo
        on = (mask[some, None] >> offsets & 1) > 0
        yield (at[some, None] - offsets)[on]
    for i in np.flatnonzero(~single).tolist():
        for offset in np.flatnonzero(int(mask[i]) >> offsets & 1).tolist():
            for k in range(0, int(number[i]), BLOCK_RECORDS):
                steps = np.arange(k, min(int(number[i]), k + BLOCK_RECORDS))
                yield int(at[i]) - offset + int(step[i]) * steps


def without(data: bytes, starts) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, and what is left when strings at ``starts`` go."""
    change = np.zeros(len(data) + 1, np.int32)
    for part in starts:
        np.add.at(change, part, 1)
        np.add.at(change, part + LENGTH, -1)
    gone = np.cumsum(change[:-1], dtype=np.int32) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()


def _same(a: str, b: str):
    """Equality that stays a condition of the join: rows are to be dealt by id alone, so that
    all joins find the one exchange of texts as they need it."""
    return F.greatest(a, b) == F.least(a, b)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   with_text: bool = False, hot_gram: int = HOT_GRAM) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept).

    Removes every byte that a string of 50 bytes covers which also starts in a document
    with a smaller id; strings are judged on the input. Null texts count as empty. Null
    ids rank below all others; rows that share an id are no smaller than each other, so
    they keep what only they repeat. An empty table gives no rows; other columns are not
    looked at. ``with_text`` adds ``kept``, the remaining bytes.

    Ids are numbers from -2 ** 62 up. A text that a smaller id has as a whole is settled by
    its SHA-256 and takes no part in the search. The exchange that carries texts, by id (by
    the text's hash where there is none), is used by all three passes.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID - 1)).alias("rank"),
                       whole_text(text_column).alias("text"))
    rows = rows.withColumn("sha", F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")))

    def number(rank):
        """The id; a number from the text's hash where there is none, so that such texts spread."""
        return F.when(F.col(rank) >= _NO_ID, F.col(rank)).otherwise(
            F.xxhash64("sha").bitwiseAND((1 << 62) - 1) + F.lit(-(1 << 63)))

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    dealt = rows.withColumn("d", number("rank")).drop("rank").repartition("d")
    first = (rows.groupBy("sha").agg(F.min("rank").alias("rank"))
             .select(number("rank").alias("first_d"), F.col("sha").alias("first_sha")))
    marked = dealt.join(first.hint("shuffle_hash"), (F.col("d") == F.col("first_d"))
                        & _same("sha", "first_sha"), "left").select(
        "d", F.xxhash64("sha").alias("tag"), F.col("text").cast("binary").alias("text"),
        F.col("first_d").isNotNull().alias("first"))
    texts = marked.where("first").select("d", "tag", "text")

    shared = (texts.mapInArrow(gram_rows, "h long, d long").repartition("h")
              .sortWithinPartitions("h", "d")
              .mapInArrow(lambda b: shared_grams(b, hot_gram), "d long, h long, cuts int"))
    wanted = shared.groupBy("d").agg(
        F.collect_list(F.expr("if(cuts = 1, h, null)")).alias("cold"),
        F.collect_list(F.expr("if(cuts > 1, h, null)")).alias("hot"),
        F.collect_list(F.expr("if(cuts > 1, cuts, null)")).alias("cuts"))

    def make_runs(batches):
        runs = Runs(buckets)
        for rows in chunks(batches):
            data, ends = laid_out(rows)
            found = anchors(data, ends)
            # (text, gram) pairs that were asked for, numbered in one space, with their cuts
            lists = [np.array([*r[3], *r[4]], np.int64).view(np.uint64) for r in rows]
            cuts = np.concatenate([np.array([1] * len(r[3]) + r[5], np.int32) for r in rows])
            owner = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
            wanted, mine = (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ y for x, y in (
                (owner, np.concatenate(lists)), (found[0], found[4])))
            order = np.argsort(wanted)
            if not len(order) or not len(mine):
                continue
            place = np.minimum(np.searchsorted(wanted[order], mine), len(order) - 1)
            pick = wanted[order][place] == mine
            yield from runs.add(data, ends, rows, [x[pick] for x in found],
                                cuts[order][place][pick])
        yield from runs.flush()

    runs = (texts.join(wanted.hint("shuffle_hash"), "d")
            .select("d", "tag", "text", "cold", "hot", "cuts")
            .mapInArrow(make_runs, "bucket int, kind int, run binary"))
    answers = (runs.repartition("bucket").sortWithinPartitions("bucket", "kind")
               .mapInArrow(removable, "d long, tag long, at int, step int, number int, mask long")
               .repartition("d").groupBy("d", "tag").agg(*[
                   F.collect_list(c).alias(c) for c in ("at", "step", "number", "mask")])
               .select(F.col("d").alias("to_d"), F.col("tag").alias("to_tag"),
                       "at", "step", "number", "mask"))
    kind = docs.schema[id_column].dataType
    judged = marked.join(answers.hint("shuffle_hash"), (F.col("d") == F.col("to_d"))
                         & _same("tag", "to_tag"), "left").select(
        F.when(F.col("d") >= _NO_ID, F.col("d").cast(kind)).alias("__id"),
        "text", "first", "at", "step", "number", "mask")

    def finish(batches):
        for batch in (x for whole in batches for x in pieces_of(whole, 1)):
            out = [[], [], [], [], []]
            for data, is_first, *found in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                if not is_first and len(data) >= LENGTH:
                    result = (len(data), len(data), 1, b"")
                elif found[0]:
                    result = (len(data), *without(data, starts_of(*found)))
                else:
                    result = (len(data), 0, 0, data)
                for column, value in zip(out, (*result[:3], hashlib.sha256(result[3]).hexdigest(),
                                               result[3])):
                    column.append(value)
            arrays = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(),
                                                           pa.string(), pa.binary()))]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            keep = 5 if with_text else 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays[:keep]],
                                             names=[id_column, *names[:keep]])

    schema = (f"`{id_column}` {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, "
              "kept_sha256 string")
    return judged.mapInArrow(finish, schema + (", kept binary" if with_text else ""))
