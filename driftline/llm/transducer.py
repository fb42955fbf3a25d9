"""A byte transducer for UTF-8 text and a verified hash table of word spans, in numpy.

The transducer has two states, outside and inside a word. Two tables of a row for each state
and a column for each byte tell the next state and what the step emits. The next state
depends on the byte alone, so the states of a whole block follow from one look-up and the
block's steps are taken at once; the state goes on to the next block.
"""

from __future__ import annotations

import hashlib

import numpy as np

OUTSIDE, INSIDE = 0, 1
#: What a step emits: a word starts, a word has ended, a capital, a code point, a symbol.
START, END, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8, 16
SPACES = frozenset([0x20, *range(0x09, 0x0E)])
BLOCK = 1 << 20
#: Words above this many bytes are hashed and compared as slices.
LONG = 128

_NEXT = np.array([OUTSIDE if b in SPACES else INSIDE for b in range(256)], np.uint8)


def _emissions(symbols: bytes) -> np.ndarray:
    table = np.zeros((2, 256), np.uint8)
    for byte in range(256):
        always = (CAPITAL if 0x41 <= byte <= 0x5A else 0) | (SYMBOL if byte in symbols else 0)
        if not 0x80 <= byte <= 0xBF:  # every byte but a continuation begins a code point
            always |= POINT
        table[:, byte] = always
        table[INSIDE if byte in SPACES else OUTSIDE, byte] |= END if byte in SPACES else START
    return table.ravel()


class Transducer:
    """Counts of texts: words, different words, capitals, code points, symbols."""

    def __init__(self, symbols: bytes = b"#$%&*|"):
        self.emit = _emissions(symbols)

    def run(self, texts: list[bytes]) -> np.ndarray:
        """One row of five counts for each text.

        A space after each text leads the transducer out of its last word, so one pass goes
        over all texts. A block's arrays and the table of different words are held beside
        the texts, never all words.
        """
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        first = np.cumsum(sizes) - sizes
        data = b"\n".join(texts) + b"\n" + bytes(8)
        counts = np.zeros((len(texts), 5), np.int64)
        words = WordTable(data)
        buffer = np.frombuffer(data, np.uint8)
        state, open_at = OUTSIDE, -1
        for lo in range(0, len(data) - 8, BLOCK):
            block = buffer[lo:min(lo + BLOCK, len(data) - 8)]
            after = _NEXT[block]
            steps = block.astype(np.uint16)
            steps[0] |= state << 8
            steps[1:] |= after[:-1].astype(np.uint16) << 8
            state = int(after[-1])
            out = self.emit[steps]
            rows = slice(np.searchsorted(first, lo, "right") - 1,
                         np.searchsorted(first, lo + len(block), "left"))
            edges = np.maximum(first[rows] - lo, 0)
            for place, bit in enumerate((START, 0, CAPITAL, POINT, SYMBOL)):
                if bit:
                    counts[rows, place] += np.add.reduceat(
                        (out & bit) != 0, edges, dtype=np.int64)
            starts = np.flatnonzero(out & START) + lo
            ends = np.flatnonzero(out & END) + lo
            if open_at >= 0:
                starts = np.concatenate([[open_at], starts])
            open_at = int(starts[-1]) if len(starts) > len(ends) else -1
            starts = starts[:len(ends)]
            if len(starts):
                row = np.searchsorted(first, starts, "right") - 1
                fresh = words.insert(row, starts, ends - starts)
                counts[:, 1] += np.bincount(row[fresh], minlength=len(texts))
        counts[:, 3] -= 1  # the space after the text
        return counts


_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Keeps the lowest k bytes of a little-endian word of eight.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class WordTable:
    """Open addressing over spans of one buffer; a span belongs to a row (a text).

    A span meets the owner of its slot: with equal row, length, hash and then equal bytes it
    is a repeat, else it moves to the next slot. Equal hashes alone decide nothing.
    """

    def __init__(self, data: bytes, slots: int = 1 << 10):
        self.data = data  # ends with eight spare bytes
        self.lanes = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        self._empty(slots)

    def _empty(self, slots: int) -> None:
        self.used = 0
        self.start = np.full(slots, -1, np.int64)
        self.row = np.zeros(slots, np.int64)
        self.length = np.zeros(slots, np.int64)
        self.hash = np.zeros(slots, np.uint64)

    def insert(self, row: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Which of the spans are the first of their row and bytes."""
        hashed = self.hashes(row, start, length)
        self._room(len(start))
        return self._place(row, start, length, hashed)

    def _room(self, more: int) -> None:
        slots = len(self.start)
        if 2 * (self.used + more) <= slots:
            return
        while 2 * (self.used + more) > slots:
            slots *= 2
        full = self.start >= 0
        kept = [x[full] for x in (self.row, self.start, self.length, self.hash)]
        self._empty(slots)
        self._place(*kept)

    def _place(self, row, start, length, hashed) -> np.ndarray:
        mask = np.uint64(len(self.start) - 1)
        slot = (hashed & mask).astype(np.int64)
        fresh = np.zeros(len(start), bool)
        left = np.arange(len(start))
        while len(left):
            at = slot[left]
            free = self.start[at] < 0
            # of several spans at one free slot the earliest, written last, owns it
            claims, places = left[free][::-1], at[free][::-1]
            for mine, given in ((self.start, start), (self.row, row), (self.length, length),
                                (self.hash, hashed)):
                mine[places] = given[claims]
            own = self.start[at] == start[left]
            alike = ~own & (self.hash[at] == hashed[left]) & (self.row[at] == row[left]) \
                & (self.length[at] == length[left])
            twins = np.flatnonzero(alike)
            alike[twins] = self._equal(start[left[twins]], self.start[at[twins]],
                                       length[left[twins]])
            fresh[left[own]] = True
            left = left[~(own | alike)]
            slot[left] = (slot[left] + 1) & int(mask)
        self.used += int(fresh.sum())
        return fresh

    def _lane(self, start, length, k: int):
        return self.lanes[start + 8 * k] & _MASKS[np.minimum(length - 8 * k, 8)]

    def hashes(self, row, start, length) -> np.ndarray:
        value = (row.astype(np.uint64) << np.uint64(32)) ^ length.astype(np.uint64)
        short = np.flatnonzero(length <= LONG)
        k = 0
        while len(short):
            mixed = (value[short] ^ self._lane(start[short], length[short], k)) * _PRIME
            value[short] = mixed ^ (mixed >> np.uint64(29))
            k += 1
            short = short[length[short] > 8 * k]
        for i in np.flatnonzero(length > LONG):
            span = memoryview(self.data)[start[i]:start[i] + length[i]]
            digest = hashlib.blake2b(span, digest_size=8, salt=int(row[i]).to_bytes(8, "little"))
            value[i] = int.from_bytes(digest.digest(), "little")
        return value

    def _equal(self, a, b, length) -> np.ndarray:
        same = np.ones(len(a), bool)
        short = np.flatnonzero(length <= LONG)
        k = 0
        while len(short):
            same[short] = self._lane(a[short], length[short], k) \
                == self._lane(b[short], length[short], k)
            k += 1
            short = short[same[short] & (length[short] > 8 * k)]
        view = memoryview(self.data)
        for i in np.flatnonzero(length > LONG):
            same[i] = view[a[i]:a[i] + length[i]] == view[b[i]:b[i] + length[i]]
        return same
