"""A compressed full-text index over words: the Burrows-Wheeler transform in a wavelet matrix.

The index is sorted by the first ``depth`` words of each suffix, which is exact for patterns of up
to that length.  Searches run backwards for many patterns at once.  A text that was folded from several
equal ones is held once with its multiplicity, which counts as so many occurrences.  The words
themselves aren't kept: a file holds bit-planes, the marks of folded texts and the vocabulary.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard

MAGIC = b"CWFM0001"


class Bits:
    """A bit vector with ranks: packed words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        raw = np.packbits(np.concatenate([bits, np.zeros(64 - n % 64, bool)]), bitorder="little")
        self._rank(raw.view("<u8"), n)

    @classmethod
    def packed(cls, words: np.ndarray, n: int) -> Bits:
        out = cls.__new__(cls)
        out._rank(words, n)
        return out

    def _rank(self, words: np.ndarray, n: int) -> None:
        ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        self.words, self.before, self.zeros = words, np.concatenate([[0], ones])[:-1], n - int(ones[-1])

    def rank1(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


def order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols, by doubling; the end sorts first, equal ones come in any order."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    known, n = 1, len(symbols)
    while True:
        tail = np.concatenate([rank[known:], np.zeros(min(known, n), np.int64)])[:n] if known < depth else np.zeros(n, np.int64)
        key = rank * (n + 2) + tail
        at = np.argsort(key)
        if known >= depth:
            return at
        new = np.empty(n, np.int64)
        new[at] = np.cumsum(np.concatenate([[1], (np.diff(key[at]) != 0).astype(np.int64)]))
        rank, known = new, 2 * known
        if rank.max() == n:
            return np.argsort(rank)


class Index:
    def __init__(self, length: int, depth: int, first: np.ndarray, planes: list[Bits], marks: Bits, extra: np.ndarray):
        """``first``: place of each symbol's first suffix.  ``marks``: suffixes that stand for several; ``extra``: how many more, summed."""
        self.length, self.depth, self.first, self.planes, self.marks, self.extra = length, depth, first, planes, marks, extra
        every = np.arange(len(first) - 1)
        self.base = self._sink(every, np.zeros(len(every), np.int64))

    @classmethod
    def build(cls, symbols: np.ndarray, times: np.ndarray, depth: int) -> Index:
        """``symbols``: zero between and after texts, else positive.  ``times``: the multiplicity of the text at each place."""
        at = order(symbols, depth)
        last = symbols[at - 1]  # of the first suffix, the last symbol: a sentinel that no pattern holds
        first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=int(symbols.max()) + 2))])
        more = times[at] - 1
        planes, width = [], max(1, int(symbols.max()).bit_length())
        for p in range(width):
            bits = (last >> (width - 1 - p) & 1).astype(bool)
            planes.append(Bits(bits))
            last = np.concatenate([last[~bits], last[bits]])
        return cls(len(symbols), depth, first, planes, Bits(more > 0), np.concatenate([[0], np.cumsum(more[more > 0])]))

    def save(self, vocabulary: pa.Array) -> bytes:
        """The index and its words (symbol i + 1 is word i) as one file."""
        words = [np.diff(self.first).astype("<u4"), *(p.words for p in self.planes), self.marks.words, np.diff(self.extra).astype("<u4")]
        parts = [zstandard.compress(x, 1) for x in (*(np.ascontiguousarray(w).tobytes() for w in words), b" ".join(vocabulary.cast(pa.binary()).to_pylist()))]
        head = struct.pack("<QIII", self.length, self.depth, len(self.planes), len(parts)) + struct.pack(f"<{len(parts)}Q", *map(len, parts))
        return MAGIC + head + b"".join(parts)

    @classmethod
    def load(cls, blob: bytes) -> tuple[Index, pa.Array]:
        if blob[:8] != MAGIC:
            raise ValueError("not an index file")
        length, depth, planes, n = struct.unpack_from("<QIII", blob, 8)
        sizes = struct.unpack_from(f"<{n}Q", blob, 28)
        ends = 28 + 8 * n + np.cumsum(sizes)
        if len(blob) != ends[-1]:
            raise ValueError("the index file is cut")
        raw = [zstandard.decompress(blob[e - k : e]) for e, k in zip(ends.tolist(), sizes)]
        summed = lambda x: np.concatenate([[0], np.cumsum(np.frombuffer(x, "<u4"), dtype=np.int64)])
        bits = [Bits.packed(np.frombuffer(x, "<u8"), length) for x in raw[1 : planes + 2]]
        return cls(length, depth, summed(raw[0]), bits[:-1], bits[-1], summed(raw[planes + 2])), pa.array(raw[-1].split(b" "), pa.binary())

    def _sink(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places carried down the planes, along each symbol's bits."""
        for p, plane in enumerate(self.planes):
            ones = plane.rank1(at)
            at = np.where((symbol >> (len(self.planes) - 1 - p) & 1).astype(bool), plane.zeros + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The backward step: where a suffix range's edge goes when the symbol is put before it."""
        return self.first[symbol] + self._sink(symbol, at) - self.base[symbol]

    def count(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Occurrences that ranges of suffixes stand for."""
        return hi - lo + self.extra[self.marks.rank1(hi)] - self.extra[self.marks.rank1(lo)]

    def matched(self, words: np.ndarray, ends: np.ndarray, length: np.ndarray, least: int = 2) -> np.ndarray:
        """Matching statistics of a stream of symbols: how many up to each place, ``length`` at most, occur ``least`` times.

        The match grows backwards a symbol at a time; one that has become too rare is let go.  Symbols below
        one are separators and words that the index doesn't hold.
        """
        c = words[ends]
        known = c > 0
        lo, hi, live = np.where(known, self.first[c], 0), np.where(known, self.first[c + 1], 0), np.arange(len(ends))
        out = np.zeros(len(ends), np.int64)
        for back in range(1, int(length.max(initial=0)) + 1):
            enough = hi - lo >= least
            if not enough.all():
                few = np.flatnonzero(~enough & (hi > lo))
                enough[few] = self.count(lo[few], hi[few]) >= least
            out[live[enough]] = back
            enough &= length[live] > back
            live, lo, hi = live[enough], lo[enough], hi[enough]
            c = words[ends[live] - back]
            if (c <= 0).any():
                live, lo, hi, c = live[c > 0], lo[c > 0], hi[c > 0], c[c > 0]
            if not len(live):
                break
            lo, hi = np.split(self.step(np.concatenate([c, c]), np.concatenate([lo, hi])), 2)
        return out

    def repeated(self, words: np.ndarray, first: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
        """For runs of windows in a stream, given by the first window's start and their number: which occur twice or more.

        A run is cut into pieces as long as the index can match; one backward search from a piece's end tells all its
        windows if it gets through.  Else the windows are searched from the left: a match that ends after m symbols
        rules out every window that holds those and the one before, so the search goes on behind that place.
        """
        most = self.depth - window + 1
        pieces = -(-count // most)
        of = np.repeat(np.arange(len(first)), pieces)
        begin = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * most
        start, n = first[of] + begin, np.minimum(count[of] - begin, most)
        base, out = np.cumsum(n) - n, np.zeros(int(n.sum()), bool)
        whole = self.matched(words, start + n + window - 2, n + window - 1)
        tail = np.maximum(0, whole - window + 1)
        at = np.arange(len(out)) - np.repeat(base, n)
        out[at >= np.repeat(n - tail, n)] = True
        left = n - np.maximum(tail, 1)  # a last window that isn't matched is ruled out
        at, run = np.zeros(len(n), np.int64), np.flatnonzero(left > 0)
        full = np.full(len(n), window)
        while len(run):
            m = self.matched(words, start[run] + at[run] + window - 1, full[run])
            out[(base + at)[run[m == window]]] = True
            at[run] += np.maximum(1, window - m)
            run = run[at[run] < left[run]]
        return out
