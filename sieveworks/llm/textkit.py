"""Vectorised tokenising and hashing of UTF-8 text held in Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Strings are hashed as polynomials modulo this prime, at two fixed points that were drawn once.
PRIME = (1 << 31) - 1
_POINTS = (1_290_472_953, 1_837_110_379)
_P, _HALF = U64(PRIME), U64(31)


def _table(separators) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for low, high in separators:
        table[low : high + 1] = False
    return table


#: Words end at blanks.
BLANK_WORDS = _table([(0x20, 0x20), (0x09, 0x0D)])
#: Words end at ASCII characters that are neither digits nor lower-case letters; upper case is folded first.
ALNUM_WORDS = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser with full avalanche over 64 bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Weights:
    """Numbers drawn for places in a string, grown on demand."""

    def __init__(self) -> None:
        self.table = np.zeros(0, U64)

    def __getstate__(self) -> dict:
        return {}

    def __setstate__(self, state: dict) -> None:
        self.__init__()

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            self.table = mix(np.arange(1, max(n, 1 << 12) + 1, dtype=U64)) | U64(1)
        return self.table


WEIGHTS = Weights()


def runs_hashes(symbols: np.ndarray, first: np.ndarray, size: np.ndarray, seed: int = 1) -> np.ndarray:
    """Hash of each of some runs of 64-bit symbols that follow one another without gaps."""
    if not len(first):
        return np.zeros(0, U64)
    place = np.arange(len(symbols)) - np.repeat(first, size)
    terms = symbols * mix(WEIGHTS.upto(int(size.max())) * U64(2 * seed + 1))[place]
    return mix(np.add.reduceat(terms, first) + size.astype(U64) * U64(0x9E3779B97F4A7C15))


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, or a few above it."""
    x = (x & _P) + (x >> _HALF)
    return (x & _P) + (x >> _HALF)


class Powers:
    """Powers of the points and of their inverses modulo the prime, grown on demand."""

    def __init__(self) -> None:
        self.tables = [np.ones(1, np.uint32)] * 4

    def __getstate__(self) -> dict:
        return {}

    def __setstate__(self, state: dict) -> None:
        self.__init__()

    def upto(self, n: int) -> list[np.ndarray]:
        """First point, its inverse, second point, its inverse: powers 0 to n at least."""
        if len(self.tables[0]) < n + 1:
            size = max(n + 1, 1 << 20)
            bases = [x for point in _POINTS for x in (point, pow(point, -1, PRIME))]
            for i, base in enumerate(bases):
                powers = np.ones(size, np.uint32)
                have = 1
                while have < size:
                    more = min(have, size - have)
                    powers[have : have + more] = powers[:more].astype(U64) * U64(pow(base, have, PRIME)) % _P
                    have += more
                self.tables[i] = powers
        return self.tables


POWERS = Powers()


class Prefix:
    """Hashes of all strings in a run of bytes from sums over its prefixes.

    A modulus of 2**64 would be quicker, but there are words that collide under every odd
    base; modulo a prime only chance is left.
    """

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        tables = POWERS.upto(n)
        self.down = tables[1], tables[3]
        self.raw = n <= 1 << 24  # sums below 2**63 ascend and are reduced where they are used
        self.sums = []
        for up in tables[::2]:
            out = np.zeros(n + 1, U64)
            for low in range(0, n, 1 << 24):
                high = min(n, low + (1 << 24))
                terms = data[low:high].astype(U64)
                terms += U64(1)
                terms *= up[low:high]
                np.cumsum(terms, out=out[low + 1 : high + 1])
                if not self.raw:
                    out[low + 1 : high + 1] = _folded(_folded(out[low + 1 : high + 1]) + out[low])
            self.sums.append(out)

    def half(self, i: int, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        """The strings' values under one of the points."""
        out = self.sums[i][ends] - self.sums[i][starts] if self.raw else self.sums[i][ends] + U64(2 * PRIME) - self.sums[i][starts]
        out = _folded(out)
        out *= self.down[i][starts]
        out = _folded(out)
        out[out >= _P] -= _P
        return out

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15)
        return mix((self.half(0, starts, ends) << _HALF | self.half(1, starts, ends)) + size)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary Arrow array; null is the same as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, where, data = column.buffers()
    if not len(column) or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about size bytes: first row, row after the last, their bytes, their offsets."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of a run of texts: start, end, index of each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> None:
        self.data, self.offsets, self.letters = data, offsets, letters
        inside = letters[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            full = np.flatnonzero(np.diff(offsets))
            begins, ends = offsets[full], offsets[full + 1] - 1
            first[begins] = inside[begins]
            last[ends] = inside[ends]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """Of each word the sum of its bytes, each times a number drawn for its place in the word."""
        if not len(self.starts):
            return np.zeros(0, U64)
        size = self.ends - self.starts
        low = int(self.starts[0])
        gaps = np.diff(np.append(self.starts, len(self.data)))
        place = np.arange(low, len(self.data)) - np.repeat(self.starts, gaps)
        # what lies between words counts nothing
        terms = np.where(self.letters, np.arange(1, 257, dtype=U64), U64(0))[self.data[low:]]
        terms *= WEIGHTS.upto(int(gaps.max()))[place]
        return mix(np.add.reduceat(terms, self.starts - low) + size.astype(U64) * U64(0x9E3779B97F4A7C15))

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, also of runs that cross texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= U64(0xD6E8FEB86659FD93)
        out += hashes[i : i + n]
    return mix(out + U64(k))


def code_points(data: np.ndarray) -> np.ndarray:
    """At each byte offset, the number of code points before it."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
