"""Arrow string columns as numpy byte blocks: word spans and substring hashes.

All functions work on a block of whole documents of about ``BLOCK`` bytes (one document, if it
is longer), so that memory follows the block or the longest document, never the batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    """Words of a block, joined by single spaces. Word i is data[start[i]:end[i]]; those of
    document d are first[d] to first[d + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of consecutive blocks."""
    if not len(column):
        return
    data, at = string_parts(column)
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes are white space."""
    return _SPACE[data]


def words(data: np.ndarray, at: np.ndarray, lower: bool = False) -> Words:
    """The maximal runs of bytes other than space, tab, LF, VT, FF and CR, by document."""
    solid = ~_SPACE[data]
    n = len(data)
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    cuts = at[(at > 0) & (at < n)]
    begins[cuts] = solid[cuts]
    ends = np.empty(n, dtype=bool)
    if n:
        ends[:-1] = solid[:-1] & (~solid[1:] | begins[1:])
        ends[-1] = solid[-1]
    begin = np.flatnonzero(begins)
    length = np.flatnonzero(ends) + 1 - begin
    start = np.cumsum(length + 1) - (length + 1)
    out = np.full(int(length.sum()) + len(length), 0x20, dtype=np.uint8)
    kept = data[solid]
    out[np.arange(len(kept)) + np.repeat(np.arange(len(length)), length)] = _LOWER[kept] if lower else kept
    return Words(out, start, start + length, np.searchsorted(begin, at, side="left"))


def windows(first: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, last word) of each run of k words; with ``short``, a document of
    1 to k - 1 words has one window of them all."""
    count = np.diff(first)
    number = np.maximum(count - k + 1, (count > 0).astype(count.dtype) if short else 0)
    doc = np.repeat(np.arange(len(count)), number)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    begin = first[doc] + nth
    return doc, begin, np.minimum(begin + k, first[doc + 1]) - 1


#: The modulus of prefix hashes, 2^61 - 1.
PRIME = (1 << 61) - 1
#: Bytes whose terms are summed before they are reduced.
_RUN = 1 << 18


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2^61 - 1, for x below 2^64."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, for a and b below it, from halves of 30 and 31 bits."""
    low, shift = np.uint64((1 << 31) - 1), np.uint64(31)
    a1, a0, b1, b0 = a >> shift, a & low, b >> shift, b & low
    middle = a1 * b0 + a0 * b1
    return _reduced(a1 * b1 * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << shift) + _reduced(a0 * b0))


class PrefixHash:
    """Polynomial hashes modulo the prime 2^61 - 1 of any substring of a block, from prefix sums.

    The hash of [s, e) is (P[e] - P[s]) * base^-s, so equal substrings have equal hashes wherever
    they lie; two others of n bytes share one for at most n of 2^61 bases."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1):
        base = int(np.random.default_rng(seed).integers(1 << 59, 1 << 60))
        n = len(data)
        powers, inverse = self._powers.get(seed, (None, None))
        if powers is None or len(powers) < n + 1:
            size = 1 << max(n, BLOCK).bit_length()
            powers, inverse = _powers(base, size), _powers(pow(base, -1, PRIME), size)
            if size <= 1 << 23:
                self._powers[seed] = powers, inverse
        self.powers, self.inverse = powers, inverse
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        low, shift = np.uint64((1 << 31) - 1), np.uint64(31)
        for lo in range(0, n, _RUN):
            term = data[lo : lo + _RUN].astype(np.uint64) + np.uint64(1)
            power = powers[lo : lo + len(term)]
            high, less = np.cumsum(term * (power >> shift)), np.cumsum(term * (power & low))  # below 2^59 and 2^60
            high = ((high & np.uint64((1 << 30) - 1)) << shift) + (high >> np.uint64(30))
            self.prefix[lo + 1 : lo + 1 + len(term)] = _reduced(self.prefix[lo] + high + less)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes below 2^61, spread over 64 bits."""
        return mixed(times(_reduced(self.prefix[end] + np.uint64(PRIME) - self.prefix[start]), self.inverse[start]))

    def equal(self, a: np.ndarray, b: np.ndarray, n) -> np.ndarray:
        """Whether the n bytes from a and those from b have one hash."""
        first, second = np.minimum(a, b), np.maximum(a, b)
        p, prime = self.prefix, np.uint64(PRIME)
        return times(_reduced(p[first + n] + prime - p[first]), self.powers[second - first]) == _reduced(p[second + n] + prime - p[second])


class PlaceHash:
    """Polynomial hashes modulo 2^64 of any substring of a block, for choosing places: equal strings
    have equal hashes, but strings that aren't equal may well share one, so nothing else may
    depend on them. A third of the cost of ``PrefixHash``."""

    _tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def __init__(self, data: np.ndarray):
        n = len(data)
        if self._tables is None or len(self._tables[1]) < n + 1:
            rng, size = np.random.default_rng(3), max(n + 1, BLOCK + 1)
            letters = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            base = int(rng.integers(1 << 60, 1 << 61)) * 8 + 5
            bases = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, np.uint64(b))], dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64))]
            tables = letters, *bases
            if size <= 1 << 22:
                PlaceHash._tables = tables
        else:
            tables = self._tables
        letters, powers, self.inverse = tables
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(letters[data] * powers[:n], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[end] - self.prefix[start]) * self.inverse[start])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        m = min(done, n - done)
        step = np.uint64(pow(base, done, PRIME))
        for lo in range(0, m, BLOCK):  # so much at a time as stays small beside the tables
            hi = min(m, lo + BLOCK)
            out[done + lo : done + hi] = times(out[lo:hi], np.full(hi - lo, step))
        done += m
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
