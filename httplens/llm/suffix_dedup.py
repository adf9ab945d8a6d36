"""Removal of bytes under repeated strings, by a hash-compared suffix sort.

Suffixes at anchors (see ``anchors``) whose first 64 bytes occur again are merge-sorted; two are
compared by their longest common extension, which a binary search over prefix polynomial hashes
finds in logarithmic steps. From that order, those of all earlier starts follow by stable sorts on
one byte more each. Equal windows are then neighbours; each claim that decides a span is verified
byte by byte."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors as an
from . import textblocks as tb

#: Bytes of a string whose repetition counts, and of the grains that find it.
WINDOW, GRAIN = 200, 64


class Suffixes:
    """Suffixes of a block of texts, each from ``begin`` to the end of its text."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.data, self.begin, self.size = data, begin, end - begin
        self.hash = tb.PrefixHash(data)

        self.equal = self.hash.equal

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of suffixes x and y."""
        a, b = self.begin[x], self.begin[y]
        most = np.minimum(self.size[x], self.size[y])
        lo, hi = np.where(self.equal(a, b, most), most, 0), most
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_] + 1) >> 1
            same = self.equal(a[open_], b[open_], mid)
            lo[open_], hi[open_] = np.where(same, mid, lo[open_]), np.where(same, hi[open_], mid - 1)
        return lo

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x is less than y; a prefix is less than what it begins."""
        n = self.common(x, y)
        least = np.minimum(self.size[x], self.size[y])
        at = np.minimum(n, np.maximum(least - 1, 0))
        differ = n < least
        return np.where(differ, self.data[self.begin[x] + at] < self.data[self.begin[y] + at], self.size[x] < self.size[y])

    def order(self, group: np.ndarray) -> np.ndarray:
        """Suffixes by group (which they come sorted by), then by content: a bottom-up mergesort
        in which each element finds its place in the other run by binary search."""
        m = len(self.begin)
        order, place, width = np.arange(m), np.arange(m), 1
        while width < m:
            pair = place // (2 * width) * (2 * width)
            left = place - pair < width
            base = np.where(left, pair + width, pair)
            lo, hi = np.minimum(base, m), np.minimum(np.where(left, pair + 2 * width, pair + width), m)
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                me, other = order[open_], order[mid]
                ahead = group[other] < group[me]
                tie = np.flatnonzero(group[other] == group[me])
                if len(tie):
                    is_left = left[open_][tie]
                    x, y = other[tie], me[tie]
                    # other before me; of equals those of the left run come first
                    first = self.before(np.where(is_left, x, y), np.where(is_left, y, x))
                    ahead[tie] = np.where(is_left, first, ~first)
                lo[open_], hi[open_] = np.where(ahead, mid + 1, lo[open_]), np.where(ahead, hi[open_], mid)
            start = np.where(left, pair, pair + width)
            moved = np.empty_like(order)
            moved[pair + (place - start) + (lo - np.minimum(base, m))] = order
            order, width = moved, 2 * width
        return order


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size)
    return np.frombuffer(b"".join(texts), np.uint8), end - size, end


def solver(window: int):
    def solve(grain: np.ndarray, rank: np.ndarray, texts: list[bytes], left: np.ndarray):
        data, start, end = _joined(texts)
        left = left.astype(np.int64)
        s = Suffixes(data, start + left, end)
        order = s.order(np.cumsum(np.r_[0, grain[1:] != grain[:-1]]))
        m = len(texts)
        low, high = np.full(m, -1), np.full(m, -1)  # fewest and most bytes before the anchor
        by_low, by_high = np.zeros(m, np.int64), np.zeros(m, np.int64)  # and whose window is equal
        for a in range(int(left.max(initial=0)) + 1):
            if a:
                order = order[left[order] >= a]
                order = order[np.argsort(data[s.begin[order] - a], kind="stable")]
            v = order[s.size[order] >= window - a]
            x, y = v[:-1], v[1:]
            hit = s.equal(s.begin[x] - a, s.begin[y] - a, window)
            for p, q in ((x[hit], y[hit]), (y[hit], x[hit])):
                fresh = low[p] < 0
                low[p[fresh]], by_low[p[fresh]] = a, q[fresh]
                high[p], by_high[p] = a, q
        which = np.flatnonzero(low >= 0)
        span = np.arange(window)
        for lo in range(0, len(which), 2048):
            w = which[lo : lo + 2048, None]
            for a, other in ((low, by_low), (high, by_high)):
                if not (data[s.begin[w] - a[w] + span] == data[s.begin[other[w]] - a[w] + span]).all():
                    return exactly(texts, left)
        return which, high[which], window - low[which]

    def exactly(texts: list[bytes], left: np.ndarray):
        """The same from the bytes alone, where a hash has collided."""
        seen: dict[tuple[int, bytes], set[int]] = {}
        places = [(i, a, (a, t[n - a : n - a + window])) for i, (t, n) in enumerate(zip(texts, left.tolist(), strict=True)) for a in range(n + 1) if n - a + window <= len(t)]
        for i, _, key in places:
            seen.setdefault(key, set()).add(i)
        found: dict[int, list[int]] = {}
        for i, a, key in places:
            if len(seen[key]) > 1:
                found.setdefault(i, []).append(a)
        which = np.array(sorted(found), dtype=np.int64)
        return which, np.array([max(found[i]) for i in which.tolist()], np.int64), np.array([window - min(found[i]) for i in which.tolist()], np.int64)

    return solve


def opener(window: int):
    def windows(left: np.ndarray, texts: list[bytes]):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        left = left.astype(np.int64)
        which = np.repeat(np.arange(len(texts)), left + 1)
        a = np.arange(len(which)) - np.repeat(np.cumsum(left + 1) - (left + 1), left + 1)
        at = left[which] - a
        ok = at + window <= size[which]
        which, a, at = which[ok], a[ok], at[ok]
        return which, *an.digests([texts[i][x : x + window] for i, x in zip(which.tolist(), at.tolist(), strict=True)], a.tolist()), a

    return windows


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, grain: int = GRAIN, crowd: int = an.CROWD, bits: int = 64) -> DataFrame:
    """(id, n_bytes, removed, kept) of every row: the text as UTF-8 without each byte that a string
    of ``window`` bytes covers which also starts anywhere else; removed: array of (lo, hi), the
    maximal runs of removed bytes.

    Matches don't cross rows. Null text counts as empty; rows shorter than the window lose
    nothing; equal rows remove each other whole; null ids are rows like any other; texts of any length
    are read whole, in stretches; an empty table gives an empty one; other columns are ignored."""
    shape = an.Shape(words=False, window=window, grain=grain, ranked=False, bits=bits)
    joined = an.covered(an.texts_of(df, id_col, text_col, ranked=False), shape, solver(window), opener(window), crowd)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, cut = an.list_parts(batch.column(2), ("lo", "hi"))
            for lo, hi, data, at in tb.blocks(batch.column(1), 1 << 22):
                removed, kept = [], []
                for i in range(lo, hi):
                    text = data[at[i - lo] : at[i - lo + 1]]
                    gone = an.mask(len(text), *(x[cut[i] : cut[i + 1]] for x in parts))
                    edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                    removed.append([{"lo": a, "hi": b} for a, b in edge.reshape(-1, 2).tolist()])
                    kept.append(text[~gone].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(removed, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), pa.array(kept, pa.binary())],
                    names=["id", "n_bytes", "removed", "kept"],
                )

    return joined.mapInArrow(run, f"id {kind}, n_bytes bigint, removed array<struct<lo:int,hi:int>>, kept binary").withColumnRenamed("id", id_col)



