"""Repeated windows of a fixed length, found through sampled anchors.

To find every window of ``window`` units (bytes or words) that occurs in another place, without
moving a row for each place, a few places of each text are chosen by their content alone: in each
run of window - grain + 1 grains (grain: so many units), those of the smallest hash. Any window
holds such a run, so equal windows hold an equal grain at an equal offset: its anchor.

1. ``mark``: each text's anchors with the hash of the grain and of its surroundings (all units of
   all windows that hold the grain). Copies within a batch meet there, before any shuffle, and are
   compared byte by byte.
2. ``meet``: anchors by grain. A grain that occurs once (for ``ranked``: in texts of one rank only)
   falls out. Of each different surroundings of the others two anchors go on, and what is found
   around them holds for their twins.
3. ``surroundings``, ``compare``: these anchors' surroundings as text, in groups of a grain, for
   the caller's own method, which decides on every window; grains with more than a crowd of them
   go window by window, by digests of 128 bits.
4. ``covered``: if ranked, twins get the spans of the anchor that stands for them; otherwise, as two
   more of their kind lie elsewhere, all their windows count.

Surroundings are of one kind if their BLAKE2 digests of 128 bits are equal, which nobody who writes
a text can bring about; all else that a hash suggests is compared byte by byte.

Everything streams over sorted partitions; no group is ever held whole unless it is small."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .lineage import ordered_key, release, scoped, staged

#: Units of one text that are hashed at a time; longer texts are taken in overlapping stretches.
STRETCH = 1 << 18
#: Anchors of one grain that are compared in one task, and anchors of whole grains that are at a time.
CROWD, PART = 1 << 14, 1 << 12
#: Anchors of one grain that ``meet`` holds before it decides on those it can.
HELD = 1 << 18
#: Anchors of one grain that are sorted in one task; those of more are counted by aggregates.
HOT = 1 << 20
#: Grains are counted by themselves only in those of so many buckets that hold more than ``HOT`` anchors.
BUCKETS = 1 << 14
#: Ranges of grains that meet one after the other: disk holds the shuffle files of one of them.
RANGES = 2


class Shape(NamedTuple):
    """What a text is made of, and how long windows and grains are. ``ranked``: a window counts
    where a text of smaller rank holds it, otherwise where it occurs anywhere else. ``bits`` of a
    grain's hash are used: with few, other grains meet as well, which costs time and changes nothing."""

    words: bool
    window: int
    grain: int
    ranked: bool
    bits: int = 64


class Units(NamedTuple):
    """Bytes and units of one text; words are joined by single spaces, bytes need no places."""

    data: np.ndarray
    start: np.ndarray | None
    end: np.ndarray | None

    def __len__(self) -> int:
        return len(self.data if self.start is None else self.start)

    def pieces(self, text: bytes, left: np.ndarray, right: np.ndarray) -> list[bytes]:
        """Units left to right - 1 of the text, which is ``data`` as bytes."""
        if self.start is not None:
            left, right = self.start[left], self.end[right - 1]
        return [text[a:b] for a, b in zip(left.tolist(), right.tolist(), strict=True)]

    def part(self, a: int, b: int) -> Units:
        """Units a to b - 1 as a text of their own."""
        if self.start is None:
            return Units(self.data[a:b], None, None)
        at = self.start[a]
        return Units(self.data[at : self.end[b - 1]], self.start[a:b] - at, self.end[a:b] - at)


def units(shape: Shape, data: np.ndarray) -> Units:
    if shape.words:
        w = tb.words(data, np.array([0, len(data)]))
        return Units(w.data, w.start, w.end)
    return Units(data, None, None)


def _sliding(op, x: np.ndarray, w: int, fill: int) -> np.ndarray:
    """op over each run of w: suffixes of one block of w with prefixes of the next."""
    n = len(x)
    y = np.concatenate([x, np.full(-n % w, fill, x.dtype)]).reshape(-1, w)
    prefix = op.accumulate(y, axis=1).ravel()
    suffix = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    return op(suffix[:m], prefix[w - 1 : w - 1 + m])


def chosen(h: np.ndarray, w: int, upto: np.ndarray | None = None) -> np.ndarray:
    """Places whose hash is the smallest of some run of w of them; upto: the place after the last
    of each place's text, if there are several, as no run goes from one into the next."""
    least = _sliding(np.minimum, h, w, (1 << 64) - 1)
    if upto is not None:
        least[np.arange(w, len(h) + 1) > upto[: len(least)]] = 0
    none = np.zeros(w - 1, h.dtype)
    return np.flatnonzero(_sliding(np.maximum, np.concatenate([none, least, none]), w, 0) == h)


def anchors(shape: Shape, text: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit, hash of the grain, two halves of the digest of the surroundings) of the anchors of one text."""
    n, (_, window, grain, _, bits) = len(text), shape
    found = []
    for lo in range(0, n if n >= window else 0, STRETCH):
        a, b = max(0, lo - 2 * window), min(n, lo + STRETCH + 2 * window)
        if b - a < window:
            continue
        part = text.part(a, b)
        s = np.arange(b - a) if part.start is None else part.start
        e = s + 1 if part.end is None else part.end
        at = chosen(tb.PlaceHash(part.data).of(s[: b - a - grain + 1], e[grain - 1 :]), window - grain + 1)
        at = at[(at >= lo - a) & (at < lo - a + STRETCH)]
        left, right = np.maximum(0, at - (window - grain)), np.minimum(b - a, at + window)
        raw = part.data.tobytes()
        own = np.array([xxhash.xxh3_64_intdigest(x) for x in part.pieces(raw, at, at + grain)], np.uint64) >> np.uint64(64 - bits)
        found.append((at + a, own, *(x.view(np.uint64) for x in digests(part.pieces(raw, left, right), (at - left).tolist()))))
    none = np.zeros(0, np.uint64)
    return tuple(np.concatenate([*x, y]) for x, y in zip(zip(*found, strict=True) if found else ((), (), (), ()), (none.astype(np.int64), none, none, none), strict=True))


class Part(NamedTuple):
    """Texts of consecutive rows from ``lo``: their bytes, their units (words joined by single spaces;
    bytes need no places), and the first unit of each and of the one after."""

    raw: bytes
    start: np.ndarray | None
    end: np.ndarray | None
    first: np.ndarray
    lo: int

    def around(self, shape: Shape, row: int, pos: int) -> tuple[bytes, int]:
        """The surroundings of an anchor, and the units of them that lie before it."""
        a, b = int(self.first[row - self.lo]), int(self.first[row - self.lo + 1])
        left, right = max(a, a + pos - (shape.window - shape.grain)), min(b, a + pos + shape.window)
        before = a + pos - left
        return (self.raw[left:right] if self.start is None else self.raw[self.start[left] : self.end[right - 1]]), before


def block_anchors(shape: Shape, data: np.ndarray, at: np.ndarray, lo: int) -> tuple[Part, tuple[np.ndarray, ...]]:
    """(row, unit, hash of the grain, two halves of the digest of the surroundings) of the anchors of a
    block of texts, the first of which is row ``lo``."""
    n, (words, window, grain, _, bits) = len(at) - 1, shape
    if n == 1 or np.diff(at).max() > STRETCH:
        each = [units(shape, data[at[i] : at[i + 1]]) for i in range(n)]
        found = [(np.full(len(x[0]), lo + i), *x) for i, x in enumerate(anchors(shape, own) for own in each)]
        first = np.r_[0, np.cumsum([len(own) for own in each])]
        byte = np.r_[0, np.cumsum([len(own.data) for own in each])]
        places = [np.concatenate([x + b for x, b in zip(column, byte.tolist(), strict=False)]) for column in zip(*(own[1:] for own in each), strict=True)] if words else [None, None]
        return Part(b"".join(own.data.tobytes() for own in each), *places, first, lo), tuple(map(np.concatenate, zip(*found, strict=True)))
    if words:
        w = tb.words(data, at)
        data, start, end, first = w
    else:
        start, first = np.arange(len(data)), at
        end = start + 1
    raw = data.tobytes()
    size = np.diff(first)
    number = np.where(size >= window, size - grain + 1, 0)
    upto = np.cumsum(number)
    doc = np.repeat(np.arange(n), number)
    place = np.arange(len(doc)) + (first[:-1] - (upto - number))[doc]
    if len(doc):
        it = chosen(tb.PlaceHash(data).of(start[place], end[place + grain - 1]), window - grain + 1, upto[doc])
        doc, place = doc[it], place[it]
    left, right = np.maximum(first[doc], place - (window - grain)), np.minimum(first[doc + 1], place + window)
    pieces = lambda a, b: (raw[x:y] for x, y in zip(start[a].tolist(), end[b - 1].tolist(), strict=True))
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, pieces(place, place + grain)), np.uint64, len(place)) >> np.uint64(64 - bits)
    around, more = (x.view(np.uint64) for x in digests(pieces(left, right), (place - left).tolist()))
    return Part(raw, *((start, end) if words else (None, None)), first, lo), (doc + lo, place - first[doc], own, around, more)


def _record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def extent(shape: Shape, pos: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """First unit of the surroundings of an anchor, and the unit after the last."""
    return np.maximum(0, pos - (shape.window - shape.grain)), np.minimum(units, pos + shape.window)


MARKS = "rid bigint, rank bigint, pos int, grain bigint, around bigint, more bigint, met boolean"


def mark(texts: DataFrame, shape: Shape) -> DataFrame:
    """Anchors of (rid, rank, text). met: two anchors of the batch stand for it, with the same bytes
    around, and the first of them shows that all its windows count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, rank = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts: list[Part] = []
            found: list[tuple[np.ndarray, ...]] = []
            for lo, _, data, at in tb.blocks(batch.column(2)):
                part, own = block_anchors(shape, data, at, lo)
                parts.append(part)
                found.append(own)
            if not sum(len(own[0]) for own in found):
                continue
            row, pos, grain, around, more = map(np.concatenate, zip(*found, strict=True))
            del found
            order = np.argsort(grain)
            same = np.diff(grain[order]) == 0
            again = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
            some = np.sort(order[again])  # of these alone the order within a grain is open
            order[again] = some[np.lexsort((pos[some], rank[row[some]], more[some], around[some], grain[some]))]
            row, pos, grain, around, more = (x[order] for x in (row, pos, grain, around, more))
            new = np.r_[True, (grain[1:] != grain[:-1]) | (around[1:] != around[:-1]) | (more[1:] != more[:-1])]
            first, second = pairs(np.cumsum(new) - 1, new, rank[row] if shape.ranked else None)
            here = np.arange(len(row))
            met = (second >= 0) & (second < here)

            above = [part.lo for part in parts]

            def text(n: int) -> tuple[bytes, int]:
                return parts[bisect_right(above, row[n]) - 1].around(shape, int(row[n]), int(pos[n]))

            held: tuple[int, tuple[bytes, int]] = (-1, (b"", 0))
            for n in np.flatnonzero(met).tolist():
                if held[0] != first[n]:
                    held = int(first[n]), text(first[n])
                met[n] = text(n) == held[1]
            yield _record(rid=rid[row], rank=rank[row], pos=pos.astype(np.int32), grain=grain.view(np.int64), around=around.view(np.int64), more=more.view(np.int64), met=met)

    return texts.mapInArrow(run, MARKS)


def pairs(kind: np.ndarray, new: np.ndarray, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The two rows that stand for each row's kind, of rows sorted by kind (and rank): its first, and
    its second, or, with ``rank``, its first of a larger rank; -1 if there is none."""
    at = np.flatnonzero(new)
    if rank is None:
        second = np.where(np.bincount(kind) > 1, at + 1, -1) if len(at) else at
    else:
        larger = rank > rank[at][kind]
        second = np.full(len(at), len(kind))
        np.minimum.at(second, kind[larger], np.flatnonzero(larger))
        second[second == len(kind)] = -1
    return at[kind], second[kind]


MET = "rid bigint, rank bigint, pos int, grain bigint, apart boolean, of_rid bigint, of_rank bigint, of_pos int"
_PLACE = ("rid", "rank", "pos")


def _met(cols: dict[str, np.ndarray], keep: np.ndarray, apart: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
    """Rows of MET for those to keep; of: the row that stands for each, unless it goes on itself."""
    own = {c: cols[c][keep] for c in (*_PLACE, "grain")}
    stands = {f"of_{c}": pa.array(cols[c][np.maximum(of, 0)[keep]], mask=apart[keep]) for c in _PLACE}
    return _record(**own, apart=apart[keep], **stands)


def meet(marks: DataFrame, shape: Shape, hot_rows: int = 0) -> DataFrame:
    """Of the anchors that are not met, those whose grain occurs again (if ranked: in another rank).
    apart: it goes on, as the first of its surroundings, or as the second (if ranked: the first of
    a larger rank). The others are twins, and name the one of those two that stands for them."""
    return reduce(DataFrame.union, meetings(marks, shape, hot_rows))


def meetings(marks: DataFrame, shape: Shape, hot_rows: int = 0) -> list[DataFrame]:
    """``meet`` by ranges of grains, which each read their own part of ``marks``: batches lie there in
    order of their grains."""
    schema = ("grain", "around", "more", *_PLACE)
    hot_rows = hot_rows or HOT

    def settle(cols: dict[str, np.ndarray], spread: bool) -> pa.RecordBatch:
        """Whole grains in order; with ``spread``, known to occur again."""
        grain, around, more, rank = cols["grain"], cols["around"], cols["more"], cols["rank"]
        fresh = np.r_[True, grain[1:] != grain[:-1]]
        new = fresh | np.r_[True, (around[1:] != around[:-1]) | (more[1:] != more[:-1])]
        first, second = pairs(np.cumsum(new) - 1, new, rank if shape.ranked else None)
        at, own, here = np.flatnonzero(fresh), np.cumsum(fresh) - 1, np.arange(len(grain))
        if shape.ranked:
            again = np.minimum.reduceat(rank, at) < np.maximum.reduceat(rank, at)
        else:
            again = np.bincount(own) > 1
        apart = (here == first) | (here == second)
        return _met(cols, again[own] | spread, apart, np.where((second >= 0) & (here > second), second, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        spread = None  # a grain of which a part has been decided
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {c: batch.column(i).to_numpy() for i, c in enumerate(schema)}
            cols = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in schema}
            last = int(np.searchsorted(cols["grain"], cols["grain"][-1], side="left"))
            if last:
                head = int(np.searchsorted(cols["grain"], cols["grain"][0], side="right")) if spread == cols["grain"][0] else 0
                for a, b, known in ((0, head, True), (head, last, False)):
                    if b > a:
                        yield settle({c: x[a:b] for c, x in cols.items()}, known)
                spread = None
            held = {c: x[last:] for c, x in cols.items()}
            if len(held["grain"]) > HELD:
                others = np.flatnonzero((held["around"] != held["around"][-1]) | (held["more"] != held["more"][-1]))
                if len(others):  # several surroundings: decide on all but the last
                    last = int(others[-1]) + 1
                    yield settle({c: x[:last] for c, x in held.items()}, True)
                    spread = held["grain"][0]
                    held = {c: x[last:] for c, x in held.items()}
                if (n := len(held["grain"])) > HELD:  # one: all but its two are twins, the last row stays to show the end
                    new_kind = np.r_[True, np.zeros(n - 1, bool)]
                    first, second = pairs(np.zeros(n, np.int64), new_kind, held["rank"] if shape.ranked else None)
                    here, none = np.arange(n), np.zeros(n, bool)
                    keep = (here != first) & (here != second) & (here < n - 1)
                    yield _met(held, keep, none, np.where((second >= 0) & (here > second), second, first))
                    held = {c: x[~keep] for c, x in held.items()}
                    spread = held["grain"][0]
        if held is not None and len(held["grain"]):
            yield settle(held, spread == held["grain"][0])

    own = marks.where("not met").select(*schema)
    hot = _hot(own, hot_rows)
    rest = own if hot is None else own.join(hot, "grain", "left_anti")
    edges = [(n << 64) // RANGES - (1 << 63) for n in range(1, RANGES)]
    met = []
    for lo, hi in zip([None, *edges], [*edges, None], strict=True):
        part = rest if lo is None else rest.where(F.col("grain") >= lo)
        part = part if hi is None else part.where(F.col("grain") < hi)
        met.append(part.repartition("grain").sortWithinPartitions("grain", "around", "more", "rank", "rid", "pos").mapInArrow(run, MET))
    return met if hot is None else [*met, _meet_hot(staged(own.join(hot, "grain", "left_semi")), shape)]


def _hot(own: DataFrame, rows: int) -> DataFrame | None:
    """Grains of more than so many anchors, at most one for each so many. A bucket of grains holds more
    than one of them does, so few or no grains are left to be counted by themselves."""
    bucket = F.col("grain").bitwiseAND(BUCKETS - 1).alias("bucket")
    full = staged(own.groupBy(bucket).count().where(F.col("count") > rows).select("bucket"))
    if full.isEmpty():
        return None
    hot = staged(own.select("grain", bucket).join(full, "bucket", "left_semi").groupBy("grain").count().where(F.col("count") > rows).select("grain"))
    return None if hot.isEmpty() else hot


def _meet_hot(own: DataFrame, shape: Shape) -> DataFrame:
    """``meet`` for grains of any number of anchors: least and greatest anchors of each grain and
    surroundings, with partial results before the shuffle, joined back by both."""
    place = F.struct("rank", "rid", "pos")
    kinds = own.groupBy("grain", "around", "more").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    both = own.join(staged(kinds), ["grain", "around", "more"])
    two = F.col("b.rank") > F.col("a.rank") if shape.ranked else F.col("b") != F.col("a")
    apart = (place == F.col("a")) | ((place == F.col("b")) & two)
    later = F.col("rank") > F.col("a.rank") if shape.ranked else F.lit(False)
    of = [F.when(~apart, F.when(later, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))).alias(f"of_{c}") for c in _PLACE]
    return both.select(*_PLACE, "grain", apart.alias("apart"), *of)


AROUND = "grain bigint, rid bigint, rank bigint, pos int, left int, around binary"


def surroundings(texts: DataFrame, apart: DataFrame, shape: Shape) -> DataFrame:
    """The surroundings of anchors of (rid, rank, at), as bytes; ``left``: units before the anchor.
    Equal rows, which the join puts side by side, take part once or, if not ranked, twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, times = None, 0
        for batch in batches:
            pos, cut = list_parts(batch.column(3), ("pos", "grain"))
            rid, rank = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, at in tb.blocks(batch.column(2)):
                out: list[list] = [[], [], [], [], [], []]
                for i in range(lo, hi):
                    times = times + 1 if last == (rid[i], rank[i]) else 1
                    last = rid[i], rank[i]
                    if times > 2 - shape.ranked:
                        continue
                    own = units(shape, data[at[i - lo] : at[i - lo + 1]])
                    p, grain = pos[0][cut[i] : cut[i + 1]], pos[1][cut[i] : cut[i + 1]]
                    left, right = extent(shape, p, len(own))
                    out[5] += own.pieces(own.data.tobytes(), left, right)
                    for x, y in zip(out, (grain, np.full(len(p), rid[i]), np.full(len(p), rank[i]), p, p - left), strict=False):
                        x.append(y)
                if not out[0]:
                    continue
                g, r, k, p, left = map(np.concatenate, out[:5])
                yield _record(grain=g, rid=r, rank=k, pos=p.astype(np.int32), left=left.astype(np.int32), around=pa.array(out[5], pa.binary()))

    joined = texts.join(apart, ["rid", "rank"]).select("rid", "rank", "text", "at")
    return joined.mapInArrow(run, AROUND)


def list_parts(column: pa.Array, fields: tuple[str, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Fields of a column of arrays of structs as flat arrays, and offsets of each row's part."""
    cut = np.r_[0, np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))]
    flat = column.flatten()
    return [flat.field(f).to_numpy(zero_copy_only=False) for f in fields], cut


Solve = Callable[[np.ndarray, np.ndarray, list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
Windows = Callable[[np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def compare(around: DataFrame, shape: Shape, solve: Solve, windows: Windows, crowd: int = CROWD) -> DataFrame:
    """(rid, rank, pos, lo, hi) of units that windows around the anchors cover which count, one row an
    anchor: its windows all hold it, so what they cover is one run.

    solve(grain, rank, texts, left) gives (anchor, units before it that are covered, units from it
    on) for whole grains; windows(left, texts) gives (anchor, two halves of a digest, units before
    it) of every window that holds the anchor's grain, for grains with more than a crowd of
    surroundings: those windows are counted by a grouped aggregate, with partial sums before the
    shuffle."""
    schema = "crowded boolean, " + AROUND + ", hi int"
    fields = ("grain", "rid", "rank", "pos", "left")

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """(whole grains, False) or (part of a crowded one, True)."""
        held: list[pa.RecordBatch] = []
        rows, hot = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            grain = batch.column(0).to_numpy()
            if hot is not None:
                n = int(np.searchsorted(grain, hot, side="right"))
                yield batch.slice(0, n), True
                batch, grain = batch.slice(n), grain[n:]
                if not len(grain):
                    continue
                hot = None
            held.append(batch)
            rows += batch.num_rows
            if rows < min(crowd, PART):
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            grain = table.column(0).to_numpy()
            last = int(np.searchsorted(grain, grain[-1], side="left"))
            if last:
                yield from parts(table.slice(0, last))
            if rows - last > crowd:
                hot = grain[-1]
                yield table.slice(last), True
                held, rows = [], 0
            else:
                held, rows = table.slice(last).to_batches(), rows - last
        if held:
            yield from parts(pa.Table.from_batches(held).combine_chunks())

    def parts(table: pa.Table) -> Iterator[tuple[pa.Table, bool]]:
        grain = table.column(0).to_numpy()
        edge = np.flatnonzero(np.r_[True, grain[1:] != grain[:-1], True])
        lo = 0
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a > crowd:
                if a > lo:
                    yield table.slice(lo, a - lo), False
                yield table.slice(a, b - a), True
                lo = b
            elif b - lo > crowd:
                yield table.slice(lo, a - lo), False
                lo = a
        if table.num_rows > lo:
            yield table.slice(lo), False

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, crowded in sized(batches):
            cols = [table.column(i).to_numpy() for i in range(5)]
            texts = table.column(5).to_pylist()
            if crowded:
                yield _record(crowded=np.ones(len(texts), bool), **dict(zip(fields, cols, strict=True)), around=pa.array(texts, pa.binary()), hi=pa.nulls(len(texts), pa.int32()))
            elif len(texts) > 1:
                which, before, after = solve(cols[0], cols[2], texts, cols[4])
                pos = cols[3][which]
                yield _record(
                    crowded=np.zeros(len(which), bool), grain=cols[0][which], rid=cols[1][which], rank=cols[2][which], pos=pos,
                    left=before.astype(np.int32), around=pa.nulls(len(which), pa.binary()), hi=(pos + after).astype(np.int32),
                )

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                which, h, k, before = windows(part.column(4).to_numpy(), part.column(5).to_pylist())
                taken = {name: part.column(i).take(pa.array(which)) for i, name in enumerate(fields[:4])}
                yield _record(**taken, h=h, k=k, lo=(taken["pos"].to_numpy() - before).astype(np.int32))

    found = staged(around.repartition("grain").sortWithinPartitions("grain").mapInArrow(settled, schema))
    spans = found.where("not crowded").select(*_PLACE, (F.col("pos") - F.col("left")).alias("lo"), "hi")
    each = found.where("crowded").select("grain", *_PLACE, "left", "around")
    each = each.mapInArrow(opened, "grain bigint, rid bigint, rank bigint, pos int, h bigint, k bigint, lo int")
    seen = each.groupBy("grain", "h", "k").agg(F.count("*").alias("n"), F.min("rank").alias("least"))
    both = each.join(seen, ["grain", "h", "k"]).where("rank > least" if shape.ranked else "n > 1")
    return spans.union(both.groupBy(*_PLACE).agg(F.min("lo").alias("lo"), (F.max("lo") + shape.window).alias("hi")))


def digests(texts: Iterable[bytes], left: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of the 128-bit digest of each text with so many units before its anchor."""
    blake, salts = hashlib.blake2b, [n.to_bytes(8, "little") for n in range(max(left, default=0) + 1)]
    raw = b"".join([blake(t, digest_size=16, salt=salts[n]).digest() for t, n in zip(texts, left, strict=True)])
    return tuple(np.frombuffer(raw, np.int64).reshape(-1, 2).T)


def texts_of(df: DataFrame, id_col: str, text_col: str, ranked: bool) -> DataFrame:
    """(id, rid, rank, text): rid and rank stand for a row, and equal rows share them and the result.
    rid is a hash of id and text; rank, if ranked, is a number in order of the id (see
    ``ordered_key``), null last, otherwise another such hash: 128 bits for a row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = ordered_key(rows, "id", "rank", nulls=(1 << 63) - 1) if ranked else rows.withColumn("rank", F.xxhash64("text", "id"))
    return rows.select("id", F.xxhash64("id", "text").alias("rid"), "rank", "text")


_SPANS = "array<struct<lo:int,hi:int>>"


def covered(texts: DataFrame, shape: Shape, solve: Solve, windows: Windows, crowd: int = CROWD) -> DataFrame:
    """``texts`` (id, text) with spans: array of (lo, hi) in units that windows which count cover, in
    any order, overlapping, hi perhaps past the end; at most two for each anchor.

    Each step is written and what it read is dropped, so that disk follows the largest step."""
    marks = staged(mark(texts.select("rid", "rank", "text"), shape))
    with scoped(texts.sparkSession) as keep:
        met = keep(staged(*meetings(marks, shape)))
    w, g = shape.window, shape.grain
    key = ["rid", "rank"]
    whole = lambda df: df.select(*key, F.greatest(F.lit(0), F.col("pos") - (w - g)).alias("lo"), (F.col("pos") + w).alias("hi"))
    sure = whole(marks.where("met"))
    sure = staged(sure if shape.ranked else sure.union(whole(met.where("not apart"))))
    release(marks)
    apart = staged(met.where("apart").groupBy(*key).agg(F.collect_set(F.struct("pos", "grain")).alias("at")))
    twins = staged(met.where("not apart").select(*_PLACE, *(f"of_{c}" for c in _PLACE))) if shape.ranked else None
    release(met)
    with scoped(texts.sparkSession) as keep:
        near = keep(staged(compare(surroundings(texts, apart, shape), shape, solve, windows, crowd)))
    release(apart)
    every = sure.union(near.select(*key, "lo", "hi"))
    if twins is not None:
        moved = F.col("pos") - F.col("of_pos")
        of = near.withColumnsRenamed({c: f"of_{c}" for c in _PLACE})
        every = every.union(of.join(twins, [f"of_{c}" for c in _PLACE]).select(*key, (F.col("lo") + moved).alias("lo"), (F.col("hi") + moved).alias("hi")))
    spans = staged(every.groupBy(*key).agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))
    release(sure, near, *([twins] if twins is not None else []))
    return texts.join(spans, key, "left").select("id", "text", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def mask(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of n units any of the spans covers."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, lo, 1)
    np.add.at(change, np.minimum(hi, n), -1)
    return np.cumsum(change)[:n] > 0
