"""Removal of words under passages of earlier documents, by level-wise doubling.

Windows of words that repeat at one length alone are extended to twice that length: runs of
``grain`` words at anchors (see ``anchors``), then of twice as many, and so on up to the window;
what occurs in one document only falls out at each level. What the last level finds is compared
byte by byte before a word is removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors as an
from . import textblocks as tb

#: Words of a window whose repetition counts, and of the runs at the first level.
WINDOW, GRAIN = 13, 4


def _block(texts: list[bytes]) -> tuple[tb.Words, tb.PrefixHash]:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    w = tb.words(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum(size)])
    return w, tb.PrefixHash(w.data)


def _least(key: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of the same key, the one of the smallest rank and that of the largest, for each row."""
    order = np.lexsort((rank, key))
    k = key[order]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    least, most = np.empty_like(order), np.empty_like(order)
    least[order] = order[new][group]
    most[order] = order[np.r_[new[1:], True]][group] if len(k) else order
    return least, most


def solver(window: int, grain: int):
    levels = [min(window, grain << n) for n in range(1, 32) if grain << (n - 1) < window]

    def solve(group: np.ndarray, rank: np.ndarray, texts: list[bytes], left: np.ndarray):
        w, p = _block(texts)
        first, last = w.first[:-1], w.first[1:]
        anchor = first + left
        # a run is an anchor and the number of words before it; all that hold the grain, if whole
        which, before = np.arange(len(texts)), np.zeros(len(texts), np.int64)
        length = grain
        for to in levels:
            step = to - length
            which = np.repeat(which, step + 1)
            before = np.repeat(before, step + 1) + np.tile(np.arange(step + 1), len(before))
            pair = np.unique(which * (window + 1) + before)
            which, before = pair // (window + 1), pair % (window + 1)
            start = anchor[which] - before
            ok = (start >= first[which]) & (start + to <= last[which])
            which, before, start = which[ok], before[ok], start[ok]
            least, most = _least(p.of(w.start[start], w.end[start + to - 1]), rank[which])
            earliest = which[least], before[least]
            alive = rank[earliest[0]] < rank[which[most]]
            which, before, length = which[alive], before[alive], to
            earliest = tuple(x[alive] for x in earliest)
        counts = rank[which] > rank[earliest[0]]
        which, before, earliest = which[counts], before[counts], tuple(x[counts] for x in earliest)
        # which and before are sorted: the first and the last run of each anchor bound what it covers
        new = np.r_[True, which[1:] != which[:-1]] if len(which) else np.zeros(0, bool)
        low, high = np.flatnonzero(new), np.flatnonzero(np.r_[new[1:], True][: len(new)])
        text, at, upto = w.data.tobytes(), w.start.tolist(), w.end.tolist()

        def bytes_of(who: np.ndarray, ahead: np.ndarray) -> list[bytes]:
            return [text[at[i] : upto[i + window - 1]] for i in (anchor[who] - ahead).tolist()]

        for edge in (low, high):
            if bytes_of(which[edge], before[edge]) != bytes_of(*(x[edge] for x in earliest)):
                return exactly(rank, texts, left)
        return which[low], before[high], window - before[low]

    def exactly(rank: np.ndarray, texts: list[bytes], left: np.ndarray):
        """The same from the words alone, where a hash has collided."""
        seen: dict[tuple[int, tuple], int] = {}
        places = []
        for i, (t, n) in enumerate(zip(texts, left.tolist(), strict=True)):
            own = t.split(b" ")
            places += [(i, a, (a, tuple(own[n - a : n - a + window]))) for a in range(min(n, window - grain) + 1) if n - a + window <= len(own)]
        for i, _, key in places:
            seen[key] = min(seen.get(key, rank[i]), rank[i])
        found: dict[int, list[int]] = {}
        for i, a, key in places:
            if rank[i] > seen[key]:
                found.setdefault(i, []).append(a)
        which = np.array(sorted(found), dtype=np.int64)
        return which, np.array([max(found[i]) for i in which.tolist()], np.int64), np.array([window - min(found[i]) for i in which.tolist()], np.int64)

    return solve


def opener(window: int):
    def windows(left: np.ndarray, texts: list[bytes]):
        w, _ = _block(texts)
        left = left.astype(np.int64)
        which = np.repeat(np.arange(len(texts)), left + 1)
        before = np.arange(len(which)) - np.repeat(np.cumsum(left + 1) - (left + 1), left + 1)
        start = (w.first[:-1] + left)[which] - before
        ok = start + window <= w.first[1:][which]
        which, before, start = which[ok], before[ok], start[ok]
        text = w.data.tobytes()
        return which, *an.digests([text[a:b] for a, b in zip(w.start[start].tolist(), w.end[start + window - 1].tolist(), strict=True)], before.tolist()), before

    return windows


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, grain: int = GRAIN, crowd: int = an.CROWD, bits: int = 64) -> DataFrame:
    """(id, n_words, removed, kept) of every row: its words without those that a window of
    ``window`` words covers which also starts in a row of smaller id; kept: the others joined by one
    space, removed: array of (lo, hi), the maximal runs of removed words.

    Null text has no words; ids are integers or of another type that has an order; rows of one id
    don't remove each other's words; a null id is larger than any; texts of any length are read whole, in
    stretches; an empty table gives an empty one; other columns are ignored."""
    shape = an.Shape(words=True, window=window, grain=grain, ranked=True, bits=bits)
    joined = an.covered(an.texts_of(df, id_col, text_col, ranked=True), shape, solver(window, grain), opener(window), crowd)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, cut = an.list_parts(batch.column(2), ("lo", "hi"))
            for lo, hi, data, at in tb.blocks(batch.column(1)):
                w = tb.words(data, at)
                removed, kept = [], []
                gone = np.zeros(len(w.start), bool)
                for i in range(lo, hi):
                    if cut[i] == cut[i + 1]:
                        removed.append([])
                        continue
                    a, b = w.first[i - lo], w.first[i - lo + 1]
                    gone[a:b] = an.mask(int(b - a), *(x[cut[i] : cut[i + 1]] for x in parts))
                    edge = np.flatnonzero(np.diff(np.r_[False, gone[a:b], False]))
                    removed.append([{"lo": x, "hi": y} for x, y in edge.reshape(-1, 2).tolist()])
                size = w.end - w.start + 1
                out = w.data[np.repeat(~gone, size)]
                upto = np.r_[0, np.cumsum(np.where(gone, 0, size))]
                for i in range(hi - lo):
                    kept.append(out[upto[w.first[i]] : max(upto[w.first[i]], upto[w.first[i + 1]] - 1)].tobytes().decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(w.first).astype(np.int64)), pa.array(removed, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), pa.array(kept, pa.string())],
                    names=["id", "n_words", "removed", "kept"],
                )

    return joined.mapInArrow(run, f"id {kind}, n_words bigint, removed array<struct<lo:int,hi:int>>, kept string").withColumnRenamed("id", id_col)
