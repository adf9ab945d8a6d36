"""Best-fit packing of documents into sequences of a fixed number of tokens.

1. Texts become token ids, are cut into pieces of at most a sequence, and every task numbers its
   pieces of each length. All that goes on to the plan is the histogram of lengths.
2. The plan is a configuration linear program: how often is each combination of lengths that fits a
   sequence used, so that all pieces are covered by as few sequences as possible? Multiplicative
   weights solve it: lengths that are left over cost more, and a knapsack by dynamic programming finds
   the most valuable combinations at these prices.
3. The fractions are rounded along their cumulative sum, and what the roundings leave goes where it
   fits best, longest first.
4. Each piece looks up its place by its length and its number among pieces of that length.

The plan's size depends on the capacity, not on the number of documents."""

from __future__ import annotations

import bisect
import functools
import json
import math
import os
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textblocks as tb
from .bpe import byte_letters
from .lineage import staged

#: Default vocabulary, by name in the folder of public tokenizers.
VOCABULARY = "word_bpe_49k.json"
#: Tokens of a sequence, and the id that ends each document.
CAPACITY, END = 2048, 0
#: Rounds that set the weights, and rounds that take an equal part of all pieces each; one gives at most
#: a configuration for each length.
ROUNDS = 32
#: By how much a length of which all is left over gets dearer in the first round (as a power of e).
RATE = 1.0
#: Words whose ids a task remembers, twice so many at most, and the bytes of the longest such word.
WORDS, WORD = 1 << 18, 64


#: Bytes of text that are encoded at a time.
BLOCK = 1 << 20


class Encoder:
    """Ids as the tokenizers library gives them.

    White space parts whatever the vocabulary's pre-tokeniser takes, so each word's ids are those of
    the word alone and can be remembered. Words of plain Latin letters and signs that aren't known
    yet are merged here, if the vocabulary file is of the kind for which that is the same; others
    go through the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.merger = _merger(spec)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers, little-endian."""
        if len(self.known) > WORDS:  # words seen since then move on, the others are forgotten next time
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        split = [t.split() for t in texts]
        ids = [list(map(known.get, words)) for words in split]
        new = {w for words, own in zip(split, ids, strict=True) for w, x in zip(words, own, strict=True) if x is None}
        found = {w: older[w] for w in new if w in older}
        found |= self._words([w for w in new if w not in found])
        known.update((w, x) for w, x in found.items() if len(w) <= WORD)
        return [b"".join([found[w] if x is None else x for w, x in zip(words, own, strict=True)]) for words, own in zip(split, ids, strict=True)]

    def _words(self, words: list[bytes]) -> dict[bytes, bytes]:
        here, rest, pieces, ends = [], [], [], []
        for w in words:
            text = w.decode("utf-8", "replace")
            plain = text.isprintable() if text.isascii() else _PLAIN.fullmatch(text)
            if self.merger is None or not plain or any(s in text for s in self.special):
                rest.append((w, text))
                continue
            text = text.lower()
            if text.isalpha():
                pieces.append(text)
            else:
                pieces += self.merger.cut.findall(text)
            here.append(w)
            ends.append(len(pieces))
        told = self.library.encode_batch_fast([text for _, text in rest], add_special_tokens=False)
        out = {w: np.array(e.ids, dtype="<u4").tobytes() for (w, _), e in zip(rest, told, strict=True)}
        if here:
            ids = np.array(self.merger.core.encode_ordinary(_CLOSE.join(pieces) + _CLOSE), dtype="<u4")
            cuts = (4 * np.r_[0, np.flatnonzero(self.merger.closes[ids]) + 1][[0, *ends]]).tolist()
            raw = ids.tobytes()
            out |= {w: raw[a:b] for w, a, b in zip(here, cuts, cuts[1:], strict=False)}
        return out


#: Characters that are as they are composed, and whose lower case has one form whatever stands around.
_PLAIN = regex.compile(r"[\x21-\x7E\xA1-\u012F\u0131-\u024F]*")
#: A character that no plain word has: the end of a piece.
_CLOSE = "\0"


class _Merger(NamedTuple):
    """Cuts a word into pieces, encodes pieces that ``_CLOSE`` ends, and tells which ids end a piece."""

    cut: regex.Pattern
    core: tiktoken.Encoding
    closes: np.ndarray


def _merger(spec: dict) -> _Merger | None:
    """For a vocabulary file whose ids are in the order of its merges, those of single bytes at the
    end of a word before all others; None for files of another kind."""
    model, normal, before = spec["model"], spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
    kinds = [x["type"] for part, name in ((normal, "normalizers"), (before, "pretokenizers")) for x in part.get(name, [])]
    if kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or spec["post_processor"] or not model["end_of_word_suffix"] or model["dropout"]:
        return None
    split, end = before["pretokenizers"][0], model["end_of_word_suffix"]
    if not split["invert"] or split["behavior"] != "Removed" or before["pretokenizers"][1]["add_prefix_space"] or before["pretokenizers"][1]["use_regex"]:
        return None
    letters, ranks = byte_letters(), {}
    closes = np.zeros(max(model["vocab"].values()) + 1, bool)
    special = {t["content"] for t in spec["added_tokens"]}
    for text, n in model["vocab"].items():
        if text in special:
            continue
        closes[n] = text.endswith(end)
        raw = bytes(letters[c] for c in text.removesuffix(end if closes[n] else ""))
        if raw == b"\0" or 0 not in raw:
            ranks[raw + _CLOSE.encode() * bool(closes[n])] = n
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    single = [ranks.get(bytes([b, 0]), math.inf) for b in range(1, 256)]
    if merged != sorted(set(merged)) or max(single) >= merged[0]:
        return None
    core = tiktoken.Encoding("own", pat_str="[^\0]*\0", mergeable_ranks=ranks, special_tokens={})
    return _Merger(regex.compile(split["pattern"]["Regex"]), core, closes)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(df: DataFrame, id_col: str, text_col: str, path: str, capacity: int, end: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids, part, nth) of every piece: the task that made it,
    and its number among the task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        last = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for lo, _, data, at in tb.blocks(batch.column(1), BLOCK):
                raw, cuts = data.tobytes(), at.tolist()
                ids = [x + last for x in encoder(path).encode([raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])]
                sizes = np.array([len(x) // 4 for x in ids])
                number = -(-sizes // capacity)
                row = np.repeat(np.arange(len(ids)), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order])
                nth = np.empty(len(row), np.int64)
                nth[order] = seen[length[order]] + np.arange(len(row)) - first
                seen += np.bincount(length, minlength=capacity + 1)
                own = [ids[r][4 * a : 4 * (a + n)] for r, a, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row + lo)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int64)),
                        pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary()), pa.array(np.full(len(row), part, np.int32)), pa.array(nth),
                    ],
                    names=["id", "piece", "start", "length", "ids_crc32", "ids", "part", "nth"],
                )

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, part int, nth bigint")


class Knapsack:
    """The most valuable combinations of lengths within a capacity, each length as often as it fits."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()

    def solve(self, price: np.ndarray) -> None:
        best, item = np.zeros(self.capacity + 1), [-1] * (self.capacity + 1)
        for room in range(1, self.capacity + 1):
            best[room] = best[room - 1]
            if k := self.upto[room]:
                value = price[:k] + best[room - self.lengths[:k]]
                j = int(value.argmax())
                if value[j] > best[room]:
                    best[room], item[room] = value[j], j
        self.best, self.item = best, item

    def with_one(self, j: int) -> dict[int, int]:
        """The best combination that holds length ``j``: how often each length is in it."""
        out, room = Counter([j]), self.capacity - int(self.lengths[j])
        while room > 0:
            if (k := self.item[room]) < 0:
                room -= 1
            else:
                out[k] += 1
                room -= int(self.lengths[k])
        return dict(out)


Configuration = tuple[tuple[int, int], ...]  # (length, how often), longest first


def relaxed(lengths: np.ndarray, number: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> tuple[list[tuple[dict[int, int], float]], float]:
    """The linear program over configurations: (places of lengths, how often) and a lower bound on
    the number of sequences, from the best of the prices tried.

    A length's price is its share of a sequence, times its weight. Each round hands out pieces to the
    best configurations that hold each length, most valuable first; a length of which some are left
    over is multiplied up by the part left, against the mean. The first ``rounds`` hand out all
    pieces and only set the weights; as many follow that take an equal part of what there is."""
    total, out, bound = number.astype(float), [], least(lengths, number, capacity)
    left, weight = total.copy(), np.zeros(len(lengths))
    sack = Knapsack(lengths, capacity)
    for r in range(2 * rounds):
        price = lengths / capacity * np.exp(weight)
        sack.solve(price)
        bound = max(bound, float((total * price).sum() / sack.best[capacity]))
        share = total if r < rounds else left / (2 * rounds - r)
        given, rest = _handed_out(sack, price, share)
        if r >= rounds:
            out += given
            left = np.maximum(left - (share - rest), 0)
        short = rest / np.maximum(share, 1e-300)
        weight += rate / (1 + 4 * r / rounds) * (short - np.average(short, weights=total * lengths))
    return out, bound


def _handed_out(sack: Knapsack, price: np.ndarray, share: np.ndarray) -> tuple[list[tuple[dict[int, int], float]], np.ndarray]:
    """Configurations with how often each is used, until one of its lengths runs out; what is left."""
    out, rest = [], share.tolist()
    value = price + sack.best[sack.capacity - sack.lengths]
    for j in np.lexsort((-sack.lengths, -np.round(value, 9))).tolist():
        if rest[j] > 0:
            held = sack.with_one(j)
            times = min(rest[i] / k for i, k in held.items())
            if times > 0:
                out.append((held, times))
                for i, k in held.items():
                    rest[i] -= k * times
    return out, np.maximum(rest, 0)


def least(lengths: np.ndarray, number: np.ndarray, capacity: int) -> float:
    """Sequences that are needed at the least: those over half a sequence need one each, and what room
    they leave may hold others, but none beside a length that leaves less than the others have. And
    of lengths from t on no more fit than t says."""
    words = lengths * number
    best = max(words.sum() / capacity, (np.cumsum(number[::-1])[::-1] / (capacity // lengths)).max())
    large = lengths * 2 > capacity
    for t in lengths[~large].tolist():
        full, half = lengths > capacity - t, large & (lengths <= capacity - t)
        rest = words[~large & (lengths >= t)].sum() - (number[half] * capacity - words[half]).sum()
        best = max(best, float(number[full].sum() + number[half].sum() + max(0, rest) / capacity))
    return max(best, float(number[large].sum()))


def rounded(lengths: np.ndarray, number: np.ndarray, capacity: int, program: list[tuple[dict[int, int], float]]) -> list[tuple[Configuration, int]]:
    """Whole configurations with how often each is used, which hold all pieces and no more. Each is
    used as often as its share of the cumulative sum says, as long as there are pieces; what is left
    goes, longest first, where least room stays."""
    left = number.tolist()
    size = lengths.tolist()
    runs: list[tuple[dict[int, int], int]] = []
    done, upto = 0, 0.0
    for held, times in sorted(program, key=lambda x: sorted(x[0].items(), reverse=True)):
        upto += times
        want = int(upto + 0.5) - done
        done += want
        held = dict(held)
        while want > 0 and held:
            can = min(want, *(left[i] // k for i, k in held.items()))
            if can:
                runs.append((dict(held), can))
                for i, k in held.items():
                    left[i] -= k * can
                want -= can
            held = {i: min(k, left[i]) for i, k in held.items() if left[i]}
    rooms: dict[int, list[tuple[dict[int, int], int]]] = {}
    for held, times in runs:
        rooms.setdefault(capacity - sum(size[i] * k for i, k in held.items()), []).append((held, times))
    order = sorted(rooms)
    for j in range(len(size) - 1, -1, -1):
        while left[j]:
            at = bisect.bisect_left(order, size[j])
            if at == len(order):  # opens sequences that hold this length as often as it fits
                most = capacity // size[j]
                for k, times in ((most, left[j] // most), (left[j] % most, 1)):
                    if k and times:
                        _put(rooms, order, capacity - k * size[j], ({j: k}, times))
                break
            room = order[at]
            held, times = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], order[at]
            k = min(left[j], times)
            left[j] -= k
            _put(rooms, order, room - size[j], (held | {j: held.get(j, 0) + 1}, k))
            if times > k:
                _put(rooms, order, room, (held, times - k))
    merged: Counter[Configuration] = Counter()
    for same in rooms.values():
        for held, times in same:
            merged[tuple(sorted(((size[i], k) for i, k in held.items()), reverse=True))] += times
    return sorted(merged.items(), reverse=True)


def _put(rooms: dict, order: list[int], room: int, run: tuple[dict[int, int], int]) -> None:
    if room not in rooms:
        bisect.insort(order, room)
        rooms[room] = []
    rooms[room].append(run)


class Plan(NamedTuple):
    """Where the pieces of each length go: those numbered from ``rank`` on stand ``each`` times in
    every sequence from ``sequence`` on, at ``offset`` and following."""

    key: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    bound: float

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        at = np.searchsorted(self.key, _key(length, rank), side="right") - 1
        nth = rank - (self.key[at] & ((1 << 50) - 1))
        return self.sequence[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def _key(length, rank):
    return (length << 50) | rank


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, rate: float = RATE) -> Plan:
    """The plan for so many pieces of each length. Pieces of the whole capacity fill a sequence each.
    At most rounds + 2 configurations a length are made, whatever the numbers of pieces."""
    lengths = np.array(sorted(n for n in histogram if n < capacity), np.int64)
    number = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    used, bound = [], 0.0
    if len(lengths):
        program, bound = relaxed(lengths, number, capacity, rounds, rate)
        used = rounded(lengths, number, capacity, program)
    if full := histogram.get(capacity, 0):
        used.append((((capacity, 1),), full))
    rank: Counter[int] = Counter()
    rows, first = [], 0
    for held, times in used:
        offset = 0
        for length, k in held:
            rows.append((_key(length, rank[length]), k, first, offset))
            rank[length] += k * times
            offset += k * length
        first += times
    assert dict(rank) == {n: k for n, k in histogram.items() if k}
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return Plan(*(np.ascontiguousarray(c) for c in columns), first, math.ceil(bound - 1e-6) + full)


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END, rounds: int = ROUNDS, rate: float = RATE
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids, sequence_id, offset) of every piece: its ids
    (unsigned 32-bit, little-endian) stand in its sequence from ``offset`` on, without gaps.

    A document is its ids, then ``end``; only documents longer than ``capacity`` are cut, and only
    their last piece may be shorter. Null and empty texts are ``end`` alone; texts of any length are
    taken whole; rows that repeat an id or a text, and null ids, are packed each for itself; pieces
    of one length stand in order of the tasks that made them; an empty table gives an empty one;
    other columns are ignored. ``path``: the vocabulary file, which every executor must have.

    The driver holds the histogram (a row for each length) and the plan; the plan is broadcast."""
    spark = df.sparkSession
    made = staged(pieces(df, id_col, text_col, path or vocabulary_path(), capacity, end))
    counts = staged(made.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    told = spark.sparkContext.broadcast(plan(histogram, capacity, rounds, rate))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = made.join(counts, ["part", "length"]).withColumn("rank", F.col("earlier") + F.col("nth"))

    def place(length: pa.Array, rank: pa.Array) -> tuple[pa.Array, pa.Array]:
        return tuple(map(pa.array, told.value.place(length.to_numpy(), rank.to_numpy())))

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def placed(length: pa.Array, rank: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(place(length, rank), names=["sequence_id", "offset"])

    out = ranked.withColumn("at", placed("length", "rank"))
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "ids", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of every sequence of ``pack``: what a training job reads. A sequence
    is of a bounded size, so gathering it in one row is safe."""
    own = F.struct("offset", "ids", "length")
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(own)).alias("p"))
    ids = F.aggregate("p.ids", F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x))
    return held.select("sequence_id", F.aggregate("p.length", F.lit(0).cast("bigint"), lambda n, x: n + x).alias("length"), ids.alias("ids"))
