"""Compression of vectors to short codes: equal parts, each told by the number of its nearest entry in
that part's codebook.

Components are integers, floor(scale * x), so that sums over any number of tasks are exact and the
codebooks don't depend on how rows are spread. Each round broadcasts a kd-tree for every codebook;
tasks look up their vectors and add up the parts of each entry; the sums give the next entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import _record
from .lineage import staged

#: Parts of a vector, entries of a codebook, rounds of assignment and update.
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: A component is floor(SCALE * x).
SCALE = 4096
#: Components of a larger magnitude count as not finite (their integers stay below 2^57).
LARGEST = 2.0**45
#: Entries of a leaf.
LEAF = 4
#: Rows of one label are dealt over so many keys where they meet its sum.
SALTS = 32
#: Components at a time.
_BATCH = 1 << 19


class Node(NamedTuple):
    """A box that holds entries; a leaf names them, others have an axis and two halves of it."""

    low: np.ndarray
    high: np.ndarray
    entries: tuple[int, ...] = ()
    axis: int = 0
    at: int = 0
    halves: tuple[Node, Node] | None = None


class Tree:
    """A kd-tree over the entries of a codebook: rows of integers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._node(np.arange(len(entries)))

    def _node(self, which: np.ndarray) -> Node:
        own = self.entries[which]
        low, high = own.min(axis=0), own.max(axis=0)
        if len(which) <= LEAF:
            return Node(low, high, tuple(which.tolist()))
        axis = int((high - low).argmax())
        which = which[np.argsort(own[:, axis], kind="stable")]
        half = len(which) // 2
        return Node(low, high, (), axis, int(self.entries[which[half], axis]), (self._node(which[:half]), self._node(which[half:])))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for each row: the nearest, of equally near ones the lowest.

        Rows go down the tree together, each first to its own side; the other side is visited unless
        its box is farther than the best so far. A box as near may hold an equal of a lower index."""
        kind = x.dtype
        best, entry = np.full(len(x), -1, kind), np.full(len(x), -1)

        def visit(node: Node, rows: np.ndarray) -> None:
            if node.halves is None:
                own = x[rows]
                for e in node.entries:
                    gap = own - self.entries[e]
                    d = (gap * gap).sum(axis=1)
                    better = (entry[rows] < 0) | (d < best[rows]) | ((d == best[rows]) & (e < entry[rows]))
                    best[rows[better]], entry[rows[better]] = d[better], e
                return
            right = (x[rows, node.axis] >= node.at).astype(bool)
            for first, side in ((0, rows[~right]), (1, rows[right])):
                if len(side):
                    visit(node.halves[first], side)
                    other = node.halves[1 - first]
                    own = x[side]
                    gap = np.maximum(np.maximum(other.low - own, own - other.high), 0)
                    side = side[((gap * gap).sum(axis=1) <= best[side]).astype(bool)]
                    if len(side):
                        visit(other, side)

        visit(self.root, np.arange(len(x)))
        return entry, best


class Codebooks(NamedTuple):
    """Entries by part, entry and place within the part, as Python integers; none if there were no vectors."""

    entries: list[list[list[int]]]
    scale: int

    @property
    def size(self) -> int:
        """Components of a vector."""
        return sum(len(book[0]) for book in self.entries)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.entries for e in book for x in e).encode()).hexdigest()

    def trees(self, kind) -> list[Tree]:
        return [Tree(np.array(book, kind)) for book in self.entries]

    def largest(self) -> int:
        return max((abs(x) for book in self.entries for e in book for x in e), default=0)


def integers(vector, scale: int) -> F.Column:
    """floor(scale * x) of each component; null if the vector is null or holds what can't take part."""
    x = F.col(vector).cast("array<double>")
    whole = F.forall(x, lambda v: F.coalesce(F.abs(v) <= LARGEST, F.lit(False)))
    return F.when(whole, F.transform(x, lambda v: F.floor(v * scale).cast("bigint")))


def _batches(column: pa.Array, size: int, largest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows of components) of so many rows at a time, as 64-bit integers where their
    squared distances fit, otherwise as Python's."""
    step = max(1, _BATCH // size)
    for lo in range(0, len(column), step):
        part = column.slice(lo, step)
        x = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), size)
        most = max(largest, int(np.abs(x).max(initial=0)))
        yield lo, x if size * (2 * most) ** 2 < 1 << 63 else x.astype(object)


def _nearest(books: Codebooks, trees: dict, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, the rows' parts, their entries, their distances) for each part."""
    if x.dtype not in trees:
        trees[x.dtype] = books.trees(x.dtype)
    at = 0
    for p, tree in enumerate(trees[x.dtype]):
        own = x[:, at : (at := at + tree.entries.shape[1])]
        yield p, own, *tree.nearest(own)


def _sums(rows: DataFrame, books: Codebooks) -> dict[tuple[int, int, int], int]:
    """Sums of each entry's parts by (part, entry, place), and at place -1 their number."""
    told, size, largest = rows.sparkSession.sparkContext.broadcast(books), books.size, books.largest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], int] = {}
        trees: dict = {}
        for batch in batches:
            for _, x in _batches(batch.column(0), size, largest):
                for p, own, entry, _ in _nearest(told.value, trees, x):
                    for e in np.unique(entry).tolist():
                        mine = own[entry == e]
                        for j, n in enumerate([len(mine), *mine.sum(axis=0).tolist()], start=-1):
                            total[p, e, j] = total.get((p, e, j), 0) + n
        if total:
            part, entry, place = zip(*total, strict=True)
            yield _record(part=pa.array(part, pa.int32()), entry=pa.array(entry, pa.int32()), place=pa.array(place, pa.int32()), total=pa.array(list(total.values()), pa.decimal128(38)))

    each = rows.select("x").mapInArrow(run, "part int, entry int, place int, total decimal(38,0)")
    got = {(r["part"], r["entry"], r["place"]): int(r["total"]) for r in each.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()}
    told.unpersist()
    return got


def _fit(rows: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> Codebooks:
    """The codebooks of ``rows`` (id, x), which are read once a round. What is gathered is a row for
    each component of each codebook."""
    can = rows.where((F.size("x") > 0) & (F.size("x") % parts == 0))
    order = [F.col("id").asc_nulls_last(), "x"]
    if (first := can.orderBy(*order).select(F.size("x")).first()) is None:
        return Codebooks([], scale)
    own = can.where(F.size("x") == first[0])
    width = first[0] // parts
    start = [r["x"] for r in own.orderBy(*order).limit(entries).select("x").collect()]
    books = Codebooks([[x[p * width : (p + 1) * width] for x in start] for p in range(parts)], scale)
    for _ in range(rounds):
        total = _sums(own, books)
        moved = lambda p, e, old: [total[p, e, j] // n for j in range(width)] if (n := total.get((p, e, -1))) else old
        books = Codebooks([[moved(p, e, old) for e, old in enumerate(book)] for p, book in enumerate(books.entries)], scale)
    return books


def _assigned(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error) of (id, label, x)."""
    told, size, largest = rows.sparkSession.sparkContext.broadcast(books), books.size, books.largest()
    kind = rows.select("id", "label").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict = {}
        for batch in batches:
            for lo, x in _batches(batch.column(2), size, largest):
                codes, error = np.empty((len(x), len(told.value.entries)), np.uint8), np.zeros(len(x), x.dtype)
                for p, _, entry, d in _nearest(told.value, trees, x):
                    codes[:, p] = entry
                    error = error + d
                text = codes.tobytes().hex()
                step = 2 * codes.shape[1]
                error = [n if n < 1 << 63 else None for n in error.tolist()]
                part = [batch.column(i).slice(lo, len(x)) for i in (0, 1)]
                yield _record(id=part[0], label=part[1], code=pa.array([text[i : i + step] for i in range(0, len(text), step)]), error=pa.array(error, pa.int64()))

    fits = (F.size("x") == size) & F.lit(size > 0)
    coded = rows.where(fits).select("id", "label", "x").mapInArrow(run, kind.add("code", "string").add("error", "long")) if size else None
    stray = rows.where(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    return stray if coded is None else coded.union(stray)


def compress(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, Codebooks]:
    """(id, code, error, label_error, codebooks_sha256) of every row that takes part, and the codebooks
    with which ``decompress`` gives vectors back.

    Rows whose vector is null or holds a null, a NaN, an infinity or more than ``LARGEST`` are
    dropped. Codebooks start as the parts of the vectors of the ``entries`` (at most 256) smallest
    ids, null ids last, rows that repeat an id in order of their components; with fewer rows they
    have fewer entries. A part goes to the nearest entry, of equally near ones (equal entries, too)
    to the lowest; entries that nothing goes to stay. The vectors' length is that of the smallest id whose length divides
    into parts: rows of another length (empty ones, too) keep a row with null code and error.

    Null labels are one label; label_error is null if the label has no error, or one or their sum
    passes 64 bits. Very long vectors take memory for ``_BATCH`` components at a time or one vector.
    An empty table gives an empty one; other columns are ignored, whatever their names."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for a part")
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), integers(vector_col, scale).alias("x")).where("x is not null")
    rows = staged(rows)
    books = _fit(rows, parts, entries, rounds, scale)
    coded = staged(_assigned(rows, books))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")
    total = F.when(F.count("error") == F.count("code"), F.sum(F.col("error").cast("decimal(19,0)"))).try_cast("bigint")
    sums = coded.groupBy("label").agg(total.alias("label_error")).select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("dealt"))
    both = coded.withColumn("salt", salt).join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("dealt")))
    return both.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")), books


def decompress(coded: DataFrame, books: Codebooks, id_col: str = "vec_id", code_col: str = "code") -> DataFrame:
    """(id, vector) of every code: its entries, as multiples of 1 / scale; null where the code is."""
    part = []
    for p, book in enumerate(books.entries):
        nth = F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int") + 1
        part.append(F.element_at(F.lit([[x / books.scale for x in e] for e in book]), nth))
    vector = F.when(F.col(code_col).isNotNull(), F.concat(*part)) if part else F.lit(None).cast("array<double>")
    return coded.select(id_col, vector.alias("vector"))
