"""Approximate nearest neighbours with an inverted multi-index.

Both halves of a vector are quantised by a codebook of their own, and the pair of centroids is its
cell. A query visits cells in order of the summed distance of its halves to the two centroids, by
a heap over the sorted rows and columns, until it has met its share of all vectors; those are then
ranked by exact distance. The share is what a few probes need to meet their true neighbours in the
whole table, so it falls as the table grows denser."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import staged

#: Nearest vectors of a query; centroids of each half at least and at most (in between, as many as
#: give cells of ``CELL`` vectors); sample vectors that fit them, for each centroid and at least;
#: recall that the visited share is fitted to; probes that it is fitted on.
NEAREST, CENTROIDS, CELL, PER_CENTROID, SAMPLE, RECALL, PROBES = 10, (16, 256), 1024, 64, 8192, 0.96, 128
#: Vectors of a block, and queries that a block meets in one task.
BLOCK, QUERIES = 16384, 1 << 20


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def nearest_pairs(qi: np.ndarray, q: np.ndarray, ei: np.ndarray, e: np.ndarray, mean: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, distance) of the nearest entries of other ids, ties to the smaller id, by
    places in q and e. A matrix product of vectors less the mean, whose rounding error follows
    their norms, picks those that are ranked by the differences of the vectors themselves."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    if not len(e):
        return tuple(x[0] for x in out)
    near = e - mean
    far = (near * near).sum(1).max()
    for lo in range(0, len(qi), 256):
        part = q[lo : lo + 256]
        own = part - mean
        d = _distances(own, near)
        d[qi[lo : lo + 256, None] == ei[None, :]] = np.inf
        k = min(nearest, d.shape[1]) - 1
        edge = np.partition(d, k, axis=1)[:, k] + 1e-12 * ((own * own).sum(1) + far)
        i, j = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
        exact = np.concatenate([np.zeros(0), *(np.sqrt(((part[i[n : n + 65536]] - e[j[n : n + 65536]]) ** 2).sum(1)) for n in range(0, len(i), 65536))])
        order = np.lexsort((ei[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < nearest
        for x, y in zip(out, (lo + i, j, exact), strict=True):
            x.append(y[first])
    return tuple(np.concatenate(x) for x in out)


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct rows; fewer if there are fewer."""
    rows = np.unique(x, axis=0)
    c = rows[np.random.default_rng(seed).permutation(len(rows))[:k]]
    for _ in range(rounds):
        own = _distances(x, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class Index:
    """Two codebooks over vectors less the sample's mean."""

    def __init__(self, sample: np.ndarray, k: int = CENTROIDS[0]):
        self.mean, self.cut = sample.mean(0), sample.shape[1] // 2
        x = sample - self.mean
        self.books = codebook(x[:, : self.cut], k), codebook(x[:, self.cut :], k)
        self.size = len(self.books[0]) * len(self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        x = x - self.mean
        a, b = _distances(x[:, : self.cut], self.books[0]), _distances(x[:, self.cut :], self.books[1])
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Cells by summed distance of both halves of one query."""
        q = q - self.mean
        a = _distances(q[None, : self.cut], self.books[0])[0]
        b = _distances(q[None, self.cut :], self.books[1])[0]
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b = a[i].tolist(), b[j].tolist()
        heap, row = [(a[0] + b[0], 0, 0)], [0] * len(a)
        while heap:
            _, x, y = heapq.heappop(heap)
            yield int(i[x]) * len(j) + int(j[y])
            row[x] = y + 1
            if y + 1 < len(b) and (x == 0 or row[x - 1] > y + 1):
                heapq.heappush(heap, (a[x] + b[y + 1], x, y + 1))
            if x + 1 < len(a) and row[x + 1] == y:
                heapq.heappush(heap, (a[x + 1] + b[y], x + 1, y))

    def visited(self, q: np.ndarray, counts: np.ndarray, least: float) -> list[int]:
        """Cells to visit until they hold ``least`` vectors; empty ones are left out."""
        out, met = [], 0
        for cell in self.visit(q):
            if met >= least:
                break
            if counts[cell]:
                out.append(cell)
                met += int(counts[cell])
        return out

    def needed(self, q: np.ndarray, counts: np.ndarray, cells: list[int]) -> list[float]:
        """Share of all vectors that one query has met when it has visited each of the cells."""
        order = np.fromiter(self.visit(q), np.int64)
        upto, place = np.cumsum(counts[order]), np.empty(self.size, np.int64)
        place[order] = np.arange(len(order))
        return (upto[place[cells]] / max(1, counts.sum())).tolist()


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part: id an integer, vector not null, every component finite,
    not all of them zero."""
    v = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = df.select(F.col(id_col).try_cast("bigint").alias("id"), v.alias("v")).where("id is not null and v is not null")
    return rows.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))


_FOUND = "query_id bigint, vec_id bigint, score double"


def search(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, nearest: int = NEAREST, centroids: tuple[int, int] = CENTROIDS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each row whose id is divisible by
    ``every``, by Euclidean distance on the original vectors, ties to the smaller id.

    Codebooks are fitted on a bounded sample (vectors of the smallest hash of their id), the visited
    share on ``PROBES`` of them against all vectors; every vector is indexed. A query never meets
    rows of its own id; a query id that repeats is asked once, with its smallest vector; other
    repeated rows are candidates each. Vectors that are null, zero or not finite are left out, and
    rows whose id isn't an integer. Between vectors of different lengths there is no distance: each
    length is searched by itself. With fewer candidates than ``nearest`` all are returned; an empty
    table gives none."""
    rows = usable(df, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").collect()
    met = [_search(rows.where(F.size("v") == r["length"]), r["count"], every, nearest, centroids, recall, block) for r in lengths]
    found = met[0] if met else df.sparkSession.createDataFrame([], _FOUND)
    for more in met[1:]:
        found = found.union(more)
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
    return best.select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, n: int, every: int, nearest: int, centroids: tuple[int, int], recall: float, block: int) -> DataFrame:
    """The nearest found in each block that a query visits, for ``n`` vectors of one length.

    Vectors are dealt to blocks of cells (a hot cell is cut by hash), once for each ``QUERIES``
    queries; a query goes to the blocks that hold cells it visits. A task holds one block at a time
    and streams its queries past it."""
    spark = rows.sparkSession
    k = min(max(int(np.ceil(np.sqrt(n / CELL))), centroids[0]), centroids[1])
    picked = rows.orderBy(F.xxhash64("id"), "id", "v").limit(max(SAMPLE, PER_CENTROID * k)).collect()
    sample = np.array([r["v"] for r in picked])
    index = Index(sample, k)
    probes, probe_ids = sample[:PROBES], np.array([r["id"] for r in picked[:PROBES]])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.cells(_matrix(batch.column(1))).astype(np.int32))], names=["id", "v", "cell"])

    entries = staged(rows.mapInArrow(placed, "id bigint, v array<double>, cell int"))
    counts = np.zeros(index.size, np.int64)  # as long as the codebooks allow, whatever the rows
    for r in entries.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = np.arange(len(probes))
                # places stand for probes; an entry of a probe's id isn't its neighbour
                ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
                i, j, d = nearest_pairs(probe_ids, probes, ids, x, index.mean, nearest)
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(ids[j]), pa.array(batch.column(2).to_numpy()[j]), pa.array(d)], names=["probe", "id", "cell", "d"])

    order = W.partitionBy("probe").orderBy("d", "id")
    true = entries.mapInArrow(probed, "probe bigint, id bigint, cell int, d double")
    true = true.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= nearest).groupBy("probe").agg(F.collect_list("cell").alias("cells"))
    shares = [x for r in true.collect() for x in index.needed(probes[r["probe"]], counts, r["cells"])]
    least = max((float(np.quantile(shares, recall)) if shares else 1.0) * n, 10 * nearest)
    # consecutive cells share a block until it is full; a cell that is larger has several
    first, cuts, here, room = np.zeros(index.size, np.int64), np.ones(index.size, np.int64), 0, block
    for cell in np.flatnonzero(counts).tolist():
        if counts[cell] > room and room < block:
            here, room = here + 1, block
        first[cell], cuts[cell] = here, max(1, -(-counts[cell] // block))
        here, room = (here + cuts[cell], block) if cuts[cell] > 1 else (here, room - counts[cell])
    shared = spark.sparkContext.broadcast((index, counts, first, cuts))  # bounded by ``centroids``

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, counts, first, cuts = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            owner, blocks = [], []
            for i, q in enumerate(_matrix(batch.column(1))):
                cells = np.array(index.visited(q, counts, least), np.int64)
                to = np.unique(np.repeat(first[cells], cuts[cells]) + np.arange(cuts[cells].sum()) - np.repeat(np.cumsum(cuts[cells]) - cuts[cells], cuts[cells]))
                owner.append(np.full(len(to), i))
                blocks.append(to)
            take = pa.array(np.concatenate(owner))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(blocks))], names=["id", "v", "block"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, first, cuts = shared.value
        for batch in batches:
            if batch.num_rows:
                ids, cell = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first[cell] + (h % cuts[cell].astype(np.uint64)).astype(np.int64))], names=["id", "v", "block"])

    parts = max(1, -(-(n // every) // QUERIES))
    kind = "id bigint, v array<double>, block bigint"
    queries = entries.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    ask = queries.mapInArrow(routed, kind).select("id", "v", "block", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.lit(True).alias("asks"))
    have = entries.mapInArrow(dealt, kind).select("id", "v", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"), F.lit(False).alias("asks"))
    mean = index.mean

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            where, asks = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()]), batch.column(4).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.r_[True, (where[:, 1:] != where[:, :-1]).any(0) | (asks[1:] != asks[:-1]), True])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if at != tuple(where[:, a]):
                    at, held = tuple(where[:, a]), []
                if not asks[a]:
                    held.append((ids[a:b], x[a:b]))
                elif held:
                    held = [tuple(map(np.concatenate, zip(*held, strict=True)))]
                    i, j, d = nearest_pairs(ids[a:b], x[a:b], *held[0], mean, nearest)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][i]), pa.array(held[0][0][j]), pa.array(d)], names=["query_id", "vec_id", "score"])

    met = have.union(ask).repartition("block", "part").sortWithinPartitions("block", "part", "asks")
    return met.mapInArrow(ranked, _FOUND)
