"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into k // 2 + 1 segments for links of up to k differing bits, so
that one segment differs by one bit at most. Each segment is indexed once per bit with that bit
wild, two linked fingerprints meet under at least one such key, and every meeting is verified on
all 64 bits. Only distinct fingerprints are indexed, so a group of exact copies is one row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .components import connected_components
from .lineage import scoped, staged

WORDS, SEED, BITS = 4, 42, 4
#: Fingerprints under one key that are compared in one task; larger groups are cut in blocks.
CROWD = 4096

_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint_block(data: np.ndarray, at: np.ndarray, k: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Unsigned fingerprints of a block's documents; 0 for one without words."""
    w = tb.words(data, at, lower=True)
    doc, begin, last = tb.windows(w.first, k, short=True)
    text, digest = w.data.tobytes(), xxhash.xxh64_intdigest
    spans = zip(w.start[begin].tolist(), w.end[last].tolist(), strict=True)
    h = np.fromiter((digest(text[s:e], seed) for s, e in spans), dtype=np.uint64, count=len(doc))
    number, n = len(at) - 1, np.diff(np.searchsorted(doc, np.arange(len(at))))
    out = np.zeros(number, dtype=np.uint64)
    for j, byte in enumerate(h.view(np.uint8).reshape(-1, 8).T):
        ones = np.bincount(doc * 256 + byte, minlength=256 * number).reshape(number, 256) @ _OF_BYTE
        bits = np.packbits((2 * ones > n[:, None]), axis=1, bitorder="little")[:, 0]
        out |= bits.astype(np.uint64) << np.uint64(8 * j)
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row, fp as a signed 64-bit integer. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint_block(data, at) for _, _, data, at in tb.blocks(batch.column(1))]
            fp = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def variant_masks(bits: int = BITS) -> list[int]:
    """The bits that each one-wildcard variant of each segment keeps."""
    parts = bits // 2 + 1
    cuts = [64 * i // parts for i in range(parts + 1)]
    whole = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [seg & ~(1 << j) for seg, lo, hi in zip(whole, cuts, cuts[1:], strict=False) for j in range(lo, hi)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: at most one edge less than
    nodes, found by breadth-first search over those not yet reached."""
    left, a, b = fp, [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = np.full(len(left), -1, dtype=np.int64)
            for lo in range(0, len(front), 256):
                todo = np.flatnonzero(reached < 0)
                near = np.bitwise_count(front[lo : lo + 256, None] ^ left[todo][None, :]) <= bits
                hit = near.any(axis=0)
                reached[todo[hit]] = lo + near[:, hit].argmax(axis=0)
            hit = reached >= 0
            a.append(front[reached[hit]])
            b.append(left[hit])
            front, left = left[hit], left[~hit]
    none = np.zeros(0, fp.dtype)
    return np.concatenate([*a, none]), np.concatenate([*b, none])


def _met(bits: int, crowd: int | None):
    """For rows (key, fp) sorted by key: verified edges (kind 0), and the rows of keys with more
    than ``crowd`` of them (kind 1), which pass through."""

    def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["kind", "a", "b"])

    def settle(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """key, fp: whole groups."""
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        size = np.diff(edge)
        small = np.repeat(size <= 48, size)
        k, f = key[small], fp[small]
        i, step = np.arange(len(k) - 1), 1
        while len(i):
            i = i[i + step < len(k)]
            i = i[k[i] == k[i + step]]
            hit = i[np.bitwise_count(f[i] ^ f[i + step]) <= bits]
            if len(hit):
                yield out(0, f[hit], f[hit + step])
            step += 1
        for lo, hi in zip(edge[:-1][size > 48], edge[1:][size > 48], strict=True):
            if crowd and hi - lo > crowd:
                yield out(1, key[lo:hi], fp[lo:hi])
            else:
                yield out(0, *forest(np.unique(fp[lo:hi]), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, hot = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if hot is not None:  # the rest of a group that has been passed on
                n = int(np.searchsorted(k, hot, side="right"))
                yield out(1, k[:n], f[:n])
                k, f = k[n:], f[n:]
                if not len(k):
                    continue
                hot = None
            key, fp = np.r_[key, k], np.r_[fp, f]
            whole = int(np.searchsorted(key, key[-1], side="left")) if len(key) else 0
            if whole:
                yield from settle(key[:whole], fp[:whole])
                key, fp = key[whole:], fp[whole:]
            if crowd and len(key) > crowd:
                hot = key[0]
                yield out(1, key, fp)
                key, fp = key[:0], fp[:0]
        if len(key):
            yield from settle(key, fp)

    return run


def links(distinct: DataFrame, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) whose components are those of all links among the distinct ``fp``.

    A key of more than ``crowd`` fingerprints is cut into blocks by hash, and each pair of blocks
    is compared in a task of its own, so no task holds a whole hot key and no link is lost."""
    masks = [_signed(m) for m in variant_masks(bits)]
    keys = F.explode(F.array(*[F.xxhash64(F.lit(v), F.col("fp").bitwiseAND(F.lit(m))) for v, m in enumerate(masks)]))
    schema = "kind tinyint, a bigint, b bigint"
    met = distinct.select(keys.alias("key"), "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_met(bits, crowd), schema)
    met = staged(met.distinct())
    hot = met.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    cuts = hot.groupBy("key").agg(F.ceil(F.count("*") / F.lit(crowd / 2)).cast("int").alias("n"))
    cut = hot.join(cuts, "key").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("n")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    rest = cut.select(cell.alias("key"), "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_met(bits, None), schema)
    return met.where("kind = 0").select("a", "b").union(rest.select("a", "b"))


def _grouped(own: DataFrame, least, bits: int) -> DataFrame:
    """(fp, least, root) of each distinct fingerprint of ``own``: ``least`` over its rows, and the
    fingerprint that stands for its component."""
    first = own.groupBy("fp").agg(least.alias("least"))
    with scoped(own.sparkSession) as keep:
        root = connected_components(links(own.select("fp").distinct(), bits))
        return keep(staged(first.join(root, first["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id, fingerprint, component_id) of every row: component_id is the smallest id reachable
    over fingerprints of at most ``bits`` differing bits.

    Null or wordless text has fingerprint zero and links like any other; repeated ids stay as
    rows and share a component with all that either links to; null ids take part in links but are
    never the smallest (null only if all are); there are no ties but equal ids, which are one; texts
    of any length are read whole, a block of texts or one long text at a time; an empty table gives an
    empty one; other columns are ignored."""
    own = staged(fingerprints(df, id_col, text_col))
    grouped = _grouped(own, F.min("id"), bits)
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = grouped.select("fp", "root").join(least, "root").select("fp", "component_id")
    out = own.join(by_fp, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row of ``df`` of each group of near-duplicates, all columns: that of the smallest id, null
    last; of rows that repeat the id, that of the smallest hash of the text; of rows equal in both, any.

    Null or wordless texts are a group like any other; an empty table gives an empty one; columns
    may have any names."""
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("h"))
    own = staged(fingerprints(df.select(place.alias("place"), F.col(text_col).cast("string").alias("text")), "place", "text"))
    firsts = _grouped(own, F.min("id"), bits).groupBy("root").agg(F.min("least").alias("p")).select("p.*")
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), place.alias("place")).select("row", "place.id", "place.h")
    kept = rows.join(firsts, rows["id"].eqNullSafe(firsts["id"]) & (rows["h"] == firsts["h"]), "left_semi")
    return kept.dropDuplicates(["id", "h"]).select("row.*")
