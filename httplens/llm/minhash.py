"""Document fingerprints by MinHash: the smallest value of each of many universal hash functions
over a text's word shingles, in vectorised numpy; near-duplicates by joining bands of equal
values and verifying the Jaccard similarity of the shingle sets."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .components import connected_components
from .lineage import ordered_key, release, staged

#: Words of a shingle, hash functions, similarity that counts as near, values in a band.
WORDS, FUNCTIONS, SIMILAR, BAND = 5, 128, 0.8, 4

_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 31, 1024, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, 1024, dtype=np.uint32)


def shingle_hashes(w: tb.Words, k: int = WORDS, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit hash) of each run of k words of a block; a text of fewer words has one."""
    doc, begin, last = tb.windows(w.first, k, short)
    return doc, tb.PrefixHash(w.data).of(w.start[begin], w.end[last]) if len(doc) else np.zeros(0, np.uint64)


def signature(h: np.ndarray, functions: int = FUNCTIONS) -> np.ndarray:
    """The smallest a * x + b modulo 2^32 (a odd) over x in h for each of the functions; all ones
    for none."""
    out = np.full(functions, 0xFFFFFFFF, dtype=np.uint32)
    x = (h >> np.uint64(32)).astype(np.uint32)
    a, b = _A[:functions], _B[:functions]
    for lo in range(0, len(x), 512):
        part = x[lo : lo + 512, None] * a
        part += b
        np.minimum(out, part.min(axis=0), out=out)
    return out


def hexed(sig: np.ndarray) -> str:
    """The low 16 bits of each value, as hexadecimal: the fingerprint. (The smallest of many values
    are small, so it is the low bits that tell them apart.)"""
    return (sig & np.uint32(0xFFFF)).astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of functions on which two fingerprints agree, an estimate of the Jaccard similarity."""
    return float(((a ^ b) & np.uint32(0xFFFF) == 0).mean())


def _signed(raw: bytes, k: int, functions: int) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    return signature(shingle_hashes(tb.words(data, np.array([0, len(data)])), k)[1], functions)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, functions: int = FUNCTIONS) -> DataFrame:
    """(id, fingerprint) of every row. Null text counts as empty; texts without words share one
    fingerprint, as do equal texts; an empty table gives an empty one; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, at in tb.blocks(batch.column(1)):
                doc, h = shingle_hashes(tb.words(data, at), k)
                cut = np.searchsorted(doc, np.arange(len(at)))
                out += [hexed(signature(h[a:b], functions)) for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "fingerprint"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def _edited(text: bytes, after: bytes, k: int, functions: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Signatures of a text and of the text with its last third replaced from ``after``, and the
    edited text. Shingles of words that lie whole in the part that stays are hashed once."""
    points = text.decode("utf-8", "replace")
    n = len(points) // 3
    stays = points[: len(points) - n].encode()
    edited = stays + after.decode("utf-8", "replace")[:n].encode()
    raw = np.frombuffer(text, np.uint8)
    h = shingle_hashes(tb.words(raw, np.array([0, len(raw)])), k)[1]
    solid = ~tb.spaces(raw[: len(stays)])
    begins = np.flatnonzero(solid & ~np.r_[False, solid[:-1]])
    same = len(begins) - bool(len(solid) and solid[-1])  # the last word may go on otherwise
    if same < k:
        return signature(h, functions), _signed(edited, k, functions), edited
    common = signature(h[: same - k + 1], functions)
    own = np.minimum(common, signature(h[same - k + 1 :], functions))
    tail = np.frombuffer(edited, np.uint8)[begins[same - k + 1] :]
    new = shingle_hashes(tb.words(tail, np.array([0, len(tail)])), k, short=False)[1]
    return own, np.minimum(common, signature(new, functions)), edited


#: Rows of a range of ids, ranges at most, and rows sampled for each range.
RANGE, RANGES, SAMPLED = 5000, 1 << 16, 30
_CHAINED = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KEY = "struct<rank:bigint,h:bigint>"


def _cuts(keys: DataFrame, parts: int) -> list[tuple[int, int]]:
    """At most parts - 1 of the keys (rank, h), ascending and less than the largest, that cut the rows
    into ranges of like size: of a sample of about ``SAMPLED`` rows for each range, by hash."""
    if parts < 2:
        return []
    n, most = keys.agg(F.count("*"), F.max(F.struct("rank", "h"))).first()
    some = keys.where(F.pmod(F.xxhash64("h", "rank"), F.lit(max(1, n // (SAMPLED * parts)))) == 0)
    found = sorted(map(tuple, some.collect()))
    return sorted({found[len(found) * i // parts] for i in range(1, parts)} - {tuple(most)}) if found else []


def _place(cuts: list[tuple[int, int]], key: F.Column) -> F.Column:
    """Number of cuts at or above the key, looked up among groups of cuts and then in one of them."""
    if not cuts:
        return F.lit(0)
    step = int(len(cuts) ** 0.5) + 1
    told = [[{"rank": r, "h": h} for r, h in cuts[lo : lo + step]] for lo in range(0, len(cuts), step)]
    table = F.from_json(F.lit(json.dumps([{"top": g[-1], "own": g} for g in told])), f"array<struct<top:{_KEY},own:array<{_KEY}>>>")
    below = F.size(F.filter(table, lambda g: g["top"] < key))
    own = F.size(F.filter(F.try_element_at(table, below + 1)["own"], lambda c: c < key))
    return F.lit(len(cuts)) - F.when(below < len(told), below * step + own).otherwise(F.lit(len(cuts)))


def chained(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, functions: int = FUNCTIONS, per_range: int = RANGE) -> DataFrame:
    """Every row with what follows it by descending id (after the last: the first): (id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has the last third of the code points replaced by as many of the next row's
    first ones. Rows are dealt by ranges of the id and a hash of the text, each range streams in
    order, and its last row meets a copy of the next range's first: one shuffle of the texts,
    whatever their number, and neither one id nor null holds a range together.

    Null text counts as empty; ids are integers or of another type that has an order; rows of one
    id follow each other by a hash of the text (equal rows share a range); null ids come last; a
    single row follows itself; texts of any length are read whole, two at a time; an empty table gives
    an empty one; other columns are ignored."""
    kind = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = ordered_key(df.select(F.col(id_col).alias("id"), text.alias("text")), "id", "rank", nulls=-(1 << 63))
    rows = rows.select("id", "rank", F.xxhash64("text").alias("h"), "text")
    cuts = _cuts(rows.select("rank", "h"), min(RANGES, -(-rows.count() // per_range)))
    rows = rows.withColumn("place", _place(cuts, F.struct("rank", "h")))
    firsts = rows.groupBy("place").agg(F.max(F.struct("rank", "h")).alias("first")).select("first.*", F.lit(True).alias("leads"))
    rows = rows.join(F.broadcast(firsts), ["rank", "h"], "left")  # a row for each range, RANGES at most
    dealt = rows.withColumn("tail", F.explode(F.when(F.col("leads"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    dealt = dealt.withColumn("place", F.when(F.col("tail"), F.pmod(F.col("place") - 1, F.lit(len(cuts) + 1))).otherwise(F.col("place")))
    dealt = dealt.repartition("place").sortWithinPartitions("place", "tail", F.desc("rank"), F.desc("h"), "text").select("id", "tail", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row whose next is still to come
        waits: list = []  # a finished row but for near_next, and its signature

        def met(sig: np.ndarray) -> None:
            for row, own in waits:
                for x, y in zip(out, (*row, likeness(own, sig)), strict=True):
                    x.append(y)
            waits.clear()

        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            ids, tails = batch.column(0), batch.column(1).to_pylist()
            for lo, _, data, at in tb.blocks(batch.column(2)):
                raw = data.tobytes()
                for i in range(len(at) - 1):
                    now, tail = raw[at[i] : at[i + 1]], tails[lo + i]
                    if last is not None:
                        own, edited, text = _edited(last[1], now, k, functions)
                        met(own)
                        waits.append(((last[0], len(last[1].decode("utf-8", "replace")), hashlib.sha256(text).hexdigest(), hexed(own), hexed(edited), likeness(own, edited)), own))
                        if tail:
                            met(_signed(now, k, functions))
                    last = None if tail else (ids[lo + i].as_py(), now)
            kinds = [ids.type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = ["id", *(c.split()[0] for c in _CHAINED.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)

    return dealt.mapInArrow(run, f"id {kind}, {_CHAINED}").withColumnRenamed("id", id_col)


#: Rounds in which the members of a bucket meet one representative each, one round if a block holds the rest.
ROUNDS = 6
#: Readings of the table for sets, each of its own part of the rows, so that disk holds the texts of one.
READINGS = 2
#: Texts and shingles of a block, about; bins in which the shingles of two texts are counted before they are compared.
MEMBERS, SHINGLES, BINS = 2048, 1 << 19, 256
#: Shingles that go to pairs or blocks at a time: a share of those of all texts, and how many at least.
PART, LEAST = 0.25, 1 << 24


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, k: int = WORDS, functions: int = FUNCTIONS, band: int = BAND, rounds: int = ROUNDS) -> DataFrame:
    """(id, class_id) of every row: class_id is the smallest id of all that it reaches over pairs of
    texts of ``similar`` Jaccard similarity or more.

    Rows of equal shingle sets stand as one text. Texts that agree on all of a band of ``band``
    values share a bucket, and are compared on their whole shingle sets. Only the bands of a text are
    written; the sets of those that share a bucket are told from the table again, which has to give
    the same rows twice. A bucket isn't opened into pairs: in each round its members meet one of them,
    those it is similar to join its class, and buckets of one class are done; what is still apart meets
    in blocks, as soon as one block holds it or after ``rounds``. No link is lost but those that no
    band shows, with a chance of (1 - s^band)^(functions / band) at similarity s: 5e-8 at 0.8. Null
    text is empty; texts without words form one class; repeated rows and ids give a row each; null ids
    belong to classes but name none (null only if all are); texts of any length are read whole, and
    their set of shingles is a row; an empty table gives an empty one; other columns, whatever their
    names, are ignored."""

    def sets_of(column: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray], pa.Array]]:
        for lo, hi, data, at in tb.blocks(column):
            doc, h = shingle_hashes(tb.words(data, at), k)
            cut = np.searchsorted(doc, np.arange(len(at)))
            sets = [np.unique(h[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
            yield lo, hi, sets, pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, sets, own in sets_of(batch.column(2)):
                keys = [[int.from_bytes(hashlib.blake2b(bytes([j]) + x.tobytes(), digest_size=8).digest(), "little", signed=True) for j, x in enumerate(signature(s, functions).reshape(-1, band))] for s in sets]
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), own, sizes, pa.array(keys, pa.list_(pa.int64()))], names=["id", "at", "own", "n", "bands"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets, own in sets_of(batch.column(0)):
                yield pa.RecordBatch.from_arrays([own, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["own", "shingles"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", F.xxhash64("id", "text").alias("at"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    signed = staged(rows.mapInArrow(sign, f"id {kind}, at bigint, own binary, n bigint, bands array<bigint>"))
    texts = staged(signed.groupBy("own").agg(F.min("id").alias("least"), F.min("at").alias("at"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    keyed = texts.select("own", "n", F.explode("bands").alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    pending = staged(keyed.join(full, "key").select("key", "own", "n"))
    # sets that share no bucket are never written; another row of the same hash is read for nothing
    again = texts.join(pending.select("own").distinct(), "own", "left_semi").select("at")
    chosen = lambda n: rows.where(F.pmod("at", F.lit(READINGS)) == n).join(again, "at", "left_semi").select("text")
    sets = staged(*(chosen(n).mapInArrow(read, "own binary, shingles array<bigint>").groupBy("own").agg(F.first("shingles").alias("shingles")) for n in range(READINGS)))
    links, root = pending.select(F.col("own").alias("a"), F.col("own").alias("b")).limit(0), None
    # sets of too different a size have no such part in common
    sized = lambda a, b: F.least(a, b) >= F.lit(similar) * F.greatest(a, b)
    part = max(LEAST, int(PART * (texts.agg(F.sum("n")).first()[0] or 0)))
    waiting, written = [], [pending]
    for _ in range(rounds):
        if pending.isEmpty():
            break
        rep = pending.groupBy("key").agg(F.min(F.struct("own", "n")).alias("first")).select("key", F.col("first.own").alias("rep"), F.col("first.n").alias("of"))
        met = pending.join(rep, "key").where("own <> rep").where(sized(F.col("n"), F.col("of")))
        met = staged(met.select(F.col("rep").alias("a"), F.col("own").alias("b"), "of").distinct())
        links, root = _joined(links, root, *(_verified(some, sets, similar) for some in _parts(met, "of", part, "b")))
        release(met)
        left = pending.join(rep, "key").where("own <> rep").select("key", "own", "n")
        written.append(staged(left.join(_apart(_rooted(left, root)), "key").select("key", "own", "n", "of")))
        pending = written[-1].where("of > 1").drop("of")
        waiting.append(written[-1].where("of = 1").drop("of"))
    if root is None:
        root = connected_components(links)
    left = reduce(DataFrame.union, waiting, pending)
    if not left.isEmpty():
        links, root = _joined(links, root, _blocks(_rooted(left, root), sets, similar, part))
    classes = staged(_rooted(texts.select("own", "least"), root))
    release(texts, sets, *written, links, root)
    least = classes.groupBy("root").agg(F.min("least").alias("class_id"))
    told = classes.join(least, "root").select("own", "class_id")
    return signed.select("id", "own").join(told, "own").select(F.col("id").alias(id_col), "class_id")


def _joined(links: DataFrame, root: DataFrame | None, *more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with more of them, one frame after the other, and their components, written anew."""
    after = staged(links, *more)
    release(links, *more, *([] if root is None else [root]))
    return after, connected_components(after)


def _parts(rows: DataFrame, size: str, most: int, *keys: str) -> list[DataFrame]:
    """The rows by a hash of their keys, in parts whose sizes sum up to about ``most``."""
    n = -(-(rows.agg(F.sum(size)).first()[0] or 0) // most) or 1
    return [rows.where(F.pmod(F.xxhash64(*keys), F.lit(n)) == i).drop(size) for i in range(n)]


def _rooted(texts: DataFrame, root: DataFrame) -> DataFrame:
    """Texts (own, ...) with the root of their class."""
    return texts.join(root, texts["own"] == root["node"], "left").select(*texts.columns, F.coalesce("root", "own").alias("root"))


def _apart(left: DataFrame) -> DataFrame:
    """(key, of) of each bucket that holds several classes: in how many blocks it is met, as many as its
    texts or its shingles ask for."""
    of = F.ceil(F.greatest(F.count("*") / F.lit(MEMBERS), F.sum("n") / F.lit(SHINGLES))).cast("int")
    return left.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), of.alias("of")).where("lo <> hi").select("key", "of")


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Of pairs (a, b), those whose sets are similar enough."""
    left = sets.select(F.col("own").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("own").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    union = F.size("sa") + F.size("sb") - F.col("common")
    return both.where((union > 0) & (F.col("common") >= F.lit(similar) * union)).select("a", "b")


def _blocks(left: DataFrame, sets: DataFrame, similar: float, part: int) -> DataFrame:
    """Links enough to tell the classes of the texts (key, own, n, root) of each bucket.

    A bucket is dealt into blocks by a hash, each two of its blocks meet in a task, and texts of
    different classes are compared there. Disk holds the sets of about ``part`` shingles, or of one
    pair of blocks, at a time: pairs of blocks go one part after the other."""
    left = staged(left)
    dealt = left.join(_apart(left), "key").withColumn("block", F.pmod(F.xxhash64("own"), "of").cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    dealt = dealt.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "own", "root", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            found = []
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j")), strict=True))
            own, root, block = (batch.column(c).to_pylist() for c in ("own", "root", "block"))
            lists = batch.column("shingles")
            values, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
            for n, key in enumerate(keys):
                if key != at:
                    found += _linked(held, similar)
                    at, held = key, []
                held.append((own[n], root[n], block[n], values[cuts[n] : cuts[n + 1]].view(np.uint64)))
            yield _pairs(found)
        yield _pairs(_linked(held, similar))

    met = (some.join(sets, "own").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j") for some in _parts(dealt, "n", part, "key", "i", "j"))
    out = staged(*(some.mapInArrow(run, "a binary, b binary") for some in met))
    release(left)
    return out


def _pairs(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _linked(texts: list[tuple[bytes, bytes, int, np.ndarray]], similar: float) -> list[tuple[bytes, bytes]]:
    """Pairs of similar texts (own, root, block, set) that join what is in different classes so far;
    of two blocks, only texts of different ones meet. Texts that differ too much in the numbers of
    shingles of each bin can't have enough in common; all others are compared whole."""
    if len(texts) < 2:
        return []
    own, roots, blocks, sets = zip(*texts, strict=True)
    root = np.unique(np.array([r.hex() for r in roots]), return_inverse=True)[1]
    block, size = np.array(blocks), np.array([len(s) for s in sets])
    two = (block != block[0]).any()
    counts = np.array([np.bincount((s % np.uint64(BINS)).astype(np.int64), minlength=BINS) for s in sets])
    counts = counts.astype(np.uint8 if counts.max() < 256 else np.uint32)
    out = []
    for x in range(len(sets) - 1):
        y = np.arange(x + 1, len(sets))
        y = y[(root[y] != root[x]) & ((block[y] != block[x]) | (not two)) & (np.minimum(size[y], size[x]) >= similar * np.maximum(size[y], size[x]))]
        near = y[_enough(np.minimum(counts[y], counts[x]).sum(axis=1, dtype=np.int64), size[y] + size[x], similar)]
        for y in near.tolist():
            if root[y] != root[x] and _enough(len(np.intersect1d(sets[x], sets[y], assume_unique=True)), size[y] + size[x], similar):
                out.append((own[x], own[y]))
                root[root == root[y]] = root[x]
    return out


def _enough(common: np.ndarray, both: np.ndarray, similar: float) -> np.ndarray:
    """Whether so many common shingles make sets of ``both`` together similar."""
    return (both > common) & (common >= similar * (both - common))
