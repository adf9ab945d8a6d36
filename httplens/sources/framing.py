"""Framing of raw corpora: where one message ends and the next begins, found by many tasks in one file.

A message's end depends on its Content-Length, and a body may hold anything, request lines too. So

1. lines are read by byte ranges and put together to chunks of about ``CHUNK`` bytes that end after an
   empty line: no head lies across two of them;
2. in each chunk every place that looks like a request line gives an edge, from there to the end that
   its head names. All ends outside the chunk are places where a message may begin in another one;
3. for each such entry, and for each chunk's start, the chain of messages from there is followed to
   where it leaves the chunk. Which of these jumps start at byte 0 is told by pointer doubling,
   with the number of messages on the way, which is the sequence;
4. chunks are cut at the chain's places; messages that lie across chunks are put together.

A row is never larger than a chunk, a line, a stretch without empty lines or a message."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written

#: Bytes of a chunk, but for what reaches to the next empty line.
CHUNK = 1 << 20
#: Chunks of a task.
CHUNKS = 64

#: What a first line must be, in strict and in lenient framing.
PARTS = re.compile(rb"(\S+)\s+(.+?)\s+HTTP/(\S+)[\r\n]*\Z")
_REQUEST = {True: re.compile(rb"\S+\s+.+?\s+HTTP/\S+\s*\Z"), False: PARTS}
#: The end of such a line, whatever stands before.
_ENDING = {True: re.compile(rb"(?m)[ \t\r\f\v]HTTP/\S+[ \t\r\f\v]*$"), False: re.compile(rb"(?m)[ \t\r\f\v]HTTP/\S+\r*$")}
_EMPTY = {True: re.compile(rb"(?m)^\r?\n"), False: re.compile(rb"(?m)^(?:\r*\n|\r+\Z)")}
_GAP = re.compile(rb"\n\r?\n")
_BLANKS = re.compile(rb"(?:\r?\n)*")
_OUTSIDE = re.compile(rb"[^\r\n][^\n]*")
_LENGTH = re.compile(rb"(?mi)^[ \t\r\f\v]*content-length[ \t\r\f\v]*:([^\n]*)")
#: A field with its folded lines; folded lines belong to a field with a name only. Or a line without a colon.
_FIELD = re.compile(rb"(?m)^(?:([^:\n]*[^:\s][^:\n]*):([^\n]*(?:\n[ \t][^\n]*)*)|([^:\n]*):([^\n]*)|([^\n]+))\n?")


def fields(head: bytes) -> tuple[list[tuple[str, str]], list[str], int]:
    """Names (lower case) with values, lines without a colon, and folded lines of a lenient head."""
    found, malformed, folded = [], [], 0
    for m in _FIELD.finditer(head):
        if m[5] is not None:
            malformed.append(m[5].rstrip(b"\r").decode("latin-1"))
            continue
        first, *more = (m[2] if m[1] is not None else m[4]).decode("latin-1").split("\n")
        name = (m[1] if m[1] is not None else m[3]).decode("latin-1").lower().strip()[:120]
        found.append((name, " ".join(x.strip() for x in (first, *more))))
        folded += len(more)
    return found, malformed, folded


def end_of_head(raw: bytes, stop: int) -> tuple[int, int]:
    """Begin and end of the empty line after a lenient message's head; both its size if there is none."""
    found = _EMPTY[False].search(raw, stop)
    return found.span() if found else (len(raw), len(raw))


def body_size(values: list[str]) -> int:
    """The last Content-Length; -1 if it isn't one, 0 if there is none."""
    try:
        return max(-1, int(values[-1])) if values else 0
    except ValueError:
        return -1


class Span(NamedTuple):
    """A message's place in its chunk; its end may lie outside. ``outside``: lines before it that are
    no message's."""

    start: int
    end: int
    outside: int


class Chunk:
    """Candidates for first lines in a chunk, with the end that each one's head names."""

    def __init__(self, data: bytes, rest: int, strict: bool):
        """``rest``: bytes of the file after the chunk."""
        self.data, self.strict, self.size = data, strict, len(data) + rest
        tokens = [m.start() for m in _ENDING[strict].finditer(data)]
        self.starts = [data.rfind(b"\n", 0, t) + 1 for t in tokens]
        self.stops = [(data.find(b"\n", t) + 1) or len(data) for t in tokens]
        self.empty = [m.start() for m in _EMPTY[strict].finditer(data)]
        self.after = [m.end() for m in _EMPTY[strict].finditer(data)]
        lengths = list(_LENGTH.finditer(data)) if strict else []
        self.length_at, self.lengths = [m.start() for m in lengths], [m[1] for m in lengths]

    def end(self, k: int) -> int | str:
        """Where a message ends whose first line is candidate k, or why it can't be one."""
        stop = self.stops[k]
        n = bisect_left(self.empty, stop)
        if n == len(self.empty):
            return "end of file inside headers" if self.strict else len(self.data)
        if self.strict:
            own = self.lengths[bisect_left(self.length_at, stop) : bisect_left(self.length_at, self.empty[n])]
            sizes = [body_size([v.decode("latin-1")]) for v in own]
            if -1 in sizes:
                return "Content-Length is no number of bytes"
            size = sizes[-1] if sizes else 0
        else:
            head = self.data[stop : self.empty[n]]
            size = max(0, body_size([v for name, v in fields(head)[0] if name == "content-length"])) if b"content-length" in head.lower() else 0
        end = self.after[n] + size
        if end > self.size:
            return "body is cut off" if self.strict else self.size
        return end

    def first(self, p: int) -> tuple[int | None, int]:
        """(candidate, start) of the first message at or after p; (None, size of the chunk) if there is none."""
        for k in range(bisect_right(self.stops, p), len(self.stops)):
            start = max(p, self.starts[k])
            if _REQUEST[self.strict].match(self.data, start, self.stops[k]):
                return k, start
        return None, len(self.data)

    def exits(self) -> list[int]:
        """Ends of candidates that lie outside the chunk."""
        ends = (self.end(k) for k in range(len(self.stops)))
        return sorted({e for e in ends if isinstance(e, int) and len(self.data) < e < self.size})

    def jumps(self, entries: list[int]) -> Iterator[tuple[int, int, int]]:
        """(entry, where the chain of messages from there leaves the chunk, messages on the way). What
        can't be a message ends the chain with the file: ``walk`` tells why, if it is the right one."""
        leave: list[tuple[int, int]] = [(0, 0)] * len(self.stops)

        def onward(p: int) -> tuple[int, int]:
            if p >= len(self.data):
                return p, 0
            k, _ = self.first(p)
            return (len(self.data), 0) if k is None else leave[k]

        for k in range(len(self.stops) - 1, -1, -1):
            end = self.end(k)
            to, n = (self.size, 0) if isinstance(end, str) else onward(end)
            leave[k] = to, n + 1
        for p in entries:
            yield p, *onward(p)

    def walk(self, p: int) -> Iterator[Span | int]:
        """Messages from p on, and at last the lines after them that are no message's."""
        while p < len(self.data):
            k, start = self.first(p)
            gap = self.data[p:start]
            if self.strict and not _BLANKS.fullmatch(gap):
                raise ValueError(f"not a request line: {gap.lstrip()[:80]!r}")
            outside = 0 if self.strict else len(_OUTSIDE.findall(gap))
            if k is None:
                yield outside
                return
            if isinstance(end := self.end(k), str):
                raise ValueError(end)
            yield Span(start, end, outside)
            p = end
        yield 0


def _table(columns: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), columns.values(), strict=True)] if rows else [pa.array([], t) for t in columns.values()], names=list(columns))


_PIECE = {"file": pa.int64(), "block": pa.int64(), "nth": pa.int64(), "offset": pa.int64(), "ended": pa.bool_(), "data": pa.binary()}


def _pieces(lines: DataFrame, size: int) -> DataFrame:
    """Lines (file, block, value) of each byte range put together; all pieces of a block but its last
    end after an empty line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, seen, nth, offset = None, bytearray(), 0, 0, 0

        def given(upto: int, ended: bool) -> pa.RecordBatch:
            nonlocal held, seen, nth, offset
            row = (*at, nth, offset, ended, bytes(held[:upto]))
            held, seen, nth, offset = held[upto:], 0, nth + 1, offset + upto
            return _table(_PIECE, [row])

        def block_end() -> Iterator[pa.RecordBatch]:
            cut = max(held.rfind(b"\n\n") + 2, held.rfind(b"\n\r\n") + 3)
            if cut > 2:
                yield given(cut, True)
            yield given(len(held), False)

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi == lo:
                    continue
                if at not in (None, keys[lo]):
                    yield from block_end()
                if at != keys[lo]:
                    at, held, seen, nth, offset = keys[lo], bytearray(), 0, 0, 0
                held += b"\n".join([x or b"" for x in batch.column(2).slice(lo, hi - lo).to_pylist()]) + b"\n"
                while len(held) >= size:
                    if (gap := _GAP.search(held, max(seen, size - 3, 0))) is None:
                        seen = len(held) - 2
                        break
                    yield given(gap.end(), True)
        if at is not None:
            yield from block_end()

    return lines.mapInArrow(run, "file bigint, block bigint, nth bigint, offset bigint, ended boolean, data binary")


def chunks(spark: SparkSession, path: str, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """((file, path) of each file, (file, chunk, at, rest, data): its bytes in chunks from byte ``at``
    on, with so many bytes after them)."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_size"))
    key = F.xxhash64("path")
    names = listed.select(key.alias("file"), "path", "file_size")
    if not names.groupBy("file").count().where("count > 1").isEmpty():
        raise ValueError("two paths have one hash")
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    pieces = written(_pieces(lines, size))
    # A row for each byte range of a file: bytes and whole pieces before it.
    blocks = pieces.groupBy("file", "block").agg(F.sum(F.octet_length("data")).alias("bytes"), F.sum(F.col("ended").cast("bigint")).alias("whole"))
    order = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy("file")
    blocks = blocks.join(names.select("file", "file_size"), "file").select(
        "file", "block", F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("before"), F.coalesce(F.sum("whole").over(order), F.lit(0)).alias("earlier"),
        (F.sum("bytes").over(every) - F.col("file_size")).alias("more"), F.sum("bytes").over(every).alias("total"), "file_size",
    )
    # The reader ends the last line with a line feed that may not be there, and leaves out a byte order mark.
    extra = F.when(F.col("more").isin(1, -2), 1).otherwise(0)
    mark = F.when(F.col("more").isin(-3, -2), 3).otherwise(0)
    at = F.col("before") + F.col("offset")
    own = pieces.join(blocks, ["file", "block"]).withColumns({"extra": extra, "mark": mark, "from": at})
    cut = F.substr("data", F.lit(1), F.octet_length("data") - F.col("extra"))
    data = F.when((F.col("extra") > 0) & (F.col("from") + F.octet_length("data") == F.col("total")), cut).otherwise(F.col("data"))
    data = F.when((F.col("mark") > 0) & (F.col("from") == 0), F.concat(F.lit(b"\xef\xbb\xbf"), data)).otherwise(data)
    own = own.select(
        "file", (F.col("earlier") + F.col("nth")).alias("chunk"), F.when(F.col("from") > 0, F.col("from") + F.col("mark")).otherwise(F.lit(0)).alias("at"),
        (F.col("ended") & (F.col("nth") > 0)).alias("alone"), (F.col("total") + F.col("mark") - F.col("extra")).alias("size"), data.alias("data"),
    )
    # Pieces at the edges of a byte range belong together; the others are chunks as they are.
    part = F.array_sort(F.collect_list(F.struct("at", "data")))
    joined = own.where("not alone").groupBy("file", "chunk", "size").agg(part.alias("part")).select("file", "chunk", F.col("part")[0]["at"].alias("at"), "size", F.aggregate("part.data", F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b)).alias("data"))
    whole = own.where("alone").select("file", "chunk", "at", "size", "data").union(joined)
    whole = whole.where(F.octet_length("data") > 0).withColumn("rest", F.col("size") - F.col("at") - F.octet_length("data"))
    return names.select("file", "path"), written(whole.select("file", "chunk", "at", "rest", "data"))


def _located(places: DataFrame, index: DataFrame, size: int) -> DataFrame:
    """``places`` (file, p, ...) with the chunk that holds byte p: they meet in cells of ``size`` bytes."""
    cells = index.select("file", "chunk", F.col("at").alias("lo"), F.col("stop").alias("hi"), F.explode(F.sequence(F.expr(f"at div {size}"), F.expr(f"(stop - 1) div {size}"))).alias("cell"))
    return places.withColumn("cell", F.expr(f"p div {size}")).join(cells, ["file", "cell"]).where("p >= lo and p < hi").drop("cell", "lo", "hi")


_FRAME = {"file": pa.int64(), "sequence": pa.int64(), "place": pa.int64(), "part": pa.bool_(), "raw": pa.binary(), "outside": pa.int64()}


def frame(spark: SparkSession, path: str, strict: bool, size: int = CHUNK) -> DataFrame:
    """(path, sequence, raw, outside): the messages of each file under ``path``, numbered from 0.

    Strict framing fails on anything that is neither a message nor an empty line between two;
    lenient framing counts such lines: ``outside`` are those before a message in its chunk, and rows
    without raw and sequence carry those after a chunk's last message."""
    names, data = chunks(spark, path, size)
    index = data.select("file", "chunk", "at", (F.col("at") + F.octet_length("data")).alias("stop"), "rest")
    every, most = index.groupBy("file").count().agg(F.sum("count"), F.max("count")).first()
    # Text packs well, so that partitions of few bytes may hold much to do: they are told by chunks.
    spread = data.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), (every or 0) // CHUNKS + 1), "file", "chunk")

    def leaving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                rows += [(r["file"], r["at"] + e) for e in Chunk(r["data"], r["rest"], strict).exits()]
            yield _table({"file": pa.int64(), "p": pa.int64()}, rows)

    entries = data.mapInArrow(leaving, "file bigint, p bigint").union(index.select("file", F.col("at").alias("p"))).distinct()
    entries = _located(entries, index, size).groupBy("file", "chunk").agg(F.array_sort(F.collect_list("p")).alias("entries"))

    def jumping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                found = Chunk(r["data"], r["rest"], strict).jumps([p - r["at"] for p in r["entries"]])
                rows += [(r["file"], r["chunk"], p + r["at"], to + r["at"], n) for p, to, n in found]
            yield _table({"file": pa.int64(), "chunk": pa.int64(), "p": pa.int64(), "to": pa.int64(), "n": pa.int64()}, rows)

    edges = written(spread.join(entries, ["file", "chunk"]).select("file", "chunk", "at", "rest", "data", "entries").mapInArrow(jumping, "file bigint, chunk bigint, p bigint, to bigint, n bigint"))
    chain = edges.where("p = 0").select("file", "p", F.lit(0).cast("bigint").alias("rank"))
    jump = edges.select("file", "p", "to", "n")
    done = 1
    while done < (most or 0):  # chain: the first ``done`` of each file; jump: over so many
        more = chain.join(jump, ["file", "p"]).select("file", F.col("to").alias("p"), (F.col("rank") + F.col("n")).alias("rank"))
        chain = written(chain.union(more))
        on = jump.select("file", F.col("p").alias("to"), F.col("to").alias("then"), F.col("n").alias("more"))
        jump = written(jump.join(on, ["file", "to"]).select("file", "p", F.col("then").alias("to"), (F.col("n") + F.col("more")).alias("n")))
        done *= 2
    right = written(edges.join(chain, ["file", "p"]))
    across = right.where("n > 0").join(index.select("file", "chunk", "stop"), ["file", "chunk"]).where("to > stop")
    across = across.select("file", (F.col("to") - 1).alias("p"), F.col("chunk").alias("begun"), (F.col("rank") + F.col("n") - 1).alias("last"), F.col("to").alias("last_to"))
    tails = _located(across, index, size).select("file", F.explode(F.sequence(F.col("begun") + 1, "chunk")).alias("chunk"), "last", "last_to")

    def cut(parts: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    rows, own, at = [], r["data"], r["at"]
                    if r["last"] is not None:
                        rows.append((r["file"], r["last"], r["chunk"], True, own[: r["last_to"] - at], 0))
                    if r["p"] is not None:
                        n = r["rank"]
                        for x in Chunk(own, r["rest"], strict).walk(r["p"] - at):
                            if isinstance(x, int):
                                rows += [(r["file"], None, r["chunk"], False, None, x)] * (x > 0)
                            else:
                                rows.append((r["file"], n, r["chunk"], x.end > len(own), own[x.start : x.end], x.outside))
                                n += 1
                    yield _table(_FRAME, [x for x in rows if x[3] == parts])

        return run

    cuts = spread.join(right.select("file", "chunk", "p", "rank"), ["file", "chunk"], "left").join(tails, ["file", "chunk"], "left")
    cuts = cuts.select("file", "chunk", "at", "rest", "data", "p", "rank", "last", "last_to")
    schema = "file bigint, sequence bigint, place bigint, part boolean, raw binary, outside bigint"
    within = cuts.mapInArrow(cut(False), schema).select("file", "sequence", "raw", "outside")
    part = F.array_sort(F.collect_list(F.struct("place", "raw")))
    lying = cuts.mapInArrow(cut(True), schema).groupBy("file", "sequence").agg(part.alias("part"), F.sum("outside").alias("outside"))
    raw = F.aggregate("part.raw", F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    every = within.union(lying.select("file", "sequence", raw.alias("raw"), "outside"))
    return every.join(names, "file").select("path", "sequence", "raw", "outside")
