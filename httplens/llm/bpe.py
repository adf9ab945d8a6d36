"""BPE encoding and decoding with public vocabularies, by tree concatenation.

A text longer than a leaf is halved, wherever the middle falls, down to leaves, which are encoded
for themselves, and neighbours are joined up the tree: the tokens around each join are encoded
again, in a window that doubles until both sides agree exactly. A side agrees

- at a place where the pre-tokeniser cuts whatever lies around it (see ``_CUTS``): the tokens on its
  far side can't depend on the other text; or
- where the whole window is letters alone, digits alone, signs alone or blanks alone, and lies
  within one piece: if its outermost token is the one that side already has. A sequence of tokens
  is the encoding of its bytes exactly if each adjacent pair is."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textblocks as tb

#: Default vocabulary, by name in the folder of public tokenizers.
VOCABULARY = "byte_bpe_50k.json"
#: Characters of a leaf at most.
LEAF = 1024
#: Tokens of each side in the first window around a join.
NEAR = 4

# Fixed value: the pre-tokeniser's pattern for byte-level vocabularies of this kind.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Places where that pattern cuts in any context: before a space that follows something else; between
# letters and digits; before a sign that follows either; after a sign (but an apostrophe, which may
# begin a contraction) that either follows. None is within blanks, and matching never looks back.
_BLANK, _SIGN = r"\p{White_Space}", r"[^\p{White_Space}\p{L}\p{N}]"
_CUTS = rf"(?<=\P{{White_Space}})(?={_BLANK})|(?<=\p{{L}})(?=\p{{N}})|(?<=\p{{N}})(?=\p{{L}})|(?<=[\p{{L}}\p{{N}}])(?={_SIGN})|(?<={_SIGN})(?<!')(?=[\p{{L}}\p{{N}}])"
_ALIKE = rf"(?P<letters>\p{{L}}+)|(?P<digits>\p{{N}}+)|(?P<signs>{_SIGN}+)|(?P<blanks>{_BLANK}+)"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 stands for
    itself, the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, leaf: int = LEAF):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.leaf = leaf
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = {bytes(letters[c] for c in text): n for text, n in spec["model"]["vocab"].items() if text not in self.special}
        size = max([*self.ranks.values(), *self.special.values()]) + 1
        table = [b""] * size
        for raw, n in self.ranks.items():
            table[n] = raw
        for text, n in self.special.items():
            table[n] = text.encode()
        self.table = table
        self.inside = [x[:1] != b"" and x[0] & 0xC0 == 0x80 for x in table]  # begins within a character
        self.core = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=self.ranks, special_tokens={})
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cuts, self.alike = regex.compile(_CUTS), regex.compile(_ALIKE)
        self.single = self.core._core_bpe.encode_single_piece
        self.joins = self.windows = 0

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``; the strings of special tokens in it become their ids."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        out: list[int] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._plain(part)
        return out

    def _plain(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.core.encode_ordinary(text)
        parts = [text]
        while len(parts[0]) > self.leaf:
            parts = [half for p in parts for half in (p[: (len(p) + 1) // 2], p[(len(p) + 1) // 2 :])]
        if len(parts) >= 64:  # the encoder runs outside the interpreter's lock
            with ThreadPoolExecutor(min(8, os.cpu_count() or 1)) as pool:
                nodes = list(pool.map(self.core.encode_ordinary, parts))
        else:
            nodes = [self.core.encode_ordinary(p) for p in parts]
        while len(nodes) > 1:
            nodes = [self.join(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0]

    def join(self, left: list[int], right: list[int], window: int = NEAR) -> list[int]:
        """Ids of the concatenated texts of two encodings."""
        self.joins += 1
        if not left or not right:
            return left or right
        while True:
            self.windows += 1
            a, b = max(0, len(left) - window), min(window, len(right))
            while a > 0 and self.inside[left[a]]:  # whole characters
                a -= 1
            while b < len(right) and self.inside[right[b]]:
                b += 1
            before, after = (b"".join([self.table[t] for t in part]).decode() for part in (left[a:], right[:b]))
            told = self._cut_before(before, a == 0), self._cut_after(after, b == len(right))
            if None not in told:
                lo, hi = told
                again = self.core.encode_ordinary(before[lo:] + after[:hi])
                return [*left[: a + self._tokens(left[a:], before[:lo])], *again, *right[self._tokens(right[:b], after[:hi]) :]]
            if self._within(before + after, left[max(0, a - 1) : a], right[b : b + 4]):
                again = self.single((before + after).encode())
                if (a == 0 or again[0] == left[a]) and (b == len(right) or again[-1] == right[b - 1]):
                    return [*left[:a], *again, *right[b:]]
            window *= 2

    def _within(self, text: str, last: list[int], following: list[int]) -> bool:
        """Whether the text between these tokens is of one kind and lies within one piece: blanks do
        unless a sign or letter follows, which parts the last of them; letters do unless an
        apostrophe precedes, which takes some of them for a contraction."""
        if not (kind := self.alike.fullmatch(text)):
            return False
        if kind.lastgroup == "blanks":
            after = b"".join([self.table[t] for t in following]).decode("utf-8", "ignore")
            return not following or bool(self.alike.fullmatch(after[:1] + text[:1]))
        return not (kind.lastgroup == "letters" and last and self.table[last[0]].endswith(b"'"))

    def _cut_before(self, text: str, whole: bool) -> int | None:
        """The first sure cut in the left side's window; 0 if the window is the side."""
        cut = None if whole else self.cuts.search(text)
        return 0 if whole else cut and cut.start()

    def _cut_after(self, text: str, whole: bool) -> int | None:
        """The last sure cut in the right side's window; its end if the window is the side."""
        return len(text) if whole else max((cut.start() for cut in self.cuts.finditer(text)), default=None)

    def _tokens(self, ids: list[int], text: str) -> int:
        """Number of the first tokens that make up the text."""
        n, size = 0, len(text.encode())
        while size > 0:
            size -= len(self.table[ids[n]])
            n += 1
        return n

    def decode(self, ids) -> str:
        """Text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join([self.table[t] for t in ids]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def codec(path: str, leaf: int = LEAF) -> Codec:
    return Codec(path, leaf)


def _texts(column: pa.Array, size: int = 1 << 22) -> Iterator[tuple[int, int, list[str]]]:
    for lo, hi, data, at in tb.blocks(column, size):
        raw = data.tobytes()
        at = at.tolist()
        yield lo, hi, [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


def encode(df: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", path: str | None = None, leaf: int = LEAF, decoded: bool = False) -> DataFrame:
    """(id, ids[, decoded]) of every row. ids is binary: unsigned 32-bit, little-endian, the form
    in which token streams are stored. With ``decoded``, ids are decoded again in the same task.
    Without ``id_col``, (row, ids[, decoded]) with all columns of the row as a struct.

    Null or empty text has no ids and decodes to the empty string; long texts are encoded whole;
    repeated rows and null ids give a row each; an empty table gives an empty one; other columns
    are ignored. ``path``: the vocabulary file, which every executor must have."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, leaf)
        for batch in batches:
            for lo, hi, texts in _texts(batch.column(1)):
                ids = [c.encode(t) for t in texts]
                columns = [batch.column(0).slice(lo, hi - lo), pa.array([np.array(x, dtype="<u4").tobytes() for x in ids], pa.binary())]
                if decoded:
                    columns.append(pa.array([c.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "decoded"][: len(columns)])

    own = F.col(id_col) if id_col else F.struct(*[df[c] for c in df.columns])
    rows = df.select(own.alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("ids", T.BinaryType()), *([T.StructField("decoded", T.StringType())] * decoded)])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col or "row")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text) of every row of (id, ids); null ids decode to the empty string."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.frombuffer(x.as_py() or b"", dtype="<u4").tolist()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
