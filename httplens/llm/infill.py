"""Fill-in-middle transformation: texts cut into prefix, middle and suffix, and put together again in
the order in which a model learns to fill a gap.

An Arrow-batched pandas UDF does the whole of it: the regex library finds a text's units, whose end
offsets are kept in a compact array; the cuts are two look-ups in it; hashlib gives the numbers that
decide on cuts and form, and the digests."""

from __future__ import annotations

import hashlib
from array import array
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A unit of text: a code point.
CODE_POINT = r"(?s:.)"
#: Units found by one match at most: the library keeps the end of each.
RUN = 256


class Marks(NamedTuple):
    """What stands before each part. A text that holds one of them stays plain."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def check(self) -> None:
        """No mark may hold another, and no end of one begin another, or a text beside it could be taken for one."""
        apart = all(a not in b for i, a in enumerate(self) for j, b in enumerate(self) if i != j)
        if not all(self) or not apart or any(a[-n:] == b[:n] for a in self for b in self for n in range(1, min(len(a), len(b)) + (a != b))):
            raise ValueError(f"marks overlap: {tuple(self)}")


class Rates(NamedTuple):
    """Of 100 texts so many stay plain at the least, and so many of the others begin with the suffix."""

    plain: int = 10
    suffix_first: int = 20


def unit_ends(units: regex.Pattern, text: str) -> array:
    """The end of each unit of the text; ``units`` has a unit as its group 1, up to ``RUN`` times."""
    ends = array("q")
    for run in units.finditer(text, concurrent=False):
        ends.extend(run.ends(1))
    return ends


def units_of(unit: str) -> regex.Pattern:
    """Runs of units that follow each other, none of them empty, each as if found by itself."""
    return regex.compile(f"({unit}){{1,{RUN}}}+")


def draws(seed: str, key: str) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that a text's key decides."""
    told = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(told[i : i + 8], 16) for i in range(0, 32, 8))


def parts(text: str, ends: array, a: int, b: int) -> tuple[str, str, str]:
    """Prefix of ``a`` units, middle up to unit ``b``, suffix."""
    lo, hi = (ends[n - 1] if n else 0 for n in (a, b))
    return text[:lo], text[lo:hi], text[hi:]


def restore(output: str, form: str, marks: Marks = Marks()) -> str:
    """The text of an output."""
    if form == "plain":
        return output
    order = (marks.prefix, marks.suffix, marks.middle) if form == "psm" else (marks.suffix, marks.prefix, marks.middle)
    at = [output.index(m) for m in order]
    part = {m: output[i + len(m) : j] for m, i, j in zip(order, at, [*at[1:], len(output)], strict=True)}
    return part[marks.prefix] + part[marks.middle] + part[marks.suffix]


_FIELDS = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string, restored_sha256 string"


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, seed: str = "1", marks: Marks = Marks(), rates: Rates = Rates()) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256) of every row:
    n units, code points of prefix and middle (null if the form is plain), and the text as it is
    given to training: ``plain`` as it was, ``psm`` prefix, suffix, middle, ``spm`` suffix, prefix,
    middle, each part after its mark. restored_sha256 is of the text that ``restore`` gives.

    Null text counts as empty; an empty text, or one that holds a mark, stays plain; texts of any
    length are cut whole, with 8 bytes a unit beside them; what lies outside all units goes with the
    part before it, or with the suffix after the last cut. A null id draws as the empty string; rows
    that repeat an id draw the same numbers, and each is cut for itself, equal rows alike; there are
    no ties: both cuts may fall on one place, and then the middle is empty. An empty table gives an
    empty one; other columns are ignored."""
    marks.check()
    if regex.compile(unit).match(""):
        raise ValueError("a unit may not be empty")

    @F.pandas_udf(_FIELDS)
    def cut(key: pd.Series, text: pd.Series) -> pd.DataFrame:
        units, rows = units_of(unit), []
        for k, t in zip(key, text, strict=True):
            ends = unit_ends(units, t)
            n = len(ends)
            h1, h2, h3, h4 = draws(seed, k)
            if not t or any(m in t for m in marks) or h3 % 100 >= 100 - rates.plain:
                form, sizes, out = "plain", (None, None), t
            else:
                form = "spm" if h4 % 100 < rates.suffix_first else "psm"
                prefix, middle, suffix = parts(t, ends, *sorted((h1 % (n + 1), h2 % (n + 1))))
                sizes = len(prefix), len(middle)
                first = [marks.prefix + prefix, marks.suffix + suffix]
                out = "".join([*(first if form == "psm" else first[::-1]), marks.middle, middle])
            digests = [hashlib.sha256(x.encode()).hexdigest() for x in (out, restore(out, form, marks))]
            rows.append((n, form, *sizes, out, *digests))
        done = pd.DataFrame(rows, columns=[f.split()[0] for f in _FIELDS.split(", ")])
        return done.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), cut(key, text).alias("done")).select(F.col("id").alias(id_col), "done.*")
