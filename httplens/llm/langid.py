"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text; a new text is cut
greedily into the longest phrases that the sample holds, and the language that needs the fewest
phrases for each letter wins. Transitions on a language's frequent letters are a dense table, those
on its rare ones a sorted list. Pieces of many texts are parsed in step, one letter of each at a
time; a piece begins a phrase of its own at first, and is then entered again from the end of the
piece before, up to the place where both parses begin a phrase, so that no cut shows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of the sample: documents of each language, letters of each document, documents in all
#: (each language has one at least, so this holds for up to as many languages).
DOCUMENTS, LETTERS, ALL_DOCUMENTS = 32, 1500, 1024
#: Letters of a language that have columns of a dense table, the most frequent ones.
DENSE = 32
#: Letters of a piece, and pieces times languages that are parsed at a time.
RUN, PIECES = 256, 16384
#: Pieces from which on they are followed one by one, and not in step.
FEW = 48
#: Characters of a text that are folded at a time.
STRETCH = 1 << 20
UNKNOWN = "und"
#: Phrases a letter above which a text is in none of the languages (1: no letter is known), and
#: characters below which that isn't held against a text.
NOISE, SHORT = 0.7, 40


_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it isn't a letter."""
    global _fold
    if _fold is None:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for n in range(0x110000):
            if (c := chr(n)).isalpha():
                table[n] = ord(c.lower()[0])
        _fold = table
    return _fold


def folded(text: str) -> np.ndarray:
    """Code points in lower case, each run of what isn't a letter as one space, none at the ends."""
    parts, last = [np.zeros(0, np.uint32)], True  # whether a space came last
    for lo in range(0, len(text), STRETCH):
        out = fold_table()[np.frombuffer(text[lo : lo + STRETCH].encode("utf-32-le", "replace"), dtype=np.uint32)]
        space = out == 32
        out = out[~space | ~np.r_[last, space[:-1]]]
        last = bool(space[-1])
        parts.append(out)
    out = np.concatenate(parts)
    return out[: len(out) - int(len(out) > 0 and out[-1] == 32)]


class Automaton:
    """The suffix automaton of texts as sequences of classes 0, 1, ... (0: a letter that the texts
    don't hold). State 0 is the start; a transition that doesn't exist is -1.

    table: transitions on the classes of columns 0 to DENSE - 1, and a column without any. keys and
    to: those on other classes, by state * classes + class. column: of each class. restart: state of
    each class as the first letter of a phrase."""

    def __init__(self, texts: list[np.ndarray], classes: int):
        steps: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in (c for t in texts for c in [*t.tolist(), -1]):  # -1 parts the texts
            now = len(steps)
            steps.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in steps[p]:
                steps[p][c] = now
                p = link[p]
            if p >= 0:
                q = steps[p][c]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    copy = len(steps)
                    steps.append(dict(steps[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and steps[p].get(c) == q:
                        steps[p][c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now
        count = np.bincount(np.concatenate([np.zeros(0, np.int64), *texts]), minlength=classes)
        frequent = np.lexsort((np.arange(classes), -count))[:DENSE]
        frequent = frequent[count[frequent] > 0]
        self.column = np.full(classes, DENSE, np.uint8)
        self.column[frequent] = np.arange(len(frequent))
        state = np.repeat(np.arange(len(steps)), [len(x) for x in steps])
        c = np.array([c for x in steps for c in x], np.int64)
        to = np.array([t for x in steps for t in x.values()], np.int32)
        state, c, to = (x[c >= 0] for x in (state, c, to))
        dense = self.column[c] < DENSE
        self.table = np.full((len(steps), DENSE + 1), -1, np.int32)
        self.table[state[dense], self.column[c[dense]]] = to[dense]
        keys = state[~dense] * classes + c[~dense]
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[~dense][order]
        self.restart = np.zeros(classes, np.int32)
        self.restart[c[state == 0]] = to[state == 0]


class Automata:
    """Automata side by side: states are numbered through, and a letter of a language is its class
    plus the language's number times the classes."""

    def __init__(self, own: list[Automaton], classes: int):
        first = np.cumsum([0, *(len(a.table) for a in own)])
        none = [np.zeros(0, np.int64)]
        self.number, self.classes, self.roots = len(own), classes, first[:-1].astype(np.int32)
        self.table = np.concatenate([np.zeros((0, DENSE + 1), np.int32), *(np.where(a.table < 0, -1, a.table + n) for a, n in zip(own, self.roots, strict=True))]).ravel()
        self.column = np.concatenate([np.zeros(0, np.uint8), *(a.column for a in own)])
        self.restart = np.concatenate([np.zeros(0, np.int32), *(a.restart + n for a, n in zip(own, self.roots, strict=True))])
        self.keys = np.concatenate(none + [a.keys + n * np.int64(classes) for a, n in zip(own, self.roots, strict=True)])
        self.to = np.concatenate(none + [a.to + n for a, n in zip(own, self.roots, strict=True)])

    def step(self, state: np.ndarray, root: np.ndarray, letter: np.ndarray, column: np.ndarray, some_rare: bool) -> tuple[np.ndarray, np.ndarray]:
        """(state after a letter, whether the letter begins a phrase)."""
        to = self.table[state * np.int32(DENSE + 1) + column]
        if some_rare and len(self.keys):
            rare = np.flatnonzero(column == DENSE)
            key = state[rare] * np.int64(self.classes) + letter[rare] % self.classes
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            to[rare] = np.where(self.keys[at] == key, self.to[at], -1)
        begins = (to < 0) | (state == root)
        return np.where(begins, self.restart[letter], to), begins

    def _rare(self, state: int, letter: int) -> int:
        key = state * self.classes + letter % self.classes
        at = int(np.searchsorted(self.keys, key))
        return int(self.to[at]) if at < len(self.keys) and self.keys[at] == key else -1

    def parsed(self, grid: np.ndarray, size: np.ndarray, goes_on: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases that begin in each piece under each language, states after the last). Pieces are
        the columns of grid; one that ``goes_on`` continues the one before, the first from ``ends``."""
        run, many = grid.shape[0], self.number
        order = np.argsort(-size, kind="stable")
        place = (order[:, None] * many + np.arange(many)).ravel()  # of each piece and language
        letter = (grid[:, order, None] + np.arange(many, dtype=np.int32) * np.int32(self.classes)).reshape(run, -1)
        column = self.column[letter]
        some_rare = (column == DENSE).any(axis=1)
        alive = np.searchsorted(-size[order], -np.arange(run), side="left") * many  # columns longer than each place
        root = np.tile(self.roots, len(size))
        starts, state = np.zeros(letter.shape, bool), root.copy()
        for i in range(run):
            m = int(alive[i])
            if not m:
                break
            state[:m], starts[i, :m] = self.step(state[:m], root[:m], letter[i, :m], column[i, :m], some_rare[i])
        upto = np.cumsum(starts, axis=0, dtype=np.uint16)
        made, after, own = upto[-1].astype(np.int32), state, state.copy()
        # enter each piece that goes on from the end of the one before
        at = np.empty(len(place), np.int64)
        at[place] = np.arange(len(place))
        before = np.where(place >= many, at[place - many], -1)
        following = np.full(len(place), -1)
        following[before[before >= 0]] = np.flatnonzero(before >= 0)
        on, length = np.repeat(goes_on[order], many), np.repeat(size[order], many)
        j = np.flatnonzero(on)
        state = np.where(before[j] >= 0, after[before[j]], ends[j % many]).astype(np.int32)
        count, changed = np.zeros(len(j), np.int32), []
        for i in range(run):
            if i >= length[j].min(initial=run):  # some end, and no place where both parses begin a phrase
                out = i >= length[j]
                made[j[out]] = count[out]
                changed.append(j[out][after[j[out]] != state[out]])
                after[j[out]] = state[out]
                j, state, count = j[~out], state[~out], count[~out]
            if len(j) < FEW:
                break
            state, begins = self.step(state, root[j], letter[i, j], column[i, j], some_rare[i])
            count += begins
            meets = begins & starts[i, j]
            if meets.any():
                done, left = j[meets], ~meets
                made[done] = count[meets] + upto[-1, done] - upto[i, done]
                j, state, count = j[left], state[left], count[left]
        # the few that are left one by one, and on through the pieces after those whose ends have changed
        nxt = following[np.concatenate([*changed, np.zeros(0, np.int64)]).astype(np.int64)]
        later = np.unique(place[np.concatenate([j, nxt[(nxt >= 0) & on[nxt]]])])
        table = memoryview(self.table)
        for k in at[later].tolist():
            now, n, i = int(after[before[k]] if before[k] >= 0 else ends[k % many]), 0, 0
            while True:
                letters, columns, own_starts, top = letter[:, k].tolist(), column[:, k].tolist(), starts[:, k].tolist(), int(root[k])
                stop, end = int(length[k]), None
                while i < stop:
                    to = table[now * (DENSE + 1) + columns[i]]
                    if columns[i] == DENSE and len(self.keys):
                        to = self._rare(now, letters[i])
                    if to < 0 or now == top:
                        if own_starts[i]:
                            n += int(upto[-1, k]) - int(upto[i, k]) + 1
                            end = int(own[k])
                            break
                        n, to = n + 1, int(self.restart[letters[i]])
                    now, i = to, i + 1
                end = now if end is None else end
                made[k] = n
                if end == after[k]:
                    break
                after[k] = end
                k = int(following[k])
                if k < 0 or not on[k]:
                    break
                now, n, i = end, 0, 0
        out = np.empty(len(place), np.int32)
        out[place] = made
        return out.reshape(-1, many), after[at[-many:]]


class Model:
    """Letters and automata, by language in order of name."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        texts = {k: [folded(t) for t in samples[k]] for k in self.languages}
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint32), *[t for ts in texts.values() for t in ts]]))
        classes = len(self.known) + 1
        self.automata = Automata([Automaton([self.classes(t) for t in ts], classes) for ts in texts.values()], classes)

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Class of each letter: from 1 those of any sample, 0 all others."""
        at = np.searchsorted(self.known, points)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == points, at + 1, 0).astype(np.int32) if len(self.known) else np.zeros(len(points), np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) under each language (columns)."""
        pieces = [(n, lo) for n, t in enumerate(texts) for lo in range(0, len(t), RUN)]
        out, ends = np.zeros((len(texts), self.automata.number), dtype=np.int64), self.automata.roots
        many = max(1, PIECES // max(1, self.automata.number))
        for at in range(0, len(pieces) if self.languages else 0, many):
            part = pieces[at : at + many]
            owner, begin = np.array([n for n, _ in part]), np.array([lo for _, lo in part])
            size = np.minimum(np.array([len(texts[n]) for n in owner]) - begin, RUN)
            grid = np.zeros((RUN, len(part)), dtype=np.int32)
            for j, (n, lo) in enumerate(part):
                grid[: size[j], j] = texts[n][lo : lo + RUN]
            made, ends = self.automata.parsed(grid, size, begin > 0, ends)
            np.add.at(out, owner, made)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, phrases a letter) of each text; the first of equal languages."""
        parts = [self.classes(folded(t or "")) for t in texts]
        phrases = self.phrases(parts)
        out = []
        for size, row in zip(map(len, parts), phrases, strict=True):
            if not size or not self.languages:
                out.append((UNKNOWN, 0.0, 1.0))
                continue
            best = int(row.argmin())
            others = np.delete(row, best)
            score = 1.0 - float(row[best]) / float(others.min()) if len(others) else 1.0
            out.append((self.languages[best], min(1.0, max(0.0, score)), float(row[best]) / size))
        return out


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", documents: int = DOCUMENTS, letters: int = LETTERS, all_documents: int = ALL_DOCUMENTS) -> Model:
    """A model of every language: of at most ``documents`` labelled documents of each, and of at most
    ``all_documents`` in all (but one of each language), those of the smallest hash of their id, and
    of at most ``letters`` characters of each. Only rows that aren't held out are read. What reaches
    the driver has that bound, whatever the size of the table: about 0.3 MB of tables a document."""
    learn = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    rows = learn.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"), F.substring(F.col(text_col), 1, letters).alias("text"))
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text")
    picked = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= documents)
    number = max(1, rows.agg(F.approx_count_distinct("lang", 0.01)).first()[0])
    each = max(1, min(documents, all_documents // number))
    samples: dict[str, list[str]] = {}
    for r in sorted(picked.where(F.col("nth") <= each).collect(), key=lambda r: (r["lang"], r["nth"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return Model(samples)


def identify(df: DataFrame, model: Model, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, phrase_rate) of every row; without ``id_col``, (row, ...) with all
    columns of the row as a struct.

    score is 1 less the ratio of the winner's phrases to the runner-up's; phrase_rate the winner's
    phrases a letter. Text that is null or has no letter is ``und`` with score 0 and rate 1; so is
    any text if nothing was learnt. Long texts are parsed whole; repeated rows and null ids give a
    row each; of languages that need equally many phrases the first by name wins; an empty table
    gives an empty one; other columns are ignored."""
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample, see fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lo, sizes = 0, np.cumsum([0, *(len(x) if x is not None else 0 for x in column.to_pylist())])
            while lo < len(column):
                hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + (1 << 20), side="right")) - 1)
                found = shared.value.predict(column.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())],
                    names=["id", "lang_pred", "score", "phrase_rate"],
                )
                lo = hi

    own = F.col(id_col) if id_col else F.struct(*[df[c] for c in df.columns])
    rows = df.select(own.alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["id"], *(T.StructField(c, t) for c, t in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("phrase_rate", T.DoubleType())))])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col or "row")
