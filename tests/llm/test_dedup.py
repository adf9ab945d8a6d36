"""Suffix, passage and SimHash dedup against plain versions."""

import numpy as np
import pytest
from brute import components, passage_dedup, simhash, suffix_dedup
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from httplens.llm import anchors, passages
from httplens.llm import simhash as sh
from httplens.llm import suffix_dedup as sd
from httplens.llm import textblocks as tb
from httplens.llm.components import connected_components
from httplens.llm.queries import _passages, _suffixes


def _removed():
    return F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, x: n + x["hi"] - x["lo"])


def _suffix_rows(df):
    cols = df.select("doc_id", "n_bytes", _removed().alias("n"), F.size("removed").alias("s"), F.sha2("kept", 256).alias("k"))
    return sorted((tuple(r) for r in cols.collect()), key=str)


def _passage_rows(df):
    cols = df.select("doc_id", "n_words", _removed().alias("n"), F.sha2("kept", 256).alias("k"))
    return sorted((tuple(r) for r in cols.collect()), key=str)


@pytest.mark.parametrize("crowd", [3, anchors.CROWD])
def test_suffix_dedup(docs, rows, crowd):
    assert _suffix_rows(sd.dedup(docs, crowd=crowd)) == sorted(suffix_dedup(rows), key=str)


def test_suffix_dedup_other_lengths(docs, rows):
    assert _suffix_rows(sd.dedup(docs, window=40, grain=9, crowd=50)) == sorted(suffix_dedup(rows, 40), key=str)


@pytest.mark.parametrize("crowd", [3, anchors.CROWD])
def test_passage_dedup(docs, rows, crowd):
    assert _passage_rows(passages.dedup(docs, crowd=crowd)) == sorted(passage_dedup(rows), key=str)


def test_passage_dedup_other_lengths(docs, rows):
    assert _passage_rows(passages.dedup(docs, window=9, grain=2)) == sorted(passage_dedup(rows, 9), key=str)


def test_repeated_rows_and_null_ids(spark):
    text = "the same words over and over " * 12
    data = [{"doc_id": d, "text": t} for d, t in ((1, text), (1, text), (None, text), (2, "short"), (None, None), (5, text + "tail"))]
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in data], "doc_id bigint, text string")
    assert _suffix_rows(sd.dedup(df)) == sorted(suffix_dedup(data), key=str)
    assert _passage_rows(passages.dedup(df)) == sorted(passage_dedup(data), key=str)
    fps = [simhash(r["text"]) for r in data]
    want = sorted(((r["doc_id"], f"{f:016x}", c) for r, f, c in zip(data, fps, components(fps, [r["doc_id"] for r in data]), strict=True)), key=str)
    assert sorted((tuple(r) for r in sh.near_duplicates(df).collect()), key=str) == want


def test_ids_that_are_text(docs, rows):
    """Passages go where an earlier id, by code point, has them; suffixes need no order."""
    named = docs.withColumn("doc_id", F.concat(F.lit("n"), F.lpad(F.col("doc_id").cast("string"), 6, "0")))
    name = lambda found: sorted(((f"n{t[0]:06d}", *t[1:]) for t in found), key=str)
    assert _passage_rows(passages.dedup(named)) == name(passage_dedup(rows))
    assert _suffix_rows(sd.dedup(named)) == name(suffix_dedup(rows))


def test_words_of_equal_polynomials(spark):
    """The Thue-Morse word and its complement agree in every polynomial hash modulo 2^64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    line = lambda w: f"one two three four five six {w} seven eight nine ten eleven twelve"
    data = [{"doc_id": 1, "text": line(word)}, {"doc_id": 2, "text": line(other)}, {"doc_id": 3, "text": line(other)}]
    df = spark.createDataFrame([tuple(r.values()) for r in data], "doc_id bigint, text string")
    assert [n for _, _, n, _ in _passage_rows(passages.dedup(df))] == [0, 0, 13]
    assert _passage_rows(passages.dedup(df)) == sorted(passage_dedup(data), key=str)
    assert _suffix_rows(sd.dedup(df)) == sorted(suffix_dedup(data), key=str)


def _weak(monkeypatch, bits):
    """Hashes of few bits, so that they collide."""
    strong, same = tb.PrefixHash.of, tb.PrefixHash.equal
    monkeypatch.setattr(tb.PrefixHash, "of", lambda self, s, e: strong(self, s, e) & np.uint64((1 << bits) - 1))
    monkeypatch.setattr(tb.PrefixHash, "equal", lambda self, a, b, n: same(self, a, b, n) | ((a + b + n) % 7 == 0))


def test_collisions_are_found(monkeypatch):
    """Whatever the hashes say, only equal bytes count."""
    rng = np.random.default_rng(2)
    line = lambda n: b" ".join(bytes(rng.integers(97, 123, 5, dtype=np.uint8)) for _ in range(n))
    grain, tail = line(4), line(9)
    texts = [line(9) + b" " + grain + b" " + (tail if n % 3 == 0 else line(9)) for n in range(12)]
    rank, left = np.arange(12) % 5, np.full(12, 9)
    solve = passages.solver(13, 4)
    want = [x.tolist() for x in solve(np.zeros(12, np.int64), rank, texts, left)]
    assert want[0] == [3, 6, 9]
    _weak(monkeypatch, 2)
    assert [x.tolist() for x in solve(np.zeros(12, np.int64), rank, texts, left)] == want
    assert want == [x.tolist() for x in passages.solver(13, 4)(np.zeros(12, np.int64), rank, texts, left)]


@pytest.mark.parametrize("crowd", [40, anchors.CROWD])
def test_colliding_grains_end_with_the_right_rows(docs, rows, crowd):
    """Grains told by two bits of their hash: different ones meet, in crowds, too."""
    assert _suffix_rows(sd.dedup(docs, crowd=crowd, bits=2)) == sorted(suffix_dedup(rows), key=str)
    assert _passage_rows(passages.dedup(docs, crowd=crowd, bits=2)) == sorted(passage_dedup(rows), key=str)


def test_kinds_are_told_by_digests_of_the_surroundings():
    shape = anchors.Shape(True, 13, 4, True, 1)
    texts = [b" ".join(b"w%d" % (i * n) for i in range(60)) for n in (1, 2)]
    kinds = [anchors.anchors(shape, anchors.units(shape, np.frombuffer(t, np.uint8))) for t in texts]
    for pos, grain, a, b in kinds:
        assert set(grain.tolist()) <= {0, 1} and len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(pos)
    assert not set(kinds[0][2].tolist()) & set(kinds[1][2].tolist())


def test_a_crowd_gives_one_span_an_anchor(docs):
    shape = anchors.Shape(True, 13, 4, True)
    texts = anchors.texts_of(docs, "doc_id", "text", True)
    met = anchors.meet(anchors.mark(texts.select("rid", "rank", "text"), shape), shape)
    apart = met.where("apart").groupBy("rid", "rank").agg(F.collect_set(F.struct("pos", "grain")).alias("at"))
    near = anchors.compare(anchors.surroundings(texts, apart, shape), shape, passages.solver(13, 4), passages.opener(13), 2)
    assert near.groupBy("rid", "rank", "pos").count().where("count > 1").isEmpty() and not near.isEmpty()


@pytest.mark.parametrize("stretch", [anchors.STRETCH, 300])
@pytest.mark.parametrize("shape", [anchors.Shape(True, 13, 4, True), anchors.Shape(True, 5, 2, True, 3), anchors.Shape(False, 40, 9, False)])
def test_anchors_of_a_block_are_those_of_its_texts(rows, shape, stretch, monkeypatch):
    monkeypatch.setattr(anchors, "STRETCH", stretch)
    texts = [(r["text"] or "").encode() for r in rows]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    part, (row, pos, *kind) = anchors.block_anchors(shape, data, at, 5)
    for i, t in enumerate(texts):
        own = anchors.units(shape, np.frombuffer(t, np.uint8))
        here = row == i + 5
        assert all((x[here] == y).all() for x, y in zip((pos, *kind), anchors.anchors(shape, own), strict=True))
        for p in pos[here][::7].tolist():
            left, right = anchors.extent(shape, np.array([p]), len(own))
            assert part.around(shape, i + 5, p) == (own.pieces(own.data.tobytes(), left, right)[0], p - left[0])


def test_a_part_of_the_anchors_meets_at_a_time(docs):
    """Each meeting reads and shuffles its own range of grains, and together they are all."""
    shape = anchors.Shape(True, 13, 4, True)
    marks = anchors.staged(anchors.mark(anchors.texts_of(docs, "doc_id", "text", True).select("rid", "rank", "text"), shape))
    grains = [{r.grain for r in part.select("grain").collect()} for part in anchors.meetings(marks, shape)]
    assert len(grains) > 1 and max(map(len, grains)) < 0.7 * len(set.union(*grains)) and sum(map(len, grains)) == len(set.union(*grains))


def test_a_third_of_all_rows_are_equal(spark, monkeypatch):
    """Many equal rows, of one id or of none, in several batches."""
    rng = np.random.default_rng(4)
    line = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 5))) for _ in range(n))
    text = line(60)
    data = [{"doc_id": d, "text": t} for d, t in [(9, text)] * 30 + [(None, text)] * 20 + [(i, line(40)) for i in range(20, 50)] + [(3, text[30:200])]]
    df = spark.createDataFrame([tuple(r.values()) for r in data], "doc_id bigint, text string").repartition(9)
    for hot in (anchors.HOT, 2):
        monkeypatch.setattr(anchors, "HOT", hot)
        assert _suffix_rows(sd.dedup(df)) == sorted(suffix_dedup(data), key=str)
        assert _passage_rows(passages.dedup(df)) == sorted(passage_dedup(data), key=str)


def test_empty_tables(none):
    assert _suffixes(none).collect() == [] and _passages(none).collect() == [] and sh.near_duplicates(none).collect() == []


@pytest.mark.parametrize("held", [3, 40, anchors.HELD])
def test_decisions_in_parts(docs, rows, held, monkeypatch):
    monkeypatch.setattr(anchors, "HELD", held)
    assert _suffix_rows(sd.dedup(docs)) == sorted(suffix_dedup(rows), key=str)
    assert _passage_rows(passages.dedup(docs)) == sorted(passage_dedup(rows), key=str)


@pytest.mark.parametrize(("hot", "held", "crowd"), [(anchors.HOT, anchors.HELD, anchors.CROWD), (1, anchors.HELD, anchors.CROWD), (anchors.HOT, 3, anchors.CROWD), (anchors.HOT, anchors.HELD, 1), (1, 3, 1), (anchors.HOT, 3, 1)])
def test_passages_within_repeats(spark, hot, held, crowd, monkeypatch):
    """Blocks that one document, or several of one rank, hold repeatedly, and an earlier one in part."""
    monkeypatch.setattr(anchors, "HOT", hot)
    monkeypatch.setattr(anchors, "HELD", held)
    rng = np.random.default_rng(11)
    line = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 5))) for _ in range(n))
    q, block, other = line(40), f"{line(10)} {{}} {line(10)}", f"{line(10)} {{}} {line(10)}"
    block, other = block.format(q), other.format(q)
    data = [(1, q), (2, f"{block} {block}"), (3, " ".join([other] * 6)), (3, f"{line(5)} {other} {line(4)}"), (None, f"{line(9)} {block} {line(3)} {other} {other}")]
    data += [(None, f"{x} {line(10)} {q} {y}") for x, y in ((line(20), line(20)), (line(5), line(5)))]
    inner = f"{line(12)} {q} {line(12)}"
    data += [(None, f"{line(7)} {inner} {line(7)}"), (None, f"{line(8)} {inner} {inner}"), (None, f"{line(8)} {inner} {inner}")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    want = sorted(passage_dedup([{"doc_id": d, "text": t} for d, t in data]), key=str)
    assert _passage_rows(passages.dedup(df, crowd=crowd)) == want


@pytest.mark.parametrize("hot", [1, 4])
def test_hot_grains(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(anchors, "HOT", hot)
    assert _suffix_rows(sd.dedup(docs)) == sorted(suffix_dedup(rows), key=str)
    assert _passage_rows(passages.dedup(docs)) == sorted(passage_dedup(rows), key=str)


def test_long_texts_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(anchors, "STRETCH", 500)
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 105, 6))) for _ in range(900)]
    long = " ".join(words)
    data = [{"doc_id": 1, "text": long}, {"doc_id": 2, "text": "begin " + long[1203:4411] + " end"}, {"doc_id": 3, "text": long[:199] + "?"}]
    raw = [anchors.anchors(anchors.Shape(False, 200, 64, False), anchors.units(anchors.Shape(False, 200, 64, False), np.frombuffer(r["text"].encode(), np.uint8)))[0] for r in data]
    assert all((np.diff(p) > 0).all() for p in raw)
    monkeypatch.undo()
    whole = [anchors.anchors(anchors.Shape(False, 200, 64, False), anchors.units(anchors.Shape(False, 200, 64, False), np.frombuffer(r["text"].encode(), np.uint8)))[0] for r in data]
    assert all((a == b).all() for a, b in zip(raw, whole, strict=True))
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in data], "doc_id bigint, text string")
    assert _suffix_rows(sd.dedup(df)) == sorted(suffix_dedup(data), key=str)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=3, max_size=40), min_size=2, max_size=30))
def test_suffix_order(texts):
    raw = [t.encode() for t in texts]
    end = np.cumsum([len(t) for t in raw])
    s = sd.Suffixes(np.frombuffer(b"".join(raw), np.uint8), end - [len(t) for t in raw], end)
    order = s.order(np.zeros(len(raw), np.int64)).tolist()
    assert [raw[i] for i in order] == sorted(raw) and sorted(order) == list(range(len(raw)))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=25), st.lists(st.tuples(st.integers(0, 24), st.integers(0, 63), st.integers(0, 63)), max_size=25))
def test_variants_meet_every_link(base, flips):
    fps = sorted({*base, *(base[i % len(base)] ^ (1 << a) ^ (1 << b) for i, a, b in flips)})
    masks = sh.variant_masks(4)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                assert any((a ^ b) & m == 0 for m in masks)
    x = np.array(fps, np.uint64)
    a, b = sh.forest(x, 4)
    assert (np.bitwise_count(a ^ b) <= 4).all()
    top = {f: f for f in fps}

    def find(f):
        while top[f] != f:
            f = top[f]
        return f

    for p, q in zip(a.tolist(), b.tolist(), strict=True):
        top[find(p)] = find(q)
    want = components(fps, fps)
    groups = {}
    for f, w in zip(fps, want, strict=True):
        assert groups.setdefault(w, find(f)) == find(f)


@pytest.mark.parametrize("crowd", [2, sh.CROWD])
def test_simhash(docs, rows, spark, crowd, monkeypatch):
    near = [(1000 + n, r["text"]) for n, r in enumerate(rows) if r["text"]]
    data = [(r["doc_id"], r["text"]) for r in rows] + [(i, t.upper()) for i, t in near] + [(i + 1000, t.replace("a", "A", 1) + " x") for i, t in near]
    fps = [simhash(t) for _, t in data]
    want = sorted((d, f"{f:016x}", c) for (d, _), f, c in zip(data, fps, components(fps, [d for d, _ in data]), strict=True))
    monkeypatch.setattr(sh, "CROWD", crowd)
    got = sh.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string"))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_links_of_a_crowd(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 62, (400, 3))})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    for crowd in (20, 4096):
        roots = {r["node"]: r["root"] for r in connected_components(sh.links(df, crowd=crowd)).collect()}
        want = components(fps, fps)
        assert [roots.get(f, f) for f in fps] == want


def test_keep_one(docs, rows):
    kept = {r["doc_id"] for r in sh.keep_one(docs).collect()}
    fps = [simhash(r["text"]) for r in rows]
    assert kept == set(components(fps, [r["doc_id"] for r in rows]))


def test_keep_one_of_odd_rows(spark):
    """Null and repeated ids are ranked too; equal rows leave one; columns may have any names."""
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
    data = [(None, a, 1), (None, a, 1), (5, a, 2), (5, b, 3), (5, b, 3), (7, b, 4), (None, None, 5), (None, "", 6), (None, "x y z", 7)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, h int").toDF("doc_id", "text", "least")
    kept = [(r["doc_id"], r["text"]) for r in sh.keep_one(df).collect()]
    assert sorted(kept[i] for i in range(len(kept)) if kept[i][0] is not None) == sorted([(5, a), (5, b)])
    assert sorted(t or "" for d, t in kept if d is None) == ["", "x y z"] and sh.keep_one(df).columns == df.columns


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
