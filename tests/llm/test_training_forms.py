"""Fill-in-middle, packing and vector codes."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import sha
from pyspark.sql import functions as F

from httplens.llm import infill, packing, quantize


def _cut(doc_id, text):
    """(form, output, prefix, middle) by the definition."""
    t = text or ""
    n = len(t)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
        return "plain", t, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, s, m = "<P>" + t[:a], "<S>" + t[b:], "<M>" + t[a:b]
    return ("spm", s + p + m, a, b - a) if h4 % 100 < 20 else ("psm", p + s + m, a, b - a)


def test_infill(spark, docs, rows):
    odd = [(None, "text without an id"), (None, "text without an id"), (5001, "a<S>b"), (5002, "<<P"), (5003, "x" * 3000 + "é🙂\r\n"), (5003, "again"), (5004, "<"), *[(6000 + i, "<P" * i + "é🙂\n") for i in range(60)]]
    more = spark.createDataFrame(odd, "doc_id bigint, text string")
    got = Counter(tuple(r) for r in infill.transform(docs.select("doc_id", "text").union(more)).collect())
    want = Counter()
    for d, t in [(r["doc_id"], r["text"]) for r in rows] + odd:
        form, out, a, m = _cut(d, t)
        want[d, len(t or ""), form, a, m, out, sha(out), sha(t or "")] += 1
    assert got == want and {k[2] for k in want} == {"plain", "psm", "spm"}


def test_infill_of_words_and_empty(spark, docs, none):
    assert infill.transform(none).collect() == []
    done = infill.transform(docs, unit=r"\S+", seed="7", marks=infill.Marks("[p]", "[s]", "[m]"), rates=infill.Rates(0, 100))
    for r, t in done.join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")), "doc_id").select(F.struct(*done.columns), "t").collect():
        assert r.n == len([w for w in t.split() if w]) or not t.isascii()
        assert r.restored_sha256 == sha(t) and (r.form == "spm" or not t)
        if r.form == "spm":
            cut = t[: r.prefix_chars]
            assert not cut or (not cut[-1].isspace() and (len(cut) == len(t) or t[len(cut)].isspace()))
    for bad in (infill.Marks("<P>", "<P>", "<M>"), infill.Marks("", "a", "b"), infill.Marks("ab", "bc", "x")):
        with pytest.raises(ValueError, match="marks"):
            infill.transform(docs, marks=bad)
    with pytest.raises(ValueError, match="empty"):
        infill.transform(docs, unit="x?")


def _library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


ODD = [
    "ÅNGSTRÖM é İstanbul ΣΊΣΥΦΟΣ straße ﬁ don't WE'LL it's'", "a b c\x1cd\x85e\x00f \x0bg\x0ch", "<|endoftext|> x<|startoftext|>y <|endof", "ĀĀ Ā! \x00", "1234 ½ Ⅷ ٣ _-_ 🙂🙂", "中文字 и русский नमस्ते", "x" * 3000, "'s 'S ' s", "", "﻿ ‍ İ",
]


def test_words_are_encoded_as_by_the_library(rows):
    texts = ODD + [r["text"] or "" for r in rows]
    rng = random.Random(3)
    letters = "aAbé'ßİσΣς1½ -_.!<|>́ \x1c\x85가ßǅ🙂"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    want = _library(texts)
    e = packing.Encoder(packing.vocabulary_path())
    assert e.merger is not None
    got = e.encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    e.merger = None
    e.known, e.older = {}, {}
    assert e.encode([t.encode() for t in texts]) == got


def _packed(df, capacity, ids):
    """Checks a packing against the ids of each text; the number of sequences."""
    got = packing.pack(df, capacity=capacity).collect()
    place, whole = {}, {}
    for r in got:
        raw = bytes(r.ids)
        assert (len(raw), zlib.crc32(raw), r.start) == (4 * r.length, r.ids_crc32, r.piece * capacity) and 0 < r.length <= capacity
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole.setdefault(r.doc_id, []).append((r.piece, np.frombuffer(raw, "<u4").tolist()))
    for own in place.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= capacity
    for d, pieces in whole.items():
        texts = Counter()
        for n, x in sorted(pieces):
            texts[n] += len(x)
        assert all(len(x) == capacity for n, x in pieces if n < max(texts) and len(ids[d]) == 1)
        assert sorted(sum((x for _, x in sorted(pieces)), [])) == sorted(sum(ids[d], []))
        if len(ids[d]) == 1:
            assert sum((x for _, x in sorted(pieces)), []) == ids[d][0]
    assert set(whole) == set(ids)
    return len(place), got


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(spark, docs, rows, capacity):
    odd = [(None, None), (None, "a b"), (7001, "one two"), (7001, "one two"), *[(7100 + i, t) for i, t in enumerate(ODD)]]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id bigint, text string")).repartition(4)
    every = [(r["doc_id"], r["text"]) for r in rows] + odd
    ids = {}
    for (d, _), own in zip(every, _library([t or "" for _, t in every]), strict=True):
        ids.setdefault(d, []).append([*own, packing.END])
    n, got = _packed(df, capacity, ids)
    total = sum(len(x) for own in ids.values() for x in own)
    assert math.ceil(total / capacity) <= n <= math.ceil(total / capacity) + 1
    seqs = packing.sequences(packing.pack(df, capacity=capacity)).collect()
    assert len(seqs) == n and sum(r.length for r in seqs) == total and all(len(r.ids) == 4 * r.length for r in seqs)


def test_packing_of_nothing(none, docs):
    assert packing.pack(none).collect() == []
    assert "place" not in packing.pack(docs).columns


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece_and_is_near_its_bound(seed):
    rng = random.Random(seed)
    sizes = [
        Counter(rng.randint(1, 100) for _ in range(3000)), Counter({51: 400, 49: 399, 26: 7, 100: 3}), Counter(rng.randint(35, 60) for _ in range(2000)),
        Counter({34: 3000, 67: 10}), Counter({1: 5}), Counter(rng.choice([70, 31, 29, 41, 59, 15]) for _ in range(10**4)),
    ][seed]
    p = packing.plan(dict(sizes), 100)
    length = np.repeat(np.array(sorted(sizes)), [sizes[n] for n in sorted(sizes)])
    rank = np.concatenate([np.arange(sizes[n]) for n in sorted(sizes)])
    seq, at = p.place(length, rank)
    held = {}
    for s, a, n in zip(seq.tolist(), at.tolist(), length.tolist(), strict=True):
        held.setdefault(s, []).append((a, n))
    for own in held.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 100
    assert len(held) == p.sequences and p.bound <= p.sequences <= p.bound * 1.02 + 1


def test_a_plan_is_as_small_for_many_pieces():
    rng = random.Random(1)
    h = Counter(rng.randint(1, 256) for _ in range(5000))
    few, many = packing.plan(dict(h), 256), packing.plan({n: k * 10**6 for n, k in h.items()}, 256)
    assert len(many.key) < 20 * 256 * packing.ROUNDS and many.sequences <= many.bound * 1.002 + 1 and few.sequences <= few.bound * 1.002 + 2


def _codes(rows, parts=8, k=16, rounds=6):
    """{row: (code, error)} and entries of rows (id, label, vector), by all distances."""
    ok = [(i, [math.floor(4096 * x) for x in v]) for i, (_, _, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(ok, key=lambda r: (rows[r[0]][0] is None, rows[r[0]][0] or 0, r[1]))
    size = next(len(x) for _, x in order if x and len(x) % parts == 0)
    own = [(i, x) for i, x in order if len(x) == size]
    w = size // parts
    part = lambda x, p: x[p * w : (p + 1) * w]
    books = [[part(x, p) for _, x in own[:k]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, x in own:
                groups.setdefault(near(part(x, p), books[p])[1], []).append(part(x, p))
            books[p] = [[sum(c) // len(c) for c in zip(*groups[j], strict=True)] if j in groups else e for j, e in enumerate(books[p])]
    out = {i: None for i, _ in ok}
    for i, x in own:
        told = [near(part(x, p), books[p]) for p in range(parts)]
        out[i] = ("".join(f"{j:02x}" for _, j in told), sum(d for d, _ in told))
    return out, books


def _vectors(seed, n=300, size=16):
    rng = random.Random(seed)
    rows = [(i * 3, rng.choice([None, 1, 2]), [rng.choice([-0.5, 0.25, rng.gauss(0, 1)]) for _ in range(size)]) for i in range(n)]
    rows += [(5, 1, None), (8, 1, [1.0] * 15 + [None]), (11, 2, [float("nan")] * size), (14, 2, [float("inf")] * size), (17, 3, []), (20, 3, [1.0] * 24), (None, 4, [0.1] * size), (0, 4, rows[0][2]), (0, None, [0.0] * size)]
    rng.shuffle(rows)
    return rows


SCHEMA = "vec_id bigint, label int, embedding array<double>"


@pytest.mark.parametrize("seed", [1, 2])
def test_vector_codes(spark, seed):
    rows = _vectors(seed)
    want, books = _codes(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "code": F.lit("y"), "x": F.lit(1)}).repartition(3)
    coded, found = quantize.compress(df)
    assert found.entries == books
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    labels = {}
    for i, told in want.items():
        if told:
            labels[rows[i][1]] = labels.get(rows[i][1], 0) + told[1]
    expected = Counter((rows[i][0], *(told or (None, None)), labels.get(rows[i][1]), digest) for i, told in want.items())
    assert Counter(tuple(r) for r in coded.collect()) == expected and any(told is None for told in want.values())
    back = {r.vec_id: r.vector for r in quantize.decompress(coded.where("vec_id > 0"), found).collect() if r.vector}
    for i, told in want.items():
        if told and rows[i][0]:
            got = [math.floor(4096 * x) for x in rows[i][2]]
            assert sum((a - 4096 * b) ** 2 for a, b in zip(got, back[rows[i][0]], strict=True)) == pytest.approx(told[1])


def test_codes_of_few_equal_and_huge_vectors(spark):
    huge = 2.0**40
    rows = [(3, None, [0.5] * 8), (1, None, [0.5] * 8), (2, 1, [huge] * 8), (4, 1, [-huge] * 7 + [0.0]), (6, 1, [1e300] * 8)]
    df = spark.createDataFrame(rows, SCHEMA)
    coded, books = quantize.compress(df, rounds=2)
    want, entries = _codes([r for r in rows if r[0] != 6], rounds=2)
    assert books.entries == entries
    got = {r.vec_id: (r.code, r.error) for r in coded.collect()}
    assert got == {rows[i][0]: told for i, told in want.items()} and got[1][0] == "00" * 8
    assert quantize.compress(df.where("false"))[0].collect() == []
    assert [tuple(r)[:4] for r in quantize.compress(df.where("vec_id = 3").withColumn("embedding", F.array().cast("array<double>")))[0].collect()] == [(3, None, None, None)]
    one, single = quantize.compress(df.where("vec_id = 1"))
    assert [tuple(r)[1:4] for r in one.collect()] == [("00" * 8, 0, 0)] and len(single.entries[0]) == 1


def test_errors_past_64_bits_are_null(spark):
    rows = [(i, 1, [0.0] * 8) for i in range(16)] + [(20, 1, [2.0**44] * 8), (21, 1, [-(2.0**44)] * 8), (22, 2, [0.0] * 8)]
    coded, books = quantize.compress(spark.createDataFrame(rows, SCHEMA), rounds=0)
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in coded.collect()}
    assert got[20] == ("00" * 8, None, None) and got[1] == ("00" * 8, 0, None) and got[22] == ("00" * 8, 0, 0) and len(books.entries[0]) == 16


def test_equal_bounds_are_visited():
    rng = np.random.default_rng(5)
    for _ in range(40):
        entries = rng.integers(-3, 4, (rng.integers(1, 40), 3))
        x = rng.integers(-4, 5, (200, 3))
        d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        for kind in (np.int64, object):
            entry, best = quantize.Tree(entries.astype(kind)).nearest(x.astype(kind))
            assert entry.tolist() == d.argmin(axis=1).tolist() and best.tolist() == d.min(axis=1).tolist()
