"""Entropy in one pass, digests of sets of any size, rounding at ties, draws by shares, chromosomes."""

import hashlib
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from httplens.functions import digests
from httplens.functions.text import entropy, longest_run
from httplens.operators import profile, training


def _entropy(text):
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0


def test_entropy(spark):
    rng = random.Random(1)
    texts = ["", "a", "aab", "\n\n\r\n", "éé🙂🙂🙂x", "a.b*c\\d$1", "".join(rng.choice("abc 🙂é\n") for _ in range(500)), "\x00\x00b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", entropy(F.col("t")).alias("e"), longest_run(F.col("t")).alias("r")).collect()
    for r in rows:
        assert r.e == pytest.approx(_entropy(r.t), abs=1e-12)
    assert {r.t: r.r for r in rows}["éé🙂🙂🙂x"] == 3


def test_entropy_of_a_long_text_of_many_letters(spark):
    rng = random.Random(2)
    letters = [chr(0x4E00 + i) for i in range(5000)]
    text = "".join(rng.choice(letters) for _ in range(350_000))  # over 1 MB
    df = spark.createDataFrame([(text,)], "t string").select(entropy(F.col("t")).alias("e"))
    first = df.first().e
    began = time.perf_counter()
    assert df.first().e == first == pytest.approx(_entropy(text), abs=1e-9)
    assert time.perf_counter() - began < 10  # 5,000 passes over the text take minutes


def test_digests_of_sets_and_indices(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), f"id-{rng.randint(0, 400)}", rng.randint(0, 10**12)) for _ in range(1500)] + [("c", None, None)]
    df = spark.createDataFrame(rows, "k string, i string, n bigint").repartition(5)
    got = {r.k: r.digest for r in digests.set_digests(df, ["k"], "i").collect()}
    assert got == {k: hashlib.sha256("".join(f"{i}\n" for i in sorted({b for a, b, _ in rows if a == k})).encode()).hexdigest() for k in ("a", "b", None)}
    assert got["a"] == df.where("k = 'a'").agg(digests.set_digest(F.col("i")).alias("d")).first().d
    index = {r.k: r.digest for r in digests.index_digests(df, ["k"], "n").collect()}
    assert index == {k: hashlib.sha256(b"".join(n.to_bytes(8, "big") for n in sorted(c for a, _, c in rows if a == k))).hexdigest() for k in ("a", "b", None)}
    plan = digests.set_digests(df, ["k"], "i")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan
    assert digests.set_digests(df.where("false"), ["k"], "i").collect() == []


def test_ties_go_to_the_even_digit(spark):
    rows = [(n, m) for m in (32, 64, 16, 7) for n in range(1, 40)]
    got = spark.createDataFrame(rows, "n bigint, m bigint").select("n", "m", profile.percent(F.col("n"), F.col("m")).alias("p"), profile.average(F.col("n"), F.col("m")).alias("a")).collect()
    for r in got:
        assert (r.p, r.a) == (round(100.0 * r.n / r.m, 4), round(r.n / r.m, 4))
    assert any(round(r.n / r.m, 4) != math.floor(r.n / r.m * 1e4 + 0.5) / 1e4 for r in got)


def test_roulette(spark):
    rng = np.random.default_rng(5)
    costs, draws = rng.uniform(0, 2, 60), rng.uniform(0, 1, 300)
    draws[:2] = 0.0, 1.0 - 1e-16
    fit = 1.0 / (costs + 1e-12)
    edge = np.cumsum(fit / fit.sum())
    want = {i: min(int(np.searchsorted(edge, u, side="right")), 59) for i, u in enumerate(draws.tolist())}
    people = spark.createDataFrame([(i, float(c)) for i, c in enumerate(costs)], "individual bigint, cost double").repartition(4)
    slots = spark.createDataFrame(list(enumerate(draws.tolist())), "slot bigint, drawn double").repartition(3)
    assert {r.slot: r.individual for r in training.roulette(people, slots).collect()} == want
    assert training.roulette(people.where("false"), slots).collect() == []


def test_chromosomes(spark):
    sizes = [4, 3, 2]
    net = training.Network.random(sizes, np.random.default_rng(6))
    df = spark.createDataFrame([(net.genes().tolist(),)], "g array<double>")
    r = df.select(training.layers_of(F.col("g"), sizes).alias("w"), training.genes_of(training.layers_of(F.col("g"), sizes)).alias("g")).first()
    assert all(np.array_equal(np.array(a), b) for a, b in zip(r.w, net.weights, strict=True)) and r.g == net.genes().tolist()
    with pytest.raises(PySparkException, match="as many genes"):
        df.select(training.layers_of(F.col("g"), [4, 3, 3])).collect()
