"""Partitions, statistics, scoring, series, histories and balancing on small tables."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from httplens.functions import digests, load
from httplens.operators import balancing, history, partition, profile, scoring, series, stats, training
from httplens.plans.queries import POPULATION


def test_record_ids(spark):
    raw = bytes(range(256))
    r = partition.identified(spark.createDataFrame([("normal", 258, bytearray(raw))], "dataset string, sequence bigint, raw binary")).collect()[0]
    want = hashlib.sha256(b"csic-experimento-2\0normal\0" + (258).to_bytes(8, "big") + b"\0" + raw).hexdigest()
    assert r.record_id == want and r.content_sha256 == hashlib.sha256(raw).hexdigest()
    long = spark.createDataFrame([(bytearray(b"x" * 500),)], "b binary").select(digests.plain_base64(F.col("b")).alias("t")).collect()[0].t
    assert "\n" not in long and len(long) == 668


def test_selection(spark):
    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(100)]
    df = spark.createDataFrame([("d", i, h) for i, h in enumerate(hashes)], "dataset string, sequence bigint, content_sha256 string")
    got = {r.sequence for r in partition.select_top(df, 25).where("partition = 'development'").collect()}
    key = lambda i: (hashlib.sha256(f"20260917:d:{i}:{hashes[i]}".encode()).hexdigest(), i)
    assert got == set(sorted(range(100), key=key)[:25])


def test_partition_checks(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k bigint") for xs in ([1, 2, 3], [3, 4]))
    assert [r.k for r in partition.overlap(a, b, "k").collect()] == [3]
    assert [r.k for r in partition.incomplete([a, b], spark.createDataFrame([(x,) for x in (1, 2, 3, 4, 5)], "k bigint"), "k").orderBy("k").collect()] == [3, 5]
    assert partition.schema_difference(a, ("k", "l")) == (["l"], [])
    assert [r.k for r in partition.repeated(a.union(b), "k").collect()] == [3]


def test_split_sizes(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(1001)], "i bigint, y boolean")
    got = {(r.y, r.split): r.n for r in partition.class_counts(partition.stratified(df, "y", [F.col("i")]), "y", "split").collect()}
    for y, n in ((True, 334), (False, 667)):
        assert (got[y, "treino"], got[y, "validacao"], got[y, "teste"]) == (int(n * 0.7), int(n * 0.15), n - int(n * 0.7) - int(n * 0.15))


def test_published_split_sizes():
    labels = np.random.default_rng(0).permutation(np.r_[np.zeros(15000, int), np.ones(15000, int)])
    parts = partition.reference_split(labels, 20260918)
    assert [len(parts[k]) for k in ("treino", "validacao", "teste")] == [21000, 4500, 4500]
    assert len(np.unique(np.concatenate(list(parts.values())))) == 30000


def test_index_digest(spark):
    xs = [5, 1, 300, 2**40]
    got = spark.createDataFrame([(x,) for x in xs], "i bigint").agg(digests.index_digest(F.col("i")).alias("d")).collect()[0].d
    assert got == partition.reference_digest(np.array(xs))


def test_statistics(spark):
    rng = np.random.default_rng(1)
    xs = rng.integers(0, 40, 500).astype(float)
    df = spark.createDataFrame([(float(x), None if i % 10 == 0 else float("nan") if i % 11 == 0 else float(x)) for i, x in enumerate(xs)], "a double, b double")
    got = {r.feature: r for r in stats.summary(df, ["a", "b"]).collect()}
    a, b = got["a"], got["b"]
    assert (a.total, a.valid, a.missing, a.zeros) == (500, 500, 0, (xs == 0).sum()) and math.isclose(a["mean"], xs.mean()) and math.isclose(a["stddev"], xs.std(), rel_tol=1e-9)
    for q, name in stats.QUANTILES:
        assert math.isclose(a[name], np.quantile(xs, q), abs_tol=1e-9)
    assert b.missing == sum(i % 10 == 0 or i % 11 == 0 for i in range(500)) and a.distinct_values == str(len(set(xs)))
    k = {r.feature: r for r in stats.sketched(df, ["a", "b"]).collect()}
    assert (k["b"].missing, k["a"].zeros, k["a"]["max"]) == (b.missing, a.zeros, a["max"]) and abs(k["a"].median - np.median(xs)) <= 1 and math.isclose(k["a"].stddev, xs.std())
    f = stats.binary_frequencies(df.select(F.signum("a").alias("s")), ["s"]).collect()[0].frequencies
    assert f["1.0"] == (xs > 0).sum()


def test_normalizer(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4)) * [1, 5, 9, 3]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "bin double, r_ratio double, signed double, count double")
    kinds = {"bin": "binaria", "r_ratio": "continua", "signed": "contagem_assinada", "count": "contagem"}
    specs = scoring.fit_normalizer(df, kinds)
    assert math.isclose(specs[2]["cap"], np.quantile(np.abs(x[:, 2]), 0.995)) and math.isclose(specs[3]["cap"], np.quantile(x[:, 3], 0.995))
    got = np.array([tuple(r) for r in scoring.normalized(df, specs).collect()])
    want = np.column_stack([np.clip(x[:, 0], 0, 1), np.clip(x[:, 1], 0, 1), np.clip(x[:, 2] / specs[2]["cap"], -1, 1), np.clip(x[:, 3] / specs[3]["cap"], 0, 1)])
    assert np.allclose(np.sort(got, axis=0), np.sort(want, axis=0))
    flat = scoring.fit_normalizer(spark.createDataFrame([(0.0,)] * 3, "c double"), {"c": "contagem"})
    assert flat[0]["cap"] == 1.0


def test_network(spark):
    net = training.Network.random([3, 5, 2, 1], np.random.default_rng(3))
    x = np.random.default_rng(4).normal(size=(20, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i bigint, a double, b double, c double")
    native = {r.i: r.s for r in df.select("i", scoring.forward(F.array("a", "b", "c"), net.layers())[0].alias("s")).collect()}
    batched = {r.i: r.score for r in scoring.forward_batches(df, ["a", "b", "c"], net.layers()).collect()}
    for i, want in enumerate(net.score(x)):
        assert math.isclose(native[i], want, rel_tol=1e-12) and math.isclose(batched[i], want, rel_tol=1e-12)
    again = training.Network.from_genes(net.sizes, net.genes())
    assert np.allclose(again.score(x), net.score(x)) and training.Network.parameter_count([76, 77, 39, 1]) == 9011
    assert spark.range(1).select(scoring.sigmoid(F.lit(1e9)).alias("a"), scoring.sigmoid(F.lit(-1e9)).alias("b")).collect()[0].a == 1.0


def test_stated_confusion(spark):
    rows = [(0, 0.0)] * 974 + [(0, 1.0)] * 2 + [(1, 1.0)] * 526
    m = scoring.confusion(spark.createDataFrame(rows, "y int, s double"), F.col("y"), scoring.decided(F.col("s"), 0.47, False)).collect()[0]
    assert (m.tn, m.fp, m.fn, m.tp) == (974, 2, 0, 526) and m.accuracy == 0.9986684420772304 and m.f1 == 0.9981024667931689


@pytest.mark.parametrize("inclusive", [False, True])
def test_sweep(spark, inclusive):
    rng = random.Random(5)
    rows = [(rng.choice([*scoring.GRID[:40], rng.random()]), rng.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "s double, y int")
    got = {r.threshold: r for r in scoring.sweep(df, "s", "y", 5, 1, inclusive).collect()}
    assert list(got) != [] and sorted(got) == sorted(scoring.GRID) and np.allclose(scoring.GRID, np.arange(0.05, 0.955, 0.01), rtol=0, atol=0)
    keys = {}
    for t in scoring.GRID:
        hit = [(s >= t if inclusive else s > t, y) for s, y in rows]
        fp, fn, tp, tn = (sum(b == x and y == z for b, y in hit) for x, z in ((True, 0), (False, 1), (True, 1), (False, 0)))
        g = got[t]
        assert (g.fp, g.fn, g.tp, g.tn, g.security_cost) == (fp, fn, tp, tn, 5 * fn + fp)
        keys[t] = (g.security_cost, g.fn, g.fp, -g.f1, -g.precision, -g.recall, -g.accuracy, t)
    assert scoring.best(scoring.sweep(df, "s", "y", 5, 1, inclusive)).collect()[0].threshold == min(keys, key=keys.get)


def test_model_ids(spark):
    names = ["E1:BP", "experimento-2/ag", "x", " e2:bp "]
    got = [r.m for r in spark.createDataFrame([(n,) for n in names], "n string").select(scoring.model_id(F.col("n")).alias("m")).collect()]
    assert got == [None if n == "x" else m for n, m in zip(names, ["experimento_1:bp", "experimento_2:ag", "", "experimento_2:bp"], strict=True)]


def test_request_rate(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(seconds=s)) for s in (0, 10, 60, 61, 200)] + [("b", t0)]
    got = series.request_rate(spark.createDataFrame(rows, "c string, t timestamp_ntz"), "c", "t").collect()
    assert sorted((r.c, r.request_rate) for r in got) == [("a", 1), ("a", 1), ("a", 2), ("a", 3), ("a", 3), ("b", 1)]


def test_series(spark):
    def plain(values):
        start, end = values[max(0, math.floor(len(values) * 0.8) - 1)], values[-1]
        return (start - end) / abs(start) if abs(start) > 1e-12 else 0.0

    curves = {"x": [9.0, 7, 8, 6, 6, 5, 5.5, 4, 3, 2], "y": [1.0, 1, 1, 1], "z": [2.0], "w": [1.0, 2, 1, 2, 1]}
    df = spark.createDataFrame([(k, i, float(v)) for k, vs in curves.items() for i, v in enumerate(vs)], "k string, i int, v double")
    imp = {r.k: r.improvement for r in series.recent_improvement(df, "k", "i", "v").collect()}
    assert imp["z"] is None and all(math.isclose(imp[k], plain(curves[k])) for k in ("x", "y", "w"))
    osc = {r.k: r.oscillation for r in series.oscillation(df, "k", "i", "v").collect()}
    assert osc == {"x": 4 / 7, "y": 0.0, "z": 0.0, "w": 1.0}
    best = [r.best for r in series.running_best(df.where("k = 'x'"), "k", "i", "v").orderBy("i").collect()]
    assert best == [9, 7, 7, 6, 6, 5, 5, 4, 3, 2]
    changes = series.version_changes(df.where("k = 'x'"), "k", "i", {"v": True}, newest=3).orderBy(F.desc("sequence")).collect()
    assert [(r.sequence, r.tone_v) for r in changes] == [(9, "better"), (8, "better"), (7, "better")]


@pytest.mark.parametrize("horizon", [None, 5000])
def test_newest_match(spark, horizon):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    probes = spark.createDataFrame([("a", at(10)), ("b", at(10)), ("c", at(10))], "k string, start timestamp_ntz")
    rows = spark.createDataFrame([("a", at(7), 1), ("a", at(8), 2), ("a", at(9), 3), ("b", at(1), 4), ("a", at(14.9), 5), ("a", at(16), 6)], "k string, ts timestamp_ntz, id int")
    got = {r.k: r.match.id if r.match else None for r in series.newest_match(probes, rows, ["k"], "start", "ts", horizon_ms=horizon).collect()}
    assert got == {"a": 5 if horizon else 6, "b": None, "c": None}


def test_changed_parameters(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "1", "b": "3", "c": "4"})], "x map<string,string>, y map<string,string>")
    got = df.select(series.changed_parameters(F.col("x"), F.col("y")).alias("m")).collect()[0].m
    assert {k: tuple(v) for k, v in got.items()} == {"b": ("2", "3"), "c": (None, "4")}


def test_profiles(spark):
    rows = [("normal", 1, "GET", "http://h/p?a=1&a=2&=z", {"host": ["h"]}, b""), ("normal", 2, "POST", "/p", {"content-type": ["application/x-www-form-urlencoded"]}, b"x=1"), ("anomalo", 3, "GET", "/p?b=<x>", {}, b"")]
    df = spark.createDataFrame([(c, s, m, t, "1.1", h, bytearray(b), []) for c, s, m, t, h, b in rows], "corpus string, seq bigint, method string, target string, version string, headers map<string,array<string>>, body binary, malformed array<string>")
    fields = profile.observed(df)
    seen = {(r.corpus, r.seq, r.field): r["values"] for r in fields.collect()}
    assert seen["normal", 1, "query_param:a"] == ["1", "2"] and seen["normal", 1, "query_param:<nome-vazio>"] == ["z"] and seen["normal", 2, "body_param:x"] == ["1"] and ("anomalo", 3, "headers") not in seen
    p = profile.field_profile(fields, df.groupBy("corpus", "method").agg(F.count("*").alias("n")))
    told = {(r.corpus, r.field): r for r in p.collect()}
    assert told["normal", "request.target"].presence == "todas" and told["normal", "url.query"].percent == 50.0 and told["normal", "url.query"].some_methods_only
    cmp = {r.campo: r for r in profile.compare_fields(p).collect()}
    assert cmp["query_param:a"].comparacao == "somente no normal" and cmp["url.query"].diferenca_anomalo_menos_normal_pp == 50.0
    assert [r.campo for r in profile.top_differences(profile.compare_fields(p), 2).collect()] == ["url.query", "query.parameters"]
    s = {(r.corpus, r.method): r for r in profile.method_stats(df, fields).collect()}
    assert s["normal", "GET"].mean_query_parameters == 3.0 and s["normal", "POST"].percent_with_form == 100.0
    ex = {r.field: r.examples for r in profile.examples(fields.where("corpus = 'normal'")).collect()}
    assert ex["query_param:a"] == ["<inteiro; 1 caracteres>"]


def test_history(spark):
    rows = [(i, "BLOQUEIA" if i % 3 == 0 else "LIBERA", "LIBERA", "BLOQUEIA" if i % 2 else "LIBERA") for i in range(100)]
    h = spark.createDataFrame(rows, "t int, operational_decision string, e1_decision string, e2_decision string")
    s = history.summary(h).collect()[0]
    assert (s.total, s.allowed, s.blocked, s.disagreements) == (100, 66, 34, 50)
    assert [r.t for r in history.page(h, ["t"], 99, 30).collect()] == list(range(9, -1, -1)) and history.page(h, ["t"], 0, 500).count() == 50


def test_architectures(spark):
    df = spark.createDataFrame([([76, 77, 1],), ([9, 10, 4, 1],)], "a array<int>")
    a, b = (r.c for r in df.select(history.architecture_candidates(F.col("a")).alias("c")).collect())
    assert (list(a.wider), list(a.deeper), list(b.wider), list(b.deeper)) == ([76, 116, 1], [76, 77, 39, 1], [9, 13, 5, 1], [9, 10, 4, 2, 1])
    assert [r.n for r in df.select(history.parameter_count(F.col("a")).alias("n")).collect()] == [6007, 149]
    texts = spark.createDataFrame([("64, 32",), ("8x4 → 2",), ("a",), ("0",), ("",)], "t string").select(history.hidden_layers(F.col("t")).alias("h")).collect()
    assert [r.h for r in texts] == [[64, 32], [8, 4, 2], None, None, None]
    bad = spark.createDataFrame([([76, 1],), ([76, 600, 1],), ([75, 3, 1],), ([76, 512, 512, 1],), ([76, 77, 1],)], "a array<int>").select(history.request_problem(F.col("a"), F.lit(76)).alias("p")).collect()
    assert [r.p is None for r in bad] == [False, False, False, False, True]


def test_diagnosis(spark):
    rate = "struct<accuracy:double,precision:double,recall:double,f1:double,fpr:double,fnr:double>"
    good, poor = (0.99, 0.98, 0.98, 0.98, 0.01, 0.02), (0.7, 0.7, 0.7, 0.70, 0.40, 0.3)
    rows = [("bp", good, good, 100, None, 0.0, 0.1, 5.0, None, None), ("bp", poor, poor, 100, None, 0.05, 0.7, 40.0, None, None), ("ag", poor, poor, 20, 9000, 0.0, 0.0, None, 0.1, 9000), ("bp", good, poor, 100, None, 0.0, 0.0, 0.0, None, None)]
    df = spark.createDataFrame(rows, f"algorithm string, train {rate}, validation {rate}, population int, x int, improvement double, oscillation double, saturation double, diversity_ratio double, genes int")
    got = history.diagnosis(df).collect()
    codes = [[r.code for r in g.recommendations] for g in got]
    assert [g.status for g in got] == ["aceitavel", "investigar", "investigar", "investigar"]
    assert codes[0] == ["keep_architecture", "enough", "keep_learning_rate", "coherent", "baseline"]
    assert codes[1] == ["try_more_capacity", "train_longer", "lower_learning_rate", "coherent", "fewer_false_positives"]
    assert codes[2][:3] == ["retry_optimizer_first", "longer_is_not_enough", "larger_population"] and codes[3][0] == "do_not_grow"


def test_rewards_and_states(spark):
    df = spark.createDataFrame([(99.99, False), (100.0, False), (249.99, False), (250.0, False), (1.0, True)], "l double, t boolean")
    assert [r.r for r in df.select(load.reward(F.col("l"), F.col("t")).alias("r")).collect()] == [20, 2, 2, -15, -100]
    means = spark.createDataFrame([(20.0,), (50.0,), (80.0,), (34.0,), (67.0,)], "m double").select(load.state_of(F.col("m")).alias("s")).collect()
    assert [r.s for r in means] == ["carga_baixa", "carga_media", "carga_alta", "carga_media", "carga_alta"]
    one = spark.range(1)
    assert one.select(load.decayed(F.lit(40.0), F.lit(2.0)).alias("a"), load.decayed(F.lit(1.0), F.lit(1.0)).alias("b")).collect()[0][:] == (28.0, 0.0)
    r = one.select(load.operational_reward(F.lit(80.0), F.lit(False), F.lit(50.0), F.lit(1), F.lit(False)).alias("a"), load.operational_reward(F.lit(80.0), F.lit(False), F.lit(50.0), F.lit(1), F.lit(True)).alias("b")).collect()[0]
    assert r.a.total == 20.0 and r.b.saturation_penalty == 25.0
    assert one.select(balancing.concurrency_limit({n: F.lit(50.0) for n in load.NODES}).alias("n")).collect()[0].n == 6


def test_verdicts(spark):
    rows = [(10, 348.6, 10, 348.7, 300), (12, 200.0, 2, 250.0, 100), (0, 100.0, 0, 80.0, 100), (0, 80.0, 0, 100.0, 100), (1, 80.0, 0, 10.0, 100)]
    df = spark.createDataFrame(rows, "a int, b double, c int, d double, n int").select(load.verdict(*[F.col(c) for c in "abcdn"]).alias("v"))
    assert [r.v.winner for r in df.collect()] == [None, "q_learning", "q_learning", "round_robin", None]


def test_learning():
    learner = balancing.Learner(1)
    learner.q["carga_baixa"]["node1"] = 10.0
    learner.q["carga_media"]["node2"] = 20.0
    assert learner.update("carga_baixa", "node1", 2.0, "carga_media") == 12.25
    assert learner.choose("carga_baixa", 0.0) == ("node1", "explotacao") and learner.choose("carga_baixa", 1.0)[1] == "exploracao"
    waits = sorted(r["latency_ms"] for r in balancing.schedule("round_robin", 60, 6))
    assert round(float(np.mean(waits)), 1) == 265.1 and round(waits[math.ceil(0.95 * 60) - 1], 1) == 494.0


def test_replay_of_sessions(spark):
    df = spark.createDataFrame([(s, i, 0.0) for s in ("a", "b") for i in range(200)], "session string, step bigint, extra_ms double")
    log = balancing.replay(df).orderBy("session", "step").collect()
    learner, epsilon = balancing.Learner(7), load.EPSILON
    for i, r in enumerate([r for r in log if r.session == "a"]):
        state = load.STATES[i % 3]
        action, mode = learner.choose(state, epsilon)
        cluster = balancing.Cluster(load.STATE_LOAD[state])
        cluster.arrive(action)
        assert (r.step, r.state, r.action, r.mode, r.latency_ms, r.epsilon) == (i + 1, state, action, mode, cluster.wait(action), epsilon)
        assert r.q_value == learner.update(state, action, r.reward, load.STATES[(i + 1) % 3])
        epsilon = max(load.EPSILON_LEAST, epsilon * load.EPSILON_DECAY)
    c = {r.session: r for r in balancing.counters(spark.createDataFrame(log)).collect()}
    assert c["a"].steps == 200 and c["a"].explorations + c["a"].exploitations == 200 and c["a"].reward_total == c["b"].reward_total


def test_control_rows_set_loads(spark):
    rows = [("s", 0.0, None), ("s", 1.0, {"node1": 95.0}), ("s", 1.0, None), ("s", 1.5, None)]
    got = balancing.online_session(spark.createDataFrame(rows, "session string, at double, loads map<string,double>"), seed=3).orderBy("step").collect()
    assert len(got) == 3 and all(r.action != "node1" for r in got[1:])


def test_bursts(spark):
    rows = [("p", "node1", float(i), i > 50, None) for i in range(1, 61)]
    b = balancing.burst_summary(spark.createDataFrame(rows, "policy string, node string, latency_ms double, timeout boolean, error string")).collect()[0]
    assert (b.requests, b.timeouts, b.under_100ms, b.average_latency_ms, b.p95_latency_ms) == (60, 10, 50, 25.5, 48.0)
    q = spark.createDataFrame([("s", "node1", 1.0), ("s", "node3", 2.0), ("s", "node2", 2.0)], "state string, action string, q double")
    assert balancing.greedy_policy(q).collect()[0].action == "node2" and balancing.valid_q_table(q).count() == 12


def test_deviation_of_offset_values(spark):
    """A common offset costs no digits."""
    rows = [(1e9 + n,) for n in (0, 1, 2)] + [(None,), (float("nan"),)]
    r = stats.summary(spark.createDataFrame(rows, "v double"), ["v"]).collect()[0]
    assert math.isclose(r.stddev, (2 / 3) ** 0.5, rel_tol=1e-9) and (r.valid, r.missing, r.mean) == (3, 2, 1e9 + 1)


def test_backpropagation_learns():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(200, 2))
    y = (x[:, 0] > x[:, 1]).astype(float)
    net, log = training.backpropagate([2, 4, 1], x, y, 30, 0.5, 1, (x[:50], y[:50]))
    assert log[-1]["train_mse_after_epoch"] < 0.5 * log[0]["train_mse_after_epoch"] and len(log) == 30 and net.sizes == [2, 4, 1]
    one = training.Network([1, 1], [np.array([[0.5], [2.0]])])
    z = 1 / (1 + math.exp(-(3.0 * 2 - 0.5)))
    err, given, scale = one.learn(np.array([[3.0]]), np.array([1.0]), 0.1)
    changes = given[0][0][:, None] * scale[0][0]
    assert math.isclose(err[0, 0], 1 - z) and math.isclose(changes[1, 0], 0.1 * 3 * z * (1 - z) * (1 - z)) and math.isclose(changes[0, 0], -0.1 * z * (1 - z) * (1 - z))
    assert math.isclose(one.weights[0][1, 0], 2.0 + changes[1, 0])


def test_steps_of_backpropagation():
    """Step by step, by the rule: slope of each layer, errors back through the weights alone."""
    rng = np.random.default_rng(4)
    x, y = rng.uniform(size=(12, 3)), rng.uniform(size=12)
    net = training.Network.random([3, 4, 2, 1], rng)
    w = [v.copy() for v in net.weights]
    errors, given, scale = net.learn(x, y, 0.3)
    for n in range(12):
        acts = [x[n]]
        for v in w:
            acts.append(1 / (1 + np.exp(-(acts[-1] @ v[1:] - v[0]))))
        error = y[n] - acts[-1]
        assert np.allclose(errors[n], error)
        for i in (2, 1, 0):
            change = 0.3 * np.outer(np.r_[-1.0, acts[i]], acts[i + 1] * (1 - acts[i + 1]) * error)
            assert np.allclose(given[i][n][:, None] * scale[i][n], change)
            error = w[i][1:] @ error
            w[i] = w[i] + change
    assert all(np.allclose(a, b) for a, b in zip(w, net.weights, strict=True))


@pytest.mark.parametrize(("selection", "crossover", "mutation"), [(1, 1, 1), (2, 2, 2), (1, 2, 3)])
def test_evolution(selection, crossover, mutation):
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(80, 2))
    y = (x[:, 0] > 0.5).astype(float)
    net, log = training.evolve([2, 3, 1], x, y, 1, population=20, generations=15, selection=selection, crossover=crossover, mutation=mutation)
    best = [r["global_best_train_mse"] for r in log]
    assert best == sorted(best, reverse=True) and math.isclose(training.mse(net, x, y), best[-1]) and np.abs(net.genes()).max() <= 1


def test_distributed_fitness(spark):
    rng = np.random.default_rng(0)
    x, y = rng.uniform(size=(30, 2)), rng.integers(0, 2, 30).astype(float)
    genes = rng.uniform(-1, 1, (7, training.Network.parameter_count([2, 3, 1])))
    df = spark.createDataFrame([(i, g.tolist()) for i, g in enumerate(genes)], "individual bigint, genes array<double>")
    got = {r.individual: r.cost for r in training.fitness(df, [2, 3, 1], x, y).collect()}
    assert all(math.isclose(got[i], training.mse(training.Network.from_genes([2, 3, 1], g), x, y), abs_tol=1e-9) for i, g in enumerate(genes))
    assert math.isclose(training.gene_statistics(df).collect()[0].population_diversity, genes.std(axis=0).mean())


def test_fitness_over_a_whole_table(spark, tmp_path):
    import __spark_entry__ as entry

    rng = np.random.default_rng(1)
    docs = [(i, int(n)) for i, n in enumerate(rng.integers(1, 900, 2600))]
    labels = [(i, int(t), float(q)) for i, t, q in zip(range(2600), np.arange(2600) // 1300, rng.uniform(size=2600), strict=True)]
    spark.createDataFrame(docs, "doc_id bigint, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int, quality double").write.parquet(f"{tmp_path}/labels.parquet")
    x = np.array([[((n * 37 + i * 11) % 101 + t * 60 + (1 - q) * 20) / 181, q] for (i, n), (_, t, q) in zip(docs, labels, strict=True)])
    y = np.array([t for _, t, _ in labels], float)
    genes = np.array(POPULATION)
    got = {r.individual: r.cost for r in entry.queries()["ga_fitness"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(64))
    assert all(math.isclose(got[i], training.mse(training.Network.from_genes([2, 3, 1], g), x, y), abs_tol=1e-9) for i, g in enumerate(genes))
    none = spark.createDataFrame([], "a double, b double, y double")
    assert [r.cost for r in training.table_fitness(genes[:2], [2, 3, 1], none, ["a", "b"], "y").collect()] == [None, None]


def test_request_problems(spark):
    from httplens.operators import validation as v

    good = {"population": "20", "generations": "5", "selection_type": "1", "tournament_size": "3", "crossover_type": "2", "crossover_rate": "0.8", "sbx_eta": "1", "mutation_type": "3", "mutation_rate": "0", "mutation_sigma": "0.1", "mutation_eta": "20", "weight_min": "-1", "weight_max": "1"}
    cases = [{}, {"population": "21"}, {"tournament_size": "50"}, {"weight_min": "2"}, {"generations": "1.5"}, {"sbx_eta": "x"}, {"mutation_type": "4"}]
    df = spark.createDataFrame([tuple((good | c).values()) for c in cases], list(good))
    got = [r.p for r in df.select(v.genetic_problems().alias("p")).collect()]
    assert got == [[], ["population_even"], ["tournament_size"], ["weight_order"], ["generations"], ["sbx_eta"], ["mutation_type"]]
    bp = spark.createDataFrame([("1", "0"), ("2000", "1"), (None, "0.5")], "epochs string, learning_rate string")
    assert [r.p for r in bp.select(v.problems(v.BACKPROPAGATION).alias("p")).collect()] == [["learning_rate"], [], ["epochs"]]
    rl = spark.createDataFrame([(10, 6, 1), (9, 501, 31)], "episodes int, requests int, concurrency int")
    assert [r.p for r in rl.select(F.concat(v.problems(v.BALANCER_TRAINING), v.problems(v.BALANCER_COMPARISON)).alias("p")).collect()] == [[], ["episodes", "requests", "concurrency"]]


def test_shuffles(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "i bigint")
    a = [r.i for r in partition.shuffled(df, 1, "i").collect()]
    assert a == [r.i for r in partition.shuffled(df.repartition(3), 1, "i").collect()] and a != sorted(a) and sorted(a) == list(range(50))
    want = list(range(20))
    random.Random(20260917).shuffle(want)
    assert partition.reference_shuffle(20, 20260917) == want
