"""Sharding, mixing, nearest neighbours and the pipeline."""

import hashlib
import math

import numpy as np
import pytest
from brute import components, secrets, simhash, words

from httplens.llm import ann, mixing, sharding
from httplens.llm.queries import oracle_sql, queries


def _check_shards(rows, limit):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    names = sorted(by)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False)), "a bucket's prefix is no other's"
    for name, own in by.items():
        total = sum(r["n_bytes"] for r in own)
        assert all((r["shard_bytes"], r["shard_rows"], r["depth"]) == (total, len(own), len(name)) for r in own)
        assert total <= limit or len(own) == 1
        assert all(r["oversize"] == (total > limit) for r in own)
    return by


@pytest.mark.parametrize(("limit", "step"), [(1000, 2), (3000, 12), (1 << 30, 12)])
def test_sharding(docs, rows, limit, step):
    got = sharding.assign(docs, limit=limit, step=step).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in rows)
    assert {r["doc_id"]: r["n_bytes"] for r in got} == {r["doc_id"]: len((r["text"] or "").encode()) for r in rows}
    by = _check_shards(got, limit)
    for name in by:  # only oversized buckets were split
        if name:
            above = [r for r in got if r["shard"].startswith(name[:-1])]
            assert sum(r["n_bytes"] for r in above) > limit


def test_shards_of_one_repeated_id(spark):
    df = spark.createDataFrame([(7, "x" * 100)] * 40 + [(None, "y" * 50)] * 10, "doc_id bigint, text string")
    _check_shards(sharding.assign(df, limit=300).collect(), 300)
    assert sharding.assign(df.where("false")).collect() == []


def test_shards_of_one_id_agree_on_reruns(spark):
    df = spark.createDataFrame([(7, f"{i} " * 30) for i in range(60)] + [(None, f"{i} " * 20) for i in range(20)], "doc_id bigint, text string")
    own = lambda d: sorted((tuple(r) for r in sharding.assign(d, limit=500).collect()), key=str)
    assert own(df.repartition(3)) == own(df.repartition(5))
    with pytest.raises(ValueError, match="repeats"):
        sharding.write_shards(df, "/nowhere", limit=500)


def test_written_shards(spark, docs, tmp_path):
    dealt = sharding.write_shards(docs, str(tmp_path / "s"), limit=2000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count()
    want = {r["doc_id"]: r["shard"] for r in dealt.collect()}
    assert {p.name.split("=")[1] for p in (tmp_path / "s").iterdir() if p.is_dir()} == {x or "__HIVE_DEFAULT_PARTITION__" for x in want.values()}


def _targets(sizes: dict, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in fixed]
        left, units = total - sum(fixed.values()), sum(w[n] for n in free)
        share = {n: left * w[n] / units for n in free}
        over = [n for n in free if share[n] >= most * sizes[n]]
        if not over:
            return fixed | share
        fixed |= {n: most * sizes[n] for n in over}
        if len(fixed) == len(names):
            return fixed


def test_mixing(docs, rows):
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    want = _targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        g = got[r["doc_id"]]
        assert g["size"] == len(words(r["text"])) and g["source_size"] == sizes[r["source"]]
        assert math.isclose(g["target"], want[r["source"]], rel_tol=1e-12)
        assert 0 <= g["taken"] <= 3 * g["size"] and (not g["positions"]) == (g["taken"] == 0)
        assert all(0 <= p < 1 for p in g["positions"])
        taken[r["source"]] += g["taken"]
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)
    assert {k: tuple(v) for k, v in got.items()} == {r["doc_id"]: tuple(r) for r in mixing.mix(docs.repartition(2)).collect()}


def test_mixing_small_sources(spark, none):
    data = [(1, "a " * 100, "big"), (2, "b", "tiny"), (3, None, "nothing"), (4, "c d", None), (4, "c d", None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    got = mixing.mix(df).collect()
    want = _targets({"big": 100, "tiny": 1, "nothing": 0, None: 4})
    assert all(math.isclose(r["target"], want[r["source"]], rel_tol=1e-12) for r in got) and len(got) == 5
    assert mixing.mix(none).collect() == []
    mixed = [r["doc_id"] for r in mixing.mixed(df).collect()]
    assert mixed.count(2) == 3 and 3 not in mixed


def test_copies_follow_the_schedule(spark):
    """Words of a repeated source, cumulated over t, meet its demand to the size of a document."""
    data = [(i, " ".join(f"w{i}" for _ in range(5)), "abc"[i % 3]) for i in range(60)] + [(1000, "x " * 5000, "d")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string").repartition(3)
    plan = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    assert all(plan[i]["copies"] == 3 for i in range(60))
    for n, s in enumerate("abc"):
        g, own = mixing.SLOPES[n], [r for r in plan.values() if r["source"] == s]
        due = sorted(p for r in own for p in r["positions"])
        target = own[0]["target"]
        assert len(due) == 60 and due[-1] > 0.9 and target == 300
        assert all(list(r["positions"]) == sorted(set(r["positions"])) for r in own)
        for t in np.linspace(0, 1, 41):
            assert abs(5 * sum(p <= t for p in due) - target * (t + g * (t * t - t))) <= 5 + 1e-6
    part = plan[1000]
    assert len(part["positions"]) == part["copies"] + (part["part"] > 0)
    h = {i: hashlib.md5(f"{i}:{t}".encode()).hexdigest() for i, t, _ in data}  # of equal positions the smaller hash comes first
    order = sorted((p, h[i], i) for i, r in plan.items() for p in r["positions"][: r["copies"] + (2 * r["part"] >= r["size"])])
    assert [r["doc_id"] for r in mixing.mixed(df).collect()] == [i for *_, i in order]


def test_every_tenth_of_training_follows_the_schedules(spark):
    """By numbers alone: the words of a source that are due by t are the integral of its schedule."""
    rng = np.random.default_rng(3)
    data = [(i, " ".join(["w"] * int(rng.integers(1, 30))), "abcdef"[int(rng.choice(6, p=[0.6, 0.2, 0.1, 0.05, 0.03, 0.02]))]) for i in range(1500)]
    rows = mixing.mix(spark.createDataFrame(data, "doc_id bigint, text string, source string").repartition(7)).collect()
    firsts = [r["positions"][0] for r in rows if r["positions"]]
    assert firsts == sorted(firsts)
    for n, s in enumerate("abcdef"):
        own = [r for r in rows if r["source"] == s]
        slope, target = mixing.SLOPES[n % 3], own[0]["target"]
        due = [(p, r["size"] if k < r["copies"] else r["part"]) for r in own for k, p in enumerate(r["positions"])]
        assert sum(w for _, w in due) == math.floor(target)
        steps = np.linspace(0, 1, 20001)
        demand = np.cumsum(1 + slope * (2 * (steps[:-1] + 0.5 / 20000) - 1)) / 20000 * target
        for tenth in range(1, 11):
            got = sum(w for p, w in due if p < tenth / 10)
            assert abs(got - demand[2000 * tenth - 1]) <= 31


def test_mixed_rows_of_one_id(spark, none):
    """Rows that repeat an id are taken each for itself; any column names; empty tables."""
    data = [(1, "a " * 50, "big", 1), (1, "b " * 40, "big", 2), (None, "c " * 9, "s", 3), (None, "d", "s", 4), (None, "d", "s", 4), (2, "e f g", "t", 5)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string, h int").withColumnRenamed("h", "positions")
    plan = mixing.mix(df).collect()
    assert len(plan) == 6 and mixing.mixed(none).collect() == [] and mixing.mixed(df).columns == df.columns
    times = sorted((r["doc_id"] or 0, r["size"], r["copies"] + (2 * r["part"] >= r["size"])) for r in plan if r["taken"])
    out = [((r["doc_id"] or 0), len(words(r["text"]))) for r in mixing.mixed(df).collect()]
    assert sorted(out) == sorted((d, n) for d, n, k in times for _ in range(k))


def test_many_sources_are_numbered_in_order(spark):
    names = [f"h{n:04d}" for n in range(500)] + [None]
    df = spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "source string, size bigint").repartition(6)
    got = {r["source"]: r["rank"] for r in mixing.numbered(df).collect()}
    assert got == {n: i + 1 for i, n in enumerate(names)}
    want = _targets({n: i + 1 for i, n in enumerate(names)})
    assert all(math.isclose(r["target"], want[r["source"]], rel_tol=1e-12) for r in mixing.targets(df).collect())


def test_position_inverts_demand():
    for g in mixing.SLOPES:
        for y in np.linspace(0, 0.999, 50):
            t = 2 * y / ((1 - g) + math.sqrt((1 - g) ** 2 + 4 * g * y))
            assert 0 <= t <= 1 and math.isclose(t + g * (t * t - t), y, abs_tol=1e-12)


def test_heap_visits_cells_in_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    index = ann.Index(x, 7)
    x = x - index.mean
    for q in x[:10]:
        seen = list(index.visit(q + index.mean))
        assert sorted(seen) == list(range(index.size))
        a = ann._distances(q[None, :3], index.books[0])[0]
        b = ann._distances(q[None, 3:], index.books[1])[0]
        d = [a[c // len(b)] + b[c % len(b)] for c in seen]
        assert all(x <= y + 1e-12 for x, y in zip(d, d[1:], strict=False))


def _nearest(rows, every=100, k=10):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for q, v in ok:
        if q % every == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in ok if i != q)[:k]
            out[q] = near
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1500)]
    rows += [(1600 + i, [1.0] * 8) for i in range(40)] + [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] * 8), (2300, [1.0, None] + [1.0] * 6), (None, [1.0] * 8), (2400, [float("inf")] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label string").repartition(4)
    want = _nearest(rows)
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert set(got) == set(want) and 2000 not in got and 2100 not in got
    hits = 0
    for q, near in got.items():
        near.sort()
        assert [r for r, _, _ in near] == list(range(1, 11))
        assert [(s, v) for _, s, v in near] == sorted((s, v) for _, s, v in near)
        hits += len({v for _, _, v in near} & {v for _, v in want[q]})
    assert hits / (10 * len(want)) >= 0.9
    assert [v for _, _, v in got[1600]] == list(range(1601, 1611))


def _recall(spark, rows, kind="array<double>", **how):
    got, want = {}, _nearest(rows)
    for r in ann.search(spark.createDataFrame(rows, f"vec_id bigint, embedding {kind}").repartition(3), **how).collect():
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    truth = {q: {v for _, v in near} for q, near in want.items()}
    exact = dict(rows)
    for q, near in got.items():
        for r in near:
            assert r["score"] == math.sqrt(((np.array(exact[q]) - np.array(exact[r["vec_id"]])) ** 2).sum())
    return sum(len(truth[q] & {r["vec_id"] for r in near}) for q, near in got.items()) / sum(map(len, truth.values()))


@pytest.mark.parametrize(("spread", "offset"), [(1e-5, 1e4), (1e-3, 1e6), (1.0, 0.0)])
def test_neighbours_far_from_the_origin(spark, spread, offset):
    rng = np.random.default_rng(6)
    assert _recall(spark, [(i, (offset + spread * rng.normal(size=16)).tolist()) for i in range(1200)]) >= 0.9
    two = [(i, ((i % 2) * 1e6 + offset + 1e-3 * rng.normal(size=8)).tolist()) for i in range(600)]
    assert _recall(spark, two) >= 0.9


def test_neighbours_in_small_blocks(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(2000)] + [(3000 + i, [0.5] * 12) for i in range(300)]
    assert _recall(spark, rows, block=64) >= 0.9


def test_each_length_is_searched_by_itself(spark):
    """Whichever length comes first in the sample, no vector is lost."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    for stray in range(0, 300, 13):
        rows[stray] = (stray, rng.normal(size=3).tolist())
    got = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    size = {i: len(v) for i, v in rows}
    assert len(got) == 30 and all(size[r["query_id"]] == size[r["vec_id"]] for r in got)


def test_vectors_of_text_ids_and_clashing_names(spark):
    rows = [("0", [1.0, 0.0], 1), ("1", [0.0, 1.0], 2), ("x7", [1.0, 0.5], 3), (None, [1.0, 1.0], 4)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, block int").toDF("vec_id", "embedding", "score")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df).collect()] == [(0, 1, 1)]


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 3.0])], "vec_id bigint, embedding array<double>")
    assert [(r["rank"], r["vec_id"]) for r in ann.search(df).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.search(df.where("false")).collect() == []


def test_one_query_for_each_operator():
    names = [n for n in queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(oracle_sql()) <= set(names)


def test_noise_goes_and_short_texts_stay(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, "the thing with the other thing " * 5, "en", "s", 1) for i in range(40)] + [(100, "QJZXKV" * 9, None, "s", 1), (101, "QJZ", None, "s", 1), (102, "12 !", None, "s", 1), (103, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r["doc_id"] for r in pipeline.language_id(spark, docs, "").collect()}
    assert kept == {*range(40), 101}


def test_stages_on_odd_tables(spark):
    """Empty tables, nulls in every column, repeated rows and clashing column names."""
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, row int, found int, lang_pred string, at double, ids string"
    text = "the quick brown fox jumps over the lazy dog again and again token=abcdefgh"
    data = [(n, f"{text} {n}", "en", "s", 9, "x", 1, 2, "y", 0.5, "z") for n in range(3)] + [(1, f"{text} 1", "en", "s", 9, "x", 1, 2, "y", 0.5, "z")] * 2
    data += [(None,) * 11, (None, text, None, None, None, None, None, None, None, None, None), (9, None, "en", "s", 1, "x", 1, 2, "y", 0.5, "z")]
    df = spark.createDataFrame(data, schema)
    for docs, some in ((df.where("false"), False), (df, True)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, "")
            got = out.collect()
            assert bool(got) == some and (name == "bpe" or out.columns == df.columns)
            if name == "secrets":
                assert len(got) == docs.count() and all("token" not in (r["text"] or "") for r in got)
            if name == "near_dedup" and some:
                assert len(got) < len(data) and (9, None) in [(r["doc_id"], r["text"]) for r in got]


def test_pipeline(spark, tmp_path, rows, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    real = docs.select("doc_id", "text", "lang", "source", "n_chars")
    real.write.parquet(str(tmp_path / "documents.parquet"))
    at, seen = real, []
    for name, stage in pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen.append([r.asDict() for r in at.collect()])
    first = {r["doc_id"] for r in seen[0]}
    assert first == {r["doc_id"] for r in rows if r["text"] and any(c.isalpha() for c in r["text"])}
    left = [r for r in rows if r["doc_id"] in first]
    keep = components([simhash(r["text"]) for r in left], [r["doc_id"] for r in left])
    assert sorted(r["doc_id"] for r in seen[1]) == sorted(set(keep))
    assert sorted(r["doc_id"] for r in seen[2]) == sorted(r["doc_id"] for r in seen[1]) and not any(secrets(r["text"]) for r in seen[2])
    assert all(r["n_chars"] == len(r["text"]) for r in seen[2])
    counts = {}
    for r in seen[3]:
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert set(counts) <= {r["doc_id"] for r in seen[2]} and max(counts.values()) <= 3
    assert all(r["exact"] for r in seen[4]) and len(seen[4]) == len(seen[3])
    assert pipeline.run(spark, str(tmp_path)).count() == len(seen[4])
