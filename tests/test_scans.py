"""Prefix scans over ranges of a series, order statistics by buckets, and rates over late rows."""

import datetime as dt
import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from httplens.operators import ranks, scan, series, stats
from httplens.streaming import online


@pytest.fixture
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _series(spark, n=900):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "a", "b", None]), i, rng.choice([None, float(rng.randint(-50, 50))])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, i int, v double").repartition(3)


@pytest.mark.parametrize("by", [["k"], []])
def test_scan_equals_windows(spark, many_ranges, by):
    df = _series(spark)
    got = scan.scan(df, by, ["i"], number="n", total="t", previous={"v": "p", "i": "q"}, least={"v": "m"})
    w = W.partitionBy(*(by or [F.lit(0)]))
    o = w.orderBy("i")
    want = df.select("*", F.row_number().over(o).alias("n"), F.count("*").over(w).alias("t"), F.lag("v").over(o).alias("p"), F.lag("i").over(o).alias("q"), F.min("v").over(o.rowsBetween(W.unboundedPreceding, 0)).alias("m"))
    key = lambda r: r.i
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == [tuple(r) for r in sorted(want.collect(), key=key)]
    spread = scan.ranged(df, by, ["i"]).where("k = 'a'").select(scan.RANGE).distinct().count()
    assert spread >= 4, "one series lies in several ranges"
    assert scan.scan(df.where("false"), by, ["i"], number="n", least={"v": "m"}).collect() == []


def test_no_task_holds_a_series(spark, many_ranges):
    plan = scan.scan(_series(spark), ["k"], ["i"], number="n", previous={"v": "p"})._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "windowspecdefinition" in line and "row_number" in line:
            assert scan.RANGE in line


def test_clamped_sums(spark, many_ranges):
    rng = random.Random(6)
    rows = [(rng.choice("aaab"), i, rng.uniform(-9, 9), rng.uniform(0, 3), 20.0) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i int, a double, l double, h double").repartition(4)
    got = {r.i: r.x for r in scan.clamped_sums(df, ["k"], ["i"], "a", "l", "h", 10.0, "x").collect()}
    x = {"a": 10.0, "b": 10.0}
    for k, i, a, lo, hi in rows:
        x[k] = min(hi, max(lo, x[k] + a))
        assert got[i] == pytest.approx(x[k], abs=1e-9)


def test_residual_loads(spark, many_ranges):
    rows = [(n, i, t) for n in ("node1", "node3", "other") for i, t in enumerate([0.0, 1.0, 1.0, 30.0, 29.0, 29.5])]
    df = spark.createDataFrame(rows, "node string, i int, t double")
    got = {(r.node, r.i): r.load for r in series.residual_loads(df, "node", ["i"], "t").collect()}
    for n, part in (("node1", 1.5), ("node3", 1.5 / 0.05**0.5), ("other", 1.5)):
        load, last = 50.0, None
        for _, i, t in (r for r in rows if r[0] == n):
            load, last = min(100.0, max(0.0, load - 6.0 * max(0.0, t - last if last is not None else 0.0)) + part), t
            assert got[n, i] == pytest.approx(load, abs=1e-9)


def _counted(spark, n):
    rng = np.random.default_rng(3)
    rows = [("many", float(x), int(c)) for x, c in zip(rng.permutation(n) / 7, rng.integers(1, 4, n), strict=True)]
    rows += [("one", 2.5, 4), ("two", -1.0, 1), ("two", 3.0, 1), (None, 1.0, 10**6), (None, 2.0, 1), ("none", None, 5)]
    return rows, spark.createDataFrame(rows, "k string, value double, n bigint").repartition(8)


def test_quantiles_by_buckets(spark):
    rows, df = _counted(spark, 20_000)
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.995, 1.0]
    got = {r.k: r.q for r in ranks.quantiles(df, ["k"], shares).collect()}
    near = {r.k: r.q for r in ranks.nearest_rank(df, ["k"], 0.95).collect()}
    assert set(got) == {"many", "one", "two", None} == set(near)
    for k in got:
        values = np.sort(np.repeat([v for a, v, _ in rows if a == k], [c for a, _, c in rows if a == k]))
        assert got[k] == pytest.approx(np.quantile(values, shares).tolist())
        assert near[k] == values[max(1, math.ceil(len(values) * 95 / 100)) - 1]


def test_a_feature_of_many_values_is_sorted_by_many_tasks(spark):
    """A million distinct values: each sorted bucket holds a small part of them."""
    df = spark.range(1_000_000).select(F.lit("f").alias("k"), (F.col("id") * 7919 % 1_000_003).cast("double").alias("value"), F.lit(1).cast("bigint").alias("n"))
    told = ranks.quantiles(df, ["k"], [0.5, 0.99])
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
    over_values = [line for line in plan.splitlines() if "windowspecdefinition" in line and "value#" in line.split("windowspecdefinition", 1)[1]]
    assert over_values and all("bucket" in line.split("windowspecdefinition", 1)[1] for line in over_values)
    values = np.sort(np.arange(1_000_000) * 7919 % 1_000_003).astype(float)
    assert told.first().q == pytest.approx(np.quantile(values, [0.5, 0.99]).tolist())


def test_summary_of_a_shifted_column(spark):
    rng = random.Random(2)
    values = [1e9 + rng.randint(0, 5) for _ in range(400)]
    df = spark.createDataFrame([(v, None if i % 9 == 0 else float("nan") if i % 7 == 0 else v) for i, v in enumerate(values)], "a double, b double")
    got = {r.feature: r for r in stats.summary(df, ["a", "b"]).collect()}
    assert got["a"].stddev == pytest.approx(float(np.std(values)), abs=1e-6) and got["a"].median == np.median(values)
    own = [v for i, v in enumerate(values) if i % 9 and i % 7]
    assert (got["b"].valid, got["b"].p95) == (len(own), pytest.approx(np.quantile(own, 0.95)))
    empty = stats.summary(df.withColumn("a", F.lit(None).cast("double")), ["a"]).first()
    assert (empty.total, empty.valid, empty.median, empty.stddev) == (400, 0, None, 0.0)


def _run(spark, tmp_path, batches, name, late):
    """Rates of rows that come in batches, a heartbeat last."""
    schema = "event_id bigint, client string, ts timestamp"
    end = max(r[2] for b in batches for r in b) + dt.timedelta(days=1)
    for b in [*batches, [(-1, None, end)]]:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online.request_rate(stream, late=late).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    rows = [r for r in spark.table(name).collect() if r.event_id >= 0]
    assert len({r.event_id for r in rows}) == len(rows), "one row for each request"
    return {r.event_id: (r.client, r.ts, r.request_rate) for r in rows}


def test_late_rows_are_counted_and_later_ones_are_not(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    got = _run(spark, tmp_path, [[(1, "c", at(0)), (2, "c", at(90))], [(3, "c", at(30)), (4, "c", at(100))]], "late_rates", "10 minutes")
    assert {e: n for e, (_, _, n) in got.items()} == {1: 1, 3: 2, 2: 2, 4: 2}
    assert got[2][:2] == ("c", at(90))


def test_streamed_rates_equal_the_window(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "b", None]), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i * 9 + rng.random())) for i in range(160)]
    batches = [[], [], []]
    for n, r in enumerate(rows):
        batches[min(2, n // 60 + (n % 60 > 50 and rng.random() < 0.5))].append(r)
    got = _run(spark, tmp_path, batches, "window_rates", "3 minutes")
    assert len(got) == len(rows)
    for i, c, t in rows:
        assert got[i][2] == sum(d == c and 0 <= (t - u).total_seconds() <= 60 for _, d, u in rows)


def test_clamped_sums_over_batches(spark, monkeypatch):
    """A range of more rows than a batch: its map is carried from batch to batch, and no task holds a range."""
    plans, write = [], scan.written
    monkeypatch.setattr(scan, "written", lambda df: plans.append(df._jdf.queryExecution().toString()) or write(df))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, i, float((i * 37 % 23) - 11), float(i % 5), 40.0) for k in ("a", "b", None) for i in range(100)]
        df = spark.createDataFrame(rows, "k string, i bigint, a double, l double, h double")
        done = scan.clamped_sums(df, ["k"], ["i"], "a", "l", "h", 10.0, "x")
        got = {(r.k, r.i): r.x for r in done.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in ("a", "b", None):
        x = 10.0
        for _, i, a, lo, hi in (r for r in rows if r[0] == k):
            x = min(hi, max(lo, x + a))
            assert got[k, i] == pytest.approx(x, abs=1e-9)
    assert len(plans) == 2 and not any("InPandas" in p for p in plans)


def test_streamed_loads_hold_two_numbers_an_arrival(spark, monkeypatch):
    """A batch of 200,000 arrivals in two frames, not in order, and one after it."""
    found = []
    monkeypatch.setattr(GroupedData, "applyInPandasWithState", lambda self, f, *more: found.append(f))
    online.residual_load(spark.createDataFrame([("node1", 1, 1.0)], "node string, event_id bigint, at double"))

    class State:
        exists = False

        def update(self, x):
            self.get, self.exists = x, True

    n, state = 200_000, State()
    order = np.random.default_rng(5).permutation(n)
    frames = (pd.DataFrame({"node": ["node1"] * len(o), "event_id": o, "at": o * 0.125}) for o in np.array_split(order, 20))
    load, told = 50.0, 0
    tracemalloc.start()
    for f in found[0](("node1",), frames, state):
        for i, got in zip(f["event_id"], f["load"], strict=True):
            load = min(100.0, max(0.0, load - 6.0 * (0.125 if i else 0.0)) + 1.5)
            assert i == told and got == load
            told += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert told == n and state.get == (load, (n - 1) * 0.125) and peak < 60 * n
    last = list(found[0](("node1",), iter([pd.DataFrame({"node": ["node1"], "event_id": [n], "at": [n * 0.125]})]), state))
    assert last[0]["load"].tolist() == [min(100.0, max(0.0, load - 0.75) + 1.5)]
