"""Raw HTTP sources, files, sinks and streams."""

import base64
import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from httplens.operators import features, history, partition
from httplens.sources import raw_http, sinks, tables
from httplens.streaming import online

ONE = b"GET http://localhost:8080/a?b=1 HTTP/1.1\r\nHost: localhost\r\nX: 1\r\n 2\r\nX: 3\r\n\r\n"
TWO = b"POST /x HTTP/1.0\nContent-Length: 5\nContent-Type: application/x-www-form-urlencoded\n\nb=2\xe9&"


def test_strict_scan(spark, tmp_path):
    (tmp_path / "c.txt").write_bytes(b"\r\n" + ONE + b"\n\n" + TWO + ONE)
    rows = raw_http.scan(spark, str(tmp_path), "normal").orderBy("sequence").collect()
    assert [bytes(r.raw) for r in rows] == [ONE, TWO, ONE] and [r.sequence for r in rows] == [0, 1, 2]
    parsed = raw_http.requests(raw_http.scan(spark, str(tmp_path), "normal")).orderBy("sequence").collect()
    assert (parsed[0].method, parsed[0].target, parsed[0].version) == ("GET", "http://localhost:8080/a?b=1", "1.1") and parsed[0].headers == {"host": ["localhost"], "x": ["1 2", "3"]}
    assert bytes(parsed[1].body) == b"b=2\xe9&" and parsed[1].headers["content-length"] == ["5"]
    assert features.vector(raw_http.requests(raw_http.scan(spark, str(tmp_path), "normal"))).count() == 3
    assert raw_http.files(spark, str(tmp_path)).collect()[0].length == len(ONE) * 2 + len(TWO) + 4


@pytest.mark.parametrize("bad", [b"nonsense\n\n", b"GET / HTTP/1.1\nHost: x", b"GET / HTTP/1.1\nContent-Length: x\n\n", b"GET / HTTP/1.1\nContent-Length: -1\n\n", b"GET / HTTP/1.1\nContent-Length: 9\n\nabc"])
def test_strict_scan_fails(spark, tmp_path, bad):
    (tmp_path / "c.txt").write_bytes(bad)
    with pytest.raises(PySparkException):
        raw_http.scan(spark, str(tmp_path), "normal").collect()


def test_lenient_scan(spark, tmp_path):
    (tmp_path / "c.txt").write_bytes(b"junk\nmore junk\n" + ONE + b"PUT /p HTTP/1.1\nbroken line\nContent-Length: x\n\n" + b"GET /cut HTTP/1.1\nContent-Length: 9\n\nabc")
    rows = raw_http.scan_lenient(spark, str(tmp_path), "normal").orderBy("seq").collect()
    assert [r.method for r in rows] == ["GET", "PUT", "GET"] and rows[1].malformed == ["broken line"] and rows[0].headers["x"] == ["1 2", "3"] and bytes(rows[2].body) == b"abc"
    c = raw_http.parser_counters(raw_http.scan_lenient(spark, str(tmp_path), "normal")).collect()[0]
    assert (c.outside, c.folded, c.bad_length, c.truncated, c.messages) == (2, 1, 1, 1, 3)


def test_dataset_contract(spark, tmp_path):
    names = ("a", "b")
    (tmp_path / "ok.csv").write_text("a,b,label\n1,2.5,0\n3,4,1\n")
    assert [tuple(r) for r in tables.dataset(spark, str(tmp_path / "ok.csv"), names).collect()] == [(1.0, 2.5, 0), (3.0, 4.0, 1)]
    for name, text in (("label.csv", "a,b,label\n1,2,3\n"), ("nan.csv", "a,b,label\n1,NaN,1\n"), ("cell.csv", "a,b,label\n1,x,1\n"), ("header.csv", "a,c,label\n1,2,1\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception):  # noqa: B017
            tables.dataset(spark, str(tmp_path / name), names).collect()


def test_records_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/c.txt").write_bytes(ONE + TWO)
    raw = partition.identified(raw_http.scan(spark, str(tmp_path / "in"), "anomalo"))
    full = raw.select("*", raw_http.parsed(F.col("raw")).alias("r"), F.lit(1).alias("label")).select("record_id", "content_sha256", "label", "sequence", "raw", "r.*")
    sinks.write_records(sinks.reserved_records(full), str(tmp_path / "out"), ["source_sequence"])
    back = tables.reserved(spark, str(tmp_path / "out"))
    assert [bytes(r.raw) for r in history.verified(back).orderBy("source_sequence").collect()] == [ONE, TWO]
    row = back.orderBy("source_sequence").collect()
    assert (row[0].path, row[0].query, row[1].path, row[1].content_type) == ("/a", "b=1", "/x", "application/x-www-form-urlencoded") and base64.b64decode(row[1].body_base64) == b"b=2\xe9&"
    shown = history.public_record(back).collect()
    assert {r.expected_decision for r in shown} == {"BLOQUEIA"} and history.available(back).collect()[0].methods == ["GET", "POST"]
    assert history.sample(back, 1, "post").count() == 1 and history.by_id(back, row[0].record_id).count() == 1
    with pytest.raises(KeyError):
        history.by_id(back, "none")
    spoiled = back.withColumn("content_sha256", F.lit("0"))
    with pytest.raises(PySparkException):
        history.verified(spoiled).collect()
    m = json.loads(sinks.manifest(full.withColumn("partition", F.when(F.col("sequence") == 0, "development").otherwise("reserved"))).collect()[0].manifest)
    assert m["disjoint"] and m["records"] == 2 and [p["partition"] for p in m["partitions"]] == ["development", "reserved"]


def test_replay_headers(spark):
    h = {"User-Agent": ["a", "b"], "X-Other": ["c"], "Cookie": ["x\ny"], "Accept": ["*/*"], "X-Real-IP": ["1"]}
    r = spark.createDataFrame([(h,)], "h map<string,array<string>>").select(history.replay_headers(F.col("h")).alias("a"), history.without_proxy_headers(F.col("h")).alias("b")).collect()[0]
    assert r.a == {"User-Agent": "a, b", "Accept": "*/*"} and "X-Real-IP" not in r.b and "X-Other" in r.b


def test_history_files(spark, tmp_path):
    path = str(tmp_path / "h")
    row = ("2024-01-01T00:00:00", "GET", "/", "experimento_1:bp", "LIBERA", "bp", 0.1, "LIBERA", "ag", 0.2, "BLOQUEIA", 200)
    for _ in range(2):
        sinks.append_history(spark.createDataFrame([row], history.HISTORY), path)
    assert history.summary(tables.history(spark, path)).collect()[0].disagreements == 2
    sinks.clear_history(spark, path, history.HISTORY)
    assert tables.history(spark, path).count() == 0
    cells = spark.createDataFrame([("",), ("3",), ("2.5",), ("x",)], "v string").select(tables.sniffed(F.col("v")).alias("s")).collect()
    assert [tuple(r.s) for r in cells] == [(None, None, None), (3, None, None), (None, 2.5, None), (None, None, "x")]


def test_archiving_a_version_twice(spark, tmp_path):
    at = str(tmp_path / "archive")
    for name, rows in (("a", [(1,), (2,)]), ("b", [(3,)]), ("a", [(4,)])):
        sinks.archive(spark.createDataFrame(rows, "n int"), at, name)
    assert sorted((r.version, r.n) for r in spark.read.parquet(at).collect()) == [("a", 4), ("b", 3)]
    told = spark.sql("select timestamp '2024-03-05 06:07:08.9' as t").select(sinks.stamp(F.col("t")).alias("s")).collect()
    assert told[0].s == "20240305-060708"


def test_versions(spark, tmp_path):
    for name in ("20240101-bp", "20240102-bp"):
        d = tmp_path / name / "bp"
        d.mkdir(parents=True)
        (d / "resultado.json").write_text(json.dumps({"threshold": 0.5, "weights": [1], "parameters": {"epochs": 3}}))
    v = tables.versions(spark, str(tmp_path / "*-bp/bp/resultado.json"))
    assert [r.version for r in v.collect()] == ["20240101-bp", "20240102-bp"] and "weights" not in history.without_weights(v).columns


def test_streamed_load_and_sessions(spark, tmp_path):
    spark.createDataFrame([(i, n, float(i)) for n in ("node1", "node3") for i in range(5)], "event_id bigint, node string, at double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id bigint, node string, at double").parquet(str(tmp_path / "in"))
    q = online.residual_load(stream).writeStream.format("memory").queryName("loads").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    loads = lambda n: [round(r.load, 6) for r in spark.table("loads").where(f"node = '{n}'").orderBy("event_id").collect()]
    assert loads("node1") == [51.5, 47.0, 42.5, 38.0, 33.5]
    part = 1.5 / 0.05**0.5
    assert loads("node3") == [round(50 + (k + 1) * part - 6 * k, 6) for k in range(5)]
    t0 = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([("a", t0 + dt.timedelta(minutes=m)) for m in (0, 1, 2, 20)], "client string, ts timestamp")
    assert sorted(r.requests for r in online.sessions(ev, "client", "ts").collect()) == [1, 3]
