"""Registered queries of sources, sinks and streams: what they write is read again and returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import digests, forms, load
from ..functions.text import decode_once
from ..operators import balancing, features, history, partition, training
from ..sources import offsets, raw_http, sinks, tables
from ..sources.scratch import scratch
from ..streaming import online
from . import inputs as I  # noqa: N812
from .queries import LAYERS, QUERIES, _records, _reserved, query

__all__ = ["QUERIES"]

#: Inputs of the networks that score streams, as SQL over events.
STREAM_INPUTS = ("value / 100.0D", "(user_id % 7) / 7.0D", "(event_id % 11) / 11.0D", "(user_id % 3) / 3.0D")
#: First weights of a 2-2-1 network: for each layer a row for the bias, then one for each input.
FIRST_WEIGHTS = ([[0.25, -0.5], [0.75, 0.5], [-0.25, 1.0]], [[0.125], [0.5], [-0.75]])


def _written(df: DataFrame, how: str, **options) -> str:
    path = scratch(df.sparkSession)
    df.write.format(how).options(**options).save(path)
    return path


def _raw_pages(spark, d, lenient: bool) -> str:
    """Pages as a corpus of raw messages; a lenient one has lines that don't belong."""
    p = I.table(spark, d, "pages").select("page_id", "url", F.col("page_id").cast("string").alias("id"))
    bad = (F.col("page_id") % 5 == 0) & F.lit(lenient)
    body = F.when(bad | (F.col("page_id") % 2 == 0), "").otherwise(F.concat(F.lit("id="), "id", F.lit("&x=%20y\r\n\r\nz")))
    raw = F.concat(
        F.when(F.lit(lenient) & (F.col("page_id") % 4 == 0), "no request line\n").otherwise("\r\n"), F.when(F.col("page_id") % 2 == 0, "GET ").otherwise("post "), "url", F.lit(" HTTP/1.1\r\nHost: localhost:8080\r\nX-Page: "), "id",
        F.lit("\r\nX-Folded: a\r\n  b\r\nX-Twice: 1\r\nx-twice: 2\r\n"), F.when(F.lit(lenient) & (F.col("page_id") % 3 == 0), "a line without the separator\r\n").otherwise(""),
        F.lit("Content-Length: "), F.when(bad, "x").otherwise(F.length(body).cast("string")), F.lit("\r\n\r\n"), body,
    )
    return _written(p.select(raw.alias("value")), "text")


@query
def raw_requests(spark, d):
    """Strictly framed messages of a raw corpus, parsed."""
    r = raw_http.requests(raw_http.scan(spark, _raw_pages(spark, d, False), "pages"))
    first = lambda n: F.array_join(F.col("headers")[n], "|").alias(n.replace("-", "_"))
    return r.select(F.col("headers")["x-page"][0].cast("bigint").alias("page_id"), "method", "target", "version", first("x-folded"), first("x-twice"), first("content-length"), F.decode("body", "ISO-8859-1").alias("body"))


@query
def raw_sequences(spark, d):
    """Places of messages in their files are without gaps, and their bytes are all there."""
    s = raw_http.scan(spark, _raw_pages(spark, d, False), "pages")
    per = s.groupBy("path").agg(F.count("*").alias("n"), F.min("sequence").alias("lo"), F.max("sequence").alias("hi"), F.sum(F.octet_length("raw")).alias("bytes"))
    return per.agg(F.sum("n").alias("messages"), F.sum(F.when((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1), 0).otherwise(1)).cast("bigint").alias("with_gaps"), F.sum("bytes").alias("bytes"))


@query
def lenient_requests(spark, d):
    r = raw_http.scan_lenient(spark, _raw_pages(spark, d, True), "pages").where("method is not null")
    return r.select(F.col("headers")["x-page"][0].cast("bigint").alias("page_id"), "method", "target", "version", F.array_join(F.col("headers")["x-folded"], "|").alias("folded_value"), F.size("malformed").cast("bigint").alias("malformed"), F.decode("body", "ISO-8859-1").alias("body"))


@query
def parser_counters(spark, d):
    return raw_http.parser_counters(raw_http.scan_lenient(spark, _raw_pages(spark, d, True), "pages"))


@query
def file_digests(spark, d):
    """Length and digest of a file: the names of the regions, one a line."""
    path = _written(I.table(spark, d, "region").orderBy("r_regionkey").coalesce(1).select(F.col("r_name").alias("value")), "text")
    return raw_http.files(spark, path).where("length > 0").select("length", "sha256")


@query
def dataset_file(spark, d):
    """A dataset written as CSV and read under its contract."""
    x = I.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("label"))
    names, path = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax"], scratch(spark)
    sinks.write_dataset(x, path, names)
    back = tables.dataset(spark, path, tuple(names))
    return back.select(*[F.col(c).cast("bigint").alias(c) for c in names[:4]], *names[4:], "label")


@query
def small_dataset_file(spark, d):
    """The headerless form of nine columns and a label."""
    e = I.table(spark, d, "events")
    nine = [(F.col("event_id") % (n + 2) / (n + 1.0)).alias(c) for n, c in enumerate(list(tables.SMALL)[:-1])]
    back = tables.small_dataset(spark, _written(e.select(*nine, F.col("event_id").cast("double").alias("request_rate"), (F.col("event_id") % 2).cast("int").alias("label")), "csv"))
    return back.select(F.col("request_rate").cast("bigint").alias("event_id"), *[F.round(c, 9).alias(c) for c in list(tables.SMALL)[:-1]], "label")


@query
def reserved_file(spark, d):
    """Reserved records written as JSON lines, read, and checked against their hash."""
    path = scratch(spark)
    sinks.write_records(_reserved(spark, d), path, ["source_sequence"])
    back = history.verified(tables.reserved(spark, path))
    return back.select("source_sequence", "record_id", "label", "method", "target", "http_version", "path", "query", F.decode(F.unbase64("body_base64"), "UTF-8").alias("body"))


@query
def control_file(spark, d):
    path = scratch(spark)
    p = partition.select_top(_records(spark, d), 1000).withColumn("label", (F.col("dataset") == "F").cast("int"))
    sinks.write_records(sinks.control_records(p), path, ["source_sequence", "record_id"])
    return tables.control(spark, path).select("record_id", "content_sha256", "label", "partition", "source_sequence")


@query
def partition_summary(spark, d):
    """Counts of the manifest of a partition, read from its JSON."""
    p = partition.select_top(_records(spark, d), 1000).withColumn("label", (F.col("dataset") == "F").cast("int"))
    m = sinks.manifest(p).select(F.from_json("manifest", "records bigint, partitions array<struct<partition:string,records:bigint,attacks:bigint,ids_sha256:string>>, disjoint boolean").alias("m"))
    return m.select("m.records", "m.disjoint", F.inline("m.partitions").alias("partition", "own", "attacks", "ids_sha256"))


def _history_rows(spark, d) -> DataFrame:
    h = I.histories(spark, d)
    score = lambda c: F.when(F.col(c) == "BLOQUEIA", 0.75).otherwise(0.25)
    return h.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "method", F.concat(F.lit("/"), F.col("event_id").cast("string")).alias("target_path"), F.lit("experimento_1:bp").alias("primary_model"), "operational_decision", F.lit("bp").alias("e1_algorithm"),
        score("e1_decision").alias("e1_score"), "e1_decision", F.lit("ag").alias("e2_algorithm"), score("e2_decision").alias("e2_score"), "e2_decision", F.when(F.col("operational_decision") == "BLOQUEIA", 403).otherwise(200).alias("status_http"),
    )


@query
def history_file(spark, d):
    """A history appended in two parts and read again."""
    rows, path = _history_rows(spark, d), scratch(spark)
    blocked = F.col("status_http") == 403
    for part in (rows.where(blocked), rows.where(~blocked)):
        sinks.append_history(part, path)
    return tables.history(spark, path).groupBy("method", "status_http", "e2_decision").agg(F.count("*").alias("n"), F.min("target_path").alias("first"), F.sum("e1_score").alias("scores"))


@query
def cleared_history(spark, d):
    """Rows of a history before and after it is cleared."""
    path = scratch(spark)
    sinks.append_history(_history_rows(spark, d), path)
    before = tables.history(spark, path).count()
    sinks.clear_history(spark, path, history.HISTORY)
    return tables.history(spark, path).agg(F.count("*").alias("after")).select(F.lit(before).alias("before"), "after")


@query
def archived_versions(spark, d):
    """A version archived twice has the rows of the second time."""
    e, path = I.table(spark, d, "events").select("event_id", "event_type", "value"), scratch(spark)
    for kind, version in (("click", "a"), ("view", "b"), ("purchase", "a")):
        sinks.archive(e.where(F.col("event_type") == kind), path, version)
    back = spark.read.schema("event_id bigint, event_type string, value double, version string").parquet(path)
    return back.groupBy("version", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query
def version_stamps(spark, d):
    return I.table(spark, d, "events").select("event_id", sinks.stamp(F.col("ts")).alias("stamp"))


@query
def artifact_file(spark, d):
    """A JSON artifact: a list with nested values of each of the few order priorities."""
    o = I.table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    told = F.struct(F.col("o_orderpriority").alias("id"), F.struct("n", "top").alias("metrics"), F.array("n", F.lit(1).cast("bigint")).alias("architecture"))
    a = tables.artifact(spark, _written(o.agg(F.to_json(F.collect_list(told)).alias("value")), "text"))
    return a.select("id", F.col("metrics.n").alias("n"), F.col("metrics.top").alias("top"), F.col("architecture")[1].alias("last"))


@query
def version_folders(spark, d):
    """Results in folders of versions, without weights and diagnostics."""
    base = scratch(spark)
    for name, kind in (("20240101-bp", "click"), ("20240102-bp", "view")):
        r = I.table(spark, d, "events").where(F.col("event_type") == kind).agg(F.count("*").alias("n"), F.max("value").alias("threshold")).withColumn("weights", F.array(F.lit(1.0))).withColumn("diagnostic", F.lit("x"))
        r.select(F.to_json(F.struct("n", "threshold", "weights", "diagnostic")).alias("value")).coalesce(1).write.text(f"{base}/{name}/bp/")
    return history.without_weights(tables.versions(spark, f"{base}/*-bp/bp/part-*"))


@query
def split_file(spark, d):
    path = scratch(spark)
    sinks.write_split(partition.stratified(I.table(spark, d, "labels"), "toxic", [F.col("doc_id")]), path, "doc_id")
    return spark.read.parquet(path)


@query
def sniffed_cells(spark, d):
    """Kinds of the cells of a table that was written as CSV."""
    path = scratch(spark)
    sinks.write_csv(I.table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand", F.when(F.col("p_size") > 20, F.col("p_size")).alias("gap")), path)
    t = tables.diagnostics(spark, path)
    cells = t.select(F.expr("stack(4, 'p_size', p_size, 'p_retailprice', p_retailprice, 'p_brand', p_brand, 'gap', gap) as (name, cell)")).select("name", tables.sniffed(F.coalesce("cell", F.lit(""))).alias("s"))
    return cells.groupBy("name").agg(F.count("s.integer").alias("integers"), F.count("s.number").alias("numbers"), F.count("s.text").alias("texts"), F.sum("s.integer").alias("total"))


@query
def schema_files(spark, d):
    """The vector's features and the others, as their CSV files tell them."""
    out = []
    for name, df in (("final", features.final_schema(spark).drop("position")), ("removed", features.removed_schema(spark))):
        path = scratch(spark)
        sinks.write_csv(df, path)
        out.append(spark.read.csv(path, header=True).groupBy("origin", "kind").agg(F.count("*").alias("n"), F.min("feature").alias("first")).select(F.lit(name).alias("file"), "*"))
    return out[0].union(out[1])


@query
def contract_difference(spark, d):
    """Columns that a table lacks and has beyond a contract, and the digest of the frozen one."""
    missing, extra = partition.schema_difference(I.table(spark, d, "labels"), ("doc_id", "toxic", "sarcasm"))
    text = "".join(f"{n}\n" for n in features.FINAL)
    return spark.range(1).select(F.lit("|".join(missing)).alias("missing"), F.lit("|".join(extra)).alias("unexpected"), F.sha2(F.lit(text), 256).alias("contract"))


def _client_headers(spark, d) -> DataFrame:
    """Headers of a request for each event, some of the client, some of the proxy."""
    e = I.table(spark, d, "events")
    one = lambda k, v, when: F.when(when, F.create_map(F.lit(k), v)).otherwise(F.create_map().cast("map<string,array<string>>"))
    n = F.col("event_id")
    parts = [one("User-Agent", F.array(F.lit("agent"), "event_type"), n % 2 == 0), one("Cookie", F.array(F.concat(F.lit("a=1\n"), "event_type")), n % 3 == 0), one("Accept", F.array(F.lit("*/*")), F.lit(True)), one("X-Real-IP", F.array(n.cast("string")), n % 4 == 0), one("X-Other", F.array(F.lit("o")), n % 5 == 0)]
    return e.select("event_id", F.map_concat(*parts).alias("headers"))


@query
def replayed_headers(spark, d):
    told = lambda m, v: F.array_join(F.array_sort(F.transform(F.map_entries(m), v)), ";")
    h = _client_headers(spark, d)
    kept = told(history.replay_headers(F.col("headers")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return h.select("event_id", kept.alias("replayed"), told(history.without_proxy_headers(F.col("headers")), lambda x: x["key"]).alias("without_proxy"))


@query
def record_by_id(spark, d):
    """The record of the smallest id of a file of records, looked up by its offset; only its bytes are read."""
    path, index = scratch(spark), scratch(spark)
    sinks.write_records(_reserved(spark, d), path, ["source_sequence"])
    offsets.write_index(spark, path, index)
    least = spark.read.parquet(index).agg(F.min("id")).first()[0]
    found, _ = offsets.look_up(spark, index, [least], tables.RESERVED)
    return found.select("record_id", "source_sequence", "method")


@query
def shown_texts(spark, d):
    """Controls as spaces, trimmed, cut."""
    return I.table(spark, d, "conversations").select("conv_id", "turn", forms.sanitized_text(F.col("text"), 60).alias("shown"))


@query
def result_payload(spark, d):
    """One row for each kind of event as an experiment, with its days in order and its normaliser."""
    day = I.daily(spark, d)
    results = day.groupBy(F.col("event_type").alias("experiment")).agg(F.count("*").alias("days")).withColumn("algorithm", F.lit("bp"))
    series = day.select(F.col("event_type").alias("experiment"), F.lit("bp").alias("algorithm"), F.date_format("day", "yyyyMMdd").cast("bigint").alias("step"), "n")
    norm = day.groupBy(F.col("event_type").alias("experiment")).agg(F.max("n").alias("cap")).select("experiment", F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f).alias("feature"), F.lit("cap").alias("method"), (F.col("cap") * i).alias("cap")) for i, f in ((2, "b"), (1, "a"))])))
    p = history.payload(results, series, norm)
    told = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[n].cast("string") for n in names])), "|")
    return p.select("experiment", "algorithm", "days", told(F.col("series"), "step", "n").alias("series"), told(F.col("normalization"), "position", "feature", "cap").alias("normalization"))


@query
def hidden_layers(spark, d):
    """Layer sizes out of text in the forms that people write."""
    p = I.table(spark, d, "part")
    a, n = F.col("p_size").cast("string"), F.col("p_partkey")
    text = F.when(n % 4 == 0, a).when(n % 4 == 1, F.concat(a, F.lit(", 32"))).when(n % 4 == 2, F.concat(a, F.lit(" x 16→8"))).otherwise(F.concat(a, F.lit("; none")))
    return p.select("p_partkey", F.array_join(F.transform(history.hidden_layers(text), lambda x: x.cast("string")), "-").alias("layers"))


@query
def training_environments(spark, d):
    """What a request to each node meets in each state of load."""
    x = spark.createDataFrame([(s, n) for s in load.STATES for n in load.NODES], "state string, node string")
    e = balancing.training_environment(F.col("state"), F.col("node"))
    return x.select("state", "node", F.round(e["cpu"], 9).alias("cpu"), F.round(e["wait"], 9).alias("wait"))


@query
def concurrency_limits(spark, d):
    """Admissions until every node meets a limit, for loads taken from events."""
    e = I.table(spark, d, "events")
    return e.select("event_id", balancing.concurrency_limit({n: (F.col("event_id") * (k + 1) % 101).cast("double") for k, n in enumerate(load.NODES)}).cast("bigint").alias("limit"))


@query
def q_table_problems(spark, d):
    """What a table of values lacks and has beyond states and nodes: those that events show, and one more."""
    q = I.loads(spark, d).where("load < 67").select(load.state_of(F.col("load")).alias("state"), F.col("node").alias("action")).distinct()
    return balancing.valid_q_table(q.union(spark.createDataFrame([("carga_nula", "node9")], "state string, action string")))


@query
def checked_loads(spark, d):
    """Loads set by hand, after their check."""
    e = I.table(spark, d, "events")
    m = F.map_from_arrays(F.array(*[F.lit(n) for n in load.NODES]), F.array(*[(F.col("event_id") * (k + 3) % 101).cast("double") for k in range(3)]))
    return e.select("event_id", F.aggregate(F.map_values(balancing.validated_loads(m)), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query
def training_steps(spark, d):
    """Weights after one pass of backpropagation over all labelled documents in order of their id. A
    step needs the one before, so the rows are read by one trainer, as every training set is."""
    import numpy as np

    rows = I.scored(spark, d).select("doc_id", "score", "quality", "label").orderBy("doc_id").toPandas()
    net = training.Network([2, 2, 1], [np.array(w) for w in FIRST_WEIGHTS])
    net.learn(rows[["score", "quality"]].to_numpy(float), rows["label"].to_numpy(float), 0.25)
    return spark.createDataFrame([(n, float(round(g, 7))) for n, g in enumerate(net.genes().tolist())], "gene int, weight double")


def _stream(spark, d) -> DataFrame:
    schema = I.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _drained(stream: DataFrame) -> DataFrame:
    """All that a stream gives from what is there, written once and read again."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession)
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query
def streamed_rates(spark, d):
    """Requests of each user in the trailing minute, as a stream with state: four batches in order of
    time, each of which leaves half of its last hour to the next, and a heartbeat at the end."""
    e = I.table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    path, quarter = scratch(spark), (high - low) / 4
    own = F.least(F.lit(3), F.floor(F.expr(f"(unix_micros(ts) - {_micros(spark, low)}) div {int(quarter.total_seconds() * 1e6) + 1}"))).cast("int")
    hour_on = F.least(F.lit(3), F.floor(F.expr(f"(unix_micros(ts) + 3600000000L - {_micros(spark, low)}) div {int(quarter.total_seconds() * 1e6) + 1}"))).cast("int")
    dealt = e.withColumn("batch", F.when(F.col("event_id") % 2 == 0, own).otherwise(hour_on))
    beat = spark.range(1).select(F.lit(-1).cast("bigint").alias("event_id"), F.lit(None).cast(e.schema["user_id"].dataType).alias("user_id"), (F.lit(high) + F.expr("interval 1 day")).alias("ts"))
    for n in range(4):
        dealt.where(F.col("batch") == n).drop("batch").coalesce(1).write.mode("append").parquet(path)
    beat.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)
    r = _drained(online.request_rate(stream, client="user_id", late="2 hours"))
    return r.where("event_id >= 0").select("event_id", F.col("client").cast("bigint").alias("user_id"), "request_rate")


def _micros(spark, t) -> int:
    return spark.range(1).select(F.unix_micros(F.lit(t))).first()[0]


@query
def streamed_loads(spark, d):
    """Load of each node after each arrival, as a stream with state."""
    s = _stream(spark, d).select("event_id", F.concat(F.lit("node"), (F.col("user_id") % 3 + 1).cast("string")).alias("node"), (F.col("event_id") * 0.125).alias("at"))
    return _drained(online.residual_load(s)).select("event_id", "node", F.round("load", 6).alias("load"))


def _stream_decisions(spark, d) -> DataFrame:
    s = _stream(spark, d).select("event_id", "event_type", *[F.expr(x).alias(f"x{n}") for n, x in enumerate(STREAM_INPUTS)])
    names = [f"x{n}" for n in range(4)]
    return online.scored(s, names, (LAYERS, 0.55), (LAYERS, 0.6), "experimento_2")


@query
def streamed_decisions(spark, d):
    """Scores and decisions of two models on each event of a stream."""
    s = _stream_decisions(spark, d).select("event_id", "e1_score", "e1_decision", "e2_decision", "operational_decision")
    return _drained(s).withColumn("e1_score", F.round("e1_score", 9))


@query
def streamed_history(spark, d):
    """Decisions of a stream appended to a history file."""
    path = scratch(spark)
    s = _stream_decisions(spark, d).select("event_type", "e1_decision", "operational_decision")
    online.to_history(s, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    back = spark.read.schema("event_type string, e1_decision string, operational_decision string").csv(f"{path}/out", header=True)
    return back.groupBy("event_type", "e1_decision", "operational_decision").agg(F.count("*").alias("n"))


@query
def live_requests(spark, d):
    """Requests of a live source, a stream of JSON lines, with features of the vector."""
    r = I.pages_as_requests(spark, d).select(F.col("page_id").alias("id"), F.lit(None).cast("timestamp").alias("at"), "method", "target", "version", "headers", digests.plain_base64(F.col("body")).alias("body_base64"))
    stream = tables.live_requests(spark, _written(r, "json")).withColumn("body", F.unbase64("body_base64"))
    return _drained(features.candidates(stream, ("method_is_post", "body_length_bytes", "content_length_matches_body", "header_unique_count"), ("id",)))


def _people(spark, d) -> DataFrame:
    """Embeddings as genes, numbered by their ids, with a cost."""
    e = I.table(spark, d, "embeddings")
    genes = F.transform("embedding", lambda x: x.cast("double"))
    return e.select(F.col("vec_id").alias("individual"), genes.alias("genes"), (F.col("vec_id") * 37 % 101).cast("double").alias("cost"))


def _drawn(k: int, over: float = 97.0) -> F.Column:
    """An array of numbers from 0 to 1 for each individual, by rule."""
    return F.transform(F.sequence(F.lit(1), F.size("genes")), lambda g: (F.col("individual") * k + g * 31) % over / over)


@query
def ga_tournament(spark, d):
    """Parents by tournaments of three, drawn by rule."""
    p = _people(spark, d)
    draws = p.select(F.col("individual").alias("slot"), F.posexplode(F.array(*[F.floor(F.col("individual") * k / 7).cast("bigint") for k in (1, 3, 5)])).alias("turn", "individual"))
    return training.tournament(p.select("individual", "cost"), draws)


@query
def ga_roulette(spark, d):
    """Parents by shares of 1 / cost, drawn by rule."""
    p = _people(spark, d).select("individual", (F.col("cost") + 1).alias("cost"))
    draws = p.select(F.col("individual").alias("slot"), (F.col("individual") * 29 % 97 / F.lit(97.0)).alias("drawn"))
    return training.roulette(p, draws)


@query
def chromosomes(spark, d):
    """Genes as weights of a 7-7-1 network, summed by layer, and back to genes."""
    p = _people(spark, d).select("individual", "genes", F.when(F.size("genes") == training.Network.parameter_count([7, 7, 1]), training.layers_of(F.col("genes"), [7, 7, 1])).alias("layers"))
    row = lambda r: F.aggregate(F.transform(r, lambda x, j: x * (j + 1)), F.lit(0.0), lambda a, x: a + x)
    total = lambda n: F.round(F.aggregate(F.transform(F.col("layers")[n], lambda r, i: (i + 1) * row(r)), F.lit(0.0), lambda a, x: a + x), 6)
    return p.select("individual", total(0).alias("hidden"), total(1).alias("output"), (training.genes_of(F.col("layers")) == F.col("genes")).alias("same"))


@query
def ga_crossover(spark, d):
    """Children of each individual and the next, by one point and by simulated binary crossover."""
    p = _people(spark, d)
    pair = p.join(p.select((F.col("individual") - 1).alias("individual"), F.col("genes").alias("other")), "individual")
    one, two = training.crossed(F.col("genes"), F.col("other"), (F.col("individual") % 63 + 1).cast("int")), training.blended(F.col("genes"), F.col("other"), _drawn(13))
    total = lambda c: F.round(F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6)
    return pair.select("individual", one.alias("one"), two.alias("two")).select("individual", *[total(F.col(f"{c}.{side}")).alias(f"{c}_{side}") for c in ("one", "two") for side in ("first", "second")])


@query
def ga_mutation(spark, d):
    """Genes after each kind of mutation, where and how far by rule."""
    hits = F.transform(F.sequence(F.lit(1), F.size("genes")), lambda g: (F.col("individual") + g) % 5 == 0)
    total = lambda c: F.round(F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6)
    return _people(spark, d).select("individual", *[total(training.mutated(F.col("genes"), hits, _drawn(17), k)).alias(f"kind_{k}") for k in (1, 2, 3)])


@query
def client_sessions(spark, d):
    """Sessions of each user with gaps of more than an hour between them."""
    s = online.sessions(I.table(spark, d, "events"), "user_id", "ts", gap="1 hour")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("requests").alias("requests"), F.max("requests").alias("longest"))


@query
def decoded_bodies(spark, d):
    """Bodies of reserved records out of Base64, decoded once."""
    r = _reserved(spark, d).select("source_sequence", F.decode(F.unbase64("body_base64"), "UTF-8").alias("body"))
    return r.select("source_sequence", decode_once(F.col("body"), plus=True).alias("body"), F.length(digests.plain_base64(F.col("body").cast("binary"))).alias("size"))
