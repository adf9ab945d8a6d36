"""Registered queries: every operator over the driver's tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import digests, forms, load
from ..functions.text import METRICS, content_metrics, decode_once
from ..functions.url import PARAMETER_METRICS, parameter_metrics, parameters, path_metrics, safe_path, split_target
from ..operators import balancing, features, history, partition, profile, scoring, series, small_model, stats, validation
from ..operators.training import gene_statistics, table_fitness
from ..sources import sinks
from . import inputs as I  # noqa: N812

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: A fixed network of 4 inputs, 3 hidden neurons and 1 output, neuron by neuron, bias first.
LAYERS = [
    [[0.25, 0.5, -0.75, 1.0, 0.125], [-0.5, 1.5, 0.25, -1.0, 0.75], [0.75, -0.25, 0.5, 0.25, -1.5]],
    [[0.5, 1.25, -0.75, 0.5]],
]
#: Genes of 64 individuals of a 2-3-1 network, by rule.
POPULATION = [[((7 * i + 13 * g) % 41 - 20) / 20 for g in range(13)] for i in range(64)]
URL_FEATURES = (
    "url_is_absolute", "url_parse_error", "url_scheme_is_http", "url_scheme_is_https", "url_scheme_is_other", "url_scheme_missing", "url_host_present", "url_host_length",
    "url_host_label_count", "url_host_is_ip", "url_userinfo_present", "url_port_present", "url_port_valid", "url_port_value", "url_fragment_present",
)
LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def url_components(spark, d):
    u = I.table(spark, d, "pages").select("page_id", split_target(F.col("url")).alias("u"))
    return u.select("page_id", "u.scheme", "u.netloc", "u.path", "u.query", "u.fragment", "u.hostname", "u.userinfo")


@query
def url_structure(spark, d):
    return features.candidates(I.pages_as_requests(spark, d), URL_FEATURES, ("page_id",))


@query
def url_path_metrics(spark, d):
    u = I.table(spark, d, "pages").select("page_id", split_target(F.col("url"))["path"].alias("path"))
    u = u.withColumn("path", decode_once(F.col("path")))
    return u.select("page_id", *[c.alias(k) for k, c in path_metrics(F.col("path")).items()])


@query
def query_parameters(spark, d):
    u = I.table(spark, d, "pages").select("page_id", split_target(F.col("url"))["query"].alias("q")).where("q <> ''")
    u = u.withColumn("pairs", parameters(F.col("q")))
    return u.select("page_id", *[parameter_metrics(F.col("pairs"))[k].alias(k) for k in PARAMETER_METRICS])


@query
def content_metrics_url(spark, d):
    u = I.table(spark, d, "pages").select("page_id", F.col("url").alias("raw")).withColumn("decoded", decode_once(F.col("raw")))
    m = content_metrics(F.col("raw"), F.col("decoded"))
    return u.select("page_id", *[(F.round(m[k], 9) if k in ("entropy",) else m[k]).alias(k) for k in METRICS])


@query
def content_metrics_text(spark, d):
    """Counts over whole texts of conversations, without the patterns of word boundaries (the two
    engines' differ on letters beyond ASCII; content_metrics_url has them)."""
    c = I.table(spark, d, "conversations").withColumn("decoded", decode_once(F.col("text"), plus=True))
    m = content_metrics(F.col("text"), F.col("decoded"))
    keep = [k for k in METRICS if k not in ("sql_pattern_count", "xss_pattern_count")]
    return c.select("conv_id", "turn", *[(F.round(m[k], 9) if k == "entropy" else m[k]).alias(k) for k in keep])


@query
def request_vector(spark, d):
    """The frozen vector of 76 features of every request."""
    return features.vector(I.pages_as_requests(spark, d), ("page_id",))


@query
def request_candidates(spark, d):
    """All 152 candidates of every request."""
    c = features.candidates(I.pages_as_requests(spark, d), keep=("page_id",))
    return c.select("page_id", *[(F.round(n, 9) if n.endswith("_entropy") else F.col(n)).alias(n) for n in features.NAMES])


@query
def header_features(spark, d):
    names = tuple(n for n in features.NAMES if features.origin(n) == "headers" or n.startswith("method_"))
    return features.candidates(I.pages_as_requests(spark, d), names, ("page_id",))


@query
def header_variety(spark, d):
    """Method, version and header features of requests whose headers are absent, repeated or odd."""
    names = tuple(n for n in features.NAMES if features.origin(n) == "headers" or n.startswith(("method_", "http_version")))
    return features.candidates(I.events_as_requests(spark, d), names, ("event_id",))


@query
def body_parameters(spark, d):
    names = tuple(f"body_{n}" for n in ("present", *PARAMETER_METRICS))
    return features.candidates(I.pages_as_requests(spark, d), names, ("page_id",))


@query
def feature_catalog_counts(spark, d):
    return features.catalog(spark).groupBy("origin").agg(F.count("*").alias("n"), F.count("final_position").alias("final"))


@query
def small_model_features(spark, d):
    r = I.pages_as_requests(spark, d).withColumn("agent", F.lit("Mozilla/5.0 (X11)"))
    v = small_model.raw_values(F.col("method"), F.col("target"), F.decode("body", "UTF-8"), F.col("agent"), F.lit(1))
    x = small_model.extract(r, v, ("page_id",))
    return x.select("page_id", *[c for c in x.columns if c not in ("page_id", "exceedances")], F.size("exceedances").cast("bigint").alias("exceeded"))


@query
def value_forms_histogram(spark, d):
    p = I.table(spark, d, "pages").select(F.lit("url").alias("field"), F.col("url").alias("value"))
    e = I.table(spark, d, "events")
    rows = p.unionAll(e.select(F.lit("value"), F.col("value").cast("string"))).unionAll(e.select(F.lit("props"), F.col("props"))).unionAll(e.select(F.lit("user"), F.col("user_id").cast("string")))
    return rows.select("field", F.explode(forms.value_forms(F.col("value"))).alias("form")).groupBy("field", "form").agg(F.count("*").alias("n"))


@query
def field_presence(spark, d):
    fields, r = I.events_as_fields(spark, d), I.event_requests(spark, d)
    p = profile.field_profile(fields, r.groupBy("corpus", "method").agg(F.count("*").alias("n")))
    return p.select("corpus", "field", "requests", "percent", "values", "presence", F.array_join("methods", "|").alias("methods"), "some_methods_only")


@query
def field_forms(spark, d):
    return profile.compact_forms(profile.forms(I.events_as_fields(spark, d)))


@query
def field_examples(spark, d):
    e = profile.examples(I.events_as_fields(spark, d))
    return e.select("corpus", "field", F.array_join("examples", " / ").alias("examples"))


def _compared(spark, d):
    fields, r = I.events_as_fields(spark, d), I.event_requests(spark, d)
    return profile.compare_fields(profile.field_profile(fields, r.groupBy("corpus", "method").agg(F.count("*").alias("n"))))


@query
def field_comparison(spark, d):
    return _compared(spark, d)


@query
def top_differences(spark, d):
    return profile.top_differences(_compared(spark, d)).select("campo", "diferenca_anomalo_menos_normal_pp", "comparacao")


@query
def method_comparison(spark, d):
    return profile.compare_methods(profile.method_stats(I.event_requests(spark, d), I.events_as_fields(spark, d)))


@query
def field_names_common(spark, d):
    p = I.events_as_fields(spark, d).select("corpus", "field").distinct()
    each = [profile.names_in(p, how).select(F.lit(how).alias("how"), "field") for how in ("union", "intersect", "except")]
    return each[0].unionAll(each[1]).unionAll(each[2])


@query
def observed_request_fields(spark, d):
    """Every field that a page, as a request, shows."""
    r = I.pages_as_requests(spark, d).select(F.lit("pages").alias("corpus"), F.col("page_id").alias("seq"), "method", "target", "version", F.transform_keys("headers", lambda k, _: F.lower(k)).alias("headers"), "body", F.array().cast("array<string>").alias("malformed"))
    return profile.observed(r).groupBy("corpus", "field").agg(F.count("*").alias("requests"), F.sum(F.size("values")).cast("bigint").alias("values"))


@query
def target_form_counts(spark, d):
    r = I.pages_as_requests(spark, d).select(F.lit("pages").alias("corpus"), "method", "target")
    return profile.target_forms(r)


@query
def safe_paths(spark, d):
    p = I.table(spark, d, "pages")
    return p.select("page_id", safe_path(F.col("url")).alias("path"), forms.sanitize_target(F.col("url")).alias("shown"))


@query
def feature_statistics(spark, d):
    t = I.table(spark, d, "lineitem").withColumn("l_shifted", F.col("l_tax") + 1e6)
    s = stats.summary(t, [*LINE_COLUMNS, "l_shifted"], ("l_returnflag",))
    return s.select("l_returnflag", "feature", "total", "valid", "missing", "min", "max", F.round("mean", 5).alias("mean"), F.round("stddev", 6).alias("stddev"), *[F.round(n, 6).alias(n) for _, n in stats.QUANTILES], "zeros", "nonzeros", "nonzero_percent", "distinct_values")


@query
def quantile_caps(spark, d):
    return stats.quantile_caps(I.table(spark, d, "lineitem"), LINE_COLUMNS).select("feature", F.round("cap", 6).alias("cap"))


@query
def normalized_lines(spark, d):
    t = I.table(spark, d, "lineitem")
    kinds = {"l_quantity": "contagem", "l_extendedprice": "contagem", "l_discount": "binaria", "l_tax": "contagem_assinada"}
    n = scoring.normalized(t, scoring.fit_normalizer(t, kinds), ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return n.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(c, 8).alias(c) for c in kinds])


@query
def normalization_methods(spark, d):
    rows = [(n, scoring.method_for(n, features.kind(n))) for n in features.FINAL]
    return history.method_histogram(spark.createDataFrame(rows, "feature string, method string"))


def _records(spark, d):
    o = I.table(spark, d, "orders")
    raw = F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").cast("binary")
    return partition.identified(o.select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderkey").alias("sequence"), raw.alias("raw")))


@query
def record_ids(spark, d):
    return _records(spark, d).select("dataset", "sequence", "content_sha256", "record_id")


@query
def hash_partition(spark, d):
    return partition.select_top(_records(spark, d), 1000).select("dataset", "sequence", "partition")


@query
def partition_manifest(spark, d):
    p = partition.select_top(_records(spark, d), 1000)
    told = digests.set_digests(p, ["partition"], "record_id").withColumnRenamed("digest", "ids_sha256")
    return p.groupBy("partition").agg(F.count("*").alias("records")).join(told, "partition")


@query
def partition_checks(spark, d):
    """Violations that each check counts: in the partition itself (none), and in parts of it that share
    rows, lack rows, repeat a text, or differ between two scans."""
    p = partition.select_top(_records(spark, d), 1000)
    first, spoiled = _records(spark, d), _records(spark, d).where("sequence % 77 <> 0")
    spoiled = spoiled.withColumn("content_sha256", F.when(F.col("sequence") % 30 == 0, "x").otherwise(F.col("content_sha256")))
    texts = I.table(spark, d, "orders").select(F.sha2(F.concat_ws("|", "o_orderstatus", (F.col("o_custkey") % 400).cast("string")), 256).alias("k"))
    a, b, every = F.col("partition") == "development", F.col("partition") == "reserved", F.col("sequence")
    m = partition.multiplicities(p, "record_id", {"a": a, "b": b, "c": b | (every % 40 == 0), "less": b & (every % 50 != 0)})
    found = {
        "overlap": F.count_if(F.expr("a > 0 and c > 0")), "incomplete": F.coalesce(F.sum(F.abs(F.col("whole") - F.col("a") - F.col("less"))), F.lit(0)),
        "overlap of the partition": F.count_if(F.expr("a > 0 and b > 0")), "repeated in the partition": F.count_if(F.col("whole") > 1),
    }
    told = m.agg(F.array(*[F.struct(F.lit(c).alias("check"), x.cast("bigint").alias("n")) for c, x in found.items()]).alias("each"))
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    own = n(partition.repeated(texts, "k"), "repeated"), n(partition.mismatches(first, spoiled, ["dataset", "sequence"], ["content_sha256", "record_id"]), "mismatches")
    return functools.reduce(DataFrame.unionAll, own, told.select(F.inline("each")))


@query
def index_digests(spark, d):
    e = I.table(spark, d, "embeddings")
    return digests.index_digests(e, ["label"], "vec_id")


@query
def bucketed_digests(spark, d):
    """Digests of sets of any size: those of the orders of each status."""
    return digests.bucketed_digest(I.table(spark, d, "orders"), ["o_orderstatus"], "o_orderkey")


@query
def stratified_split(spark, d):
    return partition.stratified(I.table(spark, d, "labels"), "toxic", [F.col("doc_id")]).select("doc_id", "toxic", "split")


@query
def split_class_counts(spark, d):
    return partition.class_counts(partition.stratified(I.table(spark, d, "labels"), "quality", [F.col("doc_id")]), "split", "quality")


@query
def request_rate_60s(spark, d):
    return series.request_rate(I.table(spark, d, "events"), "user_id", "ts").select("event_id", "user_id", "request_rate")


@query
def request_rate_day(spark, d):
    return series.request_rate(I.table(spark, d, "events"), "user_id", "ts", 86_400).select("event_id", "user_id", "request_rate")


@query
def history_summary(spark, d):
    return history.summary(I.histories(spark, d), ("method",))


@query
def history_page(spark, d):
    return history.page(I.histories(spark, d), ["ts", "event_id"], 3, 20).select("event_id", "method", "operational_decision")


@query
def decision_agreement(spark, d):
    h = I.histories(spark, d)
    expected = F.when(F.col("user_id") % 5 == 0, "BLOQUEIA").otherwise("LIBERA")
    return h.groupBy(history.agreement(expected, F.col("e1_decision"), F.col("e2_decision")).alias("agreement")).agg(F.count("*").alias("n"))


@query
def labelled_history(spark, d):
    """History with a label where its document has one."""
    h = I.histories(spark, d).withColumn("key", F.col("event_id"))
    lab = I.table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.col("toxic").alias("label"))
    return history.with_labels(h, lab, "key").select("event_id", "e1_decision", F.col("label").cast("int").alias("label"))


@query
def model_dispatch(spark, d):
    """The primary model's decision, for both choices of primary."""
    h = I.histories(spark, d)
    e1, e2 = F.col("e1_decision") == "BLOQUEIA", F.col("e2_decision") == "BLOQUEIA"
    each = [h.select(F.lit(p).alias("primary_model"), scoring.arbitrate(p, e1, e2).alias("decision")) for p in ("experimento_1", "experimento_2")]
    return each[0].unionAll(each[1]).groupBy("primary_model", "decision").agg(F.count("*").alias("n"))


@query
def newest_matches(spark, d):
    """For each signup, the newest purchase of the same user from two seconds before to a day after."""
    e = I.table(spark, d, "events")
    probes = e.where("event_type = 'signup'").select("event_id", "user_id", F.col("ts").alias("start"))
    rows = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("match_id"))
    m = series.newest_match(probes, rows, ["user_id"], "start", "ts", horizon_ms=86_400_000)
    return m.select("event_id", "user_id", F.col("match.match_id").alias("match_id"))


@query
def confusion_metrics(spark, d):
    s = I.scored(spark, d)
    return scoring.confusion(s, F.col("label"), scoring.decided(F.col("score"), 0.5, False), ("quality",))


@query
def threshold_sweep(spark, d):
    return scoring.sweep(I.scored(spark, d), "score", "label", 5.0, 1.0, True)


@query
def best_threshold(spark, d):
    return scoring.best(scoring.sweep(I.scored(spark, d), "score", "label", 10.0, 1.0))


@query
def acceptance_checks(spark, d):
    s = I.scored(spark, d)
    m = scoring.confusion(s, F.col("label"), scoring.decided(F.col("score"), 0.5, True), ("quality",))
    return history.checks(m, ["quality"])


@query
def metric_table(spark, d):
    """Metrics of two thresholds side by side."""
    s = I.scored(spark, d)
    each = [scoring.confusion(s, F.col("label"), scoring.decided(F.col("score"), t, False)).withColumn("algorithm", F.lit(a)) for a, t in (("bp", 0.4), ("ag", 0.6))]
    return history.comparison_table(each[0].unionAll(each[1]), ["accuracy", "precision", "recall", "f1", "fpr", "fnr"])


@query
def score_error(spark, d):
    return scoring.mean_squared_error(I.scored(spark, d), F.col("label"), F.col("score")).select(F.round("mse", 9).alias("mse"))


@query
def network_scores(spark, d):
    t = I.table(spark, d, "lineitem")
    x = F.array(F.col("l_quantity") / 50.0, F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber") / 7.0)
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(scoring.forward(x, LAYERS)[0], 9).alias("score"))


@query
def network_scores_batched(spark, d):
    """The same by matrix products of Arrow batches."""
    t = I.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 50.0).alias("a"), F.col("l_discount").alias("b"), F.col("l_tax").alias("c"), (F.col("l_linenumber") / 7.0).alias("e"))
    s = scoring.forward_batches(t, ["a", "b", "c", "e"], LAYERS)
    return s.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("score", 9).alias("score"))


@query
def recent_improvement(spark, d):
    r = series.recent_improvement(I.daily(spark, d), "event_type", "day", "top")
    return r.select("event_type", "n", F.round("improvement", 9).alias("improvement"))


@query
def oscillation(spark, d):
    return series.oscillation(I.daily(spark, d), "event_type", "day", "top")


@query
def running_best(spark, d):
    return series.running_best(I.daily(spark, d), "event_type", "day", "top").select("event_type", F.col("day").cast("string").alias("day"), "best")


@query
def version_changes(spark, d):
    v = series.version_changes(I.daily(spark, d), "event_type", "day", {"top": True, "n": False})
    return v.select("event_type", F.col("day").cast("string").alias("day"), F.col("sequence").cast("bigint").alias("sequence"), "previous_top", "result_top", F.round("delta_top", 6).alias("delta_top"), "tone_top", "delta_n", "tone_n")


@query
def version_verdicts(spark, d):
    w = W.partitionBy("event_type").orderBy("day")
    v = I.daily(spark, d).select("event_type", F.col("day").cast("string").alias("day"), F.lag("n").over(w).alias("c0"), F.col("n").alias("c1"), F.lag("top").over(w).alias("f0"), F.col("top").alias("f1")).where("c0 is not null")
    return v.select("event_type", "day", series.version_verdict(F.col("c0"), F.col("c1"), F.col("f0"), F.col("f1")).alias("verdict"))


@query
def scaled_series(spark, d):
    return series.scaled(I.daily(spark, d), "event_type", "top").select("event_type", F.col("day").cast("string").alias("day"), F.round("scaled", 9).alias("scaled"))


@query
def residual_loads(spark, d):
    """Load of each node after each arrival, one node's arrivals spread over ranges."""
    e = I.table(spark, d, "events").select("event_id", F.concat(F.lit("node"), (F.col("user_id") % 3 + 1).cast("string")).alias("node"), (F.col("event_id") * 0.125).alias("at"))
    return series.residual_loads(e, "node", ["event_id"], "at").select("event_id", "node", F.round("load", 6).alias("load"))


@query
def round_robin(spark, d):
    r = series.round_robin(I.table(spark, d, "events"), ["event_id"], by="user_id")
    return r.select("event_id", "node")


@query
def rl_rewards(spark, d):
    e = I.table(spark, d, "events")
    return e.select("event_id", load.reward(F.col("value"), F.col("value") > 400).alias("reward"))


@query
def rl_states(spark, d):
    return I.loads(spark, d).groupBy(load.state_of(F.col("load")).alias("state")).agg(F.count("*").alias("n"))


@query
def rl_telemetry(spark, d):
    x = I.loads(spark, d)
    n, a = F.col("node"), F.col("active")
    x = x.withColumn("cpu", load.cpu(n, F.col("load"), a))
    return x.select("event_id", "node", F.round("cpu", 6).alias("cpu"), load.saturated(n, F.col("cpu"), a).alias("saturated"), F.round(load.wait_ms(n, F.col("cpu"), a), 6).alias("wait_ms"))


@query
def rl_operational_rewards(spark, d):
    x = I.loads(spark, d)
    n, a = F.col("node"), F.col("active")
    x = x.withColumn("cpu", load.cpu(n, F.col("load"), a)).withColumn("wait", load.wait_ms(n, F.col("cpu"), a))
    r = load.operational_reward(F.col("wait"), F.col("wait") > 400, F.col("cpu"), a, load.saturated(n, F.col("cpu"), a))
    return x.select("event_id", r.alias("r")).select("event_id", *[F.round(f"r.{c}", 6).alias(c) for c in ("total", "latency_reward", "cpu_penalty", "concurrency_penalty", "saturation_penalty")])


@query
def rl_decay(spark, d):
    x = I.loads(spark, d)
    low = load.decayed(F.col("load"), F.col("active") / 4.0)
    return x.select("event_id", F.round(low, 6).alias("decayed"), F.round(load.after_arrival(F.col("node"), low), 6).alias("after"))


@query
def rl_epsilon(spark, d):
    e = I.table(spark, d, "events").select("event_id")
    return e.select("event_id", F.round(load.epsilon_at(F.col("event_id")), 8).alias("epsilon"))


def _bursts(spark, d):
    x = I.loads(spark, d)
    policy = F.when(F.col("event_id") % 2 == 0, "round_robin").otherwise("q_learning")
    wait = load.wait_ms(F.col("node"), F.col("load"), F.col("active"))
    return x.select(policy.alias("policy"), "node", wait.alias("latency_ms"), (wait > 400).alias("timeout"), F.when(F.col("event_id") % 97 == 0, "reset").alias("error"))


@query
def burst_summary(spark, d):
    b = balancing.burst_summary(_bursts(spark, d))
    return b.withColumn("average_latency_ms", F.round("average_latency_ms", 5)).withColumn("p95_latency_ms", F.round("p95_latency_ms", 6))


@query
def burst_verdict(spark, d):
    return balancing.compared(balancing.burst_summary(_bursts(spark, d)))


@query
def rl_policy(spark, d):
    x = I.loads(spark, d)
    q = x.groupBy(load.state_of(F.col("load")).alias("state"), F.col("node").alias("action")).agg(F.max("load").alias("q"))
    return balancing.greedy_policy(q)


@query
def rl_scores(spark, d):
    """Learned scores between the least and the most of each state, less what telemetry costs."""
    x = I.loads(spark, d).withColumn("state", load.state_of(F.col("load")))
    x = x.join(F.broadcast(x.groupBy("state").agg(F.min("load").alias("least"), F.max("load").alias("most"))), "state")  # a row for each of three states
    s = load.learned_score(F.col("load"), F.col("least"), F.col("most"))
    cpu = load.cpu(F.col("node"), F.col("load"), F.col("active"))
    return x.select("event_id", "state", F.round(load.penalised(s, cpu, F.col("active"), load.saturated(F.col("node"), cpu, F.col("active"))), 6).alias("score"))


@query
def rl_replay(spark, d):
    """Greedy training of each user's events, the first of equal values: counters and last values."""
    e = I.table(spark, d, "events")
    log = balancing.replay(e.select(F.col("user_id").alias("session"), F.col("event_id").alias("step"), (F.col("value") * 3).alias("extra_ms")), epsilon=(0.0, 0.0), first=True)
    last = log.groupBy("session").agg(F.max_by("q_value", "step").alias("q"))
    return balancing.counters(log).join(last, "session").withColumn("q", F.round("q", 6))


@query
def rl_session(spark, d):
    """A greedy session of each user: loads decay, requests end after their wait, values are learnt."""
    e = I.table(spark, d, "events")
    w = W.partitionBy("user_id").orderBy("event_id")
    rows = e.select(F.col("user_id").alias("session"), (F.row_number().over(w).cast("double") * 0.0625).alias("at"), F.lit(None).cast("map<string,double>").alias("loads"))
    s = balancing.online_session(rows, epsilon=(0.0, 0.0), first=True)
    return s.select("session", "step", "state", "action", "active", "timeout", "next_state", *[F.round(c, 6).alias(c) for c in ("cpu", "latency_ms", "reward", "q_value")])


@query
def ga_fitness(spark, d):
    """Mean squared error of a population over all labelled documents."""
    costs = table_fitness(np.array(POPULATION), [2, 3, 1], I.scored(spark, d), ["score", "quality"], "label")
    return costs.select("individual", F.round("cost", 9).alias("cost"))


@query
def population_diversity(spark, d):
    e = I.table(spark, d, "embeddings").select(F.col("vec_id").alias("individual"), F.col("embedding").cast("array<double>").alias("genes"))
    return gene_statistics(e).select(F.round("population_diversity", 9).alias("population_diversity"))


@query
def class_counts(spark, d):
    lab = I.table(spark, d, "labels")
    return lab.agg(F.count_if(F.col("toxic") == 0).alias("normal"), F.count_if(F.col("toxic") == 1).alias("attack"))


@query
def repeated_texts(spark, d):
    docs = I.table(spark, d, "documents").select(F.sha2("text", 256).alias("content_sha256"))
    return partition.repeated(docs, "content_sha256")


@query
def number_formats(spark, d):
    t = I.table(spark, d, "events")
    return t.select("event_id", forms.short_number(F.col("value"), 1).alias("told"))


def _reserved(spark, d):
    r = I.pages_as_requests(spark, d)
    raw = F.concat(F.col("method").cast("binary"), F.lit(b" "), F.col("target").cast("binary"), F.lit(b"\n\n"), F.col("body"))
    r = r.withColumn("raw", raw).withColumn("label", (F.col("page_id") % 2).cast("int")).withColumn("sequence", F.col("page_id"))
    return sinks.reserved_records(r.withColumn("content_sha256", digests.content_hash(F.col("raw"))).withColumn("record_id", digests.record_id(F.lit("anomalo"), F.col("sequence"), F.col("raw"))))


@query
def reserved_records(spark, d):
    """Public form of reserved records, their bytes checked against their hash."""
    p = history.public_record(history.verified(_reserved(spark, d)))
    return p.select("record_id", "source_sequence", "expected_class", "expected_decision", "method", "path", "query", "body_preview", "body_truncated")


@query
def reserved_available(spark, d):
    return history.available(_reserved(spark, d)).select("label", F.array_join("methods", "|").alias("methods"), "n")


@query
def reserved_sample(spark, d):
    """Thirty records of one class, by a seeded hash."""
    return history.sample(_reserved(spark, d), 1, limit=99).select("record_id", "expected_class")


@query
def shuffled_rows(spark, d):
    """Places of documents in a seeded shuffle."""
    key = F.sha2(F.concat_ws(":", F.lit("7"), F.col("doc_id").cast("string")), 256)
    rows = partition.shuffled(I.table(spark, d, "labels").select("doc_id"), 7, "doc_id")
    return rows.select("doc_id", F.substring(key, 1, 8).alias("place"))


@query
def catalog_statistics(spark, d):
    """Every column of the catalog for every dataset, with counts where there are any."""
    t = I.table(spark, d, "lineitem").withColumn("dataset", F.when(F.col("l_returnflag") == "N", "normal").otherwise("anomalo"))
    s = stats.summary(t, ["l_quantity", "l_tax"], ("dataset",)).select("dataset", "feature", "total", "zeros")
    return stats.with_catalog(s, spark.createDataFrame([(c,) for c in LINE_COLUMNS], "feature string")).select("feature", "dataset", "total", "zeros")


@query
def best_candidate(spark, d):
    """The best of candidates made of each threshold, with its place as training time."""
    s = scoring.sweep(I.scored(spark, d), "score", "label", 1.0, 1.0)
    return scoring.best_candidate(s.withColumn("wall_seconds", F.floor(F.col("threshold") * 10).cast("double")).withColumn("candidate_id", F.col("threshold"))).select("security_cost", "fn", "fp", "candidate_id")


@query
def request_problems(spark, d):
    """Problems of trainings and sessions with parameters taken from events."""
    e = I.table(spark, d, "events")
    rows = e.select(
        "event_id", F.col("value").alias("learning_rate"), (F.col("event_id") % 3000).alias("epochs"), (F.col("user_id") * 4).alias("requests"), (F.col("value") / 100).alias("epsilon"),
        (F.col("event_id") % 4000).alias("interval_ms"), (F.col("user_id") % 25).alias("concurrency"), F.when(F.col("event_type") == "click", "fixed").when(F.col("event_type") == "view", "continuous").alias("learning_mode"),
    )
    told = lambda c: F.array_join(c, "|")
    return rows.select("event_id", told(validation.problems(validation.BACKPROPAGATION)).alias("training"), told(validation.session_problems()).alias("session"))


@query
def architecture_plans(spark, d):
    """Wider and deeper networks and their weights, for layers taken from parts."""
    p = I.table(spark, d, "part").select("p_partkey", F.array(F.lit(76), F.col("p_size"), F.lit(1)).alias("a"))
    p = p.select("p_partkey", "a", history.architecture_candidates(F.col("a")).alias("c"))
    told = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), "-")
    return p.select("p_partkey", told(F.col("c.wider")).alias("wider"), told(F.col("c.deeper")).alias("deeper"), history.parameter_count(F.col("a")).cast("bigint").alias("weights"))


@query
def estimated_seconds(spark, d):
    o = I.table(spark, d, "orders")
    e = history.estimated_seconds(F.col("o_totalprice"), F.col("o_custkey"), F.lit(9011), (F.col("o_orderkey") % 50, F.lit(100)))
    return o.select("o_orderkey", F.round(e, 6).alias("seconds"))
