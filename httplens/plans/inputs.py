"""Inputs that the registered queries derive from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_as_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as requests: the target is the page's address; method, headers and body by its id."""
    p = table(spark, sf_dir, "pages")
    method = F.when(F.col("page_id") % 3 == 0, "GET").when(F.col("page_id") % 3 == 1, "POST").otherwise("PUT")
    body = F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("id="), F.col("page_id").cast("string"), F.lit("&name=page+one&empty=")))
    headers = F.create_map(
        F.lit("Host"), F.array(F.lit("localhost:8080")), F.lit("Content-Type"), F.array(F.lit("application/x-www-form-urlencoded; charset=utf-8")),
        F.lit("Content-Length"), F.array(F.length(body).cast("string")), F.lit("User-Agent"), F.array(F.lit("Mozilla/5.0 (X11)")),
    )
    return p.select("page_id", method.alias("method"), F.col("url").alias("target"), F.lit("HTTP/1.1").alias("version"), headers.alias("headers"), body.cast("binary").alias("body"))


def events_as_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of every kind of version, host, length, client and cookie, by their id."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    case = lambda k, *given: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in given]), (n % k + 1).cast("int"))
    body = F.when(n % 2 == 0, "").otherwise(F.concat(F.lit("id="), n.cast("string")))
    agent = case(3, "Mozilla/5.0 (X11; (a) b)", F.concat(F.lit("curl/8."), n.cast("string")), None)
    own = {
        "Host": F.array_compact(F.array(case(4, "localhost:8080", "WWW.example.org", "example.org:99999", None))), "content-TYPE": F.array_compact(F.array(case(5, "application/json", " Application/X-WWW-Form-urlencoded ; charset=utf-8", "text/plain", None, None))),
        "Content-Length": F.array_compact(F.array(case(7, F.length(body).cast("string"), "999", "x", "-4", " 5 ", None, None))), "User-Agent": F.array_compact(F.array(agent)),
        "Cookie": case(5, *[F.array().cast("array<string>")] * 3, F.array(F.lit("a=1; b=2;"), F.lit("c=3")), F.array(F.lit(" ; "))), " Accept ": F.when(n % 2 == 1, F.array(F.lit("text/html"), F.lit("*/*"))).otherwise(F.array().cast("array<string>")),
    }
    headers = F.map_filter(F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)]), lambda _, v: F.size(v) > 0)
    return e.select(
        "event_id", case(4, "get", " POST", "PUT", "TRACE").alias("method"), case(3, "http://www.example.org/a", "http://localhost:8080/a?b", "/a").alias("target"),
        case(6, "HTTP/1.0", "http/2", "HTTP/3", "HTTP/2.0", "HTTP/1.1", "HTTP/1.1").alias("version"), headers.alias("headers"), body.cast("binary").alias("body"),
    )


def events_as_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observed fields: the kind is the method, even and odd ids are two corpora."""
    e = table(spark, sf_dir, "events")
    corpus = F.when(F.col("event_id") % 2 == 0, "normal").otherwise("anomalo")
    k = F.get_json_object("props", "$.k")
    none = F.array().cast("array<struct<field:string,values:array<string>>>")
    one = lambda f, v: F.array(F.struct(F.lit(f).alias("field"), F.array(v).alias("values")))
    fields = F.concat(
        one("event.type", F.col("event_type")), one("body_param:props", F.col("props")), F.when(F.col("value") >= 50, one("query_param:high", F.col("value").cast("bigint").cast("string"))).otherwise(none),
        F.when(F.col("event_id") % 6 == 0, one("header:six", k)).otherwise(none), F.when(F.col("event_id") % 10 == 3, one("header:ten", k)).otherwise(none),
    )
    return e.select(corpus.alias("corpus"), F.col("event_id").alias("seq"), F.col("event_type").alias("method"), F.inline(fields))


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.when(F.col("event_id") % 2 == 0, "normal").otherwise("anomalo").alias("corpus"), F.col("event_id").alias("seq"), F.col("event_type").alias("method"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score from their length and quality, in hundredths."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    score = ((F.col("n_chars") * 37 + F.col("doc_id") * 11) % 101 + F.col("toxic") * 60 + (1 - F.col("quality")) * 20) / 181.0
    return lab.join(d.select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("toxic").alias("label"), F.col("quality"), score.alias("score"))


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decisions of two models."""
    e = table(spark, sf_dir, "events")
    say = lambda c: F.when(c, "BLOQUEIA").otherwise("LIBERA")
    first, second = F.col("value") > 60, F.col("value") + F.col("event_id") % 7 * 5 > 70
    return e.select("event_id", F.col("ts"), F.col("event_type").alias("method"), F.col("user_id"), say(first).alias("e1_decision"), say(second).alias("e2_decision"), say(first).alias("operational_decision"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each kind of event: the largest value of each day."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.max("value").alias("top"), F.count("*").alias("n"))


def loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as load of a node: node by user, load from the value, active requests by id."""
    e = table(spark, sf_dir, "events")
    node = F.concat(F.lit("node"), (F.col("user_id") % 3 + 1).cast("string"))
    return e.select("event_id", "user_id", node.alias("node"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.floor("value").cast("double"))).alias("load"), (F.col("event_id") % 4 + 1).cast("int").alias("active"))
