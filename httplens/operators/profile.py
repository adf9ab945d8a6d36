"""Field profiles of request corpora, and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.forms import field_category, interpretation, safe_name, sanitize_example, value_forms
from ..functions.text import SPACE
from ..functions.url import parameters, split_target, target_form

_FORM = "application/x-www-form-urlencoded"


def percent(a: Column, b: Column) -> Column:
    return F.bround(F.coalesce(F.try_divide(100.0 * a, b), F.lit(0.0)), 4)


def average(a: Column, b: Column) -> Column:
    return F.bround(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 4)


def observed(requests: DataFrame, keep: tuple[str, ...] = ("corpus",)) -> DataFrame:
    """(keep, seq, method, field, values): one row for each field that a request has.

    Requests are (keep, seq, method, target, version, headers, body, malformed). Query and form
    parameters are grouped by name, an empty one as <nome-vazio>."""
    body = F.decode(F.coalesce("body", F.lit(b"")), "ISO-8859-1")
    u, r = split_target(F.col("target")), requests
    r = r.withColumn("__u", u).withColumn("__body", body)
    types = F.coalesce(F.try_element_at("headers", F.lit("content-type")), F.array().cast("array<string>"))
    is_form = F.exists(types, lambda t: F.regexp_replace(F.substring_index(F.lower(t), ";", 1), f"^[{SPACE}]+|[{SPACE}]+$", "") == _FORM)
    looks = F.contains("__body", F.lit("=")) & ~F.contains("__body", F.lit("\x00"))
    none = F.array().cast("array<struct<field:string,values:array<string>>>")

    def grouped(raw: Column, prefix: str) -> Column:
        pairs = F.transform(parameters(raw), lambda p: F.struct(safe_name(F.when(p["name"] == "", "<nome-vazio>").otherwise(p["name"])).alias("name"), p["value"].alias("value")))
        names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
        return F.transform(names, lambda n: F.struct(F.concat(F.lit(prefix), n).alias("field"), F.transform(F.filter(pairs, lambda p: p["name"] == n), lambda p: p["value"]).alias("values")))

    def one(name: str, value: Column, when: Column | None = None) -> Column:
        row = F.array(F.struct(F.lit(name).alias("field"), F.array(value).alias("values")))
        return row if when is None else F.when(when, row).otherwise(none)

    c = F.col
    port = F.regexp_extract(c("__u.netloc"), r":([0-9]+)$", 1)
    usable = ~c("__u.error")
    has_query, form = usable & (c("__u.query") != ""), is_form | looks
    with_params = lambda when, raw, prefix, name: F.when(when & (F.size(parameters(raw)) > 0) if name == "body.parameters" else when, F.concat(one(name, F.lit("presente")), grouped(raw, prefix))).otherwise(none)
    headers = F.transform(F.map_entries("headers"), lambda e: F.struct(F.concat(F.lit("header:"), e["key"]).alias("field"), e["value"].alias("values")))
    fields = F.concat(
        one("request.method", c("method")), one("request.target", c("target")), one("request.http_version", c("version")),
        one("url.scheme", c("__u.scheme"), usable & (c("__u.scheme") != "")), one("url.host", c("__u.hostname"), usable & (c("__u.hostname") != "")),
        one("url.port", port.try_cast("int").cast("string"), usable & (port.try_cast("int") <= 65535)), one("url.path", c("__u.path"), usable),
        one("url.query", c("__u.query"), has_query), with_params(has_query, c("__u.query"), "query_param:", "query.parameters"),
        one("headers", F.size("headers").cast("string"), F.size("headers") > 0), headers,
        F.when(F.size("malformed") > 0, F.array(F.struct(F.lit("headers.malformed").alias("field"), F.array_repeat(F.lit("linha sem separador ':'"), F.size("malformed")).alias("values")))).otherwise(none),
        one("body", c("__body"), c("__body") != ""), with_params((c("__body") != "") & form, c("__body"), "body_param:", "body.parameters"),
    )
    return r.select(*keep, "seq", "method", F.inline(fields)).where(F.size("values") > 0)


def field_profile(fields: DataFrame, totals: DataFrame, keep: tuple[str, ...] = ("corpus",)) -> DataFrame:
    """Per corpus and field: requests, share, values, presence, methods. ``totals``: (keep, method, n)."""
    by_method = fields.groupBy(*keep, "field", "method").agg(F.count("*").alias("n"), F.sum(F.size("values")).alias("values"))
    counts = by_method.groupBy(*keep, "field").agg(
        F.sum("n").alias("requests"), F.sum("values").cast("bigint").alias("values"), F.array_sort(F.collect_set("method")).alias("methods"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "n")))).alias("by_method"),
    )
    whole = totals.groupBy(*keep).agg(F.sum("n").alias("__total"), F.array_sort(F.collect_set("method")).alias("__methods"))
    j = counts.join(whole, list(keep))
    return j.select(
        *keep, "field", "requests", percent(F.col("requests"), F.col("__total")).alias("percent"), "values", F.when(F.col("requests") == F.col("__total"), "todas").otherwise("parte").alias("presence"),
        "methods", (F.col("methods") != F.col("__methods")).alias("some_methods_only"), "by_method",
    )


def forms(fields: DataFrame, keep: tuple[str, ...] = ("corpus",)) -> DataFrame:
    """(keep, field, form, n, first): how many values have each form, and the first place of it."""
    place = F.struct("seq", "i")
    rows = fields.select(*keep, "field", "seq", F.posexplode("values").alias("i", "value")).select(*keep, "field", "seq", "i", F.posexplode(value_forms(F.col("value"))).alias("j", "form"))
    return rows.groupBy(*keep, "field", "form").agg(F.count("*").alias("n"), F.min(F.struct(place.alias("place"), "j")).alias("first"))


def compact_forms(counted: DataFrame, keep: tuple[str, ...] = ("corpus",), most: int = 12) -> DataFrame:
    """(keep, field, forms): the most frequent forms as name=count, ties by first occurrence."""
    w = W.partitionBy(*keep, "field").orderBy(F.desc("n"), "first")
    top = counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    told = F.transform(F.array_sort(F.collect_list(F.struct("rank", "form", "n"))), lambda x: F.concat(x["form"], F.lit("="), x["n"].cast("string")))
    return top.groupBy(*keep, "field").agg(F.array_join(told, "; ").alias("forms"))


def examples(fields: DataFrame, keep: tuple[str, ...] = ("corpus",), most: int = 3) -> DataFrame:
    """(keep, field, examples): the first distinct sanitised examples in order of arrival.

    Each example keeps only its first place before the ranking, so a field of a few forms of value
    is reduced ahead of the shuffle."""
    rows = fields.select(*keep, "field", "seq", F.posexplode("values").alias("i", "value")).select(*keep, "field", F.struct("seq", "i").alias("at"), sanitize_example(F.col("field"), F.col("value")).alias("example"))
    first = rows.groupBy(*keep, "field", "example").agg(F.min("at").alias("at"))
    w = W.partitionBy(*keep, "field").orderBy("at")
    top = first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return top.groupBy(*keep, "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "example"))), lambda x: x["example"]).alias("examples"))


def compare_fields(profile: DataFrame, normal: str = "normal", other: str = "anomalo", corpus: str = "corpus") -> DataFrame:
    """Full outer join of two corpora's profiles; a missing side is 0 or empty. ``forms``, if there, is
    compared as text."""
    has_forms = "forms" in profile.columns
    side = lambda name, p: profile.where(F.col(corpus) == name).select("field", *[F.col(c).alias(f"{p}_{c}") for c in ("requests", "percent", "methods", *(["forms"] if has_forms else []))])
    j = side(normal, "normal").join(side(other, "anomalo"), "field", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = lambda p: F.coalesce(F.array_join(f"{p}_methods", "|"), F.lit(""))
    n, a = F.coalesce("normal_percent", F.lit(0.0)), F.coalesce("anomalo_percent", F.lit(0.0))
    return j.select(
        field_category(F.col("field")).alias("categoria"), F.col("field").alias("campo"), zero(F.col("normal_requests")).alias("normal_ocorrencias"), n.alias("normal_percentual"),
        zero(F.col("anomalo_requests")).alias("anomalo_ocorrencias"), a.alias("anomalo_percentual"), F.bround(a - n, 4).alias("diferenca_anomalo_menos_normal_pp"),
        joined("normal").alias("normal_metodos"), joined("anomalo").alias("anomalo_metodos"),
        *([F.coalesce(f"{p}_forms", F.lit("")).alias(f"{p}_formas_valores") for p in ("normal", "anomalo")] if has_forms else []),
        interpretation(F.col("normal_percent"), F.col("anomalo_percent")).alias("comparacao"),
    )


def top_differences(compared: DataFrame, n: int = 15) -> DataFrame:
    """Fields that both have, by size of the difference, then by name from the end."""
    both = compared.where((F.col("normal_ocorrencias") > 0) & (F.col("anomalo_ocorrencias") > 0))
    gap = F.abs("diferenca_anomalo_menos_normal_pp")
    return both.orderBy(gap.desc(), F.desc("campo")).limit(n)


def method_stats(requests: DataFrame, fields: DataFrame, keep: tuple[str, ...] = ("corpus",)) -> DataFrame:
    """Per corpus and method: requests, shares with query, body and form, and mean values a request."""
    starts = lambda p: F.startswith("field", F.lit(p))
    sized = lambda p: F.sum(F.when(starts(p), F.size("values")).otherwise(0)).cast("bigint")
    seen = fields.groupBy(*keep, "method").agg(
        F.count_if(F.col("field") == "url.query").alias("q"), F.count_if(F.col("field") == "body").alias("b"), F.count_if(F.col("field") == "body.parameters").alias("f"),
        sized("header:").alias("h"), sized("query_param:").alias("qp"), sized("body_param:").alias("bp"),
    )
    total = requests.groupBy(*keep, "method").agg(F.count("*").alias("requests"))
    j, n = total.join(seen, [*keep, "method"], "left").na.fill(0), F.col("requests")
    return j.select(
        *keep, "method", "requests", F.col("q").alias("with_query"), percent(F.col("q"), n).alias("percent_with_query"), F.col("b").alias("with_body"), percent(F.col("b"), n).alias("percent_with_body"),
        F.col("f").alias("with_form"), percent(F.col("f"), n).alias("percent_with_form"), average(F.col("h"), n).alias("mean_headers"), average(F.col("qp"), n).alias("mean_query_parameters"), average(F.col("bp"), n).alias("mean_body_parameters"),
    )


def compare_methods(stats: DataFrame, normal: str = "normal", other: str = "anomalo", corpus: str = "corpus") -> DataFrame:
    """Full outer join of two corpora's method statistics."""
    share = stats.withColumn("percent", percent(F.col("requests"), F.sum("requests").over(W.partitionBy(corpus))))
    cols = ("requests", "percent", "percent_with_query", "percent_with_body", "mean_headers", "mean_query_parameters", "mean_body_parameters")
    side = lambda name, p: share.where(F.col(corpus) == name).select("method", *[F.col(c).alias(f"{p}_{c}") for c in cols])
    j = side(normal, "normal").join(side(other, "anomalo"), "method", "full_outer").na.fill(0)
    return j.withColumn("difference_pp", F.bround(F.col("anomalo_percent") - F.col("normal_percent"), 4))


def target_forms(requests: DataFrame, keep: tuple[str, ...] = ("corpus",)) -> DataFrame:
    form = target_form(F.col("method"), F.col("target"), split_target(F.col("target")))
    return requests.groupBy(*keep, form.alias("form")).agg(F.count("*").alias("n"))


def names_in(profile: DataFrame, how: str, normal: str = "normal", other: str = "anomalo", corpus: str = "corpus") -> DataFrame:
    """Field names of both corpora (intersect), either (union) or the first alone (except)."""
    a, b = (profile.where(F.col(corpus) == c).select("field") for c in (normal, other))
    return {"union": lambda: a.union(b).distinct(), "intersect": lambda: a.intersect(b), "except": lambda: a.subtract(b)}[how]()
