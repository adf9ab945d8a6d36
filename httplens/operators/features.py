"""The catalog of 152 candidate features of a request and the frozen vector of 76, as expressions.

Requests are rows (method, target, version, headers map<string,array<string>>, body binary). As
features are native expressions, a query that takes a few pays for no others."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import METRICS, SPACE, content_metrics, decode_once, integer
from ..functions.url import PARAMETER_METRICS, host_and_port, is_ip, parameter_metrics, parameters, path_metrics, port_of, raw_authority, split_target

# Headers whose presence is a feature.
HEADERS = ("accept", "accept-charset", "accept-encoding", "accept-language", "cache-control", "connection", "content-length", "content-type", "cookie", "host", "pragma", "user-agent")

# The ordered contract of the vector.
FINAL = (
    "method_is_post", "method_is_put", "method_is_other", "url_length_raw", "url_is_absolute", "url_parse_error", "url_host_present", "url_host_is_ip",
    "url_host_non_ascii_count", "url_userinfo_present", "url_port_present", "url_port_valid", "url_fragment_present", "path_length_raw",
    "path_percent_encoding_count", "path_invalid_percent_count", "path_non_ascii_count", "path_control_char_count", "path_digit_ratio",
    "path_special_ratio", "path_sql_pattern_count", "path_xss_pattern_count", "path_traversal_pattern_count", "path_shell_metachar_count",
    "path_segment_count", "path_double_slash_count", "path_extension_like_segment_count", "path_hidden_segment_count",
    "path_nested_extension_transition", "path_max_segment_length", "path_backslash_count", "query_present", "query_length_raw",
    "query_percent_encoding_count", "query_invalid_percent_count", "query_non_ascii_count", "query_control_char_count", "query_digit_ratio",
    "query_special_ratio", "query_sql_pattern_count", "query_xss_pattern_count", "query_traversal_pattern_count", "query_shell_metachar_count",
    "query_parameter_count", "query_repeated_parameter_count", "query_empty_value_count", "query_without_equals_count", "query_max_name_length",
    "query_max_value_length", "body_present", "body_length_raw", "body_percent_encoding_count", "body_invalid_percent_count",
    "body_non_ascii_count", "body_control_char_count", "body_digit_ratio", "body_special_ratio", "body_sql_pattern_count",
    "body_xss_pattern_count", "body_traversal_pattern_count", "body_shell_metachar_count", "body_parameter_count",
    "body_repeated_parameter_count", "body_empty_value_count", "body_without_equals_count", "body_max_name_length", "body_max_value_length",
    "header_unique_count", "header_duplicate_count", "header_has_host", "header_has_content_type", "content_type_is_form_urlencoded",
    "header_has_content_length", "content_length_valid", "content_length_delta", "host_matches_url_host",
)
#: Features of the vector that may be absent, each shown by another: query and body ones by
#: ``query_present`` and ``body_present``.
ABSENT = {
    "url_host_is_ip": ("url_host_present",), "url_host_non_ascii_count": ("url_host_present",), "url_port_valid": ("url_port_present",),
    "content_type_is_form_urlencoded": ("header_has_content_type",), "content_length_valid": ("header_has_content_length",),
    "content_length_delta": ("header_has_content_length", "content_length_valid"), "host_matches_url_host": ("header_has_host", "url_host_present"),
} | {n: (f"{n.split('_')[0]}_present",) for n in FINAL if n.startswith(("query_", "body_")) and not n.endswith("_present")}

_FORM = "application/x-www-form-urlencoded"
_RATIOS = ("alpha_ratio", "digit_ratio", "special_ratio", "entropy", "mean_name_length", "mean_value_length")


def contract_digest(names: tuple[str, ...] = FINAL) -> str:
    return hashlib.sha256(("\n".join(names) + "\n").encode()).hexdigest()


def components(requests: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Method, version, split target, decoded components and normalised headers of each request.

    Header names are trimmed and lower-cased; of names that differ in case only, the last stays."""
    names = F.map_entries("headers")
    lowered = F.transform(names, lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    last = F.filter(lowered, lambda e, i: ~F.exists(F.slice(lowered, i + 2, F.greatest(F.size(lowered), F.lit(1))), lambda x: x["key"] == e["key"]))
    body = F.coalesce(F.col("body"), F.lit(b""))
    out = requests.select(
        *keep, F.upper(F.trim("method")).alias("method"), F.col("target"), F.regexp_replace(F.upper(F.trim("version")), "^HTTP/", "").alias("version"),
        F.map_from_entries(last).alias("headers"), F.decode(body, "ISO-8859-1").alias("body"), F.octet_length(body).alias("body_bytes"), split_target(F.col("target")).alias("u"),
    )
    before = F.substring_index("target", "#", 1)
    out = out.withColumn("has_query", F.contains(before, F.lit("?"))).withColumn("has_body", F.col("body_bytes") > 0)
    return out.withColumns({
        "url_decoded": decode_once(F.col("target")), "path_decoded": decode_once(F.col("u.path")),
        "query_decoded": decode_once(F.col("u.query"), plus=True), "body_decoded": decode_once(F.col("body"), plus=True),
        "query_pairs": parameters(F.col("u.query")), "body_pairs": parameters(F.col("body")), "authority": raw_authority(F.col("target")),
    }).withColumns({"port": port_of(F.col("authority")), "host_header": host_and_port(first_header("host"))})


def first_header(name: str) -> Column:
    return F.try_element_at(F.try_element_at(F.col("headers"), F.lit(name)), F.lit(1))


def media_type(value: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.lower(value), ";", 1), f"^[{SPACE}]+|[{SPACE}]+$", "")


def expressions() -> dict[str, Column]:
    """Every candidate over ``components``, in catalog order; null: not applicable."""
    c, u = F.col, lambda f: F.col(f"u.{f}")
    out: dict[str, Column] = {}
    for m in ("GET", "POST", "PUT"):
        out[f"method_is_{m.lower()}"] = c("method") == m
    out["method_is_other"] = ~c("method").isin("GET", "POST", "PUT")
    out |= {
        "http_version_is_1_0": c("version") == "1.0", "http_version_is_1_1": c("version") == "1.1", "http_version_is_2": c("version").isin("2", "2.0"),
        "http_version_is_other": ~c("version").isin("1.0", "1.1", "2", "2.0"),
    }
    for name, raw, has in (("url", c("target"), None), ("path", u("path"), None), ("query", u("query"), "has_query"), ("body", c("body"), "has_body")):
        for k, v in content_metrics(raw, c(f"{name}_decoded")).items():
            out[f"{name}_{k}"] = F.when(c(has), v) if has else v
    host = u("hostname")
    with_host = lambda x: F.when(host != "", x)
    out |= {
        "url_is_absolute": (u("scheme") != "") & (c("authority") != ""), "url_parse_error": u("error"),
        "url_scheme_is_http": u("scheme") == "http", "url_scheme_is_https": u("scheme") == "https",
        "url_scheme_is_other": ~u("scheme").isin("", "http", "https"), "url_scheme_missing": u("scheme") == "", "url_host_present": host != "",
        "url_host_length": with_host(F.length(host)), "url_host_label_count": with_host(F.size(F.filter(F.split(host, r"\."), lambda x: x != ""))),
        "url_host_is_ip": with_host(is_ip(host)), "url_host_non_ascii_count": with_host(F.regexp_count(host, F.lit(r"[^\x00-\x7f]"))),
        "url_userinfo_present": u("userinfo"), "url_port_present": c("port.present"), "url_port_valid": c("port.valid"), "url_port_value": c("port.value"),
        "url_port_is_standard": F.when(c("port.value").isNotNull(), c("port.value").isin(80, 443)), "url_fragment_present": u("fragment") != "",
    }
    out |= path_metrics(c("path_decoded"))
    form = media_type(first_header("content-type")) == _FORM
    is_form = F.coalesce(form, F.lit(False))
    for name, has in (("query", c("has_query")), ("body", c("has_body") & is_form)):
        out[f"{name}_present"] = c(f"has_{name}")
        for k, v in parameter_metrics(c(f"{name}_pairs")).items():
            out[f"{name}_{k}"] = F.when(has, v)
    for h in HEADERS:
        out[f"header_has_{h.replace('-', '_')}"] = F.coalesce(F.size(F.try_element_at(c("headers"), F.lit(h))) > 0, F.lit(False))
    values = F.aggregate(F.map_values("headers"), F.lit(0), lambda n, x: n + F.size(x))
    declared = integer(first_header("content-length"))
    length = F.when(declared >= 0, declared)
    agent, cookies = first_header("user-agent"), F.try_element_at(c("headers"), F.lit("cookie"))
    with_cookie = lambda x: F.when(F.size(cookies) > 0, x)
    pairs = lambda v: F.size(F.filter(F.split(v, ";"), lambda p: ~p.rlike(f"^[{SPACE}]*$")))
    given = first_header("host")
    out |= {
        "header_unique_count": F.size(F.map_keys("headers")), "header_value_count": values, "header_duplicate_count": values - F.size(F.map_keys("headers")),
        "content_type_is_form_urlencoded": form, "content_length_valid": F.when(first_header("content-length").isNotNull(), F.coalesce(declared >= 0, F.lit(False))),
        "content_length_declared": length, "body_length_bytes": c("body_bytes"), "content_length_delta": c("body_bytes") - length,
        "content_length_matches_body": c("body_bytes") == length, "user_agent_length": F.length(agent),
        "user_agent_token_count": F.regexp_count(agent, F.lit(f"[^{SPACE}]+")), "user_agent_parenthesis_count": F.regexp_count(agent, F.lit("[()]")),
        "host_header_length": F.length(given), "host_header_port_present": F.when(given.isNotNull(), c("host_header.present")),
        "host_header_port_valid": F.when(given.isNotNull(), c("host_header.valid")),
        "host_matches_url_host": F.when(given.isNotNull() & (host != ""), F.lower(c("host_header.host")) == F.lower(host)),
        "cookie_length": with_cookie(F.aggregate(cookies, F.lit(0), lambda n, x: n + F.length(x))),
        "cookie_pair_count": with_cookie(F.aggregate(cookies, F.lit(0), lambda n, x: n + pairs(x))),
    }
    return {k: v.cast("double") for k, v in out.items()}


NAMES = (
    "method_is_get", "method_is_post", "method_is_put", "method_is_other", "http_version_is_1_0", "http_version_is_1_1", "http_version_is_2", "http_version_is_other",
    *(f"{o}_{m}" for o in ("url", "path", "query", "body") for m in METRICS),
    "url_is_absolute", "url_parse_error", "url_scheme_is_http", "url_scheme_is_https", "url_scheme_is_other", "url_scheme_missing", "url_host_present",
    "url_host_length", "url_host_label_count", "url_host_is_ip", "url_host_non_ascii_count", "url_userinfo_present", "url_port_present",
    "url_port_valid", "url_port_value", "url_port_is_standard", "url_fragment_present",
    "path_segment_count", "path_depth", "path_empty_inner_segment_count", "path_double_slash_count", "path_dot_segment_count",
    "path_segments_with_dot_count", "path_extension_like_segment_count", "path_max_extensions_in_segment", "path_hidden_segment_count",
    "path_nested_extension_transition", "path_max_segment_length", "path_trailing_slash", "path_backslash_count",
    *(f"{o}_{m}" for o in ("query", "body") for m in ("present", *PARAMETER_METRICS)),
    *(f"header_has_{h.replace('-', '_')}" for h in HEADERS),
    "header_unique_count", "header_value_count", "header_duplicate_count", "content_type_is_form_urlencoded", "content_length_valid",
    "content_length_declared", "body_length_bytes", "content_length_delta", "content_length_matches_body", "user_agent_length",
    "user_agent_token_count", "user_agent_parenthesis_count", "host_header_length", "host_header_port_present", "host_header_port_valid",
    "host_matches_url_host", "cookie_length", "cookie_pair_count",
)


def candidates(requests: DataFrame, names: tuple[str, ...] = NAMES, keep: tuple[str, ...] = ()) -> DataFrame:
    """The named candidates of each request, after the columns to keep."""
    found = expressions()
    missing, extra = set(names) - set(found), set(found) - set(NAMES)
    if missing or extra:
        raise ValueError(f"features do not match the catalog; missing {sorted(missing)}, unexpected {sorted(extra)}")
    return components(requests, keep).select(*keep, *[found[n].alias(n) for n in names])


def vector(requests: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 76 features. Null is 0 only where another feature shows the absence; any other null and any
    value that isn't finite is an error."""
    rows = candidates(requests, FINAL, keep)

    def settled(name: str) -> Column:
        x = F.coalesce(F.col(name), F.lit(0.0)) if name in ABSENT else F.col(name)
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        return F.when(bad, F.raise_error(F.lit(f"feature without a finite value: {name}")).cast("double")).otherwise(x).alias(name)

    return rows.select(*keep, *[settled(n) for n in FINAL])


def origin(name: str) -> str:
    if name.startswith(("method_",)):
        return "method"
    if name.startswith(("http_version", "url_")):
        return "url"
    first = name.split("_")[0]
    return first if first in ("path", "query", "body") and name != "body_length_bytes" else "headers"


def kind(name: str) -> str:
    if name == "content_length_delta":
        return "contagem_assinada"
    if name.endswith(_RATIOS):
        return "continua"
    flags = ("method_is", "http_version_is", "url_is", "url_scheme", "header_has", "path_nested", "path_trailing", "content_type_is", "content_length_valid", "content_length_matches", "host_matches", "host_header_port")
    named = ("url_parse_error", "url_host_present", "url_host_is_ip", "url_userinfo_present", "url_port_present", "url_port_valid", "url_port_is_standard", "url_fragment_present", "query_present", "body_present")
    return "binaria" if name.startswith(flags) or name in named else "contagem"


def applicability(name: str) -> str:
    if name.startswith(("query_", "body_")) and not name.endswith("_present") and name != "body_length_bytes":
        return "component present" if name.split("_", 1)[1] in METRICS else "component present and parametrised"
    if name in ("url_port_valid", "url_port_value", "url_port_is_standard"):
        return "explicit port"
    if name.startswith("url_host_") and name != "url_host_present":
        return "host present"
    conditional = ("content_", "user_agent_", "host_", "cookie_")
    return "header present" if name.startswith(conditional) else "every request"


def describe(name: str) -> str:
    return name.replace("_", " ")


def catalog(spark: SparkSession) -> DataFrame:
    """(position, feature, origin, kind, description, applicability, count_distinct, final_position)."""
    final = {n: i + 1 for i, n in enumerate(FINAL)}
    rows = [(i + 1, n, origin(n), kind(n), describe(n), applicability(n), kind(n) != "continua", final.get(n)) for i, n in enumerate(NAMES)]
    return spark.createDataFrame(rows, "position int, feature string, origin string, kind string, description string, applicability string, count_distinct boolean, final_position int")


def final_schema(spark: SparkSession) -> DataFrame:
    """The vector's features in order, with a reason for each by rule."""
    why = (
        F.when(F.col("kind") == "binaria", "indicator that keeps absence and value apart").when(F.col("feature").rlike("pattern|metachar|control|percent|non_ascii"), "generic sign of injected or encoded content")
        .when(F.col("feature").rlike("length|count"), "size or structure that does not depend on names").otherwise("composition of the component")
    )
    return catalog(spark).where("final_position is not null").select(F.col("final_position").alias("position"), "feature", "origin", "kind", "description", why.alias("reason")).orderBy("position")


def removed_schema(spark: SparkSession) -> DataFrame:
    """The other candidates, with a reason for each by rule."""
    why = (
        F.when(F.col("feature").rlike("^(user_agent|cookie|header_has)"), "depends on the client that made the corpus").when(F.col("feature").rlike("^(http_version|url_scheme|method_is_get)"), "constant or implied by others")
        .when(F.col("feature").rlike("decoded_once|depth|total_|mean_|distinct_|alpha_ratio|entropy|max_repeat"), "redundant with a feature of the vector").otherwise("covered by a more general feature")
    )
    return catalog(spark).where("final_position is null").select("feature", "origin", "kind", why.alias("reason"))
