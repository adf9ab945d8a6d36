"""Request targets, authorities, paths and parameters as native column expressions.

The built-in URL functions reject the spaces and angle brackets that attacks contain, so targets
are split by the generic pattern of the URI standard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, decode_once, integer, share

_URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def split_target(target: Column) -> Column:
    """struct(scheme, netloc, path, query, fragment, hostname, userinfo, error).

    Leading controls and spaces and all tabs and line ends are dropped first. An authority with only
    one of the brackets is an error: then the path is what stands before the question mark."""
    clean = F.regexp_replace(F.regexp_replace(target, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    part = lambda n: F.regexp_extract(clean, _URI, n)
    netloc = part(2)
    error = F.contains(netloc, F.lit("[")) != F.contains(netloc, F.lit("]"))
    host_port = F.regexp_replace(netloc, r"(?s)^.*@", "")
    host = F.when(F.contains(host_port, F.lit("[")), F.regexp_extract(host_port, r"(?s)\[([^\]]*)", 1)).otherwise(F.substring_index(host_port, ":", 1))
    after = lambda mark: F.when(F.contains(target, F.lit(mark)), F.substr(target, F.instr(target, mark) + 1)).otherwise(F.lit(""))
    choose = lambda bad, good: F.when(error, bad).otherwise(good)
    path = choose(F.substring_index(target, "?", 1), part(3))
    return F.struct(
        choose(F.lit(""), F.lower(part(1))).alias("scheme"), choose(F.lit(""), netloc).alias("netloc"), F.when(path == "", F.lit("/")).otherwise(path).alias("path"),
        choose(F.substring_index(after("?"), "#", 1), part(4)).alias("query"), choose(after("#"), part(5)).alias("fragment"),
        choose(F.lit(""), F.lower(host)).alias("hostname"), choose(F.lit(False), F.contains(netloc, F.lit("@"))).alias("userinfo"), error.alias("error"),
    )


def raw_authority(target: Column) -> Column:
    return F.regexp_extract(target, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def port_of(authority: Column) -> Column:
    """struct(present, valid, value): valid and value are null without a port, value if invalid."""
    host_port = F.regexp_replace(authority, r"(?s)^.*@", "")
    bracketed = F.when(host_port.rlike(r"(?s)^\[[^\]]*\]:"), F.regexp_extract(host_port, r"(?s)^\[[^\]]*\]:(.*)$", 1))
    plain = F.when(F.contains(host_port, F.lit(":")), F.substring_index(host_port, ":", -1))
    text = F.when(authority == "", F.lit(None)).when(F.startswith(host_port, F.lit("[")), bracketed).otherwise(plain)
    return _port(text)


def _port(text: Column) -> Column:
    n = integer(text)
    fits = n.between(0, 65535)
    return F.struct(text.isNotNull().alias("present"), F.when(text.isNotNull(), F.coalesce(fits, F.lit(False))).alias("valid"), F.when(fits, n).alias("value"))


def host_and_port(value: Column) -> Column:
    """struct(host, present, valid) of a Host header."""
    v = F.regexp_replace(value, f"^[{SPACE}]+|[{SPACE}]+$", "")
    close = F.instr(v, "]")
    bracketed = F.startswith(v, F.lit("["))
    after = F.substr(v, close + 1)
    text = F.when(bracketed, F.when((close > 0) & F.startswith(after, F.lit(":")), F.substr(after, F.lit(2)))).when(F.contains(v, F.lit(":")), F.substring_index(v, ":", -1))
    host = F.when(bracketed, F.when(close > 0, F.substr(v, F.lit(2), close - 2)).otherwise(v)).otherwise(
        F.when(F.contains(v, F.lit(":")), F.substr(v, F.lit(1), F.length(v) - F.length(F.substring_index(v, ":", -1)) - 1)).otherwise(v)
    )
    port = _port(text)
    return F.struct(host.alias("host"), port["present"].alias("present"), port["valid"].alias("valid"))


_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
_GROUPS = r"[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*"


def is_ip(host: Column) -> Column:
    """Whether a host is an IPv4 or IPv6 address. A dotted tail counts as two groups; of two colons
    in a row there is one pair at most."""
    groups = F.regexp_replace(host, rf":{IPV4[1:]}", ":0:0")
    n = F.size(F.filter(F.split(groups, ":"), lambda g: g != ""))
    short = groups.rlike(rf"^(?:{_GROUPS})?::(?:{_GROUPS})?$") & (n <= 7)
    return host.rlike(IPV4) | short | (groups.rlike(rf"^{_GROUPS}$") & (n == 8))


def path_metrics(path: Column) -> dict[str, Column]:
    """Structure of a once-decoded path."""
    raw = F.split(path, "/", -1)
    segments = F.filter(raw, lambda s: s != "")
    inner = F.when(F.size(raw) > 2, F.slice(raw, F.lit(2), F.size(raw) - 2)).otherwise(F.array().cast("array<string>"))
    hidden = lambda s: F.startswith(s, F.lit("."))
    dots = lambda s: F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))

    def extensions(s: Column) -> Column:
        return F.when(hidden(s), dots(s) - 1 + F.when(F.length(s) > 1, 1).otherwise(0)).otherwise(dots(s))

    counts = F.transform(segments, extensions)
    pairs = F.arrays_zip(counts.alias("now"), F.slice(segments, 2, 1 << 30).alias("next"), F.slice(counts, 2, 1 << 30).alias("after"))
    nested = F.exists(pairs, lambda p: (p["now"] > 0) & p["next"].isNotNull() & (hidden(p["next"]) | (p["after"] > 0)))
    n = F.size(segments)
    how_many = lambda f: F.size(F.filter(segments, f))
    out = {
        "path_segment_count": n, "path_depth": n,
        "path_empty_inner_segment_count": F.size(F.filter(inner, lambda s: s == "")),
        "path_double_slash_count": F.regexp_count(path, F.lit("//")),
        "path_dot_segment_count": how_many(lambda s: s.isin(".", "..")),
        "path_segments_with_dot_count": how_many(lambda s: F.contains(s, F.lit("."))),
        "path_extension_like_segment_count": F.size(F.filter(counts, lambda c: c > 0)),
        "path_max_extensions_in_segment": F.coalesce(F.array_max(counts), F.lit(0)),
        "path_hidden_segment_count": how_many(hidden),
        "path_nested_extension_transition": F.coalesce(nested, F.lit(False)).cast("int"),
        "path_max_segment_length": F.coalesce(F.array_max(F.transform(segments, lambda s: F.length(s))), F.lit(0)),
        "path_trailing_slash": F.endswith(path, F.lit("/")).cast("int"),
        "path_backslash_count": F.regexp_count(path, F.lit(r"\\")),
    }
    return {k: v.cast("double") for k, v in out.items()}


def parameters(raw: Column, decoded: bool = True) -> Column:
    """array of struct(name, value, bare) of the non-empty parts between ampersands, split at the
    first equals sign and decoded with plus as space; bare: no equals sign."""
    decode = (lambda c: decode_once(c, plus=True)) if decoded else (lambda c: c)
    parts = F.filter(F.split(raw, "&"), lambda p: p != "")
    has = lambda p: F.contains(p, F.lit("="))
    return F.transform(parts, lambda p: F.struct(
        decode(F.substring_index(p, "=", 1)).alias("name"),
        decode(F.when(has(p), F.substr(p, F.instr(p, "=") + 1)).otherwise(F.lit(""))).alias("value"), (~has(p)).alias("bare")))


#: Suffixes of ``parameter_metrics``, in order.
PARAMETER_METRICS = (
    "parameter_count", "distinct_parameter_name_count", "repeated_parameter_count", "empty_name_count", "empty_value_count", "without_equals_count",
    "mean_name_length", "max_name_length", "mean_value_length", "max_value_length", "total_value_length",
)


def parameter_metrics(pairs: Column) -> dict[str, Column]:
    """Counts and lengths of what ``parameters`` gives."""
    n = F.size(pairs)
    distinct = F.size(F.array_distinct(F.transform(pairs, lambda p: p["name"])))
    length = lambda f: F.transform(pairs, lambda p: F.length(p[f]))
    total = lambda f: F.aggregate(length(f), F.lit(0), lambda a, b: a + b)
    most = lambda f: F.coalesce(F.array_max(length(f)), F.lit(0))
    how_many = lambda f: F.size(F.filter(pairs, f))
    out = {
        "parameter_count": n, "distinct_parameter_name_count": distinct, "repeated_parameter_count": n - distinct,
        "empty_name_count": how_many(lambda p: p["name"] == ""), "empty_value_count": how_many(lambda p: p["value"] == ""), "without_equals_count": how_many(lambda p: p["bare"]),
        "mean_name_length": share(total("name"), n), "max_name_length": most("name"),
        "mean_value_length": share(total("value"), n), "max_value_length": most("value"), "total_value_length": total("value"),
    }
    return {k: v.cast("double") for k, v in out.items()}


def target_form(method: Column, target: Column, parts: Column) -> Column:
    """absoluta, origem, asterisco or autoridade."""
    base = F.when((parts["scheme"] != "") & (parts["netloc"] != ""), F.lit("absoluta")).otherwise(F.lit("origem"))
    authority = (method == "CONNECT") & ~F.startswith(parts["path"], F.lit("/"))
    return F.when(target == "*", F.lit("asterisco")).when(authority, F.lit("autoridade")).otherwise(base)


def safe_path(target: Column) -> Column:
    """The path for logs: what can't be printed as a question mark, at most 240 characters."""
    path = F.regexp_replace(split_target(target)["path"], r"[\x00-\x1f\x7f-\xa0\xad]", "?")
    return F.substring(path, 1, 240)
