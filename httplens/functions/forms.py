"""Forms of field values, sanitised examples and comparison categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ALPHA, DIGIT, OTHER_ALNUM, SPACE
from .url import parameters, split_target

# Categories of form, in the order in which they are tried or listed.
BANDS = ((0, "comprimento:0"), (8, "comprimento:1-8"), (32, "comprimento:9-32"), (128, "comprimento:33-128"), (512, "comprimento:129-512"))
LONGEST = "comprimento:>512"
TYPES = (
    ("inteiro", r"^[+-]?[0-9]+$"),
    ("decimal", r"^[+-]?(?:[0-9]+\.[0-9]*|[0-9]*\.[0-9]+)$"),
    ("booleano/textual", r"^(?i)(?:true|false|on|off|yes|no)$"),
    ("email", rf"^[^@{SPACE}]+@[^@{SPACE}]+\.[^@{SPACE}]+$"),
    ("url-absoluta", r"(?s)^https?://.*"),
    ("caminho", r"(?s)^/.*"),
    ("alfanumerico", rf"^[{ALPHA}{DIGIT}{OTHER_ALNUM}]+$"),
)
OTHER_TYPE, EMPTY_TYPE = "texto/simbolos", "vazio"
MARKERS = (
    ("percent-encoded", "%[0-9A-Fa-f]{2}"),
    ("contem-espaco", f"[{SPACE}]"),
    ("contem-marcacao-angle-brackets", "<[^>]*>"),
    ("contem-ponto-e-virgula", ";"),
    ("contem-aspas", "['\"]"),
    ("contem-parenteses", "[()]"),
    ("contem-controle", r"[\x00-\x08\x0b\x0c\x0e-\x1f]"),
    ("contem-byte-nao-ascii", r"[^\x00-\x7f]"),
)
#: Points of a percentage within which two presences are the same.
TOLERANCE = 0.05


def length_band(value: Column) -> Column:
    size, out = F.length(value), None
    for most, name in BANDS:
        out = F.when(size <= most, name) if out is None else out.when(size <= most, name)
    return out.otherwise(LONGEST)


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, f"^[{SPACE}]+|[{SPACE}]+$", "")


def value_type(value: Column) -> Column:
    bare, out = stripped(value), F.when(stripped(value) == "", EMPTY_TYPE)
    for name, pattern in TYPES:
        out = out.when(bare.rlike(pattern.replace("$", r"\z")), name)
    return out.otherwise(OTHER_TYPE)


def value_forms(value: Column) -> Column:
    """Length band, type and, unless blank, all markers that hold."""
    full = stripped(value) != ""
    markers = [F.when(full & value.rlike(p), name) for name, p in MARKERS]
    return F.array_compact(F.array(length_band(value), value_type(value), *[m.otherwise(F.lit(None)) for m in markers]))


def safe_name(value: Column, most: int = 120) -> Column:
    """Trimmed, what can't be printed replaced, and cut with an ellipsis."""
    v = F.regexp_replace(stripped(value), r"[\x00-\x1f\x7f-\xa0\xad]", "�")
    return F.when(F.length(v) <= most, v).otherwise(F.concat(F.substring(v, 1, most - 1), F.lit("…")))


def sanitize_cookie(value: Column) -> Column:
    keys = F.filter(F.transform(F.split(value, ";"), lambda p: stripped(F.substring_index(p, "=", 1))), lambda k: k != "")
    told = F.array_join(F.transform(keys, lambda k: F.concat(safe_name(k, 40), F.lit("=<redigido>"))), "; ")
    return F.when(told == "", "<cookie redigido>").otherwise(told)


def _names(query: Column) -> Column:
    return F.transform(parameters(query), lambda p: safe_name(p["name"], 50))


def sanitize_query(query: Column) -> Column:
    names = _names(query)
    told = F.array_join(F.transform(F.slice(names, 1, 8), lambda n: F.concat(n, F.lit("=<valor>"))), "&")
    return F.concat(told, F.when(F.size(names) > 8, F.lit("&…")).otherwise(F.lit("")))


def sanitize_target(target: Column) -> Column:
    u = split_target(target)
    prefix = F.when((u["scheme"] != "") | (u["netloc"] != ""), F.concat(safe_name(u["scheme"], 12), F.lit("://"), safe_name(u["netloc"], 80))).otherwise(F.lit(""))
    base = F.concat(prefix, safe_name(u["path"], 140))
    named = F.size(_names(u["query"])) > 0
    whole = safe_name(F.concat(base, F.when(named, F.concat(F.lit("?"), sanitize_query(u["query"]))).otherwise(F.lit(""))), 300)
    told = F.when((u["query"] != "") & ~named, F.concat(base, F.lit("?<query não estruturada>"))).otherwise(whole)
    return F.when(u["error"], "<target não interpretável; redigido>").otherwise(told)


def sanitize_example(field: Column, value: Column) -> Column:
    """An example of a field's value that shows no content of queries, bodies or credentials."""
    size = F.length(value).cast("string")
    told = F.array_join(F.filter(value_forms(value), lambda f: ~F.startswith(f, F.lit("comprimento:"))), ", ")
    scheme = F.when(stripped(value) == "", "credencial").otherwise(F.regexp_extract(value, f"([^{SPACE}]+)", 1))
    lines = F.replace(F.replace(value, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    return (
        F.when(field == "request.target", sanitize_target(value))
        .when(field == "url.query", sanitize_query(value))
        .when(field == "body", F.concat(F.lit("<corpo redigido; "), size, F.lit(" caracteres>")))
        .when(field.rlike("^(?:query|body)_param:"), F.concat(F.lit("<"), told, F.lit("; "), size, F.lit(" caracteres>")))
        .when(field == "header:cookie", sanitize_cookie(value))
        .when(field.isin("header:authorization", "header:proxy-authorization"), F.concat(safe_name(scheme, 30), F.lit(" <redigido>")))
        .otherwise(safe_name(lines, 180))
    )


def field_category(field: Column) -> Column:
    starts = lambda p: F.startswith(field, F.lit(p))
    return F.when(starts("header:"), "header").when(starts("query_param:"), "parametro_query").when(starts("body_param:"), "parametro_body").otherwise("estrutura")


def interpretation(normal: Column, other: Column) -> Column:
    """What two presences in percent say; null: the field is not there."""
    gap = other - normal
    both = F.when(F.abs(gap) <= TOLERANCE, "presença equivalente").when(gap > 0, "mais frequente no anômalo").otherwise("mais frequente no normal")
    return F.when(normal.isNotNull() & other.isNotNull(), both).when(normal.isNotNull(), "somente no normal").otherwise("somente no anômalo")


def sanitized_text(value: Column, most: int) -> Column:
    """Controls as spaces, trimmed, cut."""
    return F.substring(F.trim(F.regexp_replace(value, r"[\x00-\x1f\x7f]", " ")), 1, most)


def short_number(value: Column, digits: int = 6) -> Column:
    """At most so many decimals, without trailing zeros."""
    text = F.regexp_replace(F.format_number(value, digits), ",", "")
    return F.when(value.isNull(), "").otherwise(F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ""))
