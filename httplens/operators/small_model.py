"""The nine features of the small online model, natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.url import split_target
from ..sources.tables import SMALL
from .scoring import exceedances, fixed_limits

# Words whose presence is a feature, and characters that are counted.
SQL_WORDS = ("select", "union", "insert", "update", "delete", "drop", "alter", " or ", " and ", "--", "/*", "*/")
XSS_WORDS = ("<script", "</script", "javascript:", "onerror=", "onload=", "onclick=", "<iframe", "<svg")
BROWSERS = ("mozilla", "chrome", "safari", "firefox", "edge", "edg/")
SPECIAL = "'\"<>;(){}[]=/\\"


def unquoted(text: Column) -> Column:
    """Percent-decoding as UTF-8, malformed escapes kept, plus signs kept; bytes that aren't UTF-8
    become replacement characters."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)(?:%[0-9A-Fa-f]{2})+|[^%]+|%"), F.lit(0))
    plain = lambda t: F.make_valid_utf8(F.unhex(F.replace(t, F.lit("%"), F.lit(""))).cast("string"))
    decoded = F.transform(tokens, lambda t: F.when(t.rlike("^%[0-9A-Fa-f]{2}"), plain(t)).otherwise(t))
    return F.when(F.contains(text, F.lit("%")), F.array_join(decoded, "")).otherwise(text)


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out.cast("int")


def special_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SPECIAL, ""))


def raw_values(method: Column, target: Column, body: Column, user_agent: Column, rate: Column) -> dict[str, Column]:
    """Unscaled features; body is text (UTF-8)."""
    query, text = unquoted(split_target(target)["query"]), unquoted(F.coalesce(body, F.lit("")))
    content = F.concat(F.lower(query), F.lit(" "), F.lower(text))
    return {
        "is_post_put": F.upper(method).isin("POST", "PUT").cast("int"), "query_length": F.length(query), "body_length": F.length(text),
        "special_chars_query": special_count(query), "special_chars_body": special_count(text), "has_sql_keywords": any_of(content, SQL_WORDS),
        "has_xss_keywords": any_of(content, XSS_WORDS), "is_standard_browser": any_of(F.lower(F.coalesce(user_agent, F.lit(""))), BROWSERS), "request_rate": rate,
    }


def extract(df: DataFrame, values: dict[str, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, nine features in 0 to 1, exceedances)."""
    rows = df.select(*keep, *[v.alias(f"__{k}") for k, v in values.items()])
    own = {k: F.col(f"__{k}") for k in SMALL}
    return rows.select(*keep, *[fixed_limits(own[k], SMALL[k]).alias(k) for k in SMALL], exceedances(own, SMALL).alias("exceedances"))
