"""Lexical metrics of Latin-1 text as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes of Latin-1 as CPython has them (alphabetic, digit, other
# alphanumeric, white space), for use inside a regular expression's brackets.
ALPHA = r"A-Za-zªµºÀ-ÖØ-öø-ÿ"
DIGIT = r"0-9²³¹"
OTHER_ALNUM = r"¼-¾"
SPACE = r"\u0009-\u000d\u001c- \u0085 "

# Patterns whose matches are counted.
SQL_PATTERNS = (
    r"\b(?:select|union|insert|update|delete|drop|alter|create)\b",
    r"\b(?:or|and)\s+[\w'\"]+\s*=\s*[\w'\"]+",
    r"(?:--|/\*|\*/|;\s*(?:select|drop|insert|update|delete))",
)
XSS_PATTERNS = (
    r"<\s*/?\s*(?:script|iframe|svg|img|object|embed)\b",
    r"\bon[a-z]+\s*=",
    r"(?:javascript|data)\s*:",
)
TRAVERSAL_PATTERNS = (r"(?:^|[\\/])\.\.(?:[\\/]|$)", r"(?:^|[\\/])\.(?:[\\/]|$)")
SHELL_CHARACTERS = r";&|`$<>"

#: Suffixes of ``content_metrics``, in order.
METRICS = (
    "length_raw", "length_decoded_once", "percent_encoding_count", "invalid_percent_count", "non_ascii_count", "control_char_count", "alpha_ratio",
    "digit_ratio", "special_ratio", "entropy", "max_repeat_run", "sql_pattern_count", "xss_pattern_count", "traversal_pattern_count", "shell_metachar_count",
)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def decode_once(text: Column, plus: bool = False) -> Column:
    """Each %HH as the Latin-1 character of that byte, once; a malformed escape stays. With
    ``plus``, plus signs are spaces."""
    source = F.translate(text, "+", " ") if plus else text

    def piece(p: Column, i: Column) -> Column:
        char = F.chr(F.conv(F.substring(p, 1, 2), 16, 10).cast("bigint"))
        escaped = F.when(p.rlike("^[0-9A-Fa-f]{2}"), F.concat(char, F.substr(p, F.lit(3)))).otherwise(F.concat(F.lit("%"), p))
        return F.when(i == 0, p).otherwise(escaped)

    return F.array_join(F.transform(F.split(source, "%"), piece), "")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of a text's characters; 0 if empty. Sorted, equal characters are runs, so
    the text is read once, however many different ones it has."""
    size = F.length(text).cast("double")
    each = runs(F.array_join(F.sort_array(characters(text)), ""))
    told = F.aggregate(F.transform(each, lambda r: F.length(r).cast("double")), F.lit(0.0), lambda total, n: total + n * F.log2(n))
    return F.when(size > 0, F.greatest(F.lit(0.0), F.log2(size) - told / size)).when(size == 0, 0.0)


def runs(text: Column) -> Column:
    """The longest runs of one character each, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?s)(.)\1*"), F.lit(0))


def longest_run(text: Column) -> Column:
    """Length of the longest run of one character; 0 if empty."""
    return F.coalesce(F.array_max(F.transform(runs(text), lambda r: F.length(r))), F.lit(0))


def matches(text: Column, patterns: tuple[str, ...], flags: str = "(?iuU)") -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + count_of(text, flags + p)
    return total


def share(n: Column, size: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), size.cast("double")), F.lit(0.0))


def content_metrics(raw: Column, decoded: Column) -> dict[str, Column]:
    """The metrics of a component, from its raw and its once-decoded text."""
    size = F.length(decoded)
    percent = count_of(raw, "%[0-9A-Fa-f]{2}")
    alnum_or_space = f"[{ALPHA}{DIGIT}{OTHER_ALNUM}{SPACE}]"
    out = {
        "length_raw": F.length(raw),
        "length_decoded_once": size,
        "percent_encoding_count": percent,
        "invalid_percent_count": F.greatest(F.lit(0), count_of(raw, "%") - percent),
        "non_ascii_count": count_of(decoded, r"[^\x00-\x7f]"),
        "control_char_count": count_of(decoded, r"[\x00-\x1f\x7f]"),
        "alpha_ratio": share(count_of(decoded, f"[{ALPHA}]"), size),
        "digit_ratio": share(count_of(decoded, f"[{DIGIT}]"), size),
        "special_ratio": share(size - count_of(decoded, alnum_or_space), size),
        "entropy": entropy(decoded),
        "max_repeat_run": longest_run(decoded),
        "sql_pattern_count": matches(decoded, SQL_PATTERNS),
        "xss_pattern_count": matches(decoded, XSS_PATTERNS),
        "traversal_pattern_count": matches(F.translate(decoded, "\\", "/"), TRAVERSAL_PATTERNS, "(?d)"),
        "shell_metachar_count": count_of(decoded, f"[{SHELL_CHARACTERS}]"),
    }
    return {k: v.cast("double") for k, v in out.items()}


def integer(text: Column) -> Column:
    """The integer that a text is, as CPython reads one (sign, surrounding space and single
    underscores between digits allowed), or null."""
    plain = F.regexp_replace(text, f"[{SPACE}_]", "")
    return F.when(text.rlike(f"^[{SPACE}]*[+-]?[0-9]+(?:_[0-9]+)*[{SPACE}]*$"), plain.try_cast("bigint"))
