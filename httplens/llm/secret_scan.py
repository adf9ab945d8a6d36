"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Texts are content-addressed; of all versions of all paths, each blob is scanned once for each
version of the rules, and a ledger of (blob, rule version) keeps that so in later runs. Findings,
kept under the same pair, are then joined back to every path that holds the blob."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import staged


class Rule(NamedTuple):
    """A match counts if its given group has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int


# Kinds, patterns and least lengths.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr([tuple(r) for r in rules]).encode()).hexdigest()[:16]


def address(text) -> F.Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def _matches(n: int, r: Rule) -> F.Column:
    """Array of a rule's matches in ``text``, in order, with the gap before each."""
    kind = "array<struct<rule:int,nth:int,gap:int,size:int,ok:boolean>>"
    pattern = F.lit(r.pattern)
    zipped = F.arrays_zip(
        F.split("text", r.pattern, -1).alias("gap"), F.regexp_extract_all("text", pattern, F.lit(0)).alias("whole"),
        F.regexp_extract_all("text", pattern, F.lit(r.group)).alias("own"),
    )

    def sized(x, i):
        own = F.char_length(x["own"]) >= r.least
        return F.struct(F.lit(n).alias("rule"), i.alias("nth"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["whole"]).alias("size"), own.alias("ok"))

    return F.when(F.col("text").rlike(r.pattern), F.transform(zipped, sized)).otherwise(F.array().cast(kind))


def _placed(matched: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, kind, start, end) of each match that counts, in code points, end exclusive.

    Matches are leftmost and do not overlap within a kind. Their places follow from the pieces
    between them: each match begins where the pieces and matches before it end."""
    rows = matched.select("blob", F.inline("matches")).where("size is not null")
    upto = W.partitionBy("blob", "rule").orderBy("nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    ended = rows.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(upto)).where("ok")
    names = F.array(*[F.lit(r.kind) for r in rules])
    return ended.select("blob", "rule", names[F.col("rule")].alias("kind"), (F.col("stop") - F.col("size")).alias("start"), F.col("stop").alias("end"))


def spans_of(found: DataFrame) -> DataFrame:
    """(blob, found), found an array of (start, rule, end, kind) by start, then rule. One blob's
    findings are bounded by its text."""
    return found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rule", "end", "kind"))).alias("found"))


class Ledger(NamedTuple):
    """What earlier runs have done: ``pairs`` (blob, rule_version) that were scanned, and ``found``
    (blob, rule_version, found) of those with findings."""

    pairs: DataFrame
    found: DataFrame


def new_ledger(like: DataFrame) -> Ledger:
    pairs, spans = "blob string, rule_version string", "found array<struct<start:bigint,rule:int,end:bigint,kind:string>>"
    empty = like.sparkSession.createDataFrame
    return Ledger(empty([], pairs), empty([], f"{pairs}, {spans}"))


def scan(df: DataFrame, ledger: Ledger, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> Ledger:
    """The ledger after a run over ``df``: only blobs that have no pair with the present version of
    the rules are scanned; what is known under this and other versions stays as it is. Both tables
    are written (see ``lineage``), so that the next run reads them."""
    version = F.lit(rule_version(rules))
    texts = df.select(address(F.col(text_col)).alias("blob"), F.col(text_col).cast("string").alias("text"))
    seen = ledger.pairs.where(F.col("rule_version") == version).select(F.col("blob").alias("seen"))
    unseen = texts.join(seen, texts["blob"] == seen["seen"], "left_anti")
    contents = unseen.groupBy("blob").agg(F.coalesce(F.first("text"), F.lit("")).alias("text"))  # copies meet before the shuffle
    new = staged(contents.select("blob", version.alias("rule_version"), F.concat(*[_matches(n, r) for n, r in enumerate(rules)]).alias("matches")))
    found = spans_of(_placed(new.where(F.size("matches") > 0), rules)).select("blob", version.alias("rule_version"), "found")
    return Ledger(ledger.pairs.unionByName(new.select("blob", "rule_version")), ledger.found.unionByName(staged(found)))


def spans(df: DataFrame, ledger: Ledger, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with blob and found, the ledger's findings under the present version of the rules;
    found is null where there are none. Columns of these names in ``df`` are hidden."""
    known = ledger.found.where(F.col("rule_version") == rule_version(rules)).select("blob", "found")
    row = F.struct(*[df[c] for c in df.columns])
    return df.select(row.alias("row"), address(F.col(text_col)).alias("blob")).join(known, "blob", "left")


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES, runs: Iterable | None = None) -> DataFrame:
    """(id, blob, found) of every row; found is empty where nothing was.

    The versions in ``df`` come in ``runs``, conditions on its rows (one run of all, if None); each
    run scans what the ledger of those before doesn't hold. Rows that no condition takes, as all are
    false or null for them, come in the first run. Null text counts as empty; texts of any length are
    scanned whole; repeated rows and ids, null ids too, each give a row; there are no ties, as spans
    are in order of place and rule; an empty table gives an empty one; other columns are ignored."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ledger = ledger or new_ledger(df)
    first, *later = [F.coalesce(run, F.lit(False)) for run in runs or [F.lit(True)]]
    taken = functools.reduce(lambda a, b: a | b, [first, *later])
    for run in [first | ~taken, *later]:
        ledger = scan(df.where(run), ledger, text_col, rules)
    none = F.array().cast("array<struct<start:bigint,rule:int,end:bigint,kind:string>>")
    known = ledger.found.where(F.col("rule_version") == rule_version(rules)).select("blob", "found")
    paths = rows.select("id", address(F.col("text")).alias("blob"))
    return paths.join(known, "blob", "left").select(F.col("id").alias(id_col), "blob", F.coalesce("found", none).alias("found"))


def span_text(found) -> F.Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with each maximal run of found spans in the text replaced by ``mark``; all columns
    (whatever their names) and rows stay, null text stays null, an empty table stays empty."""
    found = spans(df, scan(df, ledger or new_ledger(df), text_col, rules), text_col, rules)
    text = F.col(f"row.`{text_col}`")
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        gap = F.when(x["start"] > acc["at"], F.substr(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))).otherwise(F.lit(""))
        told = (x["start"] > acc["at"]) | (acc["at"] == 0)
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], gap, F.when(told, F.lit(mark)).otherwise(F.lit(""))).alias("out"))

    clean = F.aggregate("found", begin, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))))
    clean = F.when(F.col("found").isNull(), text).otherwise(clean).alias(text_col)
    return found.select(*[clean if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns])
