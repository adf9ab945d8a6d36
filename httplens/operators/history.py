"""Queries over decision histories, reserved records and model results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed value: columns of the history.
HISTORY = "timestamp string, method string, target_path string, primary_model string, operational_decision string, e1_algorithm string, e1_score double, e1_decision string, e2_algorithm string, e2_score double, e2_decision string, status_http int"
# Acceptance criteria.
CRITERIA = {"accuracy": (">=", 0.95), "precision": (">=", 0.95), "recall": (">=", 0.95), "f1": (">=", 0.95), "fpr": ("<=", 0.05), "fnr": ("<=", 0.05)}
# Headers that a replay sends, and those of the proxy.
_REPLAYED = ("user-agent", "pragma", "cache-control", "accept", "accept-charset", "accept-language", "cookie", "content-type")
_PROXY = ("x-original-uri", "x-original-method", "x-original-target", "x-real-ip", "x-forwarded-for", "x-training-token")


def summary(history: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    blocked = F.count_if(F.col("operational_decision") == "BLOQUEIA")
    return history.groupBy(*by).agg(
        F.count("*").alias("total"), (F.count("*") - blocked).alias("allowed"), blocked.alias("blocked"), F.count_if(~F.col("e1_decision").eqNullSafe(F.col("e2_decision"))).alias("disagreements")
    )


def page(history: DataFrame, order: list[str], number: int = 1, size: int = 15) -> DataFrame:
    """One page, newest first; the number is held to the pages there are, the size to 1 to 50. Only as
    many rows as end with the page are kept of each task."""
    size = min(max(int(size), 1), 50)
    pages = max(-(-history.count() // size), 1)
    number = min(max(int(number), 1), pages)
    return history.orderBy(*[F.col(c).desc() for c in order]).offset((number - 1) * size).limit(size)


def public_record(records: DataFrame) -> DataFrame:
    """A reserved record without its bytes: expected class and decision, and 1000 characters of body."""
    body = F.decode(F.unbase64(F.coalesce("body_base64", F.lit(""))), "ISO-8859-1")
    attack = F.col("label") == 1
    return records.select(
        "record_id", "source_sequence", F.when(attack, "ATAQUE").otherwise("NORMAL").alias("expected_class"), F.when(attack, "BLOQUEIA").otherwise("LIBERA").alias("expected_decision"),
        "method", "target", "path", "query", "content_type", F.substring(body, 1, 1000).alias("body_preview"), (F.length(body) > 1000).alias("body_truncated"),
    )


def available(records: DataFrame) -> DataFrame:
    """Per class, the methods there are and how many records."""
    return records.groupBy("label").agg(F.array_sort(F.collect_set("method")).alias("methods"), F.count("*").alias("n"))


def sample(records: DataFrame, label: int, method: str = "", limit: int = 20, seed: int = 0) -> DataFrame:
    """Up to 30 records of a class, and of a method if given, by a seeded hash of their id."""
    rows = records.where(F.col("label") == label)
    if method.strip():
        rows = rows.where(F.col("method") == method.strip().upper())
    return public_record(rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("record_id"))), "record_id").limit(min(max(int(limit), 1), 30)))


def by_id(records: DataFrame, record_id: str) -> DataFrame:
    """The record of an id; an error if there is none."""
    row = records.where(F.col("record_id") == record_id)
    if row.isEmpty():
        raise KeyError(f"no reserved record {record_id}")
    return row


def replay_headers(headers: Column) -> Column:
    """Headers that a replay sends: of the allowed ones, values joined, none with a line end."""
    joined = F.transform_values(headers, lambda _, v: F.array_join(v, ", "))
    return F.map_filter(joined, lambda k, v: F.lower(k).isin(*_REPLAYED) & ~v.rlike("[\r\n]"))


def without_proxy_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*_PROXY))


def verified(records: DataFrame) -> DataFrame:
    """Records with ``raw`` from their Base64; an error where its hash isn't the stored one."""
    raw = F.unbase64("raw_request_base64")
    same = F.sha2(raw, 256) == F.col("content_sha256")
    return records.withColumn("raw", F.when(same, raw).otherwise(F.raise_error(F.lit("content hash does not match")).cast("binary")))


def agreement(expected: Column, e1: Column, e2: Column) -> Column:
    """Which experiments decided as expected: both, e1, e2 or none."""
    a, b = e1 == expected, e2 == expected
    return F.when(a & b, "both").when(a, "e1").when(b, "e2").otherwise("none")


def with_labels(history: DataFrame, labels: DataFrame, key: str = "timestamp") -> DataFrame:
    """History with manual labels where there are any; one label for each key, the largest."""
    return history.join(labels.groupBy(key).agg(F.max("label").alias("label")), key, "left")


def comparison_table(results: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, bp, ag): metrics of two algorithms side by side. results: (algorithm, metrics...)."""
    pairs = ", ".join(f"'{m}', cast(`{m}` as double)" for m in metrics)
    rows = results.select("algorithm", F.expr(f"stack({len(metrics)}, {pairs}) as (metric, value)"))
    return rows.groupBy("metric").pivot("algorithm", ["bp", "ag"]).agg(F.first("value"))


def payload(results: DataFrame, series: DataFrame, normalization: DataFrame) -> DataFrame:
    """One row for each experiment and algorithm, with its series in order and its normaliser.
    (A series and a feature list are bounded by what one training writes.)"""
    points = F.array_sort(F.collect_list(F.struct("step", *[F.col(c) for c in series.columns if c not in ("experiment", "algorithm", "step")])))
    s = series.groupBy("experiment", "algorithm").agg(points.alias("series"))
    n = normalization.groupBy("experiment").agg(F.array_sort(F.collect_list(F.struct("position", "feature", "method", "cap"))).alias("normalization"))
    return results.join(s, ["experiment", "algorithm"], "left").join(n, "experiment", "left")


def without_weights(results: DataFrame) -> DataFrame:
    return results.drop("weights", "diagnostic")


def method_histogram(normalization: DataFrame) -> DataFrame:
    return normalization.groupBy("method").agg(F.count("*").alias("n"))


def checks(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, criterion, value, target, passed), one row for each criterion; a missing or not finite
    value fails."""
    cases = ", ".join(f"'{m}', cast(`{m}` as double), '{op}', {t}D" for m, (op, t) in CRITERIA.items())
    rows = metrics.select(*keys, F.expr(f"stack({len(CRITERIA)}, {cases}) as (criterion, value, operator, target)"))
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    ok = F.when(F.col("operator") == ">=", F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target"))
    return rows.select(*keys, "criterion", F.when(finite, F.col("value")).alias("value"), "operator", "target", (finite & ok).alias("passed"))


def _wider(hidden: Column) -> Column:
    up = lambda f: F.transform(hidden, lambda w: F.greatest(F.lit(2), F.ceil(w * f).cast("int")))
    return F.when(F.size(hidden) == 1, up(1.5)).otherwise(up(1.25))


def architecture_candidates(architecture: Column) -> Column:
    """struct(wider, deeper) of a list of layer sizes: hidden layers by half as much again (a quarter,
    if several), or one more of half the last."""
    inner = F.slice(architecture, F.lit(2), F.size(architecture) - 2)
    ends = F.slice(architecture, 1, 1), F.slice(architecture, -1, 1)
    more = F.array(F.greatest(F.lit(2), F.ceil(F.element_at(inner, -1) / 2).cast("int")))
    return F.struct(F.concat(ends[0], _wider(inner), ends[1]).alias("wider"), F.concat(ends[0], inner, more, ends[1]).alias("deeper"))


def diagnosis(models: DataFrame) -> DataFrame:
    """status, signals and recommendations by rule, from training and validation only.

    models: algorithm, train and validation structs of rates, architecture, population, improvement,
    oscillation, saturation, diversity_ratio, genes. Recommendations are structs (area, level, code)."""
    v, t, c = (lambda n: F.col(f"validation.{n}")), (lambda n: F.col(f"train.{n}")), F.col
    passed = sum((F.when((v(m) >= x) if op == ">=" else (v(m) <= x), 1).otherwise(0) for m, (op, x) in CRITERIA.items()), F.lit(0))
    m = models.withColumn("passed", passed).withColumn("acceptable", F.col("passed") == len(CRITERIA)).withColumn("f1_gap", t("f1") - v("f1"))
    over = F.coalesce(c("f1_gap") > 0.05, F.lit(False))
    low = (t("f1") < CRITERIA["f1"][1]) | (t("accuracy") < CRITERIA["accuracy"][1])
    under = ~c("acceptable") & low & (F.abs(F.coalesce("f1_gap", F.lit(0.0))) <= 0.03)
    bp = c("algorithm") == "bp"
    r = lambda area, level, code: F.struct(F.lit(area).alias("area"), F.lit(level).alias("level"), F.lit(code).alias("code"))
    shape = (
        F.when(c("acceptable") & ~over, r("architecture", "keep", "keep_architecture")).when(over, r("architecture", "warn", "do_not_grow"))
        .when(under & ~bp & (c("population") < 32), r("architecture", "investigate", "retry_optimizer_first")).otherwise(r("architecture", "investigate", "try_more_capacity"))
    )
    gains = F.coalesce(c("improvement") > F.when(bp, 0.01).otherwise(0.005), F.lit(False))
    budget = F.when(~c("acceptable") & gains, r("budget", "try", "train_longer")).when(c("acceptable"), r("budget", "keep", "enough")).otherwise(r("budget", "warn", "longer_is_not_enough"))
    small = F.coalesce(c("population") < F.greatest(F.lit(32.0), F.sqrt("genes") / 2), F.lit(False))
    lost = F.coalesce(c("diversity_ratio") < 0.25, F.lit(False))
    by_bp = F.when(~c("acceptable") & (c("oscillation") > 0.55), r("optimizer", "try", "lower_learning_rate")).when(c("saturation") > 35, r("optimizer", "warn", "keep_learning_rate")).otherwise(r("optimizer", "keep", "keep_learning_rate"))
    level = F.when(~c("acceptable") & (small | lost), "try").otherwise("keep")
    code = F.when(~c("acceptable") & small, "larger_population").when(lost, "check_diversity").otherwise("keep_operators")
    by_ag = F.struct(F.lit("optimizer").alias("area"), level.alias("level"), code.alias("code"))
    general = F.when(over, r("generalisation", "warn", "gap")).otherwise(r("generalisation", "keep", "coherent"))
    focus = F.when(v("fpr") > CRITERIA["fpr"][1], "fewer_false_positives").when(v("fnr") > CRITERIA["fnr"][1], "fewer_false_negatives").otherwise("balance")
    following = F.struct(F.lit("next").alias("area"), F.when(c("acceptable"), "keep").otherwise("priority").alias("level"), F.when(c("acceptable"), "baseline").otherwise(focus).alias("code"))
    return m.select(
        *models.columns, F.when(c("acceptable"), "aceitavel").otherwise("investigar").alias("status"), "passed", F.lit(len(CRITERIA)).alias("checks"), "f1_gap",
        over.alias("overfit"), under.alias("underfit"), F.array(shape, budget, F.when(bp, by_bp).otherwise(by_ag), general, following).alias("recommendations"),
    )


def hidden_layers(text: Column) -> Column:
    """Layer sizes out of text such as ``64, 32`` or ``64 x 32``; null if any isn't a positive integer."""
    parts = F.filter(F.split(text, r"[,;xX×→\s]+"), lambda p: p != "")
    sizes = F.transform(parts, lambda p: p.try_cast("int"))
    ok = (F.size(sizes) > 0) & F.forall(sizes, lambda n: n.isNotNull() & (n > 0))
    return F.when(ok, sizes)


def parameter_count(architecture: Column) -> Column:
    """Weights of a network, biases included."""
    pairs = F.arrays_zip(architecture.alias("a"), F.slice(architecture, 2, 1 << 30).alias("b"))
    return F.aggregate(F.filter(pairs, lambda p: p["b"].isNotNull()), F.lit(0), lambda n, p: n + (p["a"] + 1) * p["b"])


def request_problem(architecture: Column, features: Column) -> Column:
    """What is wrong with a training request's architecture, or null."""
    return (
        F.when(~F.size(architecture).between(3, 5), "one to three hidden layers").when(F.exists(architecture, lambda n: (n < 1) | (n > 512)), "sizes from 1 to 512")
        .when((F.element_at(architecture, 1) != features) | (F.element_at(architecture, -1) != 1), "first and last size").when(parameter_count(architecture) > 250_000, "more than 250000 parameters")
    )


def estimated_seconds(previous: Column, parameters: Column, previous_parameters: Column, *budgets: tuple[Column, Column]) -> Column:
    """Previous seconds, in proportion to parameters and each (new, old) budget; 1 at least."""
    out = previous * parameters / F.greatest(previous_parameters, F.lit(1))
    for new, old in budgets:
        out = out * new / F.greatest(old, F.lit(1))
    return F.greatest(F.lit(1.0), out)


def latest(df: DataFrame, by: str, order: str) -> DataFrame:
    w = W.partitionBy(by).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
