"""Normalisation, network scores, decisions, metrics and thresholds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stats import quantile_caps

#: Thresholds as a step that is the difference of the first two, so that they equal an arange's.
GRID = tuple(0.05 + i * ((0.05 + 0.01) - 0.05) for i in range(91))

# Names of normalisation methods.
BINARY, RATIO, SIGNED, CAPPED = "binaria_identidade", "razao_clip_0_1", "escala_assinada_robusta", "cap_robusto_divisao"


def method_for(name: str, kind: str) -> str:
    return BINARY if kind == "binaria" else RATIO if name.endswith("_ratio") else SIGNED if kind == "contagem_assinada" else CAPPED


def fit_normalizer(train: DataFrame, kinds: dict[str, str], q: float = 0.995) -> list[dict]:
    """A spec for each feature, in order. Only caps and scales are read from the training rows, in
    one aggregate; what reaches the driver is one number for each feature."""
    methods = {n: method_for(n, k) for n, k in kinds.items()}
    robust = [n for n, m in methods.items() if m in (SIGNED, CAPPED)]
    signed = tuple(n for n in robust if methods[n] == SIGNED)
    caps = {r["feature"]: r["cap"] for r in quantile_caps(train, robust, q, signed).collect()} if robust else {}
    return [{"feature": n, "method": m, "cap": caps.get(n, 1.0) if m in (SIGNED, CAPPED) else None} for n, m in methods.items()]


def clip(x: Column, least: float, most: float) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), x))


def normalized(df: DataFrame, specs: list[dict], keep: Sequence[str] = ()) -> DataFrame:
    """Features by their specs, as plain arithmetic with constants."""
    def one(s: dict) -> Column:
        x = F.col(s["feature"]).cast("double")
        if s["method"] in (BINARY, RATIO):
            return clip(x, 0.0, 1.0)
        return clip(x / F.lit(s["cap"]), -1.0 if s["method"] == SIGNED else 0.0, 1.0)

    return df.select(*keep, *[one(s).alias(s["feature"]) for s in specs])


def fixed_limits(x: Column, limit: float) -> Column:
    return clip(x.cast("double") / F.lit(float(limit)), 0.0, 1.0)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(x, -709.0, 709.0)))


def forward(inputs: Column, layers: Sequence[Sequence[Sequence[float]]]) -> Column:
    """Outputs of a network of sigmoids as an array column. layers[l][j]: weights of neuron j,
    bias first (its input is -1). For small networks: each neuron is one fold over its inputs."""
    out = inputs
    for layer in layers:
        weights = F.array(*[F.array(*[F.lit(float(w)) for w in neuron]) for neuron in layer])
        out = F.transform(weights, _neuron(F.concat(F.array(F.lit(-1.0)), out)))
    return out


def _neuron(values: Column):
    products = lambda w: F.zip_with(values, w, lambda a, b: a * b)
    return lambda w: sigmoid(F.aggregate(products(w), F.lit(0.0), lambda s, x: s + x))


def forward_batches(df: DataFrame, features: Sequence[str], layers: Sequence[Sequence[Sequence[float]]], name: str = "score") -> DataFrame:
    """``df`` with the first output of a wide network, by one matrix product for each Arrow batch."""
    weights = [np.array(layer, dtype=float).T for layer in layers]

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        x = np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, len(features)))
        for w in weights:
            x = 1.0 / (1.0 + np.exp(-np.clip(np.column_stack([np.full(len(x), -1.0), x]) @ w, -709, 709)))
        return pd.Series(x[:, 0])

    return df.withColumn(name, score(F.array(*[F.col(f).cast("double") for f in features])))


def decided(score: Column, threshold: float | Column, inclusive: bool) -> Column:
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return score >= limit if inclusive else score > limit


def _rates(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    precision, recall = safe(tp, tp + fp), safe(tp, tp + fn)
    return {
        "accuracy": safe(tp + tn, tp + tn + fp + fn), "precision": precision, "recall": recall,
        "f1": safe(2.0 * precision * recall, precision + recall), "fpr": safe(fp, fp + tn), "fnr": safe(fn, fn + tp),
    }


def confusion(df: DataFrame, label: Column, blocked: Column, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp and rates; a rate without a denominator is 0."""
    count = lambda c: F.count_if(c)
    cells = df.groupBy(*by).agg(
        count((label == 0) & ~blocked).alias("tn"), count((label == 0) & blocked).alias("fp"), count((label == 1) & ~blocked).alias("fn"), count((label == 1) & blocked).alias("tp")
    )
    return cells.select(*by, "tn", "fp", "fn", "tp", *[c.alias(k) for k, c in _rates(*[F.col(x) for x in ("tn", "fp", "fn", "tp")]).items()])


def sweep(df: DataFrame, score: str, label: str, alpha: float, beta: float, inclusive: bool = False, grid: Sequence[float] = GRID) -> DataFrame:
    """Metrics and cost of each threshold, from one pass.

    Each score is put at the number of thresholds that block it, counted there by label, and cells
    follow from sums over that short histogram: rows are never multiplied by thresholds."""
    spark = df.sparkSession
    s = F.col(score)
    edges = F.array(*[F.lit(float(t)) for t in grid])
    blocks = F.size(F.filter(edges, lambda t: (t <= s) if inclusive else (t < s)))
    bins = df.where(s.isNotNull()).groupBy(blocks.alias("bin")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    steps = spark.createDataFrame([(i, float(t)) for i, t in enumerate(grid)] + [(len(grid), None)], "bin int, threshold double")
    hist = steps.join(bins, "bin", "left").na.fill(0, ["pos", "neg"])
    below = W.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.orderBy("bin").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cells = hist.select(
        "threshold", F.sum("neg").over(below).alias("tn"), (F.sum("neg").over(whole) - F.sum("neg").over(below)).alias("fp"),
        F.sum("pos").over(below).alias("fn"), (F.sum("pos").over(whole) - F.sum("pos").over(below)).alias("tp"),
    ).where("threshold is not null")
    cost = F.lit(float(alpha)) * F.col("fn") + F.lit(float(beta)) * F.col("fp")
    return cells.select("*", *[c.alias(k) for k, c in _rates(*[F.col(x) for x in ("tn", "fp", "fn", "tp")]).items()], cost.alias("security_cost"))


def best(swept: DataFrame) -> DataFrame:
    """The threshold of least cost, then fewest misses and false alarms, then best rates, then the
    smallest."""
    return swept.orderBy("security_cost", "fn", "fp", F.desc("f1"), F.desc("precision"), F.desc("recall"), F.desc("accuracy"), "threshold").limit(1)


def best_candidate(candidates: DataFrame) -> DataFrame:
    """The trained candidate of least cost, then fewest misses and false alarms, then best rates, then
    shortest training, then smallest id."""
    return candidates.orderBy("security_cost", "fn", "fp", F.desc("f1"), F.desc("precision"), F.desc("recall"), F.desc("accuracy"), "wall_seconds", "candidate_id").limit(1)


def mean_squared_error(df: DataFrame, label: Column, score: Column) -> DataFrame:
    return df.agg(F.avg((label - score) * (label - score)).alias("mse"))


def arbitrate(primary: str, e1_blocked: Column, e2_blocked: Column) -> Column:
    """The decision of the primary experiment: BLOQUEIA or LIBERA."""
    chosen = e1_blocked if primary == "experimento_1" else e2_blocked
    return F.when(chosen, "BLOQUEIA").otherwise("LIBERA")


def model_id(value: Column) -> Column:
    """Canonical id of a model name, null if unknown."""
    text = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "-", "_"), "/", ":")
    full = F.regexp_replace(text, "^e([12]):", "experimento_$1:")
    return F.when(full.rlike("^experimento_[12]:(bp|ag)$"), full)


def exceedances(values: dict[str, Column], limits: dict[str, float]) -> Column:
    """array of struct(feature, valor_real, limite) of the values over their limit."""
    rows = F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("double").alias("valor_real"), F.lit(float(limits[k])).alias("limite")) for k, v in values.items()])
    return F.filter(rows, lambda x: x["valor_real"] > x["limite"])
