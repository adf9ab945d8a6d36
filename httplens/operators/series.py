"""Ordered series: rates, learning curves, versions and matches in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import load as L  # noqa: N812
from .scan import clamped_sums, scan


def request_rate(df: DataFrame, client: str, ts: str, seconds: int = 60, name: str = "request_rate") -> DataFrame:
    """``df`` with how many rows of the client lie in the last ``seconds``, both ends included.
    (Rows at the same instant count each other.)

    Rows are dealt by client and slot of so many seconds, and stand once more, as a mere instant, in
    the slot after their own, so a hot client is spread over its slots."""
    width = seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    places = F.transform(F.array(F.lit(0), F.lit(1)), lambda n: F.struct((F.floor(at / width) + n).alias("slot"), (n == 0).alias("own")))
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.col(client).alias("client"), at.alias("at"), F.explode(places).alias("p"))
    rows = rows.select(F.when(F.col("p.own"), F.col("row")).alias("row"), "client", "at", "p.slot", "p.own")
    w = W.partitionBy("client", "slot").orderBy("at").rangeBetween(-width, 0)
    return rows.withColumn("n", F.count("*").over(w)).where("own").select("row.*", F.col("n").alias(name))


def recent_improvement(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, n, improvement): the relative fall from the value at four fifths to the last; null for
    fewer than two, 0 if the first is about 0."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(by, F.col(order).alias("__o"), F.col(value).alias("__v"))
    rows = scan(rows, [by], ["__o"], number="__at", total="__n")
    at = F.greatest(F.lit(1), F.floor(F.col("__n") * 0.8))
    start, end = F.max(F.when(F.col("__at") == at, F.col("__v"))), F.max(F.when(F.col("__at") == F.col("__n"), F.col("__v")))
    both = rows.groupBy(by).agg(F.max("__n").alias("n"), start.alias("a"), end.alias("z"))
    change = F.when(F.abs("a") > 1e-12, F.try_divide(F.col("a") - F.col("z"), F.abs("a"))).otherwise(0.0)
    return both.select(by, "n", F.when(F.col("n") >= 2, change).alias("improvement"))


def oscillation(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, oscillation): changes of direction to steps that move, 0 for short series."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(by, F.col(order).alias("__o"), F.col(value).alias("__v"))
    steps = scan(rows, [by], ["__o"], total="__n", previous={"__v": "__p"}).withColumn("__d", F.col("__v") - F.col("__p"))
    moved = steps.where(F.abs("__d") > 1e-10).select(by, "__o", "__n", F.signum("__d").alias("__s"))
    moved = scan(moved, [by], ["__o"], previous={"__s": "__before"})
    found = moved.groupBy(by).agg(F.max("__n").alias("__n"), F.count("*").alias("__k"), F.count_if(F.col("__s") != F.col("__before")).alias("__c"))
    ratio = F.when((F.col("__n") >= 4) & (F.col("__k") >= 2), F.try_divide(F.col("__c").cast("double"), F.col("__k") - 1)).otherwise(0.0)
    every = df.select(by).distinct()
    return every.join(found.select(by, ratio.alias("oscillation")), by, "left").select(by, F.coalesce("oscillation", F.lit(0.0)).alias("oscillation"))


def running_best(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    return scan(df, [by], [order], least={value: "best"})


def version_changes(df: DataFrame, by: str, order: str, values: dict[str, bool], newest: int = 20) -> DataFrame:
    """Each version after the first with its predecessor: previous, result, delta and tone of every
    value (True: lower is better); the newest ``newest`` of each series, newest first."""
    rows = scan(df.select(by, order, *values), [by], [order], number="version", total="__n", previous={v: f"previous_{v}" for v in values})
    rows = rows.where((F.col("version") > 1) & (F.col("version") > F.col("__n") - newest))
    rows = rows.select(by, order, *[c for v in values for c in (F.col(f"previous_{v}"), F.col(v).alias(f"result_{v}"))], (F.col("version") - 1).alias("sequence"))
    for v, low in values.items():
        d = F.col(f"result_{v}") - F.col(f"previous_{v}")
        better, worse = (d < 0, d > 0) if low else (d > 0, d < 0)
        rows = rows.withColumn(f"delta_{v}", d).withColumn(f"tone_{v}", F.when(better, "better").when(worse, "worse").otherwise("neutral"))
    return rows


def version_verdict(cost_before: Column, cost_after: Column, f1_before: Column, f1_after: Column) -> Column:
    """better, worse or neutral: by cost, and by F1 if costs are equal or unknown."""
    by_f1 = F.when(f1_after > f1_before, "better").when(f1_after < f1_before, "worse").otherwise("neutral")
    return F.when(cost_after < cost_before, "better").when(cost_after > cost_before, "worse").otherwise(by_f1)


def changed_parameters(before: Column, after: Column) -> Column:
    """Entries of two maps that differ or that one lacks: key to struct(before, after)."""
    keys = F.array_union(F.map_keys(before), F.map_keys(after))
    differ = F.filter(keys, lambda k: ~F.try_element_at(before, k).eqNullSafe(F.try_element_at(after, k)))
    return F.map_from_entries(F.transform(differ, lambda k: F.struct(k.alias("key"), F.struct(F.try_element_at(before, k).alias("before"), F.try_element_at(after, k).alias("after")).alias("value"))))


def newest_match(probes: DataFrame, rows: DataFrame, on: list[str], start: str, ts: str, before_ms: int = 2000, slot_ms: int = 3_600_000, horizon_ms: int | None = None) -> DataFrame:
    """For each probe the newest row of equal keys at or after its start less ``before_ms`` (and
    before start plus ``horizon_ms``, if given); probes without one keep nulls.

    With a horizon, both sides meet in time slots by equality, so a hot key is dealt over its slots;
    without one only the newest row of each key can match, and that is aggregated first."""
    ms = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1000
    p = probes.withColumn("__id", F.xxhash64(*probes.columns)).withColumn("__from", ms(start) - before_ms)
    value = F.struct(ms(ts).alias("t"), *[F.col(c) for c in rows.columns if c not in on])
    if horizon_ms is None:
        last = rows.groupBy(*on).agg(F.max(value).alias("match"))
        j = p.join(last, on, "left")
        return j.withColumn("match", F.when(F.col("match.t") >= F.col("__from"), F.col("match"))).drop("__id", "__from")
    slot = lambda c: F.floor(c / slot_ms).cast("bigint")
    p = p.withColumn("__to", ms(start) + horizon_ms)
    spread = p.withColumn("__slot", F.explode(F.sequence(slot(F.col("__from")), slot(F.col("__to")))))
    r = rows.withColumn("__match", value).withColumn("__t", ms(ts)).withColumn("__slot", slot(ms(ts))).select(*on, "__slot", "__t", "__match")
    inside = (F.col("__t") >= F.col("__from")) & (F.col("__t") < F.col("__to"))
    hit = spread.join(r, [*on, "__slot"]).where(inside).groupBy("__id").agg(F.max("__match").alias("match"))
    return p.join(hit, "__id", "left").drop("__id", "__from", "__to")


def round_robin(df: DataFrame, order: list[str], n: int = 3, by: str | None = None, name: str = "node") -> DataFrame:
    """Turn of each row among n: its place modulo n, in its client's sequence or in one of all rows."""
    rows = scan(df, [by] if by else [], order, number="__i")
    return rows.withColumn(name, ((F.col("__i") - 1) % n).cast("int")).drop("__i")


def residual_loads(df: DataFrame, node: str, order: list[str], at: str, decay: float = L.DECAY, impact: float = L.IMPACT, start: float = 50.0, name: str = "load") -> DataFrame:
    """Each node's load after each arrival: what decayed since the last, plus the request's part, at
    most 100. The rows of one node are spread over ranges (see ``scan.clamped_sums``)."""
    part = F.lit(impact) / F.sqrt(F.coalesce(L.of_node(F.col(node), L.CAPACITY), F.lit(1.0)))
    rows = scan(df, [node], order, previous={at: "__last"})
    gone = F.lit(decay) * F.greatest(F.lit(0.0), F.coalesce(F.col(at) - F.col("__last"), F.lit(0.0)))
    rows = rows.withColumns({"__p": part, "__step": part - gone, "__most": F.lit(100.0)})
    return clamped_sums(rows, [node], order, "__step", "__p", "__most", start, name).drop("__last", "__p", "__step", "__most")


def scaled(df: DataFrame, by: str, value: str) -> DataFrame:
    """Values between 0 and 1 in their series; a flat one is 0.5."""
    w = W.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("scaled", F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.5))
