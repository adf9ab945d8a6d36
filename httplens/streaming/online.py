"""Structured Streaming forms of the online operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import load as L  # noqa: N812
from ..operators import scoring

_RATE = "client string, event_id bigint, at bigint, request_rate bigint"
_WAITING = "waiting array<bigint>, events array<bigint>, counted array<bigint>"


def request_rate(stream: DataFrame, client: str = "client", event: str = "event_id", ts: str = "ts", seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Requests of each client in the trailing window, both ends included, itself counted: one row for
    each request, (client, event_id, ts, request_rate), as the same window over a table gives.

    A request waits until the watermark has passed it, when none before it can come any more (later
    ones are dropped); then a timer or its client's next request releases it. State is what waits
    and the instants of the last window; it leaves once the watermark has passed that, so idle
    clients hold nothing. A request costs its sort and two searches. A null client is one, too, and
    a null instant drops the request. At a stream's end, requests of the last ``late`` wait for a
    later one of any client (a heartbeat)."""
    width = seconds * 1_000_000

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ((), (), ())
        at, events, counted = (np.array(x, np.int64) for x in held)
        new = [] if state.hasTimedOut else list(frames)
        at, events = (np.concatenate([x, *[f[c].to_numpy(np.int64) for f in new]]) for x, c in ((at, "at"), (events, "event_id")))
        order = np.lexsort((events, at))
        at, events = at[order], events[order]
        watermark = state.getCurrentWatermarkMs() * 1000
        n = int(np.searchsorted(at, watermark, side="right"))
        every = np.concatenate([counted, at[:n]])  # counted ones lie before the former watermark, these after it
        rate = np.searchsorted(every, at[:n], side="right") - np.searchsorted(every, at[:n] - width, side="left")
        counted = every[np.searchsorted(every, watermark - width, side="left") :]
        if n < len(at) or len(counted):
            state.update((at[n:].tolist(), events[n:].tolist(), counted.tolist()))
            wake = at[n] if n < len(at) else counted[-1] + width
            state.setTimeoutTimestamp(max(int(-(-wake // 1000)), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if n:
            yield pd.DataFrame({"client": key[0], "event_id": events[:n], "at": at[:n], "request_rate": rate})

    rows = stream.select(F.col(client).cast("string").alias("client"), F.col(event).cast("bigint").alias("event_id"), F.col(ts).cast("timestamp").alias("ts"))
    rows = rows.where("ts is not null").withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    done = rows.groupBy("client").applyInPandasWithState(count, _RATE, _WAITING, "append", GroupStateTimeout.EventTimeTimeout)
    return done.select("client", "event_id", F.timestamp_micros("at").alias("ts"), "request_rate")


_LOADS = "node string, event_id bigint, at double, load double"
#: Arrivals told at a time.
SLICE = 1 << 14


def residual_load(stream: DataFrame, node: str = "node", event: str = "event_id", at: str = "at", decay: float = L.DECAY, impact: float = L.IMPACT, start: float = 50.0) -> DataFrame:
    """Each node's load after an arrival: what decayed since the last, plus the request's part, which is
    larger on nodes of less capacity (a node that isn't known has a capacity of 1). Of a batch's arrivals
    at a node, two numbers each are held, in order of which loads are told by slices."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        load, last = state.get if state.exists else (start, None)
        part, parts = impact / math.sqrt(L.CAPACITY.get(str(key[0]), 1.0)), {"at": [], "event_id": []}
        for f in frames:
            for c, held in parts.items():
                held.append(f[c].to_numpy(copy=True))  # a view would keep the whole frame
        at, events = (np.concatenate(parts.pop(c)) for c in ("at", "event_id"))
        order = np.lexsort((events, at))
        for lo in range(0, len(order), SLICE):
            own, loads = order[lo : lo + SLICE], []
            for t in at[own].tolist():
                load = max(0.0, load - decay * (max(0.0, t - last) if last is not None else 0.0))
                load, last = min(100.0, load + part), t
                loads.append(load)
            if lo + SLICE >= len(order):
                state.update((load, last))
            yield pd.DataFrame({"node": str(key[0]), "event_id": events[own], "at": at[own], "load": loads})

    rows = stream.select(F.col(node).cast("string").alias("node"), F.col(event).alias("event_id"), F.col(at).cast("double").alias("at"))
    return rows.groupBy("node").applyInPandasWithState(fold, _LOADS, "load double, last double", "append", GroupStateTimeout.NoTimeout)


def scored(stream: DataFrame, columns: list[str], e1: tuple[list, float], e2: tuple[list, float], primary: str = "experimento_1", strict: bool = True) -> DataFrame:
    """Decisions of two networks (layers, threshold) on each row, and that of the primary one: native
    expressions without state, so a stream of any source scores as a table does."""
    x = F.array(*[F.col(c).cast("double") for c in columns])
    rows = stream.withColumns({"e1_score": scoring.forward(x, e1[0])[0], "e2_score": scoring.forward(x, e2[0])[0]})
    e1_blocks, e2_blocks = scoring.decided(F.col("e1_score"), e1[1], not strict), scoring.decided(F.col("e2_score"), e2[1], not strict)
    told = lambda c: F.when(c, "BLOQUEIA").otherwise("LIBERA")
    return rows.withColumns({"e1_decision": told(e1_blocks), "e2_decision": told(e2_blocks), "operational_decision": scoring.arbitrate(primary, e1_blocks, e2_blocks)})


def to_history(decisions: DataFrame, path: str, checkpoint: str):
    """Append decisions to a history, once each."""
    return decisions.writeStream.outputMode("append").format("csv").option("header", True).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def sessions(stream: DataFrame, client: str, ts: str, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each client with a gap between them (an addition: the online system had none)."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.col(client), F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("requests")).select(client, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests")
