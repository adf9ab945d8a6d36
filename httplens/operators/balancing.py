"""Load-balancing experiments: bursts, schedules and tabular learning replayed from logs.

A session's steps depend on each other, so each is folded in order by one task; sessions are
spread. What doesn't depend on order is plain aggregation."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import load as L
from ..sources.scratch import written
from . import ranks


def burst_summary(results: DataFrame, by: tuple[str, ...] = ("policy",)) -> DataFrame:
    """Requests, routes, timeouts, errors, fast ones, and mean and nearest-rank 95th percentile of the
    latency of those that didn't time out. results: (by, node, latency_ms, timeout, error)."""
    done = F.when(~F.col("timeout"), F.col("latency_ms"))
    told = results.groupBy(*by).agg(
        F.count("*").alias("requests"), *[F.count_if(F.col("node") == n).alias(f"routes_{n}") for n in L.NODES],
        F.count_if(F.col("timeout")).alias("timeouts"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(done < 100.0).alias("under_100ms"),
        F.coalesce(F.avg(done), F.lit(0.0)).alias("average_latency_ms"),
    )
    counted = written(results.groupBy(*by, done.cast("double").alias("value")).agg(F.count("*").alias("n")))
    p95 = ranks.nearest_rank(counted, by, 0.95)
    return ranks.keyed(told, p95, by, "left").withColumn("q", F.coalesce("q", F.lit(0.0))).withColumnRenamed("q", "p95_latency_ms")


def compared(summaries: DataFrame) -> DataFrame:
    """The verdict on round_robin and q_learning, one row each side."""
    side = lambda p: F.max(F.when(F.col("policy") == p, F.struct("requests", "timeouts", "average_latency_ms"))).alias(p)
    j = summaries.agg(side("round_robin"), side("q_learning")).where("round_robin is not null and q_learning is not null")
    v = L.verdict(F.col("round_robin.timeouts"), F.col("round_robin.average_latency_ms"), F.col("q_learning.timeouts"), F.col("q_learning.average_latency_ms"), F.col("round_robin.requests"))
    return j.select(v.alias("v")).select("v.winner", "v.equivalent")


def counters(log: DataFrame, by: tuple[str, ...] = ("session",)) -> DataFrame:
    return log.groupBy(*by).agg(
        F.count("*").alias("steps"), *[F.count_if(F.col("action") == n).alias(f"count_{n}") for n in L.NODES], F.count_if(F.col("mode") == "exploracao").alias("explorations"),
        F.count_if(F.col("mode") == "explotacao").alias("exploitations"), F.count_if(F.col("timeout")).alias("timeouts"), F.sum("reward").alias("reward_total"),
    )


def greedy_policy(q: DataFrame) -> DataFrame:
    """(state, action) of the largest value in (state, action, q), the first node of equals."""
    order = F.struct(F.col("q"), (-F.array_position(F.array(*[F.lit(n) for n in L.NODES]), F.col("action"))).alias("i"))
    return q.groupBy("state").agg(F.max_by("action", order).alias("action"))


def concurrency_limit(loads: dict[str, Column]) -> Column:
    """Admissions until every node meets its first limit."""
    total = F.lit(0)
    for node, load in loads.items():
        most = L.MOST_ACTIVE[node]
        full = F.filter(F.sequence(F.lit(1), F.lit(most)), _fills(F.lit(node), load))
        total = total + F.coalesce(F.array_min(full), F.lit(most))
    return total


def _fills(node: Column, load: Column):
    return lambda active: L.saturated(node, L.cpu(node, load, active), active)


def training_environment(state: Column, node: Column) -> Column:
    """struct(cpu, wait): a request to a node of the state's load, with its own arrival and one
    active request."""
    load = L.after_arrival(node, L.of_node(state, L.STATE_LOAD))
    cpu = L.cpu(node, load, F.lit(1))
    return F.struct(cpu.alias("cpu"), L.wait_ms(node, cpu, F.lit(1)).alias("wait"))


def validated_loads(loads: Column) -> Column:
    """The map, or an error if a node lacks or a load lies outside 0 to 100."""
    ok = (F.size(loads) == len(L.NODES)) & F.forall(F.array(*[F.lit(n) for n in L.NODES]), lambda n: F.coalesce(F.try_element_at(loads, n).between(0, 100), F.lit(False)))
    return F.when(ok, loads).otherwise(F.raise_error(F.lit("a load from 0 to 100 for each node is needed")).cast("map<string,double>"))


def valid_q_table(q: DataFrame) -> DataFrame:
    """Combinations of state and action that a stored table lacks or that aren't known."""
    spark = q.sparkSession
    want = spark.createDataFrame([(s, a) for s in L.STATES for a in L.NODES], "state string, action string")
    have = q.select("state", "action")
    return want.exceptAll(have).unionAll(have.exceptAll(want))


class Learner:
    """Values of (state, action), chosen and updated in turn."""

    def __init__(self, seed: int, table: dict | None = None, first: bool = False):
        self.rng, self.first = random.Random(seed), first
        self.q = table or {s: dict.fromkeys(L.NODES, 0.0) for s in L.STATES}

    def choose(self, state: str, epsilon: float, among: list[str] | None = None, scores: dict[str, float] | None = None) -> tuple[str, str]:
        nodes, value = among or list(L.NODES), scores or self.q[state]
        if self.rng.random() < epsilon:
            return self.rng.choice(nodes), "exploracao"
        top = max(value[n] for n in nodes)
        best = [n for n in nodes if value[n] == top]
        return best[0] if self.first else self.rng.choice(best), "explotacao"

    def update(self, state: str, action: str, reward: float, following: str, alpha: float = L.ALPHA, gamma: float = L.GAMMA) -> float:
        now = self.q[state][action]
        self.q[state][action] = now + alpha * (reward + gamma * max(self.q[following].values()) - now)
        return self.q[state][action]


def reward_of(latency: float, timeout: bool) -> float:
    return -100.0 if timeout else 20.0 if latency < 100 else 2.0 if latency < 250 else -15.0


class Cluster:
    """Loads and active requests of the nodes."""

    def __init__(self, load: float = 50.0):
        self.load, self.active = dict.fromkeys(L.NODES, load), dict.fromkeys(L.NODES, 0)

    def cpu(self, node: str) -> float:
        return min(100.0, self.load[node] + self.active[node] * 10.0 / L.CAPACITY[node])

    def full(self, node: str) -> bool:
        return self.cpu(node) >= 90.0 or self.active[node] >= L.MOST_ACTIVE[node]

    def state(self) -> str:
        mean = sum(map(self.cpu, L.NODES)) / len(L.NODES)
        return L.STATES[0] if mean < 34 else L.STATES[1] if mean < 67 else L.STATES[2]

    def decay(self, seconds: float) -> None:
        self.load = {n: max(0.0, x - L.DECAY * seconds) for n, x in self.load.items()}

    def arrive(self, node: str) -> None:
        self.load[node] = min(100.0, self.load[node] + L.IMPACT / math.sqrt(L.CAPACITY[node]))
        self.active[node] += 1

    def wait(self, node: str) -> float:
        cpu, n = self.cpu(node), self.active[node]
        return L.BASE_LATENCY[node] + cpu * L.LOAD_FACTOR[node] + max(0, n - 1) ** 2 * 7.0 / L.CAPACITY[node] + (180.0 if cpu >= 90 or n >= L.MOST_ACTIVE[node] else 0.0)

    def scores(self, q: dict[str, float]) -> dict[str, float]:
        low, high = min(q.values()), max(q.values())
        base = {n: 10.0 * (q[n] - low) / (high - low) if high != low else 0.0 for n in L.NODES}
        return {n: base[n] - 0.2 * self.cpu(n) - 3.0 * self.active[n] - (40.0 if self.full(n) else 0.0) for n in L.NODES}

    def healthy(self) -> list[str]:
        return [n for n in L.NODES if not self.full(n)] or list(L.NODES)


def schedule(policy: str, requests: int, concurrency: int, q: dict | None = None, seed: int = 0) -> list[dict]:
    """The nodes that a policy picks for equal scenarios; a window of ``concurrency`` requests ends
    with all done and a quarter of a second of decay."""
    cluster, learner, out = Cluster(), Learner(seed, q), []
    for i in range(requests):
        if i and i % concurrency == 0:
            cluster.active = dict.fromkeys(L.NODES, 0)
            cluster.decay(0.25)
        state = cluster.state()
        if policy == "round_robin":
            node = L.NODES[i % len(L.NODES)]
        else:
            node, _ = learner.choose(state, L.EPSILON_LEAST, cluster.healthy(), cluster.scores(learner.q[state]))
        cluster.arrive(node)
        out.append({"policy": policy, "request": i, "node": node, "cpu": cluster.cpu(node), "active": cluster.active[node], "state": state, "latency_ms": cluster.wait(node)})
    return out


_LOG = "session string, step bigint, state string, action string, mode string, latency_ms double, timeout boolean, reward double, q_value double, epsilon double"


def replay(events: DataFrame, session: str = "session", order: str = "step", timeout_ms: float = 1000.0, seed: int = 7, epsilon: tuple[float, float] = (L.EPSILON, L.EPSILON_LEAST), first: bool = False) -> DataFrame:
    """Training replayed for each session over its events in order: states take turns, actions are
    ε-greedy (``epsilon``: at first and at least; of equal values a random one, or the ``first``), the
    latency is the model's wait plus the event's ``extra_ms``, values follow Bellman.

    Sessions are spread over tasks; one session is one sequence. Events of a session are streamed in
    order, not gathered."""
    rows = events.select(F.col(session).cast("string").alias("session"), F.col(order).alias("step"), F.col("extra_ms").cast("double").alias("extra_ms"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, learner, i, explore = None, None, 0, epsilon[0]
        for f in frames:
            out = []
            for name, extra in zip(f["session"], f["extra_ms"], strict=True):
                if name != own:
                    own, learner, i, explore = name, Learner(seed, first=first), 0, epsilon[0]
                state, following = L.STATES[i % 3], L.STATES[(i + 1) % 3]
                action, mode = learner.choose(state, explore)
                cluster = Cluster(L.STATE_LOAD[state])
                cluster.arrive(action)
                latency = cluster.wait(action) + float(extra or 0.0)
                late = latency >= timeout_ms
                gain = reward_of(latency, late)
                out.append((own, i + 1, state, action, mode, latency, late, gain, learner.update(state, action, gain, following), explore))
                i, explore = i + 1, max(epsilon[1], explore * L.EPSILON_DECAY)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _LOG.split(", ")])

    return rows.repartition("session").sortWithinPartitions("session", "step").select("session", "extra_ms").mapInPandas(fold, _LOG)


_SESSION = "session string, step bigint, state string, action string, mode string, cpu double, active int, latency_ms double, timeout boolean, reward double, q_value double, next_state string"


def online_session(events: DataFrame, learning: str = "continuous", timeout_ms: float = 1000.0, seed: int = 7, q: dict | None = None, epsilon: tuple[float, float] = (L.EPSILON, L.EPSILON_LEAST), first: bool = False) -> DataFrame:
    """A session of arrivals at times ``at`` (seconds): loads decay in between, requests end after
    their wait, control rows (``loads`` not null) set loads, and values are learnt on a copy unless
    ``learning`` is fixed. events: (session, at, loads map or null); epsilon and first as in ``replay``."""
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, cluster, learner, busy, last, n, explore = None, None, None, [], 0.0, 0, epsilon[0]
        for f in frames:
            out = []
            for name, at, loads in zip(f["session"], f["at"], f["loads"], strict=True):
                if name != own:
                    table = {s: dict(a) for s, a in q.items()} if q else None
                    own, cluster, learner, busy, last, n, explore = name, Cluster(), Learner(seed, table, first), [], float(at), 0, epsilon[0]
                cluster.decay(max(0.0, float(at) - last))
                last = float(at)
                for end, node in [b for b in busy if b[0] <= at]:
                    busy.remove((end, node))
                    cluster.active[node] -= 1
                if loads is not None:
                    cluster.load |= {k: float(v) for k, v in dict(loads).items()}
                    continue
                state = cluster.state()
                action, mode = learner.choose(state, explore, cluster.healthy(), cluster.scores(learner.q[state]))
                cluster.arrive(action)
                cpu, active, full, latency = cluster.cpu(action), cluster.active[action], cluster.full(action), cluster.wait(action)
                late = latency >= timeout_ms
                busy.append((float(at) + latency / 1000.0, action))
                gain = reward_of(latency, late) - max(0.0, cpu - 70.0) * 0.25 - max(0, active - 1) * 1.5 - (25.0 if full else 0.0)
                following = cluster.state()
                value = learner.update(state, action, gain, following) if learning == "continuous" else learner.q[state][action]
                n += 1
                out.append((own, n, state, action, mode, cpu, active, latency, late, gain, value, following))
                explore = max(epsilon[1], explore * L.EPSILON_DECAY)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _SESSION.split(", ")])

    rows = events.select(F.col("session").cast("string").alias("session"), F.col("at").cast("double").alias("at"), "loads")
    return rows.repartition("session").sortWithinPartitions("session", "at", F.col("loads").isNull()).mapInPandas(fold, _SESSION)
