"""The load-balancing model: states, telemetry, waits, rewards and scores as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States, nodes and constants of the model.
STATES = ("carga_baixa", "carga_media", "carga_alta")
NODES = ("node1", "node2", "node3")
CAPACITY = {"node1": 1.00, "node2": 0.25, "node3": 0.05}
BASE_LATENCY = {"node1": 8.0, "node2": 35.0, "node3": 90.0}
LOAD_FACTOR = {"node1": 0.72, "node2": 0.78, "node3": 0.84}
MOST_ACTIVE = {"node1": 8, "node2": 2, "node3": 1}
STATE_LOAD = {"carga_baixa": 20.0, "carga_media": 50.0, "carga_alta": 70.0}
DECAY, IMPACT = 6.0, 1.5
ALPHA, GAMMA = 0.25, 0.85
EPSILON, EPSILON_LEAST, EPSILON_DECAY = 0.30, 0.02, 0.995


def of_node(node: Column, values: dict) -> Column:
    out = None
    for name, v in values.items():
        out = F.when(node == name, F.lit(v)) if out is None else out.when(node == name, F.lit(v))
    return out


def state_of(mean_load: Column) -> Column:
    return F.when(mean_load < 34.0, STATES[0]).when(mean_load < 67.0, STATES[1]).otherwise(STATES[2])


def cpu(node: Column, load: Column, active: Column) -> Column:
    return F.least(F.lit(100.0), load + active * (F.lit(10.0) / of_node(node, CAPACITY)))


def saturated(node: Column, cpu_: Column, active: Column) -> Column:
    return (cpu_ >= 90.0) | (active >= of_node(node, MOST_ACTIVE))


def wait_ms(node: Column, load: Column, active: Column) -> Column:
    """Base wait, load, queueing behind others, and a penalty at the limit."""
    behind = F.greatest(F.lit(0), active - 1)
    full = F.when((load >= 90.0) | (active >= of_node(node, MOST_ACTIVE)), 180.0).otherwise(0.0)
    return of_node(node, BASE_LATENCY) + load * of_node(node, LOAD_FACTOR) + (behind * behind) * (F.lit(7.0) / of_node(node, CAPACITY)) + full


def reward(latency: Column, timeout: Column) -> Column:
    return F.when(timeout, -100.0).when(latency < 100.0, 20.0).when(latency < 250.0, 2.0).otherwise(-15.0)


def operational_reward(latency: Column, timeout: Column, cpu_: Column, active: Column, full: Column) -> Column:
    """struct of the total and its parts."""
    base = reward(latency, timeout)
    by_cpu = F.greatest(F.lit(0.0), cpu_ - 70.0) * 0.25
    by_active = F.greatest(F.lit(0), active - 1) * 1.5
    by_full = F.when(full, 25.0).otherwise(0.0)
    return F.struct((base - by_cpu - by_active - by_full).alias("total"), base.alias("latency_reward"), by_cpu.alias("cpu_penalty"), by_active.alias("concurrency_penalty"), by_full.alias("saturation_penalty"))


def decayed(load: Column, seconds: Column) -> Column:
    return F.greatest(F.lit(0.0), load - F.lit(DECAY) * seconds)


def after_arrival(node: Column, load: Column) -> Column:
    return F.least(F.lit(100.0), load + F.lit(IMPACT) / F.sqrt(of_node(node, CAPACITY)))


def learned_score(q: Column, least: Column, most: Column) -> Column:
    return F.when(most != least, 10.0 * (q - least) / (most - least)).otherwise(0.0)


def penalised(score: Column, cpu_: Column, active: Column, full: Column) -> Column:
    return score - 0.20 * cpu_ - 3.0 * active - F.when(full, 40.0).otherwise(0.0)


def epsilon_at(k: Column, start: float = EPSILON) -> Column:
    """Exploration rate after k steps, in closed form (the last bit may differ from the loop's)."""
    return F.greatest(F.lit(EPSILON_LEAST), F.lit(start) * F.pow(F.lit(EPSILON_DECAY), k))


def verdict(rr_timeouts: Column, rr_mean: Column, ql_timeouts: Column, ql_mean: Column, n: Column) -> Column:
    """struct(winner, equivalent): fewer timeouts by 2 % of the requests (1 at least), else, timeouts
    equal, a mean latency that is 5 % lower."""
    margin = F.greatest(F.lit(1), F.ceil(n * 0.02))
    gap = rr_timeouts - ql_timeouts
    far = F.abs(rr_mean - ql_mean) / F.greatest(rr_mean, ql_mean, F.lit(1.0)) >= 0.05
    winner = F.when(F.abs(gap) >= margin, F.when(gap > 0, "q_learning").otherwise("round_robin")).when(
        (gap == 0) & far, F.when(ql_mean < rr_mean, "q_learning").otherwise("round_robin")
    )
    return F.struct(winner.alias("winner"), winner.isNull().alias("equivalent"))
