"""Range checks of requests for trainings and experiments, as expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Range(NamedTuple):
    """Bounds of a parameter; ``above``: the least is excluded."""

    least: float
    most: float
    whole: bool = True
    above: bool = False


# Bounds of each kind of request.
BACKPROPAGATION = {"epochs": Range(1, 2000), "learning_rate": Range(0.0, 1.0, False, True)}
GENETIC = {
    "population": Range(4, 500), "generations": Range(1, 1000), "selection_type": Range(1, 2), "crossover_type": Range(1, 2), "crossover_rate": Range(0.0, 1.0, False), "sbx_eta": Range(0.01, 100.0, False),
    "mutation_type": Range(1, 3), "mutation_rate": Range(0.0, 1.0, False), "mutation_sigma": Range(0.0, 10.0, False), "mutation_eta": Range(0.01, 200.0, False), "weight_min": Range(-100.0, 100.0, False), "weight_max": Range(-100.0, 100.0, False),
}
BALANCER_TRAINING = {"episodes": Range(10, 5000)}
BALANCER_COMPARISON = {"requests": Range(6, 500), "concurrency": Range(1, 30)}
BALANCER_SESSION = {"requests": Range(1, 500), "epsilon": Range(0.0, 1.0, False), "interval_ms": Range(50, 3000), "concurrency": Range(1, 20)}


def problems(rules: dict[str, Range], value=F.col) -> Column:
    """array of the names of parameters that are missing, no number, no whole number where one is
    needed, or out of bounds. value(name) gives a parameter's column."""
    out = []
    for name, r in rules.items():
        x = value(name).cast("string").try_cast("double")
        ok = ((x > r.least) if r.above else (x >= r.least)) & (x <= r.most)
        if r.whole:
            ok = ok & (x == F.floor(x))
        out.append(F.when(~F.coalesce(ok, F.lit(False)), name))
    return F.array_compact(F.array(*[c.otherwise(F.lit(None)) for c in out]))


def genetic_problems(value=F.col) -> Column:
    """Those of ``GENETIC``, an odd population, a tournament that isn't from 2 to the population, and
    bounds of weights that aren't in order."""
    n, t = (value(c).cast("string").try_cast("int") for c in ("population", "tournament_size"))
    low, high = (value(c).cast("string").try_cast("double") for c in ("weight_min", "weight_max"))
    more = [F.when(n % 2 != 0, "population_even"), F.when(~F.coalesce(t.between(2, n), F.lit(False)), "tournament_size"), F.when(low >= high, "weight_order")]
    return F.concat(problems(GENETIC, value), F.array_compact(F.array(*[c.otherwise(F.lit(None)) for c in more])))


def session_problems(value=F.col) -> Column:
    mode = F.when(~F.coalesce(value("learning_mode").isin("fixed", "continuous"), F.lit(False)), "learning_mode").otherwise(F.lit(None))
    return F.concat(problems(BALANCER_SESSION, value), F.array_compact(F.array(mode)))
