"""Small networks: training on the driver, genetic fitness on the executors.

A training step depends on the one before, so the learners are loops over a bounded training set
in numpy; what can be spread, the fitness of a population, is a DataFrame operation."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written
from .scan import scan


class Network:
    """Sigmoid layers. weights[l] has a row for the bias (its input is -1), then one for each input."""

    def __init__(self, sizes: list[int], weights: list[np.ndarray]):
        self.sizes, self.weights = list(sizes), weights

    @classmethod
    def random(cls, sizes: list[int], rng: np.random.Generator, low: float = -1.0, high: float = 1.0) -> Network:
        return cls(sizes, [rng.uniform(low, high, (a + 1, b)) for a, b in zip(sizes, sizes[1:], strict=False)])

    @classmethod
    def from_padded(cls, sizes: list[int], cube) -> Network:
        """Out of a cube [row][column][layer] padded with zeros, as artifacts store weights."""
        cube = np.asarray(cube, dtype=float)
        return cls(sizes, [cube[: a + 1, :b, n].copy() for n, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False))])

    @staticmethod
    def parameter_count(sizes: list[int]) -> int:
        return sum((a + 1) * b for a, b in zip(sizes, sizes[1:], strict=False))

    def genes(self) -> np.ndarray:
        """Weights as one row: layer by layer, row by row, bias first."""
        return np.concatenate([w.ravel() for w in self.weights])

    @classmethod
    def from_genes(cls, sizes: list[int], genes: np.ndarray) -> Network:
        if len(genes) != cls.parameter_count(sizes):
            raise ValueError("as many genes as weights are needed")
        cuts = np.cumsum([(a + 1) * b for a, b in zip(sizes, sizes[1:], strict=False)])[:-1]
        shapes = [(a + 1, b) for a, b in zip(sizes, sizes[1:], strict=False)]
        return cls(sizes, [g.reshape(s).copy() for g, s in zip(np.split(np.asarray(genes, float), cuts), shapes, strict=True)])

    def activations(self, x: np.ndarray) -> list[np.ndarray]:
        if x.shape[1] != self.sizes[0]:
            raise ValueError("input width does not match the network")
        out = [x]
        for w in self.weights:
            z = out[-1] @ w[1:]
            z -= w[0]
            out.append(sigmoid(z))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.activations(x)[-1][:, 0]

    def layers(self) -> list[list[list[float]]]:
        """As ``scoring.forward`` takes them: neurons of [bias, weights...]."""
        return [w.T.tolist() for w in self.weights]

    def learn(self, x: np.ndarray, y: np.ndarray, rate: float) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Online steps over rows in order: errors of the output; and for each layer, by row, its
        inputs (-1 first) and what they are multiplied by to give the change of its weights.

        The error goes back through the weights undivided by the output's slope, which is the rule
        of the networks that this must reproduce; each layer's own slope scales its change."""
        n, depth = len(x), len(self.weights)
        given = [np.column_stack([np.full(n, -1.0), x]), *(np.full((n, w.shape[1] + 1), -1.0) for w in self.weights)]
        scale = [np.empty((n, w.shape[1])) for w in self.weights]
        errors, room = np.empty((n, self.sizes[-1])), [np.empty_like(w) for w in self.weights]
        with np.errstate(over="ignore"):
            for truth, error, *rows in zip(y.reshape(n, -1), errors, *given, *scale):
                for i, w in enumerate(self.weights):
                    sigmoid(np.dot(rows[i], w, out=rows[i + 1][1:]))
                np.subtract(truth, rows[depth][1:], out=error)
                for i in range(depth - 1, -1, -1):
                    act, change = rows[i + 1][1:], rows[depth + 1 + i]
                    np.subtract(1.0, act, out=change)
                    change *= act
                    change *= error
                    change *= rate
                    w = self.weights[i]
                    if i:
                        error = w[1:] @ error
                    np.multiply(rows[i][:, None], change, out=room[i])
                    w += room[i]
        return errors, given[:-1], scale


def sigmoid(z: np.ndarray) -> np.ndarray:
    """1 / (1 + e^-z), in place."""
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1.0
    return np.reciprocal(z, out=z)


def mse(net: Network, x: np.ndarray, y: np.ndarray) -> float:
    with np.errstate(over="ignore"):
        return float(((y - net.score(x)) ** 2).mean())


def backpropagate(sizes: list[int], x: np.ndarray, y: np.ndarray, epochs: int, rate: float, seed: int, validation: tuple[np.ndarray, np.ndarray] | None = None, progress: Callable[[dict], None] | None = None) -> tuple[Network, list[dict]]:
    """Online learning in a new order each epoch, with one diagnostic record for each."""
    rng = np.random.default_rng(seed)
    net, history = Network.random(sizes, rng), []
    for epoch in range(1, epochs + 1):
        began, order = time.perf_counter(), rng.permutation(len(x))
        errors, given, scale = net.learn(x[order], y[order].astype(float), rate)
        hidden = given[1][:, 1:] if len(given) > 1 else given[0][:, :0]
        total, saturated = float((errors**2).mean(axis=1).sum()), int(((hidden < 0.05) | (hidden > 0.95)).sum())
        # a change is the product of a row of inputs and one of scales, so its size is one of sizes
        deltas = [(np.abs(g), np.abs(c)) for g, c in zip(given, scale, strict=True)]
        own = mse(net, x, y)
        held = mse(net, *validation) if validation else None
        record = {"epoch": epoch, "online_mse_mean": total / len(x), "train_mse_after_epoch": own, "validation_mse": held, "train_validation_gap": None if held is None else held - own,
                  "wall_seconds": time.perf_counter() - began, "hidden_saturation_percentage": 100.0 * saturated / hidden.size if hidden.size else 0.0}
        for n, (w, (g, c)) in enumerate(zip(net.weights, deltas, strict=True), 1):
            mean, most = float((g.mean(axis=1) * c.mean(axis=1)).mean()), float((g.max(axis=1) * c.max(axis=1)).max(initial=0.0))
            record |= {f"layer_{n}_weight_abs_mean": float(np.abs(w).mean()), f"layer_{n}_weight_std": float(w.std()), f"layer_{n}_delta_abs_mean": mean, f"layer_{n}_delta_abs_max": most}
        history.append(record)
        if progress:
            progress(record)
    return net, history


def fitness(population: DataFrame, sizes: list[int], x: np.ndarray, y: np.ndarray) -> DataFrame:
    """(individual, cost) of (individual, genes): mean squared error of each, spread over executors.

    The training set is shipped once to each executor; it is bounded by what the driver trains on."""
    spark = population.sparkSession
    shared = spark.sparkContext.broadcast((np.asarray(x, float), np.asarray(y, float)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            costs = [mse(Network.from_genes(sizes, np.asarray(g)), *shared.value) for g in f["genes"]]
            yield pd.DataFrame({"individual": f["individual"], "cost": costs})

    return population.select("individual", "genes").mapInPandas(run, "individual bigint, cost double")


def table_fitness(population: np.ndarray, sizes: list[int], rows: DataFrame, inputs: list[str], label: str) -> DataFrame:
    """(individual, cost) of a population's rows of genes: mean squared error of each over all rows
    of a table, null over none.

    The population is shipped to each executor; squared errors are summed there for each part of
    the table, then by individual, so no row of the training set reaches the driver."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(np.asarray(population, float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets = [Network.from_genes(sizes, g) for g in shared.value]
        total, n = np.zeros(len(nets)), 0
        for batch in batches:
            x, y = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(inputs))]), batch.column(len(inputs)).to_numpy(zero_copy_only=False)
            total += [((y - net.score(x)) ** 2).sum() for net in nets]
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(nets))), pa.array(total), pa.array(np.full(len(nets), n))], names=["individual", "error", "n"])

    given = rows.select(*[F.col(c).cast("double") for c in (*inputs, label)])
    sums = given.mapInArrow(run, "individual bigint, error double, n bigint").groupBy("individual").agg(F.sum("error").alias("error"), F.sum("n").alias("n"))
    people = spark.range(len(population)).withColumnRenamed("id", "individual")
    return people.join(sums, "individual", "left").select("individual", F.try_divide("error", "n").alias("cost"))


def select_parents(population: np.ndarray, costs: np.ndarray, rng: np.random.Generator, kind: int = 1, tournament: int = 3) -> np.ndarray:
    """1: the best of a few drawn without replacement; 2: by chance in proportion to 1 / cost."""
    n = len(population)
    if kind == 1:
        drawn = np.array([rng.choice(n, tournament, replace=False) for _ in range(n)])
        return population[drawn[np.arange(n), costs[drawn].argmin(axis=1)]].copy()
    if kind == 2:
        fit = 1.0 / (costs + 1e-12)
        return population[rng.choice(n, n, p=fit / fit.sum())].copy()
    raise ValueError("selection is 1 (tournament) or 2 (roulette)")


def cross(a: np.ndarray, b: np.ndarray, rng: np.random.Generator, kind: int = 1, rate: float = 0.8, eta: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """1: tails after one point change places; 2: simulated binary crossover, gene by gene."""
    if kind not in (1, 2):
        raise ValueError("crossover is 1 (one point) or 2 (simulated binary)")
    if rng.random() > rate:
        return a.copy(), b.copy()
    if kind == 1:
        cut = rng.integers(1, len(a))
        return np.r_[a[:cut], b[cut:]], np.r_[b[:cut], a[cut:]]
    u = rng.random(len(a))
    spread = np.where(u <= 0.5, 2 * u, 1 / (2 * (1 - u))) ** (1 / (eta + 1))
    mean, half = (a + b) / 2, spread * (a - b) / 2
    return mean + half, mean - half


def mutate(genes: np.ndarray, rng: np.random.Generator, kind: int = 1, rate: float = 0.02, low: float = -1.0, high: float = 1.0, sigma: float = 0.1, eta: float = 20.0) -> np.ndarray:
    """1: uniform anew; 2: normal step; 3: polynomial step; then held to the bounds."""
    out, hit, span = genes.copy(), rng.random(len(genes)) < rate, high - low
    n = int(hit.sum())
    if kind == 1:
        out[hit] = rng.uniform(low, high, n)
    elif kind == 2:
        out[hit] += rng.normal(0.0, sigma * span, n)
    elif kind == 3:
        u = rng.random(n)
        out[hit] += np.where(u < 0.5, (2 * u) ** (1 / (eta + 1)) - 1, 1 - (2 * (1 - u)) ** (1 / (eta + 1))) * span
    else:
        raise ValueError("mutation is 1 (uniform), 2 (normal) or 3 (polynomial)")
    return np.clip(out, low, high)


def diversity(population: np.ndarray, low: float, high: float) -> dict[str, float]:
    edge = 0.05 * (high - low)
    return {
        "population_diversity": float(population.std(axis=0).mean()), "gene_mean": float(population.mean()), "gene_std": float(population.std()),
        "near_weight_boundaries_percentage": float(100.0 * ((population <= low + edge) | (population >= high - edge)).mean()),
    }


def evolve(sizes: list[int], x: np.ndarray, y: np.ndarray, seed: int, population: int = 100, generations: int = 100, low: float = -1.0, high: float = 1.0, selection: int = 1, tournament: int = 3,
           crossover: int = 1, crossover_rate: float = 0.8, eta: float = 1.0, mutation: int = 1, mutation_rate: float = 0.02, sigma: float = 0.1, mutation_eta: float = 20.0,
           validation: tuple[np.ndarray, np.ndarray] | None = None, spark: SparkSession | None = None, progress: Callable[[dict], None] | None = None) -> tuple[Network, list[dict]]:
    """Evolution of weights; the best so far takes a random place in each new generation. With a
    session, each generation's fitness is computed on the executors."""
    rng = np.random.default_rng(seed)
    people = rng.uniform(low, high, (population, Network.parameter_count(sizes)))
    champion, least, history = people[0], np.inf, []
    for generation in range(1, generations + 1):
        began = time.perf_counter()
        if spark is None:
            costs = np.array([mse(Network.from_genes(sizes, g), x, y) for g in people])
        else:
            rows = spark.createDataFrame([(i, g.tolist()) for i, g in enumerate(people)], "individual bigint, genes array<double>")
            found = fitness(rows, sizes, x, y).collect()  # one number for each individual
            costs = np.array([r["cost"] for r in sorted(found, key=lambda r: r["individual"])])
        if costs.min() < least:
            least, champion = float(costs.min()), people[int(costs.argmin())].copy()
        held = mse(Network.from_genes(sizes, champion), *validation) if validation else None
        record = {"generation": generation, "generation_best_train_mse": float(costs.min()), "global_best_train_mse": least, "mean_train_mse": float(costs.mean()), "validation_mse": held,
                  "train_validation_gap": None if held is None else held - least, **diversity(people, low, high)}
        parents, born = select_parents(people, costs, rng, selection, tournament), []
        for i in range(0, population, 2):
            pair = cross(parents[i], parents[(i + 1) % population], rng, crossover, crossover_rate, eta)
            born += [mutate(g, rng, mutation, mutation_rate, low, high, sigma, mutation_eta) for g in pair]
        people = np.array(born[:population])
        people[rng.integers(population)] = champion
        record["wall_seconds"] = time.perf_counter() - began
        history.append(record)
        if progress:
            progress(record)
    return Network.from_genes(sizes, champion), history


def tournament(costs: DataFrame, draws: DataFrame) -> DataFrame:
    """(slot, individual): of the individuals drawn for each slot the one of the least cost, the first
    drawn of equals. costs: (individual, cost); draws: (slot, turn, individual)."""
    met = draws.join(costs, "individual")
    return met.groupBy("slot").agg(F.min_by("individual", F.struct("cost", "turn")).alias("individual"))


def roulette(costs: DataFrame, draws: DataFrame) -> DataFrame:
    """(slot, individual): each slot's draw from 0 to 1 falls into the share of one individual, which is in
    proportion to 1 / (cost + 1e-12). costs: (individual, cost); draws: (slot, drawn).

    Shares are prefix sums over ranges, and draws find theirs by their rank among the sums: nothing
    is sorted in one task."""
    fit = costs.select("individual", (1.0 / (F.col("cost") + 1e-12)).alias("fit"))
    sums = written(scan(fit, [], ["individual"], number="number", sums={"fit": "upto"}))
    whole, most = sums.agg(F.max("upto"), F.max("number")).first()
    if most is None:
        return draws.select("slot", F.lit(None).cast(costs.schema["individual"].dataType).alias("individual")).where("false")
    none = lambda kind: F.lit(None).cast(kind)
    both = sums.select(F.col("upto").alias("at"), F.lit(0).alias("draw"), none(draws.schema["slot"].dataType).alias("slot"), F.lit(1).alias("one"))
    both = both.union(draws.select((F.col("drawn") * F.lit(whole)).alias("at"), F.lit(1).alias("draw"), "slot", F.lit(0).alias("one")))
    passed = scan(both, [], ["at", "draw"], sums={"one": "passed"}).where("draw = 1")
    found = passed.select("slot", F.least(F.col("passed") + 1, F.lit(most)).alias("number"))
    return found.join(sums.select("number", "individual"), "number").select("slot", "individual")


def layers_of(genes: Column, sizes: list[int]) -> Column:
    """Genes as weights of each layer, row by row, the bias first; an error unless there are as many."""
    out, at = [], 1
    for a, b in zip(sizes, sizes[1:], strict=False):
        out.append(F.array(*[F.slice(genes, at + b * n, b) for n in range(a + 1)]))
        at += (a + 1) * b
    return F.when(F.size(genes) == at - 1, F.array(*out)).otherwise(F.raise_error(F.lit("as many genes as weights are needed")))


def genes_of(layers: Column) -> Column:
    """Weights as one row of genes, in the order of ``layers_of``."""
    return F.flatten(F.flatten(layers))


def crossed(a: Column, b: Column, cut: Column) -> Column:
    """struct(first, second): two rows of genes whose tails after ``cut`` genes have changed places."""
    size = F.size(a)
    tail = lambda x: F.slice(x, cut + 1, size - cut)
    return F.struct(F.concat(F.slice(a, F.lit(1), cut), tail(b)).alias("first"), F.concat(F.slice(b, F.lit(1), cut), tail(a)).alias("second"))


def blended(a: Column, b: Column, drawn: Column, eta: float = 1.0) -> Column:
    """struct(first, second): simulated binary crossover, gene by gene, for uniform draws."""
    power = 1.0 / (eta + 1.0)
    half = F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), drawn.alias("u")), lambda x: F.pow(F.when(x["u"] <= 0.5, 2 * x["u"]).otherwise(1 / (2 * (1 - x["u"]))), F.lit(power)) * (x["a"] - x["b"]) / 2)
    each = lambda sign: F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), half.alias("h")), lambda x: (x["a"] + x["b"]) / 2 + sign * x["h"])
    return F.struct(each(1).alias("first"), each(-1).alias("second"))


def mutated(genes: Column, hits: Column, drawn: Column, kind: int = 1, low: float = -1.0, high: float = 1.0, sigma: float = 0.1, eta: float = 20.0) -> Column:
    """Genes anew where ``hits`` is true, by draws: 1 uniform, 2 a step of normal draws, 3 a polynomial
    step; then held to the bounds."""
    span, power = high - low, 1.0 / (eta + 1.0)

    def anew(x: Column) -> Column:
        if kind == 1:
            return low + span * x["u"]
        if kind == 2:
            return x["g"] + sigma * span * x["u"]
        up = 1 - F.pow(2 * (1 - x["u"]), F.lit(power))
        return x["g"] + F.when(x["u"] < 0.5, F.pow(2 * x["u"], F.lit(power)) - 1).otherwise(up) * span

    rows = F.arrays_zip(genes.alias("g"), hits.alias("hit"), drawn.alias("u"))
    return F.transform(rows, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), F.when(x["hit"], anew(x)).otherwise(x["g"]))))


def history_frame(spark: SparkSession, history: list[dict]) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame(history))


def gene_statistics(population: DataFrame) -> DataFrame:
    """Mean over genes of the deviation over individuals, from (individual, genes)."""
    genes = population.select(F.posexplode("genes").alias("gene", "value"))
    return genes.groupBy("gene").agg(F.stddev_pop("value").alias("std")).agg(F.avg("std").alias("population_diversity"))
