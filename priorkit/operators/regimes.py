"""Sticky hidden Markov models with diagonal Gaussian emissions, fitted by MAP expectation maximisation.

Sequences are rows; a task turns its sequences into sums of expected counts, which Spark
adds up, so that a round sends some dozens of numbers a model to the driver. All
folds (how many periods a model may see) and all starts are updated in one pass; a model that
stalls leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prior of emissions: pseudo-observations of the mean at 0, and shape and scale of the variance.
KAPPA, SHAPE, SCALE = 1.0, 2.0, 1.0


@dataclass
class Regimes:
    """A model of k states over d numbers: it may see the first `upto` periods. `told` holds the objective of each round."""

    upto: int
    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    told: list[float] = field(default_factory=list)
    stalled: bool = False

    def log_emission(self, x: np.ndarray) -> np.ndarray:
        """Log density of x (..., d) in each state; a number that is NaN says nothing."""
        gap = x[..., None, :] - self.mean
        each = -0.5 * (gap * gap / self.var + np.log(2 * np.pi * self.var))
        return np.where(np.isnan(each), 0.0, each).sum(axis=-1)

    def log_prior(self, sticky: float) -> float:
        k = len(self.start)
        dirichlet = np.log(self.start).sum() + ((1 + sticky * np.eye(k)) * np.log(self.move)).sum()
        return float(dirichlet - ((SHAPE + 1.5) * np.log(self.var) + (2 * SCALE + KAPPA * self.mean**2) / (2 * self.var)).sum())

    def stationary(self) -> np.ndarray:
        """The distribution that a move leaves as it is."""
        k = len(self.start)
        return np.linalg.lstsq(np.vstack([self.move.T - np.eye(k), np.ones(k)]), np.append(np.zeros(k), 1.0), rcond=None)[0]

    def ordered(self) -> Regimes:
        """States in ascending order of the mean of the first number."""
        o = np.argsort(self.mean[:, 0], kind="stable")
        return Regimes(self.upto, self.start[o], self.move[o][:, o], self.mean[o], self.var[o], self.told, self.stalled)


def filtered(model: Regimes, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(posterior after each period, scaled emissions, scales, log likelihoods) of sequences x (b, t, d)."""
    told = model.log_emission(x)
    most = told.max(axis=-1, keepdims=True)
    seen = np.exp(told - most)
    b, n, k = seen.shape
    state, scale = np.zeros((b, n, k)), np.zeros((b, n))
    for t in range(n):
        a = seen[:, t] * (model.start if t == 0 else state[:, t - 1] @ model.move)
        scale[:, t] = a.sum(axis=1)
        state[:, t] = a / scale[:, t, None]
    return state, seen, scale, (np.log(scale) + most[..., 0]).sum(axis=1)


def expected(model: Regimes, x: np.ndarray) -> np.ndarray:
    """Sums over the sequences x (b, t, d): starts, moves, then weight, sum and sum of squares of each state and number, and the log likelihood."""
    state, seen, scale, told = filtered(model, x)
    n = x.shape[1]
    back = np.ones_like(state)
    for t in range(n - 2, -1, -1):
        back[:, t] = (seen[:, t + 1] * back[:, t + 1]) @ model.move.T / scale[:, t + 1, None]
    moves = np.einsum("btk,btl->kl", state[:, :-1], seen[:, 1:] * back[:, 1:] / scale[:, 1:, None]) * model.move
    state = state * back
    here, filled = ~np.isnan(x), np.nan_to_num(x)
    weight = np.einsum("btk,btd->kd", state, here.astype(float))
    return np.concatenate([state[:, 0].sum(axis=0), moves.ravel(), weight.ravel(), np.einsum("btk,btd->kd", state, filled).ravel(), np.einsum("btk,btd->kd", state, filled**2).ravel(), [told.sum()]])


def maximised(model: Regimes, sums: np.ndarray, sticky: float) -> Regimes:
    """The model that the expected counts and the prior make likeliest."""
    k, d = model.mean.shape
    start, rest = sums[:k] + 1, sums[k:-1]
    move = rest[: k * k].reshape(k, k) + 1 + sticky * np.eye(k)
    weight, first, second = rest[k * k :].reshape(3, k, d)
    mean = first / (weight + KAPPA)
    var = (second - 2 * mean * first + weight * mean**2 + KAPPA * mean**2 + 2 * SCALE) / (weight + 2 * SHAPE + 3)
    return Regimes(model.upto, start / start.sum(), move / move.sum(axis=1, keepdims=True), mean, var, model.told, model.stalled)


def packed(sequences: DataFrame, d: int) -> DataFrame:
    """`sequences` with the numbers of all periods in one array, d for each, so that a task gets two flat arrays a row."""
    whole = F.transform("values", lambda v: F.coalesce(v, F.array_repeat(F.lit(None).cast("double"), d)))
    return sequences.withColumn("values", F.flatten(whole))


def dense(pdf: pd.DataFrame, periods: int, d: int) -> np.ndarray:
    """Packed sequences as (b, t, d), NaN where a period or a number is missing."""
    x = np.full((len(pdf), periods, d), np.nan)
    if len(pdf):
        row = np.repeat(np.arange(len(pdf)), [len(at) for at in pdf["periods"]])
        x[row, np.concatenate(pdf["periods"].to_list()).astype(int)] = np.concatenate(pdf["values"].to_list()).astype(float).reshape(-1, d)
    return x


def blocks(pdf: pd.DataFrame, size: int = 2000) -> Iterator[pd.DataFrame]:
    return (pdf.iloc[i : i + size] for i in range(0, len(pdf), size))


def spread(sequences: DataFrame) -> DataFrame:
    """`sequences` in as many parts as there are cores: they are few bytes, which Spark would leave to one task, and many rounds of work."""
    return sequences.repartition(max(sequences.sparkSession.sparkContext.defaultParallelism, 1), "entity")


def summed(sequences: DataFrame, work, n: int, d: int) -> np.ndarray:
    """`work(pdf)` gives an array of n numbers for some packed sequences; their sum over all of them."""

    def each(batches):
        total = np.zeros(n)
        for pdf in batches:
            for part in blocks(pdf):
                total += work(part)
        yield pd.DataFrame({"i": np.arange(n), "v": total})

    out = np.zeros(n)
    for r in packed(sequences, d).select("periods", "values").mapInPandas(each, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def kmeans_centres(sequences: DataFrame, k: int, d: int, upto: int, periods: int, starts: int, rounds: int = 8, sample: int = 2000) -> np.ndarray:
    """(starts, k, d) centres of the observations of the first `upto` periods: seeds far from each other in a sample by hash, then rounds over all observations."""
    each = sequences.select("entity", F.explode(F.arrays_zip("periods", "values")).alias("o")).where(F.col("o.periods") < upto)
    some = each.select("entity", "o.periods", "o.values").orderBy(F.xxhash64("entity", "periods"), "entity", "periods").limit(sample).collect()
    x = np.array([[np.nan if v is None else v for v in r["values"]] for r in some], float).reshape(-1, d)
    x = np.nan_to_num(x)  # a missing number is at the mean
    centres = np.zeros((starts, k, d))
    for s in range(starts):
        rng = np.random.default_rng(s)
        for j in range(k if len(x) else 0):
            far = np.ones(len(x)) if j == 0 else ((x[:, None] - centres[s, :j]) ** 2).sum(axis=2).min(axis=1)
            centres[s, j] = x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else x[0]
    for _ in range(rounds):

        def near(pdf, centres=centres):
            y = dense(pdf, periods, d)[:, :upto]
            y = np.nan_to_num(y[~np.isnan(y).all(axis=2)])
            out = np.zeros((starts, k, d + 1))
            for s in range(starts):
                own = ((y[:, None] - centres[s]) ** 2).sum(axis=2).argmin(axis=1)
                out[s] += np.column_stack([np.bincount(own, w, k) for w in (*y.T, np.ones(len(y)))])
            return out.ravel()

        sums = summed(sequences, near, starts * k * (d + 1), d).reshape(starts, k, d + 1)
        moved = np.where(sums[..., -1:] > 0, sums[..., :-1] / np.maximum(sums[..., -1:], 1), centres)
        if np.abs(moved - centres).max() < 1e-6:
            break
        centres = moved
    return centres


def fit(sequences: DataFrame, k: int, d: int, periods: int, folds: Sequence[int], starts: int = 3, sticky: float = 8.0, rounds: int = 60, tolerance: float = 1e-6) -> dict[int, Regimes]:
    """For each fold (a number of first periods) the best of `starts` models, states in order of their first mean.

    `sequences` has (entity, periods array<int> from 0, values array<array<double>>): missing periods and null numbers have no
    emission factor. A start's centres are those of k-means over the fold's observations. Rounds end when no objective
    (log likelihood and log prior) rises by more than `tolerance` of it; that of the best start is kept.
    """
    models = []
    for upto in folds:
        for c in kmeans_centres(sequences, k, d, upto, periods, starts):
            move = (1 + sticky * np.eye(k)) / (k + sticky)
            models.append(Regimes(upto, np.full(k, 1 / k), move, c, np.ones((k, d))))
    width = k + k * k + 3 * k * d + 1
    for _ in range(rounds):
        active = [i for i, m in enumerate(models) if not m.stalled]
        if not active:
            break

        def count(pdf, models=[models[i] for i in active]):
            x = dense(pdf, periods, d)
            return np.concatenate([expected(m, x[:, : m.upto]) for m in models])

        sums = summed(sequences, count, width * len(active), d).reshape(len(active), width)
        for i, s in zip(active, sums):
            told = s[-1] + models[i].log_prior(sticky)
            before = models[i].told[-1] if models[i].told else -np.inf
            models[i].told.append(float(told))
            models[i].stalled = bool(told - before <= tolerance * abs(told))
            if not models[i].stalled:
                models[i] = maximised(models[i], s, sticky)
    best = {upto: max((m for m in models if m.upto == upto), key=lambda m: m.told[-1] if m.told else -np.inf) for upto in folds}
    return {upto: m.ordered() for upto, m in best.items()}


def posteriors(sequences: DataFrame, model: Regimes, periods: int) -> DataFrame:
    """(entity, period, posterior): of every sequence after each period, given what came up to it. No later period is used."""
    d = model.mean.shape[1]
    kind = sequences.schema["entity"].dataType.simpleString()

    def walk(batches):
        for pdf in batches:
            for part in blocks(pdf):
                state = filtered(model, dense(part, periods, d))[0]
                yield pd.DataFrame({"entity": part["entity"].to_numpy(), "states": list(state.reshape(len(part), -1))})

    # a row for each sequence leaves the task, in numbers one after the other
    walked = packed(sequences, d).select("entity", "periods", "values").mapInPandas(walk, f"entity {kind}, states array<double>")
    k = len(model.start)
    each = walked.select("entity", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))).alias("period"), "states") if periods > 0 else walked.select("entity", F.lit(0).alias("period"), "states").limit(0)
    return each.select("entity", "period", F.slice("states", F.col("period") * k + 1, k).alias("posterior"))
