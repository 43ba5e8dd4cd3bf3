"""Interaction models trained by full-batch Adam, each gradient of which is one Spark aggregate.

Rows are cells: codes of fields, how many lines and hits they have, and an offset on the logit. As
fields are binned, there are no more cells than combinations of bins, however many lines. A task
turns its cells into sums of gradients, and Spark adds them up; parameters, a few for each bin, stay
on the driver. All folds (which periods a model may see) take their step in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Params = dict[str, np.ndarray]


def expit(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def anova(z: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(kernel, its gradient by z) for z (b, m, r): sums over all sets of `order` of the m entries of their products, summed over r."""
    b, m, r = z.shape
    table = np.zeros((order + 1, m + 1, b, r))  # table[t, j]: sets of t of the first j
    table[0] = 1
    for t in range(1, order + 1):
        for j in range(1, m + 1):
            table[t, j] = table[t, j - 1] + z[:, j - 1] * table[t - 1, j - 1]
    slope, grad = np.zeros((order + 2, b, r)), np.zeros_like(z)
    slope[order] = 1
    for j in range(m, 0, -1):  # slope[t]: of the kernel by table[t, j]
        for t in range(1, order + 1):
            grad[:, j - 1] += slope[t] * table[t - 1, j - 1]
        for t in range(order):
            slope[t] = slope[t] + slope[t + 1] * z[:, j - 1]
    return table[order, m].sum(axis=1), grad


class Factorisation:
    """A factorisation machine of orders 1 to 3: a weight for each bin, and for each higher order a vector."""

    def __init__(self, sizes: Sequence[int], rank: int = 3, orders: Sequence[int] = (2, 3)):
        self.sizes, self.rank, self.orders = list(sizes), rank, list(orders)

    def start(self, seed: int) -> Params:
        rng, n = np.random.default_rng(seed), sum(self.sizes)
        return {"w0": np.zeros(1), "w": np.zeros(n)} | {f"v{o}": 0.1 * rng.normal(size=(n, self.rank)) for o in self.orders}

    def score(self, p: Params, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return p["w0"][0] + (p["w"][at] * x).sum(axis=1) + sum(anova(p[f"v{o}"][at] * x[..., None], o)[0] for o in self.orders)

    def gradient(self, p: Params, at: np.ndarray, x: np.ndarray, slope: np.ndarray) -> Params:
        out = {k: np.zeros_like(v) for k, v in p.items()}
        out["w0"][0] = slope.sum()
        np.add.at(out["w"], at, slope[:, None] * x)
        for o in self.orders:
            np.add.at(out[f"v{o}"], at, anova(p[f"v{o}"][at] * x[..., None], o)[1] * (slope[:, None] * x)[..., None])
        return out


class CrossNetwork:
    """Layers x' = x0 * (W x + b) + x over the vectors of all fields, and a weight for each number of the last."""

    def __init__(self, sizes: Sequence[int], width: int = 3, layers: int = 2):
        self.sizes, self.width, self.layers = list(sizes), width, layers

    def start(self, seed: int) -> Params:
        rng, n, d = np.random.default_rng(seed), sum(self.sizes), len(self.sizes) * self.width
        out = {"e": 0.3 * rng.normal(size=(n, self.width)), "w0": np.zeros(1), "w": 0.1 * rng.normal(size=d)}
        for k in range(self.layers):
            out |= {f"m{k}": rng.normal(size=(d, d)) / d, f"b{k}": np.zeros(d)}
        return out

    def forward(self, p: Params, at: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        levels = [(p["e"][at] * x[..., None]).reshape(len(at), -1)]
        for k in range(self.layers):
            levels.append(levels[0] * (levels[-1] @ p[f"m{k}"].T + p[f"b{k}"]) + levels[-1])
        return levels

    def score(self, p: Params, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return p["w0"][0] + self.forward(p, at, x)[-1] @ p["w"]

    def gradient(self, p: Params, at: np.ndarray, x: np.ndarray, slope: np.ndarray) -> Params:
        levels = self.forward(p, at, x)
        out = {k: np.zeros_like(v) for k, v in p.items()}
        out["w0"][0], out["w"] = slope.sum(), levels[-1].T @ slope
        back, base = slope[:, None] * p["w"], np.zeros_like(levels[0])
        for k in range(self.layers - 1, -1, -1):
            inner = back * levels[0]
            base += back * (levels[k] @ p[f"m{k}"].T + p[f"b{k}"])
            out[f"m{k}"], out[f"b{k}"] = inner.T @ levels[k], inner.sum(axis=0)
            back = inner @ p[f"m{k}"] + back
        back = (back + base).reshape(*at.shape, self.width)
        np.add.at(out["e"], at, back * x[..., None])
        return out


def flat(p: Params) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def shaped(vector: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = vector[at : at + v.size].reshape(v.shape)
        at += v.size
    return out


def inputs(pdf: pd.DataFrame, fields: Sequence[str], sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of parameters, values): a null code, or one outside its field, adds nothing."""
    codes = pdf[list(fields)].to_numpy(float)
    good = (codes >= 0) & (codes < np.array(sizes))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return (np.where(good, codes, 0) + starts).astype(np.int64), good.astype(float)


def adam(steps: int, rate: float):
    """(moment, update) of Adam's steps."""
    m = v = 0.0
    for t in range(1, steps + 1):
        g = yield
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        yield -rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def loss_and_gradient(machine, p: Params, at, x, n, hits, offset) -> np.ndarray:
    """Log loss of the cells and the gradient of all parameters, in one array."""
    f = machine.score(p, at, x) + offset
    told = (n * np.logaddexp(0, f) - hits * f).sum()
    return np.concatenate([[told], flat(machine.gradient(p, at, x, n * expit(f) - hits))])


def train(cells: DataFrame, machine, fields: Sequence[str], folds: Sequence[int], period: str = "season", steps: int = 40, rate: float = 0.05, penalty: float = 1.0, seed: int = 7, least_gain: float = 1e-6) -> dict[int, tuple[Params, list[float]]]:
    """For each fold its parameters and the objective of each step: log loss of the cells of periods before the fold, and `penalty` / 2 times the squares of all but the intercept.

    `cells` has the fields' codes, n, hits, offset and `period`; a null period belongs to no fold. The objective is divided
    by the fold's lines. A fold stops when a step gains less than `least_gain`, or after `steps`.
    """
    start = machine.start(seed)
    size = flat(start).size
    free = flat({k: np.zeros_like(v) if k == "w0" else np.ones_like(v) for k, v in start.items()})
    vectors = {f: flat(start).copy() for f in folds}
    movers = {f: adam(steps, rate) for f in folds}
    told: dict[int, list[float]] = {f: [] for f in folds}
    cells = cells.select(period, *fields, "n", "hits", "offset")
    lines = {f: 0.0 for f in folds}
    for r in cells.groupBy(period).agg(F.sum("n").alias("n")).collect():  # a row for each period
        for f in folds:
            lines[f] += r["n"] if r[0] is not None and r[0] < f else 0
    active = [f for f in folds if lines[f]]
    for _ in range(steps):
        if not active:
            break
        params = {f: shaped(vectors[f], start) for f in active}

        def work(batches: Iterator[pd.DataFrame], params=params):
            total = {f: np.zeros(size + 1) for f in params}
            for pdf in batches:
                at, x = inputs(pdf, fields, machine.sizes)
                when = pdf[period].to_numpy(float)
                n, hits, offset = (pdf[c].to_numpy(float) for c in ("n", "hits", "offset"))
                for f, p in params.items():
                    seen = when < f
                    if seen.any():
                        total[f] += loss_and_gradient(machine, p, at[seen], x[seen], n[seen], hits[seen], offset[seen])
            for f, v in total.items():
                yield pd.DataFrame({"fold": f, "i": np.arange(size + 1), "v": v})

        sums = {f: np.zeros(size + 1) for f in active}
        for r in cells.mapInPandas(work, "fold int, i int, v double").groupBy("fold", "i").agg(F.sum("v").alias("v")).toPandas().itertuples():
            sums[r.fold][r.i] = r.v
        for f in list(active):
            p = vectors[f]
            objective = (sums[f][0] + 0.5 * penalty * (free * p * p).sum()) / lines[f]
            if told[f] and abs(told[f][-1] - objective) < least_gain:
                active.remove(f)
            told[f].append(float(objective))
            if f in active:
                next(movers[f])
                vectors[f] = p + movers[f].send((sums[f][1:] + penalty * free * p) / lines[f])
    return {f: (shaped(vectors[f], start), told[f]) for f in folds}


def scored(cells: DataFrame, machine, fields: Sequence[str], fitted: dict[int, tuple[Params, list[float]]], period: str = "season") -> DataFrame:
    """The cells of each fold's own period with the model's `logit`, offset included; null where no fold is of their period."""
    params = {f: p for f, (p, _) in fitted.items()}

    def work(batches):
        for pdf in batches:
            at, x = inputs(pdf, fields, machine.sizes)
            out = np.full(len(pdf), np.nan)
            when = pdf[period].to_numpy(float)
            for f, p in params.items():
                own = when == f
                if own.any():
                    out[own] = machine.score(p, at[own], x[own]) + pdf["offset"].to_numpy(float)[own]
            yield pdf.assign(logit=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema)
    return cells.mapInPandas(work, f"{schema}, logit double").withColumn("logit", F.when(~F.isnan("logit"), F.col("logit")))
