"""Boosted trees for outcomes of several classes, and for several such outcomes at once, over cells of binned fields.

Every class of every outcome has its own tree in a round; all of them, for all folds, are grown
from one aggregate a level. Tasks sum gradients and curvatures of the softmax loss by node, field and code.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import Ensemble, added_up, codes_of, ensembles, grow, node_of, pile

#: Added to the count of every class before its share is taken, so that a class not seen yet has a share.
SMOOTHING = 0.5


@dataclass
class ClassModel:
    """`nodes` name a fold and a class; `shares` has, for each fold, the share of every class before it, periods weighing alike."""

    groups: list[list[str]]
    fields: list[str]
    shares: dict[int, dict[str, float]]
    nodes: list[dict]

    def walkers(self) -> dict[tuple[int, str], Ensemble]:
        return ensembles(self.nodes, self.fields, [(f, c) for f in self.shares for g in self.groups for c in g])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(walkers: dict, shares: dict[str, float], group: Sequence[str], fold: int, x: np.ndarray) -> np.ndarray:
    """(rows, classes): of each row one probability for each class of the group."""
    return softmax(np.column_stack([np.log(shares[c]) + walkers[fold, c].contributions(x).sum(axis=1) for c in group]))


def period_weights(totals: pd.DataFrame, period: str, folds: Sequence[int]) -> dict[int, dict[int, float]]:
    """{fold: {period: weight of a line}}: periods before the fold weigh alike, lines one on average."""
    n = {int(p): float(v) for p, v in zip(totals[period], totals["n"])}
    out = {}
    for f in folds:
        before = {p: v for p, v in n.items() if p < f and v > 0}
        out[f] = {p: sum(before.values()) / len(before) / v for p, v in before.items()}
    return out


def boost_classes(
    cells: DataFrame, fields: Sequence[str], sizes: Sequence[int], groups: Sequence[Sequence[str]], folds: Sequence[int],
    period: str = "season", rounds: int = 6, depth: int = 2, rate: float = 0.3, ridge: float = 20.0, least: float = 5.0,
) -> ClassModel:
    """A model of each fold, fitted on the cells of the periods before it, which weigh alike whatever their lines.

    `cells` has the fields' codes (null is missing), `period` and the count of every class; a group's classes are
    disjoint and add up to the cell's lines. Cells without a period are seen by no fold. A leaf is `rate` times gradients
    over curvatures plus `ridge`; a split needs curvatures of `least` on either side.
    """
    groups, fields = [list(g) for g in groups], list(fields)
    names = [c for g in groups for c in g]
    cells = cells.select(period, *fields, *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in names]).where(F.col(period).isNotNull())
    lines = sum(F.col(c) for c in groups[0])
    totals = cells.groupBy(period).agg(F.sum(lines).alias("n"), *[F.sum(c).alias(c) for c in names]).toPandas()  # a row for each period
    weights = period_weights(totals, period, folds)
    folds = [f for f in folds if weights[f]]
    shares = {}
    for f in folds:
        w = totals[period].map(weights[f]).fillna(0.0).to_numpy(float)
        counts = {c: float(w @ totals[c].to_numpy(float)) + SMOOTHING for c in names}
        shares[f] = {c: counts[c] / sum(counts[o] for o in g) for g in groups for c in g}
    model = ClassModel(groups, fields, shares, [])
    keys = [(f, c) for f in folds for c in names]

    def histograms(growing: dict, level: int) -> dict:
        width, walkers = 2**level, model.walkers()

        def work(batches):
            total = np.zeros((len(keys), width, sum(s + 1 for s in sizes), 2))
            for pdf in batches:
                x, when = codes_of(pdf, fields), pdf[period]
                for f in folds:
                    seen = (when < f).to_numpy(bool)
                    if not seen.any():
                        continue
                    y, w = x[seen], when[seen].map(weights[f]).fillna(0.0).to_numpy(float)
                    for g in groups:
                        own = pdf[g].to_numpy(float)[seen]
                        n, p = own.sum(axis=1), probabilities(walkers, shares[f], g, f, y)
                        for k, c in enumerate(g):
                            values = np.column_stack([w * n * p[:, k] * (1 - p[:, k]), w * (own[:, k] - n * p[:, k])])
                            pile(total[keys.index((f, c))], y, node_of(growing[f, c], fields, y), values, sizes)
            for i, v in enumerate(total):
                yield pd.DataFrame({"key": i, "i": np.arange(v.size), "v": v.ravel()})

        return added_up(cells.mapInPandas(work, "key int, i int, v double"), "key", keys, width, sizes)

    for t in range(rounds):
        model.nodes = model.nodes + grow(histograms, keys, t, fields, sizes, depth, rate, ridge, least)
    return model


def class_scored(cells: DataFrame, model: ClassModel, period: str = "season", prefix: str = "p_") -> DataFrame:
    """The cells with a probability for each class, by the model of their period's fold; null where there is none. A row's depend on no other row."""
    walkers = model.walkers()
    names = [prefix + c for g in model.groups for c in g]

    def work(batches):
        for pdf in batches:
            x, when, out = codes_of(pdf, model.fields), pdf[period].to_numpy(float), np.full((len(pdf), len(names)), np.nan)
            for f, shares in model.shares.items():
                own = when == f
                if own.any():
                    out[own] = np.column_stack([probabilities(walkers, shares, g, f, x[own]) for g in model.groups])
            yield pdf.assign(**{c: out[:, i] for i, c in enumerate(names)})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema), *(f"`{c}` double" for c in names)])
    return cells.mapInPandas(work, schema).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})


def rolling_ridge(scored: DataFrame, columns: Sequence[str], rest: str, n: str, alpha: float, period: str = "season") -> dict[int, np.ndarray]:
    """{period: coefficients}: ridge of `rest` (sums) on the columns, over the cells of all periods before it that have them; periods with none before are not there."""
    have = scored.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns) + f" AND `{period}` IS NOT NULL")
    m = len(columns)
    sums = [F.sum(F.col(n) * F.col(columns[i]) * F.col(columns[j])).alias(f"g_{i}_{j}") for i in range(m) for j in range(i, m)]
    by = have.groupBy(period).agg(*sums, *[F.sum(F.col(rest) * F.col(c)).alias(f"b_{i}") for i, c in enumerate(columns)]).orderBy(period).collect()  # a row for each period
    g, b, out = np.zeros((m, m)), np.zeros(m), {}
    for k, r in enumerate(by):
        if k:
            out[r[period]] = np.linalg.solve(g + alpha * np.eye(m), b)
        g = g + np.array([[r[f"g_{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)])
        b = b + np.array([r[f"b_{i}"] for i in range(m)])
    return out
