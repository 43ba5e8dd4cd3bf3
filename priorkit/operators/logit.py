"""Penalised logistic fits beside an offset, with bounds on the coefficients, by projected Newton steps whose sums Spark takes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = (1.0, 0.5, 0.25, 0.0625, 0.0078125)


@dataclass
class Fit:
    """Coefficients of a fold, its objective in each round, and how far it is from the conditions of an optimum within the bounds."""

    beta: np.ndarray
    told: list[float] = field(default_factory=list)
    kkt: float = np.inf


def linear(columns: Sequence[str], beta: np.ndarray, offset: str) -> Column:
    return sum((F.col(c) * float(b) for c, b in zip(columns, beta)), F.col(offset))


def log_loss(f: Column) -> Column:
    """n ln(1 + e^f) - hits f, without overflow."""
    return F.col("n") * (F.greatest(f, F.lit(0.0)) + F.log1p(F.exp(-F.abs(f)))) - F.col("hits") * f


def bounded_logistic(cells: DataFrame, columns: Sequence[str], folds: Sequence[int], lower: Sequence[float], upper: Sequence[float], penalty: Sequence[float], offset: str = "offset", period: str = "season", rounds: int = 30, tolerance: float = 1e-9) -> dict[int, Fit]:
    """For each fold the coefficients within [lower, upper] with the least log loss on the periods before it plus `penalty` / 2 times their squares.

    Each round sums score and curvature of all folds in one aggregation, holds the coefficients that press on a bound, steps
    with the others, and takes the step length of the least objective from a second one. It ends when the projected
    gradient, for each line, is at most `tolerance`. Cells with a null column count for nothing.
    """
    d = len(columns)
    lo, hi, ridge = (np.array(v, float) for v in (lower, upper, penalty))
    whole = F.lit(True)
    for c in (*columns, "n", "hits", offset, period):
        whole = whole & F.col(c).isNotNull()
    cells = cells.where(whole)
    fits = {f: Fit(np.clip(np.zeros(d), lo, hi)) for f in folds}
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    active = list(folds)
    for _ in range(rounds):
        if not active:
            break
        sums = []
        for f in active:
            eta = linear(columns, fits[f].beta, offset)
            p = 1 / (1 + F.exp(-eta))
            seen = lambda v, f=f: F.coalesce(F.sum(F.when(F.col(period) < f, v)), F.lit(0.0))
            sums += [seen(log_loss(eta)).alias(f"l_{f}"), seen(F.col("n")).alias(f"n_{f}")] + [seen((F.col("n") * p - F.col("hits")) * F.col(c)).alias(f"g{i}_{f}") for i, c in enumerate(columns)]
            sums += [seen(F.col("n") * p * (1 - p) * F.col(columns[i]) * F.col(columns[j])).alias(f"h{i}_{j}_{f}") for i, j in pairs]
        row = cells.agg(*sums).first()
        steps = {}
        for f in list(active):
            fit = fits[f]
            g = np.array([row[f"g{i}_{f}"] for i in range(d)]) + ridge * fit.beta
            h = np.diag(ridge + 1e-12)
            for i, j in pairs:
                h[i, j] += row[f"h{i}_{j}_{f}"]
                h[j, i] = h[i, j]
            fit.told.append(float(row[f"l_{f}"] + 0.5 * (ridge * fit.beta**2).sum()))
            fit.kkt = float(np.abs(np.clip(fit.beta - g, lo, hi) - fit.beta).max(initial=0.0) / max(row[f"n_{f}"], 1.0))
            if fit.kkt <= tolerance:
                active.remove(f)
                continue
            free = ~(((fit.beta <= lo) & (g > 0)) | ((fit.beta >= hi) & (g < 0)))
            step = np.zeros(d)
            step[free] = -np.linalg.solve(h[np.ix_(free, free)], g[free])
            steps[f] = [np.clip(fit.beta + t * step, lo, hi) for t in STEPS]
        if not steps:
            break
        tried = cells.agg(*[F.coalesce(F.sum(F.when(F.col(period) < f, log_loss(linear(columns, b, offset)))), F.lit(0.0)).alias(f"t{k}_{f}") for f, s in steps.items() for k, b in enumerate(s)]).first()
        for f, s in steps.items():
            values = [tried[f"t{k}_{f}"] + 0.5 * (ridge * b**2).sum() for k, b in enumerate(s)]
            best = int(np.argmin(values))
            if values[best] > fits[f].told[-1] - 1e-12 * abs(fits[f].told[-1]):
                active.remove(f)  # no step is better in the digits of a double
                fits[f].beta = s[best] if values[best] <= fits[f].told[-1] else fits[f].beta
            else:
                fits[f].beta = s[best]
    return fits
