"""Exact solvers on small Gram matrices; the sums that make them are Spark aggregates.

Only matrices whose side is a fixed number of columns (contexts, candidates, features)
come to the driver, never one that grows with rows or entities.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import Stage


def gram(df: DataFrame, columns: Sequence[str], weight: Column | None = None) -> np.ndarray:
    """Weighted sums of products of all pairs of columns, in one aggregation."""
    w = F.lit(1.0) if weight is None else weight
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.sum(w * F.col(columns[i]) * F.col(columns[j])).alias(f"g{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"g{i}_{j}"] or 0.0
    return out


def low_rank(cells: DataFrame, entity: str, context: str, value: str, contexts: Sequence, rank: int) -> DataFrame:
    """(entity, context, value, reconstructed): the matrix entity x context, absent cells 0, cut to its leading `rank` singular directions.

    The right directions are the leading eigenvectors of the contexts' Gram matrix; each
    entity's row is then projected on them where it is, so no row leaves its executor.
    """
    names = [f"c{i}" for i in range(len(contexts))]
    filled = [F.coalesce(F.sum(F.when(F.col(context) == F.lit(c), F.col(value))), F.lit(0.0)).alias(n) for c, n in zip(contexts, names)]
    wide = cells.groupBy(entity).agg(*filled)
    values, vectors = np.linalg.eigh(gram(wide, names))
    keep = vectors[:, np.argsort(values)[::-1][:rank]]
    project = keep @ keep.T
    rebuilt = [sum(F.col(names[i]) * float(project[i, j]) for i in range(len(names))) for j in range(len(names))]
    items = F.array(*[F.struct(F.lit(c).alias(context), F.col(n).alias(value), r.alias("reconstructed")) for c, n, r in zip(contexts, names, rebuilt)])
    return wide.select(entity, F.explode(items).alias("x")).select(entity, "x.*")


def two_way_bias(cells: DataFrame, a: str, b: str, s: str, n: str, ka: float, kb: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Ridge biases of both sides after a fixed number of alternating exact updates, as (a, bias_a) and (b, bias_b).

    Cells are staged once; a round is a join and a grouping for each side, whatever their sizes. Null keys have no bias.
    """
    stage = Stage(cells.sparkSession)  # what is returned reads it
    cells = stage(cells.select(a, b, F.col(s).alias("__s"), F.col(n).alias("__n")))

    def side(key: str, other: str, biases: DataFrame, k: float) -> DataFrame:
        rest = F.sum(F.col("__s") - F.col("__n") * F.col(f"bias_{other}"))
        return cells.join(biases, b if key == a else a).groupBy(key).agg((rest / (F.sum("__n") + k)).alias("bias_a" if key == a else "bias_b"))

    at_b = cells.select(b).distinct().withColumn("bias_b", F.lit(0.0))
    for _ in range(rounds):
        at_b = stage(side(b, "a", stage(side(a, "b", at_b, ka)), kb))
    return side(a, "b", at_b, ka), at_b


def frank_wolfe(g: np.ndarray, steps: int = 2000, gap: float = 1e-12) -> tuple[np.ndarray, float]:
    """Weights on the simplex that minimise w' G w, with the certified gap to the optimum."""
    w = np.full(len(g), 1 / len(g))
    left = np.inf
    for _ in range(steps):
        slope = 2 * g @ w
        i = int(np.argmin(slope))
        left = float(slope @ w - slope[i])
        if left <= gap:
            break
        step = -w.copy()
        step[i] += 1
        bend = step @ g @ step
        w = w + min(1.0, left / (2 * bend) if bend > 0 else 1.0) * step
    return w, left


def minimax_simplex(grams: np.ndarray, sharpness: float = 1e8) -> tuple[np.ndarray, float, float]:
    """(weights, worst, gap): weights on the simplex with the least worst w' G w over the matrices (periods, k, k), and a certified bound of how much the worst could still fall.

    Newton steps on a barrier that grows sharper; the dual weights of the periods follow from its slack, and a tangent
    of their mixture gives the lower bound.
    """
    grams = np.asarray(grams, float)
    scale = max(float(np.abs(grams).max()), 1e-300)
    g, k = grams / scale, grams.shape[1]
    w = np.full(k, 1 / k)
    t = float((g @ w @ w).max()) + 1.0
    s = 1.0
    while s <= sharpness:
        for _ in range(60):
            slack = t - g @ w @ w
            slope = 2 * (g @ w)  # by period
            grad = np.append((slope / slack[:, None]).sum(axis=0) - 1 / w, s - (1 / slack).sum())
            h = np.zeros((k + 2, k + 2))
            h[:k, :k] = (2 * g / slack[:, None, None]).sum(axis=0) + np.einsum("yi,yj,y->ij", slope, slope, slack**-2) + np.diag(w**-2)
            h[:k, k] = h[k, :k] = -(slope / slack[:, None] ** 2).sum(axis=0)
            h[k, k] = (slack**-2).sum()
            h[k + 1, :k] = h[:k, k + 1] = 1
            step = np.linalg.solve(h, np.append(-grad, 0.0))[: k + 1]
            down = -float(grad @ step)
            if down < 1e-12:
                break
            a = 1.0 if down < 0.06 else 1 / (1 + np.sqrt(down))  # within reach of a self-concordant barrier
            while a > 1e-12:
                x, u = w + a * step[:k], t + a * step[k]
                x = x / x.sum()
                if (x > 0).all() and (u - g @ x @ x > 0).all():
                    w, t = x, u
                    break
                a /= 2
            else:
                break
        s *= 10
    dual = 1 / np.maximum(t - g @ w @ w, 1e-300)
    mixed = np.tensordot(dual / dual.sum(), g, 1)
    worst = float((g @ w @ w).max())
    slope = 2 * mixed @ w
    least = float(w @ mixed @ w - (slope @ w - slope.min()))  # no weights bring the mixture below
    return w, scale * worst, scale * max(worst - least, 0.0)


def ridge(df: DataFrame, features: Sequence[str], target: str, alpha: float, weight: Column | None = None) -> np.ndarray:
    """Coefficients of (X'WX + alpha I)^-1 X'Wy, without an intercept."""
    g = gram(df, [*features, target], weight)
    return np.linalg.solve(g[:-1, :-1] + alpha * np.eye(len(features)), g[:-1, -1])


def bounded_weights(g: np.ndarray, c: np.ndarray, most: float, steps: int = 5000) -> np.ndarray:
    """Non-negative weights with a bounded sum that minimise w' G w - 2 c' w, by projected gradients."""
    w = np.zeros(len(c))
    rate = 1 / (2 * np.linalg.eigvalsh(g)[-1] + 1e-12)
    for _ in range(steps):
        w = np.maximum(w - rate * 2 * (g @ w - c), 0)
        if w.sum() > most:  # on to the face where the sum is `most`
            s = np.sort(w)[::-1]
            t = (np.cumsum(s) - most) / np.arange(1, len(s) + 1)
            w = np.maximum(w - t[np.flatnonzero(s > t)[-1]], 0)
    return w
