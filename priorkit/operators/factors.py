"""Low-rank factors of sparse matrices of cells (row, column, value): truncated singular values and weighted alternating least squares.

Cells are staged once, for singular values in buckets of the larger side's key. A half round is a join of the cells with one side's
vectors and a grouping by the other side's key, whatever the sizes of the sides; only r x r matrices come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import Stage, small


def parts(r: int, name: str = "x") -> list[str]:
    return [f"{name}{i}" for i in range(r)]


def gram(df: DataFrame, x: list[str], *more: Column) -> tuple[np.ndarray, list[float]]:
    """Sums of products of each two of the columns, and the sums of `more`, in one aggregation."""
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    row = df.agg(*[F.sum(F.col(x[i]) * F.col(x[j])) for i, j in pairs], *[F.sum(m) for m in more]).first()
    out = np.zeros((len(x), len(x)))
    for (i, j), v in zip(pairs, row):
        out[i, j] = out[j, i] = v or 0.0
    return out, [v or 0.0 for v in row[len(pairs) :]]


def turned(df: DataFrame, key: str, names: list[str], matrix: np.ndarray) -> DataFrame:
    """(key, x0, x1, ...): each vector times `matrix`."""
    to = parts(matrix.shape[1])
    return df.select(key, *[sum((F.col(n) * float(matrix[i, j]) for i, n in enumerate(names[1:], 1)), F.col(names[0]) * float(matrix[0, j])).alias(to[j]) for j in range(matrix.shape[1])])


def inverse_root(gram: np.ndarray) -> np.ndarray:
    """T with T' G T = 1 on the span of G; directions without length are cut to 0."""
    values, vectors = np.linalg.eigh(gram)
    good = values > max(values.max(initial=0.0), 0.0) * 1e-14
    return vectors * np.where(good, 1 / np.sqrt(np.where(good, values, 1.0)), 0.0)


#: A side's vectors are broadcast up to so many bytes of numbers.
BROADCAST_BYTES = 64_000_000


def hinted(df: DataFrame, rows: int, r: int) -> DataFrame:
    """`rows` vectors of r numbers with a broadcast hint if they are small, else built up part by part, beside cells in buckets of their key."""
    return F.broadcast(df) if rows * (r + 1) * 8 <= BROADCAST_BYTES else df.hint("shuffle_hash")


def multiplied(cells: DataFrame, vectors: DataFrame, rows: int, on: str, to: str, r: int) -> DataFrame:
    """(to, x0, ...): the matrix, or its transpose, times the `rows` vectors of one side."""
    x = parts(r)
    return cells.join(hinted(vectors, rows, r), on).groupBy(to).agg(*[F.sum(F.col("value") * F.col(c)).alias(c) for c in x])


def seeded(side: DataFrame, key: str, r: int) -> DataFrame:
    """Vectors of numbers between -1 and 1, hashed from the key."""
    return side.select(key, *[(F.pmod(F.xxhash64(F.lit(i), key), F.lit(1 << 20)) / float(1 << 19) - 1).alias(c) for i, c in enumerate(parts(r))])


def truncated_svd(cells: DataFrame, row: str, column: str, rank: int, stage: Stage, rounds: int = 60, tolerance: float = 1e-8, extra: int = 4) -> tuple[DataFrame, np.ndarray, DataFrame, float]:
    """(left, singular values, right, residual) of the `rank` leading directions of cells (row, column, value): block subspace iteration.

    A block of rank + `extra` vectors is multiplied by the matrix and its transpose in turn, and orthogonalised through
    its Gram matrix. It ends when the part of A'A V outside the span of V is at most `tolerance` of the largest
    squared singular value for the leading directions, or after `rounds`; that residual is returned. Cells of one place
    are added up; null keys or values are left out; absent cells are 0.
    """
    cells = cells.where(F.col(row).isNotNull() & F.col(column).isNotNull() & F.col("value").isNotNull())
    cells = stage(cells.groupBy(row, column).agg(F.sum("value").alias("value")))
    r = rank + extra
    x = parts(r)
    n_left, n_right = (cells.select(c).distinct().count() for c in (row, column))
    key = column if n_right >= n_left else row
    cells = stage.bucketed(cells, key)
    kept_by = lambda df, k: stage.bucketed(df, k) if k == key else stage(df)
    right = kept_by(seeded(cells.select(column).distinct(), column, r), column)
    right = turned(right, column, x, inverse_root(gram(right, x)[0]))
    residual, sigma = np.inf, np.zeros(r)
    z = [f"z{c}" for c in x]
    for _ in range(rounds):
        left = kept_by(multiplied(cells, right, n_right, column, row, r), row)
        values, vectors = np.linalg.eigh(gram(left, x)[0])  # V' A'A V
        order = np.argsort(values)[::-1]
        sigma, rotate = np.sqrt(np.maximum(values[order], 0)), vectors[:, order]
        left, right = turned(left, row, x, rotate), turned(right, column, x, rotate)  # A V and V by falling length
        again = kept_by(multiplied(cells, left, n_left, row, column, r).withColumnsRenamed(dict(zip(x, z))), column)
        zz, gaps = gram(again.join(right, column), z, *[F.pow(F.col(z[k]) - float(sigma[k]) ** 2 * F.col(x[k]), 2) for k in range(rank)])
        residual = np.sqrt(max(gaps, default=0.0)) / max(sigma[0] ** 2, 1e-300)
        if residual <= tolerance:
            break
        kept, right = right, turned(again, column, z, inverse_root(zz))
    else:
        right = kept if rounds else right  # the vectors that `left` belongs to
    keep = np.eye(r)[:, :rank]
    unit = np.diag([1 / s if s > 0 else 0.0 for s in sigma])[:, :rank]
    found = stage(turned(left, row, x, unit)), sigma[:rank], stage(turned(right, column, x, keep)), float(residual)
    stage.drop_tables()
    return found


def fitted_products(cells: DataFrame, left: DataFrame, right: DataFrame, row: str, column: str, sigma: np.ndarray, known: Column | None = None) -> DataFrame:
    """The cells with `fit`, the product of both sides' vectors; 0 where a side is unseen."""
    r = len(sigma)
    x, y = parts(r), parts(r, "y")
    out = cells.join(small(left), row, "left").join(small(right.withColumnsRenamed(dict(zip(x, y)))), column, "left")
    fit = sum((F.col(a) * F.col(b) * float(s) for a, b, s in zip(x, y, sigma)), F.lit(0.0))
    return out.withColumn("fit", F.coalesce(fit, F.lit(0.0))).drop(*x, *y)


def solved(cells: DataFrame, vectors: DataFrame, on: str, to: str, r: int, ridge: float) -> DataFrame:
    """(to, x0, ...): for each key of one side the weighted ridge of its cells' values on the other side's vectors."""
    x = parts(r)
    upper = [(i, j) for i in range(r) for j in range(i, r)]
    w = F.col("weight")
    sums = [F.sum(w * F.col(x[i]) * F.col(x[j])).alias(f"g{i}_{j}") for i, j in upper] + [F.sum(w * F.col("value") * F.col(c)).alias(f"t{i}") for i, c in enumerate(x)]
    grouped = cells.join(small(vectors), on).groupBy(to).agg(*sums)

    def work(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            g = np.zeros((len(pdf), r, r))
            for i, j in upper:
                g[:, i, j] = g[:, j, i] = pdf[f"g{i}_{j}"]
            t = pdf[[f"t{i}" for i in range(r)]].to_numpy()
            out = pd.DataFrame(np.linalg.solve(g + ridge * np.eye(r), t[..., None])[..., 0], columns=x)
            out.insert(0, to, pdf[to].to_numpy())
            yield out

    kind = cells.schema[to].dataType.simpleString()
    return grouped.mapInPandas(work, f"`{to}` {kind}, " + ", ".join(f"{c} double" for c in x))


def weighted_als(cells: DataFrame, row: str, column: str, rank: int, ridge: float, stage: Stage, rounds: int = 30, tolerance: float = 1e-7) -> tuple[DataFrame, DataFrame, list[float]]:
    """(left, right, objectives) with the least weighted squares of value - left . right, plus `ridge` times the squares of all vectors.

    `cells` has (row, column, value, weight). The start is the truncated SVD of the values; each half round solves an
    r x r system for each key exactly, so the objective never rises. It ends when a round gains less than `tolerance` of it.
    Cells of non-positive weight and null keys are left out.
    """
    cells = stage(cells.where(F.col(row).isNotNull() & F.col(column).isNotNull() & F.col("value").isNotNull() & (F.col("weight") > 0)).select(row, column, "value", "weight"))
    _, sigma, right, _ = truncated_svd(cells.select(row, column, "value"), row, column, rank, stage, rounds=8, tolerance=1e-3)
    x, y = parts(rank), parts(rank, "y")
    right = stage(turned(right, column, x, np.diag(np.sqrt(np.maximum(sigma, 1e-6)))))
    told: list[float] = []
    for _ in range(rounds):
        left = stage(solved(cells, right, column, row, rank, ridge))
        right = stage(solved(cells, left, row, column, rank, ridge))
        fit = sum((F.col(a) * F.col(b) for a, b in zip(x, y)), F.lit(0.0))
        j = cells.join(small(left), row).join(small(right.withColumnsRenamed(dict(zip(x, y)))), column)
        loss = j.agg(F.sum(F.col("weight") * F.pow(F.col("value") - fit, 2)).alias("l")).first()["l"] or 0.0
        squares = sum(df.agg(F.sum(sum((F.col(c) * F.col(c) for c in x), F.lit(0.0))).alias("q")).first()["q"] or 0.0 for df in (left, right))
        told.append(loss + ridge * squares)
        if len(told) > 1 and told[-2] - told[-1] <= tolerance * told[-2]:
            break
    return left, right, told
