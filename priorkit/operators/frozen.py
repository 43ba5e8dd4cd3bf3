"""A linear pipeline that is fitted, stored, read and applied: missing values filled and flagged, columns standardised, ridge.

One scan adds up the products of values, flags and outcome by period, a task's in one array. Fill values, means, scales and
coefficients of every fold follow from these sums, as filling and standardising are linear in values and flags.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "fold int, feature string, place int, fill double, mean double, scale double, coefficient double, flag double, intercept double, alpha double, lines double"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def absent(x: Column) -> Column:
    """Null, NaN and infinite values are missing."""
    x = x.cast("double")
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def period_products(rows: DataFrame, features: Sequence[str], outcome: str, period: str) -> dict[int, np.ndarray]:
    """{period: products of (1, values or 0, flags, outcome)}; rows without outcome or period do not count."""
    kind, width = rows.schema[period].dataType.simpleString(), 2 * len(features) + 2
    known = rows.where(~absent(F.col(outcome)) & F.col(period).isNotNull()).select(F.col(period).alias("p"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(features)], F.col(outcome).cast("double").alias("y"))

    def products(batches):
        sums: dict = {}
        for pdf in batches:
            x = pdf.iloc[:, 1:-1].to_numpy(float)
            gone = ~np.isfinite(x)
            z = np.column_stack([np.ones(len(x)), np.where(gone, 0.0, x), gone, pdf["y"].to_numpy(float)])
            for k, at in pdf.groupby("p").indices.items():
                sums[k] = sums.get(k, 0.0) + z[at].T @ z[at]
        for k, g in sums.items():
            yield pd.DataFrame({"p": k, "i": np.arange(g.size), "v": g.ravel()})

    out: dict[int, np.ndarray] = {}
    for r in known.mapInPandas(products, f"p {kind}, i int, v double").groupBy("p", "i").agg(F.sum("v").alias("v")).collect():  # a matrix for each period
        out.setdefault(r["p"], np.zeros(width * width))[r["i"]] = r["v"]
    return {k: g.reshape(width, width) for k, g in out.items()}


def fit_fold(g: np.ndarray, features: Sequence[str], alpha: float, fold: int) -> list[dict]:
    """The stored rows of one fold, from the products of the periods before it.

    A missing value is filled with the mean of those that are there (0 if none is), a column without spread has scale 1.
    The penalty spares the intercept.
    """
    m, n = len(features), g[0, 0]
    # columns of the design as sums of (1, values, flags): 1, standardised values, flags
    design = np.zeros((2 * m + 1, 2 * m + 1))
    design[0, 0] = 1
    fills, means, scales = [], [], []
    for i in range(m):
        there = n - g[0, 1 + m + i]
        fill = g[0, 1 + i] / there if there else 0.0
        mean = (g[0, 1 + i] + fill * g[0, 1 + m + i]) / n
        square = (g[1 + i, 1 + i] + fill * fill * g[1 + m + i, 1 + m + i]) / n  # a value and its flag are never both there
        scale = float(np.sqrt(max(square - mean * mean, 0.0)))
        scale = scale if scale > 1e-9 * max(1.0, abs(mean)) else 1.0
        design[1 + i, [0, 1 + i, 1 + m + i]] = [-mean / scale, 1 / scale, fill / scale]
        design[1 + m + i, 1 + m + i] = 1
        fills.append(fill), means.append(mean), scales.append(scale)
    penalty = alpha * np.eye(2 * m + 1)
    penalty[0, 0] = 0
    w = np.linalg.solve(design @ g[:-1, :-1] @ design.T + penalty, design @ g[:-1, -1])
    return [dict(zip(NAMES, (fold, c, i, float(fills[i]), float(means[i]), float(scales[i]), float(w[1 + i]), float(w[1 + m + i]), float(w[0]), float(alpha), float(n)))) for i, c in enumerate(features)]


def fit(rows: DataFrame, features: Sequence[str], outcome: str, folds: Sequence[int], alpha: float = 10.0, period: str = "season") -> list[dict]:
    """A pipeline for each fold that has rows in periods before it, fitted on those alone."""
    if alpha <= 0:
        raise ValueError("alpha has to be above 0: a flag that is never set has no coefficient otherwise")
    by, out = period_products(rows, features, outcome, period), []
    for f in folds:
        before = [g for p, g in by.items() if p < f]
        if before:
            out += fit_fold(np.sum(before, axis=0), features, alpha, f)
    return out


def save(spark: SparkSession, stored: list[dict], path: str) -> None:
    """Write the pipelines as JSON lines, one for each fold and feature."""
    spark.createDataFrame([tuple(r[c] for c in NAMES) for r in stored], SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> list[dict]:
    """Read and check stored pipelines: every number is there and finite, scales are above 0, a fold's places are gapless, one intercept for all its features."""
    stored = [r.asDict() for r in spark.read.schema(SCHEMA).json(path).collect()]
    for r in stored:
        if any(v is None for v in r.values()) or not all(np.isfinite(r[c]) for c in NAMES[3:]) or r["scale"] <= 0:
            raise ValueError(f"{path}: feature {r['feature']} of fold {r['fold']} is not whole")
    for f in {r["fold"] for r in stored}:
        own = [r for r in stored if r["fold"] == f]
        if sorted(r["place"] for r in own) != list(range(len(own))) or len({r["intercept"] for r in own}) > 1 or len({r["feature"] for r in own}) < len(own):
            raise ValueError(f"{path}: fold {f} is not one pipeline")
    return sorted(stored, key=lambda r: (r["fold"], r["place"]))


def apply(rows: DataFrame, stored: list[dict], out: str, period: str = "season") -> DataFrame:
    """`rows` with `out`: the prediction of the pipeline whose fold is the row's period, null where there is none. A row's depends on no other row."""
    if not stored:
        return rows.withColumn(out, F.lit(None).cast("double"))
    by: dict[int, dict] = {}
    for r in sorted(stored, key=lambda r: (r["fold"], r["place"])):
        by.setdefault(r["fold"], {})[r["feature"]] = r
    features = list(next(iter(by.values())))
    if any(set(own) != set(features) for own in by.values()):
        raise ValueError("the pipelines are not of the same features")
    numbers = np.array([[[own[c][n] for n in ("fill", "mean", "scale", "coefficient", "flag")] for c in features] for own in by.values()])
    start, folds = np.array([own[features[0]]["intercept"] for own in by.values()]), np.array(list(by))

    @F.pandas_udf("double")
    def predicted(at: pd.Series, *values: pd.Series) -> pd.Series:
        at, total = at.to_numpy(float), np.full(len(at), np.nan)
        for f, own, first in zip(folds, numbers, start):
            here = np.flatnonzero(at == f)
            t = np.full(len(here), first)
            for v, (fill, mean, scale, coefficient, flag) in zip(values, own):
                x = v.to_numpy(float)[here]
                gone = ~np.isfinite(x)
                t += (np.where(gone, fill, x) - mean) / scale * coefficient + np.where(gone, flag, 0.0)
            total[here] = t
        return pd.Series(total)

    # taken as nondeterministic, so that a filter on it is not pushed below it and computed a second time
    moved = rows.withColumn(out, predicted.asNondeterministic()(F.col(period), *[F.col(c).cast("double") for c in features]))
    return moved.withColumn(out, F.when(F.col(period).isin(*map(int, folds)), F.col(out)))
